import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.functions import calendar as cal
from larkspur.functions import text as tx
from larkspur.functions import vector
from larkspur.sources.html import visible


def one(spark, column, *values, schema=None):
    df = spark.createDataFrame([values or (1,)], schema or ", ".join(f"c{k} string" for k in range(max(1, len(values)))))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("the risks of a disruption", ["risks", "disruption"]),
        ("how much did they spend on research?", ["spend", "research"]),
        ("Revenue of $383.3 billion, 8.1% more", ["revenue", "$383.3", "billion", "8.1%"]),
        ("don't panic", ["don't", "panic"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, tx.tokens(F.col("c0")), text, schema="c0 string") == want


def test_token_estimate_is_half_even(spark):
    got = spark.createDataFrame([("x" * n,) for n in (0, 1, 2, 6, 10, 14)], "t string").select(tx.token_estimate(F.col("t"))).collect()
    assert [r[0] for r in got] == [1, 1, 1, 2, 2, 4]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<div><span>ITEM</span> <span>1A.</span> RISK FACTORS</div>", "ITEM 1A. RISK FACTORS"),
        ("<p>One</p><p>Two</p>", "One\nTwo"),
        ("<style>p{}</style><script>var x='</p>';</script><p>Visible</p>", "Visible"),
        ("<p>Apple’s    net</p>", "Apple's net"),
        ("<td>a</td><td>b</td>", "ab"),
        ("<title>T</title>a &amp;lt; b", "Ta &lt; b"),
        (None, ""),
    ],
)
def test_html_text(spark, html, want):
    assert one(spark, tx.html_text(F.col("c0")), html, schema="c0 string") == want
    loose = spark.createDataFrame([(visible(html),)], "t string").select(tx.normalised_text(F.col("t"))).first()[0]
    assert loose == want


@pytest.mark.parametrize(
    "text, n",
    [
        ("Revenue rose. Costs fell.", 2), ("Sales were $383.3 billion in all.", 1), ("Apple Inc. and others", 1), ("Up 8.1% vs. Fiscal 2021", 1),
        ("J. P. Morgan analysis. It was", 2), ("in fiscal 2022. The rest", 2), ('He said "Yes." Then left.', 2), ("One line\nAnother line", 2), ("  \n ", 0),
    ],
)
def test_sentences(spark, text, n):
    assert len(one(spark, tx.sentences(F.col("c0")), text)) == n


def test_labels(spark):
    label = lambda part, item: one(spark, tx.section_label(F.lit(part).cast("string"), F.lit(item).cast("string")))
    assert [label(None, None), label("I", "1"), label(None, "7A"), label("II", "")] == ["-", "I-1", "7A", "-"]
    assert one(spark, tx.citation(F.lit("320193"), F.lit(2023), F.lit("7"))) == "320193:2023:7"
    assert one(spark, tx.chunk_id(F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit(3))) == "a-----3"
    assert one(spark, tx.document_url("https://x.test/d/", F.lit("0000320193"), F.lit("00-1-2"), F.lit("k.htm"))) == "https://x.test/d/320193/0012/k.htm"
    assert one(spark, tx.without_heading(F.col("c0")), "ITEM 1. Business\nBody text") == "Body text"
    assert one(spark, tx.without_heading(F.col("c0")), "Item 1. Business") == "Item 1. Business"


def test_digest_is_order_free_and_unambiguous(spark):
    d = lambda *x: one(spark, tx.ids_digest(F.array(*map(F.lit, x))))
    assert d("a", "b") == d("b", "a") and d("ab", "c") != d("a", "bc") and len(d("a")) == 32


YEARS = [("2025-09-27", 9, 2025), ("2025-12-27", 9, 2026), ("2026-01-25", 1, 2026), ("2025-07-27", 1, 2026), ("2026-06-30", 6, 2026), ("2025-09-30", 6, 2026), ("2025-12-31", 12, 2025), ("2026-06-30", 12, 2026)]
QUARTERS = [("2022-12-31", 9, "Q1"), ("2023-04-01", 9, "Q2"), ("2023-07-01", 9, "Q3"), ("2025-07-27", 1, "Q2"), ("2025-10-26", 1, "Q3"), ("2025-09-30", 6, "Q1"), ("2025-12-31", 6, "Q2"), ("2026-03-31", 12, "Q1"), ("2026-06-30", 12, "Q2"), ("2025-09-30", 12, "Q3")]


def test_fiscal_calendar(spark):
    rows = [(dt.date.fromisoformat(d), m, str(v)) for d, m, v in YEARS + QUARTERS]
    df = spark.createDataFrame(rows, "d date, m int, want string")
    for r in df.select("want", cal.fiscal_year(F.col("d"), F.col("m")).cast("string").alias("y"), cal.fiscal_quarter(F.col("d"), F.col("m")).alias("q")).collect():
        assert r.want in (r.y, r.q), r
    sweep = spark.range(0, 371, 7).select(F.date_add(F.lit("2025-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"))
    assert {r[0] for r in sweep.select(cal.fiscal_quarter(F.col("d"), F.col("m"))).distinct().collect()} == {"Q1", "Q2", "Q3", "Q4"}
    ends = spark.createDataFrame([(None,), ("",), ("--0630",), ("0630",), ("1399",)], "s string").select(cal.year_end_month(F.col("s"))).collect()
    assert [r[0] for r in ends] == [12, 12, 12, 6, 12]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vector.normalised(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
