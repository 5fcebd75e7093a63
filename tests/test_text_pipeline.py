import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.config import Settings
from larkspur.operators import chunking, headings

BODY = "The registrant describes its operations and its results in detail. " * 12


def heads(spark, text):
    df = spark.createDataFrame([("f", text)], "filing_id string, text string")
    return [(r.part, r.item, r.line_index) for r in headings.item_headings(df).orderBy("line_index").collect()]


@pytest.mark.parametrize("line", ["Item 1A. Risk Factors", "Item 1A.Risk Factors", "Item 1A Risk Factors", "ITEM 1A. RISK FACTORS"])
def test_heading_forms(spark, line):
    assert [h[1] for h in heads(spark, f"{line}\n{BODY}")] == ["1A"]


@pytest.mark.parametrize("line", ["Item 8", "Item 1A. 42", "Item 3. .....", "An Item 3. Thing here"])
def test_no_headings(spark, line):
    assert heads(spark, f"{line}\n{BODY}") == []


def test_contents_table_goes(spark):
    contents = "\n".join(f"Item {i}. Row of contents" for i in ("1", "1A", "2", "3", "5", "7", "8"))
    got = heads(spark, f"{contents}\nIntro\nItem 1A. Risk Factors\n{BODY}\nItem 7. Discussion\n{BODY}")
    assert [h[1] for h in got] == ["1A", "7"] and got[0][2] > 7
    assert len(heads(spark, contents)) == 7  # nothing would be left


def test_repeats_and_parts(spark):
    text = f"Item 8. Statements\nshort\nItem 8. Statements\nshort\nItem 8. Statements\n{BODY}"
    assert heads(spark, text) == [(None, "8", 4)]
    assert [h[1] for h in heads(spark, "Item 8. Statements\nshort")] == ["8"]
    both = heads(spark, f"PART I\nItem 1. Financial statements\n{BODY}\nPART II\nItem 1. Legal matters\n{BODY}")
    assert [h[:2] for h in both] == [("I", "1"), ("II", "1")]


def test_sections(spark):
    df = spark.createDataFrame([("a", f"before\nItem 1. Business\n{BODY}\nItem 2. Properties\nend"), ("b", "no headings")], "filing_id string, text string")
    got = {(r.filing_id, r.order): (r.item, r.text) for r in headings.sections(df).collect()}
    assert got["b", 0] == ("", "no headings") and got["a", 0][0] == "1" and got["a", 1] == ("2", "Item 2. Properties\nend") and got["a", 0][1].startswith("Item 1. Business")


def literal_pack(sentences, target, overlap, breaks, count):
    """The packing rules step by step, with running sums."""
    out, held = [], []
    n = lambda parts: sum(map(count, parts))
    j = lambda parts: count(" ".join(parts))

    def carry(parts):
        kept = []
        for s in reversed(parts if overlap > 0 else []):
            if kept and n([s, *kept]) > overlap and j([s, *kept]) > overlap:
                break
            kept.insert(0, s)
        return kept

    for k, s in enumerate(sentences):
        if held and n([*held, s]) > target and j([*held, s]) > target:
            out.append(" ".join(held))
            held = carry(held)
        held.append(s)
        if k in breaks and n(held) >= target // 2 and j(held) >= target // 2:
            out.append(" ".join(held))
            held = carry(held)
    return [*out, " ".join(held)] if held else out


def test_packing_against_the_rules():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = ["x" * int(n) for n in rng.integers(1, 90, rng.integers(0, 40))]
        target = int(rng.integers(10, 80))
        overlap = int(rng.integers(0, target))
        breaks = frozenset(np.flatnonzero(rng.random(len(s)) < 0.2).tolist())
        assert chunking.Packer(target, overlap).pack(s, breaks) == literal_pack(s, target, overlap, breaks, chunking.estimate)
    with pytest.raises(ValueError):
        chunking.Packer(10, 10)
    with pytest.raises(ValueError):
        Settings(chunk_target_tokens=10, chunk_overlap_tokens=10)


def test_topic_breaks(spark):
    v = np.array([[1, 0]] * 3 + [[0, 1]] * 3, float)
    assert chunking.topic_breaks(v, 95) == {2} and chunking.topic_breaks(v[:3], 95) == frozenset()
    assert isinstance(chunking.topic_breaks(np.zeros((5, 2)), 95), frozenset)
    with pytest.raises(ValueError):
        chunking.semantic_chunks(lambda t: np.zeros((len(t), 2)), 512, limit=256)


def test_chunk_rows(spark):
    f = spark.createDataFrame([("1", "AAPL", "Apple", "10-K", "acc", None, 2025, None, "u", "k")], "cik string, ticker string, company_name string, form_type string, accession_number string, filing_date date, fiscal_year int, fiscal_period string, source_url string, storage_key string")
    s = spark.createDataFrame([("1/acc", "7", "t", "Item 7. Title\n" + BODY * 4, 0, "II"), ("1/acc", "8", "t", "Item 8. T\ntiny", 1, "II")], "filing_id string, item string, title string, text string, order int, part string")
    got = chunking.chunk_sections(f, s, chunking.fixed_chunks(128, 16)).orderBy("order").collect()
    assert got[0].chunk_id == "acc-II-7-0" and {r.item for r in got} == {"7"} and all(len(r.text) >= 200 for r in got)
    w = spark.createDataFrame([(0, k, [1.0, 0.0] if k < 3 else [0.0, 1.0]) for k in range(6)], "g int, k int, vector array<double>")
    assert [r.k for r in chunking.adjacent_similarity(w, "g", "k").filter("is_break").collect()] == [2]
    assert chunking.adjacent_similarity(w.limit(3), "g", "k").count() == 0 and F is not None
