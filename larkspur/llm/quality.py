"""Quality rules with adaptive thresholds.

Base measures are taken from every whole text. Four rates are then judged, not against fixed cutoffs, but
against fences drawn from quantile sketches of each language and source: a sketch is a table of counts per
value bin (exact below 128, then 64 bins to each doubling, so within 1.6 %), which merges by adding counts.
A (language, source) with fewer than ``MIN_GROUP`` documents takes the merged sketch of its language, and
one that is still too small the merged sketch of everything. Fences are joined back and filter the rows.

A rate is outside when it lies more than ``REACH`` times max(interquartile range, ``RESOLUTION``) above the
upper quartile (for the mean word length also: below the lower one). Integer arithmetic throughout, so the
result does not depend on the order or partitioning of rows.

Defined results: null text has no words and fails the base rules. A null language or source is a group of
its own. Only documents that pass the base rules enter the sketches. Rows are judged one by one: repeated
ids and rows stay as they are, and an empty table gives an empty result. Texts are measured whole, however long. A rate
equal to a fence is inside.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow, materialise, utf8

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_GROUP, REACH = 100, 3
SYMBOLS = b"#*$%&|<>"
#: rate -> (its value in whole units, least spread, also fenced below)
RATES = {
    "symbol_rate": ("1000 * n_symbols div word_chars", 10, False),
    "dup_line_rate": ("1000 * n_dup_lines div n_words", 10, False),
    "repeat_rate": ("1000 * n_repeat_words div n_words", 50, False),
    "word_length": ("100 * word_chars div n_words", 30, True),
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_NO_VALUE = "\x00"  # stands for null in group keys


def repeated_trigram_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    hit = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def text_measures(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one UTF-8 text."""
    words = raw.split()  # bytes split at exactly space and 09 to 0D
    solid = b"".join(words)
    chars = len(solid) - len(solid.translate(None, bytes(range(0x80))).translate(None, bytes(range(0xC0, 0x100))))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_trigram_words(words)


def with_measures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, as ``_k0, _k1, ...``, and its measures."""
    named = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    source = f"_k{keep.index(text_col)}" if text_col in keep else "_text"
    if source == "_text":
        named.append(F.col(f"`{text_col}`").cast("string").alias("_text"))
    slim = docs.select(*named)
    names = [f"_k{i}" for i in range(len(keep))]

    def rows(batch):
        got = np.array([text_measures(raw) for raw in utf8(batch, source)], np.int64).reshape(-1, 5)
        cols = [batch.column(n) for n in names] + [pa.array(got[:, k]) for k in range(5)]
        return pa.RecordBatch.from_arrays(cols, [*names, *_measure_names()])

    kept = "".join(f"{n} {slim.schema[n].dataType.simpleString()}, " for n in names)
    return map_arrow(slim, rows, kept + MEASURES)


def base_failed():
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def sketch(measured: DataFrame) -> DataFrame:
    """``_lang, _source, rate, bin, n`` of the documents that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(name).alias("rate"), F.expr(value).alias("v")) for name, (value, _, _) in RATES.items()])
    one = measured.filter(~base_failed()).select("_lang", "_source", F.explode(pairs).alias("r")).select("_lang", "_source", "r.rate", F.col("r.v").alias("v"))
    shift = F.expr("CAST(length(bin(v)) - 7 AS INT)")
    floor = F.when(F.col("v") < 128, F.col("v")).otherwise(F.call_function("shiftleft", F.call_function("shiftright", F.col("v"), shift), shift))
    return one.groupBy("_lang", "_source", "rate", floor.alias("bin")).agg(F.count("*").alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """One row for each group that stands in the sketches, at each of three levels: ``_level`` 0 is
    (language, source), 1 language, 2 everything, with the fences of each rate."""
    merged = sketches.select("rate", "bin", "_lang", "_source", "n")
    up = lambda *g: merged.groupBy("rate", "bin", *g).agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    levels = (
        merged.select("rate", "bin", "n", "_lang", "_source", F.lit(0).alias("_level"))
        .unionByName(up("_lang").select("rate", "bin", "n", "_lang", none.alias("_source"), F.lit(1).alias("_level")))
        .unionByName(up().select("rate", "bin", "n", none.alias("_lang"), none.alias("_source"), F.lit(2).alias("_level")))
    )
    group = Window.partitionBy("_level", "_lang", "_source", "rate")
    run = levels.withColumn("_total", F.sum("n").over(group)).withColumn("_cum", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    quartile = lambda k: F.min(F.when(F.expr(f"4 * _cum >= {k} * _total"), F.col("bin")))
    stat = run.groupBy("_level", "_lang", "_source", "rate").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("_total").alias("docs"))
    aggs = []
    for name, (_, least, both) in RATES.items():
        at = F.col("rate") == name
        spread = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        aggs.append(F.max(F.when(at, F.col("q3") + spread)).alias(f"hi_{name}"))
        if both:
            aggs.append(F.max(F.when(at, F.col("q1") - spread)).alias(f"lo_{name}"))
    return stat.groupBy("_level", "_lang", "_source").agg(F.max("docs").alias("docs"), *aggs)


def _rules() -> list:
    out = []
    for name, (_, _, both) in RATES.items():
        out.append((f"hi_{name}", name, "<="))
        if both:
            out.append((f"lo_{name}", name, ">="))
    return out


def thresholds(measured: DataFrame) -> DataFrame:
    """Every (language, source) of ``measured`` with the fences that hold for it; a small table, written out
    so that joins know its size."""
    levels = materialise(fences(sketch(measured)), "fences")
    names = [r[0] for r in _rules()]
    own = levels.filter("_level = 0")
    lang = levels.filter("_level = 1").select(F.col("_lang"), F.col("docs").alias("_d1"), *[F.col(n).alias(f"_1{n}") for n in names])
    whole = levels.filter("_level = 2").select(F.lit(1).alias("_one"), *[F.col(n).alias(f"_2{n}") for n in names])
    joined = own.join(lang, "_lang", "left").withColumn("_one", F.lit(1)).join(whole, "_one", "left")
    pick = lambda n: F.when(F.col("docs") >= MIN_GROUP, F.col(n)).when(F.col("_d1") >= MIN_GROUP, F.col(f"_1{n}")).otherwise(F.col(f"_2{n}")).alias(n)
    return materialise(joined.select("_lang", "_source", *[pick(n) for n in names]), "thresholds")


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    inside = F.lit(True)
    for limit, rate, sign in _rules():
        value = F.expr(RATES[rate][0])
        inside = inside & (value <= F.col(limit) if sign == "<=" else value >= F.col(limit))
    passed = F.when(base_failed(), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))
    return measured.join(limits, ["_lang", "_source"], "left").withColumn("base_failed", base_failed()).withColumn("kept", passed)


def _groups(df: DataFrame, lang: str, source: str) -> DataFrame:
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NO_VALUE))
    return df.withColumns({"_lang": fill(lang), "_source": fill(source)})


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id``, measures, ``base_failed`` and ``kept`` of every row. Texts are read once; what is written,
    joined and shuffled are rows of a few numbers."""
    measured = _groups(with_measures(docs, [id_col, lang_col, source_col], text_col), "_k1", "_k2")
    measured = materialise(measured.select(F.col("_k0").cast("long").alias("doc_id"), "_lang", "_source", *_measure_names()), "measures")
    return _judged(measured, thresholds(measured)).select("doc_id", *_measure_names(), "base_failed", "kept")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Texts are measured twice (once for the
    sketches, once while filtering) rather than written or shuffled with their measures."""
    lean = _groups(with_measures(docs, [lang_col, source_col], text_col), "_k0", "_k1")
    limits = thresholds(lean)
    keep = docs.columns
    full = with_measures(docs, keep, text_col)
    full = _groups(full, f"_k{keep.index(lang_col)}", f"_k{keep.index(source_col)}")
    return _judged(full, limits).filter("kept").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def _measure_names() -> list[str]:
    return [m.split()[0] for m in MEASURES.split(", ")]


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source FROM documents
), w AS (
  SELECT rid, doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), tri AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), hit AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, lang, source, len(words) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
), r AS (
  SELECT rid, lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS rate,
         unnest([1000 * n_symbols // word_chars, 1000 * n_dup_lines // n_words, 1000 * n_repeat_words // n_words, 100 * word_chars // n_words]) AS v,
         unnest([10, 10, 50, 30]) AS least
  FROM b WHERE NOT base_failed
), s AS (
  SELECT *, CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) END AS bin FROM r
), lv AS (
  SELECT 0 AS level, lang, source, rate, bin, least FROM s
  UNION ALL SELECT 1, lang, NULL, rate, bin, least FROM s
  UNION ALL SELECT 2, NULL, NULL, rate, bin, least FROM s
), k AS (
  SELECT level, lang, source, rate, bin, least,
         row_number() OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS cum,
         count(*) OVER (PARTITION BY level, lang, source, rate) AS total FROM lv
), q AS (
  SELECT level, lang, source, rate, max(total) AS docs, max(least) AS least,
         min(bin) FILTER (4 * cum >= total) AS q1, min(bin) FILTER (4 * cum >= 3 * total) AS q3
  FROM k GROUP BY ALL
), f AS (
  SELECT level, lang, source, rate, docs, q3 + {REACH} * greatest(q3 - q1, least) AS hi,
         CASE WHEN rate = 'word_length' THEN q1 - {REACH} * greatest(q3 - q1, least) ELSE -1 END AS lo FROM q
), outside AS (
  SELECT DISTINCT r.rid FROM r
  JOIN f f0 ON f0.level = 0 AND f0.lang = r.lang AND f0.source = r.source AND f0.rate = r.rate
  JOIN f f1 ON f1.level = 1 AND f1.lang = r.lang AND f1.rate = r.rate
  JOIN f f2 ON f2.level = 2 AND f2.rate = r.rate
  WHERE r.v > CASE WHEN f0.docs >= {MIN_GROUP} THEN f0.hi WHEN f1.docs >= {MIN_GROUP} THEN f1.hi ELSE f2.hi END
     OR r.v < CASE WHEN f0.docs >= {MIN_GROUP} THEN f0.lo WHEN f1.docs >= {MIN_GROUP} THEN f1.lo ELSE f2.lo END
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM outside) AS kept
FROM b
"""
