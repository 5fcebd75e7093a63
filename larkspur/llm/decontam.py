"""Benchmark decontamination, on DataFrame and SQL functions alone.

Words are runs of letters and digits, in lower case; shingles are runs of five (of all words, in an item
with fewer). A window is as many shingles as an item has (fewer where the text ends). A window's similarity
to an item is the weighted Jaccard of their shingles, weights being the numbers of times each occurs: sum
of minima over sum of maxima, ``SIMILAR`` percent or more.

1. Windows are looked at where they start with a shingle of an item of that size. This loses nothing: a
   window without a shared shingle has similarity 0, and moving its start on to its first shared shingle
   keeps all shared ones. Up to ``IN_PLAN`` item shingles stand in the plan as a hash set; more of them are
   joined to the exploded shingles instead.
2. Each such window gets a SimHash of its shingles and meets the items of its size through a multi-index:
   its bits are cut into ``BLOCKS`` blocks of 8, of which fingerprints within ``RADIUS`` differ by at most
   ``RADIUS // BLOCKS`` bits in one at least, and the item side lists every block value that near its own.
   Equal fingerprints look items up once.
3. Pairs within RADIUS are verified by the exact similarity. The window with the highest similarity (in
   millionths), the earliest of equal ones, stands for a document and item.

At similarity 0.75 fingerprints differ in 11 of 63 bits on average, so RADIUS is 4 deviations away.

Defined results: null texts and items have no words. An item without words matches nothing. Repeated
document ids are one document, whose best window counts; a null id is reported as null. Equal items are
each reported, as are items whose ids repeat, once. Of windows with equal similarity the first counts. Texts of any length
are searched whole. An empty table on either side gives an empty one. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import free_name, materialise
from larkspur.llm.linededup import settled, simhash

SHINGLE, SIMILAR = 5, 75
RADIUS, BLOCKS = 24, 8
IN_PLAN = 20_000
_MASKS = [m for m in range(256) if m.bit_count() <= RADIUS // BLOCKS]


def with_words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    flat = df.select(*keep, flat.alias("flat")).filter("flat != ''")
    return settled(flat, *keep, words=F.transform(F.split("flat", " "), lambda w: F.xxhash64(w)))


def shingles(width: int) -> Column:
    """Hashes of all runs of ``width`` of the column ``words``, in order."""
    n = F.size("words") - (width - 1)
    run = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(width)]))
    return F.when(n > 0, run).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    words = with_words(slim, "text", "item_id").withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    of = F.lit(None).cast("array<bigint>")
    for w in range(1, SHINGLE + 1):
        of = F.when(F.col("width") == w, shingles(w)).otherwise(of)
    out = settled(words, "item_id", "width", item=of).withColumn("n", F.size("item"))
    return materialise(out.select("item_id", "width", "n", "item", simhash(F.col("item")).alias("fp")), "items")


def _windows(words: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """``doc_id, pos, n, win`` of all windows that start with a shingle of an item of their size."""
    starts = items.filter(F.col("width") == width).select("n", F.explode("item").alias("h")).distinct()
    starts = materialise(starts, "starts")
    longest = starts.agg(F.max("n")).first()[0]
    held = starts.select("h").distinct().limit(IN_PLAN + 1).collect()
    run = settled(words, "doc_id", sh=shingles(width))
    cut = lambda i: F.struct(i.alias("pos"), F.get("sh", i).alias("h"), F.slice("sh", i + 1, F.lit(longest)).alias("win"))
    if len(held) <= IN_PLAN:
        known = ", ".join(f"{r[0]}L" for r in held) or "NULL"
        found = F.expr(f"filter(sequence(0, size(sh) - 1), i -> get(sh, i) IN ({known}))")
        hits = run.filter(F.size("sh") > 0).select("doc_id", "sh", found.alias("at")).filter(F.size("at") > 0)
        hits = hits.select("doc_id", F.inline(F.transform("at", cut))).join(starts, "h")
    else:
        tagged = run.filter(F.size("sh") > 0).withColumn("own", F.xxhash64("sh"))  # equal rows have equal hits
        spots = tagged.select("own", F.posexplode("sh").alias("i", "h")).join(starts.select("h").distinct(), "h")
        spots = spots.groupBy("own").agg(F.array_sort(F.collect_set("i")).alias("at"))
        hits = tagged.join(spots, "own").select("doc_id", F.inline(F.transform("at", cut))).join(starts, "h")
    return hits.select("doc_id", "pos", F.lit(width).alias("width"), "n", F.slice("win", F.lit(1), F.col("n")).alias("win"))


def _shared(a: str, b: str) -> Column:
    """Size of the intersection of two multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    each = F.transform(F.array_distinct(a), lambda x: F.least(count(a, x), count(b, x)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(each, F.lit(0), lambda s, x: s + x))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``doc_id, item_id, first_word, similarity`` of every document and item that it contains."""
    items = _items(benchmark, item_id_col, item_text_col)
    widths = [r[0] for r in items.select("width").distinct().collect()]  # at most five
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    words = with_words(slim, "text", "doc_id")
    found = [_windows(words, items, w) for w in widths]
    windows = found[0] if found else words.select("doc_id", F.lit(0).alias("pos"), F.lit(0).alias("width"), F.lit(0).alias("n"), F.col("words").alias("win")).limit(0)
    for more in found[1:]:
        windows = windows.unionByName(more)
    windows = materialise(windows.select("doc_id", "pos", "width", "n", "win", simhash(F.col("win")).alias("fp")), "windows")

    block = lambda b: F.shiftrightunsigned("fp", 8 * b).bitwiseAND(F.lit(255).cast("long"))
    values = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), block(b).alias("value")) for b in range(BLOCKS)]))
    near = F.explode(F.array(*[F.lit(m).cast("long") for m in _MASKS]))
    index = items.select("item_id", "width", "n", F.col("fp").alias("item_fp"), values.alias("x"))
    index = index.select("item_id", "width", "n", "item_fp", "x.block", F.col("x.value").alias("v"), near.alias("m"))
    index = index.withColumn("value", F.col("v").bitwiseXOR(F.col("m"))).drop("v", "m")
    prints = windows.select("width", "n", "fp").distinct().select("width", "n", "fp", values.alias("x")).select("width", "n", "fp", "x.*")
    on = [prints[c] == index[c] for c in ("width", "n", "block", "value")] + [F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS]
    pairs = prints.join(index, on).select(prints["width"], prints["n"], "fp", "item_id").distinct()

    met = windows.join(materialise(pairs, "pairs"), ["width", "n", "fp"]).join(items.select("item_id", "width", "n", "item"), ["item_id", "width", "n"])
    met = met.filter(F.array_contains("item", F.get("win", F.lit(0)))).withColumn("both", _shared("win", "item"))
    met = met.withColumn("whole", F.size("win") + F.size("item") - F.col("both")).filter(100 * F.col("both") >= SIMILAR * F.col("whole"))
    best = F.max(F.struct(F.expr("1000000L * both div whole").alias("s"), (-F.col("pos")).alias("p")))
    out = met.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "item_id", (-F.col("b.p")).cast("long").alias("first_word"), (F.col("b.s") / 1e6).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    name = free_name(docs, "hit")
    hit = materialise(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(name)).distinct(), "hit")
    return docs.join(hit, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(name)), "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_words(table: str, key: str) -> str:
    return rf"SELECT {key}, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM {table}"


OP4_SQL = rf"""
WITH dw AS ({_sql_words("documents", "doc_id")}), iw AS ({_sql_words("benchmark", "item_id")}),
it AS (
  SELECT item_id, k, list_aggregate(w[k : k + {SHINGLE - 1}], 'string_agg', ' ') AS g, len(w) - {SHINGLE - 1} AS n
  FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS k FROM iw)
), sh AS (
  SELECT doc_id, pos, list_aggregate(w[pos + 1 : pos + {SHINGLE}], 'string_agg', ' ') AS g, len(w) - {SHINGLE - 1} AS total
  FROM (SELECT *, unnest(range(0, len(w) - {SHINGLE - 1})) AS pos FROM dw)
), cand AS (
  SELECT DISTINCT sh.doc_id, it.item_id, sh.pos, it.n, least(it.n, sh.total - sh.pos) AS size FROM sh JOIN it USING (g)
), wc AS (
  SELECT c.doc_id, c.item_id, c.pos, any_value(c.n) AS n, any_value(c.size) AS size, sh.g, count(*) AS a
  FROM cand c JOIN sh ON sh.doc_id = c.doc_id AND sh.pos >= c.pos AND sh.pos < c.pos + c.n GROUP BY c.doc_id, c.item_id, c.pos, sh.g
), ic AS (SELECT item_id, g, count(*) AS b FROM it GROUP BY ALL),
m AS (
  SELECT doc_id, item_id, pos, any_value(n) + any_value(size) AS total, sum(least(a, b)) AS common
  FROM wc JOIN ic USING (item_id, g) GROUP BY doc_id, item_id, pos
), ok AS (
  SELECT doc_id, item_id, pos, CAST(1000000 * common AS BIGINT) // CAST(total - common AS BIGINT) AS s FROM m WHERE 100 * common >= {SIMILAR} * (total - common)
)
SELECT doc_id, item_id, CAST(arg_max(pos, s * 1000000000 - pos) AS BIGINT) AS first_word, max(s) / 1e6 AS similarity
FROM ok GROUP BY doc_id, item_id
"""
