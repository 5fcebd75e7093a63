"""Item headings and sections, as window plans over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import strip

# What a heading and a part line look like, and how contents tables are told.
ITEM_LINE = r"(?i)^item\s+(\d{1,2}[A-Z]?)\s*(?:[.:—–-]\s*|\s+)(.{3,})$"
PART_LINE = r"(?i)^part\s+([IV]{1,3})\b"
MIN_SECTION_CHARS, CONTENTS_ENTRIES, CONTENTS_GAP = 400, 5, 400


def candidate_headings(docs: DataFrame, id_col: str = "filing_id", text_col: str = "text") -> DataFrame:
    """``filing_id, item, title, part, line_index, offset, total``: every line that reads like a heading, with
    the last part named before it."""
    lines = docs.select(F.col(id_col).alias("filing_id"), F.length(text_col).alias("total"), F.posexplode(F.split(text_col, "\n")).alias("line_index", "line"))
    before = Window.partitionBy("filing_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    part = F.upper(F.nullif(F.regexp_extract("line", PART_LINE, 1), F.lit("")))
    lines = lines.withColumn("part", F.last(part, ignorenulls=True).over(before))
    lines = lines.withColumn("offset", F.sum(F.length("line") + 1).over(before) - F.length("line") - 1)
    found = lines.filter(F.col("line").rlike(ITEM_LINE)).withColumn("raw", F.regexp_extract("line", ITEM_LINE, 2))
    bare = F.btrim("raw", F.lit(" .…"))
    found = found.filter((bare != "") & ~bare.rlike(r"^\d+$") & bare.rlike("[A-Za-z]{3,}"))
    return found.select("filing_id", F.upper(F.regexp_extract("line", ITEM_LINE, 1)).alias("item"), strip(F.col("raw")).alias("title"), "part", "line_index", "offset", "total")


def without_contents(headings: DataFrame) -> DataFrame:
    """Runs of at least five headings close together and in ascending order are a table of contents and go,
    unless nothing would be left or there are fewer than five headings at all."""
    doc = Window.partitionBy("filing_id")
    order = doc.orderBy("line_index")
    key = F.struct(F.regexp_extract("item", r"(\d+)", 1).cast("int").alias("n"), F.regexp_extract("item", r"\d+([A-Z]*)", 1).alias("s"))
    h = headings.withColumn("key", key)
    joined = (F.col("offset") - F.lag("offset").over(order) <= CONTENTS_GAP) & (F.col("key") > F.lag("key").over(order))
    h = h.withColumn("start", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    h = h.withColumn("run", F.sum("start").over(order)).withColumn("len", F.count("*").over(Window.partitionBy("filing_id", "run")))
    h = h.withColumn("stays", F.col("len") < CONTENTS_ENTRIES).withColumn("any", F.max("stays").over(doc)).withColumn("all", F.count("*").over(doc))
    return h.filter((F.col("all") < CONTENTS_ENTRIES) | F.col("stays") | ~F.col("any")).select(headings.columns)


def without_repeats(headings: DataFrame) -> DataFrame:
    """Of several headings for one part and item the one with the longest text (the first of equal ones),
    if that is long enough; a single heading stays whatever its length."""
    order = Window.partitionBy("filing_id").orderBy("line_index")
    h = headings.withColumn("size", F.coalesce(F.lead("offset").over(order), F.col("total")) - F.col("offset"))
    same = Window.partitionBy("filing_id", "part", "item")
    h = h.withColumn("copies", F.count("*").over(same)).withColumn("best", F.row_number().over(same.orderBy(F.desc("size"), "offset")))
    return h.filter((F.col("copies") == 1) | ((F.col("best") == 1) & (F.col("size") >= MIN_SECTION_CHARS))).select(headings.columns)


def item_headings(docs: DataFrame, id_col: str = "filing_id", text_col: str = "text") -> DataFrame:
    return without_repeats(without_contents(candidate_headings(docs, id_col, text_col)))


def sections(docs: DataFrame, id_col: str = "filing_id", text_col: str = "text") -> DataFrame:
    """``filing_id, item, title, part, order, text``: from each heading to the next; a document without
    headings is one section with an empty item."""
    order = Window.partitionBy("filing_id").orderBy("line_index")
    h = item_headings(docs, id_col, text_col).withColumn("end", F.coalesce(F.lead("offset").over(order), F.col("total"))).withColumn("order", F.row_number().over(order) - 1)
    base = docs.select(F.col(id_col).alias("filing_id"), F.col(text_col).alias("body"))
    out = base.join(h, "filing_id", "left")
    body = strip(F.substring(F.col("body"), F.col("offset") + 1, F.col("end") - F.col("offset")))
    return out.select(
        "filing_id", F.coalesce("item", F.lit("")).alias("item"), F.coalesce("title", F.lit("")).alias("title"), "part",
        F.coalesce("order", F.lit(0)).alias("order"), F.when(F.col("item").isNull(), F.col("body")).otherwise(body).alias("text"),
    )
