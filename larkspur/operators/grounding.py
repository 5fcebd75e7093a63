"""Checks of answers against the passages they rest on. Everything is a Catalyst expression over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a claimed and a printed figure look like, and what carries digits without claiming any.
CLAIM = r"(?<![A-Za-z\d])\d+(?:,\d{3})*(?:\.\d+)?(?![A-Za-z])"
FIGURE = r"\d+(?:,\d{3})*(?:\.\d+)?"
TAG = r"\[([^\]]+)\]"
OPEN_TAG = r"\[[^\]]*\z"
DATE = (
    r"(?i)\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}"
)
LEAST, FIRST_YEAR, LAST_YEAR, SCALES = 10, 1900, 2100, (1000, 0.001)
EXCERPT_CHARS = 300


def claims(answer: Column) -> Column:
    """Literals of figures that an answer claims: not in citation tags, dates, or names."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, TAG, " "), OPEN_TAG, " "), DATE, " ")
    return F.regexp_extract_all(bare, F.lit(CLAIM), F.lit(0))


def figures(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0))


def amount(literal: Column) -> Column:
    return F.replace(literal, F.lit(","), F.lit("")).try_cast("decimal(38,10)")


def ungrounded_figures(answer: Column, context: Column) -> Column:
    """Distinct claimed literals that the context has neither as they are nor a thousand times larger or
    smaller; values under 10 and bare years are not checked."""

    def missing(x: Column, held: Column) -> Column:
        v = amount(x)
        year = x.rlike(r"^\d{4}$") & v.between(FIRST_YEAR, LAST_YEAR)
        found = F.array_contains(held, v)
        for s in SCALES:
            found = found | F.array_contains(held, (v * F.lit(s).cast("decimal(10,3)")).try_cast("decimal(38,10)"))
        return v.isNotNull() & (v >= LEAST) & ~year & ~F.coalesce(found, F.lit(False))

    # the context's amounts are bound to a variable, so that they are made once and not for each claim
    held = F.array(F.array_distinct(F.transform(figures(context), amount)))
    return F.get(F.transform(held, lambda h: F.filter(F.array_distinct(claims(answer)), lambda x: missing(x, h))), F.lit(0))


def resolve_citations(answers: DataFrame, retrieved: DataFrame, ties: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """``answer_id, position, citation, chunk_id, excerpt``: tags of ``answers(answer_id, answer)`` that name a
    passage of ``retrieved(answer_id, rank, citation, chunk_id, text)``. Of passages with one tag the last
    counts, of those at one rank the first by ``ties``; a repeated tag counts once; unknown tags go."""
    tags = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(TAG), F.lit(1)), lambda t: F.trim(t)))
    asked = answers.select("answer_id", F.posexplode(tags).alias("position", "citation"))
    w = Window.partitionBy("answer_id", "citation").orderBy(F.desc("rank"), *ties)
    last = retrieved.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return asked.join(last, ["answer_id", "citation"]).select("answer_id", "position", "citation", "chunk_id", F.substring("text", 1, EXCERPT_CHARS).alias("excerpt"))


def declined(answer: Column) -> Column:
    low = F.lower(answer)
    return F.contains(low, F.lit("i don't know")) | F.contains(low, F.lit("i do not know"))


def verdict(reply: Column) -> Column:
    """True, False or null; the longer word is tried first, as it contains the other."""
    up = F.upper(reply)
    return F.when(F.contains(up, F.lit("UNSUPPORTED")), False).when(F.contains(up, F.lit("SUPPORTED")), True)


def faithful(is_declined: Column, ungrounded: Column, judged: Column) -> Column:
    """Declined answers are faithful, ungrounded ones are not, others unless the judge objects."""
    return F.when(is_declined, True).when(F.size(ungrounded) > 0, False).otherwise(F.coalesce(judged, F.lit(True)))


def quotes_expected(answer: Column, expected: Column) -> Column:
    bare = F.replace(answer, F.lit(","), F.lit(""))
    return F.coalesce(F.forall(expected, lambda f: F.contains(bare, F.replace(f, F.lit(","), F.lit("")))), F.lit(True))


# The words of the passage heads, of the empty context and of the prompt's frame.
def passages(retrieved: DataFrame) -> DataFrame:
    """``answer_id, context``: numbered passages of ``retrieved(answer_id, rank, citation, company_name,
    form_type, fiscal_year, item, text)`` in order of rank."""
    head = F.concat(
        F.lit("Passage "), F.col("rank").cast("string"), F.lit(" ["), F.col("citation"), F.lit("] "), F.col("company_name"), F.lit(" "), F.col("form_type"),
        F.lit(" FY"), F.col("fiscal_year").cast("string"), F.when(F.coalesce(F.col("item"), F.lit("")) != "", F.concat(F.lit(", Item "), F.col("item"))).otherwise(F.lit("")),
    )
    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat(head, F.lit("\n"), F.col("text")).alias("p"))))
    return retrieved.groupBy("answer_id").agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("(no passages were retrieved)")), F.lit("\n\nQuestion: "), question)
