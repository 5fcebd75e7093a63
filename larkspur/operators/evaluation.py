"""Retrieval metrics over labelled questions, as set-based plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.filters import relevance_predicate


MAX_RULES = 10_000  # rules that are broadcast at once


def resolve_relevance(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``question_id, chunk_id``: chunks that fit each question's rule (``questions(question_id, rule)``). Rules are
    the small side of a nested-loop join, at most ``MAX_RULES`` in one pass over the chunks; each text is lowered once."""
    fits = relevance_predicate(F.col("text"), F.col("ticker"), F.col("fiscal_year"), F.col("item"), F.col("rule"), lowered=True)
    low = chunks.select("chunk_id", "ticker", "fiscal_year", "item", F.lower("text").alias("text"))
    rules = questions.select("question_id", "rule")
    passes = -(-rules.count() // MAX_RULES)
    out = None
    for k in range(max(1, passes)):
        block = rules if passes <= 1 else rules.filter(F.pmod(F.xxhash64("question_id"), F.lit(passes)) == k)
        part = low.join(F.broadcast(block), fits).select("question_id", "chunk_id")
        out = part if out is None else out.unionByName(part)
    return out


def retrieval_metrics(questions: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """For each question: ``n_retrieved, n_relevant, recall, achievable_recall, precision, reciprocal_rank,
    hit``. Precision is over the rows returned within k, the reciprocal rank over the whole list. The relevant pairs
    are kept, as they are counted and joined."""
    relevant = relevant.select("question_id", "chunk_id").distinct().persist()
    n_rel = relevant.groupBy("question_id").agg(F.count("*").alias("n_relevant"))
    marked = retrieved.join(relevant.withColumn("rel", F.lit(True)), ["question_id", "chunk_id"], "left")
    got = marked.groupBy("question_id").agg(
        F.count("*").alias("n_retrieved"),
        F.count_if(F.col("rank") <= k).alias("within"),
        F.countDistinct(F.when(F.col("rel") & (F.col("rank") <= k), F.col("chunk_id"))).alias("hits"),
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"),
    )
    out = questions.select("question_id").join(got, "question_id", "left").join(n_rel, "question_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hits, n = F.coalesce("hits", F.lit(0)), F.coalesce("n_relevant", F.lit(0))
    return out.select(
        "question_id", F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"), n.alias("n_relevant"),
        zero(F.try_divide(hits, n)).alias("recall"), zero(F.try_divide(hits, F.least(F.lit(k), n))).alias("achievable_recall"),
        zero(F.try_divide(hits, F.col("within"))).alias("precision"), zero(F.try_divide(F.lit(1.0), F.col("first"))).alias("reciprocal_rank"),
        F.when(hits > 0, 1.0).otherwise(0.0).alias("hit"),
    )


RETRIEVAL = ("recall", "achievable_recall", "precision", "reciprocal_rank", "hit")


def summary(rows: DataFrame) -> DataFrame:
    """One row from ``rows(answerable, metrics, faithful, grounded, declined, quoted, n_expected, latency_ms)``:
    retrieval means over answerable questions, faithfulness over all, declines over unanswerable ones (null
    without judged answers), quotes where figures are expected, median latency; empty means are 0."""
    can = F.col("answerable")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean_if = lambda cond, c: F.avg(F.when(cond, c.cast("double")))
    return rows.agg(
        F.count("*").alias("questions"), F.count_if(can).alias("answerable"),
        *[zero(mean_if(can, F.col(m))).alias(m) for m in RETRIEVAL],
        zero(F.avg(F.col("faithful").cast("double"))).alias("faithfulness"), zero(F.avg(F.col("grounded").cast("double"))).alias("grounding"),
        mean_if(~can, F.col("declined")).alias("correct_declines"), mean_if(F.col("n_expected") > 0, F.col("quoted")).alias("quoted_expected"),
        zero(F.median("latency_ms")).alias("median_latency_ms"),
    )


def by_category(rows: DataFrame) -> DataFrame:
    return rows.filter("answerable").groupBy("category").agg(*[F.avg(m).alias(m) for m in ("hit", "achievable_recall", "reciprocal_rank")], F.avg(F.col("faithful").cast("double")).alias("faithful"))


def label_problems(questions: DataFrame, relevant: DataFrame) -> DataFrame:
    """``question_id, problem``: answerable questions whose rule finds nothing, unanswerable ones that match."""
    n = relevant.groupBy("question_id").agg(F.count("*").alias("n"))
    q = questions.join(n, "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.when(F.col("answerable") & F.col("has_rule") & (F.col("n") == 0), "no match").when(~F.col("answerable") & (F.col("n") > 0), "unexpected match")
    return q.select("question_id", kind.alias("problem"), "n").filter("problem IS NOT NULL")


def failures(rows: DataFrame) -> DataFrame:
    """Unfaithful answers and answerable questions without a hit, with the reason."""
    missed = F.col("answerable") & (F.col("hit") == 0)
    return rows.filter(~F.col("faithful") | missed).withColumn("reason", F.when(~F.col("faithful"), "unfaithful").otherwise("retrieval miss"))


def chunk_token_stats(chunks: DataFrame) -> DataFrame:
    """``n, least, middle, most, mean``; the middle is the upper median."""
    rank = chunks.groupBy("token_count").agg(F.count("*").alias("c"))  # a value table instead of all values
    run = rank.withColumn("cum", F.sum("c").over(Window.orderBy("token_count"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return run.agg(
        F.max("n").alias("n"), F.min("token_count").alias("least"), F.min(F.when(F.col("cum") > F.expr("n div 2"), F.col("token_count"))).alias("middle"),
        F.max("token_count").alias("most"), (F.sum(F.col("token_count") * F.col("c")) / F.max("n")).alias("mean"),
    )


def top_sections(chunks: DataFrame, n: int = 12, by: tuple[str, ...] = ("item",)) -> DataFrame:
    """The n sections with most chunks, ties by name."""
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), *by).limit(n)
