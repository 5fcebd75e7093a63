"""BM25 over a chunk table.

Term statistics need one pass that explodes each chunk's distinct terms and counts them with partial
aggregation. Frequencies are only made for terms that are asked for: the tokens of a chunk meet the terms
of the questions by a join that is broadcast when those are few, so that postings are never shuffled whole.
Statistics always cover the corpus; filters restrict candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import tokens

# Fixed values.
K1, B, EPSILON = 1.5, 0.75, 0.25

PAIRS = 500_000  # of a question and a chunk, that a task adds up
BROADCAST = 1_000_000  # terms of questions that are sent to all tasks; the planner decides on more


def tokenised(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``chunk_id, terms, dl`` and the columns ``keep``."""
    return chunks.select(F.col(id_col).alias("chunk_id"), *keep, tokens(F.col(text_col)).alias("terms")).withColumn("dl", F.size("terms"))


def corpus_counts(tokenised_chunks: DataFrame) -> DataFrame:
    """``term, df, words``: the chunks that hold each term, and in one row with a null term all chunks and their
    words. One pass over the text; the table (as large as the vocabulary) is kept, since length, mean and idf read it in turn."""
    rows = tokenised_chunks.select("dl", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("terms"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("words")).persist()


def corpus_stats(counts: DataFrame) -> DataFrame:
    """``n, avgdl`` in one row, from ``corpus_counts``."""
    return counts.filter("term IS NULL").select(F.col("df").alias("n"), (F.col("words") / F.col("df")).alias("avgdl"))


def term_stats(tokenised_chunks: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``term, df, idf``: idf is ln(n - df + .5) - ln(df + .5), negative ones replaced by EPSILON times the mean
    of all (which may itself be negative)."""
    counts = corpus_counts(tokenised_chunks) if counts is None else counts
    n = F.broadcast(corpus_stats(counts).select("n"))  # one row
    raw = counts.filter("term IS NOT NULL").join(n).select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))
    return raw.join(mean).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def question_terms(questions: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """``question_id, term``: the distinct terms of each question."""
    return questions.select(F.col(id_col).alias("question_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def bm25_scores(tokenised_chunks: DataFrame, asked: DataFrame, where: Column | None = None, idf: DataFrame | None = None) -> DataFrame:
    """``question_id, chunk_id, score`` of the candidates with a score above zero. The text is read twice: for the
    counts, and for the terms asked for; with ``idf`` from an index once, besides the column of lengths. Only the terms asked for are
    shuffled, by chunk, into parts of at most ``PAIRS`` or so; the pairs, which are nearly all there can be, are added up where they are made."""
    if idf is None:
        counts = corpus_counts(tokenised_chunks)
        idf, stats = term_stats(tokenised_chunks, counts), corpus_stats(counts)
    else:
        stats = tokenised_chunks.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    candidates = tokenised_chunks if where is None else tokenised_chunks.filter(where)
    stats = stats.first() or {"n": 0, "avgdl": None}  # an empty table has none
    size = asked.agg(F.count("*").alias("rows"), F.countDistinct("question_id").alias("questions")).first()
    parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stats["n"] * size["questions"] // PAIRS))
    few = F.broadcast if size["rows"] <= BROADCAST else lambda df: df
    terms = asked.select("term").distinct()
    found = candidates.select("chunk_id", "dl", F.explode("terms").alias("term")).join(few(terms), "term")
    tf = found.repartition(parts, "chunk_id").groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avgdl"]).cast("double")))
    scored = tf.join(few(idf.join(terms, "term", "left_semi")), "term").select("chunk_id", "term", weight.alias("w"))
    return scored.join(few(asked), "term").groupBy("question_id", "chunk_id").agg(F.sum("w").alias("score")).filter("score > 0")


def ranked(scores: DataFrame, k: int, rank: str, digits: int = 6) -> DataFrame:
    """The k best of each question by rounded score, ties by chunk id, with the 1-based ``rank``."""
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", digits)), "chunk_id")
    return scores.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def bm25_search(tokenised_chunks: DataFrame, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """``question_id, chunk_id, score, sparse_rank``."""
    return ranked(bm25_scores(tokenised_chunks, question_terms(questions), where), k, "sparse_rank")
