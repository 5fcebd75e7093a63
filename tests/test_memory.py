"""What Python holds at once does not grow with the table."""

import contextlib
import io

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import bm25, chunking, dense
from larkspur.plans.answer import HashingEmbedder
from larkspur.sources.html import visible, visible_text


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_pages_reach_the_tolerant_reader_in_small_batches(spark):
    html = F.concat(F.lit("<p>one<script>no</script><td>&amp; "), F.col("id").cast("string"))
    pages = spark.range(300).select(F.when(F.col("id") != 7, html).alias("html"))
    out = pages.select("html", visible_text("html").alias("text"))
    assert "ArrowEvalPython" not in plan(out)  # it takes 10,000 pages of any size at once
    assert all(r.text == visible(r.html) for r in out.collect())


def test_sentences_of_many_documents_are_not_embedded_at_once(spark):
    most = chunking.EMBEDDED

    def embed(texts):
        assert len(texts) <= most
        return HashingEmbedder().documents(texts)

    words = F.transform(F.sequence(F.lit(1), F.when(F.col("id") == 5, 2500).otherwise(20)), lambda k: F.concat_ws(" ", F.lit("sentence"), (k % 7).cast("string"), F.lit("of"), (F.col("id") + k).cast("string")))
    docs = spark.range(0, 300, 1, 1).select("id", F.when(F.col("id") != 7, words).alias("sentences"))
    out = docs.select("id", "sentences", chunking.semantic_chunks(embed, 32, 4)("sentences").alias("chunks")).collect()
    packer = chunking.Packer(32, 4)
    for r in out:
        s = r.sentences or []
        assert r.chunks == packer.pack(s, chunking.topic_breaks(HashingEmbedder().documents(s), 95))


def test_pairs_of_questions_and_chunks_are_added_up_where_they_are_made(spark, monkeypatch):
    words = F.concat_ws(" ", *[F.concat(F.lit("word"), (F.col("id") % k).cast("string")) for k in (2, 3, 5, 7, 11)])
    chunks = bm25.tokenised(spark.range(200).select(F.col("id").alias("chunk_id"), words.alias("text")))
    asked = bm25.question_terms(spark.range(50).select(F.col("id").alias("question_id"), words.alias("question")))
    whole = {(r.question_id, r.chunk_id): round(r.score, 9) for r in bm25.bm25_scores(chunks, asked).collect()}
    monkeypatch.setattr(bm25, "PAIRS", 1000, raising=False)
    out = bm25.bm25_scores(chunks, asked)
    assert "hashpartitioning(question_id" not in plan(out)  # nearly every chunk has some score for every question
    assert "hashpartitioning(chunk_id" in plan(out) and ", 10)" in plan(out)  # 200 x 50 pairs
    assert whole and {(r.question_id, r.chunk_id): round(r.score, 9) for r in out.collect()} == whole
    assert bm25.bm25_scores(chunks.limit(0), asked).count() == bm25.bm25_scores(chunks, asked.limit(0)).count() == 0


def test_cell_search_makes_no_row_for_each_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in v], k % 7) for k, v in enumerate(rng.normal(size=(500, 8)))]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>, cell int")
    queries = chunks.filter("chunk_id < 60").select(F.col("chunk_id").alias("question_id"), F.col("vector").alias("query"))
    index = dense.CellIndex(rng.normal(size=(7, 8)), 7)
    index.probe = 3
    monkeypatch.setattr(dense, "MAX_SCORES", 1200, raising=False)
    out = index.search(chunks, queries, 4)
    assert "Join" not in plan(out)
    near = np.argsort(-(np.array([r[1] for r in rows[:60]]) @ (index.centres / np.linalg.norm(index.centres, axis=1, keepdims=True)).T), axis=1)[:, :3]
    want = {}
    for q in range(60):
        best = sorted((-round(float(np.dot(v, rows[q][1])), 6), k) for k, v, c in rows if c in near[q])[:4]
        want |= {(q, k): at for at, (_, k) in enumerate(best, 1)}
    assert {(r.question_id, r.chunk_id): r.dense_rank for r in out.collect()} == want
