"""An index over chunks: building, adding to it, opening it for search, training its cells again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import bm25, dense, filters, fusion
from larkspur.plans.answer import Embedder, HashingEmbedder, embed_column, embed_pending
from larkspur.sources.store import Checkpoint, IndexStore


def _vectors(spark: SparkSession, chunks: DataFrame, embedder: Embedder, checkpoint: str | None) -> DataFrame:
    """Vectors of all chunks; with a checkpoint those that are missing there are made, and added to it."""
    if checkpoint is None:
        return chunks.select("chunk_id", embed_column(embedder)("text").alias("vector"))
    saved = Checkpoint(spark, checkpoint)
    done = saved.load_vectors(chunks, embedder.dimension)
    if done is None:
        saved.clear_vectors()
        done = spark.createDataFrame([], "chunk_id string, vector array<float>")
    missing = embed_pending(chunks, done, embedder)
    saved.append_vectors(missing, embedder.dimension)
    return saved.load_vectors(chunks, embedder.dimension)


def build(spark: SparkSession, chunks: DataFrame, root: str, embedder: Embedder | None = None, index_type: str = "flat", nlist: int = 256, checkpoint: str | None = None) -> dict:
    """Chunks, their vectors and their terms as a new version of the index; ``ivf`` deals the vectors to cells."""
    embedder = embedder or HashingEmbedder()
    vectors = _vectors(spark, chunks, embedder, checkpoint)
    terms = bm25.tokenised(chunks)
    tables, settings = {"chunks": chunks, "terms": terms, "term_stats": bm25.term_stats(terms)}, {}
    if index_type == "ivf":
        cells = dense.CellIndex.fit(vectors, nlist)
        vectors = cells.assign(vectors)
        cells.tune(vectors, 10)
        tables["centres"], settings = cells.table(spark), cells.settings()
    elif index_type != "flat":
        raise ValueError(f"unknown index type {index_type!r}")
    return IndexStore(spark, root).save(embedder.dimension, embedder.model_name, index_type, settings, vectors=vectors, **tables)


def add(spark: SparkSession, chunks: DataFrame, root: str, embedder: Embedder | None = None, vectors: DataFrame | None = None) -> dict:
    """Add chunks to the index. Only their own text is read; the statistics of terms are made again from the terms
    of all chunks, since new documents change the weights of old ones. Once there are vectors enough for cells, an
    ``ivf`` index that began as one cell is trained again."""
    embedder, store = embedder or HashingEmbedder(), IndexStore(spark, root)
    old = store.load(embedder.dimension, embedder.model_name)
    new = old["chunks"].select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    if not new.isEmpty():
        raise ValueError(f"chunk {new.first()[0]!r} is in the index already")
    vectors = chunks.select("chunk_id", embed_column(embedder)("text").alias("vector")) if vectors is None else vectors
    meta = store.manifest()
    if meta["index_type"] == "ivf":
        vectors = dense.CellIndex.from_table(old["centres"], meta["settings"]).assign(vectors)
    terms = bm25.tokenised(chunks)
    meta = store.append(("term_stats",), chunks=chunks, vectors=vectors, terms=terms, term_stats=bm25.term_stats(old["terms"].unionByName(terms)))
    if meta["index_type"] == "ivf" and old["centres"].count() == 1 and meta["size"] >= dense.CellIndex.LEAST:
        return reindex(spark, root) or meta
    return meta


def reindex(spark: SparkSession, root: str) -> dict | None:
    """Train the cells again over all vectors and make the terms again from all chunks; None if the index is flat."""
    store = IndexStore(spark, root)
    meta, t = store.manifest(), store.load()
    if meta["index_type"] != "ivf":
        return None
    vectors = t["vectors"].drop("cell")
    cells = dense.CellIndex.fit(vectors, meta["settings"]["nlist"])
    vectors, terms = cells.assign(vectors), bm25.tokenised(t["chunks"])
    cells.tune(vectors, 10)
    tables = {"chunks": t["chunks"], "vectors": vectors, "terms": terms, "term_stats": bm25.term_stats(terms), "centres": cells.table(spark)}
    return store.save(meta["dimension"], meta["model_name"], "ivf", cells.settings(), **tables)


@dataclass
class Retriever:
    """An open index: ``retriever(question, top_k, mode, wanted)``. Terms that are missing or of another number of chunks are made
    again from the chunks, as they would give wrong scores."""

    spark: SparkSession
    root: str
    embedder: Embedder
    candidate_k: int = 20
    rrf_k: int = 10

    def __post_init__(self):
        store = IndexStore(self.spark, self.root)
        self.tables, self.meta = store.load(self.embedder.dimension, self.embedder.model_name), store.manifest()
        terms = self.tables.get("terms")
        self.rebuilt = terms is None or "term_stats" not in self.tables or terms.count() != self.meta["size"]
        if self.rebuilt:
            terms = self.tables["terms"] = bm25.tokenised(self.tables["chunks"])
            self.tables["term_stats"] = bm25.term_stats(terms)
        self.cells = dense.CellIndex.from_table(self.tables["centres"], self.meta["settings"]) if self.meta["index_type"] == "ivf" else None

    def __call__(self, question: str, top_k: int = 5, mode: str = "hybrid", wanted: dict | None = None) -> DataFrame:
        """The best chunks with their text, where they come from (``origin``) and their ``rank``; filters are applied before
        the best are chosen."""
        filters.check_request(question, top_k, mode)
        t = self.tables
        asked = self.spark.createDataFrame([(0, question, self.embedder.query(question).tolist())], "question_id int, question string, query array<float>")
        allowed = t["chunks"].filter(filters.metadata_predicate(wanted)).select("chunk_id") if wanted else None
        within = lambda df: df if allowed is None else df.join(allowed, "chunk_id", "left_semi")
        flat = lambda n: dense.dense_search(within(t["vectors"]), asked, n)
        near = flat if self.cells is None else lambda n: self.cells.search(within(t["vectors"]), asked.select("question_id", "query"), n)
        scores = lambda: bm25.bm25_scores(t["terms"], bm25.question_terms(asked), idf=t["term_stats"])
        sparse = lambda n: bm25.ranked(within(scores()), n, "sparse_rank")
        found = fusion.retrieve(mode, near, sparse, top_k, self.candidate_k, self.rrf_k)
        out = fusion.with_chunks(found, t["chunks"]).withColumn("origin", fusion.rank_label())
        if {"cik", "fiscal_year", "part", "item"} <= set(out.columns):
            number = F.regexp_replace("cik", "^0+(?=.)", "")
            out = out.withColumn("citation", tx.citation(number, F.col("fiscal_year"), tx.section_label(F.col("part"), F.col("item"))))
        return out.orderBy("rank")
