"""Dense search: exact, and over cells.

Queries are few and chunks many, so queries travel to the chunks in bounded blocks: each Arrow batch of
chunks is multiplied with the block's matrix, and a task keeps its k best for each query, so that what is shuffled
grows with tasks, not with pairs. Filters are applied below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.vector import dot

MAX_QUERY_BYTES = 64 << 20  # of query vectors that are sent to the tasks at once
MAX_SCORES = 4 << 20  # that a task holds at once


def exact_scores(chunks: DataFrame, queries: DataFrame, where: Column | None = None) -> DataFrame:
    """``question_id, chunk_id, score`` of all pairs, for small sets and checks."""
    c = chunks if where is None else chunks.filter(where)
    return c.crossJoin(F.broadcast(queries)).select("question_id", "chunk_id", dot(F.col("vector"), F.col("query")).alias("score"))


def dense_search(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None, digits: int = 6) -> DataFrame:
    """``question_id, chunk_id, score, dense_rank`` by inner product (cosine of unit vectors), no threshold.
    ``chunks(chunk_id, vector)``, ``queries(question_id, query)``; query blocks are bounded by
    ``MAX_QUERY_BYTES``."""
    return _search(chunks, queries, k, where, digits)


def _search(chunks, queries, k, where, digits, probed=None):
    """As ``dense_search``; with ``probed``, which gives a row of cells for each row of a matrix of queries, among those ``cell``s of ``chunks``."""
    candidates = (chunks if where is None else chunks.filter(where)).select("chunk_id", "vector", *(["cell"] if probed else []))
    held = queries.select("question_id", "query").toLocalIterator(prefetchPartitions=False)
    out = None
    for ids, matrix in _blocks(held):
        part = _best(candidates, ids, matrix, k, digits, chunks.schema["chunk_id"].dataType, queries.schema["question_id"].dataType, probed and probed(matrix))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.join(candidates).select("question_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(1).alias("dense_rank")).limit(0)
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", digits)), "chunk_id")
    return out.withColumn("dense_rank", F.row_number().over(w)).filter(F.col("dense_rank") <= k)


def _blocks(rows) -> Iterator[tuple[list, np.ndarray]]:
    ids, vectors, size = [], [], 0
    for r in rows:
        ids.append(r[0])
        vectors.append(np.asarray(r[1], np.float64))
        size += vectors[-1].nbytes
        if size >= MAX_QUERY_BYTES:
            yield ids, np.stack(vectors)
            ids, vectors, size = [], [], 0
    if ids:
        yield ids, np.stack(vectors)


def _best(candidates, ids, matrix, k, digits, chunk_type, question_type, cells=None):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DoubleType, StructField, StructType

    kind = to_arrow_type(question_type)
    schema = StructType([StructField("question_id", question_type), StructField("chunk_id", chunk_type), StructField("score", DoubleType())])

    def best(asked, found, scores):
        """The k best of each query among these, by rounded score and then by id."""
        names = found.to_numpy(zero_copy_only=False)
        names = names.astype(str) if names.dtype == object else names
        order = np.lexsort((names, -np.round(scores, digits), asked))
        first = np.searchsorted(asked[order], asked[order])  # where each row's query begins
        keep = order[np.arange(len(order)) - first < k]
        return asked[keep], found.take(pa.array(keep)), scores[keep]

    def scored(batch):
        vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        if cells is None:
            return vectors @ matrix.T
        scores, own = np.full((batch.num_rows, len(ids)), -np.inf), batch.column("cell").to_numpy(zero_copy_only=False)
        for cell in np.unique(own):
            rows, asked = np.flatnonzero(own == cell), np.flatnonzero((cells == cell).any(axis=1))
            scores[np.ix_(rows, asked)] = vectors[rows] @ matrix[asked].T
        return scores

    def run(batches):
        held, step = None, max(k, MAX_SCORES // len(ids))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            scores = scored(batch)
            rounded, last = np.round(scores, digits), batch.num_rows - min(k, batch.num_rows)
            rows, asked = np.nonzero((rounded >= np.partition(rounded, last, axis=0)[last]) & (rounded > -np.inf))
            new = (asked, batch.column("chunk_id").take(pa.array(rows)), scores[rows, asked])
            if held is not None:
                new = (np.concatenate((held[0], new[0])), pa.concat_arrays([held[1], new[1]]), np.concatenate((held[2], new[2])))
            held = best(*new)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ids[c] for c in held[0]], kind), held[1], pa.array(held[2])], ["question_id", "chunk_id", "score"])

    return candidates.mapInArrow(run, schema)


class CellIndex:
    """Approximate search: vectors are assigned to k-means cells, and a query looks into its nearest cells.

    ``cells`` is min(nlist, max(1, n // 39)) and ``probe`` min(16, cells), until ``tune`` raises it to what a recall
    takes. Below ``LEAST`` vectors there is one cell, which makes the search exact. k-means is fitted on at most ``SAMPLE`` vectors; every vector is
    assigned. Written with ``partitionBy('cell')`` the probe prunes partitions."""

    LEAST, SAMPLE, PER_CELL, PROBES = 1000, 200_000, 39, 16
    RECALL, ASKED = 0.95, 200  # aimed at by ``tune``, and over how many vectors

    def __init__(self, centres: np.ndarray, nlist: int):
        self.centres, self.nlist = centres, nlist
        self.probe = min(self.PROBES, len(centres))

    @classmethod
    def fit(cls, vectors: DataFrame, nlist: int = 256, seed: int = 7) -> "CellIndex":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = vectors.count()
        width = len(vectors.select("vector").first()[0]) if n else 1
        cells = min(nlist, max(1, n // cls.PER_CELL)) if n >= cls.LEAST else 1
        if cells == 1:
            return cls(np.zeros((1, width)), nlist)
        data = vectors.select(array_to_vector("vector").alias("features"))
        if n > cls.SAMPLE:
            data = data.sample(cls.SAMPLE / n, seed)
        model = KMeans(k=cells, distanceMeasure="cosine", seed=seed, maxIter=15).fit(data)
        return cls(np.stack(model.clusterCenters()), nlist)

    def settings(self) -> dict:
        """What an index manifest keeps beside the centres."""
        return {"nlist": self.nlist, "probe": self.probe}

    def table(self, spark) -> DataFrame:
        """``cell, centre``, at most ``nlist`` rows."""
        return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(self.centres)], "cell int, centre array<double>")

    @classmethod
    def from_table(cls, centres: DataFrame, settings: dict) -> "CellIndex":
        out = cls(np.array([r["centre"] for r in centres.orderBy("cell").collect()]), settings["nlist"])
        out.probe = settings["probe"]
        return out

    def retrain(self, vectors: DataFrame) -> "CellIndex | None":
        """A new index over all vectors; None if they are still searched flat."""
        new = self.fit(vectors, self.nlist)
        return new if len(new.centres) > 1 else None

    def _near(self, column: str, n: int, name: str, df: DataFrame) -> DataFrame:
        size = np.linalg.norm(self.centres, axis=1, keepdims=True)
        units = self.centres / np.where(size > 0, size, 1)

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column(column).values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                best = np.argsort(-(v @ units.T), axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(best.astype(np.int32)), pa.list_(pa.int32()))], [*batch.schema.names, name])

        from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(IntegerType()))]))

    def assign(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with their ``cell``."""
        return self._near("vector", 1, "_cells", vectors).withColumn("cell", F.get("_cells", F.lit(0))).drop("_cells")

    def tune(self, assigned: DataFrame, k: int) -> "CellIndex":
        """Raises ``probe`` until ``ASKED`` of the vectors, themselves left out, find ``RECALL`` of their k nearest by
        ``dense_search``. The aim is above the 0.9 that is promised, since other queries vary."""
        if self.probe == len(self.centres):
            return self
        asked = assigned.orderBy(F.xxhash64("chunk_id")).limit(self.ASKED).select(F.col("chunk_id").alias("question_id"), F.col("vector").alias("query"))
        asked = self._near("query", len(self.centres), "_cells", asked)
        best = dense_search(assigned, asked, k + 1).filter("question_id != chunk_id")
        found = best.join(asked.select("question_id", "_cells"), "question_id").join(assigned.select("chunk_id", "cell"), "chunk_id")
        needed = sorted(r[0] for r in found.select(F.array_position("_cells", F.col("cell"))).collect())
        if needed:
            self.probe = max(self.probe, int(needed[int(np.ceil(self.RECALL * len(needed))) - 1]))
        return self

    def search(self, assigned: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """``question_id, chunk_id, score, dense_rank`` among the probed cells."""
        size = np.linalg.norm(self.centres, axis=1, keepdims=True)
        units, n = self.centres / np.where(size > 0, size, 1), self.probe
        return _search(assigned, queries, k, where, 6, lambda matrix: np.argsort(-(matrix @ units.T), axis=1, kind="stable")[:, :n])
