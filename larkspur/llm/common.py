"""Shared plumbing of the training-data operators: scratch tables, Arrow batches, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space and the control characters tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and all is one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return str(jvm_dir.get())
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/larkspur-{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: cuts lineage, and gives Catalyst a measured size,
    so that a later join broadcasts it only when it really is below ``autoBroadcastJoinThreshold``."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_larkspur_path", None):
            drop_path(t.sparkSession, path)


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of jobs that are done go now; Spark deletes them when the driver's JVM happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; null text is the empty text."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def map_arrow(df: DataFrame, rows, schema: str) -> DataFrame:
    """``rows(RecordBatch) -> RecordBatch or None`` over every batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str = "text"):
    """The column's values as bytes, without decoding them."""
    col = batch.column(name)
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    return (v.as_py() or b"" for v in col)


class WordHashes(dict):
    """word bytes -> 64-bit hash; a cache that starts anew when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, in order; a shorter sequence has none."""
    if len(words) < n:
        return words[:0]
    out = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out + words[k : len(words) - n + 1 + k])
    return out
