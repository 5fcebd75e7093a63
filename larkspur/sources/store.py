"""Raw objects, manifests, index tables, question sets: reading and writing through Spark's file systems.

An index version is a folder; a new version is written beside the old one and named in a small pointer file
last, so that a table is never overwritten while it is read.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import schemas


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    """No error if there is nothing."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _check_key(key: str) -> str:
    if key.startswith("/") or ".." in key.split("/"):
        raise ValueError(f"{key!r} leaves the store")
    return key


def put_bytes(spark: SparkSession, root: str, key: str, data: bytes) -> None:
    """Write an object under a temporary name and rename it over the old one, which readers see until then."""
    fs, p = _fs(spark, f"{root}/{_check_key(key)}")
    tmp = p.suffix(f".{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(data))
    out.close()
    gateway, hadoop = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop
    kind = getattr(hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(tmp), fs.makeQualified(p), how)


def list_keys(spark: SparkSession, root: str, pattern: str = "*.html") -> DataFrame:
    """``key, length`` of the objects below root, in order; contents are not read."""
    return objects(spark, root, pattern).select("key", "length").orderBy("key")


def objects(spark: SparkSession, root: str, pattern: str = "*.html") -> DataFrame:
    """``key, length, content`` of all objects below root whose name fits; unfinished ones don't."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    key = F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(base.split("://")[-1]), F.lit("\\E"))), -1)
    return files.filter(~F.endswith("path", F.lit(".tmp"))).select(key.alias("key"), "length", "content")


def get_bytes(spark: SparkSession, root: str, key: str) -> bytes:
    path = f"{root}/{_check_key(key)}"
    if not exists(spark, path):
        raise KeyError(key)
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def missing_objects(filings: DataFrame, stored: DataFrame) -> DataFrame:
    """Filings whose object is not in the store, or that have none."""
    return filings.join(stored.select(F.col("key").alias("storage_key")), "storage_key", "left_anti")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's filings; none if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.FILING)
    return spark.read.schema(schemas.FILING).parquet(path)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file; blank lines and lines that start with // are skipped."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("//")))
    rows = lines.select(F.from_json("value", schemas.QUESTION).alias("q")).select("q.*")
    return rows.withColumn("answerable", F.coalesce("answerable", F.lit(True)))


def save_questions(questions: DataFrame, path: str) -> None:
    questions.write.option("ignoreNullFields", "true").json(path)


def ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """Tickers of a file: a JSON array, or words."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.when(F.startswith("v", F.lit("[")), F.from_json("v", "array<string>")).otherwise(F.split("v", r"\s+"))
    return raw.select(F.explode(listed).alias("ticker")).filter("ticker != ''")


class IndexStore:
    """Versioned tables of an index, with the manifest ``index.json``.

    The manifest names the folders of each table, so that a version and an appended batch become visible at once, when it
    is replaced. The version before the last stays until the next save, for those who still read it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> dict | None:
        if not exists(self.spark, f"{self.root}/index.json"):
            return None
        return json.loads(get_bytes(self.spark, self.root, "index.json"))

    def _write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        version, out = f"v{time.time_ns()}", {}
        for name, df in tables.items():
            out[name] = f"{version}/{name}"
            df.write.parquet(f"{self.root}/{out[name]}")
        return out

    def _count(self, folders: list[str]) -> int:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]).count()

    def _drop(self, folders) -> None:
        for version in {f.split("/")[0] for f in folders}:
            delete(self.spark, f"{self.root}/{version}")

    def save(self, dimension: int, model: str, index_type: str = "flat", settings: dict | None = None, **tables: DataFrame) -> dict:
        """Write a new version of all tables, then point to it, then drop the one before the last. ``settings`` (such as
        the numbers of cells and probes) go into the manifest."""
        old, written = self.manifest(), self._write(tables)
        size = self._count([written["chunks"]])
        if not size:
            self._drop(written.values())
            raise ValueError("an index without chunks is not saved")
        folders = {name: [f] for name, f in written.items()}
        meta = {"dimension": dimension, "model_name": model, "index_type": index_type, "settings": settings or {}, "size": size, "tables": folders}
        self._point(meta, old)
        return meta

    def _point(self, meta: dict, old: dict | None) -> None:
        mine = {f for fs in meta["tables"].values() for f in fs}
        last = {f for fs in old["tables"].values() for f in fs} if old else set()
        meta["before"] = sorted(last - mine)
        put_bytes(self.spark, self.root, "index.json", json.dumps(meta).encode())
        versions = {f.split("/")[0] for f in mine | last}
        self._drop(f for f in (old or {}).get("before", []) if f.split("/")[0] not in versions)

    def append(self, replaced: tuple[str, ...] = (), **tables: DataFrame) -> dict:
        """Add a batch of rows to the tables; those named in ``replaced`` are given whole. All tables of a batch
        become visible together. Vectors must be as many as the chunks and as wide as the index."""
        old = self.manifest()
        if old is None:
            raise FileNotFoundError(self.root)
        if unknown := set(tables) - set(old["tables"]):
            raise KeyError(sorted(unknown))
        written = self._write(tables)
        try:
            new = {t: self._count([f]) for t, f in written.items() if t not in replaced}
            if "vectors" in new:
                read = self.spark.read.parquet(f"{self.root}/{written['vectors']}")
                if new["vectors"] != new.get("chunks"):
                    raise ValueError(f"{new.get('chunks')} chunks but {new['vectors']} vectors")
                if wrong := read.filter(F.size("vector") != old["dimension"]).select(F.size("vector")).first():
                    raise ValueError(f"vectors of {wrong[0]} dimensions do not fit an index of {old['dimension']}")
        except ValueError:
            self._drop(written.values())
            raise
        if not new.get("chunks"):
            self._drop(written.values())
            return old
        meta = dict(old, size=old["size"] + new["chunks"])
        meta["tables"] = dict(old["tables"]) | {t: [f] if t in replaced else [*old["tables"][t], f] for t, f in written.items()}
        self._point(meta, old)
        return meta

    def load(self, dimension: int | None = None, model: str | None = None) -> dict[str, DataFrame]:
        meta = self.manifest()
        if meta is None:
            raise FileNotFoundError(self.root)
        for name, wanted in (("dimension", dimension), ("model_name", model)):
            if wanted is not None and meta[name] != wanted:
                raise ValueError(f"{name} is {meta[name]!r}, not {wanted!r}")
        return {t: self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) for t, folders in meta["tables"].items()}

    def indexed_filings(self) -> DataFrame:
        if self.manifest() is None:
            return self.spark.createDataFrame([], "filing_id string")
        return self.load()["chunks"].select("filing_id").distinct()


class Checkpoint:
    """Work of an index build that was cut off: chunks under the fingerprint of what decides them, and vectors, appended
    as batches are done. What does not fit the run that asks is not used."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _json(self, name: str) -> dict | None:
        try:
            found = json.loads(get_bytes(self.spark, self.root, name))
        except (KeyError, ValueError):
            return None
        return found if isinstance(found, dict) else None

    def save(self, chunks: DataFrame, fingerprint: dict, completed: list[str] | None = None) -> None:
        """Chunks of the filings ``completed``, of all if None. They are named in the manifest once they are written."""
        old, folder = self._json("chunks.json"), f"chunks-{time.time_ns()}"
        chunks.write.parquet(f"{self.root}/{folder}")
        put_bytes(self.spark, self.root, "chunks.json", json.dumps({"fingerprint": fingerprint, "completed": completed, "folder": folder}).encode())
        if old and "folder" in old:
            delete(self.spark, f"{self.root}/{old['folder']}")

    def load_partial(self, fingerprint: dict) -> tuple[DataFrame, list[str] | None] | None:
        """(chunks, filings that are done, None for all); None if there is nothing of this fingerprint."""
        saved = self._json("chunks.json")
        if not saved or saved.get("fingerprint") != fingerprint or "completed" not in saved or "folder" not in saved:
            return None
        return self.spark.read.parquet(f"{self.root}/{saved['folder']}"), saved["completed"]

    def load(self, fingerprint: dict) -> DataFrame | None:
        """Chunks, if all filings are done."""
        found = self.load_partial(fingerprint)
        return found[0] if found and found[1] is None else None

    def append_vectors(self, vectors: DataFrame, dimension: int) -> None:
        """Add ``chunk_id, vector`` rows; each batch is written once."""
        if self._json("vectors.json") is None:
            put_bytes(self.spark, self.root, "vectors.json", json.dumps({"dimension": dimension}).encode())
        vectors.select("chunk_id", "vector").write.mode("append").parquet(f"{self.root}/vectors")

    def load_vectors(self, chunks: DataFrame, dimension: int) -> DataFrame | None:
        """Vectors that are done; None if they are of another width or belong to other chunks."""
        meta = self._json("vectors.json")
        if not meta or meta.get("dimension") != dimension or not exists(self.spark, f"{self.root}/vectors"):
            return None
        found = self.spark.read.parquet(f"{self.root}/vectors")
        foreign = found.join(chunks.select("chunk_id"), "chunk_id", "left_anti").isEmpty() is False
        return None if foreign or found.isEmpty() else found

    def clear_vectors(self) -> None:
        """To be called when chunks are made anew."""
        for name in ("vectors.json", "vectors"):
            delete(self.spark, f"{self.root}/{name}")

    def clear(self) -> None:
        delete(self.spark, self.root)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)
