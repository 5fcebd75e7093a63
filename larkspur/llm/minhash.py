"""MinHash near-dedup: universal hash minima, banding, signature check, exact check, connected components.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (of the whole sequence, if it has
fewer words). Documents with equal sets are one class, represented by its smallest id, before anything is
compared. Each class gets ``BANDS * ROWS`` minima under universal hashes; a band of ROWS minima is a bucket
key. At similarity 0.75 a pair misses all 32 bands of 4 rows with probability 5e-6. Pairs are then checked
by size and by two signatures inside the join: one bit of every minimum makes 128 bits, of which more than
``MAX_BITS`` unequal ones (5 standard deviations away from what 0.75 gives) end a pair; and the parities of
the set's members over ``PARITY`` bins, of which no more can be unequal than members are. What is left is
confirmed on the full sets, which are made again from the texts of those documents alone, since all sets
together are larger than the texts.

Defined results: null text, or one without words, has an empty set, is linked with nothing and is its own
component. Rows that repeat a document id are one document: they are linked if any of them is. A null id
gets a null component and is kept. Ties need no rule, as the component is the smallest id. Texts of any length are taken whole.
An empty table gives an empty one. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WordHashes, free_name, id_text, map_arrow, materialise, mix, ngram_hashes, release, utf8
from larkspur.llm.components import connected_components, linked_components, shared_buckets

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
MAX_BITS = 36
PARITY = 2048

_rng = np.random.default_rng(20240101)
_MUL = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_LANES = np.arange(1, BANDS + 1, dtype=np.uint64)


def shingle_set(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text, A-Z lowered."""
    words = hashes.of(raw.lower().split())
    if not len(words):
        return words
    got = ngram_hashes(words, min(WORDS, len(words)))
    got.sort()
    return got[np.concatenate(([True], got[1:] != got[:-1]))]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of ``(a x + b) mod 2^64`` under each universal hash; long sets are taken in pieces."""
    low = np.full(len(_MUL), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(low, (_MUL[:, None] * part[None, :] + _ADD[:, None]).min(axis=1), out=low)
    return low


def _signatures(texts: DataFrame) -> DataFrame:
    """``doc_id, n, d1, d2, s1, s2, bands, parity`` of every row."""
    hashes = WordHashes()

    def rows(batch):
        n, digest, bits, bands, parity = [], [], [], [], []
        for raw in utf8(batch):
            s = shingle_set(raw, hashes)
            n.append(len(s))
            if not len(s):
                digest.append((0, 0))
                bits.append((0, 0))
                bands.append(None)
                parity.append(None)
                continue
            d = xxhash.xxh3_128_digest(s.tobytes())
            digest.append(np.frombuffer(d, np.int64))
            odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
            parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            low = mix(minima(s))
            bits.append(np.packbits((low & np.uint64(1)).astype(np.uint8)).view(np.int64))
            key = _LANES.copy()
            for k in range(ROWS):
                key = mix(key + low[k * BANDS : (k + 1) * BANDS])
            bands.append(key.view(np.int64))
        d, b = np.array(digest, np.int64).reshape(-1, 2), np.array(bits, np.int64).reshape(-1, 2)
        cols = [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x) for x in (d[:, 0], d[:, 1], b[:, 0], b[:, 1])), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, parity))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "d1", "d2", "s1", "s2", "bands", "parity"])

    return map_arrow(texts, rows, "doc_id long, n long, d1 long, d2 long, s1 long, s2 long, bands array<long>, parity array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    hashes = WordHashes()

    def rows(batch):
        sets = [shingle_set(raw, hashes).view(np.int64) for raw in utf8(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return map_arrow(texts, rows, "doc_id long, shingles array<long>")


def _likely(a: str, b: str):
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    size = 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)
    bits = apart(F.col(f"{a}s1"), F.col(f"{b}s1")) + apart(F.col(f"{a}s2"), F.col(f"{b}s2")) <= MAX_BITS
    odd = sum((apart(F.get(f"{a}parity", F.lit(k)), F.get(f"{b}parity", F.lit(k))) for k in range(1, PARITY // 64)), apart(F.get(f"{a}parity", F.lit(0)), F.get(f"{b}parity", F.lit(0))))
    # similarity p % means that unequal members are at most (100 - p) / (100 + p) of both sizes
    return size & bits & ((100 + PERCENT) * odd <= (100 - PERCENT) * (n_a + n_b))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    texts = id_text(docs, id_col, text_col)
    signed = materialise(_signatures(texts), "signatures")
    # classes of several documents alone, written first: then a hot class can be split, or the table broadcast
    classes = signed.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = materialise(classes.filter("copies > 1").select("d1", "d2", "first"), "copies")
    rep = F.when(F.col("n") > 0, F.coalesce("first", "doc_id"))
    one = F.col("doc_id") == F.col("rep")
    placed = signed.join(classes, ["d1", "d2"], "left").withColumn("rep", rep).select("doc_id", "n", "rep", *[F.when(one, F.col(c)).alias(c) for c in ("s1", "s2", "bands", "parity")])
    placed = materialise(placed, "classes")
    release(signed)

    reps = placed.filter(F.col("bands").isNotNull())
    buckets = shared_buckets(reps.select(F.explode("bands").alias("key"), F.col("rep").alias("node")))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")
        used = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        used = materialise(used, "used")
        if used.isEmpty():
            return pairs
        sets = materialise(_sets(texts.join(used, "doc_id", "left_semi")), "sets")
        side = lambda p: sets.select(F.col("doc_id").alias(p), F.col("shingles").alias(f"{p}_set"))
        both = F.size(F.array_intersect("a_set", "b_set"))
        whole = F.size("a_set") + F.size("b_set") - both
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * both >= PERCENT * whole).select("a", "b").distinct()

    comps = linked_components(buckets, reps.select(F.col("rep").alias("node"), "n", "s1", "s2", "parity"), _likely, verify)
    # rows of an id that stand in other classes tie these to it
    tied = placed.filter("rep IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("doc_id")
    ties = placed.join(materialise(tied, "tied"), "doc_id").filter("rep != doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    ties = materialise(ties, "ties")
    if not ties.isEmpty():
        stars = comps.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        comps = materialise(connected_components(stars.unionByName(ties)), "components")
    out = placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("node")).join(comps, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component, the rows of its smallest id."""
    name = free_name(docs, "gone")
    gone = materialise(near_duplicates(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
