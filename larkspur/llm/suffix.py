"""Substring dedup by a logarithmic family of suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed, exactly.

* Suffixes are sampled where content says so: of any ``LENGTH`` bytes, the ``PREFIX``-byte string with the
  least hash is an anchor (about one in 110 bytes), so equal windows have equal anchors at equal offsets.
  A window belongs to one anchor, and an anchor's neighbourhood is the text of all its windows.
* A suffix array is a table of anchors ordered by the fingerprint of their prefix, then by that of their
  neighbourhood; equal entries are stored once with their number. Order by fingerprint instead of by bytes
  serves as well here, as only equality is asked for.
* ``SuffixLevels`` keeps arrays of geometric sizes. A new batch gets its array, is merged on the prefix
  with every level, which yields the entries that recur, and then equal-sized levels are merged.
* Entries whose whole neighbourhood recurs are removed as they are. Where only the prefix is shared (the
  edges of a repeat), the texts of those neighbourhoods are cut into blocks of ``BLOCK`` windows aligned to
  the anchor. Blocks that recur whole are removed; where unequal blocks have in common what all windows of
  a block have, the windows of one of each are counted. All hashes that decide have 128 bits. Everything is counted by
  groupBy with combining, so a passage that a third of all documents share never meets in one task.

Texts are known by 128 bits of their SHA-256, so that null and repeated document ids do no harm.

Defined results: null text is empty; a text of under LENGTH bytes is never touched, a repeated row of at
least that length is removed whole, in all its copies. Touching runs are one run. Texts of any length are taken whole, in pieces. An
empty table gives an empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import id_text, map_arrow, materialise, mix, release, utf8

LENGTH, PREFIX, BLOCK = 400, 100, 16
PIECE = 1 << 19  # bytes that are worked on at once
BATCHES = 4

_U = np.uint64
_LOW30 = _U(2**30 - 1)


class Rolling:
    """Polynomial hashes mod 2^64 of any slices of one array, by prefix sums; bytes go through a random table."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**63, 256, dtype=_U) * _U(2) + _U(1)
        self.base = _U(int(rng.integers(0, 2**62)) * 4 + 3)
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        up, down = np.full(n, self.base), np.full(n, _U(pow(int(self.base), -1, 2**64)))
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.grow(2 * len(data))
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(_U))


_rolling: list[Rolling] = []


def rolling() -> tuple[Rolling, Rolling]:
    if not _rolling:
        _rolling.extend((Rolling(11), Rolling(23)))
    return _rolling[0], _rolling[1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window, from running minima within blocks of ``width``."""
    full = np.full(-(-len(values) // width) * width, _U(2**64 - 1))
    full[: len(values)] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


def anchors(text: bytes):
    """(h, c1, c2, a, lo, hi) of each anchor: prefix hash, neighbourhood hashes, its place, and the first and
    last window start that belong to it. A long text is cut into pieces; a neighbourhood that a cut shortens
    still has the same prefix, so it is settled by blocks."""
    one, two = rolling()
    out = []
    for at in range(0, len(text) - LENGTH + 1, PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + LENGTH - 1, len(text) - at), at)
        s1, s2 = one.sums(data), two.sums(data)
        i = np.arange(len(data) - PREFIX + 1)
        h = one.of(s1, i, i + PREFIX)
        least = sliding_min((h & ~_LOW30) | i.astype(_U), LENGTH - PREFIX + 1) & _LOW30
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        lo = np.concatenate(([0], cut))
        hi = np.concatenate((cut, [len(least)])) - 1
        a = least[lo].astype(np.int64)
        salt = mix((a - lo).astype(_U) + _U(1))
        c1, c2 = (mix(r.of(s, lo, hi + LENGTH) ^ salt) for r, s in ((one, s1), (two, s2)))
        out.append((h[a], c1, c2, a + at, lo + at, hi + at))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None


def sampled_suffixes(texts: DataFrame) -> DataFrame:
    """``key, h, c1, c2, a, lo, hi`` of the anchors of ``texts(key, text)``."""

    def rows(batch):
        keys, parts = [], []
        for k, raw in enumerate(utf8(batch)):
            if len(raw) >= LENGTH:
                parts.append(anchors(raw))
                keys.append(np.full(len(parts[-1][0]), k))
        if not parts:
            return None
        got = [np.concatenate(x) for x in zip(*parts, strict=True)]
        key = batch.column("key").take(pa.array(np.concatenate(keys)))
        cols = [key, *(pa.array(x.view(np.int64)) for x in got[:3]), *(pa.array(x) for x in got[3:])]
        return pa.RecordBatch.from_arrays(cols, ["key", "h", "c1", "c2", "a", "lo", "hi"])

    return map_arrow(texts, rows, "key binary, h long, c1 long, c2 long, a long, lo long, hi long")


class SuffixLevels:
    """The logarithmic index family: ``levels`` holds (rank, table), of falling rank."""

    ENTRY = ("h", "c1", "c2")

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    @classmethod
    def array(cls, suffixes: DataFrame) -> DataFrame:
        """The suffix array of one batch: its distinct entries in order, with their number."""
        return cls._written(suffixes.groupBy(*cls.ENTRY).agg(F.count("*").alias("n")))

    @classmethod
    def _written(cls, entries: DataFrame) -> DataFrame:
        return materialise(entries.sortWithinPartitions(*cls.ENTRY), "level")

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Add a batch; gives ``h, c1, c2, n`` of all entries, new and old, whose prefix the batch repeats."""
        fresh, rank = self.array(suffixes), 0
        heads = fresh.select("h").distinct()
        met = [fresh] + [level.join(heads.hint("merge"), "h", "left_semi") for _, level in self.levels]
        total = met[0]
        for more in met[1:]:
            total = total.unionByName(more)
        total = total.groupBy(*self.ENTRY).agg(F.sum("n").alias("n"))
        total = materialise(total, "met")
        twice = total.groupBy("h").agg(F.sum("n").alias("all")).filter("all > 1").select("h")
        twice = materialise(twice, "heads")  # written first, so that a hot prefix can be split in the join
        matches = materialise(total.join(twice, "h", "left_semi"), "matches")
        release(total, twice)
        while self.levels and self.levels[-1][0] == rank:
            _, level = self.levels.pop()
            merged = self._written(level.unionByName(fresh).groupBy(*self.ENTRY).agg(F.sum("n").alias("n")))
            release(level, fresh)
            fresh, rank = merged, rank + 1
        self.levels.append((rank, fresh))
        return matches

    def close(self) -> None:
        release(*(t for _, t in self.levels))


def _edge_texts(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """``key, a, lo, hi, near``: the neighbourhood's bytes of every row of ``edges(key, a, lo, hi)``."""
    spots = edges.groupBy("key").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("spots"))
    once = texts.join(materialise(spots, "spots"), "key")  # a table, so that AQE may split a text that has many copies

    def rows(batch):
        key, a, lo, hi, near = [], [], [], [], []
        spots, last = batch.column("spots"), None
        for k, raw in enumerate(utf8(batch)):
            if (name := batch.column("key")[k].as_py()) == last:  # copies follow each other
                continue
            last = name
            for s in spots[k].as_py():
                key.append(k)
                a.append(s["a"])
                lo.append(s["lo"])
                hi.append(s["hi"])
                near.append(raw[s["lo"] : s["hi"] + LENGTH])
        cols = [batch.column("key").take(pa.array(key, pa.int64())), *(pa.array(x, pa.int64()) for x in (a, lo, hi)), pa.array(near, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["key", "a", "lo", "hi", "near"])

    return map_arrow(once, rows, "key binary, a long, lo long, hi long, near binary")


def _near(batch):
    """Parts of a batch of about PIECE bytes: (rows, columns as arrays, offset of each neighbourhood in the
    joint bytes, prefix sums of both hashes)."""
    data = list(utf8(batch, "near"))
    size = np.array([len(x) for x in data], np.int64)
    part = np.cumsum(size) // PIECE
    for first, last in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(data)]))), strict=True):
        cols = {n: batch.column(n).to_numpy()[first:last] for n in batch.schema.names if n not in ("key", "near")}
        joint = np.frombuffer(b"".join(data[first:last]), np.uint8)
        yield np.arange(first, last), cols, np.cumsum(size[first:last]) - size[first:last], [(r, r.sums(joint)) for r in rolling()]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for each value from first to last of each row."""
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def _blocks(near: DataFrame) -> DataFrame:
    """``key, id, i1, i2, core, b1, b2`` of the blocks of windows of each neighbourhood: ``core`` is the hash of
    what all windows of the full block have in common, (b1, b2) that of the block's own bytes."""

    def rows(batches):
        for batch in batches:
            for own, c, off, sums in _near(batch):
                row, q = _spread((c["lo"] - c["a"]) // BLOCK, (c["hi"] - c["a"]) // BLOCK)
                start = c["a"][row] + q * BLOCK
                i1, i2 = np.maximum(start, c["lo"][row]), np.minimum(start + BLOCK - 1, c["hi"][row])
                shift = off[row] - c["lo"][row]
                salt = mix((q + 2**40).astype(_U))
                core = mix(sums[0][0].of(sums[0][1], start + BLOCK - 1 + shift, start + LENGTH + shift) ^ salt)
                whole = [mix(r.of(s, i1 + shift, i2 + LENGTH + shift) ^ mix(salt + (i1 - start).astype(_U))) for r, s in sums]
                cols = [c["id"][row], i1, i2, *(x.view(np.int64) for x in (core, *whole))]
                key = batch.column("key").take(pa.array(own[row]))
                yield pa.RecordBatch.from_arrays([key, *(pa.array(x) for x in cols)], ["key", "id", "i1", "i2", "core", "b1", "b2"])

    return near.mapInArrow(rows, "key binary, id long, i1 long, i2 long, core long, b1 long, b2 long")


def _windows(near: DataFrame) -> DataFrame:
    """``key, i, w1, w2``: hashes of the windows i1 to i2 of each row."""

    def rows(batches):
        for batch in batches:
            for own, c, off, sums in _near(batch):
                row, i = _spread(c["i1"], c["i2"])
                at = i + off[row] - c["lo"][row]
                hashed = [pa.array(r.of(s, at, at + LENGTH).view(np.int64)) for r, s in sums]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(own[row])), pa.array(i), *hashed], ["key", "i", "w1", "w2"])

    return near.select("key", "lo", "i1", "i2", "near").mapInArrow(rows, "key binary, i long, w1 long, w2 long")


def repeated_spans(texts: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``key, s, e``: overlapping spans that together cover every repeated window of ``texts(key, text)``."""
    suffixes = materialise(sampled_suffixes(texts), "suffixes")
    index, found = SuffixLevels(), []
    for k in range(batches):
        found.append(index.add(suffixes.filter(F.pmod(F.xxhash64("key"), F.lit(batches)) == k).select(*index.ENTRY)))
    index.close()
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    entries = materialise(known.groupBy(*index.ENTRY).agg(F.max("n").alias("n")), "entries")
    torn = materialise(entries.filter("n = 1").select("h").distinct().withColumn("torn", F.lit(True)), "torn")
    status = entries.join(torn, "h", "left").select(*index.ENTRY, (F.col("n") > 1).alias("full"), F.coalesce("torn", F.lit(False)).alias("torn"))
    status = materialise(status, "status")
    hits = materialise(suffixes.join(status, [*index.ENTRY]).select("key", "h", "c1", "c2", "a", "lo", "hi", "full", "torn"), "hits")
    release(suffixes, entries, torn, status, *found)

    spans = hits.filter("full").select("key", F.col("lo").alias("s"), (F.col("hi") + LENGTH).alias("e"))
    edges = hits.filter("NOT full").select("key", "a", "lo", "hi", F.lit(True).alias("ask"))
    stand = hits.filter("full AND torn").groupBy(*index.ENTRY).agg(F.min(F.struct("key", "a", "lo", "hi")).alias("x")).select("x.*", F.lit(False).alias("ask"))
    near = _edge_texts(texts, edges.unionByName(stand).select("key", "a", "lo", "hi").distinct())
    near = materialise(near.withColumn("id", F.monotonically_increasing_id()), "near")
    blocks = materialise(_blocks(near), "blocks")
    kinds = blocks.groupBy("core", "b1", "b2").agg(F.count("*").alias("n"), F.min(F.struct("id", "i1", "i2")).alias("one"))
    kinds = materialise(kinds, "kinds")
    unequal = kinds.groupBy("core").count().filter("count > 1").select("core")
    ask = kinds.join(unequal, "core", "left_semi").select("one.*")
    windows = materialise(_windows(near.join(ask, "id")), "windows")
    again = windows.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2")
    single = windows.join(again, ["w1", "w2"], "left_semi").select("key", F.col("i").alias("s"), (F.col("i") + LENGTH).alias("e"))
    whole = blocks.join(kinds.filter("n > 1").select("core", "b1", "b2"), ["core", "b1", "b2"], "left_semi")
    return spans.unionByName(whole.select("key", F.col("i1").alias("s"), (F.col("i2") + LENGTH).alias("e"))).unionByName(single)


def _merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or touching spans, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > end[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(spans)])) - 1
    return np.stack((spans[first, 0], end[last]), axis=1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, texts_out: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, and with ``texts_out`` the remaining
    bytes as ``kept`` (null where nothing is removed, as the text is then as it was)."""
    named = id_text(docs, id_col, text_col).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    named = named.withColumn("key", F.unhex(F.substring("sha", 1, 32)))
    texts = named.filter(F.octet_length("text") >= LENGTH).select("key", "text")
    spans = repeated_spans(texts, batches).distinct()
    per_text = spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def rows(batch):
        which, removed, runs, sha, left = [], [], [], [], []
        spans, last = batch.column("spans"), None
        for k, raw in enumerate(utf8(batch)):
            if (name := batch.column("key")[k].as_py()) == last:  # copies follow each other
                continue
            last = name
            which.append(name)
            pairs = spans[k].values.flatten()
            cut = _merge(np.stack([p.to_numpy() for p in pairs], axis=1))
            at, kept = 0, []
            for s, e in cut.tolist():
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            kept = b"".join(kept)
            removed.append(len(raw) - len(kept))
            runs.append(len(cut))
            sha.append(hashlib.sha256(kept).hexdigest())
            left.append(kept if texts_out else None)
        cols = [pa.array(which, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha), pa.array(left, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["key", "n_removed", "n_spans", "cut_sha", "kept"])

    cut = map_arrow(texts.join(materialise(per_text, "per_text"), "key"), rows, "key binary, n_removed long, n_spans long, cut_sha string, kept binary")
    cut = materialise(cut.dropDuplicates(["key"]), "cut")
    slim = named.select("doc_id", "key", "sha", F.octet_length("text").cast("long").alias("n_bytes")).join(cut, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return slim.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), *["kept"] * texts_out)


def op5_suffix_array(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
