"""Stupid-backoff scores of documents against n-gram counts of the corpus itself.

S(w | context) is count(context w) / count(context) where the n-gram was seen, else ``ALPHA`` times the
score of the shorter context; a word alone has count / N. A document must not vouch for itself, so its own
occurrences are taken off every count before (leave-one-out). An unseen word counts half.

The join of n-grams to counts is relational, by hash partition, but rows are packed, since a row for each
n-gram occurrence would be ten times the texts:

1. Documents are gathered into chunks of about ``CHUNK_WORDS`` words, written as indices into the chunk's vocabulary
   of word hashes, frequent words first.
2. For every order and part (a range of the hash, about ``PART_WORDS`` of the corpus' words each, so their
   number grows with the corpus) a chunk explodes its n-grams into a packed request: sorted hashes, delta-coded, and
   how often each occurs in the chunk. Requests meet by (order, part): there that partition of the count
   table is made, and joined to the requests, each of which is answered in the order in which it asked. No key is hot: a
   frequent n-gram is one entry of each chunk's request, however often it occurs.
3. Answers meet their chunk (they are as many as its n-grams, whatever the corpus holds), and every document's
   n-grams are scored and summed.

Hashes of n-grams are as wide as the corpus needs, ``SPARE_BITS`` above the number of its words and 64 at most: of four
million n-grams one may be taken for another. Where a corpus has so many parts that a request holds few n-grams, packed rows
become as many as exploded ones would be, never more.

Defined results: null or empty text has no words, score 0 and null ``per_word``. Repeated ids and rows are documents
of their own (each vouches for its copies), and a null id stays null. Words are runs of anything but white space (space and the
controls from tab to carriage return), A-Z lowered. Texts are scored whole, however long; equal n-grams count each time. An empty table gives
an empty one. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import id_text, mix, utf8

ORDER, ALPHA = 3, 0.4
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_WORDS = PART_WORDS = 1_000_000
SPARE_BITS = 22
SLICE_BYTES = 4 << 20
_U = np.uint64


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct hashes as deltas, byte plane by byte plane, and counts."""
    delta = np.diff(hashes, prepend=_U(0))
    planes = delta.astype("<u8").view(np.uint8).reshape(-1, 8).T
    kept = [k for k in range(8) if planes[k].any()]
    body = b"".join(planes[k].tobytes() for k in kept)
    return struct.pack("<IB", len(hashes), sum(1 << k for k in kept)) + pack_counts(counts) + body


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, mask = struct.unpack_from("<IB", data)
    counts, at = unpack_counts(data, 5, n)
    planes = np.zeros((8, n), np.uint8)
    for k in range(8):
        if mask >> k & 1:
            planes[k] = np.frombuffer(data, np.uint8, n, at)
            at += n
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=_U), counts


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes (255: in the list of larger ones that follows), deflated."""
    small = np.minimum(counts, 255).astype(np.uint8)
    body = zlib.compress(small.tobytes() + counts[counts >= 255].astype("<i8").tobytes(), 1)
    return struct.pack("<I", len(body)) + body


def unpack_counts(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    (size,) = struct.unpack_from("<I", data, at)
    body = zlib.decompress(data[at + 4 : at + 4 + size])
    counts = np.frombuffer(body, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(body, "<i8", -1, n)
    return counts, at + 4 + size


def _slices(batch: pa.RecordBatch):
    """Parts of a batch with about SLICE_BYTES of text, or one row of more."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]))
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(first, last - first)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in turn, words of each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    starts, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.filter(pa.array(full)).dictionary_encode()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), _U, len(coded.dictionary))
    before = np.concatenate(([0], np.cumsum(full)))[starts - starts[0]]
    return hashed[coded.indices.to_numpy()], np.diff(before)


def _chunks(batches):
    """(ids, words of each document, word hashes), about CHUNK_WORDS words at a time."""
    held, n = [], 0
    for batch in batches:
        for part in _slices(batch):
            flat, size = word_hashes(part.column("text"))
            ids, at, ends = part.column("doc_id"), 0, np.cumsum(size)
            while at < len(size):
                done = int(ends[at - 1]) if at else 0
                upto = min(int(np.searchsorted(ends, done + CHUNK_WORDS - n)) + 1, len(size))
                held.append((ids.slice(at, upto - at), size[at:upto], flat[done : ends[upto - 1]]))
                n += int(ends[upto - 1]) - done
                at = upto
                if n >= CHUNK_WORDS:
                    yield _joined(held)
                    held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids, size, flat = zip(*held, strict=True)
    return pa.concat_arrays(ids), np.concatenate(size), np.concatenate(flat)


def _grams(flat: np.ndarray, doc: np.ndarray, order: int, bits: int):
    """For n from 1 to order: (hash of each n-gram, place of its last word); none crosses from one document to the next."""
    out = np.zeros(len(flat), _U)
    for n in range(1, order + 1):
        m = max(len(flat) - n + 1, 0)
        out = mix(out[:m] + flat[n - 1 :][:m] + _U(n))
        inside = np.flatnonzero(doc[:m] == doc[n - 1 :][:m])
        yield out[inside] >> _U(64 - bits), inside + n - 1


def _edges(parts: int, bits: int) -> np.ndarray:
    return np.array([(k << bits) // parts for k in range(1, parts)], _U)


def _requests(chunks: DataFrame, order: int, parts: int, bits: int) -> DataFrame:
    """``chunk, ord, part, data`` of every chunk."""

    def rows(batches):
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), utf8(batch, "data"), strict=True):
                size, flat = unpack_documents(data)
                doc = np.repeat(np.arange(len(size)), size)
                for n, (grams, _) in enumerate(_grams(flat, doc, order, bits), 1):
                    got, counts = np.unique(grams, return_counts=True)
                    cut = np.searchsorted(got, _edges(parts, bits))
                    out = [(part, pack(g, c)) for part, (g, c) in enumerate(zip(np.split(got, cut), np.split(counts, cut), strict=True)) if len(g)]
                    if out:
                        part, packed = zip(*out, strict=True)
                        cols = [pa.array([chunk] * len(out), pa.int64()), pa.array([n] * len(out), pa.int32()), pa.array(part, pa.int32()), pa.array(packed, pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, ["chunk", "ord", "part", "data"])

    return chunks.mapInArrow(rows, "chunk long, ord int, part int, data binary")


def count_table(asked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One partition of the count table from all requests of it: (n-grams, totals, where each request entry stands)."""
    keys, back = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in asked]), len(keys)).astype(np.int64), back


def _answers(requests: DataFrame) -> DataFrame:
    """``chunk, ord, part, data``: totals over all chunks, in the order of the request."""

    def meet(table: pa.Table) -> pa.Table:
        asked = [unpack(d.as_py()) for d in table.column("data")]
        _, total, back = count_table(asked)
        answer, at = [], 0
        for h, _ in asked:
            answer.append(pack_counts(total[back[at : at + len(h)]]))
            at += len(h)
        return table.set_column(table.schema.get_field_index("data"), "data", pa.array(answer, pa.binary()))

    return requests.groupBy("ord", "part").applyInArrow(meet, "chunk long, ord int, part int, data binary")


def _left(grams: np.ndarray, doc: np.ndarray, answers: list, parts: int, bits: int) -> np.ndarray:
    """The corpus' count of each n-gram, without the occurrences in its own document."""
    order = np.argsort(grams, kind="stable")  # documents are in order among equal ones
    grams, doc = grams[order], doc[order]
    new = np.concatenate(([True], grams[1:] != grams[:-1]))[: len(grams)]
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate(([0], np.searchsorted(grams[first], _edges(parts, bits)), [len(first)])))
    totals = np.concatenate([unpack_counts(data, 0, int(size[part]))[0] for part, data in sorted(answers)]) if answers else np.zeros(0, np.int64)
    mine = np.flatnonzero(new | np.concatenate(([True], doc[1:] != doc[:-1]))[: len(grams)])
    own = np.diff(np.concatenate((mine, [len(grams)])))
    out = np.empty(len(grams), np.int64)
    out[order] = totals[np.cumsum(new) - 1] - np.repeat(own, own)
    return out


def _score(size: np.ndarray, flat: np.ndarray, answers: list[dict], order: int, parts: int, bits: int, total: int) -> np.ndarray:
    """The score of each document of a chunk."""
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    shorter = score = None
    for n, (grams, last) in enumerate(_grams(flat, doc, order, bits), 1):
        here = np.zeros(len(flat), np.int64)
        here[last] = _left(grams, doc[last], [(a["part"], a["data"]) for a in answers if a["ord"] == n], parts, bits)
        if n == 1:
            score = np.log(np.maximum(here, 0.5) / np.maximum(total - size, 1)[doc])
        else:
            context = np.maximum(np.concatenate(([1], shorter[:-1])), 1)
            fallback = score + np.where(place >= n - 1, np.log(ALPHA), 0.0)
            score = np.where(here > 0, np.log(np.maximum(here, 1) / context), fallback)
        shorter = here
    out = np.zeros(len(size))
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(score, (np.cumsum(size) - size)[some])
    return out


def lm_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, score, per_word``: the sum of log scores, and it divided by the number of words."""
    texts = id_text(docs, id_col, text_col)
    total = texts.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    parts, bits = total // PART_WORDS + 1, min(64, total.bit_length() + SPARE_BITS)
    # shuffled once, and read from there both for the requests and for the join with the answers
    chunks = _pack_chunks(texts).repartition("chunk")
    answers = _answers(_requests(chunks, order, parts, bits))
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("ord", "part", "data")).alias("answers"))

    def rows(batches):
        for batch in batches:
            for k, data in enumerate(utf8(batch, "data")):
                size, flat = unpack_documents(data)
                score = _score(size, flat, batch.column("answers")[k].as_py() or [], order, parts, bits, total)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, pa.array(size), pa.array(score)], ["doc_id", "n_words", "score"])

    out = chunks.join(answers, "chunk", "left").select("ids", "data", "answers").mapInArrow(rows, "doc_id long, n_words long, score double")
    return out.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))


def _pack_chunks(texts: DataFrame) -> DataFrame:
    """``chunk, ids, data`` of every chunk."""

    def rows(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, (ids, size, flat) in enumerate(_chunks(batches)):
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            cols = [pa.array([task << 32 | number]), listed, pa.array([pack_documents(size, flat)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["chunk", "ids", "data"])

    return texts.mapInArrow(rows, "chunk long, ids array<long>, data binary")


def pack_documents(size: np.ndarray, flat: np.ndarray) -> bytes:
    """Documents as indices, byte plane by byte plane, into their distinct word hashes, the most frequent first."""
    vocabulary, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.argsort(-counts, kind="stable")
    back = np.empty(len(rank), "<u4")
    back[rank] = np.arange(len(rank))
    planes = back[index].view(np.uint8).reshape(-1, 4).T
    body = zstandard.ZstdCompressor(level=1).compress(size.astype("<u4").tobytes() + np.ascontiguousarray(planes).tobytes())
    return struct.pack("<III", len(size), len(flat), len(vocabulary)) + vocabulary[rank].astype("<u8").tobytes() + body


def unpack_documents(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(words of each document, word hashes)."""
    n_docs, n, words = struct.unpack_from("<III", data)
    vocabulary = np.frombuffer(data, "<u8", words, 12)
    body = zstandard.ZstdDecompressor().decompress(data[12 + 8 * words :])
    size = np.frombuffer(body, "<u4", n_docs).astype(np.int64)
    planes = np.frombuffer(body, np.uint8, 4 * n, 4 * n_docs).reshape(4, n)
    return size, vocabulary[np.ascontiguousarray(planes.T).view("<u4").ravel()].astype(_U)


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
