"""Byte-level BPE through sentencepiece.

The rank file becomes a sentencepiece BPE model without any training: every vocabulary entry is written
as a piece whose bytes are mapped to 256 letters, scored by its negative rank, under identity
normalisation, so that merging the best-scored pair first is merging by rank. A text is cut by the
pre-token pattern, each pre-token is encoded on its own, and decoding maps ids back to their bytes.
An id equals the entry's rank.

Defined results: null text is the empty text (no ids; the digest of nothing). A pre-token that is itself
a vocabulary entry takes that entry's id, as in the tiktoken library. Bytes that are not UTF-8 are
replaced by U+FFFD before encoding. Repeated rows are encoded again; nothing is shuffled, so ties and
skew don't matter. Texts of any length are taken whole, one at a time. An empty table gives an empty one. Other columns are not
read, whatever their names. The model (about a megabyte, fixed by the vocabulary) is the only thing sent out.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from larkspur.llm.common import id_text, map_arrow, utf8

#: Where the bytes 0 to 255 are mapped: letters that no normaliser or white-space rule touches.
FIRST_LETTER = 0x100
_LETTERS = {b: FIRST_LETTER + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file in the order of their ranks; ranks must be 0, 1, 2, ..."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranks) - 1}")
    return [ranks[k] for k in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field in protobuf's wire format."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(entries: list[bytes]) -> bytes:
    """The sentencepiece ModelProto of a byte-level vocabulary."""
    normal, unknown, bpe = 1, 2, 2
    pieces = b"".join(
        _field(1, _field(1, entry.decode("latin-1").translate(_LETTERS).encode()) + _field(2, -float(rank)) + _field(3, normal))
        for rank, entry in enumerate(entries)
    )
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(entries) + 1) + _field(40, len(entries))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class BpeCodec:
    """Encodes and decodes with one serialised model. ``encode`` gives ids as little-endian 32-bit bytes."""

    #: Characters of pre-tokens that the cache may hold, about 200 MB with the dictionary's own needs.
    CACHE_CHARS = 4_000_000

    def __init__(self, model: bytes, pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {FIRST_LETTER + b: b for b in range(256)}
        n = self.sp.get_piece_size() - 1
        self.entries = [self.sp.id_to_piece(k).translate(back).encode("latin-1") for k in range(n)]
        self.ranks = {e: k for k, e in enumerate(self.entries)}
        self.lengths = np.array([len(e) for e in self.entries], np.int32)
        self.cut = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, tokens) -> dict[str, bytes]:
        new, rest = {}, []
        for t in tokens:
            rank = self.ranks.get(t.encode())
            if rank is None:
                rest.append(t)
            else:
                new[t] = rank.to_bytes(4, "little")
        mapped = [t.encode().decode("latin-1").translate(_LETTERS) for t in rest]
        for t, ids in zip(rest, self.sp.encode(mapped, num_threads=1) if rest else [], strict=True):
            new[t] = np.array(ids, "<u4").tobytes()
        return new

    def encode(self, text: str) -> bytes:
        tokens = self.cut(text)
        cache = self.cache
        if missing := set(tokens).difference(cache):
            if self.held > self.CACHE_CHARS:
                cache.clear()
                self.held, missing = 0, set(tokens)
            new = self._learn(missing)
            size = sum(map(len, new))
            if size > self.CACHE_CHARS // 4:  # one text's own words: not worth keeping
                new.update((t, cache[t]) for t in set(tokens).difference(new))
                return b"".join(map(new.__getitem__, tokens))
            cache.update(new)
            self.held += size
        return b"".join(map(cache.__getitem__, tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[int, str], BpeCodec] = {}


def codec(model: bytes, pattern: str) -> BpeCodec:
    """This process's codec for a model, made once."""
    key = hash(model), pattern
    if key not in _codecs:
        _codecs[key] = BpeCodec(model, pattern)
    return _codecs[key]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids binary (little-endian 32-bit), n_tokens`` of every whole text; one pass, no shuffle."""
    return _codec_pass(docs, ranks_path, pattern, id_col, text_col, False)


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each text is encoded, and its ids are decoded."""
    return _codec_pass(docs, ranks_path, pattern, id_col, text_col, True)


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, data binary`` from the columns ``doc_id, ids``; null ids decode to nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))

    def rows(batch):
        c = codec(shared.value, pattern)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(v) for v in utf8(batch, "ids")], pa.binary())], ["doc_id", "data"])

    return map_arrow(encoded.select("doc_id", "ids"), rows, "doc_id long, data binary")


def _codec_pass(docs, ranks_path, pattern, id_col, text_col, digests):
    shared = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))

    def rows(batch):
        c = codec(shared.value, pattern)
        n, one, two = [], [], []
        for raw in utf8(batch):
            ids = c.encode(raw.decode("utf-8", "replace"))
            n.append(len(ids) // 4)
            if digests:
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(c.decode(ids)).hexdigest())
            else:
                one.append(ids)
        cols = [batch.column("doc_id")] + ([pa.array(n, pa.int64()), pa.array(one), pa.array(two)] if digests else [pa.array(one, pa.binary()), pa.array(n, pa.int64())])
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "ids", "n_tokens"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids binary, n_tokens long"
    return map_arrow(id_text(docs, id_col, text_col), rows, schema)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
