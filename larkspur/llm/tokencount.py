"""Token counts by section, from one encoding of the whole document.

A document is encoded once. Each token spans characters (a character belongs to the token that holds its
first byte), and the spans are joined to the sections' intervals, both being ordered. A token that crosses
a boundary is allocated to the section that holds its first character (rule ``start``), its last
(``end``), or most of its characters, the earlier of equal ones (``most``); it is counted as crossing in
that section. A token without a first byte of any character belongs where its first byte's character is.

Sections are intervals of characters, ``[start, end)``, that cover the text: by default its lines, each
with its line feed, or named fields that are joined with a separator before encoding.

Defined results: null and empty texts have no sections and no rows. Sections without tokens are listed
with 0. Every row is attributed on its own; repeated ids give repeated sections. Nothing is shuffled. A tie under
``most`` goes to the earlier section. Texts of any length are taken whole; an empty table gives an empty one. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.bpe import codec, read_ranks, serialise_model
from larkspur.llm.common import id_text, map_arrow, utf8

RULES = ("start", "end", "most")


def token_chars(raw: np.ndarray, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) character of each token of UTF-8 bytes; last is at least first."""
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    end = np.cumsum(token_bytes)
    begin = end - token_bytes
    first = char[begin]
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters that start before a byte
    return first, np.maximum(first, starts[end] - 1)


def allocate(first: np.ndarray, last: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section, whether it crosses) of tokens over the sections that end before the characters ``ends``."""
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "right")
    crosses = a != b
    if rule == "start" or not crosses.any():
        return a, crosses
    if rule == "end":
        return b, crosses
    out = a.copy()
    for k in np.flatnonzero(crosses):
        edges = np.concatenate(([first[k]], ends[a[k] : b[k]], [last[k] + 1]))
        out[k] = a[k] + np.argmax(np.diff(edges))
    return out, crosses


def section_tokens(
    docs: DataFrame, ranks_path: str, pattern: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text", fields: list[str] | None = None, separator: str = "\n"
) -> DataFrame:
    """``doc_id, section, char_start, char_end, n_tokens, n_crossing`` of every section. With ``fields`` the
    sections are these columns (null: empty), joined by ``separator``, which belongs to the field before it."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(ranks_path)))
    if fields:
        parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
        slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.concat_ws(separator, *parts).alias("text"), F.array(*[F.char_length(p) for p in parts]).alias("sizes"))
    else:
        slim = id_text(docs, id_col, text_col)

    def rows(batch):
        c = codec(shared.value, pattern)
        out = [[] for _ in range(6)]
        sizes = batch.column("sizes") if fields else None
        for k, data in enumerate(utf8(batch)):
            text = data.decode("utf-8", "replace")
            if not text:
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            ids = np.frombuffer(c.encode(text), "<u4")
            first, last = token_chars(raw, c.lengths[ids])
            n_chars = len(text)
            if fields:
                ends = np.cumsum(np.array(sizes[k].as_py(), np.int64) + len(separator))
                ends[-1] = n_chars
            else:
                at = np.flatnonzero(raw == 10)
                ends = np.cumsum((raw & 0xC0) != 0x80)[at]
                if not len(ends) or ends[-1] < n_chars:
                    ends = np.append(ends, n_chars)
            where, crosses = allocate(first, last, ends, rule)
            n = len(ends)
            got = (np.full(n, k), np.arange(n), np.concatenate(([0], ends[:-1])), ends, np.bincount(where, minlength=n), np.bincount(where[crosses], minlength=n))
            for x, y in zip(out, got, strict=True):
                x.append(y)
        if not out[0]:
            return None
        row, *cols = [np.concatenate(x).astype(np.int64) for x in out]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *map(pa.array, cols)], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return map_arrow(slim, rows, "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return section_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
