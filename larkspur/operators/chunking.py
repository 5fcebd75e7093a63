"""Chunks under a token budget, with provenance.

Sentences are split by a Catalyst expression; the packing of sentences depends on what was packed before,
so it is a fold in a UDF, section by section and without a shuffle. Rows come to it by the hundred: in Arrow it would hold
the sentences of 10,000 sections at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from larkspur.config import Settings
from larkspur.functions import text as tx

Counter = Callable[[str], int]

EMBEDDED = 1024  # sentences that are embedded at once


def estimate(text: str) -> int:
    return max(1, round(len(text) / 4))


class Packer:
    """Fills chunks sentence by sentence. A chunk is full when both the sum of its sentences' counts and the
    count of its joined text pass the target; it also ends at a breakpoint once both have reached half. The
    last sentences of a chunk, within ``overlap`` but one at least, start the next."""

    def __init__(self, target: int, overlap: int, count: Counter = estimate):
        if overlap >= target:
            raise ValueError("overlap must be smaller than the target")
        self.target, self.overlap, self.count = target, overlap, count

    def _over(self, parts: list[tuple[str, int]], limit: int) -> bool:
        return sum(n for _, n in parts) > limit and self.count(" ".join(s for s, _ in parts)) > limit

    def _tail(self, parts: list[tuple[str, int]]) -> list[tuple[str, int]]:
        if self.overlap <= 0:
            return []
        at = len(parts) - 1
        while at > 0 and not self._over(parts[at - 1 :], self.overlap):
            at -= 1
        return parts[at:]

    def pack(self, sentences: Iterable[str], breaks: frozenset[int] = frozenset()) -> list[str]:
        out, held = [], []
        for k, s in enumerate(sentences):
            new = (s, self.count(s))
            if held and self._over([*held, new], self.target):
                out.append(" ".join(x for x, _ in held))
                held = self._tail(held)
            held = [*held, new]
            half = self.target // 2
            if k in breaks and sum(n for _, n in held) >= half and self.count(" ".join(x for x, _ in held)) >= half:
                out.append(" ".join(x for x, _ in held))
                held = self._tail(held)
        if held:
            out.append(" ".join(x for x, _ in held))
        return out


def topic_breaks(vectors: np.ndarray, percentile: float) -> frozenset[int]:
    """Sentences after which the similarity to the next is within the lowest (100 - percentile) percent; none
    below four sentences. A zero vector is similar to nothing."""
    if len(vectors) < 4:
        return frozenset()
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    units = vectors / np.where(size > 0, size, 1)
    near = (units[:-1] * units[1:]).sum(axis=1)
    return frozenset(np.flatnonzero(near <= np.percentile(near, 100 - percentile)).tolist())


def fixed_chunks(target: int = 512, overlap: int = 64, count: Counter = estimate):
    """A Column function: array of sentences to array of chunks."""
    packer = Packer(target, overlap, count)

    @F.udf(ArrayType(StringType()), useArrow=False)
    def run(sentences):
        return packer.pack(sentences or [])

    return run


def semantic_chunks(embed: Callable[[list[str]], np.ndarray], target: int = 512, overlap: int = 64, percentile: float = 95, count: Counter = estimate, limit: int | None = None):
    """Like ``fixed_chunks``, with topic breaks; the sentences of a document are embedded ``EMBEDDED`` at a time.
    ``limit`` is the embedding model's own length, which the target may not pass."""
    if limit is not None and target > limit:
        raise ValueError(f"target {target} is more than the model takes ({limit})")
    packer = Packer(target, overlap, count)

    @F.udf(ArrayType(StringType()), useArrow=False)
    def run(sentences):
        if not sentences:
            return []
        vectors = [np.asarray(embed(sentences[at : at + EMBEDDED])) for at in range(0, len(sentences), EMBEDDED)]
        return packer.pack(sentences, topic_breaks(np.concatenate(vectors), percentile))

    return run


def adjacent_similarity(vectors: DataFrame, group: str, order: str, vector: str = "vector", percentile: float = 95) -> DataFrame:
    """Topic breaks as a window plan: ``group, order, similarity, is_break`` for each row with a next one, in
    groups of four rows or more."""
    from pyspark.sql import Window

    from larkspur.functions.vector import dot, normalised

    w = Window.partitionBy(group)
    rows = vectors.select(group, order, normalised(F.col(vector)).alias("u")).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("next", F.lead("u").over(w.orderBy(order))).filter("n >= 4 AND next IS NOT NULL")
    rows = rows.select(group, order, F.round(dot(F.col("u"), F.col("next")), 9).alias("similarity"))
    bar = F.percentile("similarity", F.lit((100 - percentile) / 100)).over(w)
    return rows.withColumn("is_break", F.col("similarity") <= F.round(bar, 9))


def chunk_sections(filings: DataFrame, sections: DataFrame, splitter=None, settings: Settings | None = None) -> DataFrame:
    """Chunk rows with their filing's metadata: ``chunk_id, filing_id, text, order, token_count`` and ten
    provenance columns. Bodies and chunks under ``min_chunk_chars`` are dropped; ``order`` counts them."""
    settings = settings or Settings()
    splitter = splitter or fixed_chunks(settings.chunk_target_tokens, settings.chunk_overlap_tokens)
    body = sections.withColumn("body", tx.without_heading(F.col("text"))).filter(F.length("body") >= settings.min_chunk_chars)
    pieces = body.select("filing_id", F.col("item").alias("_item"), F.col("part").alias("_part"), F.posexplode(splitter(tx.sentences(F.col("body")))).alias("order", "text"))
    pieces = pieces.filter(F.length("text") >= settings.min_chunk_chars)
    source = filings.withColumn("filing_id", tx.filing_id(F.col("cik"), F.col("accession_number")))
    out = pieces.join(source, "filing_id")
    return out.select(
        tx.chunk_id(F.col("accession_number"), F.col("_part"), F.col("_item"), F.col("order")).alias("chunk_id"), "filing_id", "text", "order",
        tx.token_estimate(F.col("text")).alias("token_count"), "cik", "ticker", "company_name", "form_type", "accession_number", "filing_date",
        "fiscal_year", "fiscal_period", tx.empty_to_null(F.col("_item")).alias("item"), F.col("_part").alias("part"),
    )
