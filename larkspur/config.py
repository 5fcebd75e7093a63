"""Settings of the retrieval pipeline."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_target_tokens: int = 512
    chunk_overlap_tokens: int = 64
    semantic_breakpoint_percentile: int = 95
    min_chunk_chars: int = 200
    embedding_model: str = "hashing-64"
    embedding_dim: int = 64
    embedding_batch_size: int = 64
    index_type: str = "flat"
    ivf_nlist: int = 256
    retrieval_top_k: int = 5
    retrieval_candidate_k: int = 20
    rrf_k: int = 10
    llm_provider: str = "extractive"
    llm_model: str = "extractive"
    judge_model: str = "extractive"
    llm_max_tokens: int = 512
    llm_temperature: float = 0.0
    max_api_calls_per_run: int = 200
    max_cost_usd_per_run: float = 5.0
    requests_per_second: float = 8.0
    max_retries: int = 5
    user_agent: str = ""

    def __post_init__(self):
        if self.chunk_overlap_tokens >= self.chunk_target_tokens:
            raise ValueError("overlap must be smaller than the target")

    @classmethod
    def from_mapping(cls, values: dict) -> "Settings":
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})
