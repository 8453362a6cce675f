"""Defaults of every stage. ``None`` as an argument means "take the setting"; an empty string turns a stage off."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    chunk_strategy: str = "sentence"
    chunk_size: int = 1000
    chunk_overlap: int = 200
    top_k: int = 5
    retrieval_mode: str = "dense"
    hybrid_candidates: int = 50
    rrf_k: int = 60
    rerank_model: str = ""
    rerank_candidates: int = 30
    query_transform: str = ""
    transform_n: int = 3
    history_turns: int = 4
    compress_method: str = "embedding"
    compress_candidates: int = 20
    compress_budget: int = 3688
    compress_length_penalty: float = 0.0
    context_chars: int = 12000
    prompt_version: str = "v2"
    guard_detect: bool = False
    embedding_model: str = "hash-64"
    generation_model: str = "extractive"
    cache_ttl_s: int = 604800
    cache_semantic_threshold: float | None = None
    trace_path: str | None = None
    trace_content: bool = False
    generation_usd_per_mtok_input: float | None = None
    generation_usd_per_mtok_output: float | None = None
    corpus_dir: str = ""

    def keyed(self) -> dict:
        """Settings that can shape an answer: all but a few that cannot, secrets, paths and the judge's."""
        # Names that never take part in a cache key.
        unkeyed = {"cache_ttl_s", "cache_semantic_threshold", "trace_content", "generation_usd_per_mtok_input", "generation_usd_per_mtok_output", "corpus_dir"}
        return {k: v for k, v in asdict(self).items() if k not in unkeyed and not k.endswith(("_api_key", "_path")) and not k.startswith("judge_")}
