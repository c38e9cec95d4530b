"""Settings with defaults, overridden by environment variables CORROBORATE_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 700
    chunk_overlap: int = 100
    retrieval_mode: str = "keyword"
    keyword_top_k: int = 10
    vector_top_k: int = 10
    rrf_k: int = 60
    keyword_weight: float = 1.0
    vector_weight: float = 1.0
    rerank_enabled: bool = False
    rerank_candidates: int = 10
    researchers: int = 3
    rounds: int = 2
    min_evidence: int = 2
    results_per_researcher: int = 3
    context_tokens: int = 12_000
    reserved_tokens: int = 3_500
    source_tokens: int = 1_200
    max_sources: int = 18
    max_sources_per_domain: int = 2
    min_quality: float = 0.35
    search_provider: str = "mock"
    breaker_threshold: int = 2
    breaker_cooldown_s: float = 60.0
    search_rate_per_s: float = 0.0
    lease_seconds: int = 600


def load(environ: dict[str, str] | None = None) -> Settings:
    """Unknown names are left alone; a value that is not of its field's type is an error."""
    env = os.environ if environ is None else environ
    kinds = {"int": int, "float": float, "str": str, "bool": lambda x: {"1": True, "true": True, "0": False, "false": False}[x.strip().lower()]}
    given = {f.name: kinds[f.type](env[k]) for f in fields(Settings) if (k := f"CORROBORATE_{f.name.upper()}") in env}
    return Settings(**given)
