"""Tunables, as plain values with defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    top_k_recall: int = 60
    top_k_final: int = 10
    rrf_k: int = 60
    graph_weight: float = 2.0
    graph_seeds: int = 8
    graph_chunk_cap: int = 60
    rerank_threshold: float = 0.2
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    max_chunk_tokens: int = 800
    break_percentile: float = 90.0
    history_messages: int = 4
    session_messages: int = 6
    dedupe_ttl_seconds: int = 600
    max_heading_chars: int = 40
    community_max: int = 800


def from_env(environment: Mapping[str, str], prefix: str = "QUILL_") -> Config:
    """The defaults, with what the environment names (QUILL_RRF_K=50) in the type of the default. A
    name that is no tunable, or a value that is not of its type, is an error."""
    known, found = {f.name: type(f.default) for f in fields(Config)}, {}
    for key, value in environment.items():
        if key.startswith(prefix):
            name = key.removeprefix(prefix).lower()
            if name not in known:
                raise ValueError(f"no tunable {name}")
            found[name] = known[name](value)
    return replace(Config(), **found)


DEFAULT = from_env(os.environ)
