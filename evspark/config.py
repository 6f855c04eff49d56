"""Parameters that change results, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_size: int = 800
    chunk_overlap: int = 120
    top_k: int = 40
    rerank_n: int = 8
    rerank_candidates: int = 12
    context_budget: int = 6000
    rrf_k: int = 60
    bm25_weight: float = 0.4
    vector_weight: float = 0.6
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    confidence_high: float = 0.80
    confidence_medium: float = 0.60
    sufficiency: float = 0.5
    sufficiency_lexical: float = 0.25
    anchor_coverage: float = 0.5
    anchor_corpus_missing: float = 0.4
    attribution: float = 0.45
    low_stock: int = 5


DEFAULT = Config()
