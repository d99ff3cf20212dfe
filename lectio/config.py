"""Every tunable in one frozen object; pass another one to change behaviour."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    embedding_provider: str = "hashing"
    embedding_dim: int = 384
    local_embed_model: str = "sentence-transformers/all-MiniLM-L6-v2"
    local_embed_dim: int = 384
    remote_embed_url: str = "http://localhost:8080/v1/embeddings"
    remote_embed_model: str = "default"
    remote_embed_dim: int = 768
    collection: str = "documents"
    bootstrap: bool = True
    embed_batch_size: int = 64
    embed_max_retries: int = 5
    embed_backoff_s: float = 2.0
    runon_word_length: int = 15
    runon_max_fraction: float = 0.08
    furniture_min_pages: int = 3
    furniture_min_fraction: float = 0.6
    furniture_max_document_fraction: float = 0.9
    chunk_size: int = 1000
    chunk_overlap: int = 150
    chunk_min_tokens: int = 64
    chunk_max_tokens: int = 512
    semantic_chunking: bool = True
    breakpoint_percentile: float = 90.0
    k_retrieve: int = 20
    k_final: int = 5
    reranking: bool = True
    rerank_batch_size: int = 32
    fusion_method: str = "rrf"
    rrf_k: int = 60
    dense_weight: float = 0.5
    sparse_weight: float = 0.5
    query_transform: str = "multi_query"
    multi_query_count: int = 3
    history_turns: int = 4
    max_context_tokens: int = 6000
    grounding_threshold: float = 0.5
    confidence_high: float = 0.75
    confidence_medium: float = 0.5
    heading_max_words: int = 12
    heading_max_chars: int = 90
    heading_max_number: int = 99
    outline_step: int = 3
    short_question_words: int = 4
    answer_excerpt_chars: int = 300
    uncited_preview_chars: int = 280
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25

    @classmethod
    def from_env(cls, secrets: dict | None = None, prefix: str = "LECTIO_") -> Config:
        """Environment first, then the secrets, then the default."""

        def one(f):
            raw = os.environ.get(prefix + f.name.upper(), (secrets or {}).get(f.name, f.default))
            kind = type(f.default)
            return raw in (True, "true", "True", "1", "on") if kind is bool else kind(raw)

        return cls(**{f.name: one(f) for f in fields(cls)})


DEFAULT = Config()


def embedding_dimension(provider: str, config: Config = DEFAULT) -> int:
    """A provider's vector width, without a call to its model."""
    widths = {"hashing": config.embedding_dim, "local": config.local_embed_dim, "remote": config.remote_embed_dim}
    if provider not in widths:
        raise ValueError(f"unknown embedding provider {provider!r}; known: {', '.join(sorted(widths))}")
    return widths[provider]
