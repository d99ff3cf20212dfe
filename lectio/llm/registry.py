"""The queries of this subpackage and their DuckDB equivalents, for __spark_entry__.py."""

from __future__ import annotations

from .bpe import op9_byte_bpe
from .ngram_join import op2_ngram_jaccard_join
from .packing import op1_best_fit_packing
from .pii import op8_pii_spans
from .quality import op10_quality_classifier
from .sharding import op6_jump_hash_sharding
from .topk import op7_exact_topk
from .toxicity import op4_toxicity
from .urlfilter import URL_FILTER_SQL, op3_url_filters
from .vecdedup import VECTOR_DEDUP_SQL, op5_embedding_dedup
from .topk import TOPK_SQL

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_url_filters": op3_url_filters,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_jump_hash_sharding": op6_jump_hash_sharding,
    "op7_exact_topk": op7_exact_topk,
    "op8_pii_spans": op8_pii_spans,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL = {
    "op3_url_filters": URL_FILTER_SQL,
    "op5_embedding_dedup": VECTOR_DEDUP_SQL,
    "op7_exact_topk": TOPK_SQL,
}
