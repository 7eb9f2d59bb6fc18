"""Queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP3_SQL, op3_chat_formatting
from .class_lm import op8_class_lm_scoring
from .decontaminate import OP10_SQL, op10_benchmark_decontamination
from .jaccard import OP5_SQL, op5_ngram_jaccard_join
from .licenses import op2_license_scans
from .line_dedup import op4_line_dedup
from .packing import op1_best_fit_packing
from .quality import op7_quality_rules
from .token_counts import op6_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_scans": op2_license_scans,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_class_lm_scoring": op8_class_lm_scoring,
    "op9_toxicity": op9_toxicity,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": OP3_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
}
