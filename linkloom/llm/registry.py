"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .block_dedup import op10_block_dedup
from .bpe import op6_bpe_roundtrip
from .decontaminate import op2_decontamination
from .language_id import op7_language_id
from .lexical_search import op12_lexical_search
from .near_dedup import op3_near_dedup
from .oracle import ORACLE_SQL
from .prefix_trie import op13_prefix_trie
from .quality_model import op8_quality_model
from .quality_rules import op5_quality_rules
from .sharding import op1_sharding
from .suffix_dedup import op4_suffix_dedup
from .token_counts import op9_token_counts
from .toxicity import op11_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_near_dedup": op3_near_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe_roundtrip": op6_bpe_roundtrip,
    "op7_language_id": op7_language_id,
    "op8_quality_model": op8_quality_model,
    "op9_token_counts": op9_token_counts,
    "op10_block_dedup": op10_block_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
