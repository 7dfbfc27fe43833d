"""The queries of these operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from strandkeep.llm import decontamination, hilbert_shards, near_dups, nearest, page_text, prefix_trie, quality, source_mix, state_model, substring_dedup, token_counts, toxicity, turn_repair

MODULES = (token_counts, substring_dedup, decontamination, near_dups, page_text, source_mix, nearest, quality, hilbert_shards, toxicity, state_model, turn_repair, prefix_trie)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
