"""Queries of the corpus operators and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, simhash, suffix_tree, token_files, toxicity, url_cascade, zstd_models


def queries() -> dict:
    return {
        "op1_suffix_tree": suffix_tree.query,
        "op2_simhash": simhash.query,
        "op3_url_cascade": url_cascade.query,
        "op4_toxicity": toxicity.query,
        "op5_repair_tokens": token_files.query,
        "op6_winnowing": decontaminate.query,
        "op7_quality": zstd_models.query_quality,
        "op8_exact_dedup": exact_dedup.query,
        "op9_byte_bpe": bpe.query,
        "op10_language": zstd_models.query_language,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_cascade": url_cascade.ORACLE,
        "op6_winnowing": decontaminate.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
    }
