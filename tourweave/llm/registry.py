"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annular_codes, budget_mixing, byte_bpe, chat_format, html_text, jacobi_whitening, pstable_ann, quality_bt, ring_sharding, secret_scan, simhash_dedup, suffix_tree_lm, template_decontam

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash_dedup.op1_simhash_near_dedup,
    "op2_html_text": html_text.op2_html_text,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_quality_bradley_terry": quality_bt.op5_quality_bradley_terry,
    "op6_pstable_ann": pstable_ann.op6_pstable_ann,
    "op7_ring_sharding": ring_sharding.op7_ring_sharding,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_suffix_tree_lm": suffix_tree_lm.op9_suffix_tree_lm,
    "op10_template_decontamination": template_decontam.op10_template_decontamination,
    "op11_budget_mixing": budget_mixing.op11_budget_mixing,
    "op12_jacobi_whitening": jacobi_whitening.op12_jacobi_whitening,
    "op13_annular_codes": annular_codes.op13_annular_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat_format.OP3_SQL,
    "op13_annular_codes": annular_codes.OP13_SQL,
}
