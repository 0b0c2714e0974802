"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidara.llm import (
    op1_suffix_arrays,
    op2_suffix_trees,
    op3_line_frequency,
    op4_url_trees,
    op5_anchor_pii,
    op6_log_bilinear,
    op7_mixing,
    op8_pigeonhole,
    op9_subword_toxicity,
    op10_setsketch,
    op11_jacobi_whitening,
    op12_neighbour_quality,
    op13_importance_resampling,
)

_QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_arrays,
    "op2_substring_dedup": op2_suffix_trees,
    "op3_line_frequency": op3_line_frequency,
    "op4_url_trees": op4_url_trees,
    "op5_anchor_pii": op5_anchor_pii,
    "op6_log_bilinear": op6_log_bilinear,
    "op7_mixing": op7_mixing,
    "op8_pigeonhole_decontamination": op8_pigeonhole,
    "op9_subword_toxicity": op9_subword_toxicity,
    "op10_setsketch_near_dedup": op10_setsketch,
    "op11_jacobi_whitening": op11_jacobi_whitening,
    "op12_neighbour_quality": op12_neighbour_quality,
    "op13_importance_resampling": op13_importance_resampling,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for name, module in _QUERIES.items()} | {"op3_line_frequency_removed": op3_line_frequency.op3_line_frequency_removed}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _QUERIES.items() if module.SQL} | {"op3_line_frequency_removed": op3_line_frequency.REMOVED_SQL}
