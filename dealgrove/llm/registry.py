"""The registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dealgrove.llm import (
    byte_bpe,
    licenses,
    masks,
    materialise,
    maxscore,
    minhash,
    negatives,
    packing,
    quality,
    sharding,
    suffixes,
    toxicity,
    windows,
)

QUERIES = {
    "op1_near_dedup": minhash,
    "op2_byte_bpe": byte_bpe,
    "op3_quality_rules": quality,
    "op4_training_order": materialise,
    "op5_maxscore": maxscore,
    "op6_sharding": sharding,
    "op7_suffix_dedup": suffixes,
    "op8_toxicity": toxicity,
    "op9_license_scan": licenses,
    "op10_best_fit_packing": packing,
    "op11_hard_negatives": negatives,
    "op12_presence_masks": masks,
    "op13_sum_of_squares_packing": windows,
}


def jobs() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: module.ORACLE for name, module in QUERIES.items() if hasattr(module, "ORACLE")}
