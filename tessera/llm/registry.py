"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import media, mixing, neardup, packing, pii, repeats, sharding, toxicity, vectors, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_size_tiered_shards": sharding.op1_size_tiered_shards,
        "op2_segment_toxicity": toxicity.op2_segment_toxicity,
        "op3_subspace_pigeonhole": vectors.op3_subspace_pigeonhole,
        "op4_run_length_index": repeats.op4_run_length_index,
        "op5_pivotal_mixing": mixing.op5_pivotal_mixing,
        "op6_weighted_minhash": neardup.op6_weighted_minhash,
        "op7_information_sanitisation": pii.op7_information_sanitisation,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_lossless_webp": media.op9_lossless_webp,
        "op10_warc_index": warc.op10_warc_index,
    }


def oracle_sql() -> dict[str, str]:
    return {}
