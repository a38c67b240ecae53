"""The queries of this subpackage and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from pricewright.llm import chat, fingerprints, katz, mixing, negatives, neighbours, outliers, pii, quality, segmentations, simhash, token_counts, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_gumbel_pieces": segmentations.op2_gumbel_pieces,
        "op3_pii": pii.op3_pii,
        "op4_katz": katz.op4_katz,
        "op5_compression_quality": quality.op5_compression_quality,
        "op6_simhash": simhash.op6_simhash,
        "op7_pareto_mix": mixing.op7_pareto_mix,
        "op8_chat_format": chat.op8_chat_format,
        "op9_posting_lists": neighbours.op9_posting_lists,
        "op10_fingerprints": fingerprints.op10_fingerprints,
        "op11_robust_outliers": outliers.op11_robust_outliers,
        "op12_bit_sliced_negatives": negatives.op12_bit_sliced_negatives,
        "op13_jacobi_whitening": whitening.op13_jacobi_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_pareto_mix": mixing.OP7_SQL,
        "op8_chat_format": chat.OP8_SQL,
        "op12_bit_sliced_negatives": negatives.OP12_SQL,
    }
