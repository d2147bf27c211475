"""Queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base_columns, decontamination, fingerprints, language_id, licenses, lm_scoring, mixing, near_duplicates, token_counts, token_output, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_token_output": token_output.op3_token_output,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_jaccard_join": near_duplicates.op5_jaccard_join,
        "op6_lm_scoring": lm_scoring.op6_lm_scoring,
        "op7_language_id": language_id.op7_language_id,
        "op8_mixing": mixing.op8_mixing,
        "op9_warc": warc.op9_warc,
        "op10_token_counts": token_counts.op10_token_counts,
    } | base_columns.queries()


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.OP8_SQL, "op9_warc": warc.OP9_SQL} | base_columns.oracle_sql()
