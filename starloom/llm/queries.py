"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, licenses, linededup, media, mixing, outliers, quality, secrets, simhash, tokenfiles


def queries():
    return {
        "op1_quality_rules": outliers.op1_quality_rules,
        "op2_mix": mixing.op2_mix,
        "op3_tokens": tokenfiles.op3_tokens,
        "op4_quality": quality.op4_quality,
        "op5_bpe": bpe.op5_bpe,
        "op6_media": media.op6_media,
        "op7_secrets": secrets.op7_secrets,
        "op8_line_dedup": linededup.op8_line_dedup,
        "op9_simhash": simhash.op9_simhash,
        "op10_licenses": licenses.op10_licenses,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    """Those that SQL can express; of the others, tests compare results with brute-force versions."""
    return {"op1_quality_rules": outliers.ORACLE_SQL, "op2_mix": mixing.ORACLE_SQL, "op10_licenses": licenses.ORACLE_SQL}
