"""The subpackage's queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timeweave.llm import blocks, gifs, mixing, packing, quality, rules, secrets, simhash, substrings, tokenids


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.query,
        "op2_best_fit_packing": packing.query,
        "op3_html_extraction": blocks.query,
        "op4_token_ids": tokenids.query,
        "op5_simhash_near_dedup": simhash.query,
        "op6_quality_classifier": quality.query,
        "op7_substring_dedup": substrings.query,
        "op8_quality_rules": rules.query,
        "op9_gif_frames": gifs.query,
        "op10_source_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_substring_dedup": substrings.SQL, "op10_source_mixing": mixing.SQL}
