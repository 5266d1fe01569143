"""Queries of this subpackage and their SQL, for the entry module to add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rangeflow.llm import fingerprints, languages, media, mixing, quality, sentencepieces, sharding, simhash, substrings, templates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.query,
    "op2_sentencepieces": sentencepieces.query,
    "op3_line_templates": templates.query,
    "op4_mixing": mixing.query,
    "op5_substrings": substrings.query,
    "op6_simhash": simhash.query,
    "op7_media_columns": media.query,
    "op8_languages": languages.query,
    "op9_sharding": sharding.query,
    "op10_quality": quality.query,
}

ORACLES: dict[str, str] = {
    "op3_line_templates": templates.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_substrings": substrings.ORACLE_SQL,
}
