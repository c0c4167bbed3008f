"""All registered queries of the library: (spark, sf_dir) -> DataFrame, and the SQL that states each anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timbral.plans import audio_queries, evaluation_queries, library_queries, ranking_queries, record_queries, state_queries

REGISTERED = audio_queries.QUERIES | ranking_queries.QUERIES | library_queries.QUERIES | evaluation_queries.QUERIES | state_queries.QUERIES | record_queries.QUERIES

#: The queries that bench.py times, one or two for each kind of plan. The last is a queue's drain: its files a second compare with published ones.
HEADLINES = (
    "R14_J9_L2_flagship_recommend",
    "J1_pivot_features",
    "F1_F6_admission",
    "G8_G9_fit_normalization",
    "R6_R10_J11_hybrid",
    "F16_F17_J2_analysis_states",
    "D7_upsert",
    "G13_J13_W12_query_metrics",
    "G12_G19_latency_percentiles",
    "X19_retention",
    "A15_A16_tone_library",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
