"""The registered queries of the tracking operators, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchlake.plans import detection, flights, games, identities, reviews, rollups, scoring, tracking

Query = Callable[[SparkSession, str], DataFrame]


MODULES = (tracking, scoring, rollups, detection, games, reviews, flights, identities)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated statistics of every player of every game."""
    return tracking.QUERIES["player_consolidation"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
