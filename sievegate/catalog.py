"""The flagship query and every query of the engine itself, by name, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievegate.queries import ORACLE, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contamination gate: is the evaluation set in the training set?"""
    return QUERIES["contamination_gate"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
