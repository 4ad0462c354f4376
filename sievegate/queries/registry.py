from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("doc_id % 5 <> 0")


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation set: a fifth of the documents by id. It is the queries' second dataset, not a sample of the first."""
    return documents(spark, sf_dir).where("doc_id % 5 = 0")


#: Lower-cased white-space tokens and their trigram sets, in DuckDB.
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
STRIPPED = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


def grams(words: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i : i + {n - 1}], ' ')))"
