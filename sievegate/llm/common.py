"""What several operators share: checked columns and tables written to the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.sources.sinks import forget, shared_dir, swept, written  # noqa: F401


#: Bytes of input for each partition of a shuffle whose tasks hold what they read; more partitions than are set are used where the input needs them.
PART = 64 << 20
#: Bytes of a table that is broadcast at most.
BROADCAST = 32 << 20


def written_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As written, in so many buckets of key; later joins on key leave its rows in place where there are as many shuffle partitions."""
    spark = df.sparkSession
    name = f"sievegate_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # of the catalogue only: the table is external
    out._sievegate_path = path
    return out


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker gives the memory that it doesn't use back: Spark keeps workers for later tasks."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # of glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return mapped


def side(table: DataFrame, row: int) -> DataFrame:
    """A written table of row bytes a row as the smaller side of a join: broadcast if it is small enough, else merged, whatever Spark estimates."""
    return F.broadcast(table) if table.count() * row <= BROADCAST else table.hint("merge")


def partitions(spark: SparkSession, size: int = 0) -> int:
    """spark.sql.shuffle.partitions, or as many as size bytes of input need."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row, however often then uses it and whatever the optimizer inlines."""
    return F.transform(F.array(value), then)[0]
