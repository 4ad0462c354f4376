"""Datasets and their manifests as files, all written by Spark."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegate.operators.records import category


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where it is unset, a folder of our own if there is one machine only, as in tests; else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(spark, "_sievegate_dir", None)
        if not where:
            where = spark._sievegate_dir = "file://" + tempfile.mkdtemp(prefix="sievegate-")
    return where


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sievegate_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._sievegate_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have ended. Its cleaner does so only once the driver's JVM has collected them, which a driver with memory to spare may never do."""
    spark.sparkContext._jvm.System.gc()


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """One object a line; single gives one file, for small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], single: bool = False, sep: str = ",") -> None:
    """With a header; quotes are doubled and spaces kept, as read_csv takes them."""
    out = df.select(*columns)
    writer = (out.coalesce(1) if single else out).write.mode("overwrite")
    writer.csv(path, header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def bucketed(df: DataFrame, least: int = 1, schema: str = "unknown") -> DataFrame:
    """df with one more column, bucket (schema and category, with other characters as _), of the buckets with least rows or more."""
    name = F.concat_ws("__", F.lit(schema), category(df))
    named = df.withColumn("bucket", F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"))
    big = named.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("bucket")
    return named.join(F.broadcast(big) if least > 1 and big.limit(10_001).count() <= 10_000 else big, "bucket", "left_semi")


def write_buckets(df: DataFrame, path: str, least: int = 1, schema: str = "unknown") -> None:
    """One folder of JSON lines for each bucket."""
    bucketed(df, least, schema).write.mode("overwrite").partitionBy("bucket").json(path)


def write_artifact(df: DataFrame, path: str, report: DataFrame) -> DataFrame:
    """dataset, report and manifest under a folder; returns the manifest (path, length, sha256)."""
    spark = df.sparkSession
    write_jsonl(df, f"{path}/dataset.jsonl")
    write_jsonl(report, f"{path}/report.json", single=True)
    from sievegate.sources.readers import file_hashes

    files = file_hashes(spark, f"{path}/dataset.jsonl/*.json").unionByName(file_hashes(spark, f"{path}/report.json/*.json"))
    write_jsonl(files, f"{path}/hashes.json", single=True)
    return spark.read.schema(files.schema).json(f"{path}/hashes.json")


def write_transform(df: DataFrame, path: str, transform: str, config: dict[str, object], tags: list[str]) -> DataFrame:
    """A transform's dataset, frozen config, meta and hashes under a folder; returns the meta's row.

    meta: transform, rows, row_schema (name: type, by name), tag_distribution (JSON: tag, value, n, in order), config_sha256 and chain_hash over the
    dataset's and the config's files. tags should have few values each, as their counts are one cell.
    """
    from sievegate.operators.history import chain_hash
    from sievegate.operators.stats import tag_distribution
    from sievegate.sources.readers import file_hashes

    spark = df.sparkSession
    frozen = json.dumps(config, sort_keys=True)
    write_jsonl(df, f"{path}/dataset.jsonl")
    spark.createDataFrame([(frozen,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/transform_config.json")
    files = file_hashes(spark, f"{path}/dataset.jsonl/*.json").unionByName(file_hashes(spark, f"{path}/transform_config.json/*.txt"))
    write_jsonl(files, f"{path}/hashes.json", single=True)
    files = spark.read.schema(files.schema).json(f"{path}/hashes.json")
    # names follow the files' order, for Spark draws the files' own anew for each run
    chain = chain_hash(files, F.element_at(F.split("path", "/"), -2), F.col("sha256"))
    rows = spark.read.schema(df.schema).json(f"{path}/dataset.jsonl")
    counts = tag_distribution(rows, tags).agg(F.to_json(F.array_sort(F.collect_list(F.struct("tag", "value", "n")))).alias("tag_distribution"))
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in sorted(df.schema, key=lambda f: f.name))
    fixed = [F.lit(v).alias(n) for n, v in (("transform", transform), ("row_schema", kinds), ("config_sha256", hashlib.sha256(frozen.encode()).hexdigest()))]
    meta = rows.agg(F.count("*").alias("rows")).crossJoin(counts).crossJoin(chain).select("rows", "tag_distribution", "chain_hash", *fixed)
    write_jsonl(meta, f"{path}/transform_meta.json", single=True)
    return spark.read.schema(meta.schema).json(f"{path}/transform_meta.json")


def append_events(df: DataFrame, path: str) -> None:
    """Events after those that a log has already; a replay is a re-aggregation of the log."""
    df.write.mode("append").json(path)
