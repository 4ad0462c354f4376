"""Runs over time: regressions, ticks, comparisons, registry state, hashes, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regressions(runs: DataFrame, name: str, metric: str, threshold: float = 0.02) -> DataFrame:
    """name, metric, delta to the last run with a value, status (OK, REGRESSION, IMPROVED, NO_DATA). Runs are few: one row each."""
    before = Window.partitionBy(F.lit(0)).orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.select(F.col(name).alias("name"), F.col(metric).alias("metric"))
    rows = rows.withColumn("delta", F.col("metric") - F.last("metric", ignorenulls=True).over(before))
    status = F.when(F.col("metric").isNull(), "NO_DATA").when(F.col("delta") < -threshold, "REGRESSION").when(F.col("delta") > threshold, "IMPROVED").otherwise("OK")
    return rows.withColumn("status", status)


def history_summary(runs: DataFrame, name: str, metric: str) -> DataFrame:
    """One row: baseline (the first value), best, worst, runs."""
    return runs.agg(F.min_by(metric, F.when(F.col(metric).isNotNull(), F.col(name))).alias("baseline"), F.max(metric).alias("best"), F.min(metric).alias("worst"), F.count("*").alias("runs"))


def ticks(rows: DataFrame, monitor: str, tick: str, metric: str, threshold: float = 0.02, keep: int = 20) -> DataFrame:
    """The last ticks of each monitor: delta to the tick before even if that is null, and whether it is a regression."""
    order = Window.partitionBy(monitor).orderBy(tick)
    made = rows.select(F.col(monitor).alias("monitor"), F.col(tick).alias("tick"), F.col(metric).alias("metric"), (F.col(metric) - F.lag(metric).over(order)).alias("delta"), F.row_number().over(Window.partitionBy(monitor).orderBy(F.desc(tick))).alias("__at"))
    return made.where(F.col("__at") <= keep).select("monitor", "tick", "metric", "delta", F.coalesce(F.col("delta") < -threshold, F.lit(False)).alias("regression"))


def compare(metrics: DataFrame, run: str = "run", metric: str = "metric", value: str = "value") -> DataFrame:
    """run, metric, value, delta to the first run by name, best (whether no run has more)."""
    every = Window.partitionBy(metric)
    first = F.first(value).over(every.orderBy(run).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return metrics.select(F.col(run).alias("run"), F.col(metric).alias("metric"), F.col(value).alias("value"), (F.col(value) - first).alias("delta"), (F.col(value) == F.max(value).over(every)).alias("best"))


def differing(config: DataFrame, run: str = "run", key: str = "key", value: str = "value") -> DataFrame:
    """key, values (run=value, by run) of the keys whose values, as text, aren't the same in all runs."""
    runs = config.select(run).distinct()
    full = runs.crossJoin(F.broadcast(config.select(key).distinct())).join(config, [run, key], "left")
    text = F.coalesce(F.col(value).cast("string"), F.lit("null"))
    return full.groupBy(F.col(key).alias("key")).agg(F.count_distinct(text).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", run, text))), ", ").alias("values")).where("n > 1").drop("n")


def registry(events: DataFrame, model: str, version: str, stage: str, ts: str) -> DataFrame:
    """model, version, stage: the last stage of each version's events."""
    return events.groupBy(F.col(model).alias("model"), F.col(version).alias("version")).agg(F.max_by(stage, ts).alias("stage"))


def next_version(events: DataFrame, model: str, version: str) -> DataFrame:
    """model, next: one more than the largest number of the versions vN."""
    number = F.expr(f"try_cast(regexp_extract({version}, '^v([0-9]+)$', 1) as long)")
    return events.groupBy(F.col(model).alias("model")).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def verify(expected: DataFrame, actual: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """path, status: PASS, FAIL or MISSING."""
    seen = actual.select(path, F.col(digest).alias("__seen"))
    status = F.when(F.col("__seen").isNull(), "MISSING").when(F.col("__seen") == F.col(digest), "PASS").otherwise("FAIL")
    return expected.join(seen, path, "left").select(path, status.alias("status"))


def chain_hash(df: DataFrame, name: Column, value: Column) -> DataFrame:
    """chain_hash: SHA-256 of the sorted name=value parts joined by |; for a manifest's few rows."""
    return df.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", name, value))), "|"), 256).alias("chain_hash"))


def metric_of(json: Column, metric: str) -> Column:
    """A metric of an evaluation file's JSON: under overall, aggregate, or at the top."""
    return F.coalesce(*[F.get_json_object(json, p).try_cast("double") for p in (f"$.overall.{metric}", f"$.aggregate.{metric}", f"$.{metric}")])


def parents(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """The nodes from which an edge leads to node."""
    return nodes.join(edges.where(F.col("dst") == node).select(F.col("src").alias("id")), "id", "left_semi")


def children(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """The nodes to which an edge leads from node."""
    return nodes.join(edges.where(F.col("src") == node).select(F.col("dst").alias("id")), "id", "left_semi")


def mermaid(edges: DataFrame) -> DataFrame:
    """One row, text: the lineage as a Mermaid graph, edges in order; for a lineage's few rows."""
    line = F.concat(F.lit("    "), F.col("src"), F.lit(" -->|"), F.col("relation"), F.lit("| "), F.col("dst"))
    return edges.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))
