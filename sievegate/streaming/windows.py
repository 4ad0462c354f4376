"""The time-window operators over streams. Each has a batch twin in operators.metering; tests hold them to it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events later than this are dropped; the batch twins know no lateness.
LATE = "10 minutes"


def tumbling(events: DataFrame, key: str, ts: str, seconds: int = 60, late: str = LATE) -> DataFrame:
    """key, window_start, requests by event time."""
    counted = events.withWatermark(ts, late).groupBy(key, F.window(ts, f"{seconds} seconds")).agg(F.count("*").alias("requests"))
    return counted.select(key, F.col("window.start").alias("window_start"), "requests")


def rate_limit(events: DataFrame, key: str, ts: str, limit: int, seconds: int = 60, late: str = LATE) -> DataFrame:
    """As tumbling, with the requests beyond the limit."""
    return tumbling(events, key, ts, seconds, late).withColumn("limited", F.greatest(F.col("requests") - limit, F.lit(0)).cast("long"))


def sliding(events: DataFrame, keys: list[str], ts: str, minutes: int, slide: int, late: str = LATE) -> DataFrame:
    """keys, window_start, window_end, requests of the last so many minutes, every slide minutes."""
    counted = events.withWatermark(ts, late).groupBy(*keys, F.window(ts, f"{minutes} minutes", f"{slide} minutes")).agg(F.count("*").alias("requests"))
    return counted.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests")


def daily_quota(events: DataFrame, event: str, key: str, project: str, ts: str, rows: str, requests_per_day: int = 0, rows_per_day: int = 0, late: str = "1 day") -> DataFrame:
    """event, key, project, day, accepted: each micro-batch's requests in order of (ts, event) against what the day's group has accepted.

    A refused request doesn't count. State is two numbers a group; it goes when the watermark has passed the day.
    """
    src = events.select(F.col(event).alias("event"), F.col(key).alias("key"), F.col(project).alias("project"), F.to_date(ts).alias("day"), F.col(ts).alias("ts"), F.coalesce(F.col(rows), F.lit(0)).cast("long").alias("rows"))
    kinds = dict(src.dtypes)

    def run(group, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0)
        part = pd.concat(list(parts)).sort_values(["ts", "event"])
        accepted = []
        for size in part["rows"]:
            ok = not (requests_per_day > 0 and n >= requests_per_day) and not (rows_per_day > 0 and size > 0 and total + size > rows_per_day)
            if ok:
                n, total = n + 1, total + int(size)
            accepted.append(ok)
        state.update((n, total))
        state.setTimeoutTimestamp(int((pd.Timestamp(group[2]) + pd.Timedelta(days=2)).timestamp() * 1000))
        yield part[["event", "key", "project", "day"]].assign(accepted=accepted)

    return src.withWatermark("ts", late).groupBy("key", "project", "day").applyInPandasWithState(run, f"event {kinds['event']}, key {kinds['key']}, project {kinds['project']}, day date, accepted boolean", "n long, total long", "append", "EventTimeTimeout")


def monitor(events: DataFrame, path: str, check, keep: int = 20, threshold: float = 0.02, checkpoint: str | None = None, **trigger):
    """Starts a query that runs check (a DataFrame to one row with a metric) on each micro-batch and adds the tick to the table at path.

    delta is to the tick before, even if that has none; the table keeps all ticks, history.ticks the last of them.
    """

    def tick(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        row = check(batch).first()
        value = None if row is None else row["metric"]
        try:
            before = spark.read.schema("tick long, metric double, delta double, regression boolean").json(path).where(F.col("tick") == number - 1).first()
        except Exception as e:  # the first tick has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = None
        delta = None if before is None or before["metric"] is None or value is None else value - before["metric"]
        made = spark.createDataFrame([(number, value, delta, delta is not None and delta < -threshold)], "tick long, metric double, delta double, regression boolean")
        made.coalesce(1).write.mode("append").json(path)

    writer = events.writeStream.foreachBatch(tick)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(**trigger) if trigger else writer).start()
