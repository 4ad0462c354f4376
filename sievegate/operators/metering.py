"""Usage, billing, budgets, rate limits and quotas over an event table.

Events have key, project, ts, and counters; names are given by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    """Monthly base in cents, included units, prices in cents, and the monthly cap of rows."""

    name: str
    base: int
    requests: int
    rows: int
    bytes: int
    per_1k_rows: int
    per_request: int
    per_mb: int
    per_decision: int
    cap: int


#: The plan catalogue.
PLANS = {
    p.name: p
    for p in (
        Plan("FREE", 0, 500, 100_000, 50_000_000, 0, 0, 0, 0, 50_000),
        Plan("STARTER", 9_900, 5_000, 1_000_000, 500_000_000, 5, 1, 2, 10, 1_000_000),
        Plan("PRO", 49_900, 50_000, 10_000_000, 5_000_000_000, 3, 0, 1, 5, 5_000_000),
        Plan("ENTERPRISE", 49_900, 1_000_000, 100_000_000, 50_000_000_000, 1, 0, 0, 2, 2**63 - 1),
    )
}
#: Budget units of the operations, and the rows and bytes of a unit.
UNITS = {"decisions": 5, "reports": 3, "contamination_checks": 2, "classify_jobs": 4, "retrains": 50, "monitor_ticks": 1}
UNIT_ROWS, UNIT_BYTES = 1000, 5 * 1024 * 1024


def usage(df: DataFrame, counters: dict[str, Column], keys: list[str]) -> DataFrame:
    """Sums of the counters and requests by keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("requests"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in counters.items()])


def usage_rollup(df: DataFrame, counters: dict[str, Column], key: str = "api_key_id", project: str = "project_id") -> DataFrame:
    """One pass for all four levels: by key and project, key, project, and in total; level names them."""
    made = df.select(key, project, *[c.alias(n) for n, c in counters.items()])
    sets = made.groupingSets([[key, project], [key], [project], []], key, project)
    level = F.when((F.grouping(key) == 0) & (F.grouping(project) == 0), "key_project").when(F.grouping(key) == 0, "key").when(F.grouping(project) == 0, "project").otherwise("total")
    return sets.agg(level.alias("level"), F.count("*").alias("requests"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counters])


def replay(log: DataFrame, counters: list[str], line: str = "value") -> DataFrame:
    """api_key_id, project_id, requests and the counters' sums from a log of JSON lines: ts, api_key_id, project_id, counters.

    A line that isn't an object counts nothing; a missing key is anonymous, a missing project default, a missing counter 0.
    """
    kind = "api_key_id string, project_id string, counters struct<" + ", ".join(f"`{c}`: bigint" for c in counters) + ">"
    rows = log.where(F.col(line).rlike(r"^\s*\{") & F.get_json_object(line, "$").isNotNull()).select(F.from_json(line, kind).alias("e"))
    named = rows.select(F.coalesce("e.api_key_id", F.lit("anonymous")).alias("api_key_id"), F.coalesce("e.project_id", F.lit("default")).alias("project_id"), "e.counters")
    return usage(named, {c: F.coalesce(F.col(f"counters.`{c}`"), F.lit(0)) for c in counters}, ["api_key_id", "project_id"])


def meter(steps: DataFrame, run: str, at: str) -> DataFrame:
    """A run's billable units, timings and result from one row a step, by run; of repeated steps units add up, and the last by at gives the timing and result.

    steps: step (contract, report, contamination, decision, total), elapsed_ms, rows_in, bytes_in (report), checked_rows,
    contamination (contamination), decision, exit_code (decision), contract_valid (contract).
    """
    own = lambda step, c: F.when(F.col("step") == step, F.col(c))
    added = lambda step, c: F.coalesce(F.sum(own(step, c)), F.lit(0))
    last = lambda step, c: F.max_by(F.col(c), own(step, at))
    number = lambda step: F.count(own(step, "step"))
    return steps.groupBy(run).agg(
        added("report", "rows_in").alias("rows_in"), added("contamination", "checked_rows").alias("rows_out"), added("report", "bytes_in").alias("bytes_in"),
        number("contamination").alias("contamination_checks"), number("report").alias("reports_generated"), number("decision").alias("decisions_generated"), number("contract").alias("contracts_validated"),
        *[last(s, "elapsed_ms").alias(f"{s}_ms") for s in ("contract", "report", "contamination", "decision", "total")],
        last("decision", "decision").alias("decision"), last("decision", "exit_code").alias("exit_code"), last("contamination", "contamination").alias("contamination"), last("contract", "contract_valid").alias("contract_valid"),
    )


def window(df: DataFrame, ts: str, now: Column, minutes: int) -> DataFrame:
    """The rows of the last so many minutes up to now."""
    return df.where((F.col(ts) >= now - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col(ts) <= now))


def month(df: DataFrame, ts: str, period: str) -> DataFrame:
    """The rows of a UTC month, given as YYYY-MM."""
    start = F.to_timestamp(F.lit(f"{period}-01 00:00:00"))
    return df.where((F.col(ts) >= start) & (F.col(ts) < F.add_months(start, 1)))


def invoice(totals: DataFrame, plan: Plan) -> DataFrame:
    """Lines of an invoice from one row of requests, rows, bytes, decisions: unit_type, quantity, included, overage, unit_price_cents, amount_cents."""
    q = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("requests", "rows", "bytes", "decisions")}
    included = {"requests": plan.requests, "rows": plan.rows, "bytes": plan.bytes, "decisions": 0}
    price = {"requests": (plan.per_request, 1), "rows": (plan.per_1k_rows, 1000), "bytes": (plan.per_mb, 1024 * 1024), "decisions": (plan.per_decision, 1)}
    lines = []
    for unit, (cents, block) in price.items():
        over = F.greatest(F.lit(0).cast("long"), q[unit] - included[unit])
        amount = F.floor((over + (block - 1)) / block).cast("long") * cents
        lines.append(F.struct(F.lit(unit).alias("unit_type"), q[unit].alias("quantity"), F.lit(included[unit]).cast("long").alias("included"), over.alias("overage"), F.lit(cents).cast("long").alias("unit_price_cents"), amount.alias("amount_cents")))
    return totals.select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def invoice_total(lines: DataFrame, plan: Plan) -> DataFrame:
    return lines.agg((F.sum("amount_cents") + plan.base).alias("total_cents"))


def invoice_id(project: Column, period: Column, plan: Column) -> Column:
    return F.concat(F.lit("inv-"), F.substring(F.sha2(F.concat_ws(":", project, period, plan), 256), 1, 16))


def api_key_id(key: Column, namespace: str = "usage") -> Column:
    """A key's public name: 12 digits of the SHA-256 of namespace and key."""
    return F.substring(F.sha2(F.concat(F.lit(f"{namespace}:"), key), 256), 1, 12)


def budget_units(counters: dict[str, Column]) -> Column:
    """Units of one row of counters; rows and bytes are rounded up each on its own."""
    parts = []
    for name, column in counters.items():
        if name in UNITS:
            parts.append(column * UNITS[name])
        else:
            parts.append(F.ceil(column / (UNIT_ROWS if name.startswith("rows") else UNIT_BYTES)))
    return sum(parts[1:], parts[0]).cast("long")


def budget_mode(daily: Column, monthly: Column, daily_limit: int, monthly_limit: int, hard: bool = True) -> Column:
    """BLOCK (WARN without hard) from a limit on, WARN from 80 % of one, else PASS."""
    over = (daily >= daily_limit) | (monthly >= monthly_limit)
    near = (daily >= daily_limit * 0.8) | (monthly >= monthly_limit * 0.8)
    return F.when(over, "BLOCK" if hard else "WARN").when(near, "WARN").otherwise("PASS")


def quota_mode(used: Column, adding: Column, plan: Plan) -> Column:
    """BLOCK if used and adding exceed the plan's cap, WARN from 80 % used, else PASS."""
    return F.when(used + adding > plan.cap, "BLOCK").when(used >= int(plan.cap * 0.8), "WARN").otherwise("PASS")


def rate_limit(df: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """key, window_start, requests, limited (requests beyond the limit) of fixed windows."""
    start = F.timestamp_seconds(F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds)
    return df.groupBy(key, start.alias("window_start")).agg(F.count("*").alias("requests")).withColumn("limited", F.greatest(F.col("requests") - limit, F.lit(0)).cast("long"))


def daily_quota(df: DataFrame, event: str, key: str, project: str, ts: str, rows: str, requests_per_day: int = 0, rows_per_day: int = 0) -> DataFrame:
    """event, key, project, day, accepted: requests in order of (ts, event), each checked against what was accepted before it.

    A request that would exceed the row limit is refused and doesn't count, so a smaller one after it may
    pass; that makes it a sequential scan of each key, project and day, run side by side for the groups. A limit of 0 is none.
    """
    src = df.select(F.col(event).alias("event"), F.col(key).alias("key"), F.col(project).alias("project"), F.to_date(ts).alias("day"), F.col(ts).alias("ts"), F.coalesce(F.col(rows), F.lit(0)).cast("long").alias("rows"))
    ordered = src.repartition("key", "project", "day").sortWithinPartitions("key", "project", "day", "ts", "event")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, total = None, 0, 0
        for part in parts:
            accepted = []
            for group, size in zip(zip(part["key"], part["project"], part["day"], strict=True), part["rows"], strict=True):
                if group != at:
                    at, n, total = group, 0, 0
                ok = not (requests_per_day > 0 and n >= requests_per_day) and not (rows_per_day > 0 and size > 0 and total + size > rows_per_day)
                if ok:
                    n, total = n + 1, total + size
                accepted.append(ok)
            yield part[["event", "key", "project", "day"]].assign(accepted=accepted)

    kinds = dict(src.dtypes)
    return ordered.mapInPandas(run, f"event {kinds['event']}, key {kinds['key']}, project {kinds['project']}, day date, accepted boolean")


def latency(df: DataFrame, by: str, order: list[str], value: str, last: int = 10_000) -> DataFrame:
    """by, n, p50, p95, p99 of the last so many samples: the value at min(int(n * p / 100), n - 1)."""
    from sievegate.operators.stats import order_stats

    newest = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    kept = df.withColumn("__at", F.row_number().over(newest)).where(F.col("__at") <= last)
    picks = {f"p{p}": f"least(floor(n * {p} / 100), n - 1)" for p in (50, 95, 99)}
    return order_stats(kept, F.col(value), picks, [by]).join(kept.groupBy(by).agg(F.count(value).alias("n")), by)


def error_rate(df: DataFrame, by: list[str], failed: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("requests"), F.count(F.when(failed, 1)).alias("errors")).withColumn("error_rate", F.col("errors") / F.col("requests"))
