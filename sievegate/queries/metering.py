"""Usage, billing, limits and history over events: a user is an API key, an event type a project, props.k the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.operators import history, metering, stats
from sievegate.queries.registry import query, table

_E = "e as (select user_id::varchar as api_key_id, event_type as project_id, (props->>'k')::bigint as rows_in, ts, event_id, value from events)"


def events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").cast("string").alias("api_key_id"), F.col("event_type").alias("project_id"), F.get_json_object("props", "$.k").cast("long").alias("rows_in"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def latest(rows):
    return rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("now"))))



def counters():
    return {"rows_in": F.col("rows_in"), "cents": F.floor(F.col("value") * 100).cast("long")}


_SUMS = "count(*) as requests, coalesce(sum(rows_in), 0)::bigint as rows_in, coalesce(sum(floor(value * 100)::bigint), 0)::bigint as cents"


@query("usage_by_key_project", f"with {_E} select api_key_id, project_id, {_SUMS} from e group by all")
def usage_by_key_project(spark, sf_dir):
    return metering.usage(events(spark, sf_dir), counters(), ["api_key_id", "project_id"])


@query("usage_by_key", f"with {_E} select api_key_id, {_SUMS} from e group by all")
def usage_by_key(spark, sf_dir):
    return metering.usage(events(spark, sf_dir), counters(), ["api_key_id"])


@query("usage_by_project", f"with {_E} select project_id, {_SUMS} from e group by all")
def usage_by_project(spark, sf_dir):
    return metering.usage(events(spark, sf_dir), counters(), ["project_id"])


@query("usage_total", f"with {_E} select {_SUMS} from e")
def usage_total(spark, sf_dir):
    return metering.usage(events(spark, sf_dir), counters(), [])


@query(
    "usage_grouping_sets",
    f"""with {_E} select api_key_id, project_id, case when grouping(api_key_id) = 0 and grouping(project_id) = 0 then 'key_project' when grouping(api_key_id) = 0 then 'key' when grouping(project_id) = 0 then 'project' else 'total' end as level, {_SUMS}
from e group by grouping sets ((api_key_id, project_id), (api_key_id), (project_id), ())""",
)
def usage_grouping_sets(spark, sf_dir):
    return metering.usage_rollup(events(spark, sf_dir), counters())


@query("usage_window", f"with {_E} select project_id, {_SUMS} from e where ts >= (select max(ts) from e) - interval 1440 minute group by all")
def usage_window(spark, sf_dir):
    rows = latest(events(spark, sf_dir))
    return metering.usage(metering.window(rows, "ts", F.col("now"), 24 * 60), counters(), ["project_id"])


@query("billing_month", f"with {_E} select project_id, {_SUMS} from e where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by all")
def billing_month(spark, sf_dir):
    return metering.usage(metering.month(events(spark, sf_dir), "ts", "2024-01"), counters(), ["project_id"])


@query("billing_day", f"with {_E} select ts::date as day, {_SUMS} from e group by all")
def billing_day(spark, sf_dir):
    return metering.usage(events(spark, sf_dir).withColumn("day", F.to_date("ts")), counters(), ["day"])


@query("billing_day_project", f"with {_E} select ts::date as day, project_id, {_SUMS} from e group by all")
def billing_day_project(spark, sf_dir):
    return metering.usage(events(spark, sf_dir).withColumn("day", F.to_date("ts")), counters(), ["day", "project_id"])


@query("billing_day_key", f"with {_E} select ts::date as day, api_key_id, {_SUMS} from e group by all")
def billing_day_key(spark, sf_dir):
    return metering.usage(events(spark, sf_dir).withColumn("day", F.to_date("ts")), counters(), ["day", "api_key_id"])


_PLAN = metering.PLANS["STARTER"]
_TOTALS = "t as (select count(*) as requests, sum(rows_in)::bigint * 100 as rows, sum(floor(value * 1000000)::bigint)::bigint as bytes, count(*) filter (where project_id = 'purchase') as decisions from e)"
_LINES = f"""lines as (
  select 'requests' as unit_type, requests as quantity, {_PLAN.requests}::bigint as included, greatest(0, requests - {_PLAN.requests}) as overage, {_PLAN.per_request}::bigint as unit_price_cents, greatest(0, requests - {_PLAN.requests}) * {_PLAN.per_request} as amount_cents from t
  union all select 'rows', rows, {_PLAN.rows}, greatest(0, rows - {_PLAN.rows}), {_PLAN.per_1k_rows}, (greatest(0, rows - {_PLAN.rows}) + 999) // 1000 * {_PLAN.per_1k_rows} from t
  union all select 'bytes', bytes, {_PLAN.bytes}, greatest(0, bytes - {_PLAN.bytes}), {_PLAN.per_mb}, (greatest(0, bytes - {_PLAN.bytes}) + 1048575) // 1048576 * {_PLAN.per_mb} from t
  union all select 'decisions', decisions, 0, decisions, {_PLAN.per_decision}, decisions * {_PLAN.per_decision} from t)"""


def totals(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.agg(F.count("*").alias("requests"), (F.sum("rows_in") * 100).alias("rows"), F.sum(F.floor(F.col("value") * 1000000)).alias("bytes"), F.count(F.when(F.col("project_id") == "purchase", 1)).alias("decisions"))


@query("invoice_lines", f"with {_E}, {_TOTALS}, {_LINES} select * from lines")
def invoice_lines(spark, sf_dir):
    return metering.invoice(totals(spark, sf_dir), _PLAN)


@query("invoice_total", f"with {_E}, {_TOTALS}, {_LINES} select (sum(amount_cents) + {_PLAN.base})::bigint as total_cents from lines")
def invoice_total(spark, sf_dir):
    return metering.invoice_total(metering.invoice(totals(spark, sf_dir), _PLAN), _PLAN)


@query("invoice_ids", f"with {_E} select distinct project_id, 'inv-' || substr(sha256(project_id || ':2024-01:STARTER'), 1, 16) as invoice_id from e")
def invoice_ids(spark, sf_dir):
    return events(spark, sf_dir).select("project_id").distinct().select("project_id", metering.invoice_id(F.col("project_id"), F.lit("2024-01"), F.lit("STARTER")).alias("invoice_id"))


@query("api_key_ids", f"with {_E} select distinct api_key_id, substr(sha256('usage:' || api_key_id), 1, 12) as public_id from e")
def api_key_ids(spark, sf_dir):
    return events(spark, sf_dir).select("api_key_id").distinct().select("api_key_id", metering.api_key_id(F.col("api_key_id")).alias("public_id"))


_UNITS = f"{_E}, u as (select api_key_id, (ceil(sum(rows_in) / 1000) + ceil(sum(floor(value * 1000000)::bigint) / 5242880) + 5 * count(*) filter (where project_id = 'purchase'))::bigint as units from e group by all)"


def units(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("api_key_id").agg(F.sum("rows_in").alias("rows_in"), F.sum(F.floor(F.col("value") * 1000000)).alias("bytes_in"), F.count(F.when(F.col("project_id") == "purchase", 1)).alias("decisions"))
    return rows.select("api_key_id", metering.budget_units({"rows_in": F.col("rows_in"), "bytes_in": F.col("bytes_in"), "decisions": F.col("decisions")}).alias("units"))


@query("budget_units", f"with {_UNITS} select * from u")
def budget_units(spark, sf_dir):
    return units(spark, sf_dir)


@query("budget_check", f"with {_UNITS} select api_key_id, case when units >= 900 then 'BLOCK' when units >= 720 then 'WARN' else 'PASS' end as mode from u")
def budget_check(spark, sf_dir):
    return units(spark, sf_dir).select("api_key_id", metering.budget_mode(F.col("units"), F.col("units"), 900, 100_000).alias("mode"))


@query("quota_check", f"with {_E} select api_key_id, case when sum(rows_in) * 10 + 1000 > 50000 then 'BLOCK' when sum(rows_in) * 10 >= 40000 then 'WARN' else 'PASS' end as mode from e group by all")
def quota_check(spark, sf_dir):
    used = events(spark, sf_dir).groupBy("api_key_id").agg((F.sum("rows_in") * 10).alias("used"))
    return used.select("api_key_id", metering.quota_mode(F.col("used"), F.lit(1000), metering.PLANS["FREE"]).alias("mode"))


@query("rate_limit_60s", f"with {_E} select project_id, to_timestamp(floor(epoch_us(ts) / 60000000) * 60)::timestamp as window_start, count(*) as requests, greatest(0, count(*) - 1)::bigint as limited from e group by 1, 2")
def rate_limit_60s(spark, sf_dir):
    return metering.rate_limit(events(spark, sf_dir), "project_id", "ts", 1)


@query(
    "daily_quota",
    f"""with recursive {_E}, o as (select event_id, api_key_id, project_id, ts::date as day, coalesce(rows_in, 0) as size, row_number() over (partition by api_key_id, project_id, ts::date order by ts, event_id) as i from e
), r as (select null::bigint as event_id, k.api_key_id, k.project_id, k.day, 0::bigint as i, 0::bigint as n, 0::bigint as total, false as ok from (select distinct api_key_id, project_id, day from o) k
  union all select o.event_id, r.api_key_id, r.project_id, r.day, o.i, r.n + q.ok::int, r.total + case when q.ok then o.size else 0 end, q.ok
  from r join o on r.api_key_id is not distinct from o.api_key_id and r.project_id is not distinct from o.project_id and r.day is not distinct from o.day and o.i = r.i + 1, lateral (select r.n < 3 and not (o.size > 0 and r.total + o.size > 120) as ok) q)
select event_id as event, api_key_id as key, project_id as project, day, ok as accepted from r where i > 0""",
)
def daily_quota(spark, sf_dir):
    return metering.daily_quota(events(spark, sf_dir), "event_id", "api_key_id", "project_id", "ts", "rows_in", requests_per_day=3, rows_per_day=120)


@query("latency_percentiles", f"with {_E}, k as (select * from e qualify row_number() over (partition by project_id order by ts desc, event_id desc) <= 10000), r as (select project_id, value, row_number() over (partition by project_id order by value) - 1 as i, count(*) over (partition by project_id) as n from k) select project_id, max(value) filter (where i = least(n * 50 // 100, n - 1)) as p50, max(value) filter (where i = least(n * 95 // 100, n - 1)) as p95, max(value) filter (where i = least(n * 99 // 100, n - 1)) as p99, count(*) as n from r group by project_id")
def latency_percentiles(spark, sf_dir):
    return metering.latency(events(spark, sf_dir), "project_id", ["ts", "event_id"], "value")


@query("error_rate", f"with {_E} select api_key_id, count(*) as requests, count(*) filter (where project_id = 'error') as errors, count(*) filter (where project_id = 'error') / count(*) as error_rate from e group by all")
def error_rate(spark, sf_dir):
    return metering.error_rate(events(spark, sf_dir), ["api_key_id"], F.col("project_id") == "error")


@query("recent_events", f"with {_E} select event_id, project_id, ts from e order by ts desc, event_id desc limit 50")
def recent_events(spark, sf_dir):
    return events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "project_id", "ts")


_DAYS = f"{_E}, d as (select ts::date::varchar as name, round(avg(value) filter (where project_id = 'purchase') / 100, 6) as metric from e group by 1)"


def days(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.groupBy(F.to_date("ts").cast("string").alias("name")).agg(F.round(F.avg(F.when(F.col("project_id") == "purchase", F.col("value"))) / 100, 6).alias("metric"))


@query(
    "history_regression",
    f"""with {_DAYS}, l as (select *, metric - last_value(metric ignore nulls) over (order by name rows between unbounded preceding and 1 preceding) as delta from d)
select name, metric, round(delta, 9) as delta, case when metric is null then 'NO_DATA' when delta < -0.02 then 'REGRESSION' when delta > 0.02 then 'IMPROVED' else 'OK' end as status from l""",
)
def history_regression(spark, sf_dir):
    return history.regressions(days(spark, sf_dir), "name", "metric").withColumn("delta", F.round("delta", 9))


@query("history_summary", f"with {_DAYS} select arg_min(metric, name) filter (where metric is not null) as baseline, max(metric) as best, min(metric) as worst, count(*) as runs from d")
def history_summary(spark, sf_dir):
    return history.history_summary(days(spark, sf_dir), "name", "metric")


_TICKS = f"{_E}, t as (select project_id as monitor, row_number() over (partition by project_id order by ts::date) as tick, avg(value) as metric from e group by project_id, ts::date)"


@query("rolling_ticks", f"with {_TICKS} select monitor, tick, round(metric, 9) as metric, round(delta, 9) as delta, coalesce(delta < -0.02, false) as regression from (select *, metric - lag(metric) over (partition by monitor order by tick) as delta, row_number() over (partition by monitor order by tick desc) as r from t) where r <= 20")
def rolling_ticks(spark, sf_dir):
    from pyspark.sql import Window

    by_day = events(spark, sf_dir).groupBy("project_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("metric"))
    numbered = by_day.withColumn("tick", F.row_number().over(Window.partitionBy("project_id").orderBy("day")).cast("long"))
    return history.ticks(numbered, "project_id", "tick", "metric").withColumns({"metric": F.round("metric", 9), "delta": F.round("delta", 9)})


@query(
    "compare_runs",
    f"""with {_E}, m as (select project_id as run, 'mean' as metric, avg(value) as value from e group by 1 union all select project_id, 'most', max(value) from e group by 1)
select run, metric, round(value, 9) as value, round(value - first_value(value) over (partition by metric order by run), 9) as delta, value = max(value) over (partition by metric) as best from m""",
)
def compare_runs(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy(F.col("project_id").alias("run")).agg(F.avg("value").alias("mean"), F.max("value").alias("most"))
    long = rows.select("run", F.explode(F.create_map(F.lit("mean"), "mean", F.lit("most"), "most")).alias("metric", "value"))
    return history.compare(long).withColumns({"value": F.round("value", 9), "delta": F.round("delta", 9)})


@query("differing_configs", "with c as (select n_regionkey::varchar as run, substr(n_name, 1, 1) as key, min(n_name) as value from nation group by 1, 2), f as (select run, key, coalesce(value, 'null') as v from (select distinct run from c) cross join (select distinct key from c) left join c using (run, key)) select key, string_agg(run || '=' || v, ', ' order by run || '=' || v) as \"values\" from f group by key having count(distinct v) > 1")
def differing_configs(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    config = nation.groupBy(F.col("n_regionkey").cast("string").alias("run"), F.substring("n_name", 1, 1).alias("key")).agg(F.min("n_name").alias("value"))
    return history.differing(config)


@query("registry_state", f"with {_E} select project_id as model, 'v' || (event_id % 7) as version, arg_max(case when value < 20 then 'staging' else 'production' end, event_id) as stage from e group by 1, 2")
def registry_state(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("project_id").alias("m"), F.concat(F.lit("v"), F.col("event_id") % 7).alias("v"), F.when(F.col("value") < 20, "staging").otherwise("production").alias("s"), "event_id")
    return history.registry(rows, "m", "v", "s", "event_id")


@query("next_version", f"with {_E} select project_id as model, max(event_id % 7)::bigint + 1 as next from e group by 1")
def next_version(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("project_id").alias("m"), F.concat(F.lit("v"), F.col("event_id") % 7).alias("v"))
    return history.next_version(rows, "m", "v")


@query("verify_hashes", "with e as (select doc_id::varchar as path, sha256(text) as h from documents), a as (select doc_id::varchar as path, case when doc_id % 7 = 0 then 'x' else sha256(text) end as h from documents where doc_id % 11 <> 0) select e.path, case when a.h is null then 'MISSING' when a.h = e.h then 'PASS' else 'FAIL' end as status from e left join a using (path)")
def verify_hashes(spark, sf_dir):
    expected = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    actual = expected.where("doc_id % 11 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return history.verify(expected, actual)


@query("chain_hash", "select sha256(string_agg(n_name || '=' || n_regionkey, '|' order by n_name || '=' || n_regionkey)) as chain_hash from nation")
def chain_hash(spark, sf_dir):
    return history.chain_hash(table(spark, sf_dir, "nation"), F.col("n_name"), F.col("n_regionkey").cast("string"))


_EDGES = "edges as (select 'nation:' || n_name as src, 'region:' || r_name as dst, 'in' as relation from nation join region on n_regionkey = r_regionkey)"


def edges(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.concat(F.lit("nation:"), "n_name").alias("src"), F.concat(F.lit("region:"), "r_name").alias("dst"), F.lit("in").alias("relation"))


@query("lineage_parents", f"with {_EDGES} select src as id from edges where dst = 'region:ASIA'")
def lineage_parents(spark, sf_dir):
    links = edges(spark, sf_dir)
    return history.parents(links, links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct(), "region:ASIA")


@query("lineage_children", f"with {_EDGES} select distinct dst as id from edges where src = (select min(src) from edges)")
def lineage_children(spark, sf_dir):
    links = edges(spark, sf_dir)
    return history.children(links, links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct(), links.agg(F.min("src")).first()[0])


@query("lineage_mermaid", f"with {_EDGES} select 'graph LR' || chr(10) || string_agg('    ' || src || ' -->|' || relation || '| ' || dst, chr(10) order by '    ' || src || ' -->|' || relation || '| ' || dst) as text from edges")
def lineage_mermaid(spark, sf_dir):
    return history.mermaid(edges(spark, sf_dir))


@query("order_price_percentiles", "with r as (select o_orderpriority, o_totalprice as v, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as i, count(*) over (partition by o_orderpriority) as n from orders) select o_orderpriority, min(v) as least, max(v) filter (where i = n // 2) as middle, max(v) filter (where i = least(n * 95 // 100, n - 1)) as p95, max(v) as most from r group by 1")
def order_price_percentiles(spark, sf_dir):
    return stats.order_stats(table(spark, sf_dir, "orders"), F.col("o_totalprice"), {"least": "0", "middle": "floor(n / 2)", "p95": "least(floor(n * 95 / 100), n - 1)", "most": "n - 1"}, ["o_orderpriority"])


@query("stream_tumbling", f"with {_E} select project_id, to_timestamp(floor(epoch_us(ts) / 3600000000) * 3600)::timestamp as window_start, count(*) as requests, greatest(0, count(*) - 5)::bigint as limited from e group by 1, 2")
def stream_tumbling(spark, sf_dir):
    """The hourly rate limit computed by a stream that reads the table once."""
    from sievegate.sources.sinks import new_path
    from sievegate.streaming import windows

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("event_type").alias("project_id"), F.col("ts").cast("timestamp").alias("ts"))
    counted = windows.rate_limit(rows, "project_id", "ts", 5, 3600)
    out, state = new_path(spark), new_path(spark)
    save = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    counted.writeStream.foreachBatch(save).outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
