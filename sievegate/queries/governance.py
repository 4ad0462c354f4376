"""Runs and their artifacts: integrity, registration, promotion, readiness; classification of rows; normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions import patterns
from sievegate.functions.text import normalise
from sievegate.operators import decision, evaluation, governance, history, records, topics
from sievegate.queries.profile import secret_audit
from sievegate.queries.records import _CHAT
from sievegate.queries.registry import ORACLE, documents, query, table
from sievegate.queries.scoring import _CASES, _CRITERIA, _HEALTH, _RISK, _T, cases, pairs


def _runs(spark, sf_dir):
    """Files of runs made from orders: a run an order, files by its key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    files = F.array(
        F.struct(F.lit("manifest.json").alias("name"), F.when(F.col("k") % 23 == 0, 0).otherwise(10).alias("size"), F.lit(100.0).alias("modified"), F.lit("m").alias("expected"), F.when(F.col("k") % 17 == 0, "x").otherwise("m").alias("actual")),
        F.when(F.col("k") % 13 != 0, F.struct(F.lit("decision.json").alias("name"), F.lit(10).alias("size"), F.when(F.col("k") % 11 == 0, 98.0).otherwise(99.5).alias("modified"), F.lit(None).cast("string").alias("expected"), F.lit("d").alias("actual"))),
        F.when(F.col("k") % 7 == 0, F.struct(F.lit("notes.txt").alias("name"), F.lit(1).alias("size"), F.lit(1.0).alias("modified"), F.lit(None).cast("string").alias("expected"), F.lit("n").alias("actual"))),
    )
    return o.select(F.col("k").alias("run"), F.explode(files).alias("f")).where("f is not null").select("run", "f.*")


@query(
    "integrity",
    """with r as (select o_orderkey as k, o_orderkey % 13 = 0 as lacks, o_orderkey % 17 = 0 as differs, o_orderkey % 7 = 0 as odd, o_orderkey % 23 = 0 as hollow, o_orderkey % 11 = 0 and o_orderkey % 13 <> 0 as late from orders)
select k as run, case when lacks then 'INCOMPLETE' when differs then 'TAMPERED' else 'VERIFIED' end as status,
  array_to_string(list_filter([case when late then 'MTIME_ANOMALY' end, case when lacks then 'FILES_MISSING' end, case when odd then 'UNEXPECTED_FILES' end, case when hollow then 'SIZE_ANOMALY' end, case when differs and not lacks then 'HASH_MISMATCH' end], lambda x: x is not null), ',') as indicators,
  case when differs and not lacks then 'HIGH' when late or lacks then 'MEDIUM' else 'LOW' end as confidence from r""",
)
def integrity(spark, sf_dir):
    return governance.integrity(_runs(spark, sf_dir)).select("run", "status", F.array_join("indicators", ",").alias("indicators"), "confidence")


@query("unexpected_files", "select o_orderkey as run, 'notes.txt' as name from orders where o_orderkey % 7 = 0")
def unexpected_files(spark, sf_dir):
    return governance.unexpected(_runs(spark, sf_dir))


@query(
    "registration_gate",
    f"""with {_CASES} select id, array_to_string(list_filter([case when recommendation <> 'SHIP' then 'decision' end, case when not contract_valid then 'contract' end, case when contamination = 'FAIL' then 'contamination' end], lambda x: x is not null), ',') as refused from d""",
)
def registration_gate(spark, sf_dir):
    made = cases(spark, sf_dir).withColumn("recommendation", decision.decide(_CRITERIA)["recommendation"])
    return made.select("id", F.array_join(governance.registration(), ",").alias("refused"))


@query(
    "promotion_gate",
    f"""with {_CASES}, s as (select id, round({_RISK}, 6) as r, round({_HEALTH}, 6) as h, recommendation as rec, ['none', 'staging', 'production', 'archived'][id % 4 + 1] as stage, ['staging', 'production', 'archived'][id % 3 + 1] as target from d)
select id, case when (stage || '>' || target) not in ('none>staging', 'staging>production', 'staging>archived', 'production>archived') then 'transition' when target = 'production' then
  array_to_string(list_filter([case when h < 60 then 'health' end, case when r > 50 then 'risk' end, case when rec <> 'SHIP' then 'decision' end], lambda x: x is not null), ',') else '' end as refused from s""",
)
def promotion_gate(spark, sf_dir):
    made = cases(spark, sf_dir).withColumn("d", decision.decide(_CRITERIA))
    made = made.withColumns({"recommendation": F.col("d.recommendation"), "confidence": F.col("d.confidence")})
    made = made.withColumns({"risk": F.round(decision.risk(), 6), "health": F.round(decision.health(), 6)})
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % n + 1).cast("int"))
    made = made.withColumns({"stage": pick(governance.NEXT_STAGE, 4), "target": pick(("staging", "production", "archived"), 3)})
    return made.select("id", F.array_join(governance.promotion(), ",").alias("refused"))


@query(
    "promotions",
    """with recursive e as (select o_custkey as c, ['staging', 'production', 'archived'][o_orderkey % 3 + 1] as target, (o_orderkey % 100)::double as h, (o_orderkey % 90)::double as r, case when o_orderkey % 5 = 0 then 'NO' else 'SHIP' end as rec, row_number() over (partition by o_custkey order by o_orderkey) as i from orders
), f as (select c, 0::bigint as i, 'none' as stage, 0::bigint as refused from (select distinct c from e)
  union all select f.c, e.i, case when ok then e.target else f.stage end, f.refused + (not ok)::int
  from f join (select * from e) e on e.c = f.c and e.i = f.i + 1, lateral (select (f.stage || '>' || e.target) in ('none>staging', 'staging>production', 'staging>archived', 'production>archived') and (e.target <> 'production' or (h >= 60 and r <= 50 and rec = 'SHIP')) as ok))
select c as model, 'v1' as version, arg_max(stage, i) as stage, max(refused) as refused from f group by c""",
)
def promotions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    events = o.select(
        F.col("o_custkey").alias("model"), F.lit("v1").alias("version"), k.alias("ts"), F.element_at(F.array(*map(F.lit, ("staging", "production", "archived"))), (k % 3 + 1).cast("int")).alias("target"),
        (k % 100).cast("double").alias("health"), (k % 90).cast("double").alias("risk"), F.when(k % 5 == 0, "NO").otherwise("SHIP").alias("recommendation"),
    )
    return governance.promote(events)


_RUN_JSON = """r as (select c_custkey as id, c_custkey % 8 <> 0 as manifest, c_custkey % 9 <> 0 as decision, ['VERIFIED', 'TAMPERED', 'INCOMPLETE'][c_custkey % 3 + 1] as chain, case c_custkey % 4 when 0 then 'PASS' when 1 then 'FAIL' when 2 then 'WARN' end as audit from customer
), s as (select id, [case when decision and manifest and id % 6 <> 0 then 'PASS' else 'FAIL' end, case chain when 'VERIFIED' then 'PASS' when 'TAMPERED' then 'FAIL' else 'WARN' end, case when audit in ('PASS', 'FAIL') then audit else 'WARN' end,
  case when not decision then 'WARN' when id % 5 = 0 then 'FAIL' when id % 7 = 0 then 'WARN' else 'PASS' end, case when not decision or id % 10 = 3 or id % 11 = 0 then 'WARN' else 'PASS' end,
  case when not manifest or id % 12 < 2 then 'WARN' else 'PASS' end, case when id % 2 = 0 and id % 3 <> 0 then 'PASS' else 'WARN' end] as c from r)"""


@query("readiness_checks", f"with {_RUN_JSON} select id, array_to_string(c, ',') as checks, case when list_contains(c, 'FAIL') then 'FAIL' when list_contains(c, 'WARN') then 'WARN' else 'PASS' end as status from s")
def readiness_checks(spark, sf_dir):
    k = F.col("id")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    manifest = F.to_json(F.struct(F.when(k % 6 != 0, k.cast("string")).alias("run_id"), F.array(F.struct(F.when(k % 12 == 0, 5).otherwise(50).alias("min_row_count"), F.when(k % 12 == 1, 0.9).alias("max_null_ratio"))).alias("contracts")))
    checks = F.struct(F.when(k % 5 == 0, "FAILED").otherwise("PASS").alias("Contamination_scan"), F.struct((k % 11 == 0).alias("regression_detected")).alias("metrics"))
    made = F.to_json(F.struct(checks.alias("checks"), F.when(k % 7 == 0, "FAIL").otherwise("PASS").alias("status"), F.struct(F.array(F.when(k % 10 == 3, "a Regression of f1").otherwise("none")).alias("warnings")).alias("summary")))
    rows = c.select(
        "id", F.when(k % 8 != 0, manifest).alias("manifest"), F.when(k % 9 != 0, made).alias("decision"), F.element_at(F.array(*map(F.lit, ("VERIFIED", "TAMPERED", "INCOMPLETE"))), (k % 3 + 1).cast("int")).alias("chain"),
        F.to_json(F.struct(F.when(k % 4 == 0, "PASS").when(k % 4 == 1, "FAIL").when(k % 4 == 2, "WARN").alias("status"))).alias("audit"), F.to_json(F.struct(F.when(k % 2 == 0, 7).alias("seed"), F.when(k % 3 != 0, "x").alias("versions"))).alias("environment"),
    )
    found = rows.select("id", governance.readiness_checks().alias("c")).select("id", F.transform("c", lambda x: x["status"]).alias("s"))
    return found.select("id", F.array_join("s", ",").alias("checks"), decision.worst(F.col("s")).alias("status"))


@query("audit_status", f"with a as ({ORACLE['secret_audit']}) select coalesce(sum(hits) filter (where severity = 'HIGH'), 0)::bigint as high, coalesce(sum(hits) filter (where severity = 'MEDIUM'), 0)::bigint as medium, coalesce(sum(hits) filter (where severity = 'LOW'), 0)::bigint as low, case when high > 0 then 'FAIL' when medium > 0 then 'WARN' else 'PASS' end as status from a")
def audit_status(spark, sf_dir):
    return governance.audit_status(secret_audit(spark, sf_dir))


@query("schema_votes", "select case when text is not null and quality is not null then 'classification' else 'unknown' end as schema, count(*) as rows from documents left join labels using (doc_id) group by 1")
def schema_votes(spark, sf_dir):
    joined = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").select("text", F.col("quality").alias("label"))
    return records.votes(joined)


_EMAIL, _PHONE = patterns.PII["email"][0], patterns.PII["phone"][0]


@query(
    "classify_report",
    f"""with x as (select text, quality as label from documents left join labels using (doc_id)
), n as (select count(*) as rows, count(*) filter (where regexp_matches(coalesce(text, ''), '{_EMAIL}')) as email_rows, count(*) filter (where regexp_matches(coalesce(text, ''), '{_PHONE}')) as phone_rows,
  count(*) filter (where regexp_matches(coalesce(text, ''), '{_EMAIL}') or regexp_matches(coalesce(text, ''), '{_PHONE}')) as pii_rows, count(*) filter (where text is not null and label is not null) as cls from x
), c as (select sum(c - 1) as copies from (select count(*) as c from x group by text, label))
select rows, case when cls * 2 >= rows then 'classification' else 'unknown' end as schema, round(copies / rows, 4) as duplicate_rate, email_rows, phone_rows, pii_rows,
  array_to_string(list_filter([case when cls * 2 < rows then 'unknown_schema' end, case when round(copies / rows, 4) > 0.05 then 'duplicates' end, case when pii_rows > 0 then 'pii' end, case when cls not in (0, rows) then 'mixed_schemas' end], lambda w: w is not null), ',') as warnings from n, c""",
)
def classify_report(spark, sf_dir):
    joined = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").select("text", F.col("quality").alias("label"))
    return records.classified(joined, F.col("text"), _EMAIL, _PHONE).select("rows", "schema", "duplicate_rate", "email_rows", "phone_rows", "pii_rows", F.array_join("warnings", ",").alias("warnings"))


_SPACES = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"
_SQUAD = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w not in ('', 'a', 'an', 'the')), ' ')"


@query("normalise_spaces", f"select doc_id, sha256({_SPACES}) as h from documents")
def normalise_spaces(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(normalise(F.col("text"), "spaces"), 256).alias("h"))


@query("normalise_squad", f"{_CHAT} select conv_id, pair, {_SQUAD.format('assistant')} as said from pairs")
def normalise_squad(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "pair", normalise(F.col("assistant"), "squad").alias("said"))


@query(
    "token_f1_sets",
    f"""{_CHAT}, q as (select conv_id, pair, {_T.format(_SQUAD.format('"user"'))} as p, {_T.format(_SQUAD.format("assistant"))} as r from pairs), m as (select *, len(list_intersect(p, r)) as m from q)
select conv_id, pair, round(case when len(p) = 0 or len(r) = 0 then (len(p) = len(r))::int when m = 0 then 0 else 2 * (m / len(p)) * (m / len(r)) / (m / len(p) + m / len(r)) end, 9) as f1 from m""",
)
def token_f1_sets(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "pair", F.round(evaluation.token_f1_sets(F.col("user"), F.col("assistant")), 9).alias("f1"))


@query("metric_of", """select event_id, case event_id % 3 when 0 then value when 1 then value + 1 else null end as f1 from events""")
def metric_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.struct(F.col("value").alias("f1")).alias("overall")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct((F.col("value") + 1).alias("f1")))).otherwise("{}")
    return e.select("event_id", history.metric_of(body, "f1").alias("f1"))


@query("judged_score", "select doc_id, floor((doc_id % 101) * 0.7 + (quality * 100) * 0.3)::bigint as score from labels where quality is not null")
def judged_score(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").where("quality is not null")
    return rows.select("doc_id", topics.judged_score(F.col("doc_id") % 101, F.col("quality") * 100).alias("score"))


@query("topic_diversity")
def topic_diversity(spark, sf_dir):
    return topics.diversity(topics.topics(topics.assign(documents(spark, sf_dir), "doc_id")))
