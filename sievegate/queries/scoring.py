"""Predictions against references, and the rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.operators import decision, evaluation, records
from sievegate.queries.records import _CHAT
from sievegate.queries.registry import query, table

_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\pL\pN\pM_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_T = "list_filter(string_split({0}, ' '), lambda x: x <> '')"


def _scored_sql() -> str:
    return f"""{_CHAT}, q as (select conv_id, pair, {_T.format(_NORM.format('"user"'))} as p, {_T.format(_NORM.format("assistant"))} as r from pairs
), a as (select conv_id, pair, w, count(*) as c from (select conv_id, pair, unnest(p) as w from q) group by all), b as (select conv_id, pair, w, count(*) as c from (select conv_id, pair, unnest(r) as w from q) group by all
), m as (select conv_id, pair, sum(least(a.c, b.c)) as m from a join b using (conv_id, pair, w) group by all
), sc as (select conv_id, pair, p, r, case when len(p) = 0 and len(r) = 0 then 1.0 when coalesce(m, 0) = 0 then 0.0 else 2 * (m / len(p)) * (m / len(r)) / (m / len(p) + m / len(r)) end as f1 from q left join m using (conv_id, pair))"""


def pairs(spark, sf_dir):
    return records.chat_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def scored(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "pair", "user", "assistant", evaluation.token_f1(F.col("user"), F.col("assistant")).alias("f1"))


@query("token_f1", f"{_scored_sql()} select conv_id, pair, round(f1, 9) as f1 from sc")
def token_f1(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "pair", F.round("f1", 9).alias("f1"))


@query("exact_match", f"{_scored_sql()} select conv_id, pair, (array_to_string(p, ' ') = array_to_string(r, ' '))::int::double as exact_match from sc")
def exact_match(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "pair", evaluation.exact_match(F.col("user"), F.col("assistant")).alias("exact_match"))


@query("length_ratio", f"{_scored_sql()} select conv_id, pair, round(case when len(r) = 0 then case when len(p) = 0 then 0 else 'inf'::double end else len(p) / len(r) end, 9) as ratio from sc")
def length_ratio(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "pair", F.round(evaluation.length_ratio(F.col("user"), F.col("assistant")), 9).alias("ratio"))


def _bleu_sql() -> str:
    orders = []
    for n in range(1, 5):
        gram = lambda c: f"list_transform(range(1, greatest(len({c}) - {n - 2}, 1)), lambda i: array_to_string({c}[i : i + {n - 1}], ' '))"  # noqa: B023, E731
        orders.append(f"select conv_id, pair, {n} as n, sum(least(a.c, b.c)) as m from (select conv_id, pair, g, count(*) as c from (select conv_id, pair, unnest({gram('p')}) as g from q) group by all) a join (select conv_id, pair, g, count(*) as c from (select conv_id, pair, unnest({gram('r')}) as g from q) group by all) b using (conv_id, pair, g) group by all")
    return f"""{_CHAT}, q as (select conv_id, pair, {_T.format(_NORM.format('"user"'))} as p, {_T.format(_NORM.format("assistant"))} as r from pairs
), o as ({" union all ".join(orders)}), l as (select conv_id, pair, count(*) as k, sum(ln(m / (len(p) - n + 1))) as s from o join q using (conv_id, pair) group by conv_id, pair)
select q.conv_id, q.pair, round(case when k = 4 then case when len(p) < len(r) then exp(1 - len(r) / len(p)) else 1 end * exp(s / 4) else 0 end, 9) as bleu from q left join l using (conv_id, pair)"""


@query("bleu", _bleu_sql())
def bleu(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "pair", F.round(evaluation.bleu(F.col("user"), F.col("assistant")), 9).alias("bleu"))


@query(
    "rouge_l",
    f"""{_scored_sql().replace("with s as", "with recursive s as", 1)}, l as (select conv_id, pair, p, r, 0::bigint as i, list_transform(r, lambda x: 0) as v from sc
  union all select conv_id, pair, p, r, i + 1, list_transform(range(1, len(u) + 1), lambda j: list_max(u[1:j]))
  from (select *, list_transform(range(1, len(r) + 1), lambda j: greatest(v[j], case when r[j] = p[i + 1] then coalesce(v[j - 1], 0) + 1 else 0 end)) as u from l where i < len(p) and len(r) > 0))
select conv_id, pair, case when len(p) = 0 or len(r) = 0 then (len(p) = len(r))::int::double else 2 * v[len(r)] / (len(p) + len(r)) end as rouge_l from l where i = len(p) or len(r) = 0""",
)
def rouge_l(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "pair", evaluation.rouge_l(F.col("user"), F.col("assistant")).alias("rouge_l"))


@query("rouge_1", f"{_scored_sql()} select conv_id, pair, round(f1, 9) as rouge_1 from sc")
def rouge_1(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "pair", F.round(evaluation.rouge_1(F.col("user"), F.col("assistant")), 9).alias("rouge_1"))


@query("eval_mean", f"{_scored_sql()} select count(*) as n, round(avg(f1), 9) as f1 from sc")
def eval_mean(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg("f1"), 9).alias("f1"))


@query("slice_metrics", f"{_scored_sql()} select coalesce(case when conv_id % 3 > 0 then (conv_id % 3)::varchar end, '_untagged') as slice, count(*) as n, round(avg(f1), 9) as f1 from sc group by 1")
def slice_metrics(spark, sf_dir):
    tagged = scored(spark, sf_dir).withColumn("tag", F.when(F.col("conv_id") % 3 > 0, (F.col("conv_id") % 3).cast("string")))
    return evaluation.slices(tagged, "tag", ["f1"]).withColumn("f1", F.round("f1", 9))


@query("hard_examples", f"{_scored_sql()} select conv_id, pair, round(f1, 9) as f1, row_number() over (order by round(f1, 9), conv_id, pair) as rank from sc order by round(f1, 9), conv_id, pair limit 50")
def hard_examples(spark, sf_dir):
    rows = scored(spark, sf_dir).select("conv_id", "pair", F.round("f1", 9).alias("f1"))
    return evaluation.hardest(rows, "f1", ["conv_id", "pair"], 50)


@query("confusion", "select quality as reference, toxic as predicted, count(*) as n from labels group by all")
def confusion(spark, sf_dir):
    return evaluation.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    "class_metrics",
    """with l as (select unnest([quality, toxic]) as label from labels), c as (select distinct label from l)
select label, (select count(*) from labels where quality = label) as support,
  coalesce((select count(*) from labels where quality = label and toxic = label) / nullif((select count(*) from labels where toxic = label), 0), 0) as "precision",
  coalesce((select count(*) from labels where quality = label and toxic = label) / nullif((select count(*) from labels where quality = label), 0), 0) as recall,
  coalesce(2 * (select count(*) from labels where quality = label and toxic = label) / nullif((select count(*) from labels where quality = label) + (select count(*) from labels where toxic = label), 0), 0) as f1 from c""",
)
def class_metrics(spark, sf_dir):
    return evaluation.class_metrics(table(spark, sf_dir, "labels"), "quality", "toxic")


def cases(spark, sf_dir):
    """One case for each customer, its figures made from its columns."""
    c = table(spark, sf_dir, "customer")
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return c.select(
        k.alias("id"),
        (k % 10 != 0).alias("contract_valid"),
        (k % 3).cast("int").alias("contract_failures"),
        F.when(k % 7 != 0, k % 5).cast("int").alias("pii_hits"),
        F.when(k % 4 == 0, "FAIL").when(k % 4 == 1, "WARN").otherwise("PASS").alias("contamination"),
        (k % 101).cast("double").alias("quality"),
        F.when(k % 9 != 0, (k % 100) / 100).alias("f1"),
        F.when(k % 9 != 0, (k % 90) / 100).alias("exact_match"),
        F.when(k % 9 != 0, ((k % 11) - 5) / 100).alias("f1_delta"),
        (k % 200).alias("rows"),
        F.lit(None).cast("double").alias("duplicate_rate"),
        F.when(b < 0, "remote").when(b < 5000, "local").alias("privacy"),
        F.lit(None).cast("double").alias("accuracy"),
        (k % 9 != 0).alias("evaluated"),
        F.when(k % 6 != 0, k % 6 == 1).alias("regressed"),
        (k % 2 == 0).alias("reproducible"),
    )


_CASES = """c as (select c_custkey as id, c_custkey % 10 <> 0 as contract_valid, (c_custkey % 3)::int as contract_failures, case when c_custkey % 7 <> 0 then c_custkey % 5 end as pii_hits,
  case c_custkey % 4 when 0 then 'FAIL' when 1 then 'WARN' else 'PASS' end as contamination, case when c_custkey % 9 <> 0 then (c_custkey % 100) / 100 end as f1, case when c_custkey % 9 <> 0 then (c_custkey % 90) / 100 end as em,
  case when c_custkey % 9 <> 0 then (c_custkey % 11 - 5) / 100 end as delta, (c_custkey % 101)::double as quality, c_custkey % 200 as rows, case when c_acctbal < 0 then 'remote' when c_acctbal < 5000 then 'local' end as privacy,
  c_custkey % 9 <> 0 as evaluated, case when c_custkey % 6 <> 0 then c_custkey % 6 = 1 end as regressed, c_custkey % 2 = 0 as reproducible from customer
), n as (select *, coalesce(pii_hits > 2, false)::int + (contamination = 'FAIL')::int + (quality < 20)::int + (f1 is null)::int + coalesce(f1 < 0.3, false)::int + coalesce(em < 0.2, false)::int + coalesce(delta < -0.02, false)::int as blockers,
  coalesce(f1 >= 0.3, false)::int + coalesce(em >= 0.2, false)::int as met from c
), d as (select *, case when not contract_valid or blockers > 0 then 'DONT_SHIP' when contamination = 'WARN' then 'INVESTIGATE' else 'SHIP' end as recommendation,
  case when not contract_valid then 3 when blockers > 0 then 1 when contamination = 'WARN' then 2 else 0 end as exit_code,
  round(case when not contract_valid then 1 when blockers > 0 then least(0.3, 0.1 * blockers) when contamination = 'WARN' then 0.7 else least(1, 0.9 + 0.02 * met) end::double, 2) as confidence from n)"""

_CRITERIA = decision.Criteria(min_f1=0.3, min_exact_match=0.2, max_f1_regression=0.02, max_pii_hits=2, min_quality=20)


@query("decision_rules", f"with {_CASES} select id, recommendation, exit_code, confidence from d")
def decision_rules(spark, sf_dir):
    made = cases(spark, sf_dir).select("id", decision.decide(_CRITERIA).alias("d"))
    return made.select("id", "d.recommendation", "d.exit_code", "d.confidence")


_RISK = """greatest(0, least(100, case when pii_hits is null then 20 when pii_hits > 0 then least(30, 10 + pii_hits * 2) else 0 end + case when contract_valid then 0 else least(25, 10 + contract_failures * 5) end
  + case contamination when 'FAIL' then 50 when 'WARN' then 20 else 0 end + case privacy when 'remote' then 10 when 'local' then -5 else 0 end + case when rows < 100 then least(10, (100 - rows) / 100 * 10) else 0 end))"""
_HEALTH = """greatest(0, least(100, case recommendation when 'SHIP' then 40 * confidence when 'INVESTIGATE' then 20 * confidence else 5 end + case when not evaluated then 5 else f1 * 30 end
  + case when regressed is null then 10 when regressed then 0 else 15 end + case when reproducible then 15 else 5 end))"""


@query("risk_score", f"with {_CASES} select id, round({_RISK}, 6) as risk from d")
def risk_score(spark, sf_dir):
    return cases(spark, sf_dir).select("id", F.round(decision.risk(), 6).alias("risk"))


def judged(spark, sf_dir):
    made = cases(spark, sf_dir).withColumn("d", decision.decide(_CRITERIA))
    made = made.withColumns({"recommendation": F.col("d.recommendation"), "confidence": F.col("d.confidence")})
    return made.select("id", F.round(decision.risk(), 6).alias("risk"), F.round(decision.health(), 6).alias("health"))


@query("model_health", f"with {_CASES} select id, round({_HEALTH}, 6) as health from d")
def model_health(spark, sf_dir):
    return judged(spark, sf_dir).select("id", "health")


@query(
    "verdict",
    f"""with {_CASES}, s as (select id, round({_RISK}, 6) as r, round({_HEALTH}, 6) as h from d)
select id, case when r > 75 or h < 26 then 'BLOCKED' when r > 50 and h < 51 then 'BLOCKED' when r <= 50 and h >= 51 then 'APPROVED' else 'REVIEW_REQUIRED' end as verdict from s""",
)
def verdict(spark, sf_dir):
    made = judged(spark, sf_dir)
    return made.select("id", decision.verdict(decision.risk_level(F.col("risk")), decision.health_level(F.col("health"))).alias("verdict"))


@query(
    "readiness",
    f"with {_CASES} select id, case when not contract_valid or contamination = 'FAIL' then 'FAIL' when contamination = 'WARN' or pii_hits > 0 then 'WARN' else 'PASS' end as status from d",
)
def readiness(spark, sf_dir):
    checks = F.array(F.when(F.col("contract_valid"), "PASS").otherwise("FAIL"), F.col("contamination"), F.when(F.col("pii_hits") > 0, "WARN").otherwise("PASS"))
    return cases(spark, sf_dir).select("id", decision.worst(checks).alias("status"))
