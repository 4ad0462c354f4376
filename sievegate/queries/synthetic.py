"""Synthetic rows against human ones, run contracts, usage logs and meters, tag deltas, coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.operators import gates, governance, metering, models, records, synthetic, topics
from sievegate.queries.records import _CHAT
from sievegate.queries.registry import documents, grams, held, query, table, train
from sievegate.queries.scoring import pairs

_RECURSIVE = _CHAT.replace("with s as", "with recursive s as", 1)
_SPLIT = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"


def made_rows(spark, sf_dir):
    """The chats' pairs, half of them once more, and a third once more with a word added."""
    rows = pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("pair")).alias("id"), "conv_id", "pair", F.col("user").alias("question"), F.col("assistant").alias("answer"))
    again = rows.where("conv_id % 2 = 0").withColumn("id", F.col("id") + 10**9)
    near = rows.where("conv_id % 3 = 0").withColumns({"id": F.col("id") + 2 * 10**9, "question": F.concat("question", F.lit(" indeed"))})
    return rows.unionByName(again).unionByName(near)


_MADE = f"""{_RECURSIVE}, base as (select conv_id * 1000 + pair as id, conv_id, "user" as q, assistant as a from pairs
), made as (select * from base union all select id + 1000000000, conv_id, q, a from base where conv_id % 2 = 0 union all select id + 2000000000, conv_id, q || ' indeed', a from base where conv_id % 3 = 0)"""


@query(
    "synthetic_filter",
    f"""{_MADE}, w as (select id, q, a, sha256(q || '|||' || a) as h, {_SPLIT.format("lower(q)")} as w, len({_SPLIT.format("a")}) as n_a from made
), l as (select *, case when len(w) < 10 then 'question_too_short' when n_a < 3 then 'answer_too_short' when n_a > 200 then 'answer_too_long' end as bad from w
), seeds as (select id, unnest({grams("w", 8)}) as z from (select id, {_SPLIT.format("lower(q)")} as w from base where conv_id % 10 = 1)
), g as (select id, {grams("w", 8)} as g from l where bad is null), u as (select id, len(g) as n, unnest(g) as z from g
), over as (select distinct id from (select u.id, s.id as seed from u join seeds s using (z) group by u.id, s.id, u.n having count(*) / u.n > 0.3)
), c as (select id, h, list_sort(list_distinct(w)) as s from l where bad is null and id not in (select id from over)
), nodes as (select min(id) as id, s from c group by s
), p as (select x.id as a, y.id as b from nodes x join nodes y on x.id < y.id where len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) >= 0.7
), o as (select b, list(a) as before, row_number() over (order by b) as i from p group by b
), r as (select 0::bigint as i, []::bigint[] as gone union all select o.i, case when len(list_filter(o.before, lambda x: not list_contains(r.gone, x))) > 0 then list_append(r.gone, o.b) else r.gone end from r join o on o.i = r.i + 1
), kept as (select id from nodes where not list_contains((select arg_max(gone, i) from r), id)
), f as (select h, min(id) as first from c group by h)
select l.id, case when bad is not null then bad when l.id in (select id from over) then 'ngram_overlap' when f.first in (select id from kept) then case when l.id <> f.first then 'exact_duplicate' end else 'near_duplicate' end as reason from l left join f using (h)""",
)
def synthetic_filter(spark, sf_dir):
    seeds = pairs(spark, sf_dir).where("conv_id % 10 = 1").select(F.col("user").alias("question"))
    return synthetic.rejection(made_rows(spark, sf_dir), seeds, "id")


@query(
    "answer_difference",
    f"""{_MADE}, human as (select q, arg_max(a, id) as own from (select id, q, case when id % 5 = 0 then a || '.' else a end as a from base) group by q)
select count(*) as matched, count(*) filter (where a <> own) as different, count(*) filter (where a = own) as same, count(*) filter (where a = own) > count(*) * 0.1 as warning from made join human using (q)""",
)
def answer_difference(spark, sf_dir):
    made = made_rows(spark, sf_dir)
    human = made.where("id < 1000000000").withColumn("answer", F.when(F.col("id") % 5 == 0, F.concat("answer", F.lit("."))).otherwise(F.col("answer")))
    return synthetic.answer_difference(made, human, "id")


@query("contaminated_split", "select doc_id, case when row_number() over (order by doc_id) <= floor(count(*) over () * 0.3::double) then 'pure_ai' else 'paraphrased' end as contamination, sha256(coalesce(text, '') || '|||' || coalesce(lang, '') || '|||' || coalesce(source, '')) as content_hash from documents")
def contaminated_split(spark, sf_dir):
    return synthetic.contaminated_split(documents(spark, sf_dir), "doc_id", 0.3, F.col("text"), F.col("lang"), F.col("source"))


@query("performance_gap", "with m as (select case when s_suppkey % 7 = 3 then 'Human ' else 'model ' end || s_suppkey as model, s_suppkey as k, s_acctbal::double as f1 from supplier) select model, f1, f1 - (select f1 from m order by model not like 'Human%', k limit 1) as gap from m")
def performance_gap(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 7 == 3, "Human ").otherwise("model "), F.col("s_suppkey").cast("string")).alias("model"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").cast("double").alias("f1"))
    return synthetic.performance_gap(rows, "model", "f1", "k")


@query(
    "run_contract",
    """with r as (select o_orderkey as k, o_orderkey % 5 = 0 as hashless, o_orderkey % 3 <> 0 as has_eval, case o_orderkey % 4 when 0 then 'completed' when 1 then 'failed' when 2 then 'unknown' end as status from orders)
select k as run, not hashless and has_eval and coalesce(status = 'completed', true) as valid, has_eval,
  array_to_string(list_filter([case when hashless then 'hashes.json' end, case when not has_eval then 'eval/eval_results.json' end, case when status <> 'completed' then 'run_meta.json' end], lambda x: x is not null), ',') as failed from r""",
)
def run_contract(spark, sf_dir):
    k = F.col("k")
    file = lambda name, when, body=None: F.when(when, F.struct(F.lit(name).alias("name"), (F.lit(None).cast("string") if body is None else body).alias("body")))
    meta = F.when(k % 4 == 0, '{"status": "completed"}').when(k % 4 == 1, '{"status": "failed"}').otherwise("not json")
    always = F.lit(True)
    made = F.array(file("config.yaml", always), file("hashes.json", k % 5 != 0), file("environment.json", always), file("eval/eval_results.json", k % 3 == 1), file("eval_results.json", k % 3 == 2), file("run_meta.json", k % 4 != 3, meta))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select(k.alias("run"), F.explode(made).alias("f")).where("f is not null").select("run", "f.*")
    return governance.run_contract(files).select("run", "valid", "has_eval", F.array_join("failed", ",").alias("failed"))


@query(
    "usage_replay",
    "select case when event_id % 7 = 0 then 'anonymous' else user_id::varchar end as api_key_id, case when event_id % 11 = 0 then 'default' else event_type end as project_id, count(*) as requests, coalesce(sum(case when event_id % 3 > 0 then (props->>'k')::bigint end), 0)::bigint as rows_in, sum(event_id)::bigint as bytes_in from events where event_id % 101 <> 0 group by 1, 2",
)
def usage_replay(spark, sf_dir):
    e = F.col("event_id")
    counters = F.struct(F.when(e % 3 > 0, F.get_json_object("props", "$.k").cast("long")).alias("rows_in"), e.alias("bytes_in"))
    whole = F.to_json(F.struct(F.when(e % 7 != 0, F.col("user_id").cast("string")).alias("api_key_id"), F.when(e % 11 != 0, F.col("event_type")).alias("project_id"), counters.alias("counters")))
    log = table(spark, sf_dir, "events").select(F.when(e % 101 == 0, F.when(e % 2 == 0, F.lit("")).otherwise(F.substring(whole, 1, 9))).otherwise(whole).alias("value"))
    return metering.replay(log, ["rows_in", "bytes_in"])


_STEPS = "['contract', 'report', 'contamination', 'decision', 'total']"


@query(
    "usage_meter",
    f"""with e as (select user_id as run, event_id as moment, {_STEPS}[event_id % 5 + 1] as step, event_id % 97 as n, (props->>'k')::bigint as k from events)
select run, coalesce(sum(k) filter (where step = 'report'), 0)::bigint as rows_in, coalesce(sum(n) filter (where step = 'contamination'), 0)::bigint as rows_out, coalesce(sum(k * 10) filter (where step = 'report'), 0)::bigint as bytes_in,
  count(*) filter (where step = 'contamination') as contamination_checks, count(*) filter (where step = 'report') as reports_generated, count(*) filter (where step = 'decision') as decisions_generated, count(*) filter (where step = 'contract') as contracts_validated,
  arg_max(n, moment) filter (where step = 'contract') as contract_ms, arg_max(n, moment) filter (where step = 'report') as report_ms, arg_max(n, moment) filter (where step = 'contamination') as contamination_ms, arg_max(n, moment) filter (where step = 'decision') as decision_ms, arg_max(n, moment) filter (where step = 'total') as total_ms,
  arg_max(case when n % 2 = 0 then 'SHIP' else 'DONT_SHIP' end, moment) filter (where step = 'decision') as decision, arg_max(n % 2, moment) filter (where step = 'decision') as exit_code,
  arg_max(case when n % 3 = 0 then 'FAIL' else 'PASS' end, moment) filter (where step = 'contamination') as contamination, arg_max(n % 5 > 0, moment) filter (where step = 'contract') as contract_valid from e group by run""",
)
def usage_meter(spark, sf_dir):
    e, n = F.col("event_id"), F.col("n")
    step = F.element_at(F.array(*map(F.lit, ("contract", "report", "contamination", "decision", "total"))), (e % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), e.alias("at"), step.alias("step"), (e % 97).alias("n"), F.get_json_object("props", "$.k").cast("long").alias("rows_in"))
    made = rows.withColumns({
        "elapsed_ms": n, "bytes_in": F.col("rows_in") * 10, "checked_rows": n, "decision": F.when(n % 2 == 0, "SHIP").otherwise("DONT_SHIP"), "exit_code": n % 2,
        "contamination": F.when(n % 3 == 0, "FAIL").otherwise("PASS"), "contract_valid": n % 5 > 0,
    })
    return metering.meter(made, "run", "at")


@query("tag_deltas", "with t as (select 'lang' as tag, lang as value, doc_id from documents union all select 'source', source, doc_id from documents) select tag, value, sum(case when doc_id % 5 = 0 then 1 else -1 end)::bigint as delta from t where value is not null group by tag, value")
def tag_deltas(spark, sf_dir):
    return gates.tag_deltas(train(spark, sf_dir), held(spark, sf_dir), ["lang", "source"])


@query("embedding_coherence", "with c as (select a.label as topic, avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as c from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by a.label) select e.label as topic, count(*) as size, round(coalesce(max(c), 0), 9) as coherence from embeddings e left join c on c.topic = e.label group by e.label")
def embedding_coherence(spark, sf_dir):
    """The coherence of the embeddings' labels, each position of a vector a term."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))
    rows = table(spark, sf_dir, "embeddings").withColumn("norm", norm).select(F.col("label").alias("topic"), F.map_from_arrays(F.sequence(F.lit(1), F.size("embedding")), unit).alias("weights"))
    return topics.coherence(rows).select("topic", "size", F.round("coherence", 9).alias("coherence"))


@query("topic_coherence")
def topic_coherence(spark, sf_dir):
    return topics.coherence(topics.assign(documents(spark, sf_dir), "doc_id"))


def _canned(prompts):
    """Stands in for a model: an answer in one of five forms by the prompt's number."""
    out = []
    for number, lang in (p.split("|") for p in prompts):
        whole = f'{{"text": "row {number} ", "label": "{lang}"}}'
        out.append([whole, f"Here:\n```json\n{whole}\n```\nDone.", f"I would say {whole} here", "I can't tell.", '{"text": "no label"}'][int(number) % 5])
    return out


@query("model_labels", "select doc_id, case when doc_id % 5 < 3 then 'row ' || doc_id end as text, case when doc_id % 5 < 3 then coalesce(lang, '') end as label from documents")
def model_labels(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("lang", F.lit(""))).alias("prompt"))
    made = models.answered(rows, F.col("prompt"), _canned)
    return made.select("doc_id", models.parsed(F.col("answer"), ("text", "label")).alias("p")).select("doc_id", "p.text", "p.label")


@query(
    "experiment_rows",
    """with x as (select doc_id, coalesce(source, '') as question, coalesce(text, '') as context, case when doc_id % 4 > 0 then coalesce(lang, '') else '' end as answer, 'squad' as kind from documents
  union all select doc_id, coalesce(source, ''), coalesce(text, ''), case doc_id % 3 when 0 then 'zero' when 1 then coalesce(lang, '') else '' end, 'cosmos_qa' from documents
  union all select doc_id, coalesce(text, ''), '', coalesce(lang, ''), 'generic' from documents)
select kind, 'train_' || doc_id as id, answer, sha256(question || '|||' || context || '|||' || answer) as content_hash from x""",
)
def experiment_rows(spark, sf_dir):
    d = documents(spark, sf_dir)
    base = d.select("doc_id", F.col("source").alias("question"), F.col("text").alias("context"), "lang")
    squad = base.withColumn("answers", F.struct(F.when(F.col("doc_id") % 4 > 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("text")))
    cosmos = base.withColumns({"label": F.col("doc_id") % 3, "answer0": F.lit("zero"), "answer1": F.col("lang")})
    generic = d.select("doc_id", "text", F.array("lang").alias("output"))
    made = [records.experiment_rows(x, "doc_id", "train", k).select(F.lit(k).alias("kind"), "id", "answer", "content_hash") for x, k in ((squad, "squad"), (cosmos, "cosmos_qa"), (generic, "generic"))]
    return made[0].unionByName(made[1]).unionByName(made[2])
