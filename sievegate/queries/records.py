"""Records: chat expansion, canonical form, ids, buckets, splits, dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions.text import strip, tokens
from sievegate.operators import records, similarity
from sievegate.plans.ingest import ingest
from sievegate.queries.registry import STRIPPED, documents, query, table
from sievegate.sources import readers, sinks

_CHAT = """
with s as (select *, last_value(case when role = 'system' then text end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as system from conversations
), n as (select *, lead(role) over (partition by conv_id order by turn) as r, lead(text) over (partition by conv_id order by turn) as t from s where role <> 'system'
), pairs as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as pair, text as "user", t as assistant, system from n where role = 'user' and r = 'assistant')
"""


@query("chat_expand", f"{_CHAT} select * from pairs")
def chat_expand(spark, sf_dir):
    return records.chat_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("canonical_sft", rf"""{_CHAT} select conv_id, pair, regexp_replace("user", '^\s+|\s+$', '', 'g') as input, regexp_replace(assistant, '^\s+|\s+$', '', 'g') as output from pairs where trim("user") <> '' and trim(assistant) <> ''""")
def canonical_sft(spark, sf_dir):
    pairs = records.chat_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumnsRenamed({"user": "question", "assistant": "answer"})
    kept = pairs.where(records.has_required(pairs, "sft"))
    return kept.select("conv_id", "pair", *records.canonical_columns(kept, "sft"))


_ESCAPE = "replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t')"


@query("row_id", f"""select doc_id, 'row_' || substr(sha256('{{"lang": "' || {_ESCAPE.format("lang")} || '", "text": "' || {_ESCAPE.format("text")} || '"}}'), 1, 16) as row_id from documents where text is not null and lang is not null""")
def row_id(spark, sf_dir):
    docs = documents(spark, sf_dir).where("text is not null and lang is not null")
    return docs.select("doc_id", records.row_id({"text": F.col("text"), "lang": F.col("lang")}).alias("row_id"))


@query(
    "ingest_classification",
    rf"""with x as (select {STRIPPED} as text, quality::varchar as label from documents join labels using (doc_id) where trim(coalesce(text, '')) <> '' and quality is not null)
select 'row_' || substr(sha256('{{"label": "' || label || '", "text": "' || {_ESCAPE.format("text")} || '"}}'), 1, 16) as row_id, label, length(text)::bigint as n from x""",
)
def ingest_classification(spark, sf_dir):
    joined = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("text").alias("body"), F.col("quality").alias("category"))
    rows = ingest(joined, mapping={"text": "body", "label": "category"}, tags={"origin": "documents"}).rows
    return rows.select("row_id", "label", F.length("text").cast("long").alias("n"))


@query("classify_buckets", "select 'unknown' as schema, coalesce(nullif(lower(trim(source)), ''), 'uncategorized') as category, count(*) as \"count\", count(*) / (select count(*) from documents) as fraction from documents group by 2")
def classify_buckets(spark, sf_dir):
    return records.buckets(documents(spark, sf_dir))


@query("language_share", r"select case when length(t) = 0 or length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) / length(t) >= 0.90 then 'en' else 'other' end as language, count(*) as n from (select coalesce(text, '') as t from documents) group by 1")
def language_share(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.when(records.mostly_ascii(F.coalesce("text", F.lit(""))), "en").otherwise("other").alias("language"))
    return rows.groupBy("language").agg(F.count("*").alias("n"))


@query("dataset_contract", "select count(*) as rows, count(*) filter (where trim(coalesce(text, '')) <> '' and quality is not null) as valid, count(*) filter (where not (trim(coalesce(text, '')) <> '' and quality is not null)) as invalid, case when bool_and(trim(coalesce(text, '')) <> '' and quality is not null) then 'PASS' else 'FAIL' end as status from documents left join labels using (doc_id)")
def dataset_contract(spark, sf_dir):
    joined = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("label", F.col("quality"))
    return records.contract(joined, "classification")


@query("bucketed_rows", "with c as (select source, count(*) as n from documents group by source) select doc_id, regexp_replace(lower('unknown__' || coalesce(nullif(trim(source), ''), 'uncategorized')), '[^a-z0-9_]', '_', 'g') as bucket from documents join c using (source) where n >= 20")
def bucketed_rows(spark, sf_dir):
    return sinks.bucketed(documents(spark, sf_dir), 20).select("doc_id", "bucket")


@query("flatten_events", "select event_id, user_id, event_type as \"event.type\", value as \"event.value\", (props->>'k')::bigint as \"event.props.k\" from events")
def flatten_events(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct(F.col("event_type").alias("type"), "value", F.from_json("props", "k long").alias("props")).alias("event"))
    return records.flatten(nested)


_UNIQUE = f"select min(doc_id) as doc_id, lower({STRIPPED}) as t from documents group by 2"


_TOKEN_SETS = f"""w as (select min(doc_id) as id, w from (select doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> ''))) as w from documents) group by w
), u as (select id, len(w) as n, unnest(w) as t from w), p as (select x.id as a, y.id as b from u x join u y using (t) where x.id < y.id group by x.id, y.id, x.n, y.n having count(*) / (x.n + y.n - count(*)) >= 0.85
), s as (select b, list(a) as before, row_number() over (order by b) as i from p group by b)"""


@query(
    "fuzzy_dedupe",
    f"""with recursive {_TOKEN_SETS}, r as (select 0::bigint as i, []::bigint[] as gone union all select s.i, case when len(list_filter(s.before, lambda x: not list_contains(r.gone, x))) > 0 then list_append(r.gone, s.b) else r.gone end from r join s on s.i = r.i + 1
) select id as doc_id from w where not list_contains((select arg_max(gone, i) from r), id)""",
)
def fuzzy_dedupe(spark, sf_dir):
    """Kept documents of the greedy order: distinct token sets, Jaccard of 0.85 or more to a kept smaller one drops."""
    words = F.array_distinct(tokens(F.lower(F.coalesce(F.col("text"), F.lit("")))))
    return similarity.fuzzy_dedupe(documents(spark, sf_dir), "doc_id", words, 0.85).select(F.col("id").alias("doc_id"))


@query("sample_rows", "select doc_id from documents order by sha256('42:' || doc_id), doc_id limit 100")
def sample_rows(spark, sf_dir):
    return readers.sample(documents(spark, sf_dir).select("doc_id"), "doc_id", 100)


@query("split_rows", "select doc_id, source, case when draw < 0.8 then 'train' when draw < 0.9 then 'val' else 'test' end as split from (select doc_id, source, ('0x' || sha256('42:' || doc_id)[1:8])::bigint / 4294967296 as draw from documents)")
def split_rows(spark, sf_dir):
    return readers.split(documents(spark, sf_dir).select("doc_id", "source"), "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1})


@query("multi_source", "select 'documents' as _source, count(*) as n from documents union all select 'benchmark', count(*) from benchmark")
def multi_source(spark, sf_dir):
    both = readers.concat({"documents": documents(spark, sf_dir).select("text"), "benchmark": table(spark, sf_dir, "benchmark").select("text")})
    return both.groupBy("_source").agg(F.count("*").alias("n"))


@query("content_hash", r"select doc_id, sha256(coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') || '|||' || coalesce(lang, '') || '|||' || coalesce(source, '')) as h from documents")
def content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.concat_ws("|||", F.coalesce(strip(F.col("text")), F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))), 256).alias("h"))
