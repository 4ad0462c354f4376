"""Profiles, personal data, quality checks, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions import patterns
from sievegate.functions.text import strip
from sievegate.operators import filters, quality, stats
from sievegate.plans import gate, transform
from sievegate.queries.registry import STRIPPED, TOKENS, documents, query, table


@query(
    "field_stats",
    """
with x as (
  select 'text' as field, text as value from documents union all select 'lang', lang from documents union all select 'source', source from documents
)
select field, count(value) as present, count(*) filter (where regexp_matches(value, '^\\s*$')) as empty,
  round(coalesce(avg(length(value)) filter (where not regexp_matches(value, '^\\s*$')), 0), 1) as avg_len from x group by field
""",
)
def field_stats(spark, sf_dir):
    return stats.field_stats(documents(spark, sf_dir), ["text", "lang", "source"])


@query(
    "field_stats_orders",
    """
with x as (
  select 'o_orderkey' as field, o_orderkey::varchar as value from orders union all select 'o_custkey', o_custkey::varchar from orders
  union all select 'o_orderstatus', o_orderstatus from orders union all select 'o_orderpriority', o_orderpriority from orders
)
select field, count(value) as present, count(*) filter (where trim(value) = '') as empty, round(coalesce(avg(length(value)) filter (where trim(value) <> ''), 0), 1) as avg_len from x group by field
""",
)
def field_stats_orders(spark, sf_dir):
    return stats.field_stats(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


VOCAB = f"""
with d as (select {TOKENS} as w from documents), v as (select word, count(*) as c from (select unnest(w) as word from d) group by word
), l as (select len(w)::bigint as n, row_number() over (order by len(w)) - 1 as i, count(*) over () as t from d)
select (select sum(c)::bigint from v) as total_tokens, (select count(*) from v) as unique_tokens, (select count(*) from v where c = 1) as hapax_legomena,
  round((select count(*) / sum(c) from v), 4) as type_token_ratio, round((select count(*) filter (where c = 1) / count(*) from v), 4) as hapax_ratio,
  (select round(avg(n), 1) from l) as length_mean, (select n from l where i = t // 2) as length_median,
  (select n from l where i = case when t >= 20 then floor(t * 0.95)::bigint else t - 1 end) as length_p95, (select min(n) from l) as length_min, (select max(n) from l) as length_max
"""


@query("vocab_stats", VOCAB)
def vocab_stats(spark, sf_dir):
    return stats.vocab_stats(documents(spark, sf_dir))


@query(
    "length_report",
    r"""
with x as (select len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint as a, length(text)::bigint as b from documents where not regexp_matches(text, '^\s*$')
), y as (select 'text' as field, 'tokens' as measure, a as v from x union all select 'text', 'characters', b from x
), r as (select *, row_number() over (partition by measure order by v) - 1 as i, count(*) over (partition by measure) as n from y)
select field, measure, min(v) as min, floor((max(v) filter (where i = (n - 1) // 2) + max(v) filter (where i = n // 2)) / 2)::bigint as median,
  max(v) filter (where i = least(n * 95 // 100, n - 1)) as p95, max(v) as max from r group by field, measure
""",
)
def length_report(spark, sf_dir):
    return stats.length_report(documents(spark, sf_dir), ["text"])


@query(
    "duplicate_rates",
    """
with c as (select count(*) as c from documents group by sha256(coalesce(text, ''))), t as (select sum(c)::bigint as rows, count(*) as d, coalesce(sum(c) filter (where c > 1), 0)::bigint as m, coalesce(sum(c - 1) filter (where c > 1), 0)::bigint as l from c)
select 'surplus' as variant, rows, rows - d as duplicates, (rows - d) / rows as rate from t union all select 'members', rows, m, m / rows from t union all select 'later', rows, l, l / rows from t
""",
)
def duplicate_rates(spark, sf_dir):
    return stats.duplicate_rates(documents(spark, sf_dir))


@query(
    "tag_distribution",
    "select 'lang' as tag, lang as value, count(*) as n from documents where lang is not null group by lang union all select 'source', source, count(*) from documents where source is not null group by source",
)
def tag_distribution(spark, sf_dir):
    return stats.tag_distribution(documents(spark, sf_dir), ["lang", "source"])


@query("keep_first_dedupe", f"select min(doc_id) as doc_id from documents group by sha256(lower({STRIPPED}))")
def keep_first_dedupe(spark, sf_dir):
    return stats.keep_first(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").select("doc_id")


@query(
    "blank_cells",
    "select count(*) * 3 as cells, (count(*) filter (where trim(coalesce(text, '')) = '') + count(*) filter (where trim(coalesce(lang, '')) = '') + count(*) filter (where trim(coalesce(source, '')) = ''))::bigint as blank from documents",
)
def blank_cells(spark, sf_dir):
    return stats.blanks(documents(spark, sf_dir).select("text", "lang", "source"))


_PII_ROWS = " union all ".join(f"select '{k}' as type, {c} as confidence, doc_id from documents where regexp_matches(text, '{p}')" for k, (p, c) in patterns.PII.items())


@query("pii_scan", f"select type, count(*) as rows, confidence::double as confidence, list(doc_id order by doc_id)[1:10] as sample from ({_PII_ROWS}) group by type, confidence")
def pii_scan(spark, sf_dir):
    return gate.pii_scan(documents(spark, sf_dir), "doc_id")


@query("pii_scan_confident", f"select type, count(*) as rows, confidence::double as confidence, list(doc_id order by doc_id)[1:10] as sample from ({_PII_ROWS}) where confidence >= 0.8 group by type, confidence")
def pii_scan_confident(spark, sf_dir):
    return gate.pii_scan(documents(spark, sf_dir), "doc_id", least=0.8)


def _redacted(column: str) -> str:
    for kind, pattern in patterns.REDACT.items():
        column = f"regexp_replace({column}, '{pattern}', '[{kind.upper()}_REDACTED]', 'g')"
    return column


@query("pii_redact", f"select doc_id, sha256({_redacted('text')}) as redacted_sha256 from documents where text is not null")
def pii_redact(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.sha2(patterns.redact(F.col("text")), 256).alias("redacted_sha256"))


@query(
    "pii_redact_by_hash",
    r"""
with d as (select doc_id, regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') as h, string_split_regex(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') as g from documents where text is not null)
select doc_id, sha256(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || case when i <= len(h) then '[EMAIL:' || sha256(h[i])[1:12] || ']' else '' end), '')) as redacted_sha256 from d
""",
)
def pii_redact_by_hash(spark, sf_dir):
    made = patterns.redact_by_hash(F.col("text"), patterns.PII["email"][0], "email")
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.sha2(made, 256).alias("redacted_sha256"))


def _secret_sql() -> str:
    quoted = {k: (p.replace("'", "''"), s) for k, (p, s) in patterns.SECRETS.items()}
    rows = " union all ".join(f"select '{k}' as type, '{s}' as severity, doc_id, unnest(regexp_extract_all(line, '{p}', 0)) as hit from lines" for k, (p, s) in quoted.items())
    return f"""
with lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), hits as ({rows})
select type, severity, count(*) as hits, count(distinct doc_id) as rows from hits where not regexp_matches(hit, '{patterns.HARMLESS}') group by type, severity
"""


@query("secret_audit", _secret_sql())
def secret_audit(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(s).alias("severity"), F.regexp_extract_all("line", F.lit(p), F.lit(0)).alias("hits")) for k, (p, s) in patterns.SECRETS.items()])
    hits = lines.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.type", "x.severity", F.explode("x.hits").alias("hit")).where(~F.col("hit").rlike(patterns.HARMLESS))
    return hits.groupBy("type", "severity").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("rows"))


@query("empty_rows", f"select doc_id from documents where length({STRIPPED}) < 10")
def empty_rows(spark, sf_dir):
    return documents(spark, sf_dir).where(quality.low_information(F.col("text"))).select("doc_id")


@query(
    "length_outliers",
    r"""
with d as (select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint as n_words from documents)
select doc_id, n_words from d, (select avg(n_words) as m, stddev_pop(n_words) as s, count(*) as n from d) where n >= 5 and s > 0 and abs(n_words - m) > 2 * s
""",
)
def length_outliers(spark, sf_dir):
    return quality.length_outliers(documents(spark, sf_dir), "doc_id")


@query("encoding_issues", r"select doc_id from documents where regexp_matches(coalesce(text, ''), '[Ã¢â€ï¿½Â]|[\x00-\x08\x0b\x0c\x0e-\x1f]')")
def encoding_issues(spark, sf_dir):
    return documents(spark, sf_dir).where(quality.encoding_issue(F.col("text"))).select("doc_id")


_REPEATED = f"""
with d as (select doc_id, {TOKENS} as w from documents), g as (select doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) as g from d where len(w) >= 12)
select distinct doc_id from (select doc_id, g from g group by doc_id, g having count(*) >= 3)
"""


@query("repetition", _REPEATED)
def repetition(spark, sf_dir):
    return documents(spark, sf_dir).where(quality.repeated_phrase(F.col("text"))).select("doc_id")


@query(
    "class_imbalance",
    "select quality::varchar as label, count(*) as n, count(*) / sum(count(*)) over () as share, count(*) / sum(count(*)) over () < 0.05 as minority from labels where quality is not null group by quality",
)
def class_imbalance(spark, sf_dir):
    return quality.class_balance(table(spark, sf_dir, "labels"), "quality")


def issues_sql(source: str = "documents", near: str | None = None, semantic: str | None = None, label: str | None = None) -> str:
    """The issues i of a table; near and semantic select the doc_id of duplicates, label is a column of classes."""
    also = lambda name, rows: f" union all select doc_id, '{name}' from ({rows})" if rows else ""
    classes = f"""
  union all select 'class_imbalance', 'warning', minority, minority / classes, []::bigint[] from (select count(*) filter (where n / labelled < 0.05) as minority, count(*) as classes, max(labelled) as labelled
    from (select count(*) as n, sum(count(*)) over () as labelled from {source} where {label} is not null group by {label})), (select max(total) as total from s) where minority > 0 and classes > 1 and labelled >= total * 0.5"""
    return f"""
with rep as ({_REPEATED.replace('from documents', f'from {source}')}), d as (select doc_id, length({STRIPPED}) as n, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as w, coalesce(text, '') as t from {source}
), s as (select avg(w) as m, stddev_pop(w) as sd, count(*) as total from d
), f as (
  select doc_id, 'empty_or_low_info' as category from d where n < 10
  union all select doc_id, 'encoding_issue' from d where regexp_matches(t, '[Ã¢â€ï¿½Â]|[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')
  union all select doc_id, 'repetition' from rep
  union all select doc_id, 'length_outlier' from d, s where sd > 0 and abs(w - m) > 2 * sd{also('near_duplicate', near)}{also('semantic_duplicate', semantic)}
), i as (
  select category, case when category = 'empty_or_low_info' and count(*) / max(total) > 0.05 or category = 'near_duplicate' and count(*) / max(total) >= 0.1 or category = 'semantic_duplicate' and count(*) / max(total) >= 0.15 then 'error' else 'warning' end as severity, count(*) as "count",
    count(*) / max(total) as fraction, list(doc_id order by doc_id)[1:5] as sample from f, s group by category{classes if label else ''}
)"""


PENALTY = "select greatest(0, least(100, floor(100 - coalesce(sum(least(25, case severity when 'error' then 15 else 5 end * fraction * 100)), 0))))::bigint as quality_score from i"


_REJECT = f"""
with d as (select doc_id, coalesce(text, '') as text from documents), w as (select doc_id, text, {TOKENS} as w from d
), a as (select doc_id, max(c) as c from (select doc_id, x, count(*) as c from (select doc_id, unnest(w) as x from w) group by doc_id, x) group by doc_id
), b as (select doc_id, max(c) as c from (select doc_id, x, count(*) as c from (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) as x from w) group by doc_id, x) group by doc_id
)
select w.doc_id, case when trim(text) = '' then 'empty' when length(text) < 20 then 'too_short' when length(text) > 4096 then 'too_long'
  when length(regexp_replace(text, '[a-zA-Z0-9\\s.,!?;:''"()\\-/]', '', 'g')) / length(text) >= 0.3 then 'bad_chars'
  when len(w) >= 5 and (a.c / len(w) > 0.4 or b.c > greatest(3, (len(w) - 2) * 0.2)) then 'repetitive'
  when {" or ".join(f"regexp_matches(text, '{p}')" for p in patterns.REDACT.values())} then 'pii' end as reason
from w left join a using (doc_id) left join b using (doc_id)
"""


@query("filter_chain", _REJECT)
def filter_chain(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", filters.rejection(F.col("text"), 20, 4096).alias("reason"))


@query("filter_counts", f"select coalesce(reason, 'kept') as reason, count(*) as n from ({_REJECT}) group by 1")
def filter_counts(spark, sf_dir):
    made = documents(spark, sf_dir).select(F.coalesce(filters.rejection(F.col("text"), 20, 4096), F.lit("kept")).alias("reason"))
    return made.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "seed_leakage",
    f"""
with s as (select distinct lower({STRIPPED}) as t from benchmark where {STRIPPED} <> ''), d as (select doc_id, lower({STRIPPED}) as t from documents
), w as (select doc_id, t, unnest(list_distinct(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''))) as x from d), n as (select doc_id, count(*) as n from w group by doc_id
), i as (select t as seed, unnest(list_distinct(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''))) as x from s)
select doc_id from d where t in (select t from s) union
select doc_id from (select w.doc_id, seed from w join i using (x) join n using (doc_id) group by w.doc_id, seed, n having count(*) / n > 0.9)
""",
)
def seed_leakage(spark, sf_dir):
    return filters.leaked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id")


def _count(words: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::int" for w in words)


@query("sentiment_label", f"select doc_id, case when {_count(filters.POSITIVE)} > {_count(filters.NEGATIVE)} then 'positive' when {_count(filters.POSITIVE)} < {_count(filters.NEGATIVE)} then 'negative' end as label from documents where text is not null")
def sentiment_label(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").select("doc_id", filters.sentiment(F.col("text")).alias("label"))


@query(
    "qa_regex_label",
    r"""
with p as (select conv_id, turn, text, '(?is)(?:Q|Question|Ask)[:\s]+(.+?)(?:\n|$)\s*(?:A|Answer|Response)[:\s]+(.+)' as pat, string_split(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(10)) as l from conversations
), f as (select *, list_min(list_filter(range(1, len(l)), lambda i: contains(l[i], '?'))) as fst from p)
select conv_id, turn, case when regexp_matches(text, '(?is)(?:Q|Question|Ask)[:\s]+(.+?)(?:\n|$)\s*(?:A|Answer|Response)[:\s]+(.+)') then trim(regexp_extract(text, '(?is)(?:Q|Question|Ask)[:\s]+(.+?)(?:\n|$)\s*(?:A|Answer|Response)[:\s]+(.+)', 1)) else trim(l[fst]) end as question from f
""",
)
def qa_regex_label(spark, sf_dir):
    found = filters.question_answer(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found["question"].alias("question"))


@query("redacted_fields", f"select coalesce(sum((text <> {_redacted('text')})::int), 0)::bigint as changed from documents")
def redacted_fields(spark, sf_dir):
    return transform.redacted_fields(documents(spark, sf_dir), ["text"])


@query("page_bad_characters", r"""select page_id, case when length(html) > 0 then length(regexp_replace(html, '[a-zA-Z0-9\s.,!?;:''"()\-/]', '', 'g')) / length(html) >= 0.3 else true end as bad from pages""")
def page_bad_characters(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", filters.bad_characters(F.col("html")).alias("bad"))


@query("sanity_basics", f"select lang, count(*) as n, avg(len({TOKENS})) as mean, min(len({TOKENS}))::bigint as least, max(len({TOKENS}))::bigint as most, median(len({TOKENS})) as middle from documents where text is not null group by lang")
def sanity_basics(spark, sf_dir):
    from sievegate.functions.text import tokens

    rows = documents(spark, sf_dir).where("text is not null").select("lang", F.size(tokens(F.col("text"))).cast("long").alias("w"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg("w").alias("mean"), F.min("w").alias("least"), F.max("w").alias("most"), F.median("w").alias("middle"))


@query("stripped_lengths", f"select doc_id, length({STRIPPED})::bigint as n from documents")
def stripped_lengths(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length(strip(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("n"))


_PASSED = f"""with red as (select doc_id, {_redacted('text')} as text from documents
), lab as (select doc_id, text, case when {_count(filters.POSITIVE)} > {_count(filters.NEGATIVE)} then 'positive' when {_count(filters.POSITIVE)} < {_count(filters.NEGATIVE)} then 'negative' end as label from red
), kept as (select * from lab where doc_id in (select min(doc_id) from red group by lower({STRIPPED})))"""


@query("transform_chain", f"{_PASSED} select doc_id, label from kept where doc_id in (select doc_id from ({_REJECT.replace('from documents', 'from kept')}) where reason is null)")
def transform_chain(spark, sf_dir):
    return transform.transform(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", longest=4096).select("doc_id", "label")
