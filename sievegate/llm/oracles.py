"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import url_filter

SQL: dict[str, str] = {}

#: The contract's rules.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

SQL["op1_decontaminate"] = r"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents
), b as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w, least(5, len(w)) as k from benchmark
), items as (
  select item_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')))) as g from b where len(w) > 0
), sizes as (select item_id, count(*) as n from items group by item_id
), held as (
  select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as g
  from d, (select distinct k from items) where len(w) >= k
)
select doc_id, item_id, n as n_shingles, count(*) as n_matched, count(*) / n as containment
from held join items using (k, g) join sizes using (item_id) group by doc_id, item_id, n having count(*) * 100 >= n * 80
"""

SQL["op2_ngram_join"] = r"""
with recursive toks as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) end as s from toks
), grams as (select doc_id, len(s) as n, unnest(s) as g from sets
), pairs as (
  select a.doc_id as x, b.doc_id as y from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links as (select x, y from pairs union all select y, x from pairs
), reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce((select min(y) from reach r where r.x = doc_id), doc_id)) as component_id from sets
"""


def _matches(kind: str, pattern: str) -> str:
    return f"""
  select doc_id, t, '{kind}' as kind, h[i] as hit, (list_sum(g[1:i]) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::bigint as s
  from (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{pattern}') as h,
          list_transform(string_split_regex(coalesce(text, ''), '{pattern}'), lambda x: length(x)) as g from documents), unnest(range(1, len(h) + 1)) r(i)"""


#: The contract's own patterns, and the two added kinds.
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}

SQL["op5_pii"] = (
    "with m as (" + "\n  union all".join(_matches(k, p) for k, p in _PII.items()) + r"""
), v as (
  select doc_id, t, kind, hit, s, s + length(hit) as e, regexp_replace(hit, '[^0-9]', '', 'g') as d, replace(hit, ' ', '') as c,
    case when s > 0 then t[s] else '' end as before, t[s + length(hit) + 1] as after, lower(t[greatest(s - 40, 0) + 1 : s]) as near from m
), ok as (
  select doc_id, kind, s, e from v where case kind
    when 'email' then true
    when 'ip' then list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3 and coalesce(try_cast(ltrim(p, '0') as int), 0) <= 255))
    when 'card' then length(d) between 16 and 19 and list_sum(list_transform(range(length(d)), lambda i:
      case when i % 2 = 0 then d[length(d) - i]::int when d[length(d) - i]::int > 4 then d[length(d) - i]::int * 2 - 9 else d[length(d) - i]::int * 2 end)) % 10 = 0
    when 'phone' then length(d) between 8 and 15
    when 'iban' then not regexp_matches(before, '[A-Za-z0-9]') and not regexp_matches(after, '[A-Za-z0-9]') and length(c) between 15 and 34 and
      list_reduce(list_prepend(0, list_transform(range(1, length(c) + 1), lambda i: ascii((c[5:] || c[1:4])[i]))), lambda a, x: case when x < 58 then (a * 10 + x - 48) % 97 else (a * 100 + x - 55) % 97 end) = 1
    else not regexp_matches(before, '[0-9-]') and not regexp_matches(after, '[0-9-]') and hit[1:3] not in ('000', '666') and hit[1:3] < '900'
      and hit[5:6] <> '00' and hit[8:11] <> '0000' and regexp_matches(near, '(?:^|[^a-z])(?:ssn|social security|tax id)') end
), k as (select *, list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn'], kind) as o, kind || ':' || s || ':' || e as p from ok)
select d.doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip,
  count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone,
  sha256(coalesce(string_agg(p, ',' order by o, s) filter (where o <= 4), '')) as base_sha256, coalesce(string_agg(p, ',' order by o, s), '') as spans
from documents d left join k on d.doc_id = k.doc_id group by d.doc_id
"""
)

SQL["op7_sharding"] = """
with recursive crc(i, step, v) as (
  select i, 0, i::ubigint from range(256) t(i)
  union all
  select i, step + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end from crc where step < 8
), tab as (select list(v order by i) as t from crc where step = 8),
draws as (
  select doc_id, max(s) filter (where s < 24) as ignored,
         arg_max(s, md5(coalesce(doc_id::varchar, 'null') || ':' || s)) filter (where s < 24) as shard,
         arg_max(s, md5(coalesce(doc_id::varchar, 'null') || ':' || s)) as grown_shard
  from (select distinct doc_id from documents), range(25) r(s) group by doc_id
), sized as (
  select d.doc_id, n + 8 as size,
    xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(n), lambda k: ('0x' || hx[2 * k + 1 : 2 * k + 2])::ubigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint)::bigint as text_crc32,
    w.shard::int as shard, w.grown_shard::int as grown_shard,
    substr(md5(coalesce(d.doc_id::varchar, 'null') || ':lane'), 1, 3) as lane
  from (select doc_id, hex(encode(coalesce(text, ''))) as hx, octet_length(encode(coalesce(text, '')))::bigint as n from documents) d
  join draws w on d.doc_id is not distinct from w.doc_id, tab
)
select doc_id, size, text_crc32, 'key' as law, shard,
  (row_number() over (partition by shard order by lane, doc_id, text_crc32) - 1)::bigint as slot, grown_shard
from sized
"""

SQL["op10_suffix_dedup"] = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as hx, octet_length(encode(coalesce(text, '')))::bigint as n_bytes from documents
), w as (select doc_id, i, hx[2 * i + 1 : 2 * i + 100] as s from b, unnest(range(greatest(n_bytes - 49, 0))) r(i)
), m as (select s, min(doc_id) as first from w group by s having min(doc_id) < max(doc_id)
), h as (select w.doc_id, w.i, lag(w.i) over (partition by w.doc_id order by w.i) as p from w join m using (s) where first < w.doc_id
), g as (select doc_id, i, sum((p is null or i > p + 50)::int) over (partition by doc_id order by i) as span, least(50, coalesce(i - p, 50)) as fresh from h
), spans as (select doc_id, span, min(i) as a, max(i) + 50 as z, sum(fresh) as fresh from g group by doc_id, span
), cut as (select doc_id, span, a, z, fresh, coalesce(lag(z) over (partition by doc_id order by a), 0) as after from spans
), kept as (select doc_id, sum(fresh)::bigint as n_removed, count(*) as n_spans, string_agg(hx[2 * after + 1 : 2 * a], '' order by a) as head, max(z) as z from cut join b using (doc_id) group by doc_id)
select doc_id, n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(head || hx[2 * z + 1 : 2 * n_bytes], hx))) as kept_sha256
from b left join kept using (doc_id)
"""


def url_filter_sql() -> str:
    """The rules as given, longest first, then the model's weights on the buckets of the URL's n-grams."""
    model = url_filter.standard()
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda out: "case " + " ".join(f"when (host = '{on}' or ends_with(host, '.{on}')) and starts_with(path, '{start}') then '{out(verdict, on, start)}'" for verdict, on, start in rules) + " end"
    low = f"'{url_filter.UPPER}', '{url_filter.UPPER.lower()}'"
    grams = " || ".join(f"case when length(t) >= {n} then list_transform(range(1, length(t) - {n - 2}), lambda i: ('0x' || substring(md5(substring(t, i, {n})), 1, {url_filter.DIGITS}))::int) else [] end" for n in url_filter.GRAMS)
    return f"""
with h as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {low}) as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages
), t as (select *, '^' || host || regexp_replace(translate(path, {low}), '[0-9]+', '0', 'g') || '$' as t from h
), b as (select *, list_distinct({grams}) as b from t
), s as (select *, 1 / (1 + exp(-(coalesce(list_sum(list_transform(b, lambda x: {list(model.weights)}[x + 1])), 0) / {float(url_filter.UNIT)} / sqrt(greatest(len(b), 1)) + {model.bias}))) as score from b)
select page_id, host, path, {fits(lambda verdict, on, start: on + start)} as rule, coalesce({fits(lambda verdict, on, start: verdict)}, case when score >= 0.5 then 'block' else 'allow' end) as verdict, round(score, 9) as score from s
"""
