"""Contamination, near duplicates, term vectors, fingerprints, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions import patterns, sketch
from sievegate.functions.text import strip, tokens, word_ngrams
from sievegate.operators import decision, gates, similarity, terms
from sievegate.plans import gate
from sievegate.queries.profile import PENALTY, issues_sql
from sievegate.queries.registry import ORACLE, STRIPPED, TOKENS, documents, grams, held, query, table, train

_EXACT = f"""exact as (
  select e.doc_id as eval_id, max(t.doc_id) as train_id from documents e join documents t on {STRIPPED.replace("text", "e.text")} = {STRIPPED.replace("text", "t.text")}
  where e.doc_id % 5 = 0 and t.doc_id % 5 <> 0 group by e.doc_id)"""

_CHARS = f"""c as (select doc_id, lower({STRIPPED}) as t from documents
), g as (select doc_id, list_distinct(case when length(t) >= 3 then list_transform(range(1, length(t) - 1), lambda i: t[i : i + 2]) when t <> '' then [t] else [] end) as g from c
), x as (select doc_id, len(g) as n, unnest(g) as gram from g)"""

_PAIRS = """p as (
  select e.doc_id as eval_id, t.doc_id as train_id, count(*) / (e.n + t.n - count(*)) as s from x e join x t using (gram)
  where e.doc_id % 5 = 0 and t.doc_id % 5 <> 0 and e.doc_id not in (select eval_id from exact) group by e.doc_id, t.doc_id, e.n, t.n)"""

_NEAR = "near as (select eval_id, train_id, s as similarity from p where s >= 0.70 qualify row_number() over (partition by eval_id order by s desc, train_id) = 1)"
_FOUND = f"with {_EXACT}, {_CHARS}, {_PAIRS}, {_NEAR}, found as (select eval_id, train_id, 'exact' as kind, 1.0::double as similarity from exact union all select eval_id, train_id, 'near', similarity from near)"


@query("contamination_exact", f"with {_EXACT} select * from exact")
def contamination_exact(spark, sf_dir):
    return similarity.exact_matches(train(spark, sf_dir), held(spark, sf_dir), "doc_id", strip(F.coalesce(F.col("text"), F.lit(""))))


@query("contamination_matches", f"{_FOUND} select * from found")
def contamination_matches(spark, sf_dir):
    return gates.contamination(train(spark, sf_dir), held(spark, sf_dir))


@query(
    "contamination_gate",
    f"""{_FOUND}, k as (select count(*) filter (where kind = 'exact') as exact, count(*) filter (where kind = 'near') as near, (select count(*) from documents where doc_id % 5 = 0) as eval_rows from found)
select eval_rows, exact, near, exact / eval_rows as exact_fraction, near / eval_rows as near_fraction,
  case when exact / eval_rows > 0 then 'FAIL' when near / eval_rows > 0.15 then 'WARN' else 'PASS' end as status,
  case when exact / eval_rows > 0 then 1 when near / eval_rows > 0.15 then 2 else 0 end as exit_code from k""",
)
def contamination_gate(spark, sf_dir):
    other = held(spark, sf_dir)
    return gates.contamination_status(gates.contamination(train(spark, sf_dir), other), other)


def _family(perms: int) -> str:
    return "[" + ", ".join(f"{{'a': {a}::hugeint, 'b': {b}::hugeint}}" for a, b in sketch.family(perms)) + "]"


def _signatures(perms: int, source: str) -> str:
    """sig(doc_id, sig) from source (doc_id, z: a distinct shingle)."""
    return f"""f as (select unnest(range({perms})) as i, unnest({_family(perms)}) as ab
), h as (select doc_id, ('0x' || substr(sha256(z), 1, 16))::ubigint::hugeint as x from {source}
), m as (select doc_id, i, min((ab.a * x + ab.b) % {sketch.PRIME}::hugeint)::bigint as v from h, f group by doc_id, i
), sig as (select doc_id, list(v order by i) as sig from m group by doc_id)"""


@query(
    "contamination_lsh",
    f"""with {_EXACT}, {_CHARS}, z as (select doc_id, gram as z from x), {_signatures(128, "z")}
, bands as (select doc_id, b, sig[b * 8 + 1 : b * 8 + 8] as k from sig, range(16) r(b)
), cand as (select distinct e.doc_id as eval_id, t.doc_id as train_id from bands e join bands t using (b, k) where e.doc_id % 5 = 0 and t.doc_id % 5 <> 0 and e.doc_id not in (select eval_id from exact)
), p as (select eval_id, train_id, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) as s from cand join g a on a.doc_id = eval_id join g b on b.doc_id = train_id), {_NEAR}
select eval_id, train_id, 'exact' as kind, 1.0::double as similarity from exact union all select eval_id, train_id, 'near', similarity from near""",
)
def contamination_lsh(spark, sf_dir):
    return gates.contamination(train(spark, sf_dir), held(spark, sf_dir), mode="lsh")


_WORD3 = f"w as (select doc_id, {TOKENS} as w from documents), z as (select doc_id, unnest(case when len(w) < 3 then list_distinct(w) else {grams('w', 3)} end) as z from w)"


@query("minhash_signature", f"with {_WORD3}, {_signatures(64, 'z')} select doc_id, sig as signature from sig")
def minhash_signature(spark, sf_dir):
    return sketch.signed(documents(spark, sf_dir), ["doc_id"], word_ngrams(tokens(F.lower("text")), 3), 64).withColumnRenamed("sig", "signature")


@query(
    "near_dup_rows",
    f"""with {_WORD3}, {_signatures(64, "z")}, bands as (select doc_id, b, sig[b * 8 + 1 : b * 8 + 8] as k from sig, range(8) r(b)
), p as (select distinct x.doc_id as a, y.doc_id as b from bands x join bands y using (b, k) where x.doc_id < y.doc_id
), ok as (select a, b from p join sig s on s.doc_id = a join sig t on t.doc_id = b where list_sum(list_transform(range(1, 65), lambda i: (s.sig[i] = t.sig[i])::int)) / 64 >= 0.80)
select a as doc_id from ok union select b from ok""",
)
def near_dup_rows(spark, sf_dir):
    return sketch.near_duplicate_rows(documents(spark, sf_dir), "doc_id", word_ngrams(tokens(F.lower("text")), 3))


@query(
    "benchmark_overlap",
    f"""with b as (select item_id, {grams("w", 8)} as g from (select item_id, {TOKENS} as w from benchmark)
), d as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) as z from (select doc_id, {TOKENS} as w from documents)
), u as (select item_id, len(g) as n, unnest(g) as z from b), m as (select item_id, max(c) as c from (select item_id, doc_id, count(*) as c from u join d using (z) group by item_id, doc_id) group by item_id)
select item_id, case when len(g) > 0 then coalesce(c, 0) / len(g) else 0.0 end as overlap from b left join m using (item_id)""",
)
def benchmark_overlap(spark, sf_dir):
    return gates.overlap(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir), "item_id", "doc_id")


_DRIFT = f"""w as (select doc_id % 5 = 0 as side, {TOKENS} as w from documents), z as (select distinct side, unnest({grams("w", 3)}) as z from w where len(w) >= 3
), sim as (select count(*) filter (where c = 2) / count(*) as similarity from (select z, count(*) as c from z group by z))"""


@query("drift_ngram", f"with {_DRIFT} select similarity from sim")
def drift_ngram(spark, sf_dir):
    return gates.ngram_similarity(train(spark, sf_dir), held(spark, sf_dir))


_SHIFT = """t as (select 'lang' as tag, lang as value, doc_id % 5 = 0 as side from documents union all select 'source', source, doc_id % 5 = 0 from documents
), q as (select tag, value, count(*) filter (where not side) as p, count(*) filter (where side) as q from t where value is not null group by tag, value
), shifts as (select tag, least(1, sum(abs(p / ps - q / qs)) / 2) as shift from (select *, sum(p) over (partition by tag) as ps, sum(q) over (partition by tag) as qs from q) group by tag)"""


@query("tag_shift", f"with {_SHIFT} select tag, shift from shifts")
def tag_shift(spark, sf_dir):
    return gates.tag_shift(train(spark, sf_dir), held(spark, sf_dir), ["lang", "source"])


@query(
    "drift_verdict",
    f"""with {_DRIFT}, {_SHIFT} select similarity, m as max_shift, case when similarity < 0.45 or m > 0.30 then 'FAIL' when similarity < 0.65 or m > 0.15 then 'WARN' else 'PASS' end as status
from sim, (select max(shift) as m from shifts)""",
)
def drift_verdict(spark, sf_dir):
    return gates.drift_verdict(train(spark, sf_dir), held(spark, sf_dir), ["lang", "source"])


_LENGTHS = r"""select len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint as w, row_number() over (order by len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) - 1 as i, count(*) over () as n from documents where coalesce(text, '') <> ''"""


@query(
    "drift_lengths",
    f"""with l as ({_LENGTHS}) select min(w) as min, max(w) filter (where i = n // 2) as median, max(w) filter (where i = n * 95 // 100) as p95,
  max(w) filter (where i = case when n >= 100 then n * 99 // 100 else n - 1 end) as p99, max(w) as max, count(*) as rows, avg(w) as mean from l""",
)
def drift_lengths(spark, sf_dir):
    return gates.drift_lengths(documents(spark, sf_dir))


@query(
    "length_shift",
    f"""with a as ({_LENGTHS} and doc_id % 5 <> 0), b as ({_LENGTHS} and doc_id % 5 = 0), x as (select max(w) filter (where i = n // 2) as m, max(w) filter (where i = n * 95 // 100) as p from a
), y as (select max(w) filter (where i = n // 2) as m, max(w) filter (where i = n * 95 // 100) as p from b)
select 'median' as statistic, (y.m - x.m) / x.m as shift from x, y union all select 'p95', (y.p - x.p) / x.p from x, y""",
)
def length_shift(spark, sf_dir):
    return gates.length_shift(train(spark, sf_dir), held(spark, sf_dir))


@query("hash_sketch", f"select list(h order by h)[1:200] as sketch from (select distinct substr(sha256({STRIPPED}), 1, 16) as h from documents)")
def hash_sketch(spark, sf_dir):
    return sketch.bottom_k(documents(spark, sf_dir), strip(F.coalesce(F.col("text"), F.lit(""))))


def _print(where: str, name: str) -> str:
    return f"""{name}_t as (select {STRIPPED} as text from documents where {where}), {name}_w as (select {TOKENS} as w from {name}_t
), {name}_l as (select len(w)::bigint as w, row_number() over (order by len(w)) - 1 as i, count(*) over () as n from {name}_w
), {name}_z as (select distinct unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else {grams("w", 3)} end) as z from {name}_w
), {name}_s as (select list(v order by i) as signature from (select i, min((ab.a * x + ab.b) % {sketch.PRIME}::hugeint)::bigint as v from (select ('0x' || substr(sha256(z), 1, 16))::ubigint::hugeint as x from {name}_z), f group by i)
), {name}_h as (select list(h order by h)[1:200] as sketch from (select distinct substr(sha256(text), 1, 16) as h from {name}_t)
), {name} as (select count(*) as rows, min(w) as length_min, (max(w) filter (where i = (n - 1) // 2) + max(w) filter (where i = n // 2)) / 2 as length_median, max(w) filter (where i = least(n * 95 // 100, n - 1)) as length_p95, max(w) as length_max,
  (select coalesce(sum(c) filter (where c > 1), 0) / sum(c) from (select count(*) as c from {name}_t group by text)) as exact_dup_rate,
  (select signature from {name}_s) as signature, (select sketch from {name}_h) as sketch from {name}_l)"""


_F128 = f"f as (select unnest(range(128)) as i, unnest({_family(128)}) as ab)"


@query("fingerprint", f"with {_F128}, {_print('true', 'p')} select * from p")
def fingerprint(spark, sf_dir):
    return gates.fingerprint(documents(spark, sf_dir))


@query(
    "fingerprint_diff",
    f"""with {_F128}, {_print('doc_id % 5 <> 0', 'a')}, {_print('doc_id % 5 = 0', 'b')}
select list_sum(list_transform(range(1, 129), lambda i: (a.signature[i] = b.signature[i])::int)) / 128 as similarity, len(list_intersect(a.sketch, b.sketch)) / len(list_distinct(a.sketch || b.sketch)) as sketch_overlap,
  b.rows - a.rows as rows_delta, b.length_min - a.length_min as length_min_delta, b.length_median - a.length_median as length_median_delta, b.length_p95 - a.length_p95 as length_p95_delta,
  b.length_max - a.length_max as length_max_delta, b.exact_dup_rate - a.exact_dup_rate as exact_dup_rate_delta from a, b""",
)
def fingerprint_diff(spark, sf_dir):
    return gates.fingerprint_diff(gates.fingerprint(train(spark, sf_dir)), gates.fingerprint(held(spark, sf_dir)))


_STOP = "[" + ", ".join(f"'{w}'" for w in similarity.STOPWORDS) + "]"
_TERMS = f"""k as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 1 and not list_contains({_STOP}, x)) as w from documents
), tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from k) group by doc_id, term
), idf as (select term, count(*) as df, ln((select count(*) from documents) / count(*)) + 1 as idf from tf group by term having count(*) <= floor((select count(*) from documents) * 0.95))"""


@query("tfidf_idf", f"with {_TERMS} select term, df, round(idf, 9) as idf from idf")
def tfidf_idf(spark, sf_dir):
    return similarity.idf(documents(spark, sf_dir)).select("term", "df", F.round("idf", 9).alias("idf"))


_WEIGHTS = f"""{_TERMS}, top as (select * from idf order by df desc, term limit 10000), raw as (select doc_id, term, (1 + ln(tf)) * idf as w from tf join top using (term)
), wt as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from raw)"""


@query("tfidf_top_terms", f"with {_WEIGHTS} select doc_id, term, rank from (select doc_id, term, row_number() over (partition by doc_id order by round(weight, 9) desc, term) as rank from wt) where rank <= 5")
def tfidf_top_terms(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.round("weight", 9).desc(), "term")
    return similarity.term_weights(documents(spark, sf_dir), "doc_id").select("doc_id", "term", F.row_number().over(order).cast("long").alias("rank")).where("rank <= 5")


@query(
    "semantic_dups",
    f"""with {_WEIGHTS}, p as (select a.doc_id as a, b.doc_id as b from wt a join wt b using (term) where a.doc_id < b.doc_id group by a.doc_id, b.doc_id having sum(a.weight * b.weight) >= 0.90 - 1e-9)
select a as doc_id from p union select b from p""",
)
def semantic_dups(spark, sf_dir):
    return terms.alike_rows(documents(spark, sf_dir), "doc_id", 0.90)


@query(
    "judge_entropy",
    f"with {_WEIGHTS}, n as (select doc_id, weight / sum(weight) over (partition by doc_id) as p, count(*) over (partition by doc_id) as n from wt) select doc_id, round(case when max(n) > 1 then -sum(p * ln(p)) / ln(10000) else 0 end, 9) as entropy from n group by doc_id",
)
def judge_entropy(spark, sf_dir):
    weights = similarity.term_weights(documents(spark, sf_dir), "doc_id")
    total = weights.groupBy("doc_id").agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
    p = F.col("weight") / F.col("s")
    made = weights.join(total, "doc_id").groupBy("doc_id").agg(F.when(F.max("n") > 1, -F.sum(p * F.log(p)) / F.log(F.lit(10000.0))).otherwise(0.0).alias("e"))
    return made.select("doc_id", F.round("e", 9).alias("entropy"))


@query(
    "dense_cosine_pairs",
    "with n as (select min(vec_id) as vec_id, embedding from embeddings group by embedding) select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as cosine from n a join n b on a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.90",
)
def dense_cosine_pairs(spark, sf_dir):
    found = similarity.dense_cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.90)
    return found.select("a", "b", F.round("cosine", 9).alias("cosine"))


_PII_HITS = " + ".join(f"count(*) filter (where regexp_matches(coalesce(text, ''), '{p}'))" for p, _ in patterns.PII.values())
_NEAR_TRAIN = ORACLE["near_dup_rows"].replace("from documents", "from train")


@query(
    "gate",
    f"""with train as (select * from documents where doc_id % 5 <> 0), pii as (select {_PII_HITS} as pii_hits from train), score as ({issues_sql("train", _NEAR_TRAIN)} {PENALTY}
), found as ({ORACLE["contamination_lsh"]}), n as (select count(*) filter (where kind = 'exact') as exact, count(*) filter (where kind = 'near') as near, (select count(*) from documents where doc_id % 5 = 0) as eval_rows from found
), g as (select pii_hits, quality_score as quality, case when exact > 0 then 'FAIL' when near / eval_rows > 0.15 then 'WARN' else 'PASS' end as contamination, exact, near, eval_rows from pii, score, n
), b as (select *, list_filter([case when pii_hits > 0 then 'pii_violation' end, case when contamination = 'FAIL' then 'contamination_fail' end], lambda x: x is not null) as blockers, contamination = 'WARN' as warned from g)
select pii_hits, quality, contamination, exact, near, eval_rows, case when len(blockers) > 0 then 'DONT_SHIP' when warned then 'INVESTIGATE' else 'SHIP' end as recommendation, case when len(blockers) > 0 then 1 when warned then 2 else 0 end as exit_code,
  round(case when len(blockers) > 0 then least(0.3, 0.1 * len(blockers)) when warned then 0.7 else 0.92 end::double, 2) as confidence, blockers, case when warned then list_append(blockers, 'contamination_warn') else blockers end as flags from b""",
)
def full_gate(spark, sf_dir):
    return gate.run(train(spark, sf_dir), held(spark, sf_dir), decision.Criteria(max_pii_hits=0, min_f1=0.6), f1=0.7)


@query("topics")
def topic_terms(spark, sf_dir):
    from sievegate.operators import topics

    return topics.topics(topics.assign(documents(spark, sf_dir), "doc_id"))
