"""The issues of a dataset and the two scores made of them, with every check."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievegate.functions.sketch import near_duplicate_rows
from sievegate.functions.text import tokens, word_ngrams
from sievegate.operators import quality, stats, terms
from sievegate.queries import similarity as _  # noqa: F401  its oracles are parts of those here
from sievegate.queries.profile import PENALTY, VOCAB, issues_sql
from sievegate.queries.registry import ORACLE, documents, query
from sievegate.sources.sinks import written

_ISSUES = issues_sql("documents", ORACLE["near_dup_rows"], ORACLE["semantic_dups"], "lang")


def found(docs):
    """All checks; the language stands for a class."""
    near = near_duplicate_rows(docs, "doc_id", word_ngrams(tokens(F.lower("text")), 3))
    alike = terms.alike_rows(docs, "doc_id", 0.90)
    return quality.issues(docs, "doc_id", near=near, semantic=alike, label="lang")


@query("quality_issues", f"{_ISSUES} select * from i")
def quality_issues(spark, sf_dir):
    return found(documents(spark, sf_dir))


@query("quality_score", f"{_ISSUES} {PENALTY}")
def quality_score(spark, sf_dir):
    return quality.penalty_score(found(documents(spark, sf_dir)))


def _learned_sql() -> str:
    share = lambda c: f"coalesce((select max(fraction) from i where category = '{c}'), 0)"
    x = [y for c in quality.CATEGORIES for y in (f"({share(c)} > 0)::int", share(c))]
    x += [f"(select count(*) from i where severity = '{s}')" for s in quality.SEVERITY] + ["(select count(*) from i)", "type_token_ratio", "hapax_ratio", "ln(1 + total_tokens)"]
    x += ["case when length_mean > 0 and length_max > length_min then (length_max - length_min) / 4.0 / length_mean else 0 end", "ln(1 + (select count(*) from documents))", "1.0"]
    x += [share("semantic_duplicate"), "0.0", "0.0"]
    z = " + ".join(f"({w}) * {v}" for w, v in zip(quality.WEIGHTS, x, strict=True))
    return f"{_ISSUES} select floor(100 / (1 + exp(-({z}))))::bigint as learned_score from ({VOCAB})"


@query("learned_score", _learned_sql())
def learned_score(spark, sf_dir):
    docs = documents(spark, sf_dir)
    issues = written(found(docs))
    semantic = issues.where("category = 'semantic_duplicate'").agg(F.coalesce(F.max("fraction"), F.lit(0.0))).first()[0]
    return quality.learned_score(issues, stats.vocab_stats(docs), docs.count(), semantic=semantic)
