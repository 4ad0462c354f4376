"""Synthetic question-answer rows: filters, answers against a human set, splits, gaps between models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.functions.text import tokens
from sievegate.operators import gates, similarity
from sievegate.operators.stats import order_stats


def rejection(df: DataFrame, seeds: DataFrame, key: str, question: str = "question", answer: str = "answer", min_question: int = 10, min_answer: int = 3, max_answer: int = 200, most_overlap: float = 0.3, n: int = 8, near: float = 0.7) -> DataFrame:
    """key, reason: why a row goes, null for those that stay.

    question_too_short, answer_too_short, answer_too_long count words. ngram_overlap: a seed's question holds
    more than most_overlap of the question's n-grams. exact_duplicate, near_duplicate: in order of key, a kept
    row has the question and answer, or a question whose set of words has a Jaccard of near or more. Overlap is judged before copies,
    so a row that fails both is named by it; which rows stay is the same in either order.
    """
    q, a = F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(answer), F.lit(""))
    rows = df.select(F.col(key).alias("key"), q.alias("text"), F.sha2(F.concat_ws("|||", q, a), 256).alias("h"), F.size(tokens(q)).alias("n_q"), F.size(tokens(a)).alias("n_a"))
    short = F.when(F.col("n_q") < min_question, "question_too_short").when(F.col("n_a") < min_answer, "answer_too_short").when(F.col("n_a") > max_answer, "answer_too_long")
    rows = rows.withColumn("length", short)
    fit = rows.where("length is null")
    other = seeds.select(F.monotonically_increasing_id().alias("seed"), F.col(question).alias("text"))
    held = gates.overlap(fit, other, "key", "seed", n=n).where(F.col("overlap") > most_overlap).select("key")
    fresh = fit.join(held, "key", "left_anti")
    words = F.array_distinct(tokens(F.lower("text")))
    kept = similarity.fuzzy_dedupe(fresh, "key", words, near).select(F.col("id").alias("first"), F.lit(True).alias("stays"))
    first = fresh.groupBy("h").agg(F.min("key").alias("first")).join(kept, "first", "left")
    copies = fresh.select("key", "h").join(first, "h").select("key", F.when(F.col("stays") & (F.col("key") == F.col("first")), F.lit(None)).when(F.col("stays"), "exact_duplicate").otherwise("near_duplicate").alias("copy"))
    judged = rows.select("key", "length").join(held.withColumn("held", F.lit("ngram_overlap")), "key", "left").join(copies, "key", "left")
    return judged.select(F.col("key").alias(key), F.coalesce("length", "held", "copy").alias("reason"))


def answer_difference(rows: DataFrame, human: DataFrame, order: str, question: str = "question", answer: str = "answer", most_same: float = 0.1) -> DataFrame:
    """One row: matched, different, same, warning over the rows whose question a human row has; of its answers that of the greatest order counts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = human.select(F.sha2(text(question), 256).alias("h"), text(answer).alias("human"), order).groupBy("h").agg(F.max_by("human", order).alias("human"))
    both = rows.select(F.sha2(text(question), 256).alias("h"), text(answer).alias("own")).join(known, "h")
    one = both.agg(F.count("*").alias("matched"), F.count(F.when(F.col("own") != F.col("human"), 1)).alias("different"))
    same = F.col("matched") - F.col("different")
    return one.select("matched", "different", same.alias("same"), (same > F.col("matched") * most_same).alias("warning"))


def contaminated_split(df: DataFrame, key: str, share: float, question: Column, context: Column, answer: Column) -> DataFrame:
    """key, contamination, content_hash: the first int(share * rows) rows by key, which is unique, are pure_ai, the others paraphrased.

    The last key of the first part is found as an order statistic, so no task numbers all rows.
    """
    last = order_stats(df, F.col(key), {"last": f"floor(n * {share!r}D) - 1"})
    parts = [F.coalesce(c, F.lit("")) for c in (question, context, answer)]
    rows = df.select(F.col(key), F.sha2(F.concat_ws("|||", *parts), 256).alias("content_hash")).crossJoin(F.broadcast(last))
    first = F.coalesce(F.col(key) <= F.col("last"), F.lit(False))
    return rows.select(key, F.when(first, "pure_ai").otherwise("paraphrased").alias("contamination"), "content_hash")


def performance_gap(scores: DataFrame, model: str, metric: str, order: str) -> DataFrame:
    """model, metric, gap: the metric less the baseline's, which is the first model named human, or else the first."""
    human = F.coalesce(F.contains(F.lower(F.col(model)), F.lit("human")), F.lit(False))
    base = scores.agg(F.min_by(metric, F.struct((~human).alias("other"), F.col(order).alias("at"))).alias("base"))
    return scores.crossJoin(F.broadcast(base)).select(model, metric, (F.col(metric) - F.col("base")).alias("gap"))
