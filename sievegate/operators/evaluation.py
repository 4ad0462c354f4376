"""Scores of predictions against references, by row, slice and class."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegate.functions.text import let, normalise


def _words(text: Column, how: str) -> Column:
    return F.filter(F.split(normalise(text, how), " "), lambda t: t != "")


def exact_match(prediction: Column, reference: Column, how: str = "punctuation") -> Column:
    return (normalise(prediction, how) == normalise(reference, how)).cast("double")


def _numbered(words: Column) -> Column:
    """Each word with how many equal ones stand before it, so that multisets meet as sets."""

    def number(s: Column) -> Column:
        return F.transform(s, lambda w, i: F.concat_ws("\x01", w, (i - F.array_position(s, w)).cast("string")))

    return let(F.array_sort(words), number)


def token_f1(prediction: Column, reference: Column, how: str = "punctuation") -> Column:
    """F1 of the words as multisets; 1 if both have none, 0 if one has none."""

    def score(x: Column) -> Column:
        p, r = F.size(x["p"]), F.size(x["r"])
        shared = F.size(F.array_intersect(_numbered(x["p"]), _numbered(x["r"])))
        return F.when((p == 0) & (r == 0), 1.0).when((p == 0) | (r == 0), 0.0).otherwise(let(shared, lambda s: F.when(s == 0, 0.0).otherwise(2 * (s / p) * (s / r) / (s / p + s / r))))

    return let(F.struct(_words(prediction, how).alias("p"), _words(reference, how).alias("r")), score)


def token_f1_sets(prediction: Column, reference: Column) -> Column:
    """F1 with the number of distinct shared words over the words' counts, after the "squad" normaliser."""

    def score(x: Column) -> Column:
        p, r = F.size(x["p"]), F.size(x["r"])
        shared = F.size(F.array_intersect(x["p"], x["r"]))
        return F.when((p == 0) | (r == 0), (p == r).cast("double")).otherwise(let(shared, lambda s: F.when(s == 0, 0.0).otherwise(2 * (s / p) * (s / r) / (s / p + s / r))))

    return let(F.struct(_words(prediction, "squad").alias("p"), _words(reference, "squad").alias("r")), score)


def bleu(prediction: Column, reference: Column, most: int = 4) -> Column:
    """Geometric mean of clipped n-gram precisions to 4 with brevity penalty; 0 where an order has no match or the prediction no such n-gram."""

    def score(x: Column) -> Column:
        p, r = F.size(x["p"]), F.size(x["r"])

        def grams(words: Column, n: int) -> Column:
            return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))).otherwise(F.array().cast("array<string>"))

        hits = F.array(*[F.size(F.array_intersect(_numbered(grams(x["p"], n)), _numbered(grams(x["r"], n)))) for n in range(1, most + 1)])

        def mean(h: Column) -> Column:
            logs = F.aggregate(F.transform(h, lambda c, i: F.log(c / (p - i))), F.lit(0.0), lambda s, v: s + v) / most
            return F.when((p < most) | F.exists(h, lambda c: c == 0), 0.0).otherwise(F.when(p < r, F.exp(1 - r / p)).otherwise(1.0) * F.exp(logs))

        return let(hits, mean)

    return let(F.struct(_words(prediction, "punctuation").alias("p"), _words(reference, "punctuation").alias("r")), score)


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(b))}
    y = np.array([codes[w] for w in b])
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for w in a:
        if w in codes:
            new = np.maximum(row[1:], np.where(y == codes[w], row[:-1] + 1, 0))
            row = np.concatenate(([0], np.maximum.accumulate(new)))
    return int(row[-1])


@F.pandas_udf(T.DoubleType())
def _rouge(p: pd.Series, r: pd.Series) -> pd.Series:
    def one(a: list[str], b: list[str]) -> float:
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        n = _common(list(a), list(b))
        return 2 * n / (len(a) + len(b))

    return pd.Series([one(a, b) for a, b in zip(p, r, strict=True)])


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of words; 1 if both have none."""
    return _rouge(_words(prediction, "punctuation"), _words(reference, "punctuation"))


def rouge_1(prediction: Column, reference: Column) -> Column:
    """Unigram F1, which is token_f1."""
    return token_f1(prediction, reference)


def length_ratio(prediction: Column, reference: Column) -> Column:
    """Words of the prediction over the reference's; infinite for an empty reference, 0 if both are empty."""
    p, r = F.size(_words(prediction, "punctuation")), F.size(_words(reference, "punctuation"))
    return F.when(r == 0, F.when(p == 0, 0.0).otherwise(float("inf"))).otherwise(p / F.greatest(r, F.lit(1)))


def confusion(df: DataFrame, reference: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(reference).alias("reference"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, reference: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 of every label on either side; a division by zero is 0."""
    cells = confusion(df, reference, predicted)
    rows = cells.select(F.explode(F.array(F.struct(F.col("reference").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given")))).alias("x"), F.when(F.col("reference") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    by = rows.groupBy("x.label").agg(F.sum("x.support").alias("support"), F.sum("x.given").alias("given"), (F.sum("hit") / 2).cast("long").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.expr(f"try_divide({a}, {b})"), F.lit(0.0))
    return by.select("label", "support", ratio("hit", "given").alias("precision"), ratio("hit", "support").alias("recall"), ratio("2 * hit", "support + given").alias("f1"))


def slices(df: DataFrame, tag: str, metrics: list[str]) -> DataFrame:
    """slice, n and the means of the metrics by a tag's value, _untagged where it is null."""
    return df.groupBy(F.coalesce(F.col(tag).cast("string"), F.lit("_untagged")).alias("slice")).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def hardest(df: DataFrame, score: str, key: list[str], n: int = 50) -> DataFrame:
    """The n rows of the lowest score, ranked from 1; ties by key."""
    least = df.orderBy(score, *key).limit(n)
    return least.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(score, *key)).cast("long"))
