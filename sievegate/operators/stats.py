"""Profiles of a dataset: order statistics, fields, vocabulary, duplicates, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.functions.text import strip, tokens


#: Parts of a group's values that are sorted apart.
PARTS = 64


def order_stats(df: DataFrame, value: Column, picks: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """One row for each group of by: the values at the given places (SQL over n, from 0) of the sorted values, exactly.

    Values (numbers or times) are counted first, so the running sum sees a row for each distinct value and not for each row; approximate
    percentiles then cut a group into PARTS ranges that are sorted apart. The cuts are the same for equal values, so they move no place.
    """
    by = by or []
    counts = df.select(*by, value.alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("c"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 1000).alias("cuts"))
    own = cuts.select(*[F.col(c).alias(f"__{c}") for c in by], "cuts")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    ranged = counts.join(own, same) if by else counts.crossJoin(F.broadcast(own))
    ranged = ranged.select(*by, "v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("part"))
    # a group has PARTS ranges at most, so numbering them takes no long sort
    every = Window.partitionBy(*(by or [F.lit(0)]))
    before = ranged.groupBy(*by, "part").agg(F.sum("c").alias("size")).withColumn("n", F.sum("size").over(every)).withColumn("before", F.sum("size").over(every.orderBy("part")) - F.col("size"))
    before = before.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("part").alias("__part"), "n", "before")
    inner = Window.partitionBy(*by, "part").orderBy("v")
    placed = ranged.withColumn("inside", F.sum("c").over(inner)).join(before, [*same, F.col("part") == F.col("__part")]).withColumn("upto", F.col("before") + F.col("inside"))
    out = [F.max(F.when((F.col("upto") > F.expr(at)) & (F.col("upto") - F.col("c") <= F.expr(at)), F.col("v"))).alias(name) for name, at in picks.items()]
    return placed.groupBy(*by).agg(*out)


def field_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """field, present, empty, avg_len: non-null rows, blank ones, mean length of the others to one place."""
    columns = columns or [c for c in df.columns if c != "tags"]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    blank = strip(F.col("value")) == ""
    return rows.groupBy("field").agg(
        F.count("value").alias("present"),
        F.count(F.when(blank, 1)).alias("empty"),
        F.round(F.coalesce(F.avg(F.when(~blank, F.length("value"))), F.lit(0.0)), 1).alias("avg_len"),
    )


def vocab_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """One row of token and length figures over lower-cased white-space tokens."""
    rows = df.select(tokens(F.lower(F.col(text))).alias("w"))
    words = rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    vocab = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total_tokens"), F.count("*").alias("unique_tokens"), F.count(F.when(F.col("c") == 1, 1)).alias("hapax_legomena"))
    lengths = order_stats(rows, F.size("w").cast("long"), {"length_median": "floor(n / 2)", "length_p95": "case when n >= 20 then floor(n * 0.95) else n - 1 end"})
    sums = rows.agg(F.avg(F.size("w")).alias("mean"), F.min(F.size("w")).cast("long").alias("length_min"), F.max(F.size("w")).cast("long").alias("length_max"))
    return vocab.crossJoin(lengths).crossJoin(sums).select(
        "total_tokens", "unique_tokens", "hapax_legomena",
        F.expr("round(try_divide(unique_tokens, total_tokens), 4)").alias("type_token_ratio"),
        F.expr("round(try_divide(hapax_legomena, unique_tokens), 4)").alias("hapax_ratio"),
        F.round("mean", 1).alias("length_mean"), "length_median", "length_p95", "length_min", "length_max",
    )


def length_report(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, measure (tokens or characters), min, median, p95, max over non-blank values; the median is the lower-rounded mean of the middle two."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*").where(strip(F.col("value")) != "")
    rows = rows.select("field", F.explode(F.create_map(F.lit("tokens"), F.size(tokens(F.col("value"))).cast("long"), F.lit("characters"), F.length("value").cast("long"))).alias("measure", "v"))
    found = order_stats(rows, F.col("v"), {"min": "0", "low": "floor((n - 1) / 2)", "high": "floor(n / 2)", "p95": "least(floor(n * 95 / 100), n - 1)", "max": "n - 1"}, ["field", "measure"])
    return found.select("field", "measure", "min", F.floor((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "max")


def duplicate_rates(df: DataFrame, text: str = "text") -> DataFrame:
    """variant, rows, duplicates, rate: surplus rows (total less distinct), all rows of repeated texts, and rows after a text's first."""
    counts = df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h")).agg(F.count("*").alias("c"))
    one = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("members"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("later"))
    kinds = F.array(*[F.struct(F.lit(n).alias("variant"), x.alias("duplicates")) for n, x in (("surplus", F.col("rows") - F.col("distinct")), ("members", F.col("members")), ("later", F.col("later")))])
    return one.select("rows", F.explode(kinds).alias("k")).select("k.variant", "rows", "k.duplicates", F.expr("try_divide(k.duplicates, rows)").alias("rate"))


def tag_distribution(df: DataFrame, tags: list[str]) -> DataFrame:
    """tag, value, n over the rows where the tag is present."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for t in tags])).alias("x")).select("x.*")
    return rows.where("value is not null").groupBy("tag", "value").agg(F.count("*").alias("n"))


def keep_first(df: DataFrame, order: str, text: str = "text") -> DataFrame:
    """The rows whose text (stripped, lower case) has no earlier row, by order; columns of df.

    The first of each text is found by an aggregate over hashes, combined before the shuffle.
    """
    keyed = df.withColumn("__h", F.sha2(strip(F.lower(F.coalesce(F.col(text), F.lit("")))), 256))
    first = keyed.groupBy("__h").agg(F.min(order).alias("__first"))
    return keyed.join(first, "__h").where(F.col(order) == F.col("__first")).select(*df.columns)


def blanks(df: DataFrame) -> DataFrame:
    """cells, blank: how many cells there are and how many are null or blank."""
    empty = [F.sum(F.when(F.coalesce(strip(F.col(c).cast("string")), F.lit("")) == "", 1).otherwise(0)) for c in df.columns]
    return df.agg((F.count("*") * len(df.columns)).alias("cells"), F.coalesce(sum(empty[1:], empty[0]), F.lit(0)).cast("long").alias("blank"))
