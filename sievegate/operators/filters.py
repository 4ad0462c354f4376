"""The transform chain: ordered filters, heuristic labels, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.functions.patterns import REDACT
from sievegate.functions.text import let, strip, tokens

#: Words that count for a label wherever they stand in a text.
POSITIVE = ["great", "good", "excellent", "amazing", "love", "wonderful", "fantastic"]
NEGATIVE = ["bad", "terrible", "awful", "horrible", "hate", "worst", "poor"]


def bad_characters(text: Column) -> Column:
    """Whether 30 % or more of the characters are neither letters, digits, spaces nor common punctuation."""
    odd = F.length(F.regexp_replace(text, r"""[a-zA-Z0-9\s.,!?;:'"()\-/]""", ""))
    return F.when(F.length(text) > 0, odd / F.length(text) >= 0.3).otherwise(True)


def repetitive(text: Column) -> Column:
    """In a text of five words or more: a word makes up more than 40 %, or a 3-gram occurs more than max(3, 20 %) times."""

    def most(values: Column) -> Column:
        """The largest number of equal elements: in a sorted array, of the longest run."""
        return F.aggregate(
            F.array_sort(values),
            F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best")),
            lambda a, x: let(F.when(a["at"] == x, a["run"] + 1).otherwise(1), lambda run: F.struct(x.alias("at"), run.alias("run"), F.greatest(a["best"], run).alias("best"))),
            lambda a: a["best"],
        )

    def judge(w: Column) -> Column:
        word = most(F.transform(w, lambda x: F.xxhash64(x)))
        triples = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 5, F.lit(False)).otherwise((word / F.size(w) > 0.4) | (most(triples) > F.greatest(F.lit(3.0), (F.size(w) - 2) * 0.2)))

    return let(tokens(F.lower(text)), judge)


def rejection(text: Column, shortest: int = 20, longest: int = 512, leaked: Column | None = None) -> Column:
    """The first filter that a text fails, or null: empty, too_short, too_long, bad_chars, repetitive, leakage, pii."""
    body = F.coalesce(text, F.lit(""))
    chain = (
        F.when(strip(body) == "", "empty")
        .when(F.length(body) < shortest, "too_short")
        .when(F.length(body) > longest, "too_long")
        .when(bad_characters(body), "bad_chars")
        .when(repetitive(body), "repetitive")
    )
    if leaked is not None:
        chain = chain.when(leaked, "leakage")
    pii = None
    for pattern in REDACT.values():
        pii = body.rlike(pattern) if pii is None else pii | body.rlike(pattern)
    return chain.when(pii, "pii")


def leaked(df: DataFrame, seeds: DataFrame, key: str, text: str = "text", least: float = 0.9) -> DataFrame:
    """key of the rows whose lower-cased, stripped text is a seed's, or more than least of whose distinct words one seed has.

    Words are matched through an index; words that many seeds have still give a count for each pair
    that shares them, so seeds should be a small table.
    """
    low = strip(F.lower(F.coalesce(F.col(text), F.lit(""))))
    rows = df.select(F.col(key).alias("key"), low.alias("t"))
    seed = seeds.select(strip(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("t")).where("t <> ''").distinct()
    same = rows.join(seed, "t", "left_semi").select("key")
    words = rows.select("key", F.explode(F.array_distinct(tokens(F.col("t")))).alias("w"))
    size = words.groupBy("key").agg(F.count("*").alias("n"))
    index = seed.select(F.sha2("t", 256).alias("seed"), F.explode(F.array_distinct(tokens(F.col("t")))).alias("w"))
    shared = words.join(index, "w").groupBy("key", "seed").agg(F.count("*").alias("m"))
    near = shared.join(size, "key").where(F.col("m") / F.col("n") > least).select("key")
    return same.unionByName(near).distinct().select(F.col("key").alias(key))


def sentiment(text: Column) -> Column:
    """positive or negative by which list has more words within the text, null at a tie."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("int"))
    return F.when(count(POSITIVE) > count(NEGATIVE), "positive").when(count(POSITIVE) < count(NEGATIVE), "negative")


def question_answer(text: Column) -> Column:
    """struct<question, answer> of a "Q: ... A: ..." text, else of the first line with a question mark and the line after it, else null."""
    pattern = r"(?is)(?:Q|Question|Ask)[:\s]+(.+?)(?:\n|$)\s*(?:A|Answer|Response)[:\s]+(.+)"
    body = F.coalesce(text, F.lit(""))
    pair = lambda q, a: F.struct(strip(q).alias("question"), strip(a).alias("answer"))
    lines = F.split(strip(body), "\n")

    def by_line(x: Column) -> Column:
        at = F.array_min(F.filter(F.transform(x, lambda line, i: F.when(F.contains(line, F.lit("?")) & (i + 1 < F.size(x)), i)), lambda i: i.isNotNull()))
        return F.when(at.isNotNull(), pair(F.get(x, at), F.get(x, at + 1)))

    return F.when(body.rlike(pattern), pair(F.regexp_extract(body, pattern, 1), F.regexp_extract(body, pattern, 2))).otherwise(let(lines, by_line))
