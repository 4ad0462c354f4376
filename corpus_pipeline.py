"""A corpus from raw documents to tokens: five stages over the columns of documents.

Each stage works on all that the one before kept. Extra columns pass through the first four stages.
Stages that filter judge rows; a doc_id may be missing or repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegate.llm import bpe, decontaminate, langid, ngram_join, pii_spans
from sievegate.llm.common import forget, side, written

#: Language identification can't be written in SQL, so run()'s rows can't either; tests hold each stage against brute force.
ORACLE_SQL = None


def _new(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter that are not unlike every language, as far as their length lets that be told.

    Languages and the likeness a document must reach for its length are learned from all rows that have a
    language; where lang is null the found one is filled in. Where nothing is learned only texts without a
    letter go.
    """
    profiles = langid.train(docs)
    if not profiles.names:
        return docs.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    found, like = _new(docs, "lang"), _new(docs, "like")
    told = langid.predict(docs, profiles, lang=found, score=like, floor=langid.floors(docs, profiles))
    return told.where(F.col(found) != langid.UNKNOWN).withColumn("lang", F.coalesce("lang", found)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least row of each group of near duplicates: word 5-shingles, Jaccard of 0.8 or more.

    Rows are ordered by doc_id, those without one last, then by a digest of the text; each is compared by
    its own text. Equal rows of one doc_id are one row. Rows with neither a doc_id nor a word are in no
    group and stay.
    """
    bare = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^ \t-\r]")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("text"))
    key = _new(docs, "row")
    rows = docs.where(~bare).withColumn(key, row)
    groups = ngram_join.near_groups(rows.select(key, "text"), key=key, words=5, num=80, den=100).withColumnRenamed(key, "at")
    # the texts are joined with the few keys that go or come more than once, so others needn't be moved
    marks = groups.groupBy("at").agg(F.max(F.col("at") != F.col("component_id")).alias("goes"), F.count("*").alias("n")).where("goes or n > 1")
    marks = written(marks.select(F.col("at").alias(key), "goes"))
    once = rows.join(side(marks.select(key), 64), key, "left_anti")
    number = _new(docs, "number")
    same = Window.partitionBy(key).orderBy(key)
    more = rows.join(side(marks.where("not goes").select(key), 64), key, "left_semi").withColumn(number, F.row_number().over(same)).where(F.col(number) == 1)
    return once.select(*docs.columns).unionByName(more.select(*docs.columns)).unionByName(docs.where(bare).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold less than 0.8 of the word 5-shingles of every benchmark item. Each is judged by its own text, whatever its doc_id."""
    key = _new(docs, "digest")
    rows = docs.withColumn(key, F.unhex(F.sha2("text", 256)))
    found = decontaminate.find(rows.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key)
    held = written(found.select(key).distinct())
    return rows.join(side(held, 64), key, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data as its kind in brackets; n_chars follows the text."""
    return pii_spans.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (of the bytes that the ids decode to) of all documents."""
    path, pattern = bpe.vocabulary()
    made = bpe.encode(docs, "doc_id", path, pattern, offsets=False, decoded=True)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; each stage before it is written to the shared folder and reread, and then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
