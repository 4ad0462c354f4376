"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, decontaminate, langid, ngram_join, oracles, pii_spans, quality, sharding, spotsigs, suffix_dedup, url_filter


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(documents(spark, sf_dir), words=4, num=85, den=100)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs, labels.where(quality.fold(F.col("doc_id"), 5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.train(docs.where(quality.fold(F.col("doc_id"), 4) != 2))
    guessed = langid.predict(docs.select("doc_id", "text"), profiles)
    return guessed.select("doc_id", (quality.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans.find(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    places = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.transform(F.filter("spans", lambda s: s["kind"].isin(*pii_spans.BASE)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    number = [(F.size("spans") - F.size(F.array_remove("spans.kind", k))).cast("long").alias(f"n_{k}") for k in pii_spans.BASE]
    return found.select("doc_id", *number, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(places, ",").alias("spans"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, oracles.URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir), "doc_id", 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spotsigs.compare_next(documents(spark, sf_dir))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("signatures")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = bpe.vocabulary()
    made = bpe.encode(documents(spark, sf_dir), "doc_id", path, pattern, offsets=False, decoded=True, splits=True)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
        "n_split",
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_ngram_join": op2_ngram_join,
        "op3_quality": op3_quality,
        "op4_langid": op4_langid,
        "op5_pii": op5_pii,
        "op6_url_filter": op6_url_filter,
        "op7_sharding": op7_sharding,
        "op8_spotsigs": op8_spotsigs,
        "op9_bpe": op9_bpe,
        "op10_suffix_dedup": op10_suffix_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | {"op6_url_filter": oracles.url_filter_sql()}
