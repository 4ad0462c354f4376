"""Rendezvous hashing of record keys over weighted shards.

Each (key, shard) pair gets an independent pseudo-random draw and the key goes to the shard that
wins. A new shard can only win keys for itself, so growing from n to n + 1 shards moves about
1/(n + 1) of the records and moves none between old shards. Nothing but the key and the shard
list decides, so any executor can redo any row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need


def _draw(key: Column, shard: int) -> Column:
    return F.md5(F.concat_ws(":", key, F.lit(str(shard))))


def _key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("null"))


def shard_of(column: Column, shards: int | Sequence[float]) -> Column:
    """The winning shard of a key column; shards is a count or one positive weight per shard.

    Equal weights compare the digests themselves. Otherwise shard s scores weight / -ln(u), u being
    the digest's first 13 hexadecimal digits as a fraction, which gives it keys in proportion to its
    weight. Null keys share the key "null". Ties, which need equal digests, go to the later shard.
    """
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    if not weights or min(weights) <= 0:
        raise ValueError("at least one shard, and weights above 0")
    key = _key(column)
    if len(set(weights)) == 1:
        scores = [_draw(key, s) for s in range(len(weights))]
    else:
        unit = [(F.conv(F.substring(_draw(key, s), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13)) for s in range(len(weights))]
        scores = [F.lit(w) / -F.log(u) for w, u in zip(weights, unit, strict=True)]
    return F.array_max(F.array(*[F.struct(x.alias("score"), F.lit(s).alias("shard")) for s, x in enumerate(scores)]))["shard"]


def shard(df: DataFrame, key: str, shards: int | Sequence[float], text: str = "text") -> DataFrame:
    """One row per row of df: the key, shard, grown_shard (one more shard of weight 1), slot, size, text_crc32.

    slot numbers a shard's rows from 0 without gaps, ordered by lane (three digits of a digest of
    the key), key and text checksum. Rows are numbered lane by lane, 4096 lanes a shard, and a lane's
    offset comes from the lane counts: no task holds a whole shard. Null texts count as empty;
    repeated keys share a shard and have slots of their own, equal rows in any order; an empty table gives none. Of
    a text only its length and checksum are moved, however long it is. Other columns are dropped, so none can clash.

    The draws of both shard counts are equal expressions, which the compiled stage evaluates once.
    """
    need(df, key, text)
    body = F.coalesce(F.col(text), F.lit(""))
    more = shards + 1 if isinstance(shards, int) else [*shards, 1.0]
    rows = df.select(
        F.col(key),
        (F.octet_length(body).cast("long") + F.lit(8)).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), shards).cast("int").alias("shard"),
        shard_of(F.col(key), more).cast("int").alias("grown_shard"),
        F.substring(F.md5(F.concat_ws(":", _key(F.col(key)), F.lit("lane"))), 1, 3).alias("lane"),
    )
    lane = Window.partitionBy("shard", "lane")
    numbered = rows.withColumn("at", F.row_number().over(lane.orderBy(key, "text_crc32")).cast("long"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "lane").agg(F.count("*").alias("n")).select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return numbered.join(starts, ["shard", "lane"]).select(key, "size", "text_crc32", "shard", (F.col("start") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")
