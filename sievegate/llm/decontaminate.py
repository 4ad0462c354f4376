"""Benchmark items inside documents, by MinHash containment search.

An item's sketch holds the shingles of smallest hash. Items are partitioned by size, and a
partition's sketch length is one more than the shingles that its largest item may miss at the
threshold; so a document that contains enough of an item holds one shingle of its sketch at least,
whatever its own length, and no item is missed. Documents are read once against the sketches;
candidates are then verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, let, need, written

def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _each(w: Column, k: int, make) -> Column:
    """make(the k words from i on) for every place i of a word array."""
    places = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: make([F.get(w, i + j) for j in range(k)]))


def _hashes(text: Column, lengths: list[int]) -> Column:
    return let(words(text), lambda w: F.concat(*[_each(w, k, lambda x: F.xxhash64(F.lit(len(x)), *x)) for k in lengths]))


def _shingles(text: Column, k: int) -> Column:
    return let(words(text), lambda w: F.array_distinct(_each(w, k, lambda x: F.concat_ws(" ", *x))))


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """key, item, n_shingles, n_matched, containment: documents that hold num / den of an item's distinct shingles or more.

    An item of fewer words than size is one shingle of its words; an item without words, or a null
    text, is in no document. Repeated keys are judged row by row and give the best; null keys are one
    key. Equal items are found under each of their ids; an empty table on either side finds nothing. A
    text costs in proportion to its length, and to the items' number of lengths below size. Other columns are dropped, so none can clash.
    """
    need(docs, key, text)
    need(items, item, text)
    own = items.select(F.col(item).alias("item"), F.col(text).alias("text"), F.size(words(F.col(text))).alias("k")).where("k > 0")
    own = own.withColumn("k", F.least("k", F.lit(size)))
    lengths = sorted(r["k"] for r in own.select("k").distinct().collect())
    by_length = [own.where(F.col("k") == k).select("item", "k", _shingles(F.col("text"), k).alias("shingles"), F.array_sort(F.array_distinct(_hashes(F.col("text"), [k]))).alias("h")) for k in lengths or [size]]
    table = by_length[0]
    for more in by_length[1:]:
        table = table.unionByName(more)
    # size partitions: 2**b to 2**(b + 1) - 1 shingles; the sketch is as long as the largest of them needs
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.size("shingles"))) + 1).cast("int") - 1
    sketch_length = F.floor(top * (den - num) / den).cast("int") + 1
    table = written(table.withColumn("n", F.size("shingles")).withColumn("sketch", F.slice("h", 1, F.least(sketch_length, F.size("h")))).drop("h"))
    bytes_of = lambda *x: F.coalesce(F.sum(sum(x)), F.lit(0))
    name = F.octet_length(F.col("item").cast("string"))
    moved = table.agg(bytes_of(F.size("sketch") * (name + 32)).alias("sketch"), bytes_of(name, F.octet_length(F.array_join("shingles", "")), F.size("shingles") * 16).alias("shingles")).first()
    sketch = table.select("item", F.explode("sketch").alias("h"))
    if moved["sketch"] <= BROADCAST:
        sketch = F.broadcast(sketch)

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    held = src.select("key", F.explode(_hashes(F.col("text"), lengths or [size])).alias("h"))
    met = held.join(sketch, "h")
    candidates = written(met.select("key", "item").distinct())

    shingled = table.select("item", "k", "n", "shingles")
    if moved["shingles"] <= BROADCAST:
        shingled = F.broadcast(shingled)
    keys = candidates.select(F.col("key").alias("held")).distinct()
    texts = src.join(keys, F.col("key").eqNullSafe(F.col("held")), "left_semi")
    pairs = texts.join(candidates.withColumnRenamed("key", "held"), F.col("key").eqNullSafe(F.col("held"))).drop("held").join(shingled, "item")
    same = None
    for k in lengths or [size]:
        shared = F.size(F.array_intersect("shingles", _shingles(F.col("text"), k)))
        same = F.when(F.col("k") == k, shared) if same is None else same.when(F.col("k") == k, shared)
    judged = pairs.select("key", "item", "n", same.alias("m")).where(F.col("m") * den >= F.col("n") * num)
    best = judged.groupBy("key", "item").agg(F.max("n").alias("n"), F.max("m").alias("m"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), F.col("n").cast("long").alias("n_shingles"), F.col("m").cast("long").alias("n_matched"), (F.col("m") / F.col("n")).alias("containment"))
