"""Topics of a dataset: cosine k-means over its terms' weights."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, MapType, StringType, StructField, StructType

from sievegate.operators import terms
from sievegate.sources.sinks import written

#: Terms of the vocabulary, as many as terms.vocabulary takes by itself and the reference's vectorizer does.
TERMS = 10_000


def topic_count(n: int) -> int:
    """Clusters for n documents: the root of a tenth, 2 to 20."""
    return min(2, n) if n <= 5 else min(max(2, int(math.sqrt(n / 10))), 20)


def assign(df: DataFrame, key: str, text: str = "text", seed: int = 42) -> DataFrame:
    """key, topic, weights (term to weight) of the rows that have one of the TERMS most frequent terms; no rows below five documents."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import VectorUDT

    found, idf = terms.vocabulary(df, key, text, features=TERMS)
    packed = terms.vectors(df, key, found, text).drop("h")
    wide = len(found)
    ends = lambda start: pa.array(start.astype(np.int32))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                start, place, w = terms.unpacked(part.column(1), part.column(2), idf)
                lists = [pa.ListArray.from_arrays(ends(start), pa.array(x)) for x in (place.astype(np.int32), w)]
                fixed = [pa.array(np.full(part.num_rows, v, dtype=k)) for v, k in ((0, np.int8), (wide, np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays([*fixed, *lists], names=["type", "size", "indices", "values"])], names=[*part.schema.names, "features"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(found, pa.string())
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                start, place, w = terms.unpacked(part.column(2), part.column(3), idf)
                weights = pa.MapArray.from_arrays(ends(start), words.take(pa.array(place)), pa.array(w))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], weights], names=[*part.schema.names[:2], "weights"])

    # written once as what a vector consists of and reread as vectors, so no row passes a function of its own and no round makes them anew
    stored = written(packed.mapInArrow(spread, StructType([*packed.schema, StructField("features", VectorUDT.sqlType())])))
    vectors = df.sparkSession.read.schema(StructType([*packed.schema, StructField("features", VectorUDT())])).parquet(stored._sievegate_path)
    n = vectors.count()
    out = StructType([packed.schema[key], StructField("topic", IntegerType()), StructField("weights", MapType(StringType(), DoubleType()))])
    if df.count() < 5 or n < 2:
        return df.sparkSession.createDataFrame([], out)
    model = KMeans(k=topic_count(n), seed=seed, maxIter=50, distanceMeasure="cosine", predictionCol="topic").fit(vectors.select("features"))
    return model.transform(vectors).select(key, "topic", "t", "f").mapInArrow(named, out)


def topics(assigned: DataFrame, top: int = 5) -> DataFrame:
    """topic, size, terms (the heaviest in sum, ties by term) of assign's rows."""
    sizes = assigned.groupBy("topic").agg(F.count("*").alias("size"))
    heavy = assigned.select("topic", F.explode("weights").alias("term", "w")).groupBy("topic", "term").agg(F.sum("w").alias("w"))
    ranked = heavy.withColumn("at", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("w"), "term"))).where(F.col("at") <= top)
    named = ranked.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("t"))
    return sizes.join(named, "topic").select("topic", "size", F.col("t.term").alias("terms"))


def diversity(found: DataFrame) -> DataFrame:
    """One row, diversity: the mean Jaccard distance of two topics' terms; 0 for fewer than two topics. Topics are 20 at most."""
    a, b = (found.select(F.col("topic").alias(c), F.col("terms").alias(f"t{c}")) for c in "ab")
    distance = 1 - F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    return a.join(b, F.col("a") < F.col("b")).agg(F.round(F.coalesce(F.avg(distance), F.lit(0.0)), 4).alias("diversity"))


def coherence(assigned: DataFrame) -> DataFrame:
    """topic, size, coherence: the mean cosine of two of the topic's rows, 0 for one alone, from their unit weights (a map).

    The square of the rows' sum holds the product of every pair, so all rows count and no pairs are made.
    """
    sizes = assigned.groupBy("topic").agg(F.count("*").alias("size"))
    sums = assigned.select("topic", F.explode("weights").alias("term", "w")).groupBy("topic", "term").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    whole = sums.groupBy("topic").agg((F.sum(F.col("s") * F.col("s")) - F.sum("q")).alias("pairs"))
    mean = F.col("pairs") / (F.col("size") * (F.col("size") - 1))
    return sizes.join(whole, "topic", "left").select("topic", "size", F.when(F.col("size") > 1, F.coalesce(mean, F.lit(0.0))).otherwise(0.0).alias("coherence"))


def judged_score(learned: Column, judge: Column) -> Column:
    """The learned score and a judge's, 7 to 3, cut to a whole number. Whole scores and decimals are mixed without rounding."""
    return F.floor(learned * F.lit(Decimal("0.7")) + judge * F.lit(Decimal("0.3"))).cast("long")
