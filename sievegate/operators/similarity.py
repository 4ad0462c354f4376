"""Similarity joins on sets, found exactly or by bands, and cosine joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.functions import sketch
from sievegate.functions.text import alnum_tokens
from sievegate.operators import overlap
from sievegate.sources.sinks import forget, swept, written

#: Fixed value: stopwords of the term vectors.
STOPWORDS = """
a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could
should may might shall can it its this that these those i you he she we they me him her us them my your his our their not no
if so as up out about into than then also just more
""".split()


def exact_matches(train: DataFrame, other: DataFrame, key: str, text: Column) -> DataFrame:
    """eval_id, train_id: rows of other whose text is a train row's; of equal train texts the largest key."""
    index = train.select(F.sha2(text, 256).alias("h"), F.col(key).alias("id")).groupBy("h").agg(F.max("id").alias("train_id"))
    return other.select(F.sha2(text, 256).alias("h"), F.col(key).alias("eval_id")).join(index, "h").select("eval_id", "train_id")


def best_jaccard(train: DataFrame, other: DataFrame, least: float = 0.70, some: bool = False) -> DataFrame:
    """eval_id, train_id, similarity: for rows of other the train row of the largest Jaccard, if that is least or more; ties go to the smaller id.

    Both tables are (id, g) of sketch.char_sets. Equal sets are one node. Every pair of a train and an other
    set whose sizes can reach least is judged. some: any train row that reaches least will do, so most pairs need no judging.
    """
    return overlap.best_overlap(train, other, least, some=some)


def best_by_bands(train: DataFrame, other: DataFrame, least: float = 0.70, perms: int = 128, seed: int = 42, some: bool = False) -> DataFrame:
    """As best_jaccard, but only pairs that share a band of their MinHash signatures count, so a few pairs near least may be missed.

    Pairs are found by their bands within the tiles of best_jaccard, so none is sent.
    """
    return overlap.best_overlap(train, other, least, (perms, sketch.bands(perms, least)[0], seed), some)


def term_weights(df: DataFrame, key: str, text: str = "text", min_df: int = 1, max_df: float = 0.95, features: int = 10_000) -> DataFrame:
    """key, term, weight: (1 + ln tf) * (ln(N / df) + 1), normalised, over the terms of min_df to int(max_df * N) documents, the most frequent first.

    Rows without such a term are absent.
    """
    words = df.select(F.col(key).alias("key"), F.explode(alnum_tokens(F.coalesce(F.col(text), F.lit("")), STOPWORDS)).alias("term"))
    tf = words.groupBy("key", "term").agg(F.count("*").alias("tf"))
    total = df.agg(F.count("*").alias("total"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).where((F.col("df") >= min_df) & (F.col("df") <= F.floor(F.col("total") * max_df)))
    idf = idf.orderBy(F.desc("df"), "term").limit(features).select("term", "df", (F.log(F.col("total") / F.col("df")) + 1).alias("idf"))
    raw = tf.join(idf, "term").select("key", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "key").select(F.col("key").alias(key), "term", (F.col("w") / F.col("norm")).alias("weight"))


def idf(df: DataFrame, text: str = "text", max_df: float = 0.95) -> DataFrame:
    """term, df, idf of the terms in int(max_df * N) documents at most."""
    terms = df.select(F.explode(F.array_distinct(alnum_tokens(F.coalesce(F.col(text), F.lit("")), STOPWORDS))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = df.agg(F.count("*").alias("total"))
    return terms.crossJoin(F.broadcast(total)).where(F.col("df") <= F.floor(F.col("total") * max_df)).select("term", "df", (F.log(F.col("total") / F.col("df")) + 1).alias("idf"))


def cosine_pairs(weights: DataFrame, key: str, least: float = 0.90) -> DataFrame:
    """a, b, cosine of the pairs (a < b) of normalised sparse vectors that reach least, exhaustively.

    Equal vectors are one node, named by its smallest key; cosine_rows gives the members. A term is indexed for a vector only
    until the rest of the vector, its heaviest terms last to go, can't reach least alone; so the common
    terms of light weight make no pairs. Candidates are verified on whole vectors.
    """
    rows = weights.select(F.col(key).alias("id"), "term", F.col("weight").alias("w"))
    vectors = rows.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "w")))).alias("v"))
    named = vectors.withColumn("h", F.sha2(F.to_json("v"), 256))
    nodes = named.groupBy("h").agg(F.min("id").alias("node"), F.count("*").alias("size"))
    frequency = rows.groupBy("term").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "term")
    # what stands from a term on has norm r; a pair that shares none of the terms before it has a cosine of r at most
    left = rows.join(nodes.select(F.col("node").alias("id")), "id").join(frequency, "term").withColumn("r", F.sqrt(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(0, Window.unboundedFollowing))))
    prefix = left.where(F.col("r") >= least - 1e-9).select("term", "id")
    pairs = prefix.select("term", F.col("id").alias("a")).join(prefix.select("term", F.col("id").alias("b")), "term").where("a < b").select("a", "b").distinct()
    x = vectors.select(F.col("id").alias("a"), F.col("v").alias("x"))
    y = vectors.select(F.col("id").alias("b"), F.col("v").alias("y"))
    dot = F.aggregate(F.map_entries("x"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at("y", e["key"]), F.lit(0.0)))
    return pairs.join(x, "a").join(y, "b").select("a", "b", F.least(F.lit(1.0), dot).alias("cosine")).where(F.col("cosine") >= least)


def cosine_rows(weights: DataFrame, key: str, least: float = 0.90) -> DataFrame:
    """key of the rows whose vector reaches least with another row's; copies of a vector count without pairs."""
    rows = weights.select(F.col(key).alias("id"), "term", F.col("weight").alias("w"))
    named = rows.groupBy("id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("term", "w")))), 256).alias("h"))
    nodes = named.groupBy("h").agg(F.min("id").alias("node"), F.count("*").alias("size"))
    pairs = cosine_pairs(weights, key, least)
    hit = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().unionByName(nodes.where("size > 1").select("node")).distinct()
    return named.join(nodes, "h").join(hit, "node").select(F.col("id").alias(key)).distinct()


#: Vectors that the exhaustive cosine join's cells are named by, and vectors of a tile, about.
PIVOTS, TILE = 64, 2048


def _units(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: each different vector other than zero, of length 1, named by its smallest key."""
    rows = df.select(F.col(key).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).groupBy("v").agg(F.min("id").alias("id"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).where("norm > 0").select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def dense_cosine_pairs(df: DataFrame, key: str, vector: str, least: float = 0.90, recall: float | None = None, seed: int = 42) -> DataFrame:
    """a, b, cosine of the pairs (a < b) of dense vectors of one dimension that reach least. Equal vectors are one node, named by the smallest key.

    Exhaustive without recall: each vector goes to the nearest of PIVOTS vectors; two cells whose pivots lie further
    apart than their radii and the widest distance of a pair are never compared, the others tile by tile, as products
    of matrices. Vectors that don't gather in cells are all compared, so the work then grows with the square of the rows.
    With recall, a pair of cosine least is found with that chance and a nearer one with a larger: the signs of random projections
    are cut into bands, and pairs that share a band are verified. Its work grows with the rows and the pairs found.
    """
    units = written(_units(df, key, vector))
    kind = units.schema["id"].dataType.simpleString()
    return _by_signs(units, kind, least, recall, seed) if recall else _by_tiles(units, kind, least)


def _by_tiles(units: DataFrame, kind: str, least: float) -> DataFrame:
    pivots = np.array([r["v"] for r in units.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()])
    if not len(pivots):
        return units.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("cosine")).limit(0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = _matrix(batch.column(1)) @ pivots.T
                cell = like.argmax(axis=1)
                far = np.sqrt(np.maximum(0, 2 - 2 * like[np.arange(len(cell)), cell]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])

    placed = written(units.select("id", "v").mapInArrow(place, f"id {kind}, v array<double>, cell int, far double"))
    cells = {r["cell"]: (-(-r["n"] // TILE), r["far"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # PIVOTS at most
    widest = (2 - 2 * least) ** 0.5 + 1e-6
    apart = lambda a, b: float(np.linalg.norm(pivots[a] - pivots[b]))
    met = [(a, b, cells[a][0], cells[b][0]) for a in cells for b in cells if apart(a, b) <= cells[a][1] + cells[b][1] + widest]
    reach = placed.sparkSession.createDataFrame(met, "cell int, other int, own long, tiles long")
    tile = lambda cell, number: F.struct(cell.alias("cell"), number.alias("tile"))
    mine = tile(F.col("cell"), F.pmod(F.xxhash64("id"), F.col("own")))
    dealt = placed.select("id", "v", "cell").join(F.broadcast(reach), "cell").select("id", "v", mine.alias("at"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: tile(F.col("other"), t))).alias("to"))
    dealt = dealt.select("id", "v", (F.col("at") <= F.col("to")).alias("low"), (F.col("at") == F.col("to")).alias("same"), F.least("at", "to").alias("x"), F.greatest("at", "to").alias("y"))

    def pairs(group: pa.Table) -> pa.Table:
        batch = group.select(["id", "v", "low", "same"]).combine_chunks().to_batches()[0]
        ids, v = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
        low = batch.column(2).to_numpy(zero_copy_only=False)
        if batch.column(3)[0].as_py():
            rows = cols = np.arange(len(ids))
        else:
            rows, cols = np.flatnonzero(low), np.flatnonzero(~low)
        like = v[rows] @ v[cols].T
        i, j = np.nonzero(like >= least)
        a, b, c = ids[rows[i]], ids[cols[j]], like[i, j]
        once = a < b if rows is cols else a != b
        a, b, c = a[once], b[once], c[once]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "cosine": pa.array(np.minimum(c, 1.0))})

    return dealt.groupBy("x", "y").applyInArrow(pairs, f"a {kind}, b {kind}, cosine double")


def _by_signs(units: DataFrame, kind: str, least: float, recall: float, seed: int, bits: int = 16) -> DataFrame:
    one = 1 - float(np.arccos(least)) / np.pi
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - one**bits)))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                planes = np.random.default_rng(seed).standard_normal((v.shape[1], bands * bits)) if planes is None else planes
                up = (v @ planes >= 0).reshape(len(v), bands, bits)
                at = (up * (1 << np.arange(bits))).sum(axis=2) + (np.arange(bands) << bits)
                ends = np.arange(0, at.size + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(at.ravel()))], names=["id", "at"])

    banded = units.select("id", "v").mapInArrow(signs, f"id {kind}, at array<long>").select("id", F.explode("at").alias("at"))
    a, b = (banded.withColumnRenamed("id", c) for c in "ab")
    x, y = (units.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}")) for c in "ab")
    dot = F.aggregate(F.zip_with("v_a", "v_b", lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    pairs = a.join(b, "at").where("a < b").select("a", "b").distinct()
    return pairs.join(x, "a").join(y, "b").select("a", "b", F.least(F.lit(1.0), dot).alias("cosine")).where(F.col("cosine") >= least)


#: Words that have a place of their own in the order of rising frequency, about; all others come before them.
RANKS = 1 << 20
#: Longs of a set's sketch, and of the wide one that sets of so many words have too. Nodes of a cell of pairs, about. Words of the sets that are verified at once, and of the pairs.
SKETCH, WIDE, LARGE, CELL, WORDS, PAIRED = 4, 32, 400, 512, 4_000_000, 2_000_000
#: Bytes of a table that is broadcast at most.
BROADCAST = 64 << 20


def _ranked(frequency: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words (sorted) that have a place of their own, and their place by rising frequency, of a written table (x, df). Which words these are decides how fast pairs are found, not which."""
    counts = frequency.groupBy("df").count().toArrow()  # as many rows as there are frequencies
    df, count = (counts.column(c).to_numpy() for c in ("df", "count"))
    order = np.argsort(-df)
    fit = df[order[np.cumsum(count[order]) <= RANKS]]
    found = frequency.where(F.col("df") >= int(fit[-1]) if len(fit) else F.lit(False)).toArrow()
    x, df = (found.column(c).to_numpy() for c in ("x", "df"))
    at = np.empty(len(x), dtype=np.int64)
    at[np.lexsort((x, df))] = np.arange(len(x))
    order = np.argsort(x)
    return x[order], at[order].astype(np.int32)


def near_pairs(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, n) and their pairs (a < b) whose Jaccard is least or more, exactly, of sets (key, w). Equal sets are one node, named by the least key; empty ones have no pairs.

    Pairs are found by their first words: in any order of all words, of two sets of sizes x and y that reach least the first word that they
    share has least / (1 + least) * (x + y) words of each from it on. Rare words come first, so only these are shuffled; a row brings its
    sketch, in which a word turns a bit over: two sketches differ in no more bits than the sets in words. So few pairs that fall short leave the join,
    and most of those are told by the wide sketches.
    Candidates are verified on the sets of 64-bit hashes of words, which are written once and sent for candidates only, to cells of nodes that have a neighbour in common.
    """
    hashed = sets.select("key", F.unhex(F.sha2(F.to_json("w"), 256)).alias("h"), F.sort_array(F.transform("w", lambda x: F.xxhash64(x))).alias("w"))
    rows = written(hashed)
    frequency = written(rows.select(F.explode("w").alias("x")).groupBy("x").agg(F.count("*").alias("df")).where("df > 1"))
    known, place = _ranked(frequency)
    forget(frequency)
    swept(sets.sparkSession)
    sketched = [f"s{i}" for i in range(SKETCH)]

    def turned(row: np.ndarray, flat: np.ndarray, rows: int, longs: int) -> np.ndarray:
        count = np.bincount(row * 64 * longs + (flat & (64 * longs - 1)), minlength=rows * 64 * longs)
        return np.packbits((count & 1).astype(np.uint8).reshape(rows, 64 * longs), axis=1).view(np.int64).reshape(rows, longs)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in sketch.parts(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)):
                part = batch.slice(start, stop - start)
                size = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
                flat, row = part.column(2).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
                rank = np.zeros(len(flat), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    rank = np.where(known[at] == flat, place[at] + 1, 0)
                order = np.argsort(row << 32 | rank, kind="stable")  # words without a place stay in the order of their hashes
                count = np.where(size > 0, size - np.ceil(size * least - 1e-9).astype(np.int64) + 1, 0)
                ends = np.concatenate(([0], np.cumsum(count)))
                begin = np.cumsum(size) - size
                firsts = flat[order[np.repeat(begin - ends[:-1], count) + np.arange(ends[-1])]]
                bits = turned(row, flat, len(size), SKETCH)
                large = size >= LARGE
                wide = turned((np.cumsum(large) - 1)[row[large[row]]], flat[large[row]], int(large.sum()), WIDE)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values)) for at, values in ((ends, firsts), (np.concatenate(([0], np.cumsum(large * WIDE))), wide.ravel()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), *lists, *[pa.array(bits[:, i].copy()) for i in range(SKETCH)]], names=["key", "h", "n", "first", "wide", *sketched])

    kind = rows.schema["key"].dataType.simpleString()
    firsts = rows.mapInArrow(first, f"key {kind}, h binary, n long, first array<bigint>, wide array<bigint>, " + ", ".join(f"{c} long" for c in sketched))
    nodes = written(firsts.groupBy("h").agg(F.min("key").alias("id"), *[F.first(c).alias(c) for c in ("n", "first", "wide", *sketched)]))
    swept(sets.sparkSession)
    pairs = _candidates(nodes, sketched, least)
    swept(sets.sparkSession)
    found = _verified(pairs, nodes.select("id", "h"), rows, kind, least)
    forget(rows, pairs)
    swept(sets.sparkSession)
    return nodes.select("id", "n"), found


def _candidates(nodes: DataFrame, sketched: list[str], least: float) -> DataFrame:
    """a, b (a < b) of the nodes (id, n, first, sketches) that share one of the first words, from which on both have words enough, and whose sketches are near enough."""
    prefix = nodes.select("id", "n", *sketched, F.posexplode("first").alias("r", "x"))
    a, b = (prefix.select("x", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "r", *sketched)]) for side in "ab")
    share = least / (1 + least)
    both = F.col("n_a") + F.col("n_b")
    enough = (F.col("n_a") - F.col("r_a") >= both * share - 1e-6) & (F.col("n_b") - F.col("r_b") >= both * share - 1e-6)
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    turned = sum((apart(F.col(f"{c}_a"), F.col(f"{c}_b")) for c in sketched), F.lit(0))
    most = both * (1 - 2 * share) + 1e-6
    met = a.join(b.hint("merge"), (a["x"] == b["x"]) & (F.col("id_a") < F.col("id_b")) & enough & (turned <= most))
    large = (F.col("n_a") >= LARGE) & (F.col("n_b") >= LARGE)  # both have a wide sketch
    found = written(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), large.alias("large")).distinct())
    x, y = (nodes.where(F.col("n") >= LARGE).select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab")
    bits = F.aggregate(F.zip_with("wide_a", "wide_b", apart), F.lit(0), lambda s, t: s + t)
    told = found.where("large").join(x, "a").join(y, "b").where(bits <= most)
    out = written(found.where("not large").select("a", "b").unionByName(told.select("a", "b")))
    forget(found)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, kind: str, least: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard is least or more, of nodes (id, h) and their sets among rows (key, h, w).

    A node's mark is its least neighbour or itself, and of a mark with many nodes, which part of them. Pairs whose nodes have the same two
    marks are a cell, to which each of its sets is sent once; so a group of near copies isn't sent for each of its pairs.
    """
    sides = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.col("a").alias("mark")).groupBy("id").agg(F.min("mark").alias("mark"))
    many = sides.groupBy("mark").agg(F.ceil(F.count("*") / CELL).alias("parts")).where("parts > 1")
    marks = written(sides.join(many, "mark", "left").select("id", F.xxhash64("mark", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).alias("mark")))
    a, b = (marks.select(F.col("id").alias(c), F.col("mark").alias(f"mark_{c}")) for c in "ab")
    celled = written(pairs.join(a, "a").join(b, "b").select(F.xxhash64(F.least("mark_a", "mark_b"), F.greatest("mark_a", "mark_b")).alias("cell"), "a", "b"))
    cells = celled.select("cell", F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.collect_set("cell").alias("cells"))
    asked = written(cells.join(nodes, "id").select(F.col("id").alias("key"), "h", "cells"))
    forget(marks)
    size = asked.agg(F.sum(F.size("cells") * 8 + 128)).first()[0] or 0
    dealt = rows.join(F.broadcast(asked) if size <= BROADCAST else asked, ["key", "h"]).select(F.explode("cells").alias("cell"), F.col("key").alias("a"), F.lit(None).cast(kind).alias("b"), "w")
    dealt = dealt.unionByName(celled.select("cell", "a", "b", F.lit(None).cast("array<bigint>").alias("w"))).repartition("cell").sortWithinPartitions("cell")

    def judge(table: pa.Table) -> pa.RecordBatch:
        own = pc.is_valid(table.column("w"))
        some, met = table.filter(own), table.filter(pc.invert(own))
        ids, sets = some.column("a").combine_chunks(), some.column("w").combine_chunks()
        size = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, number = np.cumsum(size) - size, np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        i, j = (pc.index_in(met.column(c), value_set=ids).to_numpy().astype(np.int64) for c in "ab")
        near = np.zeros(len(i), dtype=bool)
        for start, stop in sketch.parts(size[i] + size[j], PAIRED):
            both = []
            for at in (i[start:stop], j[start:stop]):
                ends = np.cumsum(size[at])
                both.append(np.repeat(np.arange(len(at)), size[at]) << 32 | number[np.repeat(begin[at] - (ends - size[at]), size[at]) + np.arange(ends[-1])])
            both = np.sort(np.concatenate(both))
            shared = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=stop - start)
            near[start:stop] = shared / (size[i[start:stop]] + size[j[start:stop]] - shared) >= least
        return met.select(["a", "b"]).filter(pa.array(near)).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # cells are whole: what goes ends before the last cell that has come
            cell = batch.column(0).to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))
            words += len(batch.column(3).flatten())
            if words >= WORDS and (cut or held and held[-1].column(0)[-1].as_py() != cell[0]):
                yield from judge(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held, words = [], 0
                batch = batch.slice(cut)
                words = len(batch.column(3).flatten())
            held.append(batch)
        if held:
            yield from judge(pa.Table.from_batches(held)).to_batches()

    out = written(dealt.mapInArrow(run, f"a {kind}, b {kind}"))
    forget(celled, asked)
    return out


def fuzzy_dedupe(df: DataFrame, key: str, words: Column, least: float) -> DataFrame:
    """id of the rows kept when, in order of key, a row goes whose set of words is a kept one's or nearly; of equal sets the least key stays."""
    nodes, pairs = near_pairs(df.select(F.col(key).alias("key"), F.sort_array(words).alias("w")), least)
    return greedy_dedupe(nodes.select("id"), pairs, written)


def greedy_dedupe(nodes: DataFrame, edges: DataFrame, write) -> DataFrame:
    """id of the nodes that are kept when, in order of id, a node is dropped if a kept smaller one is its neighbour.

    nodes: id. edges: a < b. write cuts the lineage (a table written and reread). Rounds decide all nodes
    whose smaller neighbours are decided; there are as many as the longest rising chain.
    """
    kept = None
    left, links = nodes.select("id"), edges.select("a", "b")
    while True:
        blocked = links.select(F.col("b").alias("id")).distinct()
        now = write(left.join(blocked, "id", "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        gone = write(links.join(now, links["a"] == now["id"], "left_semi").select(F.col("b").alias("id")).distinct())
        done = now.unionByName(gone)
        left = write(left.join(done, "id", "left_anti"))
        links = write(links.join(done.select(F.col("id").alias("a")), "a", "left_anti").join(done.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"))
        if left.isEmpty():
            return kept
