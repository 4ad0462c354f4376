"""Term vectors as packed rows, and the rows whose vectors are alike, found without pairs leaving a task."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegate.operators.similarity import STOPWORDS
from sievegate.sources.sinks import forget, written

#: Bytes of packed vectors in a tile, tiles at least, rows that are multiplied at a time, groups of terms of the two bounds.
TILE, TILES, ROWS, GROUPS = 24 << 20, 6, 2048, (256, 1024)

_WORD = re.compile("[a-z0-9]+")


def _one_each(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, t: the lower-cased text of each key; the texts of a key that several rows have are put one after another."""
    rows = df.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    again = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"))
    if again.isEmpty():
        return rows
    same = F.col("key").eqNullSafe(F.col("k"))
    joined = rows.join(again, same, "left_semi").groupBy("key").agg(F.concat_ws("\n", F.collect_list("t")).alias("t"))
    return rows.join(again, same, "left_anti").unionByName(joined)


def vocabulary(df: DataFrame, key: str, text: str = "text", min_df: int = 1, max_df: float = 0.95, features: int = 10_000) -> tuple[list[str], np.ndarray]:
    """The terms of min_df to int(max_df * N) keys, the most frequent first and at most features of them, and their idf, ln(N / df) + 1."""
    stop, word = frozenset(STOPWORDS), _WORD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "df"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(w for w in set(word.findall(t)) if len(w) > 1 and w not in stop)
                if len(seen) > 500_000:
                    yield told()
                    seen.clear()
        yield told()

    total = df.count()
    counts = _one_each(df, key, text).select("t").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = counts.where((F.col("df") >= min_df) & (F.col("df") <= math.floor(total * max_df))).orderBy(F.desc("df"), "term").limit(features).collect()
    return [r["term"] for r in found], np.array([math.log(total / r["df"]) + 1 for r in found])


def vectors(df: DataFrame, key: str, terms: list[str], text: str = "text") -> DataFrame:
    """key, t, f, h of the rows that have a term: the places of its terms, rising (packed u2 or u4), how often each occurs (u1, u2 or u4, as the row needs), and a digest of both."""
    place = {t: i for i, t in enumerate(terms)}
    word, wide = _WORD, "<u2" if len(terms) <= 1 << 16 else "<u4"
    rows = _one_each(df, key, text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, t, f, h = [], [], [], []
            for i, own in enumerate(batch.column(1).to_pylist()):
                found = [p for p in map(place.get, word.findall(own)) if p is not None]
                if not found:
                    continue
                where, often = np.unique(np.array(found, dtype=np.int64), return_counts=True)
                kind = next(k for k in ("<u1", "<u2", "<u4") if often.max() < 1 << 8 * int(k[-1]))
                at.append(i)
                t.append(where.astype(wide).tobytes())
                f.append(often.astype(kind).tobytes())
                h.append(hashlib.sha256(t[-1] + b"|" + f[-1]).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.binary()) for x in (t, f, h))], names=["key", "t", "f", "h"])

    empty = F.lit(b"")
    packed = rows.mapInArrow(pack, rows.select("key", empty.alias("t"), empty.alias("f"), empty.alias("h")).schema)
    return packed.withColumnRenamed("key", key)


def unpacked(t: pa.Array, f: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packed rows one after another: each row's first element (and the end), places, and weights (1 + ln tf) * idf, normalised."""
    wide = "<u2" if len(idf) <= 1 << 16 else "<u4"
    places = [np.frombuffer(x.as_buffer(), dtype=wide) for x in t]
    size = np.array([len(x) for x in places], dtype=np.int64)
    often = [np.frombuffer(x.as_buffer(), dtype=f"<u{len(x.as_buffer()) // n}").astype(np.float32) for x, n in zip(f, size.tolist(), strict=True)]
    start = np.append(0, np.cumsum(size))
    place = np.concatenate(places)
    w = (1 + np.log(np.concatenate(often).astype(np.float64))) * idf[place]
    return start, place, w / np.repeat(np.sqrt(np.add.reduceat(w * w, start[:-1])), size)


def _grouped(start: np.ndarray, place: np.ndarray, w: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Rows by groups: the norm of each row's weights in each group of terms. Two rows' product is at least that of the rows themselves."""
    n = len(start) - 1
    at = np.repeat(np.arange(n) * groups, np.diff(start)) + group[place]
    return np.sqrt(np.bincount(at, w * w, minlength=n * groups)).astype(np.float32).reshape(n, groups)


class _Tile:
    def __init__(self, t: pa.Array, f: pa.Array, idf: np.ndarray, deal: list[np.ndarray]) -> None:
        self.t, self.f, self.idf, self.deal = t, f, idf, deal
        parts = [self.rows(np.arange(a, min(a + ROWS, len(t)))) for a in range(0, len(t), ROWS)]
        self.z = np.concatenate([_grouped(*x, deal[0], GROUPS[0]) for x in parts])

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return unpacked(self.t.take(pa.array(which)), self.f.take(pa.array(which)), self.idf)


def _likeness(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, terms: int) -> np.ndarray:
    """Cosine of row i of x and row j of y, for each pair."""
    own = np.repeat(np.arange(len(x[0]) - 1), np.diff(x[0])) * terms + x[1]
    size = np.diff(y[0])[j]
    ends = np.cumsum(size)
    at = np.repeat(y[0][j] - (ends - size), size) + np.arange(ends[-1])
    pair = np.repeat(np.arange(len(i)), size)
    wanted = i[pair] * terms + y[1][at]
    place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    return np.bincount(pair, np.where(own[place] == wanted, x[2][place] * y[2][at], 0.0), minlength=len(i))


def _hits(x: _Tile, y: _Tile, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row of x, and of y, reaches least with one of the other (of its own tile, if x is y)."""
    hit_x = np.zeros(len(x.t), dtype=bool)
    hit_y = hit_x if x is y else np.zeros(len(y.t), dtype=bool)
    terms = len(x.idf)
    for a in range(0, len(x.t), ROWS):
        for b in range(a if x is y else 0, len(y.t), ROWS):
            i, j = np.nonzero(x.z[a : a + ROWS] @ y.z[b : b + ROWS].T >= least - 1e-4)
            i, j = i + a, j + b
            if x is y:
                i, j = i[i < j], j[i < j]
            while len(i):
                open_ = ~(hit_x[i] & hit_y[j])  # of a group of near copies only the first row's pairs are judged
                i, j = i[open_], j[open_]
                k, m, i, j = i[:4096], j[:4096], i[4096:], j[4096:]
                if not len(k):
                    break
                (u, k1), (v, m1) = np.unique(k, return_inverse=True), np.unique(m, return_inverse=True)
                p, q = x.rows(u), y.rows(v)
                bound = np.einsum("ij,ij->i", _grouped(*p, x.deal[1], GROUPS[1])[k1], _grouped(*q, y.deal[1], GROUPS[1])[m1])
                left = np.flatnonzero(bound >= least - 1e-4)
                if len(left):
                    found = left[_likeness(p, q, k1[left], m1[left], terms) >= least - 1e-9]
                    hit_x[k[found]] = True
                    hit_y[m[found]] = True
    return hit_x, hit_y


def alike_rows(df: DataFrame, key: str, least: float = 0.90, text: str = "text", features: int = 10_000) -> DataFrame:
    """key of the rows whose term vector reaches least with another row's, exhaustively.

    Equal vectors are one node from the start. The nodes are dealt over tiles of about TILE bytes, and a task judges two tiles: a
    matrix product over GROUPS[0] groups of terms bounds every cosine from above, one over GROUPS[1] the pairs that are left, and the rest are
    computed whole. A task returns the rows that it found, so no pairs are made; the work grows with the square of the different rows.
    """
    terms, idf = vocabulary(df, key, text, features=features)
    if not terms:
        return df.select(key).limit(0)
    rows = written(vectors(df, key, terms, text).withColumnRenamed(key, "id").where("id is not null"))
    groups = rows.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    nodes = rows.select("id", "t", "f").join(groups.select("id"), "id")
    size = rows.agg(F.sum(F.octet_length("t") + F.octet_length("f"))).first()[0] or 0
    tiles = max(TILES, -(-int(size) // TILE))
    tile = F.pmod(F.xxhash64("id"), F.lit(tiles))
    dealt = nodes.select("id", "t", "f", tile.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("to"))
    dealt = dealt.select("id", "t", "f", "own", F.least("own", "to").alias("x"), F.greatest("own", "to").alias("y"))
    deal = [np.random.default_rng(n).integers(0, n, len(terms)) for n in GROUPS]

    def judge(group: pa.Table) -> pa.Table:
        low, high = group["x"][0].as_py(), group["y"][0].as_py()
        ids, made = [], []
        for n in dict.fromkeys((low, high)):
            part = group.filter(pc.equal(group["own"], n)).combine_chunks()
            order = pa.array(np.argsort(pc.binary_length(part["t"]).to_numpy(), kind="stable"))  # long rows together
            part = part.take(order).combine_chunks()
            if part.num_rows:
                t, f = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (part["t"], part["f"]))
                ids.append(part["id"])
                made.append(_Tile(t, f, idf, deal))
        if len(made) < len({low, high}):
            return group.select(["id"]).slice(0, 0)
        found = _hits(made[0], made[-1], least)
        return pa.table({"id": pa.chunked_array([c for part, hit in zip(ids, found, strict=False) for c in part.filter(pa.array(hit)).chunks], type=group["id"].type)})

    met = dealt.groupBy("x", "y").applyInArrow(judge, dealt.select("id").schema).distinct()
    # the tasks' findings are written, so that the nodes that they read can go
    hit = written(met.unionByName(groups.where("size > 1").select("id")).distinct())
    members = rows.select("id", "h").join(groups.select("h", F.col("id").alias("node")), "h")
    out = written(members.join(hit.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("id").alias(key)))
    forget(rows, hit)
    return out
