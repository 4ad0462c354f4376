"""Near duplicates by the Jaccard likeness of word-shingle sets.

Nothing is sampled, capped or cut. Shingles are compared by 64-bit hashes and sets named by 128 bits,
which is all that chance can touch: two sets of n shingles count one too many with a chance of about
n * n / 2**63, two different sets of N are one with N * N / 2**129, and a link is overlooked only if
the two sets' blocks or first 64 bits coincide, one chance in 2**64 a link.

Shingles are hashed into groups. A set's group counts are a point, and two sets cannot share more
than the sum over the groups of the smaller count; an R-tree whose nodes keep each coordinate's
largest count prunes pairs of subtrees by that sum, and the pairs it leaves are verified on the sets.

A tree over a whole corpus would be one task, and points of unrelated texts lie too close for its
boxes to part them, so the groups also decide which points meet. Sets that link differ by at most d
shingles, d following from the size class; of d + 1 or more groups one is untouched, so both sets hold
the same shingles there. Each set is dealt under (size class, group, hash of the group's shingles): no
link is lost, and a passage or line shared by many texts does not bring them together, for their
other shingles fall into its groups. Equal sets are one point from the start.

A group that a set leaves empty is no key, or all short texts would meet in it. A set that fills more
than d groups has a full one among the untouched; two sets of d full groups or fewer, which only
short texts have, are dealt again by other groups, and after LEVELS of those by their single shingles.

In each block all members are first verified against its pivot, the member that is in most blocks;
members that are in one component then need no further pair. What is left of a pivot's neighbourhood,
all that met it in a block, goes through the R-tree in tiles of a bounded number of points.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, hashing
from .common import forget, lean, need, partitions, side, written

U = np.uint64
#: Groups that make the tree's points, and the least and most that make a set's fine point, which has one for every four shingles.
GROUPS, COARSEST, FINEST = 256, 64, 1 << 14
#: Groupings that a set tries before it is dealt by its single shingles; below 4096.
LEVELS = 6
#: Points in one task's tile of a neighbourhood, about, and in a leaf.
TILE, LEAF = 2048, 32
#: Counts from here on are kept in eight bytes instead of two.
WIDE = 1 << 16


@functools.cache
def classes(num: int, den: int, top: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Smallest size of each size class up to top, and for each class (d, groups, largest size of a linked set).

    Sizes of a class lie within 1 : 1.5. With s the class's largest size, linked sets' union has at
    most s * den / num shingles and d = (den - num) / den of that differ.
    """
    first, found = [1], []
    while first[-1] <= top:
        stop = max(first[-1] + 1, first[-1] * 3 // 2)
        union = (stop - 1) * den // num
        d = (den - num) * union // den
        found.append((d, 1 if not d else d + 1 + max(2, d // 5), union))
        first.append(stop)
    return np.array(first), found


def block_keys(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """The blocks of one sorted set: its own class's groups, and the class below's if a set of that class can link to it.

    Only what a set holds makes a key. Of two linked sets that a level of groups doesn't bring together
    both fill d groups at most, so both go on to the next level.
    """
    n = len(own)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    first, found = classes(num, den, 1 << max(10, (n * 2).bit_length()))
    c = int(np.searchsorted(first, n, side="right")) - 1
    keys = []
    low = c
    while low > 0 and n <= found[low - 1][2]:
        low -= 1
    for at in range(low, c + 1):
        d, m, _ = found[at]
        for level in range(LEVELS):
            dealt = own if not level else np.sort(hashing.mix(own + hashing.STEP[level]))
            content = hashing.mix(dealt ^ U(0x5851F42D4C957F2D))
            group = ((dealt >> U(32)) * U(m)) >> U(32)
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            keys.append(hashing.mix(np.add.reduceat(content, starts) + hashing.mix(group[starts] + U((level * 4096 + at) << 40))))
            if len(starts) > d:
                break
        else:
            keys.append(hashing.mix(own + U((LEVELS * 4096 + at) << 40)))
    return np.concatenate(keys)


def set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set; 0 of an empty one."""
    size = np.array([len(x) for x in sets], dtype=np.uint64)
    out = np.zeros((2, len(sets)), dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum(size[full])[:-1])).astype(np.int64)
        for i, salt in enumerate((U(0), U(0x1F83D9ABFB41BD6B))):
            out[i, full] = hashing.mix(np.add.reduceat(hashing.mix(flat ^ salt), starts) + size[full] + salt)
    return out[0].view(np.int64), out[1].view(np.int64)


def counts(own: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group counts of a set; groups is a power of two, and fewer groups' counts are sums of neighbours."""
    return np.bincount((own >> U(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def fine_point(own: np.ndarray) -> np.ndarray:
    return counts(own, min(FINEST, max(COARSEST, 1 << (len(own) // 4).bit_length())))


def packed(point: np.ndarray) -> bytes:
    """Counts as bytes, the last of which is the size of one count."""
    kind = np.uint16 if int(point.max()) < WIDE else np.int64
    return point.astype(kind).tobytes() + bytes([np.dtype(kind).itemsize])


def unpacked(data: pa.Buffer | bytes) -> np.ndarray:
    data = memoryview(data)
    return np.frombuffer(data[:-1], dtype=np.uint16 if data[-1] == 2 else np.int64).astype(np.int64)


def may_link(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each two points whether their summed minima, at the coarser one's groups, reach what a link needs. Points of one size are compared at once."""
    out = np.zeros(len(left), dtype=bool)
    sizes = np.array([(len(p), len(q)) for p, q in zip(left, right, strict=True)], dtype=np.int64).reshape(-1, 2)
    for x, y in np.unique(sizes, axis=0).tolist():
        n = min(x, y)
        same = np.flatnonzero((sizes == (x, y)).all(axis=1))
        for at in np.array_split(same, max(1, len(same) * (x + y) // (1 << 18))):
            p, q = (np.stack([own[i] for i in at]).reshape(len(at), n, -1).sum(axis=2) for own in (left, right))
            out[at] = np.minimum(p, q).sum(axis=1) * (num + den) >= num * (p.sum(axis=1) + q.sum(axis=1))
    return out


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets link, by the shingles themselves."""
    both = np.sort(np.concatenate((a, b)))
    return int((both[1:] == both[:-1]).sum()) * (num + den) >= num * (len(a) + len(b))


class CountTree:
    """R-tree over group counts, bulk-loaded by halving along the coordinate of the widest spread."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None):
        rows = np.arange(len(points)) if rows is None else rows
        own = points[rows]
        self.rows, self.most, self.least = rows, own.max(axis=0), int(own.sum(axis=1).min())
        self.labels = int(labels[rows].min()), int(labels[rows].max())
        self.parts: list[CountTree] = []
        if len(rows) > LEAF:
            wide = int(np.argmax(self.most - own.min(axis=0)))
            order = rows[np.argsort(own[:, wide], kind="stable")]
            half = len(order) // 2
            self.parts = [CountTree(points, labels, order[:half]), CountTree(points, labels, order[half:])]

    def join(self, other: CountTree, points: np.ndarray, others: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of both sides whose summed coordinate minima reach what a link needs; each pair of a tree with itself once or twice.

        Subtrees that hold one label only are not joined to each other.
        """
        stack = [(self, other)]
        while stack:
            a, b = stack.pop()
            if a.labels == b.labels and a.labels[0] == a.labels[1]:
                continue
            if int(np.minimum(a.most, b.most).sum()) * (num + den) < num * (a.least + b.least):
                continue
            if not a.parts and not b.parts:
                p, q = points[a.rows], others[b.rows]
                shared = np.minimum(p[:, None, :], q[None, :, :]).sum(axis=2)
                i, j = np.nonzero(shared * (num + den) >= num * (p.sum(axis=1)[:, None] + q.sum(axis=1)[None, :]))
                yield a.rows[i], b.rows[j]
            elif a is b:
                x, y = a.parts
                stack += [(x, x), (y, y), (x, y)]
            elif a.parts and (not b.parts or len(a.rows) >= len(b.rows)):
                stack += [(x, b) for x in a.parts]
            else:
                stack += [(a, x) for x in b.parts]


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[pa.Array], list[np.ndarray]]]:
    """Keys, digests and shingle sets of batches of (key, h, text)."""
    for batch in batches:
        for a, b, data, offsets in hashing.chunks(batch.column(2)):
            yield batch.slice(a, b - a).columns[:2], list(hashing.shingles(*hashing.words(data, offsets), k))


def _sized(df: DataFrame, k: int) -> DataFrame:
    """key, h, n, sid, check of rows of (key, h, text): a set's size and the two halves of its id."""

    def run(batches):
        for keys, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([*keys, pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, set_ids(sets))], names=["key", "h", "n", "sid", "check"])

    return df.mapInArrow(lean(run), f"key {df.schema['key'].dataType.simpleString()}, h long, n long, sid long, check long")


def _dealt(df: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """sid, block for each set; a set that a task meets again is dealt once."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for _, sets in _sets(batches, k):
            sids, blocks = [], []
            for own, name in zip(sets, zip(*(x.tolist() for x in set_ids(sets)), strict=True), strict=True):
                if len(own) and name not in seen:
                    seen.add(name)
                    sids.append(name[0])
                    blocks.append(block_keys(own, num, den).astype(np.int64))
            if sids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in blocks]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(blocks)))], names=["sid", "blocks"])

    return df.mapInArrow(lean(run), "sid long, blocks array<long>").select("sid", F.explode("blocks").alias("block"))


def _loaded(df: DataFrame, k: int) -> DataFrame:
    """sid, check, n, own (the sorted set as bytes), fine and point (its packed group counts) of rows of (key, h, text), once for each task that meets a set."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for _, sets in _sets(batches, k):
            new = {name: x for x, name in zip(sets, zip(*(x.tolist() for x in set_ids(sets)), strict=True), strict=True) if name not in seen}
            seen.update(new)
            made = [[x.tobytes() for x in new.values()], [packed(fine_point(x)) for x in new.values()], [packed(counts(x)) for x in new.values()]]
            names = [pa.array([name[i] for name in new], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*names, pa.array([len(x) for x in new.values()], pa.int64()), *[pa.array(x, pa.binary()) for x in made]], names=["sid", "check", "n", "own", "fine", "point"])

    return df.mapInArrow(lean(run), "sid long, check long, n long, own binary, fine binary, point binary")


def _named(sets: DataFrame) -> tuple[DataFrame, Column]:
    """id, sid, check, n of the sets (sid, check, n), and the id as a column of (sid, check): a number that no two of them share.

    That is the id's first half, unless two of the sets have the same; then it is drawn anew from both halves until none do.
    """
    names = written(sets.select("sid", "check", "n").distinct())
    name, seed = F.col("sid"), 0
    while not names.groupBy(name.alias("id")).count().where("count > 1").isEmpty():
        seed += 1
        name = F.xxhash64(F.lit(seed), "sid", "check")
    return written(names.select(name.alias("id"), "sid", "check", "n")), name


def _judged(pairs: DataFrame, sets: DataFrame, column: str, keep) -> DataFrame:
    """The pairs (a, b) whose sets' column, as bytes, keep allows; only that column is moved."""
    left = sets.select(F.col("id").alias("a"), F.col(column).alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col(column).alias("y"))

    def run(batches):
        for batch in batches:
            buffers = [[v.as_buffer() for v in batch.column(c)] for c in (2, 3)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep(*buffers), pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def _bounded(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose summed coordinate minima reach what a link needs."""
    return _judged(pairs, sets, "fine", lambda x, y: may_link([unpacked(v) for v in x], [unpacked(v) for v in y], num, den))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that link."""
    whole = functools.partial(np.frombuffer, dtype=np.uint64)
    return _judged(pairs, sets, "own", lambda x, y: [linked(whole(p), whole(q), num, den) for p, q in zip(x, y, strict=True)])


def _tree_pairs(rest: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a < b, of different labels that an R-tree leaves of each tile pair of a neighbourhood.

    rest: pivot, tiles, id, label, point. Members are dealt into tiles by hash; each pair of tiles is one group, so a
    neighbourhood of any size is spread over tasks that hold two tiles at most, and nothing gathers it.
    """
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    dealt = rest.select("pivot", "id", "label", "point", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    dealt = dealt.select("pivot", F.least("tile", "t").alias("i"), F.greatest("tile", "t").alias("j"), "tile", "id", "label", "point")

    def pairs(tile, label, points):
        low = tile == tile.min()
        if low.all():
            tree = CountTree(points, label)
            found, own, other = tree.join(tree, points, points, num, den), np.arange(len(tile)), np.arange(len(tile))
        else:
            own, other = np.flatnonzero(low), np.flatnonzero(~low)
            found = CountTree(points[own], label[own]).join(CountTree(points[other], label[other]), points[own], points[other], num, den)
        for p, q in found:
            p, q = own[p], other[q]
            keep = label[p] != label[q]
            yield p[keep], q[keep]

    def emit(group: pa.Table):
        group = group.combine_chunks()
        tile, name, label = (group.column(c).to_numpy() for c in (3, 4, 5))
        if len(tile) < 2 or (label == label[0]).all():
            return
        points = np.stack([unpacked(v.as_buffer()) for v in group.column(6)])
        for p, q in pairs(tile, label, points):
            a, b = name[p], name[q]
            found = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))).tolist() if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                key = tuple(keys[:, a].tolist())
                if key != at and held:
                    yield from emit(pa.Table.from_batches(held))
                    held = []
                at = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from emit(pa.Table.from_batches(held))

    spread = dealt.repartition(partitions(rest.sparkSession), "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    return spread.mapInArrow(lean(run), "a long, b long").distinct()



def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """key, n_shingles, component_id for each row of df; component_id is the smallest key of the row's component.

    Words are runs of anything but space and tab to carriage return, with A-Z in lower case. A row's
    set is its distinct shingles of so many words, or its whole sequence if that is shorter. Two rows
    link when den * shared >= num * united. Rows without words, and null texts, link with nothing and
    keep their own key. Repeated keys give a row each; a component takes the least key whatever row
    has it, so ties need no rule. A component whose keys are all null has null. An empty table gives
    none. A very long text is one task's work at a time and needs some 100 bytes of memory a word.
    Other columns are dropped, so none can clash.
    """
    need(df, key, text)
    if not (0 < num <= den and 1 <= words <= 32):
        raise ValueError("0 < num <= den and 1 to 32 words")
    src = df.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("h"), F.col(text).alias("text"))
    sized = written(_sized(src, words))
    node = ["sid", "check"]

    block = Window.partitionBy("block")
    dealt = _dealt(src, words, num, den).select("*", F.min("sid").over(block).alias("x"), F.max("sid").over(block).alias("y"), F.lag("sid").over(block.orderBy("sid")).alias("before"))
    shared = written(dealt.where("x <> y and not (before <=> sid)").select("block", "sid"))
    degree = written(shared.groupBy("sid").agg(F.count("*").alias("degree")))
    pivots = written(shared.join(degree, "sid").groupBy("block").agg(F.max(F.struct("degree", "sid"))["sid"].alias("pivot")))
    stars = shared.join(pivots, "block").where("sid <> pivot").select("pivot", "sid").distinct()

    # one row of each set that shares a block is loaded, found again by a digest of its key and text
    wanted = written(degree.join(sized.where("n > 0"), "sid").groupBy(*node).agg(F.min("h").alias("h")).select("h").distinct())
    loaded = written(_loaded(src.join(side(wanted, 16), "h", "left_semi"), words))
    names, name = _named(loaded)
    sets = loaded.withColumn("id", name)

    ends = [names.select(F.col("sid").alias(x), F.col("id").alias(y), F.col("n").alias(f"n_{y}")) for x, y in (("pivot", "a"), ("sid", "b"))]
    around = written(stars.join(ends[1], "sid").join(ends[0], "pivot").select("pivot", "a", "b", F.expr(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}").alias("near")))
    forget(shared, degree, pivots, wanted)
    links = written(_verified(_bounded(around.where("near").select("a", "b").distinct(), sets, num, den), sets, num, den).distinct())
    root = graph.components(links)

    labelled = written(around.select("pivot", F.col("b").alias("id")).distinct().join(root.withColumnRenamed("node", "id"), "id", "left").select("pivot", "id", F.coalesce("root", "id").alias("label")))
    several = written(labelled.groupBy("pivot").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("x <> y").select("pivot", "tiles"))
    if not several.isEmpty():
        rest = labelled.join(several, "pivot").join(sets.groupBy("id").agg(F.first("point").alias("point")), "id")
        more = written(_verified(_bounded(_tree_pairs(rest, num, den), sets, num, den), sets, num, den).distinct())
        root = graph.components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    least = sized.where("n > 0").groupBy(*node).agg(F.min("key").alias("least"))
    named = least.join(root.withColumnRenamed("node", "id").join(names, "id").select(*node, "root"), node, "left")
    of = written(named.where("root is not null").groupBy("root").agg(F.min("least").alias("component")))
    # written, so that a set or component of very many rows is a skewed join that Spark splits
    component = written(named.join(of, "root", "left").select(*node, F.coalesce("component", "least").alias("component")))
    forget(loaded, around, links, labelled, several, names, of)
    full = sized.join(component, node, "left")
    return full.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"))
