"""Removal of byte strings that an earlier document holds already, with suffix arrays.

A suffix array over a corpus doesn't fit one task, and shards of it would have to be compared with
each other, so strings are first brought together by anchors. Of the overlapping grams within a
string of the given length, the one of least hash is its anchor; equal strings have equal anchors,
and about one place in thirteen is anchor of any string. Anchors that two documents share are found
by a shuffle of packed hashes: each task sends a gram once however many of its documents hold it.

Around each shared anchor a context holds all strings that have it as their anchor. Contexts are
dealt by anchor; whole contexts that occur again are settled at once. The distinct rest is cut into
shards. Each shard gets a suffix array (Larsson-Sadakane: groups of equal prefixes are refined by the
rank of what follows, doubling the length) and its common prefixes (Kasai's bound, for all contexts
side by side), which give its distinct strings in order with the least key that holds them; the
shards' lists are merged by binary search. A string that a lesser key holds is removed.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import lean, need, partitions, swept, written, written_by

U = np.uint64
#: Bits of a gram's hash that are sent, beside its bucket.
LOW = (1 << 40) - 1
#: The key of a gram that several documents of a task hold.
SEVERAL = np.int64(-(2**63))
#: Anchors packed at once by a task, bytes of contexts in a suffix array's shard, and contexts that a task remembers.
PACK, SHARD, SEEN = 500_000, 1 << 20, 300_000


def gram_of(length: int) -> int:
    """Bytes of an anchor; a string has length - gram + 1 of them."""
    return (length + 2) // 2


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (a minimum or maximum) over each size neighbours."""
    span = 1
    while span * 2 <= size:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


@functools.lru_cache(maxsize=2)
def _spread(size: int) -> np.ndarray:
    return hashing.powers(size)[1] * U(0x9FB21C651E98DF25)


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """A gram's bucket: buckets are ranges of hashes, which don't depend on the order that makes anchors."""
    return ((gram >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def context_hash(body: np.ndarray, bits: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Of a context's bytes (as their polynomial), strings, and bytes before and from its anchor on."""
    return hashing.mix(hashing.mix(body) + bits.astype(np.uint64) * hashing.STEP[8] + lead.astype(np.uint64) * hashing.STEP[9] + rest.astype(np.uint64) * hashing.STEP[10])


def _split(low: np.ndarray) -> bytes:
    """The sent bits of hashes, five bytes each."""
    return np.ascontiguousarray(low).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _whole(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


class Texts:
    """Anchors and contexts of the texts of one chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.offsets, self.length, self.gram = data, offsets, length, gram_of(length)
        self.up, self.down = hashing.powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(hashing.BYTE_VALUE[data] * self.up[: len(data)], out=self.total[1:], dtype=np.uint64)
        n = max(0, len(data) - self.gram + 1)
        # 32 bits order the grams; the few that become anchors get a full hash
        self.order = (((self.total[self.gram : self.gram + n] - self.total[:n]) * _spread(len(self.down))[:n]) >> U(32)).astype(np.uint32)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return hashing.mix((self.total[at + self.gram] - self.total[at]) * self.down[at])

    def anchors(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of a row's grams, the least of each string, and the places of the grams that are some string's anchor."""
        a, b = int(self.offsets[row]), int(self.offsets[row + 1])
        if b - a < self.length:
            none = np.zeros(0, dtype=np.uint32)
            return none, none, np.zeros(0, dtype=np.int64)
        own = self.order[a : b - self.gram + 1]
        width = self.length - self.gram + 1
        least = _slide(own, width, np.minimum)
        pad = np.zeros(width - 1, dtype=np.uint32)
        return own, least, np.flatnonzero(_slide(np.concatenate((pad, least, pad)), width, np.maximum) == own)

    def contexts(self, row: int, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the row's anchors whose sent bits are among shared (sorted): place, first and last byte (exclusive) of the context, strings as bits, context hash, anchor."""
        own, least, at = self.anchors(row)
        a, n = int(self.offsets[row]), int(self.offsets[row + 1] - self.offsets[row])
        gram = self.hashes(a + at)
        known = shared[np.minimum(np.searchsorted(shared, gram & U(LOW)), len(shared) - 1)] == gram & U(LOW)
        at, gram = at[known], gram[known]
        width = self.length - self.gram + 1
        pad = np.zeros(width - 1, dtype=np.uint32)
        around = np.concatenate((pad, least, pad))
        bits = (around[at[:, None] + np.arange(width)] == own[at][:, None]) @ (1 << np.arange(width))
        start, stop = np.maximum(at - (width - 1), 0), np.minimum(at + self.length, n)
        body = (self.total[a + stop] - self.total[a + start]) * self.down[a + start]
        return at, start, stop, bits, context_hash(body, bits, at - start, stop - at), gram


# anchors that more than one document holds


def _packed(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, shared, pack of (rid, text): a pack holds gram hashes and rids; shared ones are known to be in two rows."""
    grams: list[np.ndarray] = []
    keys: list[int] = []
    held = 0

    def emit(own: np.ndarray, who: np.ndarray, names: np.ndarray, shared: bool):
        """Packs of sorted grams, whose documents are numbers of names or -1."""
        of = bucket_of(own, buckets)
        cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
        packs = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            used = np.zeros(len(names) + 1, dtype=bool)
            used[who[a:b]] = True  # -1 is the last
            table = np.append(names, SEVERAL)[used]
            at = (np.cumsum(used) - 1)[who[a:b]].astype(np.uint16 if len(table) < 1 << 16 else np.uint32)
            packs.append(np.array([b - a, len(table)], dtype=np.int64).tobytes() + table.tobytes() + at.tobytes() + _split(own[a:b] & U(LOW)))
        return pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]].astype(np.int32)), pa.array([shared] * len(packs)), pa.array(packs, pa.binary())], names=["bucket", "shared", "pack"])

    def flush():
        nonlocal held
        if not held:
            return
        own, who = np.concatenate(grams), np.repeat(np.arange(len(keys)), [len(x) for x in grams])
        names = np.array(keys, dtype=np.int64)
        grams.clear(), keys.clear()
        held = 0
        order = np.argsort(own)
        own, who = own[order], who[order]
        cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        several = np.minimum.reduceat(names[who], cuts) != np.maximum.reduceat(names[who], cuts)
        # one row for each gram; that of a gram of several documents has no key
        yield emit(own[cuts], np.where(several, -1, who[cuts]), names, False)
        known = np.repeat(several, np.diff(np.append(cuts, len(own))))
        if known.any():
            yield emit(own[known], who[known], names, True)

    for batch in batches:
        for a, b, data, offsets in hashing.chunks(batch.column(1)):
            texts = Texts(data, offsets, length)
            for row, key in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                own = texts.hashes(int(offsets[row]) + texts.anchors(row)[2])
                grams.append(own)
                keys.append(key)
                held += len(own)
            if held >= PACK:
                yield from flush()
    yield from flush()


def _unpack(pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k = np.frombuffer(pack, dtype=np.int64, count=2).tolist()
    table = np.frombuffer(pack, dtype=np.int64, count=k, offset=16)
    kind = np.dtype(np.uint16 if k < 1 << 16 else np.uint32)
    at = np.frombuffer(pack, dtype=kind, count=n, offset=16 + 8 * k)
    return _whole(pack[16 + 8 * k + kind.itemsize * n :]), table[at]


def _held_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, grams (bytes of the shared grams' low bits) from a partition of packs, in which all packs of a bucket are."""
    packs: dict[int, list[tuple[bool, bytes]]] = {}
    for batch in batches:
        for bucket, shared, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            packs.setdefault(bucket, []).append((shared, pack))
    while packs:
        _, own = packs.popitem()
        parts = [_unpack(p) for shared, p in own if not shared]
        low, who = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        order = np.argsort(low, kind="stable")
        low, who = low[order], who[order]
        cuts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        twice = np.repeat(np.diff(np.append(cuts, len(low))) > 1, np.diff(np.append(cuts, len(low)))) & (who != SEVERAL)
        known = [_unpack(p) for shared, p in own if shared]
        low = np.concatenate([low[twice], *[x for x, _ in known]])
        who = np.concatenate([who[twice], *[x for _, x in known]])
        if not len(low):
            continue
        order = np.argsort(who, kind="stable")
        low, who = low[order], who[order]
        cuts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1], [True])))
        yield pa.RecordBatch.from_arrays([pa.array(who[cuts[:-1]]), pa.array([_split(low[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["rid", "grams"])


# contexts and their strings

#: A context on its way to its anchor's partition, and what comes back: strings to remove as bits.
CONTEXT = "bucket int, mark long, key long, salt int, lead int, bits int, body binary"
FOUND = "key long, salt int, mark long, bits int"


def _context_rows(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Contexts of (key, salt, text, grams): bucket >= 0 to be judged, -1 where a lesser key that this task has met has the same context.

    A context to be judged goes without its hash, which follows from its bytes; a settled one with
    nothing else. So of a passage that very many rows hold, a task sends little more than one context to be judged.
    """
    seen: dict[int, int] = {}
    for batch in batches:
        for a, b, data, offsets in hashing.chunks(batch.column(2)):
            texts, found = Texts(data, offsets, length), []
            keys, salts = (batch.column(c).slice(a, b - a).to_numpy() for c in (0, 1))
            for row in range(b - a):
                shared = np.sort(_whole(b"".join(batch.column(3)[a + row].as_py())))
                at, start, stop, bits, mark, own = texts.contexts(row, shared)
                if len(at):
                    base = int(offsets[row])
                    found.append((np.full(len(at), row), mark, own, bits, at - start, base + start, base + stop))
            if not found:
                continue
            row, mark, own, bits, lead, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((row, keys[row], mark))
            again = np.concatenate(([False], (mark[order][1:] == mark[order][:-1]) & (row[order][1:] == row[order][:-1])))
            row, mark, own, bits, lead, start, stop = (x[order[~again]] for x in (row, mark, own, bits, lead, start, stop))
            cuts = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
            names, first = mark[cuts].tolist(), keys[row[cuts]].tolist()
            if len(seen) + len(names) > SEEN:
                seen.clear()
            least = [min(k, seen.get(m, k)) for m, k in zip(names, first, strict=True)]
            seen.update(zip(names, least, strict=True))
            settled = keys[row] > np.repeat(np.array(least, dtype=np.int64), np.diff(np.append(cuts, len(mark))))
            size = np.where(settled, 0, stop - start)
            ends = np.concatenate(([0], np.cumsum(size)))
            body = data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
            bodies = pa.BinaryArray.from_buffers(pa.binary(), len(mark), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body.tobytes())])
            bucket = np.where(settled, -1, bucket_of(own, buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), pa.array(np.where(settled, mark.view(np.int64), 0)), pa.array(keys[row]), pa.array(salts[row]), pa.array(lead.astype(np.int32)), pa.array(bits.astype(np.int32)), bodies],
                names=["bucket", "mark", "key", "salt", "lead", "bits", "body"],
            )


def suffix_array(data: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Order of all suffixes of the pieces of data; stop has for each byte the end of its piece.

    Seven symbols make the first rank. Groups of equal rank are then refined by the rank at the
    doubled distance; a suffix that ends there ranks by its piece, below all others, so all ranks differ in the end.
    """
    n = len(data)
    symbol = np.concatenate((data.astype(np.uint64) + U(1), np.zeros(7, dtype=np.uint64)))
    place = np.arange(n)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(7):
        key = key << U(9) | np.where(place + j < stop, symbol[j : n + j], U(0))
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n, dtype=np.int64)
    first = np.flatnonzero(new)
    rank[order] = first[np.cumsum(new) - 1]
    depth = 7
    piece = np.searchsorted(np.unique(stop), stop)
    while True:
        size = np.diff(np.append(first, n))
        loose = np.repeat(size > 1, size)
        if not loose.any():
            return order
        at = order[loose]
        after = at + depth
        follow = np.where(after < stop[at], rank[np.minimum(after, n - 1)] + n, piece[at])
        own = rank[at]
        sub = np.argsort((own << 32) | follow)
        order[np.flatnonzero(loose)] = at[sub]
        own, follow = own[sub], follow[sub]
        split = np.concatenate(([True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])))
        place_of = np.flatnonzero(loose)
        new = np.ones(n, dtype=bool)
        new[place_of] = split
        first = np.flatnonzero(new)
        start = first[np.cumsum(new) - 1]
        rank[order] = start
        depth *= 2


def common_prefixes(data: np.ndarray, starts: np.ndarray, stop: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the order the bytes its suffix shares with the one before, within their pieces.

    By Kasai's bound the next suffix of a piece shares one byte less at least; pieces advance side by side.
    """
    n = len(data)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    out = np.zeros(n, dtype=np.int64)
    at, share = starts.copy(), np.zeros(len(starts), dtype=np.int64)
    while len(at):
        r = rank[at]
        other = order[np.maximum(r - 1, 0)]
        share[r == 0] = 0
        grow = np.flatnonzero(r > 0)
        while len(grow):
            i, j = at[grow] + share[grow], other[grow] + share[grow]
            ok = (i < stop[at[grow]]) & (j < stop[other[grow]])
            ok[ok] = data[i[ok]] == data[j[ok]]
            grow = grow[ok]
            share[grow] += 1
        out[r] = share
        share = np.maximum(share - 1, 0)
        at = at + 1
        on = at < stop[at - 1]
        at, share = at[on], share[on]
    return out


def distinct_strings(bodies: list[bytes], lead: np.ndarray, bits: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard of contexts: its distinct strings in order, the least key of each; and for each string of a context: its context, bit, and number among the distinct."""
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    size = np.array([len(x) for x in bodies])
    stops = np.cumsum(size)
    starts = stops - size
    stop = np.repeat(stops, size)
    order = suffix_array(data, stop)
    shared = common_prefixes(data, starts, stop, order)
    width = length - gram_of(length) + 1
    context, bit = np.nonzero(bits[:, None] >> np.arange(width) & 1)
    place = starts[context] + lead[context] - (width - 1) + bit
    rank = np.empty(len(data), dtype=np.int64)
    rank[order] = np.cumsum(shared < length)
    group = rank[place]
    groups, first, number = np.unique(group, return_index=True, return_inverse=True)
    least = np.full(len(groups), np.iinfo(np.int64).max)
    np.minimum.at(least, number, keys[context])
    rows = data[place[first][:, None] + np.arange(length)] if len(first) else np.zeros((0, length), dtype=np.uint8)
    closed = np.concatenate((rows, np.ones((len(rows), 1), dtype=np.uint8)), axis=1)  # no string ends in a zero byte, which numpy would drop
    return np.ascontiguousarray(closed).view(f"S{length + 1}").ravel(), least, context, bit, number


def _runs(gram: np.ndarray, size: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Places of contexts in order of their anchors, as runs of shards: whole anchors up to SHARD bytes, or one anchor's contexts in several shards."""
    cuts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True])))
    upto = np.concatenate(([0], np.cumsum(size)))
    i = 0
    while i < len(cuts) - 1:
        j = max(i + 1, int(np.searchsorted(upto[cuts], upto[cuts[i]] + SHARD, side="right")) - 1)
        a, b = int(cuts[i]), int(cuts[j])
        inner = np.searchsorted(upto, np.arange(upto[a] + SHARD, upto[b], SHARD))
        yield [x for x in np.split(np.arange(a, b), inner - a) if len(x)]
        i = j


def _polynomials(body: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and sizes of some contexts put one after another, running sums of their bytes' values, and the powers that take a place out."""
    data = np.frombuffer(b"".join(body.to_pylist()), dtype=np.uint8)
    size = pc.binary_length(body).to_numpy(zero_copy_only=False).astype(np.int64)
    up, down = hashing.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(hashing.BYTE_VALUE[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
    return np.cumsum(size) - size, size, total, down


def _string_hashes(body: pa.Array, lead: np.ndarray, bits: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of some contexts, and the contexts that they are in."""
    start, _, total, down = _polynomials(body)
    width = length - gram_of(length) + 1
    context, bit = np.nonzero(bits[:, None] >> np.arange(width) & 1)
    place = start[context] + lead[context] - (width - 1) + bit
    return hashing.mix((total[place + length] - total[place]) * down[place]), context


def _named(batch: pa.RecordBatch, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and context hash of each row."""
    start, size, total, down = _polynomials(batch.column("body"))
    lead, bits = batch.column("lead").to_numpy().astype(np.int64), batch.column("bits").to_numpy()
    at = start + lead
    body = (total[start + size] - total[start]) * down[start]
    return hashing.mix((total[at + gram] - total[at]) * down[at]), context_hash(body, bits, lead, size - lead)


def _judged(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Strings to remove of the contexts of a partition, in which all contexts of an anchor are."""
    parts, named, names = [], [], ["key", "salt", "mark", "bits"]
    for batch in batches:
        live = batch.column(0).to_numpy() >= 0
        if not live.all():
            gone = batch.filter(pa.array(~live))
            yield pa.RecordBatch.from_arrays([gone.column(x) for x in names], names=names)
            batch = batch.filter(pa.array(live))
        if batch.num_rows:
            parts.append(batch.select(["key", "salt", "lead", "bits", "body"]))
            named.append(_named(batch, gram_of(length)))
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    gram, mark = (np.concatenate(x) for x in zip(*named, strict=True))
    key, salt, lead, bit = (table.column(c).to_numpy() for c in ("key", "salt", "lead", "bits"))
    order = np.lexsort((key, mark, gram))
    new = np.concatenate(([True], (mark[order][1:] != mark[order][:-1]) | (gram[order][1:] != gram[order][:-1])))
    lone = order[new]
    kind = np.cumsum(new) - 1
    least = key[lone][kind]
    remove = np.zeros(len(mark), dtype=np.int32)
    remove[order] = np.where(key[order] > least, bit[order], 0)
    # the rest: one context of each kind, of the anchors that have several
    grams = gram[lone]
    several = np.zeros(len(lone), dtype=bool)
    several[1:] |= grams[1:] == grams[:-1]
    several[:-1] |= grams[1:] == grams[:-1]
    rest = np.flatnonzero(several)
    more = np.zeros(len(lone), dtype=np.int32)
    body = table.column("body").take(pa.array(lone[rest]))
    sizes = pc.binary_length(body).to_numpy().astype(np.int64)
    for run in _runs(grams[rest], sizes):
        # a context whose strings all have hashes of their own needs no suffix array
        marks, owners = zip(*[_string_hashes(body.take(pa.array(at)), lead[lone[rest[at]]], bit[lone[rest[at]]], length) for at in run], strict=True)
        every = np.sort(np.concatenate(marks))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        run = [at[np.unique(context[np.isin(mark_of, twice)])] for at, mark_of, context in zip(run, marks, owners, strict=True)]
        run = [at for at in run if len(at)]
        if not run:
            continue
        strings_of = lambda at: distinct_strings(body.take(pa.array(at)).to_pylist(), lead[lone[rest[at]]], bit[lone[rest[at]]], key[lone[rest[at]]], length)
        found = strings_of(run[0])
        known, owner = found[0], found[1]
        for at in run[1:]:  # binary search merges the next shard's list
            strings, own = strings_of(at)[:2]
            place = np.searchsorted(known, strings)
            same = place < len(known)
            same[same] = known[place[same]] == strings[same]
            owner[place[same]] = np.minimum(owner[place[same]], own[same])
            known, owner = np.insert(known, place[~same], strings[~same]), np.insert(owner, place[~same], own[~same])
        for at in run:
            strings, _, context, place, number = found if len(run) == 1 else strings_of(at)
            lesser = owner[np.searchsorted(known, strings)][number] < key[lone[rest[at]]][context]
            np.bitwise_or.at(more, rest[at[context[lesser]]], np.int32(1) << place[lesser].astype(np.int32))
    # rows of the least key itself, which may repeat, lose what their kind loses
    remove[order] |= np.where(key[order] == least, more[kind], 0)
    hit = np.flatnonzero(remove)
    for a in range(0, len(hit), 50_000):
        at = hit[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(salt[at]), pa.array(mark[at].view(np.int64)), pa.array(remove[at])], names=names)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """key, id, spans, kept hash of (key, id, text, grams, marks, bits)."""
    width = length - gram_of(length) + 1
    for batch in batches:
        for a, b, data, offsets in hashing.chunks(batch.column(2)):
            texts = Texts(data, offsets, length)
            keys, ids, spans, digests = [], [], [], []
            for row in range(b - a):
                shared = np.sort(_whole(b"".join(batch.column(3)[a + row].as_py())))
                at, _, _, _, mark, _ = texts.contexts(row, shared)
                known = np.array(batch.column(4)[a + row].as_py(), dtype=np.int64).view(np.uint64)
                bits = np.array(batch.column(5)[a + row].as_py(), dtype=np.int64)
                order = np.argsort(known, kind="stable")
                known, bits = known[order], bits[order]
                cuts = np.flatnonzero(np.concatenate(([True], known[1:] != known[:-1])))
                known, bits = known[cuts], np.bitwise_or.reduceat(bits, cuts)
                place = np.minimum(np.searchsorted(known, mark), len(known) - 1)
                own = np.where(known[place] == mark, bits[place], 0)
                context, bit = np.nonzero(own[:, None] >> np.arange(width) & 1)
                start = np.unique(at[context] - (width - 1) + bit)
                body = data[offsets[row] : offsets[row + 1]]
                step = np.zeros(len(body) + 1, dtype=np.int32)
                step[start] += 1
                step[start + length] -= 1
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                keys.append(batch.column(0)[a + row].as_py())
                ids.append(batch.column(1)[a + row].as_py())
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                digests.append(hashlib.sha256(body[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(digests)], names=["key", "id", "spans", "kept_sha256"])


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """key, n_bytes, spans (array of start and end bytes to remove), kept_sha256 for each row of df.

    A byte goes if a string of so many bytes over it also starts in a row of a lesser key; spans are
    maximal runs. Null texts are empty. Null keys are greater than all others; rows of one key never
    remove each other, and keep spans of their own where their texts differ. An empty table gives
    none. A very long text is one task's work at a time, some 60 bytes of memory for each of its own. Other columns are
    dropped, so none can clash. length is 8 to 60.

    Rows are told apart by key and a 32-bit salt of the text's SHA-256: what is removed depends on the
    key and the string alone, so rows of one key whose salts are equal get the same answers rightly.
    """
    need(df, key, text)
    if not 8 <= length <= 60:  # a context's strings are bits of an int
        raise ValueError("length is 8 to 60")
    src = df.select(F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    salt, rid = F.hash("id"), F.greatest(F.xxhash64("key", "salt"), F.lit(int(SEVERAL) + 1))
    named = src.withColumn("id", F.unhex(F.sha2("text", 256))).withColumn("salt", salt).withColumn("rid", rid)
    base = written(named.select("key", "id", F.octet_length("text").cast("long").alias("n")))
    copies = written(base.groupBy("id").agg(F.min("key").alias("first"), F.count("*").alias("c")).where("c > 1").select("id", "first"))
    same = written(base.groupBy("key", "id").agg(F.count("*").alias("c")).where("c > 1").select("id").distinct())
    base = base.join(copies, "id", "left").select("key", "id", "n", F.coalesce("first", "key").alias("least"))
    p = partitions(df.sparkSession, base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    buckets = 4 * p
    if not same.isEmpty():  # rows that repeat whole are read once
        repeated = named.join(same, "id", "left_semi").groupBy("key", "id", "salt", "rid").agg(F.first("text").alias("text"))
        named = named.join(same, "id", "left_anti").select("key", "id", "salt", "rid", "text").unionByName(repeated)

    packs = named.select("rid", "text").mapInArrow(lean(lambda x: _packed(x, length, buckets)), "bucket int, shared boolean, pack binary")
    shared = packs.repartition(p, "bucket").mapInArrow(lean(_held_twice), "rid long, grams binary").groupBy("rid").agg(F.collect_list("grams").alias("grams"))
    firsts = base.where("key = least").select("key", salt.alias("salt")).select(rid.alias("rid")).distinct()
    held = written_by(named.join(shared.join(firsts, "rid"), "rid").select("key", "salt", "rid", "id", "text", "grams"), "rid", p)
    swept(df.sparkSession)  # the packs and shared grams, which are as large as the contexts, are read no more

    contexts = held.select("key", "salt", "text", "grams").mapInArrow(lean(lambda x: _context_rows(x, length, buckets)), CONTEXT)
    # settled contexts only pass through, so they go by their row and not by a context that many rows share
    spread = contexts.repartition(p, F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("key", "salt"), F.lit(buckets)).cast("int")))
    found = spread.mapInArrow(lean(lambda x: _judged(x, length)), FOUND)
    told = found.groupBy(rid.alias("rid")).agg(F.collect_list(F.struct("key", "salt", "mark", "bits")).alias("told"))
    mine = F.filter("told", lambda x: (x["key"] == F.col("key")) & (x["salt"] == F.col("salt")))  # rids may be equal by chance
    cut = held.join(told, "rid").withColumn("told", mine).where(F.size("told") > 0).select("key", "id", "text", "grams", "told.mark", "told.bits").mapInArrow(lean(lambda x: _cut(x, length)), "key long, id binary, spans array<struct<start:int,end:int>>, kept_sha256 string")

    full = base.join(cut, ["key", "id"], "left")
    copy = (F.col("key") > F.col("least")) & (F.col("n") >= length)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    return full.select(
        F.when(F.col("key") != 2**63 - 1, F.col("key")).alias(key),
        F.col("n").alias("n_bytes"),
        F.when(copy, whole).when(F.col("spans").isNotNull(), F.col("spans")).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(F.col("spans").isNotNull(), F.col("kept_sha256")).otherwise(F.lower(F.hex("id"))).alias("kept_sha256"),
    )
