"""Byte-level BPE over Arrow batches.

The vocabulary is a file of ranks, named by a parameter. Each match of the split pattern is encoded
on its own by the tokenizers library, whose byte-level alphabet maps every byte to one printable
character; a piece that has been met before is looked up instead, for natural text repeats its words.
Offsets count bytes of the UTF-8 text and, by the bytes that begin a character, characters. Decoding
reverses the byte table; a token may hold part of a character, so the bytes are the exact result and
the text replaces what is no whole character.

A text is encoded whole, so a very long one needs some 100 bytes of memory for each of its own.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import lean, need

#: Pieces that a Python worker remembers, about, in each of two generations, and the characters that such a piece has at most.
PIECES, SHORT = 120_000, 32


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of more than one byte: what is left after all merges of lower rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), default=(rank, -1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        letters = byte_characters()
        spell = lambda token: "".join(map(letters.__getitem__, token))
        self.model = Tokenizer(models.BPE(vocab={spell(t): i for t, i in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in merges_of(ranks)], ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.length_of = np.array([len(t) for t in self.bytes_of], dtype=np.int64)
        self.within = np.array([t[:1] >= b"\x80" and t[:1] < b"\xc0" for t in self.bytes_of])
        self.seen: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text. Pieces are remembered in two generations, so what recurs outlives the emptying of a full table."""
        for text in texts:
            pieces = self.split(text)
            if len(self.seen) > PIECES:
                self.seen, self.before = {}, self.seen
            seen, before, long = self.seen, self.before, {}
            new = set(pieces).difference(seen)
            if new:
                known = {p for p in new if p in before}
                seen.update((p, before[p]) for p in known)
                new = list(new - known)
                for piece, got in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    (seen if len(piece) <= SHORT else long)[piece] = tuple(got.ids)
            if long:
                yield [i for p in pieces for i in (long.get(p) or seen[p])]
            else:
                yield list(chain.from_iterable(map(seen.__getitem__, pieces)))

    def starts(self, ids: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each token the byte where it begins, and the character that it begins or, as part of one, lies in."""
        sizes = self.length_of[ids]
        at = np.cumsum(sizes) - sizes
        if len(body) == 0 or body.isascii():
            return at, at
        first = np.frombuffer(body, dtype=np.uint8) & 0xC0 != 0x80
        return at, np.cumsum(first)[at] - 1

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()])


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker, built from the file when first used."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Codec(path, pattern)


def _slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about limit bytes of one column each, and one row at least."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _list(values: list, kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate([np.asarray(v) for v in values]) if values and ends[-1] else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype()), type=kind))


def encode(df: DataFrame, key: str, path: str, pattern: str, text: str = "text", offsets: bool = True, decoded: bool = False, splits: bool = False) -> DataFrame:
    """key, ids array<int>; with offsets starts and chars, array<int>: the byte where each token begins, and the character; with decoded bytes: those that the ids decode to; with splits n_split long: how many tokens begin within a character.

    decoded spares a second pass over the ids, and its workers, where both directions are wanted.
    Null and empty texts have no tokens. The file must be readable under this path on every executor,
    as an installed package's files are. Special tokens' strings in a text are ordinary text. Rows
    are independent, so repeated rows repeat; other columns are dropped, so none can clash.
    """
    need(df, key, text)
    src = df.select(key, text)
    schema = f"`{key}` {src.schema[key].dataType.simpleString()}, ids array<int>" + ", starts array<int>, chars array<int>" * offsets + ", bytes binary" * decoded + ", n_split long" * splits
    names = [key, "ids", *["starts", "chars"] * offsets, *["bytes"] * decoded, *["n_split"] * splits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in _slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [np.array(x, dtype=np.int32) for x in own.encode(texts)]
            columns = [batch.column(0), _list(ids, pa.int32())]
            if offsets:
                found = [own.starts(x, t.encode()) for x, t in zip(ids, texts, strict=True)]
            if offsets:
                columns += [_list([x[i] for x in found], pa.int32()) for i in (0, 1)]
            if decoded:
                columns.append(pa.array([own.decode(x) for x in ids], type=pa.binary()))
            if splits:
                columns.append(pa.array([int(own.within[x].sum()) for x in ids], type=pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return src.mapInArrow(lean(run), schema)


def decode(df: DataFrame, key: str, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """key, ids, bytes binary: the bytes that the ids stand for; null ids count as none.

    An id outside the vocabulary raises. Cast bytes to a string with decode_text() where a text is needed.
    """
    need(df, key, ids)
    src = df.select(key, ids)
    schema = f"`{key}` {src.schema[key].dataType.simpleString()}, ids array<int>, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(1)
                out = [own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(out, type=pa.binary())], names=[key, "ids", "bytes"])

    return src.mapInArrow(lean(run), schema)


def decode_text(data: bytes) -> str:
    """Bytes as text; parts of characters become U+FFFD."""
    return data.decode("utf-8", errors="replace")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of an installed public vocabulary."""
    import public_tokenizers

    assert re.fullmatch(r"[\w.]+", name)
    return public_tokenizers.path(name), public_tokenizers.PATTERN
