"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters'
vectors, rotated by their places; a text's vector bundles (adds) its trigrams'. A language's
prototype bundles all its texts, and a text has the language whose prototype is nearest by cosine.
Bundles are sums of whole numbers, so prototypes don't depend on how the rows are dealt.

A text in no learned language has a best cosine near zero, but so has a short text in one. So what a
text must reach follows from how like the learned rows' first letters are, for each length.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need

#: Length of the vectors, and symbols: 0 for what is no letter, a to z, and the other letters by code point.
WIDTH, SYMBOLS = 2048, 64
UNKNOWN = "und"
#: Rows bundled at once, and their distinct trigrams per product.
ROWS, PART = 64, 512
#: Lengths judged are 2**0 to 2**(LENGTHS - 1) letters. A language's rows give a floor from ENOUGH on: MARGIN of the cosine that all but SHARE of them reach, counted in STEPS.
LENGTHS, ENOUGH, SHARE, MARGIN, STEPS = 16, 100, 0.01, 0.7, 1000


@functools.cache
def symbol_of() -> np.ndarray:
    """The symbol of each code point; capitals have their small letter's."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = ord(char.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (SYMBOLS - 27)
    return table


@functools.cache
def letters() -> np.ndarray:
    """The symbols' vectors, rotated for the first, second and third place of a trigram."""
    own = np.random.Generator(np.random.PCG64(77)).integers(0, 2, (SYMBOLS, WIDTH), dtype=np.int8) * 2 - 1
    return np.stack([np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own])


def vectors(trigrams: np.ndarray) -> np.ndarray:
    first, second, third = letters()
    return first[trigrams >> 12] * second[trigrams >> 6 & 63] * third[trigrams & 63]


def sequence(text: str) -> np.ndarray:
    """The trigrams of a text around each letter, in order; runs of other characters are one break."""
    own = symbol_of()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    own = np.concatenate(([0], own, [0])).astype(np.int32)
    own = own[np.concatenate(([True], (own[1:] > 0) | (own[:-1] > 0)))]
    if len(own) < 3:
        return np.zeros(0, dtype=np.int32)
    return (own[:-2] << 12 | own[1:-1] << 6 | own[2:])[own[1:-1] > 0]


def counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a sequence, and their counts."""
    found = np.sort(found)
    if not len(found):
        return found, np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    return found[at], np.diff(np.append(at, len(found)))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text and their counts."""
    return counted(sequence(text))


def bundles(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each row of (distinct trigrams, counts) the sum of their vectors, exact: a row of 2**24 letters or more is summed in doubles."""
    total = np.zeros((len(rows), WIDTH), dtype=np.float64)
    for a in range(0, len(rows), ROWS):
        part = rows[a : a + ROWS]
        kind = np.float32 if max(int(c.sum()) for _, c in part) < 1 << 24 else np.float64
        held = np.zeros(SYMBOLS**3, dtype=bool)
        for found, _ in part:
            held[found] = True
        every = np.flatnonzero(held).astype(np.int32)
        dense = np.zeros((len(part), len(every)), dtype=kind)
        for i, (found, count) in enumerate(part):
            dense[i, np.searchsorted(every, found)] = count
        for b in range(0, len(every), PART):
            total[a : a + ROWS] += dense[:, b : b + PART] @ vectors(every[b : b + PART]).astype(kind)
    return total


def bundle(found: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors."""
    return bundles([(found, count)])[0]


@dataclass(frozen=True)
class Profiles:
    names: list[str]
    prototypes: np.ndarray

    def likeness(self, own: np.ndarray) -> np.ndarray:
        """Cosines of bundles (rows) with the prototypes (columns)."""
        size = np.linalg.norm(own, axis=1, keepdims=True)
        return own @ self.prototypes.T / np.where(size > 0, size, 1.0)

    def predict(self, texts: list[str | None], floor: list[float] | None = None) -> list[tuple[str, float]]:
        """Language and cosine, 0 at least, of each text; the unknown language and 0 for one without a letter, or where nothing was learned.

        floor: the least cosine for a text of 2**i letters or more; below it the language is unknown.
        """
        rows = [trigrams(x or "") for x in texts]
        out = [(UNKNOWN, 0.0)] * len(rows)
        at = [i for i, (found, _) in enumerate(rows) if len(found)]
        if not at or not self.names:
            return out
        like = self.likeness(bundles([rows[i] for i in at]))
        for i, j, own in zip(at, np.argmax(like, axis=1), like, strict=True):
            score = float(min(1.0, max(0.0, own[j])))
            least = floor[min(int(rows[i][1].sum()).bit_length(), len(floor)) - 1] if floor else 0.0
            out[i] = (self.names[j] if score >= least else UNKNOWN, score)
        return out

    def starts(self, text: str) -> np.ndarray:
        """The best cosines of a text's first 1, 2, 4 ... letters, as far as it has so many."""
        found = sequence(text)
        ends = [1 << i for i in range(LENGTHS) if 1 << i <= len(found)]
        if not ends:
            return np.zeros(0)
        own = bundles([counted(found[a:b]) for a, b in zip([0, *ends], ends)])
        return self.likeness(np.cumsum(own, axis=0)).max(axis=1)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes of all rows with a language; each task bundles what it reads, so it sends one vector a language.

    Rows with a null text or language teach nothing, nor does a language whose texts have no letter; an
    empty table gives no language. Repeated rows count each time; other columns are dropped. A text's trigrams are
    counted first, so a very long one costs little more than its letters.
    """
    need(docs, text, lang)
    src = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, count = trigrams(body.as_py())
                counts.setdefault(name, np.zeros(SYMBOLS**3, dtype=np.int64))[found] += count
        for name, own in counts.items():
            found = np.flatnonzero(own).astype(np.int32)
            total = sum((own[found[a : a + PART]] @ vectors(found[a : a + PART]).astype(np.int64) for a in range(0, len(found), PART)), np.zeros(WIDTH, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([name] * WIDTH), pa.array(range(WIDTH), pa.int32()), pa.array(total, pa.int64())], names=["lang", "at", "sum"])

    made = src.mapInArrow(lean(run), "lang string, at int, sum long").groupBy("lang", "at").agg(F.sum("sum").alias("sum"))
    found: dict[str, np.ndarray] = {}
    for r in made.collect():
        found.setdefault(r["lang"], np.zeros(WIDTH))[r["at"]] = r["sum"]
    names = sorted(n for n, x in found.items() if x.any())
    return Profiles(names, np.stack([found[n] / np.linalg.norm(found[n]) for n in names]) if names else np.zeros((0, WIDTH)))


def floors(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang") -> list[float]:
    """For each length 2**i, MARGIN of the cosine that all but SHARE of a language's rows reach with so many first letters.

    The least of the languages that have ENOUGH such rows; 0, so that nothing is rejected, where none has. All learned rows count.
    """
    need(docs, text, lang)
    src = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                like = shared.value.starts(body.as_py())
                step = (np.clip(like, 0, 1) * STEPS).astype(np.int64)
                counts.setdefault(name, np.zeros((LENGTHS, STEPS + 1), dtype=np.int64))[np.arange(len(step)), step] += 1
        for name, own in counts.items():
            i, step = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(step, pa.int32()), pa.array(own[i, step], pa.int64())], names=["lang", "at", "step", "n"])

    floor = [0.0] * LENGTHS
    if not profiles.names:
        return floor
    made: dict[tuple[int, str], np.ndarray] = {}
    for r in src.mapInArrow(lean(run), "lang string, at int, step int, n long").groupBy("lang", "at", "step").agg(F.sum("n").alias("n")).collect():
        made.setdefault((r["at"], r["lang"]), np.zeros(STEPS + 1, dtype=np.int64))[r["step"]] = r["n"]
    for i in range(LENGTHS):
        reached = [int(np.searchsorted(np.cumsum(own), SHARE * own.sum(), side="right")) / STEPS for (at, _), own in made.items() if at == i and own.sum() >= ENOUGH]
        floor[i] = min(reached, default=0.0) * MARGIN
    return floor


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang_pred", score: str = "score", floor: list[float] | None = None) -> DataFrame:
    """docs with two more columns; a column of docs that has one of their names is replaced, so a caller that needs it names them otherwise.

    Null texts are unknown, repeated rows repeat. floor: as of floors. Of equally near languages the first by name is taken. An empty table stays empty.
    """
    need(docs, text)
    src = docs.drop(lang, score)
    names = src.columns
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                got = shared.value.predict(part.column(at).to_pylist(), floor)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*names, lang, score])

    schema = src.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score)).schema
    return src.mapInArrow(lean(run), schema)
