"""Document fingerprints from chains of content words that follow common words.

A common word of running prose, an anchor, and the next content words after it make a spot
signature; boilerplate and lists, which have few anchors, hardly count. A document's fingerprint
stands for its set of distinct signatures. Sets are likened by Jaccard, by partitions of their
length: sets whose partitions or lengths alone bound the likeness below a threshold are never intersected.

The j-th anchor (from 0) of a text at word place p has p - j content words before it, so its chain
starts at place p - j of the content words: one pass over the words and no search.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PART, let, need, partitions

#: Common words of English, German, French and Spanish.
ANCHORS = """
the of and to in a is that it for was on as with be by this are at from or an not but have which
der die das und den von zu mit sich auf im dem nicht ein eine als auch es des er ist bei aus nach
le la les de et un une du en que qui dans par pour pas sur avec au ce il est plus ne se
el los las del y por con lo su una al como para no si sus
""".split()
#: Content words of a chain; with fewer signatures than FEW a text's words and word pairs count too.
CHAIN, FEW = 2, 4
#: A likeness below this counts as none, so that lengths alone can decide; and bytes of texts in a range of keys.
LEAST, RANGE = 0.05, 128 << 20


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """array<bigint>, sorted: hashes of the distinct signatures of a text; null counts as empty.

    Words are runs of letters and digits in lower case. Chains that the text ends within are left out.
    A text with fewer signatures than FEW adds its word pairs and words; one without any word is its
    own signature; only an empty text has an empty set.
    """
    common = sorted(set(anchors))
    body = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def chains(w: Column) -> Column:
        places = F.filter(F.when(F.size(w["w"]) > 0, F.sequence(F.lit(0), F.size(w["w"]) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(w["w"], i).isin(common))
        content = F.filter(w["w"], lambda x: ~x.isin(common))

        def of(p: Column) -> Column:
            whole = F.filter(F.transform(p["at"], lambda i, j: F.struct(i.alias("i"), (i - j).alias("c"))), lambda s: s["c"] + chain <= F.size(p["content"]))
            spots = F.transform(whole, lambda s: F.xxhash64(F.get(w["w"], s["i"]), *[F.get(p["content"], s["c"] + k) for k in range(chain)]))
            ones = F.transform(w["w"], lambda x: F.xxhash64(x))
            pairs = F.when(F.size(w["w"]) > 1, F.transform(F.sequence(F.lit(0), F.size(w["w"]) - 2), lambda i: F.xxhash64(F.get(w["w"], i), F.get(w["w"], i + 1)))).otherwise(F.array().cast("array<bigint>"))
            few = F.when(F.size(w["w"]) > 0, F.concat(spots, pairs, ones)).when(F.length(body) > 0, F.array(F.xxhash64(body))).otherwise(F.array().cast("array<bigint>"))
            return F.when(F.size(whole) >= FEW, spots).otherwise(few)

        return let(F.struct(places.alias("at"), content.alias("content")), of)

    return F.array_sort(F.array_distinct(let(F.struct(found.alias("w")), chains)))


def fingerprint(found: Column) -> Column:
    """A set of signatures as a short string: its length, which partitions, and a digest of its hashes."""
    return F.concat(F.size(found).cast("string"), F.lit("-"), F.substring(F.sha2(F.array_join(found.cast("array<string>"), ","), 256), 1, 32))


def length_part(size: Column, least: float) -> Column:
    """The partition of a set's length. A partition's lengths lie within 1 : 1 / least, so sets of a likeness of least or more are in one or in neighbouring partitions; -1 for an empty set."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.lit(math.log(1 / least)) + F.lit(1e-9)).cast("int")).otherwise(-1)


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard of two signature sets; 0 where their length partitions or lengths alone keep it below least, and 1 for two empty sets.

    The sets of a pruned pair are never intersected. From least on a likeness is exact.
    """
    x, y = F.size(a), F.size(b)
    far = F.abs(length_part(x, least) - length_part(y, least)) > 1
    shared = F.size(F.array_intersect(a, b))
    return F.when((x == 0) & (y == 0), 1.0).when(far, 0.0).when(F.least(x, y) < F.lit(least) * F.greatest(x, y), 0.0).otherwise(let(shared, lambda s: s / (x + y - s)))


#: The place of a row: its key and its text's hash.
Place = tuple[int, int]


def _cuts(quantiles: list[int]) -> list[Place]:
    """Cuts at the quantiles of the keys; a key that several of them name has many rows and is cut by their texts' hashes, too."""
    return [(k, -(2**63) + i * 2**64 // n) for k, n in sorted(Counter(quantiles).items()) for i in range(n)]


def _firsts(rows: DataFrame) -> list[Place]:
    """The smallest place of each range when rows (k, h, text) are cut into ranges of about RANGE bytes, and into as many as there are partitions at least."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = partitions(rows.sparkSession, size * PART // RANGE)
    quantiles = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))).first()[0] or []
    found = rows.groupBy(_range(_cuts(quantiles)).alias("range")).agg(F.min(F.struct("k", "h")).alias("first")).collect()
    return sorted(tuple(r["first"]) for r in found)


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _range(cuts: list[Place]) -> Column:
    """How many of the sorted cuts are at or below (k, h), by binary search."""
    if not cuts:
        return F.lit(0)
    ks, hs = _longs([k for k, _ in cuts]), _longs([h for _, h in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def reached(i: Column) -> Column:
        k = F.get(ks, i)
        return F.coalesce((k < F.col("k")) | ((k == F.col("k")) & (F.get(hs, i) <= F.col("h"))), F.lit(False))

    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(reached(at + step - 1), step).otherwise(0))


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, next (the text of the row with the next larger key; after the last row, the first's), part, order.

    Rows are dealt into ranges of places (key, then the text's hash), each range with a copy of the next
    range's first place; every range is its own task, and a key of very many rows has several. Null
    keys come first and null texts count as empty. part and order are the columns to window by without
    another shuffle.
    """
    need(df, key, text)
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("key", "text", F.coalesce("key", F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("h"))
    firsts = _firsts(rows)
    placed = rows.withColumn("at", _range(firsts))
    before = F.when(F.col("at") > 1, F.col("at") - 1).otherwise(len(firsts))
    own = F.struct(F.col("at").alias("part"), F.lit(0).alias("copy"))
    first = (F.get(_longs([k for k, _ in firsts]), F.col("at") - 1) == F.col("k")) & (F.get(_longs([h for _, h in firsts]), F.col("at") - 1) == F.col("h"))
    places = F.when(first, F.array(own, F.struct(before.alias("part"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    dealt = placed.select("key", "text", "k", "h", F.explode(places).alias("place")).select("key", "text", "place.part", F.struct("place.copy", "k", "h").alias("order"))
    dealt = dealt.repartition(max(1, len(firsts)), "part")
    return dealt.withColumn("next", F.lead("text").over(Window.partitionBy("part").orderBy("order")))


def edited(text: Column, after: Column) -> Column:
    """text with its last quarter (rounded down) replaced by as many first code points of after, or all it has."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(after, F.lit(1), cut))


def compare_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited (the edited text), signatures, edited_signatures, near_edited, near_next for each row.

    near_next likens a row to the next one, near_edited to its own edited text, both by the pruned
    likeness. Rows with null or empty text have an empty set, which equals another empty set; a table
    of one row is its own next. Rows of one key, repeated or null, follow each other in the order of
    their texts' hashes; null keys come first. An empty table gives none. The cost of a text is in proportion to
    its length. Other columns are dropped, so none can clash.
    """
    paired = with_next(df, key, text)
    found = paired.withColumn("own", signatures(F.col("text")))
    led = found.withColumn("next_own", F.lead("own").over(Window.partitionBy("part").orderBy("order"))).where("order.copy = 0")
    made = led.withColumn("edited", edited(F.col("text"), F.col("next"))).withColumn("edited_own", signatures(F.col("edited")))
    return made.select(
        F.col("key").alias(key),
        F.length("text").cast("long").alias("n_chars"),
        "edited",
        F.col("own").alias("signatures"),
        F.col("edited_own").alias("edited_signatures"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
