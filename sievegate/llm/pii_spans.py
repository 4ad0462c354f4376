"""Personal data as spans: patterns propose, validators confirm, context words move the score.

Everything is a built-in expression. Positions are code points: a pattern's matches and the gaps
between them (the text split by the same pattern) have lengths whose running sums are the starts.
Java's matcher recurses for a repeated group, so the patterns repeat character classes only: where
a group would repeat, the separators that it allows are first masked by U+0001, one for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, need

#: Kinds in their order, with the score before context. The first four are always kept.
BASE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6}
ADDED = {"iban": 0.8, "ssn": 0.3}
#: Words that raise a span's score if one stands in the WINDOW code points before it.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address",
    "card": "card|visa|mastercard|amex|credit|debit",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|tax id",
}
WINDOW, LIFT, LEAST = 40, 0.4, 0.6

_MASK = "\x01"
_WORD = "A-Za-z0-9"
#: What the masked text is searched for. A lookbehind that a match could not cross anyway, unless
#: the last match ended there, keeps the search of long runs linear.
EMAIL = rf"(?:\G|(?<![{_WORD}._%+\x01-]))[{_WORD}._%+\x01-]+@[{_WORD}-]+\x01[{_WORD}\x01-]+"
IP = r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9\x01]{16,}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<hit, start, end>> of the pattern's non-overlapping matches, leftmost first.

    Starts are sums over the matches before; sums of 64 keep long texts with many matches cheap.
    """
    size = 64

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def placed(v: Column) -> Column:
        blocks = F.when(F.size(v["step"]) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v["step"]) - 1) / size).cast("int")), lambda b: total(F.slice(v["step"], b * size + 1, size)))).otherwise(F.array().cast("array<int>"))

        def row(b: Column) -> Column:
            def one(hit: Column, i: Column) -> Column:
                at = F.floor(i / size).cast("int")
                start = total(F.slice(b["sums"], 1, at)) + total(F.slice(v["step"], at * size + 1, i - at * size)) + F.get(v["gap"], i)
                return F.struct(hit.alias("hit"), start.alias("start"), (start + F.length(hit)).alias("end"))

            return F.transform(v["hits"], one)

        return let(F.struct(blocks.alias("sums")), row)

    def stepped(v: Column) -> Column:
        step = F.transform(v["hits"], lambda h, i: F.length(h) + F.get(v["gap"], i))
        return let(F.struct(v["hits"].alias("hits"), v["gap"].alias("gap"), step.alias("step")), placed)

    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), gaps.alias("gap")), stepped)


def _masked(text: Column, separators: str) -> Column:
    """text with each separator (a lookaround pattern of one character) as U+0001, and its own U+0001 as U+0002."""
    return F.regexp_replace(F.translate(text, _MASK, "\x02"), separators, _MASK)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters as 10 to 35, leave 1 modulo 97."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(a: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _byte_sized(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(F.when(F.length(short) <= 3, short).try_cast("int"), F.lit(0)) <= 255)


def _alone(text: Column, m: Column, kind: str) -> Column:
    before, after = F.substring(text, m["start"], F.lit(1)), F.substring(text, m["end"] + 1, F.lit(1))
    before = F.when(m["start"] > 0, before).otherwise("")
    return ~before.rlike(kind) & ~after.rlike(kind)


def _valid(kind: str, text: Column, m: Column) -> Column:
    hit = m["hit"]
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), _byte_sized)
    if kind == "card":
        d = _digits(hit)
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "iban":
        return _alone(text, m, f"[{_WORD}]") & F.length(F.translate(hit, " ", "")).between(15, 34) & mod97(F.translate(hit, " ", ""))
    if kind == "ssn":
        area, group, serial = (F.substring(hit, a, n) for a, n in ((1, 3), (5, 2), (8, 4)))
        return _alone(text, m, "[0-9-]") & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    return F.lit(True)


def _score(kind: str, text: Column, m: Column) -> Column:
    start = F.greatest(m["start"] - WINDOW, F.lit(0))
    near = F.lower(F.substring(text, start + 1, m["start"] - start)).rlike(f"(?:^|[^a-z])(?:{CONTEXT[kind]})")
    return F.least(F.lit(1.0), F.lit((BASE | ADDED)[kind]) + F.when(near, F.lit(LIFT)).otherwise(F.lit(0.0)))


def spans(text: Column) -> Column:
    """array<struct<kind, start, end, score>> of a non-null text column, by kind and then start.

    A kind's patterns run only on texts that a cheap test lets through. Matches that fail their
    validator are dropped and not tried again; spans of added kinds also need a score of LEAST.
    """
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    dots = rf"(?<=[{_WORD}-])\.(?=[{_WORD}-])"
    tries = {
        "email": (F.contains(text, F.lit("@")), _masked(text, dots), EMAIL),
        "ip": (text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), text, IP),
        "card": (text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), _masked(text, r"(?<=[0-9])[ -](?=[0-9])"), CARD),
        "phone": (text.rlike(r"\+[0-9]"), text, PHONE),
        "iban": (text.rlike(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{10}"), text, IBAN),
        "ssn": (text.rlike(SSN), text, SSN),
    }

    def of(kind: str, maybe: Column, searched: Column, pattern: str) -> Column:
        kept = F.filter(matches(searched, pattern), lambda m: _valid(kind, text, m))
        own = F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _score(kind, text, m).alias("score")))
        return F.when(maybe, F.filter(own, lambda s: s["score"] >= LEAST) if kind in ADDED else own).otherwise(empty)

    return F.concat(*[of(kind, *how) for kind, how in tries.items()])


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """df with one more column of spans; a column of that name is replaced.

    Null texts count as empty and have an empty list; repeated rows repeat, an empty table stays empty. Spans of
    one kind never tie; those of several kinds may overlap. A text costs in proportion to its length, a long one with
    very many matches somewhat more.
    """
    need(df, text)
    return df.withColumn(out, spans(F.coalesce(F.col(text), F.lit(""))))


def redacted(text: Column, found: Column) -> Column:
    """text with each span as [KIND]; spans that overlap become one, named by the first to start (then the longest)."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def add(a: Column, s: Column) -> Column:
        end = -s["less"]
        apart = s["start"] >= a["at"]
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], end).alias("at"), F.when(apart, F.concat(a["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"]).alias("out"))

    def end(a: Column) -> Column:
        return F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, end))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the spans of its text column replaced by their kinds; null texts stay null."""
    need(df, text)
    found = f"{text}_spans"
    while found in df.columns:
        found += "_"
    return find(df, text, found).withColumn(text, F.when(F.col(text).isNotNull(), redacted(F.col(text), F.col(found)))).drop(found)
