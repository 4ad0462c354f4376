"""Text as columns: tokens, n-grams, normalisers, canonical JSON.

White space is Unicode's, as (?U) gives it; the separators U+001C to U+001F are not split on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once a row, whatever the optimizer inlines into lambdas."""
    return F.transform(F.array(value), then)[0]


#: Unicode's white space, as (?U)\s has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """text without the white space around it. A pattern would be tried at each of the text's spaces."""
    return F.trim(text, F.lit(SPACE))


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def alnum_tokens(text: Column, stopwords: list[str]) -> Column:
    """[a-z0-9]+ of the lower-cased text, of two characters or more, without stopwords."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(stopwords))


def word_ngrams(words: Column, n: int, short: str = "words") -> Column:
    """Distinct n-grams joined by a space. With fewer words: the words ("words"), all joined ("joined"), or none ("none")."""

    def grams(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - n)
        full = F.transform(places, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))
        less = {"words": w, "joined": F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")), "none": F.array().cast("array<string>")}[short]
        return F.array_distinct(F.when(F.size(w) >= n, full).otherwise(less))

    return let(words, grams)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased, stripped text; a shorter text is its own."""

    def grams(c: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + j) for j in range(n)]))
        return F.array_distinct(F.when(F.size(c) >= n, full).when(F.size(c) > 0, F.array(F.array_join(c, ""))).otherwise(F.array().cast("array<string>")))

    return let(F.filter(F.split(strip(F.lower(F.coalesce(text, F.lit("")))), ""), lambda c: c != ""), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    shared, x, y = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.when((x == 0) & (y == 0), 1.0).otherwise(let(shared, lambda s: s / (x + y - s)))


def containment(a: Column, b: Column) -> Column:
    """Share of a's elements that b has; 0 for an empty a."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def normalise(text: Column, how: str = "punctuation") -> Column:
    """"punctuation": lower case, punctuation to spaces, spaces collapsed. "spaces": lower case and spaces only.
    "squad": lower case, punctuation dropped, English articles dropped, spaces collapsed."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if how == "punctuation":
        low = F.regexp_replace(low, r"(?U)[^\w\s]", " ")
    elif how == "squad":
        low = F.regexp_replace(F.regexp_replace(low, r"[!-/:-@\[-`{-~]", ""), r"(?U)\b(?:a|an|the)\b", " ")
    elif how != "spaces":
        raise ValueError(how)
    return strip(F.regexp_replace(low, r"(?U)\s+", " "))


def json_string(text: Column) -> Column:
    """A JSON string literal in which characters beyond ASCII stand as they are."""
    out = text
    for char, escape in (("\\", r"\\"), ('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t"), ("\b", r"\b"), ("\f", r"\f")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_json(columns: dict[str, Column]) -> Column:
    """An object of string columns with sorted keys, ", " and ": " between; a null is null."""
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(json_string(columns[k]), F.lit("null"))) for k in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
