"""Allow or block URLs: the longest rule that fits, else logistic regression on character n-grams.

The model is trained when it is first needed, from the small labelled table below or another of
the same kind, by plain gradient descent on the driver. Scoring is an expression: an aggregate over
the hashed n-grams with the weights as a constant array.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, need

#: Hexadecimal digits that name a bucket, buckets, n-gram lengths, passes over the labelled table, step, and L2 penalty.
DIGITS, BUCKETS, GRAMS, PASSES, STEP, PENALTY = 3, 16**3, (3, 4), 60, 0.5, 0.0005
#: A weight of 1 in whole numbers.
UNIT = 1_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A rule: verdict, host (itself and all its subdomains), start of the path.
Rule = tuple[str, str, str]

#: A small labelled table, names that stand alone or in a host, by label.
UNWANTED = """
casino-win casino win-casino royal-casino casinobonus online-casino slots-win jackpot-win poker-win free-poker free-bets bets
best-bets sports-bets betting bet365x freebets free-spins lottery-win ads-track ads adserver ad-track track-ads clicktrack
ads-click popads banner-ads spam-farm spam linkfarm link-farm spamlinks seo-spam content-farm adult-x adult xxx adult-video
porn xxx-tube sex-cams hot-adult camgirls escort-x pills-cheap viagra-cheap malware-free phish-login free-money win-prize
""".split()
WANTED = """
blog news wiki docs library museum university school garden weather recipes travel history science math physics music art
theatre gallery archive journal press book reader review forum community city village river mountain forest house kitchen
health clinic bank market shop store sport football cycling train station transport tour photo camera paint design software
data code help support about team project research institute thread other there this that these those three through third
thing then than nation station action motion section mention attention relation edition tradition order under over water
winter summer morning evening hands friend shine share ship shelter wheel where which white north south east west
""".split()


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first :// up to /, ? or #, A-Z in lower case; path: from there up to ? or #. Both are empty without ://."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null without one; equal lengths in the order given."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    chain = None
    for verdict, on, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        value = F.struct(F.lit(on + start).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return out if chain is None else chain.otherwise(out)


def features(host: Column, path: Column) -> Column:
    """array<int>: distinct buckets of the n-grams of host and path, A-Z in lower case and every run of digits 0.

    The text is cut into characters once, so the cost follows the length of the URL. A bucket is the start of
    an MD5, which any engine can compute.
    """
    text = F.concat(F.lit("^"), host, F.regexp_replace(F.translate(path, UPPER, UPPER.lower()), "[0-9]+", "0"), F.lit("$"))

    def grams(c: Column, n: int) -> Column:
        places = F.sequence(F.lit(0), F.size(c) - n)
        return F.when(F.size(c) >= n, F.transform(places, lambda i: _bucket(F.concat(*[F.get(c, i + j) for j in range(n)])))).otherwise(F.array().cast("array<int>"))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.array_distinct(F.concat(*[grams(c, n) for n in GRAMS])))


def _bucket(gram: Column) -> Column:
    return F.conv(F.substring(F.md5(gram), 1, DIGITS), 16, 10).cast("int")


def buckets_of(url: str) -> list[int]:
    """The features of one URL, for the small table that is learned from."""
    host, path = "", ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    low = str.maketrans(UPPER, UPPER.lower())
    text = "^" + host.translate(low) + re.sub("[0-9]+", "0", path.translate(low)) + "$"
    found = [int(hashlib.md5(text[i : i + n].encode()).hexdigest()[:DIGITS], 16) for n in GRAMS for i in range(len(text) - n + 1)]
    return list(dict.fromkeys(found))


def labelled() -> list[tuple[str, int]]:
    """url, label (1: block): each name under a few hosts and paths."""
    rows = []
    for label, names in ((1, UNWANTED), (0, WANTED)):
        for i, name in enumerate(names):
            top = ("com", "net", "org")[i % 3]
            rows.append((f"https://{('', 'www.', 'm.', 'blog.')[i % 4]}{name}.example.{top}/{('en', 'de', 'fr', 'es')[i % 4]}/{i}", label))
            rows.append((f"http://{('m.', 'blog.', '', 'www.')[i % 4]}{name}.{('net', 'org', 'com')[i % 3]}/{i}.html", label))
    return rows


@dataclass(frozen=True)
class Model:
    """Weights in units of 1 / UNIT, so that sums don't depend on their order, and an intercept."""

    weights: tuple[int, ...]
    bias: float


def train(table: Sequence[tuple[str, int]]) -> Model:
    """A model from (url, label) pairs, some hundred that the driver holds.

    Stochastic gradient descent in the order of the URLs' digests; a row's gradient is scaled by its number of features.
    """
    rows = [(buckets_of(url), label) for url, label in sorted(table, key=lambda r: (hashlib.md5(r[0].encode()).hexdigest(), r))]
    weights, bias = [0.0] * BUCKETS, 0.0
    for t in range(PASSES):
        step = STEP / (1 + t / 10)
        for found, label in rows:
            size = math.sqrt(len(found) or 1)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights[f] for f in found) / size))))
            bias -= step * 0.1 * (p - label)
            for f in found:
                weights[f] -= step * ((p - label) / size + PENALTY * weights[f])
    return Model(tuple(round(w * UNIT) for w in weights), round(bias, 6))


@functools.cache
def standard() -> Model:
    """The model of the table above."""
    return train(labelled())


def score(host: Column, path: Column, model: Model) -> Column:
    """The chance, 0 to 1, that a URL is to be blocked: its weights' sum over the root of their number."""
    table = F.from_json(F.lit(json.dumps(model.weights)), "array<bigint>")

    def chance(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0).cast("bigint"), lambda a, f: a + F.get(table, f))
        return 1 / (1 + F.exp(-(total / F.lit(float(UNIT)) / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double")) + F.lit(model.bias))))

    return let(features(host, path), chance)


def judge(df: DataFrame, rules: Sequence[Rule] = (), url: str = "url", model: Model | None = None, least: float = 0.5) -> DataFrame:
    """df with host, path, rule, score and verdict: the rule's if one fits, else block from a score of least on.

    Columns of those names are replaced. Null URLs and those without :// have an empty host and path
    and are judged by the model like any other; repeated rows repeat, an empty table stays empty. Of rules of one
    length the first given wins; a score of just least blocks. The cost of a URL is in proportion to its length.
    """
    need(df, url)
    host, path = host_path(F.col(url))
    made = df.withColumns({"host": host, "path": path})
    scored = made.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "score": score(F.col("host"), F.col("path"), model or standard())})
    verdict = F.coalesce("rule.verdict", F.when(F.col("score") >= least, "block").otherwise("allow"))
    return scored.withColumns({"rule": F.col("rule.rule"), "verdict": verdict})
