"""Answers of outside models: a hook that asks one, and what its answers say."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.functions.text import let, strip


def answered(df: DataFrame, prompt: Column, ask: Callable[[list[str]], list[str | None]], into: str = "answer") -> DataFrame:
    """df with one more column, into: what ask answers to the prompts, an Arrow batch at a time.

    ask runs in the Python workers and must be picklable, as a client made inside it is. A task that is run again asks
    again, so write the result before it is read twice.
    """
    asked = F.pandas_udf(lambda prompts: pd.Series(ask(prompts.tolist()), dtype=object), "string").asNondeterministic()
    return df.withColumn(into, asked(prompt))


def parsed(answer: Column, fields: tuple[str, ...]) -> Column:
    """struct of the fields, stripped, of the JSON object in an answer: the first fenced one, the whole answer, or the first flat object in it.

    Null where there is no object or it lacks a field; a field that is null counts as lacking.
    """
    fence = "```"
    parts = F.transform(F.split(answer, fence), lambda p: strip(F.regexp_replace(strip(p), "^json", "")))
    fenced = F.get(F.filter(parts, lambda p: F.startswith(p, F.lit("{"))), 0)
    body = F.when(F.contains(answer, F.lit(fence)), F.coalesce(fenced, answer)).otherwise(strip(answer))

    def read(text: Column) -> Column:
        own = F.when(F.startswith(text, F.lit("{")) & F.get_json_object(text, "$").isNotNull(), text).otherwise(F.regexp_extract(text, r"\{[^{}]+\}", 0))
        values = lambda o: F.array(*[F.get_json_object(o, f"$.{f}") for f in fields])
        made = lambda v: F.struct(*[strip(v[i]).alias(f) for i, f in enumerate(fields)])
        return let(values(own), lambda v: F.when(~F.exists(v, lambda x: x.isNull()), made(v)))

    return let(body, read)
