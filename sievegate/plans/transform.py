"""Raw text to a training set: label, redact, drop copies, filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegate.functions.patterns import redact
from sievegate.operators import filters, stats


def transform(df: DataFrame, key: str, text: str = "text", shortest: int = 20, longest: int = 512, redact_first: bool = True, label: bool = True) -> DataFrame:
    """df's rows that pass, with label where asked: redacted, first of their copies, and failing no filter."""
    out = df.withColumn(text, redact(F.col(text))) if redact_first else df
    out = out.withColumn("label", filters.sentiment(F.col(text))) if label else out
    return stats.keep_first(out, key, text).where(filters.rejection(F.col(text), shortest, longest).isNull())


def redacted_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, changed: how many cells of the columns redaction changes."""
    changed = [F.coalesce((F.col(c) != redact(F.col(c))).cast("int"), F.lit(0)) for c in columns]
    return df.agg(F.coalesce(F.sum(sum(changed[1:], changed[0])), F.lit(0)).alias("changed"))
