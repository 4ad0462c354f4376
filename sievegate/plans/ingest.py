"""Raw rows to canonical rows: map, flatten, detect, check, canonicalise, tag, identify."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegate.operators import records


@dataclass(frozen=True)
class Ingested:
    """schema, the canonical rows with row_id and tags, the dropped rows' counts by reason."""

    schema: str
    rows: DataFrame
    dropped: DataFrame


def ingest(df: DataFrame, schema: str = "auto", mapping: dict[str, str] | None = None, tags: dict[str, str] | None = None, id_column: str | None = None, strict: bool = False) -> Ingested:
    """One lazy plan; only the schema's choice looks at the columns on the driver. ValueError where no kind fits.

    id_column names a source column that becomes row_id where it isn't blank; it follows its row through chat
    expansion. A row's own tags win over the added ones. strict raises at the first row without
    its fields; otherwise dropped counts the ten most frequent reasons.
    """
    df = records.rename(df, mapping or {})
    own = records.tag_map(df)
    df = df.withColumn("__tags", records.merged_tags(own, tags or {}))
    df = records.flatten(df, keep=("tags", "__tags", "messages", "conversations"))
    fields = [c for c in df.columns if c != "__tags"]
    kind = records.detect(fields) if schema == "auto" else schema
    if kind not in records.SCHEMAS:
        raise ValueError(f"no schema fits the columns {fields}")
    ok = records.has_required(df, kind)
    if strict and not df.where(~ok).isEmpty():
        raise ValueError(f"a row lacks the fields of {kind}")
    kept = df.where(ok).withColumn("__id", F.nullif(F.trim(F.col(id_column).cast("string")), F.lit("")) if id_column else F.lit(None).cast("string"))
    # a conversation's pairs are gathered by a row number that takes the row's id and tags along
    number = F.monotonically_increasing_id() if kind == "chat" else F.lit(0)
    carried = kept.withColumn("__row", F.struct(number.alias("n"), "__id", F.to_json("__tags").alias("tags")))
    made = records.canonical(carried, kind, "__row").withColumns({"__id": F.col("__row.__id"), "__tags": F.from_json("__row.tags", "map<string,string>")}).drop("__row")
    out = [c for c in made.columns if c not in ("__id", "__tags")]
    named = F.coalesce("__id", records.row_id({c: F.col(c) for c in out}))
    dropped = df.where(~ok).groupBy(records.missing(df, kind).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)
    return Ingested(kind, made.select(named.alias("row_id"), *out, F.col("__tags").alias("tags")), dropped)
