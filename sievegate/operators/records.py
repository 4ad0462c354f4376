"""Record schemas: detection, required fields, canonical form, flattening, chat expansion, ids, buckets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegate.functions.text import canonical_json, strip


@dataclass(frozen=True)
class Schema:
    """A record kind: any group of required fields, and column sets that give it away."""

    name: str
    required: tuple[tuple[str, ...], ...]
    signatures: tuple[frozenset[str], ...]


#: The eight kinds, in the order in which detection tries them.
SCHEMAS = {
    s.name: s
    for s in (
        Schema("rm_pairwise", (("prompt", "chosen", "rejected"),), (frozenset({"prompt", "chosen", "rejected"}),)),
        Schema("nl2sql", (("question", "sql", "schema"), ("question", "sql", "schema_ref")), (frozenset({"question", "sql", "schema"}), frozenset({"question", "sql", "schema_ref"}), frozenset({"question", "sql", "db_id"}),)),
        Schema("qa", (("question", "context", "answer"),), (frozenset({"question", "context", "answer"}), frozenset({"passage", "question", "answer"}),)),
        Schema("chat", (("messages",),), (frozenset({"messages"}), frozenset({"conversations"}),)),
        Schema("summarization", (("document", "summary"),), (frozenset({"document", "summary"}), frozenset({"article", "highlights"}), frozenset({"article", "summary"}),)),
        Schema("translation", (("source", "target"),), (frozenset({"source", "target", "source_lang"}), frozenset({"source", "target", "target_lang"}), frozenset({"src", "tgt"}),)),
        Schema("sft", (("input", "output"), ("question", "answer")), (frozenset({"input", "output"}), frozenset({"instruction", "output"}), frozenset({"instruction", "response"}), frozenset({"prompt", "completion"}), frozenset({"question", "answer"}),)),
        Schema("classification", (("text", "label"),), (frozenset({"text", "label"}), frozenset({"body", "category"}), frozenset({"input", "label"}), frozenset({"sentence", "label"}), frozenset({"text", "class"}),)),
    )
}


def detect(columns: list[str]) -> str | None:
    """The first kind one of whose signatures the columns (in any case) contain."""
    have = {c.lower() for c in columns}
    return next((s.name for s in SCHEMAS.values() if any(x <= have for x in s.signatures)), None)


def has_required(df: DataFrame, schema: str) -> Column:
    """Whether all fields of some required group are there and not blank."""

    def filled(c: str) -> Column:
        if c not in df.columns:
            return F.lit(False)
        kind = df.schema[c].dataType
        return F.coalesce(F.size(c) > 0, F.lit(False)) if isinstance(kind, (T.ArrayType, T.MapType)) else F.coalesce(strip(F.col(c).cast("string")) != "", F.lit(False))

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [filled(c) for c in group]) for group in SCHEMAS[schema].required])


def missing(df: DataFrame, schema: str) -> Column:
    """Why a row lacks its kind's fields: the fields of each required group, joined by " OR "."""
    return F.lit("missing required fields " + " OR ".join(", ".join(group) for group in SCHEMAS[schema].required))


def row_schema(df: DataFrame) -> Column:
    """The kind that a row's own filled fields give away, "unknown" without one; the first that fits, as for columns."""
    have = {c.lower(): c for c in df.columns}
    chain = None
    for s in SCHEMAS.values():
        for fields in s.signatures:
            if fields <= have.keys():
                fits = reduce(lambda a, b: a & b, [F.col(have[c]).isNotNull() for c in sorted(fields)])
                chain = F.when(fits, s.name) if chain is None else chain.when(fits, s.name)
    return F.lit("unknown") if chain is None else chain.otherwise("unknown")


def votes(df: DataFrame) -> DataFrame:
    """schema, rows: how many rows vote for each kind."""
    return df.groupBy(row_schema(df).alias("schema")).agg(F.count("*").alias("rows"))


def classified(df: DataFrame, text: Column, email: str, phone: str) -> DataFrame:
    """One row: rows, schema (of most votes; ties go to the first name), duplicate_rate, email_rows, phone_rows, pii_rows, schemas (the other kinds), warnings.

    Every row is scanned. warnings are empty, unknown_schema, duplicates (above 0.05), pii, mixed_schemas.
    """
    named = df.select(row_schema(df).alias("schema"), F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256).alias("h"), text.alias("t"))
    named = named.withColumns({"email": F.coalesce(F.col("t").rlike(email), F.lit(False)), "phone": F.coalesce(F.col("t").rlike(phone), F.lit(False))})
    hit = lambda c: F.count(F.when(c, 1))
    one = named.agg(F.count("*").alias("rows"), hit(F.col("email")).alias("email_rows"), hit(F.col("phone")).alias("phone_rows"), hit(F.col("email") | F.col("phone")).alias("pii_rows"))
    copies = named.groupBy("h").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("copies"))
    kinds = named.groupBy("schema").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "schema"))).alias("k"))
    made = one.crossJoin(copies).crossJoin(kinds).withColumn("duplicate_rate", F.round(F.coalesce(F.expr("try_divide(copies, rows)"), F.lit(0.0)), 4))
    made = made.withColumns({"schema": F.coalesce(F.get("k", F.lit(0))["schema"], F.lit("unknown")), "schemas": F.array_sort(F.transform(F.slice("k", 2, F.greatest(F.size("k"), F.lit(1))), lambda x: x["schema"]))})
    told = {"empty": F.col("rows") == 0, "unknown_schema": (F.col("schema") == "unknown") & (F.col("rows") > 0), "duplicates": F.col("duplicate_rate") > 0.05, "pii": F.col("pii_rows") > 0, "mixed_schemas": F.size("schemas") > 0}
    warnings = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in told.items()]), lambda x: x.isNotNull())
    return made.select("rows", "schema", "duplicate_rate", "email_rows", "phone_rows", "pii_rows", "schemas", warnings.alias("warnings"))


def tag_map(df: DataFrame, tags: str = "tags") -> Column:
    """A row's own tags as map<string,string>: a map, a struct, or a string of JSON; anything else, and what can't be read, has none."""
    none = F.create_map().cast("map<string,string>")
    if tags not in df.columns:
        return none
    kind = df.schema[tags].dataType
    if isinstance(kind, T.MapType):
        own = F.col(tags).cast("map<string,string>")
    elif isinstance(kind, T.StructType):
        own = F.from_json(F.to_json(tags), "map<string,string>")
    elif isinstance(kind, T.StringType):
        own = F.when(F.col(tags).rlike(r"(?s)^\s*\{"), F.from_json(tags, "map<string,string>"))
    else:
        return none
    return F.coalesce(own, none)


def merged_tags(own: Column, added: dict[str, str]) -> Column:
    """own with the added tags whose keys it lacks."""
    more = F.create_map(*[F.lit(x) for pair in added.items() for x in pair]) if added else F.create_map().cast("map<string,string>")
    return F.map_concat(F.map_filter(more, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(own), k), F.lit(False))), own)


def remap(label: Column, mapping: dict[str, str]) -> Column:
    """label by the mapping; labels that it lacks stay."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[label], label) if mapping else label


def map_fields(columns: list[str], synonyms: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """canonical name to source column: for each canonical name that the columns lack, the first of its synonyms (in any case) that they have."""
    have = {c.lower(): c for c in columns}
    found = {name: [have[s] for s in tries if s in have] for name, tries in synonyms.items() if name not in have}
    return {name: hits[0] for name, hits in found.items() if hits}


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """mapping: canonical name to source column; other columns stay."""
    return df.withColumnsRenamed({source: name for name, source in mapping.items()})


def flatten(df: DataFrame, sep: str = ".", depth: int = 10, keep: tuple[str, ...] = ("tags", "messages", "conversations")) -> DataFrame:
    """Nested structs as columns of dotted names; those of keep stay at the top."""

    def walk(path: str, name: str, kind: T.DataType, level: int) -> list[Column]:
        if isinstance(kind, T.StructType) and level < depth and name not in keep:
            return [c for f in kind.fields for c in walk(f"{path}.`{f.name}`", f"{name}{sep}{f.name}", f.dataType, level + 1)]
        return [F.col(path).alias(name)]

    return df.select(*[c for f in df.schema.fields for c in walk(f"`{f.name}`", f.name, f.dataType, 0)])


def canonical_columns(df: DataFrame, schema: str) -> list[Column]:
    """The kind's canonical string columns: input and output, text and label, or the kind's own; blank where a field is missing."""

    def get(*names: str) -> Column:
        return F.coalesce(*[F.nullif(strip(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns], F.lit(""))

    pair = lambda a, b: [a.alias("input"), b.alias("output")]
    if schema == "sft":
        return pair(get("input", "question"), get("output", "answer"))
    if schema == "qa":
        return pair(F.concat(F.lit("Context:\n"), get("context", "passage"), F.lit("\n\nQuestion:\n"), get("question")), get("answer"))
    if schema == "classification":
        return [get("text", "body", "input", "sentence").alias("text"), get("label", "category", "class").alias("label")]
    if schema == "summarization":
        return pair(get("document", "article"), get("summary", "highlights"))
    if schema == "translation":
        return pair(get("source", "src"), get("target", "tgt"))
    if schema in ("rm_pairwise", "nl2sql"):
        own = ("prompt", "chosen", "rejected") if schema == "rm_pairwise" else ("question", "sql", "schema", "schema_ref", "db_id")
        return [get(c).alias(c) for c in own]
    raise ValueError(schema)


def canonical(df: DataFrame, schema: str, key: str | None = None) -> DataFrame:
    """The canonical columns, with key (if one is given) before them; a conversation gives a row for each pair."""
    keys = [key] if key else []
    if schema != "chat":
        return df.select(*keys, *canonical_columns(df, schema))
    turns = "messages" if "messages" in df.columns else "conversations"
    own = df if key else df.withColumn("__id", F.monotonically_increasing_id())
    return chat_pairs_of_arrays(own, key or "__id", turns).select(*keys, F.col("user").alias("input"), F.col("assistant").alias("output"))


def row_id(columns: dict[str, Column]) -> Column:
    """row_ and 16 digits of the SHA-256 of the row's canonical JSON."""
    return F.concat(F.lit("row_"), F.substring(F.sha2(canonical_json(columns), 256), 1, 16))


def chat_pairs(df: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """conversation, pair, user, assistant, system for each user turn that an assistant turn follows; the last system prompt before it."""
    order = Window.partitionBy(conversation).orderBy(turn)
    prompt = F.last(F.when(F.col(role) == "system", F.col(text)), ignorenulls=True).over(order)
    said = df.withColumn("__system", prompt).where(F.col(role) != "system")
    led = said.select("*", F.lead(role).over(order).alias("__role"), F.lead(text).over(order).alias("__text"))
    pairs = led.where((F.col(role) == "user") & (F.col("__role") == "assistant"))
    return pairs.select(conversation, (F.row_number().over(order) - 1).cast("long").alias("pair"), F.col(text).alias("user"), F.col("__text").alias("assistant"), F.col("__system").alias("system"))


def chat_pairs_of_arrays(df: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """As chat_pairs, for one row per conversation with an array of structs of role and content."""
    turns = df.select(key, F.posexplode(messages).alias("turn", "m")).select(key, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))
    return chat_pairs(turns, key, "turn")


def category(df: DataFrame, keys: tuple[str, ...] = ("category", "tag", "source", "type", "topic")) -> Column:
    """The first filled field of keys in lower case, or "uncategorized"."""
    return F.coalesce(*[F.nullif(F.lower(strip(F.col(k).cast("string"))), F.lit("")) for k in keys if k in df.columns], F.lit("uncategorized"))


def buckets(df: DataFrame, schema: str | None = None) -> DataFrame:
    """schema, category, count, fraction."""
    rows = df.select(F.lit(schema or detect(df.columns) or "unknown").alias("schema"), category(df).alias("category"))
    counts = rows.groupBy("schema", "category").agg(F.count("*").alias("count"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).select("schema", "category", "count", (F.col("count") / F.col("total")).alias("fraction"))


#: The fields that training asks for, by task; and where a question, context and answer may stand.
TRAINED = {"sft": ("instruction", "output"), "classification": ("text", "label")}
QUESTION, CONTEXT, ANSWER = ("question", "input", "text"), ("context", "passage"), ("answer", "output", "target")


def trainable(df: DataFrame, task: str) -> DataFrame:
    """df, if its columns have the task's fields; else a ValueError names those it lacks. Values may be blank."""
    lacking = [c for c in TRAINED[task] if c not in df.columns]
    if lacking:
        raise ValueError(f"missing fields {lacking} for task {task!r}")
    return df


def experiment_rows(df: DataFrame, key: str, split: str, kind: str = "generic") -> DataFrame:
    """id (split and key), question, context, answer, content_hash of a dataset's rows; what is missing is empty.

    kind "squad": the first of answers.text. "cosmos_qa": the answer column that label numbers. Else the first of QUESTION, CONTEXT
    and ANSWER that is a column; an array, or a struct's text array, gives its first element.
    """
    has = lambda names: next((c for c in names if c in df.columns), None)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")

    def first(column: Column, type_: T.DataType) -> Column:
        if isinstance(type_, T.StructType) and "text" in type_.names:
            return first(column["text"], type_["text"].dataType)
        return F.coalesce((F.get(column, 0) if isinstance(type_, T.ArrayType) else column).cast("string"), F.lit(""))

    if kind == "cosmos_qa":
        numbered = [c for c in df.columns if c.startswith("answer") and c[6:].isdigit()]
        label = F.coalesce(F.col("label").cast("int"), F.lit(0)) if "label" in df.columns else F.lit(0)
        answer = F.coalesce(*[F.when(label == int(c[6:]), F.col(c)) for c in numbered], F.lit(""))
    else:
        name = has(("answers",) if kind == "squad" else ANSWER)
        answer = first(F.col(name), df.schema[name].dataType) if name else F.lit("")
    question = text(has(("question",) if kind != "generic" else QUESTION))
    context = text(has(("context",) if kind != "generic" else CONTEXT))
    parts = df.select(F.concat_ws("_", F.lit(split), F.col(key).cast("string")).alias("id"), question.alias("question"), context.alias("context"), answer.alias("answer"))
    return parts.withColumn("content_hash", F.sha2(F.concat_ws("|||", "question", "context", "answer"), 256))


def mostly_ascii(text: Column) -> Column:
    """Whether nine tenths of the characters are ASCII; an empty text is."""
    n = F.length(text)
    return F.when(n == 0, F.lit(True)).otherwise(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / n >= 0.90)


def contract(df: DataFrame, schema: str) -> DataFrame:
    """One row: rows, valid, invalid, status of the kind's required fields."""
    one = df.agg(F.count("*").alias("rows"), F.count(F.when(has_required(df, schema), 1)).alias("valid"))
    return one.select("rows", "valid", (F.col("rows") - F.col("valid")).alias("invalid"), F.when(F.col("rows") == F.col("valid"), "PASS").otherwise("FAIL").alias("status"))
