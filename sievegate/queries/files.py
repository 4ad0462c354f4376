"""Files written and read again: each source and sink, ingest, logs, artifacts, the monitor."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sievegate.operators import history, records
from sievegate.plans.ingest import ingest
from sievegate.queries.registry import STRIPPED, documents, query, table
from sievegate.sources import readers, sinks
from sievegate.sources.sinks import new_path
from sievegate.streaming import windows

_HASHED = "select doc_id, sha256(coalesce(text, '')) as h, coalesce(lang, '') as lang from documents"


def _hashed(rows):
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text("text"), 256).alias("h"), text("lang").alias("lang"))


@query("csv_scan", _HASHED)
def csv_scan(spark, sf_dir):
    path = f"{new_path(spark)}.csv"
    sinks.write_csv(documents(spark, sf_dir), path, ["doc_id", "text", "lang"])
    return _hashed(readers.read_dataset(spark, path))


@query("tsv_scan", _HASHED)
def tsv_scan(spark, sf_dir):
    path = f"{new_path(spark)}.tsv"
    sinks.write_csv(documents(spark, sf_dir), path, ["doc_id", "text", "lang"], sep="\t")
    return _hashed(readers.read_dataset(spark, path, columns=["lang", "text", "doc_id"]))


@query("jsonl_scan", _HASHED)
def jsonl_scan(spark, sf_dir):
    path = f"{new_path(spark)}.jsonl"
    sinks.write_jsonl(documents(spark, sf_dir), path)
    return _hashed(readers.read_dataset(spark, path))


@query("json_scan", "select n_nationkey, n_name from nation")
def json_scan(spark, sf_dir):
    """A file that is one list, of a small table."""
    path = f"{new_path(spark)}.json"
    nations = table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    nations.write.text(path)
    return readers.read_dataset(spark, path).select("n_nationkey", "n_name")


@query("text_scan", r"select sha256(t) as h, count(*) as n from (select regexp_replace(l, '^\s+|\s+$', '', 'g') as t from (select unnest(regexp_split_to_array(text, '\r\n|\r|\n')) as l from documents)) where t <> '' group by t")
def text_scan(spark, sf_dir):
    path = f"{new_path(spark)}.txt"
    documents(spark, sf_dir).where("text is not null").select("text").write.text(path)
    return readers.read_dataset(spark, path).groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))


@query("folder_scan", "select 'a.jsonl' as source, count(*) as n from documents union all select 'b.jsonl', count(*) from benchmark")
def folder_scan(spark, sf_dir):
    path = new_path(spark)
    sinks.write_jsonl(documents(spark, sf_dir).select("text"), f"{path}/a.jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "benchmark").select("text"), f"{path}/b.jsonl")
    rows = readers.read_folder(spark, path, ".jsonl")
    return rows.groupBy(F.element_at(F.split("_source", "/"), -2).alias("source")).agg(F.count("*").alias("n"))


@query("hub_scan", _HASHED)
def hub_scan(spark, sf_dir):
    root = new_path(spark)
    documents(spark, sf_dir).write.parquet(f"{root}/corpus/full/train.parquet")
    return _hashed(readers.read_dataset(spark, "hf://corpus/full?split=train", hub_root=root))


@query("line_count", "select count(*) as lines, true as sized from documents")
def line_count(spark, sf_dir):
    path = f"{new_path(spark)}.jsonl"
    sinks.write_jsonl(documents(spark, sf_dir), path)
    size = readers.file_hashes(spark, f"{path}/*.json").agg((F.sum("length") > 0).alias("sized"))
    return readers.line_count(spark, path).crossJoin(size)


@query("artifact", "select 'PASS' as status, count(*) as rows from documents")
def artifact(spark, sf_dir):
    """The manifest's digests against the files, and the dataset's rows."""
    path, docs = new_path(spark), documents(spark, sf_dir)
    manifest = sinks.write_artifact(docs, path, docs.agg(F.count("*").alias("rows")))
    found = readers.file_hashes(spark, f"{path}/dataset.jsonl/*.json").unionByName(readers.file_hashes(spark, f"{path}/report.json/*.json"))
    status = history.verify(manifest, found).select("status").distinct()
    return status.crossJoin(readers.read_jsonl(spark, f"{path}/dataset.jsonl").agg(F.count("*").alias("rows")))


_CONFIG = {"name": "corpus", "filters": ["empty", "pii"], "seed": 42}
_FROZEN = '{"filters": ["empty", "pii"], "name": "corpus", "seed": 42}'


@query(
    "transform_artifact",
    f"""select 't1' as transform, count(*) as rows, 'doc_id: bigint, lang: string, text: string' as row_schema, '{hashlib.sha256(_FROZEN.encode()).hexdigest()}' as config_sha256, true as chained,
  (select '[' || string_agg('{{"tag":"lang","value":"' || lang || '","n":' || n || '}}', ',' order by lang) || ']' from (select lang, count(*) as n from documents where lang is not null group by lang)) as tag_distribution from documents""",
)
def transform_artifact(spark, sf_dir):
    meta = sinks.write_transform(documents(spark, sf_dir).select("doc_id", "text", "lang"), new_path(spark), "t1", _CONFIG, ["lang"])
    return meta.select("transform", "rows", "row_schema", "config_sha256", (F.length("chain_hash") == 64).alias("chained"), "tag_distribution")


@query("event_log", "select event_type, count(*) as events, sum(event_id)::bigint as total from events group by event_type")
def event_log(spark, sf_dir):
    """A log appended to twice and aggregated anew."""
    path, events = new_path(spark), table(spark, sf_dir, "events").select("event_id", "event_type")
    sinks.append_events(events.where("event_id % 2 = 0"), path)
    sinks.append_events(events.where("event_id % 2 = 1"), path)
    log = readers.read_jsonl(spark, path, events.schema)
    return log.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("event_id").alias("total"))


def _tagged(spark, sf_dir):
    """Documents under other names: body, topic, and for the even ones tags of their own as JSON."""
    own = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.lit("own").alias("origin"), "lang")))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("number"), F.col("text").alias("Body"), F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("topic"), own.alias("tags"))


#: What the columns of a source may be called.
SYNONYMS = {"text": ("body", "content"), "label": ("category", "topic")}


def _ingested(spark, sf_dir):
    rows = _tagged(spark, sf_dir)
    return ingest(rows, mapping=records.map_fields(rows.columns, SYNONYMS), tags={"origin": "added", "batch": "b1"}, id_column="number")


@query(
    "ingest_tags",
    rf"select doc_id::varchar as row_id, case source when 'src0' then 'first' when 'src1' then 'second' else {STRIPPED.replace('text', 'source')} end as label, case when doc_id % 2 = 0 then 'own' else 'added' end as origin, 'b1' as batch, case when doc_id % 2 = 0 then lang end as lang from documents where {STRIPPED} <> '' and doc_id % 9 <> 0 and {STRIPPED.replace('text', 'source')} <> ''",
)
def ingest_tags(spark, sf_dir):
    """Columns found by their synonyms, a row's own tags before the added ones, labels renamed."""
    rows = _ingested(spark, sf_dir).rows
    label = records.remap(F.col("label"), {"src0": "first", "src1": "second"})
    return rows.select("row_id", label.alias("label"), *[F.col("tags")[t].alias(t) for t in ("origin", "batch", "lang")])


@query("ingest_dropped", rf"select count(*) as n from documents where not ({STRIPPED} <> '' and doc_id % 9 <> 0 and {STRIPPED.replace('text', 'source')} <> '')")
def ingest_dropped(spark, sf_dir):
    return _ingested(spark, sf_dir).dropped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("monitor_stream", "select 0::bigint as tick, round(avg(value), 6) as metric, null::double as delta, false as regression from events")
def monitor_stream(spark, sf_dir):
    """The monitor over a stream that reads the table in one batch."""
    schema, out = table(spark, sf_dir, "events").schema, new_path(spark)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    windows.monitor(stream, out, lambda batch: batch.agg(F.avg("value").alias("metric")), checkpoint=new_path(spark), availableNow=True).awaitTermination()
    return spark.read.schema("tick long, metric double, delta double, regression boolean").json(out).withColumn("metric", F.round("metric", 6))
