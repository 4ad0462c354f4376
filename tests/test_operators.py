"""Facts and traps: small tables of our own against plain Python."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegate.functions import patterns, sketch, text
from sievegate.operators import decision, evaluation, filters, gates, governance, history, metering, models, overlap, quality, records, similarity, stats, synthetic, topics
from sievegate.plans import gate, ingest
from sievegate.sources import readers, sinks
from sievegate.streaming import windows


def docs(spark, *texts, name="text"):
    return spark.createDataFrame(list(enumerate(texts)), f"doc_id long, {name} string")


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_tokens_split_on_unicode_space(spark):
    assert one(spark, text.tokens(F.col("t")), t="a b \t c\n") == ["a", "b", "c"]
    assert one(spark, text.strip(F.col("t")), t="  x y \n") == "x y"


def test_char_ngrams_of_short_texts(spark):
    assert one(spark, text.char_ngrams(F.col("t")), t=" Ab ") == ["ab"]
    assert one(spark, text.char_ngrams(F.col("t")), t="") == []
    assert sorted(one(spark, text.char_ngrams(F.col("t")), t="éaéaé")) == ["aéa", "éaé"]


@pytest.mark.parametrize(("short", "expect"), [("words", ["a", "b"]), ("joined", ["a b"]), ("none", [])])
def test_word_ngrams_of_short_texts(spark, short, expect):
    assert one(spark, text.word_ngrams(text.tokens(F.col("t")), 3, short), t="a b") == expect


def test_jaccard_of_empty_sets(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, text.jaccard(empty, empty)) == 1.0
    assert one(spark, text.jaccard(empty, F.array(F.lit("a")))) == 0.0


def test_canonical_json_is_pythons(spark):
    row = {"b": 'say "hi"\n\\ é', "a": None}
    got = one(spark, text.canonical_json({"b": F.col("b"), "a": F.lit(None).cast("string")}), b=row["b"])
    assert got == json.dumps(row, sort_keys=True, ensure_ascii=False)


def test_permutation_is_exact():
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 1, sketch.PRIME, sketch.PRIME + 1, 2**64 - 1], dtype=np.uint64)))
    for a, b in [*sketch.family(8), (sketch.PRIME - 1, sketch.PRIME - 1), (1, 0)]:
        assert [int(v) for v in sketch.permute(x, a, b)] == [(a * int(v) + b) % sketch.PRIME for v in x]


def test_bands():
    assert sketch.bands(64, 0.80) == (8, 8)
    assert sketch.bands(128, 0.70) == (16, 8)
    assert sketch.bands(128, 0.85) == (8, 16)


def test_order_stats_are_list_indices(spark):
    values = [5, 1, 4, 4, 9, 2, 7]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = stats.order_stats(df, F.col("v"), {"median": "floor(n / 2)", "p95": "floor(n * 0.95)"}).first()
    assert (got["median"], got["p95"]) == (sorted(values)[3], sorted(values)[6])


def test_outliers_need_five_rows(spark):
    assert quality.length_outliers(docs(spark, "a", "a", "a", "a " * 50), "doc_id").count() == 0
    assert [r["doc_id"] for r in quality.length_outliers(docs(spark, *["a"] * 9, "a " * 50), "doc_id").collect()] == [9]


def test_repetition_counts_overlapping_phrases(spark):
    flags = docs(spark, "a b c d " * 3, "a b c d e f g h i j k l", "x " * 11, "x " * 12).select(quality.repeated_phrase(F.col("text")).alias("x")).collect()
    assert [r["x"] for r in flags] == [True, False, False, True]


def test_penalty_score(spark):
    found = spark.createDataFrame([("a", "error", 0.5), ("b", "warning", 0.01)], "category string, severity string, fraction double")
    assert quality.penalty_score(found).first()[0] == math.floor(100 - 25 - 5)


def test_contamination_takes_last_equal_and_smallest_best(spark):
    train = docs(spark, "same text here", "same text here", "the quick brown fox jumps over the lazy dog and runs away", "the quick brown fox jumps over the lazy dog and runs away")
    other = docs(spark, "same text here", "the quick brown fox jumps over the lazy dog and runs home", "nothing of that kind")
    for mode in ("exact", "lsh"):
        got = {r["eval_id"]: (r["train_id"], r["kind"]) for r in gates.contamination(train, other, mode=mode).collect()}
        assert got == {0: (1, "exact"), 1: (2, "near")}
    status = gates.contamination_status(gates.contamination(train, other), other).first()
    assert (status["status"], status["exit_code"], status["exact"], status["near"]) == ("FAIL", 1, 1, 1)


def test_contamination_of_nothing_passes(spark):
    status = gates.contamination_status(gates.contamination(docs(spark, "a"), docs(spark, "b").limit(0)), docs(spark, "b").limit(0)).first()
    assert (status["status"], status["exact_fraction"]) == ("PASS", 0.0)


def test_greedy_dedupe_is_not_components(spark, tmp_path):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    paths = iter(range(1000))

    def write(df):
        path = str(tmp_path / str(next(paths)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    assert sorted(r["id"] for r in similarity.greedy_dedupe(nodes, edges, write).collect()) == [0, 2, 3]


def test_near_pairs_keep_few_candidates_besides_the_pairs(spark, monkeypatch):
    """Words that stand in many sets' first words make no table of pairs that fall short."""
    rng = np.random.default_rng(0)
    sets = [set(rng.choice(400, 90, replace=False).tolist()) for _ in range(150)]
    sets += [set((1000 + rng.choice(2000, 700, replace=False)).tolist()) for _ in range(40)]  # with wide sketches
    near = [(set(sorted(x)[k:]) | {5000 + 20 * i + j for j in range(k)}) for i, x in enumerate(sets) if i % 3 == 0 for k in (3, 7, 8)]
    sets += [*near, set(range(17)) | {1, 7000}, set(range(20)) - {19} | {7000}, set(range(17)), set(range(20)), sets[0], set(), set(), {1}]
    df = spark.createDataFrame([(i, [f"w{x}" for x in sorted(s)]) for i, s in enumerate(sets)], "doc_id long, w array<string>")
    counts, write = [], similarity.written

    def written(df):
        out = write(df)
        if {"a", "b"} <= set(out.columns):
            counts.append(out.count())
        return out

    monkeypatch.setattr(similarity, "written", written)
    nodes, pairs = similarity.near_pairs(df.select(F.col("doc_id").alias("key"), F.array_sort("w").alias("w")), 0.85)
    first = [i for i, s in enumerate(sets) if s not in sets[:i]]
    want = {(i, j) for i in first for j in first if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert {(r["id"], r["n"]) for r in nodes.collect()} == {(i, len(sets[i])) for i in first}
    assert len(want) <= max(counts) <= 2 * len(want)


def test_cosine_pairs_are_exhaustive(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma delta", "alpha beta gamma epsilon", "zeta eta theta", "zeta eta theta iota"]
    df = docs(spark, *texts, *[f"w{i} x{i}" for i in range(20)])
    weights = similarity.term_weights(df, "doc_id")
    vectors = {}
    for r in weights.collect():
        vectors.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    want = {i for i in vectors for j in vectors if i != j and sum(w * vectors[j].get(t, 0) for t, w in vectors[i].items()) >= 0.6}
    assert {r["doc_id"] for r in similarity.cosine_rows(weights, "doc_id", 0.6).collect()} == want


def test_term_in_every_document_is_dropped(spark):
    assert similarity.term_weights(docs(spark, "only one"), "doc_id").count() == 0


def test_near_duplicate_rows_without_pairs_for_copies(spark):
    df = docs(spark, *["one two three four five six"] * 50, "something else altogether here now", "")
    rows = sketch.near_duplicate_rows(df, "doc_id", text.word_ngrams(text.tokens(F.lower("text")), 3))
    assert sorted(r["doc_id"] for r in rows.collect()) == list(range(50))


def test_tag_shift_of_a_missing_key_is_one(spark):
    a = spark.createDataFrame([("x", None)], "p string, q string")
    b = spark.createDataFrame([("x", "y")], "p string, q string")
    assert {r["tag"]: r["shift"] for r in gates.tag_shift(a, b, ["p", "q"]).collect()} == {"p": 0.0, "q": 1.0}


def test_fingerprint_nearness(spark):
    a = docs(spark, *[f"row {i} has some words of its own to hash" for i in range(15)])
    near = docs(spark, *[f"row {i} has some words of its own to hash" for i in range(14)], "a changed row")
    far = docs(spark, *[f"completely other vocabulary number {i * 7} shows up" for i in range(15)])
    like = lambda x: gates.fingerprint_diff(gates.fingerprint(a), gates.fingerprint(x)).first()["similarity"]
    assert like(near) > like(far)


@pytest.mark.parametrize(
    ("columns", "kind"),
    [("prompt chosen rejected", "rm_pairwise"), ("question sql schema", "nl2sql"), ("question context answer", "qa"), ("Messages", "chat"), ("article highlights", "summarization"), ("src tgt", "translation"), ("question answer", "sft"), ("body category", "classification"), ("foo", None)],
)
def test_detect(columns, kind):
    assert records.detect(columns.split()) == kind


def test_chat_pairs(spark):
    turns = [(1, 0, "system", "s1"), (1, 1, "user", "u0"), (1, 2, "user", "u1"), (1, 3, "system", "s2"), (1, 4, "assistant", "a1"), (1, 5, "user", "u2"), (2, 0, "user", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in records.chat_pairs(df, "conv_id", "turn").collect()] == [(1, 0, "u1", "a1", "s1")]


def test_flatten_stops_at_tags(spark):
    df = spark.sql("select 1 as id, named_struct('b', named_struct('c', 2), 'd', 3) as a, named_struct('k', 'v') as tags")
    assert records.flatten(df).columns == ["id", "a.b.c", "a.d", "tags"]


def test_ingest_drops_and_identifies(spark):
    df = spark.createDataFrame([("q1", "a1", "7"), ("q2", " ", "8")], "prompt string, completion string, k string")
    done = ingest.ingest(df, mapping={"input": "prompt", "output": "completion"}, tags={"source": "x"}, id_column="k")
    assert done.schema == "sft"
    assert [tuple(r) for r in done.rows.collect()] == [("7", "q1", "a1", {"source": "x"})]
    assert [tuple(r) for r in done.dropped.collect()] == [("missing required fields input, output OR question, answer", 1)]
    named = ingest.ingest(df, mapping={"input": "prompt", "output": "completion"}).rows.first()["row_id"]
    assert named == "row_" + hashlib.sha256(json.dumps({"input": "q1", "output": "a1"}, sort_keys=True).encode()).hexdigest()[:16]
    with pytest.raises(ValueError):
        ingest.ingest(spark.range(1))


def test_ingest_tags_strict_and_chat(spark):
    rows = [("q1", "a1", '{"source": "own", "n": 3}'), ("q2", "a2", "not json"), ("q3", "a3", None)]
    df = spark.createDataFrame(rows, "question string, answer string, tags string")
    got = [r["tags"] for r in ingest.ingest(df, tags={"source": "x", "more": "y"}).rows.orderBy("input").collect()]
    assert got == [{"more": "y", "source": "own", "n": "3"}, {"source": "x", "more": "y"}, {"source": "x", "more": "y"}]
    with pytest.raises(ValueError):
        ingest.ingest(spark.createDataFrame([("q", " ")], "question string, answer string"), strict=True)
    said = [(1, [("user", "u"), ("assistant", "a"), ("user", "v"), ("assistant", "b")], {"k": "v"}), (2, [("user", "w"), ("assistant", "c")], None)]
    chat = spark.createDataFrame(said, "key long, messages array<struct<role: string, content: string>>, tags map<string,string>")
    done = ingest.ingest(chat, tags={"k": "z"}, id_column="key").rows.orderBy("input").collect()
    assert [tuple(r) for r in done] == [("1", "u", "a", {"k": "v"}), ("1", "v", "b", {"k": "v"}), ("2", "w", "c", {"k": "z"})]


def test_row_schemas_and_warnings(spark):
    df = spark.createDataFrame([("t", "l", None), ("t", "l", None), ("t", None, None), ("x@y.org", "l", "s")], "text string, label string, summary string")
    assert {r["schema"]: r["rows"] for r in records.votes(df).collect()} == {"classification": 3, "unknown": 1}
    one = records.classified(df, F.col("text"), r"[a-z]+@[a-z.]+", r"\d{7}").first()
    assert (one["rows"], one["schema"], one["duplicate_rate"], one["pii_rows"], one["schemas"], one["warnings"]) == (4, "classification", 0.25, 1, ["unknown"], ["duplicates", "pii", "mixed_schemas"])
    assert records.classified(df.limit(0), F.col("text"), "a", "b").first()["warnings"] == ["empty"]
    assert records.map_fields(["Prompt", "completion", "text"], {"input": ("prompt", "question"), "output": ("response", "completion"), "text": ("body",)}) == {"input": "Prompt", "output": "completion"}
    assert [r["x"] for r in df.select(records.remap(F.col("text"), {"t": "u"}).alias("x")).collect()] == ["u", "u", "u", "x@y.org"]


def test_integrity(spark):
    ok = [("a", "manifest.json", 5, 10.0, "h", "h"), ("a", "decision.json", 5, 11.0, None, "x")]
    rows = [*ok, ("b", "manifest.json", 5, 10.0, "h", "g"), ("b", "decision.json", 0, 5.0, None, "x"), ("b", "odd.bin", 1, 1.0, None, "x"), ("c", "manifest.json", 5, 10.0, "h", "h")]
    df = spark.createDataFrame(rows, "run string, name string, size long, modified double, expected string, actual string")
    got = {r["run"]: tuple(r)[1:] for r in governance.integrity(df).collect()}
    assert got["a"] == ("VERIFIED", [], False, "LOW", [], [])
    assert got["b"] == ("TAMPERED", ["MTIME_ANOMALY", "UNEXPECTED_FILES", "SIZE_ANOMALY", "HASH_MISMATCH"], True, "HIGH", [], ["odd.bin"])
    assert got["c"] == ("INCOMPLETE", ["FILES_MISSING"], True, "MEDIUM", ["decision.json"], [])
    assert [tuple(r) for r in governance.unexpected(df).collect()] == [("b", "odd.bin")]


def test_promotions_in_order(spark):
    rows = [("m", "v1", 1, "production", 90.0, 10.0, "SHIP"), ("m", "v1", 2, "staging", None, None, None), ("m", "v1", 3, "production", 59.0, 10.0, "SHIP"), ("m", "v1", 4, "production", 60.0, 50.0, "SHIP"), ("m", "v1", 5, "archived", None, None, None), ("m", "v1", 6, "staging", None, None, None)]
    df = spark.createDataFrame(rows, "model string, version string, ts long, target string, health double, risk double, recommendation string")
    assert [tuple(r) for r in governance.promote(df).collect()] == [("m", "v1", "archived", 3)]
    asked = df.withColumn("stage", F.lit("staging")).select("ts", governance.promotion().alias("x"))
    assert {r["ts"]: r["x"] for r in asked.collect()} == {1: [], 2: ["transition"], 3: ["health"], 4: [], 5: [], 6: ["transition"]}


def test_rejection_order(spark):
    texts = ["", "short", "x" * 600, "#" * 30, "word " * 10, "mail me at someone@example.org please now", "a perfectly good sentence of many words"]
    got = [r["x"] for r in docs(spark, *texts).select(filters.rejection(F.col("text")).alias("x")).collect()]
    assert got == ["empty", "too_short", "too_long", "bad_chars", "repetitive", "pii", None]


def test_leakage_needs_more_than_the_share(spark):
    seeds = docs(spark, "one two three four five six seven eight nine ten")
    rows = docs(spark, "ONE two three four five six seven eight nine ten ", "one two three four five six seven eight nine other", "ten nine eight seven six five four three two one")
    assert sorted(r["doc_id"] for r in filters.leaked(rows, seeds, "doc_id").collect()) == [0, 2]


def test_question_answer(spark):
    got = docs(spark, "Q: what?\nA: that", "Is it so?\nyes", "no question", "why?").select(filters.question_answer(F.col("text")).alias("x")).collect()
    assert [r["x"] and tuple(r["x"]) for r in got] == [("what?", "that"), ("Is it so?", "yes"), None, None]


def test_redaction(spark):
    assert one(spark, patterns.redact(F.col("t")), t="a@b.co or 10.0.0.1") == "[EMAIL_REDACTED] or [IP_ADDRESS_REDACTED]"
    digest = hashlib.sha256(b"a@b.co").hexdigest()[:12]
    assert one(spark, patterns.redact_by_hash(F.col("t"), patterns.PII["email"][0], "email"), t="to a@b.co!") == f"to [EMAIL:{digest}]!"


def test_ssn_boundary_is_unicode(spark):
    assert not one(spark, patterns.has(F.col("t"), patterns.PII["ssn"][0]), t="é123-45-6789")


def _f1(p, r):
    p, r = p.split(), r.split()
    if not p or not r:
        return float(len(p) == len(r))
    n = sum((Counter(p) & Counter(r)).values())
    return 0.0 if not n else 2 * n / (len(p) + len(r))


@pytest.mark.parametrize(("p", "r"), [("a b b c", "b b b d"), ("", ""), ("a", ""), ("x y", "z"), ("a b c d e", "a b c d e")])
def test_metrics(spark, p, r):
    assert one(spark, evaluation.token_f1(F.col("p"), F.col("r")), p=p, r=r) == pytest.approx(_f1(p, r))
    assert one(spark, evaluation.exact_match(F.col("p"), F.col("r")), p=p, r=r) == float(p == r)


def test_bleu_and_rouge(spark):
    p, r = "the cat sat on the mat today", "the cat sat on the mat"
    precisions = [6 / 7, 5 / 6, 4 / 5, 3 / 4]
    assert one(spark, evaluation.bleu(F.col("p"), F.col("r")), p=p, r=r) == pytest.approx(math.exp(sum(map(math.log, precisions)) / 4))
    assert one(spark, evaluation.bleu(F.col("p"), F.col("r")), p="a b c", r="a b c") == 0.0
    assert one(spark, evaluation.rouge_l(F.col("p"), F.col("r")), p="a x b y c", r="a b c") == pytest.approx(2 * 3 / 8)
    assert one(spark, evaluation.length_ratio(F.col("p"), F.col("r")), p="a", r="") == math.inf


def test_class_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "r string, p string")
    got = {x["label"]: (x["support"], x["precision"], x["recall"]) for x in evaluation.class_metrics(df, "r", "p").collect()}
    assert got == {"a": (2, 0.5, 0.5), "b": (1, 0.5, 1.0), "c": (1, 0.0, 0.0)}


def test_decisions(spark):
    rows = [(True, 0, "PASS", 90.0, 0.8, 0.7, 0.0), (True, 0, "WARN", 90.0, 0.8, 0.7, 0.0), (True, 9, "FAIL", 90.0, 0.1, 0.7, -0.5), (False, 0, "PASS", 90.0, 0.8, 0.7, 0.0), (True, 0, "PASS", 90.0, None, None, None)]
    df = spark.createDataFrame(rows, "contract_valid boolean, pii_hits int, contamination string, quality double, f1 double, exact_match double, f1_delta double")
    got = [tuple(r["d"])[:3] for r in df.select(decision.decide(decision.Criteria(min_f1=0.5, max_pii_hits=0, max_f1_regression=0.02)).alias("d")).collect()]
    assert got == [("SHIP", 0, 0.92), ("INVESTIGATE", 2, 0.7), ("DONT_SHIP", 1, 0.3), ("DONT_SHIP", 3, 1.0), ("DONT_SHIP", 1, 0.1)]
    assert decision.Criteria(min_f1=2).problems()


def test_regressions_skip_missing_runs(spark):
    runs = spark.createDataFrame([("r1", 0.7139), ("r2", None), ("r3", 0.6650), ("r4", 0.7050)], "name string, f1 double")
    got = {r["name"]: r["status"] for r in history.regressions(runs, "name", "f1").collect()}
    assert got == {"r1": "OK", "r2": "NO_DATA", "r3": "REGRESSION", "r4": "IMPROVED"}
    ticks = spark.createDataFrame([("m", 1, 0.7), ("m", 2, None), ("m", 3, 0.1)], "m string, t long, v double")
    assert [r["delta"] for r in history.ticks(ticks, "m", "t", "v").orderBy("tick").collect()] == [None, None, None]


def test_invoice_rounds_blocks_up(spark):
    totals = spark.sql("select 5001L as requests, 1000001L as rows, 500000001L as bytes, 2L as decisions")
    got = {r["unit_type"]: r["amount_cents"] for r in metering.invoice(totals, metering.PLANS["STARTER"]).collect()}
    assert got == {"requests": 1, "rows": 5, "bytes": 2, "decisions": 20}


def quota_events(spark):
    rows = [(i, "k", "p", f"2024-01-01 00:00:{i:02d}", size) for i, size in enumerate([60, 50, 30, 20, 5])]
    return spark.createDataFrame(rows, "event long, key string, project string, at string, rows long").withColumn("ts", F.to_timestamp("at")).drop("at")


def test_refused_requests_do_not_count(spark):
    got = metering.daily_quota(quota_events(spark), "event", "key", "project", "ts", "rows", rows_per_day=100)
    assert [r["accepted"] for r in got.orderBy("event").collect()] == [True, False, True, False, True]


def test_streams_give_the_batch_rows(spark, tmp_path):
    quota_events(spark).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(quota_events(spark).schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    counted = run(windows.rate_limit(stream(), "key", "ts", 2), "limits", "complete")
    assert [tuple(r) for r in counted.collect()] == [tuple(r) for r in metering.rate_limit(quota_events(spark), "key", "ts", 2).collect()]
    quota = run(windows.daily_quota(stream(), "event", "key", "project", "ts", "rows", rows_per_day=100), "quota", "append")
    assert [r["accepted"] for r in quota.orderBy("event").collect()] == [True, False, True, False, True]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines"\n2,\n')
    assert [tuple(r) for r in readers.read_dataset(spark, str(tmp_path / "a.csv")).collect()] == [("1", "two\nlines"), ("2", "")]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert readers.read_dataset(spark, str(tmp_path / "b.jsonl"), columns=["x"], limit=1).count() == 1
    (tmp_path / "c.json").write_text('[{"x": 1}, {"x": 2}]')
    assert readers.read_dataset(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "d.txt").write_text(" a \n\n b\n")
    assert [r["text"] for r in readers.read_dataset(spark, str(tmp_path / "d.txt")).collect()] == ["a", "b"]
    (tmp_path / "e.tsv").write_text("p\tq\n1\t2\n")
    assert readers.read_dataset(spark, str(tmp_path / "e.tsv")).columns == ["p", "q"]
    spark.range(5).write.parquet(str(tmp_path / "hub/name/test.parquet"))
    assert readers.read_dataset(spark, "hf://name?split=test&limit=3", hub_root=str(tmp_path / "hub")).count() == 3
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x.zip")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "A b"), (2, "A b"), (3, "c")], "id long, source string")
    sinks.write_buckets(df, str(tmp_path / "buckets"), least=2, schema="sft")
    assert [p.name for p in (tmp_path / "buckets").iterdir() if p.is_dir()] == ["bucket=sft__a_b"]
    manifest = sinks.write_artifact(df, str(tmp_path / "out"), df.agg(F.count("*").alias("rows")))
    assert all(len(r["sha256"]) == 64 for r in manifest.collect()) and manifest.count() >= 2


def test_split_keeps_groups(spark):
    df = spark.range(1000).select((F.col("id") % 40).alias("g"))
    split = readers.split(df, "g", {"train": 0.7, "eval": 0.3})
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_gate(spark):
    train = docs(spark, *[f"a clean training sentence number {i} with several other words" for i in range(30)])
    clean = docs(spark, "entirely different evaluation content about music and weather")
    got = gate.run(train, clean, decision.Criteria(max_pii_hits=0), mode="exact").first()
    assert (got["recommendation"], got["contamination"]) == ("SHIP", "PASS")
    leaked = gate.run(train, train.limit(1), decision.Criteria(max_pii_hits=0)).first()
    assert (leaked["recommendation"], leaked["exit_code"]) == ("DONT_SHIP", 1)


def test_gate_checks_in_one_pass(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeéÉİß", k=rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " \t\n", "One", "one TWO", "a a", "a b c", "a\x1cb c\x85d\u2003e\u00a0f\x1f", "x y z w " * 3, "x y z w " * 2 + "q " * 4, "p q r s t " * 3 + "u", "İ ẞ \x0b Σ", "a b c a b c a b c a b c"]
    texts += [texts[3], texts[4] + " end", "call 555-123-4567 or 123-45-6789", "a@b.co 10.0.0.1", "@ 1234 1.2", "4111 1111 1111 1111", "Ã\x01", "fine, but â"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = gate.checked(df, "doc_id").collect()
    low = text.tokens(F.lower("text"))
    sig = {r["doc_id"]: r["sig"] for r in sketch.signed(df, ["doc_id"], text.word_ngrams(low, 3), 64).collect()}
    pii = sum(F.when(patterns.has(F.col("text"), p), 1).otherwise(0) for p, _ in patterns.PII.values())
    want = df.select("doc_id", F.size(text.tokens(F.col("text"))).alias("w"), quality.repeated_phrase(F.col("text")).alias("r"), F.coalesce("text", F.lit("")).rlike(quality.MOJIBAKE).alias("e"), pii.alias("p")).collect()
    assert {r["key"]: (r["words"], r["repetition"], r["encoding_issue"], r["pii"]) for r in rows} == {r["doc_id"]: tuple(r)[1:] for r in want}
    assert {r["key"]: r["sig"] for r in rows if r["sig"] is not None} == sig and len(sig) == len(texts) - 3
    near = sketch.near_duplicate_rows(df, "doc_id", text.word_ngrams(low, 3))
    tell = lambda found: sorted(map(tuple, found.collect()))
    assert tell(gate.issues(gate.checked(df, "doc_id"))) == tell(quality.issues(df, "doc_id", near=near))


def test_minima_near_the_ends():
    ends = np.concatenate([np.arange(50), sketch.PRIME - np.arange(50), [(1 << 64) - 1] * 2]).astype(np.uint64)
    starts = np.array([0, 10, 50, 60, 99])
    params = [(1, 0), (1, sketch.PRIME - 1), (sketch.PRIME - 1, 5), *sketch.family(5)]
    assert (sketch.minima(ends, starts, params) == sketch.signatures(ends, np.arange(len(ends)), starts, params)).all()
    assert sketch.minima(ends[:0], starts[:0], params).shape == (0, len(params))


@pytest.mark.parametrize("mode", ["exact", "lsh"])
def test_any_near_match(spark, mode):
    """Where rows are only counted, those with a near match are the same as with the nearest, and each pair reaches the threshold."""
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdef ", k=rng.randint(5, 90))) for _ in range(40)]
    change = lambda t: t[:-1] + "xyz"[: rng.randint(0, 3)]
    train, other = (spark.createDataFrame([(i, change(t)) for i, t in enumerate(base * 4)], "doc_id long, text string") for _ in range(2))
    other = other.unionByName(spark.createDataFrame([(900, "zzz qqq"), (901, "")], other.schema))
    nearest, some = ({r["eval_id"]: (r["kind"], r["similarity"]) for r in gates.contamination(train, other, mode=mode, some=x).collect()} for x in (False, True))
    assert nearest.keys() == some.keys() and 900 not in some
    assert all(some[k][0] == nearest[k][0] and 0.70 <= some[k][1] <= nearest[k][1] for k in some)
    assert sum(k == "near" for k, _ in some.values()) > 10


def test_topics(spark):
    from sievegate.operators import topics

    df = docs(spark, *[f"cats dogs pets animals fur{i % 3}" for i in range(12)], *[f"stocks bonds market money fund{i % 3}" for i in range(12)])
    found = topics.topics(topics.assign(df, "doc_id"))
    rows = found.collect()
    assert sum(r["size"] for r in rows) == 24 and len(rows) == topics.topic_count(24) and all(1 <= len(r["terms"]) <= 5 for r in rows)
    assert 0 <= topics.diversity(found).first()[0] <= 1
    assert topics.assign(docs(spark, "a b"), "doc_id").count() == 0


def test_topics_of_rare_terms(spark):
    from sievegate.operators import topics

    common = " ".join(f"common{i}" for i in range(600))
    df = docs(spark, *[common if i % 2 else f"{common} more{i}" for i in range(12)], "seldom rarely hardly", "scarce")
    found = topics.assign(df, "doc_id")
    assert found.count() == df.count() == 14
    assert found.where(F.map_contains_key("weights", F.lit("scarce"))).count() == 1


def test_order_stats_of_many_values_and_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 5 == 0 else "g" if i % 5 < 4 else "h", float(v)) for i, v in enumerate(rng.integers(0, 900, 3000) / 7)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    picks = {"least": "0", "middle": "floor(n / 2)", "last": "n - 1", "before": "-1"}
    got = {r["k"]: tuple(r)[1:] for r in stats.order_stats(df, F.col("v"), picks, ["k"]).collect()}
    for k in (None, "g", "h", "one"):
        own = sorted(v for x, v in rows if x == k)
        assert got.pop(k) == (own[0], own[len(own) // 2], own[-1], None)
    assert not got
    every = sorted(v for _, v in rows if v is not None)
    assert tuple(stats.order_stats(df, F.col("v"), picks).first()) == (every[0], every[len(every) // 2], every[-1], None)


def _vectors(n, copies, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 24))
    near = v[:copies] + 0.2 * rng.standard_normal((copies, 24))
    rows = [*np.concatenate([v, near, v[:5]]).tolist(), [0.0] * 24]
    return [(i, x) for i, x in enumerate(rows)]


def _cosines(rows, least):
    v = np.array([x for _, x in rows[: len(rows) - 6]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    like = v @ v.T
    return {(a, b) for a, b in zip(*np.nonzero(like >= least), strict=True) if a < b}


@pytest.mark.parametrize("tile", [2048, 7])
def test_dense_cosine_pairs_exhaustively(spark, monkeypatch, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "PIVOTS", 5)
    rows = _vectors(150, 60)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for least in (0.9, 0.5):
        got = [(r["a"], r["b"]) for r in similarity.dense_cosine_pairs(df, "id", "v", least).collect()]
        assert len(got) == len(set(got)) and set(got) == _cosines(rows, least)
    assert similarity.dense_cosine_pairs(df.limit(0), "id", "v").count() == 0


def test_dense_cosine_pairs_by_signs(spark):
    rows = _vectors(400, 300)
    found = {(r["a"], r["b"]) for r in similarity.dense_cosine_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.9, recall=0.95).collect()}
    want = _cosines(rows, 0.9)
    assert found <= want and len(found) >= 0.95 * len(want) > 100


def test_synthetic_rows(spark):
    q = " ".join(f"w{i}" for i in range(12))
    other = " ".join(f"x{i}" for i in range(12))
    rows = [(1, q, "a b c"), (2, q, "a b c"), (3, q + " more", "a b c"), (4, "too few", "a b c"), (5, q, "a"), (6, q, "a " * 201), (7, other, "a b c"), (8, other, "a b c"), (9, None, None), (10, " ".join(f"y{i}" for i in range(12)), "a b c")]
    df = spark.createDataFrame(rows, "id long, question string, answer string")
    seeds = spark.createDataFrame([(other,), (None,), ("short",)], "question string")
    got = {r["id"]: r["reason"] for r in synthetic.rejection(df, seeds, "id").collect()}
    assert got == {1: None, 2: "exact_duplicate", 3: "near_duplicate", 4: "question_too_short", 5: "answer_too_short", 6: "answer_too_long", 7: "ngram_overlap", 8: "ngram_overlap", 9: "question_too_short", 10: None}
    assert synthetic.rejection(df.limit(0), seeds, "id").count() == 0
    human = spark.createDataFrame([(1, q, "x"), (2, q, "a b c"), (3, "none", "y")], "id long, question string, answer string")
    assert tuple(synthetic.answer_difference(df, human, "id").first()) == (4, 2, 2, True)
    parts = {r["id"]: r["contamination"] for r in synthetic.contaminated_split(df, "id", 0.35, F.col("question"), F.lit(None), F.col("answer")).collect()}
    assert [k for k, v in sorted(parts.items()) if v == "pure_ai"] == [1, 2, 3] and len(parts) == 10
    assert {r["contamination"] for r in synthetic.contaminated_split(df, "id", 0.05, F.col("question"), F.lit(None), F.col("answer")).collect()} == {"paraphrased"}
    scores = spark.createDataFrame([("b", 1, 0.5), ("a_Human", 2, 0.75), ("human", 3, 0.1)], "model string, k long, f1 double")
    assert {r["model"]: r["gap"] for r in synthetic.performance_gap(scores, "model", "f1", "k").collect()} == {"b": -0.25, "a_Human": 0.0, "human": pytest.approx(-0.65)}
    assert synthetic.performance_gap(scores.where("k = 1"), "model", "f1", "k").first()["gap"] == 0.0


def test_coherence_is_the_mean_of_all_pairs(spark):
    rows = [(0, {"a": 1.0}), (0, {"a": 0.6, "b": 0.8}), (0, {"b": 1.0}), (1, {"c": 1.0}), (2, {"a": 1.0}), (2, {"b": 1.0})]
    got = {r["topic"]: (r["size"], round(r["coherence"], 9)) for r in topics.coherence(spark.createDataFrame(rows, "topic int, weights map<string,double>")).collect()}
    assert got == {0: (3, round((0.6 + 0.0 + 0.8) / 3, 9)), 1: (1, 0.0), 2: (2, 0.0)}


def test_usage_replay_and_meter(spark):
    lines = ['{"api_key_id": "k", "counters": {"n": 2}}', '{"api_key_id": "k", "project_id": "default", "counters": {"n": 3, "m": 1}}', '{"counters": {}}', "", "  ", "{broken", "[1]", None]
    got = sorted(map(tuple, metering.replay(spark.createDataFrame([(x,) for x in lines], "value string"), ["n", "m"]).collect()))
    assert got == [("anonymous", "default", 1, 0, 0), ("k", "default", 2, 5, 1)]
    steps = "run string, at long, step string, elapsed_ms long, rows_in long, bytes_in long, checked_rows long, contamination string, decision string, exit_code int, contract_valid boolean"
    rows = [("r", 1, "report", 5, 10, 100, None, None, None, None, None), ("r", 2, "report", 7, 1, 1, None, None, None, None, None), ("r", 3, "contamination", 2, 99, 99, 4, "PASS", None, None, None)]
    one = metering.meter(spark.createDataFrame(rows, steps), "run", "at").first()
    assert (one["rows_in"], one["rows_out"], one["bytes_in"], one["reports_generated"], one["report_ms"], one["contamination"], one["decision"], one["total_ms"]) == (11, 4, 101, 2, 7, "PASS", None, None)


def test_run_contract_and_tag_deltas(spark):
    whole = [("a", f, None) for f in (*governance.RUN_FILES, governance.EVAL_FILES[1])]
    rows = [*whole, ("a", "run_meta.json", '{"status": "completed"}'), ("b", "config.yaml", None), ("b", "run_meta.json", "{")]
    got = {r["run"]: tuple(r)[1:] for r in governance.run_contract(spark.createDataFrame(rows, "run string, name string, body string")).collect()}
    assert got == {"a": (True, True, []), "b": (False, False, ["hashes.json", "environment.json", "eval/eval_results.json", "run_meta.json"])}
    a, b = (spark.createDataFrame(x, "t string") for x in ([("x",), ("x",), (None,)], [("x",), ("y",)]))
    assert sorted(map(tuple, gates.tag_deltas(a, b, ["t"]).collect())) == [("t", "x", -1), ("t", "y", 1)]


def test_parsed_answers(spark):
    rows = ['{"text": " a ", "label": 1}', "```\n{\"text\": \"a\", \"label\": \"b\"}\n```", 'x {"text": "a", "label": "b"} y', "none", '{"text": "a"}', "", None, '{"text": null, "label": "b"}', "```{broken```"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, answer string")
    got = [r["p"] and tuple(r["p"]) for r in df.select("i", models.parsed(F.col("answer"), ("text", "label")).alias("p")).orderBy("i").collect()]
    assert got == [("a", "1"), ("a", "b"), ("a", "b"), None, None, None, None, None, None]
    asked = models.answered(df, F.col("answer"), lambda xs: [x and x[:1] for x in xs], into="short")
    assert [r["short"] for r in asked.orderBy("i").collect()][:4] == ["{", "`", "x", "n"] and models.answered(df.limit(0), F.col("answer"), list).count() == 0


def test_experiment_rows_and_training_fields(spark):
    df = spark.createDataFrame([(1, None, ["a", "b"]), (2, "q", [])], "k long, input string, target array<string>")
    got = {r["id"]: r for r in records.experiment_rows(df, "k", "val").collect()}
    assert (got["val_1"]["question"], got["val_1"]["answer"], got["val_2"]["answer"]) == ("", "a", "")
    assert got["val_2"]["content_hash"] == hashlib.sha256(b"q||||||").hexdigest()
    assert records.trainable(df.withColumnsRenamed({"input": "instruction", "target": "output"}), "sft").count() == 2
    with pytest.raises(ValueError, match="label"):
        records.trainable(df.withColumn("text", F.lit("")), "classification")


def test_issues_of_duplicates_and_classes(spark):
    rows = [(i, "some words of a text", "a" if i < 38 else "b") for i in range(39)] + [(39, "more", None)]
    df = spark.createDataFrame(rows, "id long, text string, kind string")
    alike = df.where("id < 6").select("id")
    got = {r["category"]: (r["severity"], r["count"], r["fraction"], r["sample"]) for r in quality.issues(df, "id", near=df.where("id < 2").select("id"), semantic=alike, label="kind").collect()}
    assert got["near_duplicate"] == ("warning", 2, 0.05, [0, 1]) and got["semantic_duplicate"] == ("error", 6, 0.15, [0, 1, 2, 3, 4])
    assert got["class_imbalance"] == ("warning", 1, 0.5, [])
    few = df.withColumn("kind", F.when(F.col("id") < 5, F.col("kind")))
    assert "class_imbalance" not in {r["category"] for r in quality.issues(few, "id", label="kind").collect()}
    assert quality.issues(df.limit(0), "id", near=alike.limit(0), semantic=alike.limit(0), label="kind").count() == 0


def test_judged_score_of_whole_numbers_is_exact(spark):
    pairs = [(x, y) for x in range(101) for y in (0, 1, 50, 99, 100)]
    got = spark.createDataFrame(pairs, "x long, y int").select("x", "y", topics.judged_score(F.col("x"), F.col("y")).alias("s")).collect()
    assert [r for r in got if r["s"] != (7 * r["x"] + 3 * r["y"]) // 10] == []  # in doubles, 90 * 0.7 is less than 63


def test_alike_rows_against_plain_loops(spark, monkeypatch):
    from sievegate.operators import terms

    monkeypatch.setattr(terms, "ROWS", 7)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(60)]
    texts += [f"{texts[i]} {rng.choice(words)}" for i in range(0, 60, 2)] + [texts[1], "", "the", "w1 " * 300 + "w2"]
    texts += [" ".join(words[:30]) + f" {words[30 + i % 10]}" for i in range(25)]  # near copies of one another
    rows = [*enumerate(texts), (1, "w7 w7"), (2, None), (None, texts[0])]  # two keys have two rows, one has none
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights = {}
    for r in similarity.term_weights(df, "doc_id").collect():
        weights.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    known = sorted(k for k in weights if k is not None)
    cosine = lambda a, b: sum(w * weights[b].get(t, 0.0) for t, w in weights[a].items())
    want = {k for a in known for b in known if a < b and cosine(a, b) >= 0.9 - 1e-9 for k in (a, b)}
    got = [r[0] for r in terms.alike_rows(df, "doc_id", 0.9).collect()]
    assert 25 < len(want) < len(known) and sorted(got) == sorted(want)
    packed = terms.vectors(df, "doc_id", words).select(F.max(F.octet_length("f") - F.octet_length("t")), F.min(F.octet_length("f") / F.octet_length("t"))).first()
    assert tuple(packed) == (0, 0.5)  # two bytes for a place and one for a count, or two where a term occurs more than 255 times


def test_issues_run_each_check_once(spark, tmp_path):
    """Signatures and flags are made by one pass over the texts, however often later steps read them."""
    df = docs(spark, *["one two three four five six"] * 3, "", "other words that nobody repeats at all")
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = df.mapInArrow(told, df.schema)
    near = sketch.near_duplicate_rows(counted, "doc_id", text.word_ngrams(text.tokens(F.col("text")), 3))
    assert sorted(r[0] for r in near.collect()) == [0, 1, 2] and seen.value == 5
    made = quality.issues(counted, "doc_id", near=near)
    before = seen.value
    got = {r["category"]: (r["count"], r["sample"]) for r in made.collect()}
    assert got["near_duplicate"] == (3, [0, 1, 2]) and got["empty_or_low_info"] == (1, [3])
    assert seen.value - before <= 5  # the rows are counted anew, but no text is checked again


def _sets(rows):
    return [(i, np.sort(np.array(list(s), dtype=np.int64)).tobytes()) for i, s in rows]


def test_best_overlap_against_loops(spark):
    """Grams with bits, with codes and without; copies and ties; a seventh of the sets nearly another's."""
    rng = random.Random(3)
    train = [(i, {rng.randrange(1, 6000) + (1 << 42) for _ in range(rng.randrange(1, 60))}) for i in range(120)]
    other = [(1000 + i, {rng.randrange(1, 6000) + (1 << 42) for _ in range(rng.randrange(1, 60))}) for i in range(40)]
    for i in range(60):
        base = sorted(train[rng.randrange(40)][1])
        gone = base[rng.randrange(len(base))]
        other.append((2000 + i, {x for x in base if x != gone} | {7 + (1 << 42)}))
        train.append((500 + i, set(base[: max(1, len(base) * 9 // 10)])))
    want = {}
    for i, s in other:
        like = max((len(s & t) / len(s | t), -j) for j, t in train)
        if like[0] >= 0.7:
            want[i] = (-like[1], like[0])
    a, b = (spark.createDataFrame(_sets(x), "id long, g binary") for x in (train, other))
    found = similarity.best_jaccard(a, b, 0.7)
    assert {r["eval_id"]: (r["train_id"], r["similarity"]) for r in found.collect()} == want and len(want) > 30
    # the kernel, with grams that have no code and grams folded together
    order = np.array(sorted({g for _, s in other for g in s}))[:4000]
    rows = [[tuple(r) for r in overlap.packed(x, order).select("id", "n", "pack", "bands").collect()] for x in (b, a)]
    q, t = (overlap.Sets([(i, n, bytes(p), bytes(k)) for i, n, p, k in x]) for x in rows)
    best, who = overlap.best_of(q, t, 0.7)
    assert {int(i): (int(w), float(s)) for i, s, w in zip(q.ids, best, who, strict=True) if s >= 0.7} == want


def test_best_jaccard_sends_sets_to_few_tiles(spark):
    """Whatever the number of shuffle partitions: the evaluation set once went to each of them."""
    rng = random.Random(4)
    make = lambda first: spark.createDataFrame(_sets([(first + i, {rng.randrange(1, 9000) + (1 << 42) for _ in range(500)}) for i in range(200)]), "id long, g binary")
    a, b = make(0), make(1000)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def size():
        found = files.getAllFiles()
        return sum(found.apply(i).length() for i in range(found.size()))

    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        before = size()
        assert similarity.best_jaccard(a, b, 0.7).count() == 0
        assert size() - before < 8 * 400 * 4000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_best_by_bands_sends_no_pairs(spark):
    """A pair counts if it reaches least and shares a band; that is asked in the tiles, where pairs that share a band were once joined and sent."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(30)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60)))) for i in range(90)]
    sets = sketch.char_sets(spark.createDataFrame(texts, "id long, t string"), "id", F.col("t"))
    train, other = sets.where("id % 3 > 0"), sets.where("id % 3 = 0")
    grams = {r["id"]: set(np.frombuffer(r["g"], dtype=np.int64).tolist()) for r in sets.collect()}
    sig = {r["node"]: r["sig"] for r in sketch.signed_sets(sets.withColumnRenamed("id", "node"), "node", 128).collect()}
    bands, rows = sketch.bands(128, 0.7)
    met = lambda i, j: any(sig[i][b * rows : (b + 1) * rows] == sig[j][b * rows : (b + 1) * rows] for b in range(bands))
    want = {}
    for i in [x for x in grams if x % 3 == 0]:
        found = [(len(grams[i] & grams[j]) / len(grams[i] | grams[j]), -j) for j in grams if j % 3 and met(i, j)]
        if found and max(found)[0] >= 0.7:
            want[i] = (-max(found)[1], max(found)[0])
    got = similarity.best_by_bands(train, other, 0.7)
    assert {r["eval_id"]: (r["train_id"], r["similarity"]) for r in got.collect()} == want and want


def test_strip_is_the_pattern(spark):
    """Every character of the basic plane at both ends, and runs of spaces within."""
    rng = random.Random(8)
    texts = [f"{chr(c)} a{chr(c)}b {chr(c)}" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choice(" \n\r\x85 　xé") for _ in range(rng.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert df.where(~text.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_permutations_and_both_ways_to_sign(monkeypatch):
    rng = random.Random(9)
    p = sketch.PRIME
    xs = [0, 1, p - 1, p, p + 1, 1 << 61, 1 << 63, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(300))]
    hashes = np.array(xs, dtype=np.uint64)
    params = [*sketch.family(32), (p - 1, p - 1), (1, 0), (p - 1, 0), ((1 << 31) - 1, p - 1)]
    for a, b in params:
        assert sketch.permute(hashes, a, b).tolist() == [(a * x + b) % p for x in xs]
    index = np.array([rng.randrange(len(xs)) for _ in range(20_000)])
    starts = np.array([0, 1, 7, 9000, 19_999])
    want = [[min((a * xs[k] + b) % p for k in set(index[s:e].tolist())) for a, b in params] for s, e in zip(starts, [*starts[1:], len(index)], strict=True)]
    assert sketch.signatures(hashes, index, starts, params).tolist() == want
    monkeypatch.setattr(sketch, "TABLE", 0)
    monkeypatch.setattr(sketch, "BLOCK", 100)
    assert sketch.signatures(hashes, index, starts, params).tolist() == want


def test_only_sets_that_share_a_band_are_compared(spark):
    """Sets of like sizes without a common band: every such pair once went through a matrix product. Grams with bits, with codes and without, folded together."""
    rng = random.Random(10)
    base = [rng.sample(range(1, 9000), 200) for _ in range(12)]
    make = lambda first, n: [(first + i, {x + (1 << 42) for x in rng.sample(base[i % 12], 185)}) for i in range(n)]
    train, other = make(0, 150), make(1000, 60)
    order = np.array(sorted({g for _, s in other for g in s}))
    rng.shuffle(order)
    frames = [spark.createDataFrame(_sets(x), "id long, g binary") for x in (train, other)]
    bands = (128, sketch.bands(128, 0.7)[0], 42)
    for known in (np.concatenate((np.arange(overlap.OWN - 500), order[:3000])), order[:0]):
        t, q = (overlap.Sets([(r["id"], r["n"], bytes(r["pack"]), bytes(r["bands"])) for r in overlap.packed(f, known, bands).collect()]) for f in frames)
        q.dense = t.dense = None
        best, who = overlap.best_of(q, t, 0.7)
        keys, sets = {int(i): k for i, k in [*zip(q.ids, q.bands), *zip(t.ids, t.bands)]}, dict(train) | dict(other)  # noqa: B905
        for i, s, w in zip(q.ids, best, who, strict=True):
            met = [(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), -j) for j, _ in train if (keys[i] == keys[j]).any()]
            want = max(met, default=(0, 0))
            assert (s, w) == (want[0], -want[1]) if want[0] >= 0.7 else s == -1
        assert (best >= 0.7).sum() > 30


def test_a_tile_has_a_task_of_its_own(spark):
    """Numbers of tiles dealt by hash left some tasks two or three tiles."""
    keys = {r["at"]: r["key"] for r in overlap._keys(spark, 97).collect()}
    dealt = spark.createDataFrame(list(keys.items()), "at long, key long").repartition(97, "key").select("at", F.spark_partition_id().alias("p")).collect()
    assert len(keys) == 97 and all(r["at"] == r["p"] for r in dealt)
