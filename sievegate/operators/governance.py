"""Rules over runs and their artifacts: integrity, registration, promotion, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files a run must have, and those it may have.
REQUIRED = ("manifest.json", "decision.json")
OPTIONAL = ("dataset.jsonl", "usage.json", "audit.log", "decision.sig")
#: The stages that may follow each stage, and what production asks for.
NEXT_STAGE = {"none": ("staging",), "staging": ("production", "archived"), "production": ("archived",), "archived": ()}
MIN_HEALTH, MAX_RISK = 60.0, 50.0
#: Files that a run's contract asks for, and those of which it asks for one.
RUN_FILES = ("config.yaml", "hashes.json", "environment.json")
EVAL_FILES = ("eval/eval_results.json", "eval_results.json")


def _names(conditions: dict[str, Column]) -> Column:
    """array<string> of the names whose condition holds; an unknown condition doesn't."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())


def unexpected(files: DataFrame, run: str = "run", name: str = "name", expected: Sequence[str] = REQUIRED + OPTIONAL) -> DataFrame:
    """run, name of the files that are not among the expected ones."""
    return files.select(run, name).where(~F.col(name).isin(*expected)).distinct()


def integrity(files: DataFrame, run: str = "run", name: str = "name") -> DataFrame:
    """run, status, indicators, tampering, confidence, missing, unexpected from one row a file.

    files: run, name, size, modified (seconds), expected and actual (digests; a null expected one isn't
    checked). A run without a required file is INCOMPLETE, one with a differing digest TAMPERED, else VERIFIED.
    A decision older than its manifest by more than a second, a missing file or a differing digest
    means tampering; strange and empty files only indicate it.
    """
    f = files.select(F.col(run).alias("run"), F.col(name).alias("name"), "size", "modified", (F.col("expected") != F.col("actual")).alias("differs"))
    time = lambda n: F.max(F.when(F.col("name") == n, F.col("modified")))
    one = f.groupBy("run").agg(
        F.collect_set(F.when(F.col("name").isin(*REQUIRED), F.col("name"))).alias("have"),
        F.array_sort(F.collect_set(F.when(~F.col("name").isin(*REQUIRED, *OPTIONAL), F.col("name")))).alias("unexpected"),
        F.coalesce(F.max("differs"), F.lit(False)).alias("differs"),
        F.coalesce(F.max(F.col("name").isin(*REQUIRED) & (F.col("size") == 0)), F.lit(False)).alias("hollow"),
        F.coalesce(time(REQUIRED[1]) < time(REQUIRED[0]) - 1, F.lit(False)).alias("late"),
    )
    one = one.withColumn("missing", F.array_except(F.array(*map(F.lit, REQUIRED)), "have"))
    lacks = F.size("missing") > 0
    one = one.withColumn("status", F.when(lacks, "INCOMPLETE").when(F.col("differs"), "TAMPERED").otherwise("VERIFIED"))
    tampered = F.col("status") == "TAMPERED"
    found = {"MTIME_ANOMALY": F.col("late"), "FILES_MISSING": lacks, "UNEXPECTED_FILES": F.size("unexpected") > 0, "SIZE_ANOMALY": F.col("hollow"), "HASH_MISMATCH": tampered}
    one = one.withColumns({"indicators": _names(found), "tampering": F.col("late") | lacks | tampered})
    confidence = F.when(tampered, "HIGH").when(F.col("tampering"), "MEDIUM").otherwise("LOW")
    return one.select(F.col("run").alias(run), "status", "indicators", "tampering", confidence.alias("confidence"), "missing", "unexpected")


def run_contract(files: DataFrame, run: str = "run", name: str = "name", body: str = "body") -> DataFrame:
    """run, valid, has_eval, failed (the files that are missing, and run_meta.json where its status isn't completed) from one row a file.

    body is read of run_meta.json alone, a file that may be absent; one that isn't JSON has no status and fails.
    """
    meta = F.when(F.col(name) == "run_meta.json", F.coalesce(F.get_json_object(body, "$.status"), F.lit("unknown")))
    one = files.groupBy(F.col(run).alias("run")).agg(F.collect_set(F.when(F.col(name).isin(*RUN_FILES, *EVAL_FILES), F.col(name))).alias("have"), F.max(meta).alias("status"))
    lacks = {f: ~F.array_contains("have", f) for f in RUN_FILES}
    has_eval = F.arrays_overlap("have", F.array(*map(F.lit, EVAL_FILES)))
    failed = _names(lacks | {EVAL_FILES[0]: ~has_eval, "run_meta.json": F.col("status") != "completed"})
    return one.select(F.col("run").alias(run), (F.size(failed) == 0).alias("valid"), has_eval.alias("has_eval"), failed.alias("failed"))


def registration() -> Column:
    """array<string>: what forbids a run's registration, over recommendation, contract_valid and contamination; empty if nothing does."""
    return _names({
        "decision": ~F.coalesce(F.col("recommendation") == "SHIP", F.lit(False)),
        "contract": ~F.coalesce("contract_valid", F.lit(False)),
        "contamination": F.col("contamination") == "FAIL",
    })


def promotion() -> Column:
    """array<string>: what forbids a promotion, over stage, target, health, risk and recommendation.

    A transition that isn't allowed decides alone; health, risk and decision are asked for production only.
    """
    steps = F.array(*[F.lit(f"{a}>{b}") for a, to in NEXT_STAGE.items() for b in to])
    allowed = F.coalesce(F.array_contains(steps, F.concat_ws(">", "stage", "target")), F.lit(False))
    checks = _names({"health": F.col("health") < MIN_HEALTH, "risk": F.col("risk") > MAX_RISK, "decision": ~F.coalesce(F.col("recommendation") == "SHIP", F.lit(False))})
    none = F.array().cast("array<string>")
    return F.when(~allowed, F.array(F.lit("transition"))).when(F.col("target") == "production", checks).otherwise(none)


def promote(events: DataFrame, model: str = "model", version: str = "version", ts: str = "ts") -> DataFrame:
    """model, version, stage, refused: the stage after all promotions in order of ts, refused ones left out, and how many were refused.

    events: also target, health, risk, recommendation. A version's promotions are few and are folded in one pass.
    """
    request = F.struct(F.col(ts).alias("ts"), "target", "health", "risk", "recommendation")
    rows = events.groupBy(F.col(model).alias("model"), F.col(version).alias("version")).agg(F.array_sort(F.collect_list(request)).alias("requests"))
    steps = F.array(*[F.lit(f"{a}>{b}") for a, to in NEXT_STAGE.items() for b in to])

    def step(a: Column, r: Column) -> Column:
        fit = (r["target"] != "production") | (F.coalesce(r["health"] >= MIN_HEALTH, F.lit(True)) & F.coalesce(r["risk"] <= MAX_RISK, F.lit(True)) & F.coalesce(r["recommendation"] == "SHIP", F.lit(False)))
        ok = F.coalesce(F.array_contains(steps, F.concat_ws(">", a["stage"], r["target"])) & fit, F.lit(False))
        return F.struct(F.when(ok, r["target"]).otherwise(a["stage"]).alias("stage"), (a["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"))

    last = F.aggregate("requests", F.struct(F.lit("none").alias("stage"), F.lit(0).cast("long").alias("refused")), step)
    return rows.select("model", "version", last.alias("x")).select("model", "version", "x.stage", "x.refused")


def readiness_checks() -> Column:
    """array<struct<name, status>>, seven checks over manifest, decision, audit and environment (JSON or null) and chain (a status of integrity)."""
    at = lambda c, path: F.get_json_object(c, f"$.{path}")
    have = lambda c, *paths: sum((at(c, p).isNotNull().cast("int") for p in paths[1:]), at(c, paths[0]).isNotNull().cast("int")) > 0
    checks = F.map_entries(F.from_json(at("decision", "checks"), "map<string,string>"))
    some = lambda test: F.coalesce(F.exists(checks, test), F.lit(False))
    leak = some(lambda e: F.contains(F.lower(e["key"]), F.lit("contamination")) & e["value"].isin("FAIL", "FAILED", "false"))
    warned = F.exists(F.from_json(at("decision", "summary.warnings"), "array<string>"), lambda w: F.contains(F.lower(w), F.lit("regression")))
    worse = F.coalesce(warned, F.lit(False)) | some(lambda e: F.coalesce(F.get_json_object(e["value"], "$.regression_detected") == "true", F.lit(False)))
    terms = F.from_json(at("manifest", "contracts"), "array<struct<min_row_count:double,max_null_ratio:double>>")
    absurd = F.exists(terms, lambda t: (F.coalesce(t["min_row_count"], F.lit(0.0)) < 10) | (F.coalesce(t["max_null_ratio"], F.lit(0.0)) > 0.5))
    audit = at("audit", "status")
    status = {
        "contract_integrity": F.when(F.col("decision").isNotNull() & have("manifest", "run_id"), "PASS").otherwise("FAIL"),
        "hash_chain": F.when(F.col("chain") == "VERIFIED", "PASS").when(F.col("chain") == "TAMPERED", "FAIL").otherwise("WARN"),
        "privacy_safety": F.when(audit.isin("PASS", "FAIL"), audit).otherwise("WARN"),
        "contamination_risk": F.when(F.col("decision").isNull(), "WARN").when(leak, "FAIL").when(at("decision", "status") == "FAIL", "WARN").otherwise("PASS"),
        "regression_risk": F.when(F.col("decision").isNull() | worse, "WARN").otherwise("PASS"),
        "config_sanity": F.when(F.col("manifest").isNull() | F.coalesce(absurd, F.lit(False)), "WARN").otherwise("PASS"),
        "reproducibility": F.when(have("environment", "seed", "random_seed") & have("environment", "versions", "dependencies"), "PASS").otherwise("WARN"),
    }
    return F.array(*[F.struct(F.lit(n).alias("name"), s.alias("status")) for n, s in status.items()])


def audit_status(counts: DataFrame, fail_on_high: bool = True, warn_on_medium: bool = True) -> DataFrame:
    """One row: high, medium, low, status from (type, severity, hits) of the secret audit."""
    number = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("hits"))), F.lit(0))
    one = counts.agg(number("HIGH").alias("high"), number("MEDIUM").alias("medium"), number("LOW").alias("low"))
    bad, poor = F.lit(fail_on_high) & (F.col("high") > 0), F.lit(warn_on_medium) & (F.col("medium") > 0)
    return one.withColumn("status", F.when(bad, "FAIL").when(poor, "WARN").otherwise("PASS"))
