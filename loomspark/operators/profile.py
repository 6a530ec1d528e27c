"""Router profiles end to end: runtime settings from the training split, a threshold from the calibration split, metrics of all
splits, and checks that recompute what a profile reports."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources import readers
from . import policy as S
from . import quality as Q
from . import routing as R
from . import training as L

SPLITS = ("train", "calibration", "test")
#: What a profile reports of a split, by the columns of the policy operators.
REPORTED = {"confusion": ("n", "accuracy", "escalate_precision", "escalate_recall", "local_precision", "local_recall", "tp", "fp", "tn", "fn"), "safety": ("planned_recall", "final_recall", "slow_planned_recall", "unsafe_rate"), "projection": ("expected_misses", "expected_escalations", "expected_tokens", "local_share", "projected_accuracy", "planned_escalations", "reactive_escalations", "reactive_at_risk", "fallback_misses", "slow_recall")}


def runtime_settings(train: DataFrame) -> DataFrame:
    """(category, decision, expected_tokens, expected_latency): policy and nearest-rank costs, from the training split only."""
    stats = S.category_stats(train, "category")
    return S.policy(train).select("category", "decision").join(stats.select("category", F.col("p90_tokens").alias("expected_tokens"), F.col("p90_latency").alias("expected_latency")), "category")


def calibrated(train: DataFrame, calibration: DataFrame, most_misses: float = 1.0) -> DataFrame:
    """One row: the threshold that the scored calibration split gives under the training split's policy, with its projection."""
    return S.pick(S.sweep(S.with_policy(calibration, S.policy(train))), most_misses)


def evaluation(scored: DataFrame, decisions: DataFrame, threshold: float) -> DataFrame:
    """(split, section, field, value) of every split that has records, in one aggregation. scored: records with split and score; decisions: category, decision."""
    known = S.with_policy(scored, decisions).filter(F.col("split").isin(*SPLITS))
    sections = {"confusion": (S.confusion_sums(threshold), S.confusion_fields), "safety": (S.safety_sums(threshold), S.safety_fields), "projection": (S.projection_sums(threshold), lambda c: S.projection_fields(c=c))}
    sums = known.groupBy("split").agg(*(F.struct(*columns).alias(section) for section, (columns, _) in sections.items()))
    values = []
    for section, (_, fields) in sections.items():
        told = fields(lambda name, section=section: F.col(f"{section}.{name}"))
        values += [F.struct(F.lit(section).alias("section"), F.lit(f).alias("field"), told[f].cast("double").alias("value")) for f in REPORTED[section]]
    return sums.select("split", F.explode(F.array(*values)).alias("v")).select("split", "v.*")


def recomputed(reported: DataFrame, computed: DataFrame) -> DataFrame:
    """(split, section, field, reported, value, ok): whether each reported metric is the recomputed one; counts must be equal, what is missing on either side is wrong."""
    joined = computed.join(reported.withColumnRenamed("value", "reported"), ["split", "section", "field"], "full_outer")
    counts = F.col("field").isin("n", "tp", "fp", "tn", "fn")
    return joined.withColumn("ok", F.when(counts, F.coalesce(F.col("reported") == F.col("value"), F.lit(False))).otherwise(Q.close(F.col("reported"), F.col("value"))))


def build(records: DataFrame, dimension: int = 2048, **training) -> tuple[dict, DataFrame]:
    """Fits on the training split, takes the threshold from the calibration split, and evaluates all: (profile, evaluation).

    records: id, split, prompt, category, label, correct, verified, latency_s, completion_tokens. The test split is scored
    when weights and threshold are settled. The profile holds what a run needs; records never leave the executors.
    """
    train = records.filter("split = 'train'")
    features = L.features(records.select("id", "prompt", "category"), dimension)
    labels = train.select("id", F.when(F.col("label") == "escalate", 1).otherwise(0).alias("label"))
    bias, weights = L.fit(features.join(labels.select("id"), "id"), labels, dimension, **training)
    scored = with_scores(records, bias, weights, dimension)
    settings = runtime_settings(train).collect()  # a row for each category
    decisions = records.sparkSession.createDataFrame([(r["category"], r["decision"]) for r in settings], "category string, decision string")
    threshold = S.pick(S.sweep(S.with_policy(scored.filter("split = 'calibration'"), decisions))).first()["threshold"]
    profile = {
        "schemaVersion": 1, "modelType": "hashed-logistic-v1", "dimension": dimension, "bias": bias, "threshold": threshold, "weights": {str(k): w for k, w in sorted(weights.items())},
        "categoryPolicy": {d: sorted(r["category"] for r in settings if r["decision"] == d) for d in ("always_escalate", "trust_local")},
        "expectedCompletionTokens": {r["category"]: float(r["expected_tokens"]) for r in settings}, "expectedLocalLatencySeconds": {r["category"]: r["expected_latency"] for r in settings},
    }
    profile["provenance"] = {}
    profile["provenance"]["profileSemanticSha256"] = L.profile_digest(profile)
    return profile, evaluation(scored, decisions, threshold)


def with_scores(tasks: DataFrame, bias: float, weights: dict[int, float], dimension: int) -> DataFrame:
    """tasks (id, prompt, category) with the profile's score."""
    table = tasks.sparkSession.createDataFrame(sorted(weights.items()) or [(0, 0.0)], "idx int, weight double")
    counts = R.feature_counts(tasks, "id", "prompt", F.col("category"), dimension)
    return tasks.join(R.scores(counts, "id", F.broadcast(table), bias).select("id", "score"), "id")  # `dimension` weights at most


def infer(tasks: DataFrame, profile: dict) -> DataFrame:
    """(id, score, label) of tasks (id, prompt, category) by a profile."""
    scored = with_scores(tasks, float(profile["bias"]), {int(k): float(w) for k, w in profile["weights"].items()}, int(profile["dimension"]))
    hosted = N.routed(F.col("category"), F.col("score"), float(profile["threshold"]), F.array(*map(F.lit, profile.get("categoryPolicy", {}).get("always_escalate", []))).cast("array<string>"))
    return scored.select("id", "score", F.when(hosted, "escalate").otherwise("local_ok").alias("label"))


def score_metrics(records: DataFrame, threshold: float) -> DataFrame:
    """One row of metrics by scores alone, without a policy, to three digits."""
    p, y = F.col("score") >= threshold, F.col("label") == "escalate"
    m = records.agg(F.count("*").alias("n"), F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    c = F.col
    ratio = lambda a, b: N.share(a, b, digits=3)
    return m.select("n", ratio(c("tp") + c("tn"), c("n")).alias("accuracy"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"))


def provenance_problems(records: DataFrame) -> DataFrame:
    """One row: how many records there are, how many have no provenance, and how many different ones there are; more than one is a mixture."""
    text = F.to_json("provenance")
    return records.agg(F.count("*").alias("records"), F.count_if(F.col("provenance").isNull()).alias("missing"), F.count_distinct(text).alias("distinct")).withColumn("ok", (F.col("missing") == 0) & (F.col("distinct") == 1))


def excluded_ids(groups: DataFrame) -> DataFrame:
    """(task_id, n, ok): the ids of all excluded groups; one that is blank or stands in several places is wrong. groups: task_ids."""
    each = groups.select(F.explode("task_ids").alias("task_id"))
    return each.groupBy("task_id").agg(F.count("*").alias("n")).withColumn("ok", (F.col("n") == 1) & (F.coalesce("task_id", F.lit("")) != ""))


def excluded_tasks(manifests: dict[str, DataFrame], normalize) -> DataFrame:
    """(source, task_id, prompt, key): the tasks of all manifests with where each is from and its normalized prompt."""
    parts = [df.select(F.lit(source).alias("source"), "task_id", "prompt", normalize("prompt").alias("key")) for source, df in manifests.items()]
    return reduce(DataFrame.unionByName, parts)


def split_by_prompt(records: DataFrame, excluded: DataFrame, normalize) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) records by their normalized prompts."""
    keyed, public = records.withColumn("key", normalize("prompt")), excluded.select("key").distinct()
    return keyed.join(public, "key", "left_anti").drop("key"), keyed.join(public, "key", "left_semi").drop("key")


def with_truth(todo: DataFrame, truth: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks with their truth; a task without one is an error when the rows are read."""
    joined = todo.join(truth.withColumn("found", F.lit(True)), key, "left")
    return joined.withColumn(key, F.when(F.col("found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no truth for "), F.col(key))))).drop("found")


def unsolved(tasks: DataFrame, solved: DataFrame, key: str = "task_id") -> DataFrame:
    """The tasks that nothing has solved before."""
    return tasks.join(solved.select(key).distinct(), key, "left_anti")


def phrased(specs: DataFrame, phrasings: list[str]) -> DataFrame:
    """Every spec in every wording; `{}` stands for the spec."""
    return specs.withColumn("phrasing", F.explode(F.array(*map(F.lit, phrasings)))).withColumn("prompt", F.replace("phrasing", F.lit("{}"), F.col("spec"))).drop("phrasing")


def labeling_report(records: DataFrame) -> DataFrame:
    """Stats by category and over all (category null): counts, accuracy, mean latency, nearest-rank tokens and latency."""
    every = records.unionByName(records.withColumn("category", F.lit(None).cast("string")))
    mean = records.rollup("category").agg(F.round(F.avg("latency_s"), 2).alias("mean_latency"))
    stats = S.category_stats(every.withColumn("category", F.coalesce("category", F.lit(""))), "category")
    return stats.join(mean.withColumn("category", F.coalesce("category", F.lit(""))), "category").withColumn("category", F.when(F.col("category") != "", F.col("category")))


def checked(profile: dict, reported: DataFrame, computed: DataFrame, copies: Column | None = None) -> DataFrame:
    """(rule, ok, detail): a profile's fields, its digest, its metrics and the gates of its test split."""
    spark = reported.sparkSession
    problems = Q.profile_problems(profile)
    digest = (profile.get("provenance") or {}).get("profileSemanticSha256") == L.profile_digest(profile)
    fixed = spark.createDataFrame([("fields", not problems, ", ".join(problems)), ("digest", digest, "")], "rule string, ok boolean, detail string")
    metrics = recomputed(reported, computed).select(F.concat_ws(".", "split", "section", "field").alias("rule"), "ok", F.concat(F.coalesce(F.col("reported").cast("string"), F.lit("missing")), F.lit(" for "), F.coalesce(F.col("value").cast("string"), F.lit("nothing"))).alias("detail"))
    test = computed.filter("split = 'test'").groupBy().pivot("field", ["n", "tp", "fp", "tn", "fn", "escalate_recall", "local_recall", "final_recall", "slow_planned_recall", "unsafe_rate", "expected_misses"]).agg(F.max("value"))
    c = F.col
    gated = Q.gates(test.select(c("n").alias("count"), F.least(c("tp") + c("fn"), c("tn") + c("fp")).alias("class_support"), ((c("escalate_recall") + c("local_recall")) / 2).alias("balanced_accuracy"), "escalate_recall", "final_recall", c("slow_planned_recall").alias("slow_recall"), "unsafe_rate", c("expected_misses").alias("misses_19")))
    return fixed.unionByName(metrics).unionByName(gated.select(F.concat(F.lit("gate."), "rule").alias("rule"), "ok", F.col("value").cast("string").alias("detail")))


def training_provenance(records: DataFrame, label_files: str, solver_files: str, labeler_file: str, required_file: str | None = None, excluded_files: str | None = None) -> dict:
    """What a profile was made of: digests of its records, files and sources, and the labels' own run.

    records have one provenance; a solver, labeler or manifest that is no longer the one that it names is an error. The
    records' digest is a tree's over all of them (quality.tree_digest); files are read by Spark, so paths may be globs.
    """
    spark = records.sparkSession
    told = provenance_problems(records).first()
    if not told["ok"]:
        raise ValueError(f"{told['missing']} records without provenance, {told['distinct']} different ones")
    run = records.select("provenance").first()["provenance"].asDict(recursive=True)
    listed = lambda path: [{"path": r["path"], "sha256": r["digest"]} for r in readers.file_digests(spark, path).orderBy("path").collect()] if path else []
    solver = listed(solver_files)
    now = {"solver_bundle_sha256": Q.bundle_digest(readers.file_digests(spark, solver_files)).first()[0], "labeler_sha256": listed(labeler_file)[0]["sha256"], "task_manifest_sha256": listed(required_file)[0]["sha256"] if required_file else run["task_manifest_sha256"]}
    for name, digest in now.items():
        if run[name] != digest:
            raise ValueError(f"{name} is not that of the labels")
    return {
        "schemaVersion": 1, "labelRecordsSha256": Q.tree_digest(records).first()[0], "labelRecordCount": told["records"], "labelFiles": listed(label_files), "requiredTasksSha256": now["task_manifest_sha256"], "requiredTasksPath": required_file or "",
        "excludedTaskFiles": listed(excluded_files), "labelRun": run, "solverBundleSha256": now["solver_bundle_sha256"], "labelerSha256": now["labeler_sha256"], "solverFiles": {f["path"]: f["sha256"] for f in solver},
    }


def revision(profile: dict, ids: list[str]) -> str:
    """A short name of a profile: a digest of what decides its answers and of the records that it was fitted to."""
    decides = ("modelType", "dimension", "bias", "threshold", "weights")
    told = ("categoryPolicy", "expectedCompletionTokens", "expectedLocalLatencySeconds", "split", "exclusion")
    body = {k: profile[k] for k in decides} | {k: profile.get(k, {}) for k in told} | {"recordIds": sorted(ids)}
    body["provenance"] = {k: v for k, v in profile.get("provenance", {}).items() if k != "profileSemanticSha256"}
    return "compact-" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def as_json(profile: dict) -> str:
    """The profile as text, the same for every destination."""
    return json.dumps(profile, indent=2, sort_keys=True) + "\n"
