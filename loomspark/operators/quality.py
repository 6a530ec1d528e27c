"""Checks of labels, coverage, splits and artifacts, as tables of findings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.shared import dropped, written

HASHES = ("gguf_sha256", "solver_bundle_sha256", "labeler_sha256", "task_manifest_sha256", "expected_answers_sha256")


def label_rules() -> list[tuple[str, Column]]:
    """(name, broken) of every rule for a label record, in the order in which they are reported."""
    c, p = F.col, F.col("provenance")
    blank = lambda x: F.trim(T.text_or_empty(x)) == ""
    bad_number = lambda x, low: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")) | low
    return [
        ("prompt is blank", blank("prompt")),
        ("label is unknown", ~F.coalesce(c("label").isin("local_ok", "escalate"), F.lit(False))),
        ("task_id is blank or untrimmed", blank("task_id") | F.coalesce(c("task_id") != F.trim("task_id"), F.lit(True))),
        ("correct is missing", c("correct").isNull()),
        ("verified is missing", c("verified").isNull()),
        ("label contradicts correct", ~F.coalesce(c("label") == F.when(c("correct"), "local_ok").otherwise("escalate"), F.lit(False))),
        ("category is unknown", ~F.coalesce(c("category").isin(*P.CATEGORIES), F.lit(False))),
        ("category is not the classifier's", ~F.coalesce(c("category") == T.classify("prompt"), F.lit(False))),
        ("dataset_category is unknown", ~F.coalesce(c("dataset_category").isin(*P.CATEGORIES), F.lit(False))),
        ("latency_s is negative or no number", bad_number(c("latency_s"), c("latency_s") < 0)),
        ("completion_tokens is negative or missing", c("completion_tokens").isNull() | (c("completion_tokens") < 0)),
        ("model is blank", blank("model")),
        ("provenance has another schema version", ~F.coalesce(p["schema_version"] == 1, F.lit(False))),
        *((f"provenance.{h} is no digest", ~F.coalesce(p[h].rlike("^[0-9a-f]{64}$"), F.lit(False))) for h in HASHES),
        ("provenance.budget_seconds is not positive", bad_number(p["budget_seconds"], p["budget_seconds"] <= 0)),
        ("provenance.threads is not positive", ~F.coalesce(p["threads"] > 0, F.lit(False))),
    ]


def violations(rules: list[tuple[str, Column]]) -> Column:
    """The names of broken rules in order."""
    return F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules)), lambda x: x.isNotNull())


def coverage(required: DataFrame, labeled: DataFrame) -> DataFrame:
    """(task_id, finding): missing, extra, duplicate or mismatch of prompts; only tasks with a finding. Both: task_id, prompt (normalized)."""
    have = labeled.groupBy("task_id").agg(F.count("*").alias("rows"), F.min("prompt").alias("got"), F.max("prompt").alias("other"))
    joined = required.select("task_id", F.col("prompt").alias("want"), F.lit(1).alias("asked")).join(have, "task_id", "full_outer")
    finding = (
        F.when(F.col("rows").isNull(), "missing").when(F.col("asked").isNull(), "extra").when(F.col("rows") > 1, "duplicate").when((F.col("got") != F.col("want")) | (F.col("other") != F.col("want")), "mismatch")
    )
    return joined.select("task_id", finding.alias("finding")).filter("finding is not null")


def first_tasks(findings: DataFrame, most: int = 10) -> DataFrame:
    """(finding, n, task_ids): how many tasks each finding has, and the first of them for a message."""
    place = F.row_number().over(Window.partitionBy("finding").orderBy("task_id"))
    named = findings.withColumn("place", place).filter(F.col("place") <= most).groupBy("finding").agg(F.array_sort(F.collect_list("task_id")).alias("task_ids"))
    return findings.groupBy("finding").agg(F.count("*").alias("n")).join(named, "finding")


def class_support(records: DataFrame, least: int = 8, least_all: int = 40) -> DataFrame:
    """One row: records by label, and whether both labels have enough for a test. A record without one of the two labels is an error when the row is read."""
    kinds = ("local_ok", "escalate")
    known = F.coalesce(F.col("label").isin(*kinds), F.lit(False))
    counted = records.agg(F.count("*").alias("n"), F.count_if(~known).alias("unlabeled"), *(F.count_if(F.col("label") == k).alias(k) for k in kinds))
    checked = F.when(F.col("unlabeled") > 0, F.raise_error(F.concat(F.col("unlabeled").cast("string"), F.lit(" records without a label"))).cast("long")).otherwise(F.col("n"))
    return counted.select(checked.alias("n"), *kinds, ((F.col("n") >= least_all) & (F.least(*kinds) >= least)).alias("ok"), (F.least(*kinds) == 0).alias("one_class"))


def split_report(splits: DataFrame, every: DataFrame) -> DataFrame:
    """One row of counts that must be zero: ids in several splits, ids of no record, records in no split, repeated ids. splits: task_id, split."""
    by_id = splits.groupBy("task_id").agg(F.count("*").alias("rows"), F.count_distinct("split").alias("kinds"))
    joined = by_id.join(every.select("task_id").distinct().withColumn("known", F.lit(1)), "task_id", "full_outer")
    return joined.agg(
        F.count_if(F.col("kinds") > 1).alias("overlapping"), F.count_if(F.col("rows") > F.col("kinds")).alias("repeated"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("rows").isNull()).alias("uncovered")
    )


def records_digest(df: DataFrame) -> DataFrame:
    """One row: a SHA-256 over all rows that does not depend on their order or place: of their number and of the sums of their digests' parts, so nothing grows with the table."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns)), 256)
    parts = [F.sum(F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(8)]
    return df.select(row.alias("d")).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(F.coalesce(p, F.lit("0")) for p in parts)), 256).alias("digest"))


#: Digests that one node of a tree is made of.
FAN = 1024


def _joined_digest(batches):
    """The digest of all digests behind one another, a batch at a time."""
    import pyarrow as pa

    joined = hashlib.sha256()
    for b in batches:
        joined.update("".join(b.column("digest").to_pylist()).encode())
    yield pa.RecordBatch.from_arrays([pa.array([joined.hexdigest()])], ["digest"])


def tree_digest(df: DataFrame, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """One row: the root of a hash tree over all rows in order of their canonical JSON (columns by name, nulls left out).

    A leaf is the SHA-256 of a row's JSON; a node that of `fan` digests behind one another, level after level until one is
    left, so no other set of rows has the digest and none of the work is in one place: rows are sorted in ranges, each
    knows its place from the sizes of those before it, and a node is a group of at most `fan` rows. Repeated rows count.
    The digest of no rows is that of an empty text. It depends neither on order nor on the number of partitions.
    levels: of nodes, at most. The root then takes all digests of the level before, however many; one task hashes them in
    order, a batch at a time, as a SHA-256 has no parts: with two levels a digest for every `fan` rows.
    """
    rows = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("row"))
    placed = written(rows.repartitionByRange("row").sortWithinPartitions("row").select(F.sha2("row", 256).alias("digest"), F.monotonically_increasing_id().alias("id")), "leaves")
    part, inside = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row for each range
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    level = placed.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("before") + inside).alias("place"), "digest")
    count, above = placed.count(), 0
    while True:
        above += 1
        if above == levels and count > fan:
            root = written(level.repartition(1).sortWithinPartitions("place").mapInArrow(_joined_digest, "digest string"), "root")
            dropped(placed)
            return root
        node = F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])), 256)
        level = level.groupBy(F.floor(F.col("place") / fan).alias("place")).agg(node.alias("digest"))
        count = -(-count // fan)
        if count <= 1:
            root = written(level.agg(F.coalesce(F.max("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("digest")), "root")
            dropped(placed)
            return root


def bundle_digest(files: DataFrame) -> DataFrame:
    """One row: the digest of a set of files (path, digest) in order of their paths."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda s: F.concat(s["path"], F.lit("\0"), s["digest"], F.lit("\n")))
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"))


def waived_digest(recorded: DataFrame, current: DataFrame, waived: DataFrame) -> DataFrame:
    """The bundle's digest with recorded digests for waived files (path) and current ones for all others: equal to the recorded bundle if only those changed."""
    joined = recorded.withColumnRenamed("digest", "was").join(current, "path").join(waived.select("path").distinct().withColumn("waived", F.lit(True)), "path", "left")
    return bundle_digest(joined.select("path", F.when(F.col("waived"), F.col("was")).otherwise(F.col("digest")).alias("digest")))


def close(a: Column, b: Column) -> Column:
    """Whether two reported metrics agree."""
    return F.coalesce(F.abs(a - b) <= 5e-5, F.lit(False))


# What a router's held-out test must reach.
GATES = {"count": 40, "class_support": 8, "balanced_accuracy": 0.65, "escalate_recall": 0.80, "final_recall": 0.95, "slow_recall": 0.90, "unsafe_rate": 0.02, "misses_19": 2.0}
_AT_MOST = ("unsafe_rate", "misses_19")


def gates(metrics: DataFrame) -> DataFrame:
    """(rule, value, ok) for each gate of a row of metrics."""
    checks = [F.struct(F.lit(k).alias("rule"), F.col(k).cast("double").alias("value"), F.coalesce((F.col(k) <= v) if k in _AT_MOST else (F.col(k) >= v), F.lit(False)).alias("ok")) for k, v in GATES.items()]
    return metrics.select(F.explode(F.array(*checks)).alias("g")).select("g.*")


def profile_problems(profile: dict) -> list[str]:
    """What is wrong with a router profile's fields; nothing for a usable one."""
    out = []
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < float("inf")
    size = profile.get("dimension")
    if profile.get("schemaVersion") != 1 or profile.get("modelType") != "hashed-logistic-v1":
        out.append("schemaVersion or modelType")
    if isinstance(size, bool) or not isinstance(size, int) or not 0 < size <= 1_000_000:
        out.append("dimension")
        size = 0
    if not number(profile.get("bias")):
        out.append("bias")
    if not number(profile.get("threshold")) or not 0 <= profile["threshold"] <= P.ROUTE_NONE:
        out.append("threshold")
    weights = profile.get("weights")
    if not isinstance(weights, dict) or not all(str(k).isdigit() and str(int(k)) == str(k) and int(k) < size and number(w) for k, w in weights.items()):
        out.append("weights")
    policy = profile.get("categoryPolicy", {})
    if not isinstance(policy, dict) or not all(isinstance(policy.get(k, []), list) and all(isinstance(x, str) for x in policy.get(k, [])) for k in ("always_escalate", "trust_local")):
        out.append("categoryPolicy")
    for field in ("expectedCompletionTokens", "expectedLocalLatencySeconds"):
        if not isinstance(profile.get(field, {}), dict) or not all(number(x) and x >= 0 for x in profile.get(field, {}).values()):
            out.append(field)
    return out
