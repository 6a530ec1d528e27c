"""Readers with explicit schemas for task lists, labels, answers, truth and event streams, and the checked tables."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = "task_id string, prompt string, dataset_category string"
RESULT = "task_id string, answer string"
PROVENANCE = "struct<schema_version:int,gguf_sha256:string,solver_bundle_sha256:string,labeler_sha256:string,task_manifest_sha256:string,expected_answers_sha256:string,budget_seconds:double,threads:int>"
LABEL = f"task_id string, dataset_category string, category string, prompt string, label string, correct boolean, verified boolean, latency_s double, completion_tokens int, model string, provenance {PROVENANCE}"
EVENT = "type string, runId string, label string, model string, latencyMs double, text string, code string, usage struct<promptTokens:bigint,completionTokens:bigint,reasoningTokens:bigint,totalTokens:bigint>, hypotheticalTokensSaved bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, path: str, tries: int = 5, delay: float = 1.0) -> DataFrame:
    """Tasks of a JSON array, or of an object's array `tasks`, with their place in it as idx. A path that is missing at first is tried again."""
    for left in range(tries - 1, -1, -1):
        try:
            raw = spark.read.text(path, wholetext=True)
            break
        except AnalysisException:
            if not left:
                raise
            time.sleep(delay)
    item = f"array<struct<{', '.join(c.replace(' ', ':') for c in TASK.split(', '))}>>"
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", item)).otherwise(F.from_json("value", f"struct<tasks:{item}>")["tasks"])
    checked = F.coalesce(listed, F.raise_error(F.lit("the file holds no array of tasks")).cast(item))
    return raw.select(F.posexplode(checked).alias("idx", "t")).select(F.col("idx").cast("long"), "t.*")


def labels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Label records, one JSON object a line; blank lines are skipped, lines that don't parse stay in `broken`."""
    return spark.read.schema(LABEL + ", broken string").option("columnNameOfCorruptRecord", "broken").json(paths)


def results(spark: SparkSession, path: str) -> DataFrame:
    """Answers of JSON arrays with their place as idx, so that of several of one task the last is known."""
    return spark.read.schema(RESULT).option("multiLine", True).json(path).withColumn("idx", F.monotonically_increasing_id())


def truth(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, kind, answer as JSON) of an object from task to expectation."""
    raw = spark.read.text(path, wholetext=True)
    entry = F.from_json("value", "map<string,struct<kind:string,answer:string>>")
    return raw.select(F.explode(entry).alias("task_id", "e")).select("task_id", "e.kind", "e.answer")


def events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Run events, one JSON object a line; as a stream, new files are new events."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT).json(path)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order (null: the first); of several such any. Each task passes on one row a key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(order)).alias("_row")).select("_row.*")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the first in order: later writes don't replace it."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(order)).alias("_row")).select("_row.*")


def merged(shards: list[DataFrame], manifest: DataFrame) -> DataFrame:
    """Shards of labels in the manifest's order (task_id, idx). Differing records of one task, or a task too many or missing, are an error when the rows are read.

    Where records have a provenance, one without it or two different ones are an error at once: all shards must be of one run.
    """
    every = shards[0]
    for s in shards[1:]:
        every = every.unionByName(s)
    columns = [c for c in every.columns if c != "task_id"]
    if "provenance" in columns:
        told = F.to_json("provenance")
        seen = every.agg(F.count_if(F.col("provenance").isNull()).alias("without"), F.min(told).alias("least"), F.max(told).alias("most")).first()
        if seen["without"] or seen["least"] != seen["most"]:
            raise ValueError(f"{seen['without']} labels without provenance" if seen["without"] else "labels of different provenance")
    one = every.groupBy("task_id").agg(*(F.first(c).alias(c) for c in columns), F.count_distinct(F.struct(*columns)).alias("_kinds"))
    joined = one.withColumn("_has", F.lit(1)).join(manifest.select("task_id", "idx"), "task_id", "full_outer")
    fault = F.when(F.col("_has").isNull(), "no label").when(F.col("idx").isNull(), "not in the manifest").when(F.col("_kinds") > 1, "labels differ")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(F.col("task_id"), F.lit(": "), fault)).cast("long")).otherwise(F.col("idx"))
    return joined.withColumn("idx", checked).select("idx", "task_id", *columns).orderBy("idx")


def unlabeled(todo: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks that no record has yet: what a run that starts again has left."""
    return todo.join(done.select("task_id").distinct(), "task_id", "left_anti")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest): the SHA-256 of each file's bytes, by its name."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("digest"))
