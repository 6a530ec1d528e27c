"""Run events: lifecycle of each run, totals of sessions, rate limits and late events, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



STAGES = ("run.started", "baseline.started", "baseline.completed", "answer.started", "answer.completed", "comparison.completed", "run.error")
NEEDED = ("baseline.completed", "answer.completed", "comparison.completed")


def lifecycle(events: DataFrame, key: str = "runId", kind: str = "type") -> DataFrame:
    """A row for each run: events, whether it failed, and whether every needed stage has been seen. An aggregate, so a stream in update mode gives it as it grows."""
    seen = [F.max((F.col(kind) == s).cast("int")) for s in NEEDED]
    failed = F.max((F.col(kind) == "run.error").cast("int")) == 1
    whole = F.lit(True)
    for s in seen:
        whole = whole & (s == 1)
    return events.groupBy(key).agg(F.count("*").alias("events"), failed.alias("failed"), (whole & ~failed).alias("complete"))


def session_totals(history: DataFrame, key: str, *values: str) -> DataFrame:
    """Queries of each session; for each value the sum of what is known and whether anything is unknown."""
    sums = [x for v in values for x in (F.coalesce(F.sum(v), F.lit(0)).alias(v), (F.count_if(F.col(v).isNull()) > 0).alias(f"{v}_unknown"))]
    return history.groupBy(key).agg(F.count("*").alias("queries"), *sums)


def recent(history: DataFrame, key: str, time: str, tie: str, most: int = 8) -> DataFrame:
    """The newest rows of each session."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(tie).desc()))
    return history.withColumn("place", place).filter(F.col("place") <= most)


def rate_limited(requests: DataFrame, key: str, time: str, tie: str, most: int = 5, seconds: int = 60) -> DataFrame:
    """Adds window_start and allowed: the first requests of a key in each fixed window."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(time) / seconds) * seconds)
    place = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(time, tie))
    return requests.withColumn("window_start", start).withColumn("allowed", place <= most)


def windowed_counts(requests: DataFrame, key: str, time: str, most: int = 5, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Requests and denials (all but the first `most`) by key and window of a stream; state of windows older than `late` is dropped. ordered.limited says which requests those are."""
    counts = requests.withWatermark(time, late).groupBy(key, F.window(time, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests"))
    return counts.select(key, F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - most, F.lit(0)).alias("denied"))


def on_time(events: DataFrame, arrived: Column, finalized: Column) -> DataFrame:
    """Events that came before their run was final; later ones change nothing."""
    return events.filter(arrived <= finalized)


def current(events: DataFrame, client: str, sequence: str) -> DataFrame:
    """Events of each client's latest run only, of all that the table holds; ordered.guarded judges by what was known at each event."""
    newest = events.groupBy(F.col(client).alias("_client")).agg(F.max(sequence).alias("_newest"))
    return events.join(newest, F.col(client).eqNullSafe(F.col("_client")) & (F.col(sequence) == F.col("_newest"))).drop("_client", "_newest")


def probe_waves(pending: DataFrame, part: str, order: str, first: int = 3) -> DataFrame:
    """Adds wave: 1 for the first rows of a part, 2 for those that go only if the first did."""
    return pending.withColumn("wave", F.when(F.row_number().over(Window.partitionBy(part).orderBy(order)) <= first, 1).otherwise(2))


def timed_out(events: DataFrame, key: str, time: str, last: Column, seconds: int) -> DataFrame:
    """A row for each run: when it started, and whether its last event is missing or came later than `seconds` after the first. An aggregate, so a stream gives it too."""
    seen = events.groupBy(key).agg(F.min(time).alias("started"), F.min(F.when(last, F.col(time))).alias("ended"))
    late = F.unix_timestamp("ended") - F.unix_timestamp("started") > seconds
    return seen.select(key, "started", F.coalesce(late, F.lit(True)).alias("timed_out"))


def completed_runs(spark, path: str, out: str, checkpoint: str):
    """Starts a stream over event files that adds the runs that changed in each batch to a table, and ends when the files are read.

    A batch is a folder of its own, written whole or again, so a reader always finds the states of the batches before.
    """
    from ..sources.readers import events

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    runs = lifecycle(events(spark, path, stream=True))
    return runs.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_runs(spark, out: str, key: str = "runId") -> DataFrame:
    """The latest state of each run that completed_runs has written."""
    from ..sources.readers import last_wins

    return last_wins(spark.read.parquet(out), key, "batch").drop("batch")
