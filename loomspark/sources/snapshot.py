"""A table of the latest row of each key that a stream keeps up to date, rewriting only the parts that a batch touches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import last_wins

BUCKETS = 64


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot's rows; None before the first batch."""
    try:
        return spark.read.parquet(path).drop("bucket")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def apply(batch: DataFrame, path: str, key: str, order: str, buckets: int = BUCKETS) -> list[int]:
    """Puts a batch's rows into the snapshot at path, of each key the last in order, and returns the buckets that were rewritten.

    The table is partitioned by a hash of the key. A batch brings one row a key at most into its buckets; only those are
    read and written (dynamic overwrite: files are staged and moved when the job is done), so the work grows with the
    batch and the size of a bucket, not with the table. The number of buckets is fixed with the first batch. The same
    batch again changes nothing, nor does an older one.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = last_wins(batch, key, order).withColumn("bucket", bucket).persist()
    try:
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # `buckets` numbers at most
        if not touched:
            return []
        try:
            old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            rows = new
        else:
            # of equal order the row that is there already stays
            both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            rows = last_wins(both.withColumn("_order", F.struct(F.col(order), -F.col("_new"))), key, "_order").drop("_new", "_order")
        rows.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        return touched
    finally:
        new.unpersist()


def keep(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, buckets: int = BUCKETS, **trigger):
    """Starts a stream into the snapshot at path and returns its query. trigger: as of writeStream.trigger."""
    out = stream.writeStream.foreachBatch(lambda batch, number: apply(batch, path, key, order, buckets) and None).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()
