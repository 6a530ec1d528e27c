"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, token ids.

All stages but the last take a table with doc_id and text and return its columns, whatever others it has and however those
are named. A null text counts as empty, a null doc_id as an id less than all others, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, common, decontaminate, jaccard, repetition, substrings
from loomspark.llm.queries import vocabulary


def _bare(docs: DataFrame) -> DataFrame:
    """The same rows with doc_id, text and all other columns named c0, c1, ... by place, so that none meets a name of a step."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. Null and empty texts have too few words and go; equal rows stay or go together."""
    return repetition.judge(docs, keep_columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: that with the least doc_id (null is the least), of several such that with the least hash.

    Each row counts by itself, whatever other rows have its doc_id; only rows with one doc_id and one text are one. Null
    and empty texts are similar to nothing and stay, one row for each doc_id.
    """
    keyed = _bare(docs).withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    groups = jaccard.classes(keyed.select(F.col("key").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("class")).distinct()
    ids = keyed.groupBy("key").agg(F.min("doc_id").alias("id"))
    first = groups.join(ids, "key").groupBy("class").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "key")).alias("first"))
    kept = keyed.join(first.select(F.col("first.key").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    return kept.drop("key").toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that one with a lesser doc_id has too; characters of which a part is cut go, and so do documents of which nothing is left.

    Rows with one doc_id do not affect each other. n_chars, if it is there, is counted anew; null texts come back empty.
    """
    bare = _bare(docs)
    out = substrings.remove_repeats(bare, as_text=True).filter("kept <> '' or n_removed = 0")
    again = {"text": F.col("kept"), **({f"c{docs.columns.index('n_chars')}": F.length("kept").cast("long")} if "n_chars" in docs.columns else {})}
    return out.select(*(again.get(c, F.col(c)).alias(c) for c in bare.columns)).toDF(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited. Null and empty texts hold none and stay; equal rows stay or go together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of every remaining document's ids and of the text that they decode to; a row for each row."""
    return bpe.encode_decode(docs, vocabulary(), word_bytes=2 << 20)  # workers still hold what earlier stages loaded


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", token_ids),
]
#: SQL expresses none of the last four stages; tests hold the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        after = common.materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
        if before is not None:
            common.discard(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
