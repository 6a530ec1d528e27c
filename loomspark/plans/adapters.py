"""Stand-ins on the given tables for the inputs of prompt routing; the mappings carry no meaning beyond exercising the operators.

Each adapter has a DataFrame form and the SQL of a WITH clause for the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..sources.readers import table

# What is put before a document's text, by doc_id modulo 8, so that all categories occur.
OPENINGS = (
    "Classify the sentiment of this review: ", "Summarize in exactly one sentence and in at most 20 words: ", "Extract all named entities from this text: ", "Fix the bug: def run(x): return ",
    "Write a function that prints: ", "What is 12 percent of 50 in total? ", "Three people each own a different pet. Who owns the cat? ", "Tell me about ",
)


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, task_id, prompt) from documents: an opening and the text."""
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.pmod(F.col("doc_id"), F.lit(8)) + 1).cast("int"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("lang", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("task_id"), F.concat(opening, F.coalesce("text", F.lit(""))).alias("prompt"))


PROMPTS = f"prompts AS (SELECT doc_id AS id, lang || '_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS task_id, list_extract([{', '.join(repr(o) for o in OPENINGS)}], CAST(doc_id % 8 + 1 AS INT)) || coalesce(text, '') AS prompt FROM documents)"

# The category by opening is what the classifier gives wherever the text adds no cue; this is the planner's input.
CATEGORY = P.CATEGORIES


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled answers from documents and labels."""
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.concat("lang", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("task_id"),
        F.col("lang").alias("category"),
        (F.col("quality") == 1).alias("correct"),
        ((F.col("toxic") == 0) & (F.pmod(F.col("doc_id"), F.lit(3)) > 0)).alias("verified"),
        (F.col("n_chars") / 200.0).alias("latency_s"),
        F.floor(F.col("n_chars") / 4).alias("completion_tokens"),
        (F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0).alias("score"),
        F.when(F.col("quality") == 1, "local_ok").otherwise("escalate").alias("label"),
    )


RECORDS = """records AS (SELECT d.doc_id AS id, lang || '_' || lpad(CAST(d.doc_id AS VARCHAR), 7, '0') AS task_id, lang AS category, quality = 1 AS correct, (toxic = 0 AND d.doc_id % 3 > 0) AS verified,
  n_chars / 200.0 AS latency_s, n_chars // 4 AS completion_tokens, CAST((d.doc_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS score, CASE WHEN quality = 1 THEN 'local_ok' ELSE 'escalate' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """(id, turn, prompt, answer): each assistant turn with the turn before it; the answer ends with a number."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("prompt", before).filter("role = 'assistant' and prompt is not null").select(F.col("conv_id").alias("id"), "turn", "prompt", F.col("text").alias("answer"))


ANSWERS = """answers AS (SELECT conv_id AS id, turn, prompt, text AS answer FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations) WHERE role = 'assistant' AND prompt IS NOT NULL)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Token events: event_id, ts, session, stage, tokens (unknown for every 17th)."""
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("session"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 17 != 0, F.floor("value").cast("long")).alias("tokens"))


RUNS = "runs AS (SELECT event_id, ts, user_id AS session, event_type AS stage, CASE WHEN event_id % 17 <> 0 THEN CAST(floor(value) AS BIGINT) END AS tokens FROM events)"
