"""Sinks: final answers, snapshots by upsert, appended labels, event lines."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import FALLBACK_ANSWER


def final_answers(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Every task (task_id, idx) with its answer; blank or missing ones get the fallback, a missing id its place."""
    text = F.when(F.trim("answer") != "", F.col("answer"))
    joined = tasks.join(answers, "task_id", "left")
    return joined.select("idx", F.coalesce("task_id", F.col("idx").cast("string")).alias("task_id"), F.coalesce(text, F.lit(FALLBACK_ANSWER)).alias("answer"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines through the committer: a reader sees the old files or the new ones."""
    df.write.mode(mode).json(path)


def append_labels(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def as_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, keys in column order."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def upsert(old: DataFrame | None, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both by key, the latest in order kept: one step of a snapshot sink."""
    from .readers import last_wins

    return last_wins(batch if old is None else old.unionByName(batch), key, order)


def write_copies(text: str, paths: Iterable[str]) -> None:
    """One text to several files, the same bytes in each: whole or as it was before."""
    for path in paths:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        part = f"{path}.part"
        with open(part, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(part, path)
