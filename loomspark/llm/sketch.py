"""Counts of 64-bit keys in a table of fixed size, summed over all tasks; an estimate is never below the true count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters: fixed, so what is broadcast (16 MB) doesn't grow with the corpus.
BITS, SLICES = 22, 64
SCHEMA = "slice int, task long, blob binary"


def empty() -> np.ndarray:
    return np.zeros(1 << BITS, np.uint32)


def place(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def add(counts: np.ndarray, keys: np.ndarray) -> None:
    np.add.at(counts, place(keys), np.uint32(1))


def packed(counts: np.ndarray, task: int) -> tuple[list[int], list[int], list[bytes]]:
    """One task's counts as rows (slice, task, blob)."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return list(range(SLICES)), [task] * SLICES, [pack(part.tobytes()) for part in np.split(counts, SLICES)]


def _added(rows: DataFrame, key: list) -> DataFrame:
    def add_up(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << BITS) // SLICES, np.uint64)
        for blob in group.column("blob"):
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint32)
        # a counter that is full stays full: what is that frequent needs no finer order
        blob = zstandard.ZstdCompressor(level=1).compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes())
        return pa.table({"slice": group.column("slice")[:1], "task": group.column("task")[:1], "blob": pa.array([blob], pa.binary())})

    return rows.groupBy(*key).applyInArrow(add_up, SCHEMA)


def collected(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' rows, added in two steps so that no group holds more than some hundred of them."""
    rows = _added(_added(rows, ["slice", (F.col("task") / 256).cast("long")]), ["slice"])
    out = np.zeros((SLICES, (1 << BITS) // SLICES), np.uint32)
    for r in rows.select("slice", "blob").collect():  # SLICES rows
        out[r["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["blob"])), np.uint32)
    return out.reshape(-1)
