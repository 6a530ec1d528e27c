"""Lines of files that still grow, as a stream: each line once, a line that is not finished only when it is."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .readers import EVENT

#: Bytes that one task reads of a file at once, and that are looked through at a time for a line's end.
TASK_BYTES, BLOCK = 32 << 20, 1 << 16


@dataclass
class Range(InputPartition):
    """Bytes of a file: lines that begin in start:end are this task's."""

    path: str
    start: int
    end: int
    first: int


class GrowingLines(DataSource):
    """Options: path (a folder), suffix (of its files, default .ndjson), seconds (a file that has not changed for so long is finished, and its last line counts without a line's end; default: never)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, position long, value string"

    def streamReader(self, schema) -> "GrowingReader":
        return GrowingReader(self.options)


class GrowingReader(DataSourceStreamReader):
    """An offset has the bytes of each file up to which lines are whole; what follows them stays in the file until it is."""

    def __init__(self, options):
        self.path, self.suffix, self.seconds = options["path"], options.get("suffix", ".ndjson"), options.get("seconds")
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"ends": "{}"}

    def latestOffset(self) -> dict:
        store, folder = fs.FileSystem.from_uri(self.path)
        ends = {}
        for f in store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True)):
            if f.type != fs.FileType.File or not f.base_name.endswith(self.suffix):
                continue
            done = self.seconds is not None and time.time() - f.mtime_ns / 1e9 >= float(self.seconds)
            ends[f.base_name] = f.size if done else self._whole(store, f.path, min(f.size, self.known.get(f.base_name, 0)), f.size)
        self.known = ends
        return {"ends": json.dumps(ends, sort_keys=True)}

    @staticmethod
    def _whole(store, path: str, least: int, size: int) -> int:
        """Where the last line's end is behind `least`, looked for from the file's end."""
        with store.open_input_file(path) as f:
            high = size
            while high > least:
                low = max(least, high - BLOCK)
                f.seek(low)
                at = f.read(high - low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                high = low
        return least

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["ends"]), json.loads(end["ends"])
        out = []
        for name in sorted(after):
            first = before.get(name, 0)
            if after[name] < first:
                raise ValueError(f"{name} is shorter than what has been read of it")
            out += [Range(name, at, min(at + TASK_BYTES, after[name]), first) for at in range(first, after[name], TASK_BYTES)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Lines that are not blank, with the file and the place of their first byte."""
        store, folder = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{folder}/{partition.path}") as f:
            at, rest, places, lines, size = partition.start, b"", [], [], 0
            if at > partition.first:  # the line that this range begins in is the one before's, unless a line's end stands before it
                f.seek(at - 1)
                skip = f.read(1) != b"\n"
            else:
                skip = False
                f.seek(at)
            more = True
            while more:
                block = f.read(BLOCK)
                more = bool(block)
                parts = (rest + block).split(b"\n") if more else [rest, b""]
                for line in parts[:-1]:
                    if skip:
                        skip = False
                    elif at >= partition.end:
                        more = False
                        break
                    elif line.strip():
                        places.append(at)
                        lines.append(line.decode("utf-8", "replace"))
                        size += len(line)
                    at += len(line) + 1
                rest = parts[-1]
                if size > BLOCK * 16 or (not more and lines):
                    yield self._batch(partition.path, places, lines)
                    places, lines, size = [], [], 0

    @staticmethod
    def _batch(path: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(places, pa.int64()), pa.array(lines)], ["file", "position", "value"])

    def commit(self, end: dict) -> None:
        pass


def lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of (file, position, value) of the files in a folder, which may grow."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(path=path, **options).load()


def events(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Run events of files that grow, each with file and position; a line that is no JSON object gives nulls."""
    return lines(spark, path, **options).select("file", "position", F.from_json("value", EVENT).alias("e")).select("file", "position", "e.*")
