"""Rules that depend on the order of events, for tables and for streams: run states with deadlines, superseded runs, rate limits.

A table is judged by windows over its keys. A stream is judged by state: events wait until the watermark has passed them,
then go through the rule in order of their time, so both give the same rows however the events arrive.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .runs import STAGES

ERROR, TIMEOUT = "run.error", "run.timeout"
PATH = tuple(s for s in STAGES if s != ERROR)
#: Events that wait are JSON; times keep their microseconds.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Groups of keys whose state is kept together, and events of a piece of it. A stream keeps the number of buckets that it began with;
#: a bucket's records, and its events that are due at once, are held by one task at a time.
BUCKETS, PIECE = 1024, 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(micros: int) -> int:
    """The first millisecond that is not before a time."""
    return -(-micros // 1000)


def _packed(x) -> bytes:
    return zlib.compress(json.dumps(x).encode(), 1)


def _unpacked(x: bytes):
    return json.loads(zlib.decompress(x))


class InOrder(StatefulProcessor):
    """Holds events until the watermark passes them and hands them on in order of (time, tie), key by key.

    Subclasses say what an event's verdict is and, if silence matters, until when something must happen. Times are
    microseconds. What Spark groups by is a bucket of many keys, as each call for state takes longer than judging an event:
    its events wait in pieces of PIECE in order of their time, so only pieces that the watermark has reached are read
    again; beside them there is one small record a key, and the record goes when its `until` passes.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, n int", "events binary")
        self.records = handle.getValueState("records", "records binary")
        self.done = None

    def _wait(self, events: list[tuple]) -> None:
        """events: (micros, tie, row, key) in order."""
        for k in range(0, len(events), PIECE):
            first, n = events[k][0], 0
            while self.waiting.containsKey((first, n)):
                n += 1
            self.waiting.updateValue((first, n), (_packed(events[k : k + PIECE]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for df in rows:
            new = sorted((int(m), int(t), r, k) for m, t, r, k in zip(df["micros"], df["tie"], df["row"], df["key"]))
            self._wait(new)
            first = min(new[0][0], new[0][0] if first is None else first)
        self.handle.registerTimer(_ms(first))  # later ones get theirs when it expires
        return iter(())

    def _due(self, now: int) -> tuple[list[tuple], list[int]]:
        """(events up to now in order, when the first event of each other piece is); the former wait no longer."""
        due, rest, firsts = [], [], []
        for first, n in [(int(first), int(n)) for first, n in self.waiting.keys()]:
            if first > now:
                firsts.append(first)
                continue
            for e in _unpacked(self.waiting.getValue((first, n))[0]):
                (due if e[0] <= now else rest).append(tuple(e))
            self.waiting.removeKey((first, n))
        rest.sort()
        self._wait(rest)
        return sorted(due), firsts + [e[0] for e in rest[:1]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.done == (tuple(key), mark):  # the first timer of a bucket that expires does it for all
            return
        self.done = (tuple(key), mark)
        now = mark * 1000
        due, firsts = self._due(now)
        records = _unpacked(self.records.get()[0]) if self.records.exists() else {}
        out = []
        for micros, tie, row, k in due:
            record = records.setdefault(k, {})
            out += ((k, *r) for r in self.silence(record, micros - 1))
            out.append((k, micros, tie, row, self.verdict(record, micros, json.loads(row))))
        for k, record in records.items():
            out += ((k, *r) for r in self.silence(record, now))
        records = {k: record for k, record in records.items() if record.get("until", now) >= now}
        self.records.update((_packed(records),)) if records else self.records.clear()
        ends = (record.get(name) for record in records.values() for name in ("deadline", "until"))
        timers = [_ms(first) for first in firsts] + [end // 1000 + 1 for end in ends if end is not None]
        if timers:
            self.handle.registerTimer(min(timers))
        if out:
            keys, micros, ties, rows, verdicts = zip(*out)
            yield pd.DataFrame({"key": keys, "micros": micros, "tie": pd.array(ties, dtype="Int64"), "row": rows, "verdict": verdicts})

    def verdict(self, record: dict, micros: int, row: dict) -> str:
        raise NotImplementedError

    def silence(self, record: dict, now: int) -> list[tuple]:
        """Rows (micros, tie, row, verdict) for what had to happen by `now` and did not."""
        return []

    def close(self) -> None:
        pass


def _streamed(events: DataFrame, keys: list, time: str, tie: str, late: str, processor: InOrder, buckets: int) -> DataFrame:
    """(key0, ..., micros, tie, row, verdict) of a stream; row: the event as JSON, null for one that silence made."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    marked = events.withWatermark(time, late)
    key = F.struct(*(c.alias(f"key{k}") for k, c in enumerate(keys)))
    kinds = marked.select(key.alias("k")).schema["k"].dataType
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    given = marked.select(bucket.alias("bucket"), F.to_json(key, JSON).alias("key"), F.col(time).alias("time"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"), F.col(tie).cast("long").alias("tie"), F.to_json(F.struct(*events.columns), JSON).alias("row"))
    judged = given.groupBy("bucket").transformWithStateInPandas(processor, "key string, micros long, tie long, row string, verdict string", "append", "eventTime")
    return judged.select(F.from_json("key", kinds, JSON).alias("k"), "micros", "tie", "row", "verdict").select("k.*", "micros", "tie", "row", "verdict")


def _rows(judged: DataFrame, schema: T.StructType) -> DataFrame:
    """The events' own columns and verdict."""
    return judged.select(F.from_json("row", schema, JSON).alias("r"), "verdict").select("r.*", "verdict")


class _Runs(InOrder):
    """The state of one run: how many stages of PATH are done, whether it is over, and its deadline."""

    def __init__(self, kind: str, seconds: int, keep: int):
        self.kind, self.seconds, self.keep = kind, seconds * 1_000_000, keep * 1_000_000

    def verdict(self, record: dict, micros: int, row: dict) -> str:
        kind, at = row.get(self.kind), record.get("at", 0)
        if "until" not in record and not record.get("over"):
            record["deadline"] = micros + self.seconds
        record["until"] = max(record.get("until", 0), micros, record.get("deadline") or 0) + self.keep if not record.get("over") else max(record["until"], micros + self.keep)
        if record.get("over"):
            return "after the end"
        if kind == ERROR or at < len(PATH) and kind == PATH[at]:
            record["at"] = at + (kind != ERROR)
            if kind == ERROR or record["at"] == len(PATH):
                record |= {"over": True, "deadline": None}
            return "accepted"
        return "unknown" if kind not in PATH else "repeated" if PATH.index(kind) < at else "out of order"

    def silence(self, record: dict, now: int) -> list[tuple]:
        end = record.get("deadline")
        if end is None or end > now:
            return []
        record |= {"over": True, "deadline": None}
        return [(end, None, None, "timed out")]


def run_states(events: DataFrame, key: str, kind: str, time: str, tie: str, seconds: int, late: str = "10 minutes", keep: int = 86400, buckets: int = BUCKETS) -> DataFrame:
    """(key, time, tie, kind, verdict): every event of each run judged in order, and a row for each run that was still open at its deadline.

    Verdicts: accepted (the next stage of PATH, or an error), repeated (a stage that is done), out of order (a later one),
    unknown (no stage), after the end (the run is over). A run is over with its last stage, an error, or `seconds` after
    its first event, which gives a row of kind run.timeout: timed out. An event of the very deadline is in time.

    A stream needs no further event of the run for that row, only a watermark that has passed the deadline; it forgets a
    run `keep` seconds after its last event or deadline. (time, tie) should differ within a run; where they don't, kind decides.
    """
    if events.isStreaming:
        judged = _streamed(events.select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(time).alias("time"), F.col(tie).cast("long").alias("tie")), [F.col("key")], "time", "tie", late, _Runs("kind", seconds, keep), buckets)
        named = F.coalesce(F.get_json_object("row", "$.kind"), F.when(F.col("row").isNull(), TIMEOUT))
        return judged.select(F.col("key0").alias(key), F.timestamp_micros("micros").alias(time), F.col("tie").alias(tie), named.alias(kind), "verdict")
    w = Window.partitionBy("key")
    e = events.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(tie).cast("long").alias("tie"), F.col(kind).alias("kind"))
    e = e.withColumn("place", F.row_number().over(w.orderBy("time", "tie", "kind")))
    e = e.withColumn("deadline", F.timestamp_micros(F.min(F.unix_micros("time")).over(w) + F.lit(seconds * 1_000_000)))
    alive = F.col("time") <= F.col("deadline")
    e = e.withColumn("end", F.min(F.when(alive & (F.col("kind") == ERROR), F.col("place"))).over(w))  # of the first error
    for k, stage in enumerate(PATH):  # the place where each stage is reached: the first of its kind after the one before
        before = F.col(f"at{k - 1}") if k else F.lit(0)
        e = e.withColumn(f"at{k}", F.min(F.when(alive & (F.col("kind") == stage) & (F.col("place") > before), F.col("place"))).over(w))
    reached = [F.col(f"at{k}") for k in range(len(PATH))]
    over = F.least("end", reached[-1])  # least skips nulls
    e = e.withColumn("over", over)
    done = sum((F.coalesce(r < F.col("place"), F.lit(False)).cast("int") for r in reached), F.lit(0))
    stage = F.coalesce(*(F.when(F.col("kind") == s, k) for k, s in enumerate(PATH)))
    accepted = (F.col("kind") == ERROR) | (stage == done)
    verdict = F.when(~alive | F.coalesce(F.col("place") > F.col("over"), F.lit(False)), "after the end").when(F.coalesce(accepted, F.lit(False)), "accepted").when(stage.isNull(), "unknown").when(stage < done, "repeated").otherwise("out of order")
    own = F.struct("key", "time", "tie", "kind", verdict.alias("verdict"))
    late_row = F.struct("key", F.col("deadline").alias("time"), F.lit(None).cast("long").alias("tie"), F.lit(TIMEOUT).alias("kind"), F.lit("timed out").alias("verdict"))
    silent = (F.col("place") == 1) & F.col("over").isNull()
    out = e.select(F.explode(F.when(silent, F.array(own, late_row)).otherwise(F.array(own))).alias("r")).select("r.*")
    return out.toDF(key, time, tie, kind, "verdict")


class _Guard(InOrder):
    """A client's greatest sequence so far."""

    def __init__(self, sequence: str):
        self.sequence = sequence

    def verdict(self, record: dict, micros: int, row: dict) -> str:
        number = row.get(self.sequence)
        if number is None or number < record.get("most", number):
            return "stale"
        record["most"] = number
        return "current"


def guarded(events: DataFrame, client: str, sequence: str, time: str, tie: str, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Adds verdict: stale for an event of a run that a newer one of its client (greater sequence) has superseded by then, or of no sequence; else current. Events of a table and a stream come out alike."""
    if events.isStreaming:
        return _rows(_streamed(events, [F.col(client)], time, tie, late, _Guard(sequence), buckets), events.schema)
    newest = F.max(sequence).over(Window.partitionBy(client).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("verdict", F.when(F.col(sequence) >= newest, "current").otherwise("stale"))


class _Final(InOrder):
    """Whether a key is final; forgotten `keep` after its last event."""

    def __init__(self, kind: str, final: str, keep: int):
        self.kind, self.final, self.keep = kind, final, keep * 1_000_000

    def verdict(self, record: dict, micros: int, row: dict) -> str:
        record["until"] = max(record.get("until", 0), micros + self.keep)
        if record.get("final"):
            return "late"
        record["final"] = row.get(self.kind) == self.final
        return "on time"


def before_final(events: DataFrame, key: str, kind: str, final: str, time: str, tie: str, late: str = "10 minutes", keep: int = 86400, buckets: int = BUCKETS) -> DataFrame:
    """Adds verdict: late for what comes after the first event of kind `final` of its key, which nothing may change any more; else on time."""
    if events.isStreaming:
        return _rows(_streamed(events, [F.col(key)], time, tie, late, _Final(kind, final, keep), buckets), events.schema)
    first = F.min(F.when(F.col(kind) == final, F.struct(F.col(time).alias("t"), F.col(tie).alias("i")))).over(Window.partitionBy(key))
    return events.withColumn("verdict", F.when(F.struct(F.col(time).alias("t"), F.col(tie).alias("i")) > first, "late").otherwise("on time"))


class _Limit(InOrder):
    """How many requests of one key and window there have been; forgotten when the window has passed."""

    def __init__(self, most: int, size: int):
        self.most, self.size = most, size * 1_000_000

    def verdict(self, record: dict, micros: int, row: dict) -> str:
        record["n"] = record.get("n", 0) + 1
        record["until"] = micros - micros % self.size + self.size
        return "allowed" if record["n"] <= self.most else "denied"


def limited(requests: DataFrame, key: str, time: str, tie: str, most: int = 5, seconds: int = 60, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Adds verdict: allowed for the first requests of a key in each fixed window, denied for the others, row by row, for a table or a stream."""
    start = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    if requests.isStreaming:
        return _rows(_streamed(requests, [F.col(key), start], time, tie, late, _Limit(most, seconds), buckets), requests.schema)
    place = F.row_number().over(Window.partitionBy(key, start).orderBy(time, tie))
    return requests.withColumn("verdict", F.when(place <= most, "allowed").otherwise("denied"))
