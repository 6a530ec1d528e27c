"""Order-dependent rules: streams give the rows of tables, and runs follow a plain fold."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspark.streaming import ordered as O

T0 = datetime(2024, 1, 1)
SCHEMA = "client string, run string, seq long, kind string, at timestamp, id long"


def some_events(seed, n=160):
    rng = random.Random(seed)
    kinds = [*O.PATH, O.ERROR, "other", None]
    rows = []
    for k in range(n):
        run = k // 8
        kind = O.PATH[k % 8] if k % 8 < 6 and rng.random() < 0.85 else rng.choice(kinds)
        rows.append((f"c{run % 3}", f"r{run}", rng.choice([run, run, run - 3, None]), kind, T0 + timedelta(seconds=run * 40 + k % 8 * 9 + rng.choice([0, 0, 0, -20, 30]), microseconds=rng.choice([0, 1, 999])), k))
    return rows


def fold(rows, seconds):
    """Verdicts by going through each run's events."""
    out = []
    for run in {r[1] for r in rows}:
        at, over, events = 0, False, sorted((t, i, k or "") for _, r, _, k, t, i in rows if r == run)
        end = events[0][0] + timedelta(seconds=seconds)
        for t, i, kind in [*events, (datetime.max, 0, "")]:
            if t > end and not over:
                over = True
                out.append((run, end, None, O.TIMEOUT, "timed out"))
            if t == datetime.max:
                break
            if over:
                verdict = "after the end"
            elif kind == O.ERROR or at < 6 and kind == O.PATH[at]:
                verdict, over, at = "accepted", kind == O.ERROR or at == 5, at + 1
            else:
                verdict = "unknown" if kind not in O.PATH else "repeated" if O.PATH.index(kind) < at else "out of order"
            out.append((run, t, i, kind or None, verdict))
    return sorted(map(repr, out))


def listed(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.fixture()
def stream(spark, tmp_path):
    """Runs a rule over rows that come in files in a shuffled order, and returns what it gave. The watermark waits longer than the disorder."""

    def run(rule, rows, late, seed=1, files=5):
        rows = list(rows)
        random.Random(seed).shuffle(rows)
        source = tmp_path / f"in{seed}"
        source.mkdir()
        last = ("end", "end", 0, None, T0 + timedelta(days=40), 10**6)  # time goes on
        for k in range(files + 2):
            part = rows[k::files] if k < files else [last[:4] + (last[4] + timedelta(days=k), last[5] + k)]
            lines = [json.dumps(dict(zip(("client", "run", "seq", "kind", "at", "id"), (*r[:4], r[4].isoformat(), r[5])))) for r in part]
            (source / f"{k}.json").write_text("\n".join(lines))
            os.utime(source / f"{k}.json", (1.7e9 + k, 1.7e9 + k))  # read in this order
        read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(source))
        name = f"out{seed}_{random.randrange(10**9)}"
        query = rule(read, late).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    return run


def test_run_states_are_a_fold(spark):
    for seed in range(4):
        rows = some_events(seed)
        got = O.run_states(spark.createDataFrame(rows, SCHEMA).repartition(3), "run", "kind", "at", "id", 60)
        assert listed(got, "run", "at", "id", "kind", "verdict") == fold(rows, 60)
    assert {v for v in ("accepted", "repeated", "out of order", "unknown", "after the end", "timed out")} == {r[0] for r in got.select("verdict").distinct().collect()}


def test_streamed_run_states(spark, stream):
    rows = some_events(9)
    got = stream(lambda s, late: O.run_states(s, "run", "kind", "at", "id", 60, late), rows, "2 days", seed=9).filter("run <> 'end'")
    assert listed(got, "run", "at", "id", "kind", "verdict") == fold(rows, 60)


def test_silence_alone_times_a_run_out(spark, stream):
    rows = [("c", "r", 1, "run.started", T0, 1), ("c", "s", 1, "run.started", T0, 2), ("c", "s", 1, O.ERROR, T0 + timedelta(seconds=60), 3)]
    got = stream(lambda s, late: O.run_states(s, "run", "kind", "at", "id", 60, late), rows, "10 seconds", seed=3, files=1).filter("verdict = 'timed out' and run <> 'end'")
    assert [tuple(r) for r in got.collect()] == [("r", T0 + timedelta(seconds=60), None, O.TIMEOUT, "timed out")]


def test_streamed_guard(spark, stream):
    rows = some_events(4)
    table = O.guarded(spark.createDataFrame(rows, SCHEMA), "client", "seq", "at", "id")
    got = stream(lambda s, late: O.guarded(s, "client", "seq", "at", "id", late), rows, "2 days", seed=4).filter("client <> 'end'")
    columns = [*got.columns]
    assert listed(got, *columns) == listed(table, *columns) and {r[0] for r in table.select("verdict").distinct().collect()} == {"stale", "current"}


def test_nothing_comes_after_the_final_event(spark, stream):
    rows = some_events(8)
    table = O.before_final(spark.createDataFrame(rows, SCHEMA), "run", "kind", O.ERROR, "at", "id")
    got = stream(lambda s, late: O.before_final(s, "run", "kind", O.ERROR, "at", "id", late), rows, "2 days", seed=8).filter("run <> 'end'")
    assert listed(got, *table.columns) == listed(table, *table.columns)
    for run in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == run), key=lambda r: r[4:])
        kinds = [r[3] for r in own]
        on_time = kinds.index(O.ERROR) + 1 if O.ERROR in kinds else len(own)
        assert sorted(r["id"] for r in table.filter(F.col("run") == run).filter("verdict = 'on time'").collect()) == sorted(r[5] for r in own[:on_time])


def test_streamed_limit(spark, stream):
    rows = some_events(6)
    table = O.limited(spark.createDataFrame(rows, SCHEMA), "client", "at", "id", most=3, seconds=60)
    got = stream(lambda s, late: O.limited(s, "client", "at", "id", 3, 60, late), rows, "2 days", seed=6).filter("client <> 'end'")
    assert listed(got, *table.columns) == listed(table, *table.columns)
    assert table.filter("verdict = 'allowed'").groupBy("client", F.window("at", "60 seconds")).count().agg({"count": "max"}).first()[0] == 3


class Store:
    """State in memory, and how often it was asked."""

    def __init__(self):
        self.asked, self.timers = 0, set()

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)

    def getMapState(self, *schema):
        return self.state(dict())

    getValueState = getListState = getMapState

    def state(self, held):
        store = self

        class State:
            def __getattribute__(self, name):
                store.asked += 1
                return {
                    "exists": lambda: bool(held), "clear": held.clear, "keys": lambda: iter(list(held)), "containsKey": lambda k: k in held, "updateValue": held.__setitem__, "getValue": held.get, "removeKey": held.pop,
                    "get": lambda: held.get(0), "update": lambda v: held.__setitem__(0, v), "put": lambda v: held.__setitem__(0, v), "appendList": lambda v: held.__setitem__(0, held.get(0, []) + v),
                }[name]

        return State()


@pytest.mark.parametrize("piece", [3, 1024])
def test_state_is_asked_by_bucket_not_by_key(monkeypatch, piece):
    import pandas as pd

    if hasattr(O, "PIECE"):
        monkeypatch.setattr(O, "PIECE", piece)
    rows, store, out = some_events(5, 1600), Store(), []
    micros = lambda t: (t - T0) // timedelta(microseconds=1) + 10**15
    rule = O._Runs("kind", 60, 86400)
    rule.init(store)
    new = pd.DataFrame({"bucket": 0, "key": [r[1] for r in rows], "micros": [micros(r[4]) for r in rows], "tie": [r[5] for r in rows], "row": [json.dumps({"kind": r[3]} if r[3] else {}) for r in rows]})
    for part in (new[::2], new[1::2]):
        assert not list(rule.handleInputRows((0,), iter([part]), None))
    for mark in (T0 + timedelta(seconds=2000), T0 + timedelta(seconds=2000, milliseconds=1), T0 + timedelta(seconds=9000)):
        ms = micros(mark) // 1000
        if min(store.timers) > ms:
            continue
        store.timers = {t for t in store.timers if t > ms}
        timer = type("", (), {"getCurrentWatermarkInMs": lambda self: ms})()
        for df in rule.handleExpiredTimer((0,), timer, None):
            out += [(r.key, T0 + timedelta(microseconds=r.micros - 10**15), None if pd.isna(r.tie) else int(r.tie), json.loads(r.row).get("kind") if r.row else O.TIMEOUT, r.verdict) for r in df.itertuples()]
    assert sorted(map(repr, out)) == fold(rows, 60)
    assert piece == 3 or store.asked < 50  # 200 runs


def test_keys_of_all_types_come_back(spark, stream):
    rows = some_events(7)
    keyed = lambda df: df.withColumn("n", F.when(F.col("seq").isNotNull(), F.col("seq") + (1 << 60)))
    table = O.limited(keyed(spark.createDataFrame(rows, SCHEMA)), "n", "at", "id", most=2, seconds=60)
    got = stream(lambda s, late: O.limited(keyed(s), "n", "at", "id", 2, 60, late), rows, "2 days", seed=7).filter("client <> 'end'")
    assert listed(got, *table.columns) == listed(table, *table.columns)
    got = stream(lambda s, late: O._streamed(keyed(s), [F.col("n"), F.col("at")], "at", "id", late, O._Limit(9, 60), 4), rows, "2 days", seed=8)
    assert {(r["key0"], r["key1"]) for r in got.filter("row not like '%\"end\"%'").collect()} == {((r[2] + (1 << 60)) if r[2] is not None else None, r[4]) for r in rows}
