"""Files that grow, snapshots that streams keep, and digests as trees."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import quality as Q
from loomspark.sources import growing, snapshot


def event(run, kind, **more):
    return json.dumps({"type": kind, "runId": run, **more}, ensure_ascii=False)


def test_a_line_that_grows_is_read_once(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def drain(**options):
        stream = growing.events(spark, str(source), **options)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(((r["file"], r["runId"], r["type"], r["text"]) for r in spark.read.parquet(out).collect()), key=str)

    lines = [event("r1", "run.started"), "", event("r1", "answer.completed", text="é" * 40), "no json"]
    whole = "\n".join(lines) + "\n"
    cut = whole.encode().index("é".encode()) + 1  # in the middle of a character
    with open(source / "a.ndjson", "wb") as f:
        f.write(whole.encode()[:cut])
    (source / "b.ndjson").write_text(event("r2", "run.started") + "\n" + event("r2", "run.error"))
    (source / "c.txt").write_text("other\n")
    assert drain() == [("a.ndjson", "r1", "run.started", None), ("b.ndjson", "r2", "run.started", None)]
    assert len(drain()) == 2
    with open(source / "a.ndjson", "ab") as f:
        f.write(whole.encode()[cut:])
    got = drain()
    assert got == sorted([("a.ndjson", "r1", "run.started", None), ("a.ndjson", "r1", "answer.completed", "é" * 40), ("a.ndjson", None, None, None), ("b.ndjson", "r2", "run.started", None)], key=str)
    got = drain(seconds="0")  # the files are finished: the last line counts
    assert len(got) == 5 and ("b.ndjson", "r2", "run.error", None) in got
    assert len(drain(seconds="0")) == 5
    with open(source / "a.ndjson", "r+b") as f:
        f.truncate(3)
    with pytest.raises(Exception):
        drain()


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_ranges_of_a_file_give_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(growing, "TASK_BYTES", size)
    monkeypatch.setattr(growing, "BLOCK", 16)
    rng = random.Random(size)
    lines = ["".join(rng.choices("abé ", k=rng.choice([0, 1, 5, 40]))) for _ in range(80)]
    data = "\n".join(lines).encode()
    (tmp_path / "f.ndjson").write_bytes(data)
    reader = growing.GrowingReader({"path": str(tmp_path), "seconds": "0"})
    start, got = reader.initialOffset(), []
    for end in (len("\n".join(lines[:30]).encode()) + 1, len(data)):
        stop = {"ends": json.dumps({"f.ndjson": end})}
        for part in reader.partitions(start, stop):
            for batch in reader.read(part):
                got += zip(batch.column("position").to_pylist(), batch.column("value").to_pylist())
        start = stop
    want, at = [], 0
    for line in lines:
        if line.strip():
            want.append((at, line))
        at += len(line.encode()) + 1
    assert got == want


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_snapshot_rewrites_what_a_batch_touches(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "k long, n long, v string"
    assert snapshot.read(spark, path) is None
    big = spark.range(2000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"), F.lit("a").alias("v"))
    assert len(snapshot.apply(big, path, "k", "n", buckets=16)) == 16
    before = files(path)
    small = spark.createDataFrame([(5, 2, "b"), (5, 3, "c"), (5, 0, "old"), (None, 1, "none")], schema)
    touched = snapshot.apply(small, path, "k", "n", buckets=16)
    after = files(path)
    assert len(touched) <= 2 and len(set(before) - set(after)) <= 2 and len(set(before) & set(after)) >= 14
    rows = {r["k"]: (r["n"], r["v"]) for r in snapshot.read(spark, path).collect()}
    assert len(rows) == 2001 and rows[5] == (3, "c") and rows[None] == (1, "none") and rows[6] == (1, "a")
    for again in (small, spark.createDataFrame([(5, 3, "other"), (6, 0, "older")], schema), small.limit(0)):
        snapshot.apply(again, path, "k", "n", buckets=16)
        assert {r["k"]: (r["n"], r["v"]) for r in snapshot.read(spark, path).collect()} == rows


def test_a_stream_keeps_a_snapshot(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        spark.range(40).select((F.col("id") % 7).alias("k"), (F.col("id") + 100 * k).alias("n")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k long, n long").option("maxFilesPerTrigger", 1).parquet(source)
    snapshot.keep(stream, str(tmp_path / "s"), str(tmp_path / "cp"), "k", "n", 4, availableNow=True).awaitTermination()
    assert {r["k"]: r["n"] for r in snapshot.read(spark, str(tmp_path / "s")).collect()} == {k: 200 + max(i for i in range(40) if i % 7 == k) for k in range(7)}


def plain_root(rows, fan):
    level = [hashlib.sha256(r.encode()).hexdigest() for r in sorted(rows, key=lambda r: r.encode())]
    while True:
        level = [hashlib.sha256("".join(level[k : k + fan]).encode()).hexdigest() for k in range(0, len(level), fan)] or [hashlib.sha256(b"").hexdigest()]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("size", [0, 1, 5, 64, 700])
def test_tree_digest(spark, size):
    rng = random.Random(size)
    rows = [{"b": rng.choice([None, "x", "é", 'q"']), "a": rng.randrange(50)} for _ in range(size)]
    want = plain_root([json.dumps({k: v for k, v in sorted(r.items()) if v is not None}, ensure_ascii=False, separators=(",", ":")) for r in rows], 8)
    df = spark.createDataFrame([(r["b"], r["a"]) for r in rows], "b string, a long")
    for parts in (1, 5):
        assert Q.tree_digest(df.repartition(parts), fan=8).collect()[0][0] == want


@pytest.mark.parametrize("size", [0, 5, 64, 65, 700])
def test_tree_digest_of_two_levels(spark, size):
    rows = sorted(json.dumps({"a": k}, separators=(",", ":")) for k in range(size))
    leaves = [hashlib.sha256(r.encode()).hexdigest() for r in rows]
    nodes = [hashlib.sha256("".join(leaves[k : k + 8]).encode()).hexdigest() for k in range(0, size, 8)]
    want = nodes[0] if len(nodes) == 1 else hashlib.sha256("".join(nodes).encode()).hexdigest()
    assert Q.tree_digest(spark.range(size).toDF("a").repartition(3), fan=8, levels=2).collect()[0][0] == want


def test_orders_digest_is_its_sql_s_beyond_a_million_rows(spark, tmp_path):
    import duckdb

    from loomspark.plans.oracle import ORACLE
    from loomspark.plans.queries import orders_tree_digest

    made = spark.range(1024 * 1024 + 1500).selectExpr("id o_orderkey", "id % 999 o_custkey", "'O' o_orderstatus", "'1-URGENT' o_orderpriority")
    made.coalesce(4).write.parquet(str(tmp_path / "orders.parquet"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
        assert orders_tree_digest(spark, str(tmp_path)).collect()[0][0] == db.sql(ORACLE["orders_tree_digest"]).fetchall()[0][0]
