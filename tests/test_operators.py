import json
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspark.functions import patterns as P
from loomspark.operators import evaluate as E
from loomspark.operators import policy as S
from loomspark.operators import profile as O
from loomspark.operators import quality as Q
from loomspark.operators import routing as R
from loomspark.operators import templates as G
from loomspark.operators import training as L
from loomspark.sources import config as C
from loomspark.sources import readers, writers
from loomspark.streaming import runs as V


def records(spark, rows):
    return spark.createDataFrame(rows, "category string, correct boolean, verified boolean, score double, latency_s double, completion_tokens long")


def test_policy(spark):
    rows = [("factual", True, False, 0.1, 1.0, 5)] * 40 + [("logic", False, False, 0.1, 1.0, 5)] * 10 + [("math", True, False, 0.1, 1.0, 5)] * 9 + [("ner", True, True, 0.1, 1.0, 5)] * 30
    got = {r["category"]: r["decision"] for r in S.policy(records(spark, rows)).collect()}
    assert got == {"factual": "trust_local", "logic": "always_escalate", "math": "none", "ner": "none"}
    stats = {r["category"]: r for r in S.category_stats(records(spark, rows), "category").collect()}
    assert stats["ner"]["unverified_accuracy"] is None and stats["factual"]["n"] == 40


def test_simulation_and_sweep_agree(spark):
    r = random.Random(4)
    rows = [(r.choice("abc"), r.random() < 0.7, r.random() < 0.6, round(r.random(), 1), r.choice([1.0, 22.0]), 9) for _ in range(80)]
    d = spark.createDataFrame([("a", "always_escalate"), ("b", "trust_local")], "category string, decision string")
    p = S.with_policy(records(spark, rows), d).cache()
    swept = {x["threshold"]: x for x in S.sweep(p).collect()}
    assert {0.0, 0.5, 1.01} <= set(swept)
    for t in (0.0, 0.3, 0.5, 1.01):
        assert swept[t] == S.simulate(p, t).first()
    assert S.pick(S.sweep(p)).count() == 1
    late = S.with_policy(records(spark, [("c", False, False, 0.0, 22.0, 9)]), d)
    x = S.simulate(late, 0.5, size=1).first()
    assert (x["reactive_at_risk"], x["fallback_misses"], x["expected_misses"]) == (1, 1, 1)


def test_admission_is_sequential(spark):
    r = random.Random(1)
    rows = [(k % 5, round(r.uniform(1, 30), 3), k) for k in range(60)]
    got = {x["id"]: x["admitted"] for x in R.admission(spark.createDataFrame(rows, "q int, cost double, id int"), "q", "cost", "id", 100.0, 5.0).collect()}
    for q in range(5):
        used = 0.0
        for _, cost, k in sorted((x for x in rows if x[0] == q), key=lambda x: (x[1], x[2])):
            ok = cost <= 100 - used - 5
            assert got[k] == ok
            used += cost if ok else 0


def test_plan_modes(spark):
    t = spark.createDataFrame([("debug", 0.0, False), ("math", 0.9, False), ("math", None, False), ("math", 0.6, True)], "category string, score double, solved boolean")
    route = lambda **o: [r["route"] for r in R.plan(t, 0.9, ["debug"], **o).collect()]
    assert route() == ["remote", "remote", "local", "solved"]
    assert route(remote_first=True) == ["remote", "remote", "remote", "solved"]
    assert route(remote=False) == ["local", "local", "local", "solved"]


def test_grading(spark):
    rows = [("number", "195", "It is 195.", True), ("label", "neutral", "Mixed", True), ("label", "positive", "negative", False), ("contains", "Oslo", "in oslo", True), ("entities", '["Ann:person","Bo:person"]', "Ann", True), ("contains_any", '["x","y"]', "y", True), ("contains_all", '["x","y"]', "y", False), ("summary", '{"keyterms":["rain"]}', "Rain fell.", True), ("number", "1", " ", False), ("essay", "x", "y", None)]
    df = spark.createDataFrame(rows, "kind string, expected string, answer string, want boolean")
    for r in df.withColumn("got", E.grade(F.col("kind"), F.col("expected"), F.col("answer"))).collect():
        assert r["got"] == r["want"], r


def test_ranking(spark):
    rows = [("cheap", True, 5, None)] * 8 + [("cheap", False, 5, None)] * 2 + [("good", True, 50, None)] * 10 + [("flaky", True, 5, None)] * 9 + [("flaky", True, 5, "timeout")]
    got = E.ranked(E.model_report(spark.createDataFrame(rows, "model string, ok boolean, tokens long, error string"), "model")).orderBy("place").collect()
    assert [r["model"] for r in got] == ["good", "flaky", "cheap"]
    assert {r["model"]: r["n"] for r in got}["flaky"] == 10


def test_groups_and_split(spark):
    texts = [(f"t{k}", "s", f"s\nthe capital of {c} is asked here today", None, "factual", "local_ok") for k, c in enumerate(["norway", "norwey", "peru and all of its many distant valleys"])]
    texts += [("e1", "s", "s\nexplicit:1", "x", "factual", "escalate"), ("e2", "s", "s\nexplicit:1", "x", "factual", "escalate")]
    df = spark.createDataFrame(texts, "task_id string, scope string, canonical string, explicit string, category string, label string")
    leader = {r["task_id"]: r["leader"] for r in G.groups(df).collect()}
    assert leader["t0"] == leader["t1"] != leader["t2"] and leader["e1"] == leader["e2"] == "e1"
    public = df.filter("task_id = 't1'").select("scope", "canonical")
    left = {r["task_id"] for r in G.without(G.groups(df), G.excluded(G.groups(df), public)).collect()}
    assert left == {"t2", "e1", "e2"}
    whole = G.split(G.groups(df)).groupBy("scope", "leader").agg(F.count_distinct("split").alias("n"))
    assert all(r["n"] == 1 for r in whole.collect())


def test_training_equals_plain_loop(spark):
    import math

    x = [{0: 1.0, 3: 2.0}, {1: 1.5}, {0: 0.5, 2: 1.0}, {3: 1.0}]
    y = [1, 0, 1, 0]
    f = spark.createDataFrame([(i, k, v) for i, r in enumerate(x) for k, v in r.items()], "id int, idx int, value double")
    bias, weights = L.fit(f, spark.createDataFrame(list(enumerate(y)), "id int, label int"), 4, epochs=4)
    w, m, v = [0.0] * 5, [0.0] * 5, [0.0] * 5
    for t in range(1, 5):
        g = [0.0] * 5
        for r, label in zip(x, y):
            e = 1 / (1 + math.exp(-(w[4] + sum(w[k] * z for k, z in r.items())))) - label
            g[4] += e
            for k, z in r.items():
                g[k] += e * z
        for k in range(5):
            d = g[k] / 4 + (0.0002 * w[k] if k < 4 else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            w[k] -= 0.04 * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    assert bias == pytest.approx(w[4], abs=1e-9) and all(weights.get(k, 0) == pytest.approx(w[k], abs=1e-9) for k in range(4))
    with pytest.raises(ValueError):
        L.fit(f, spark.createDataFrame([(0, 1)], "id int, label int"), 4, epochs=1)


def test_coverage_and_splits(spark):
    t = "task_id string, prompt string"
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], t)
    have = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("d", "4"), ("e", "5")], t)
    assert {tuple(r) for r in Q.coverage(want, have).collect()} == {("b", "mismatch"), ("c", "missing"), ("d", "duplicate"), ("e", "extra")}
    s = spark.createDataFrame([("a", "x"), ("a", "y"), ("q", "x")], "task_id string, split string")
    assert tuple(Q.split_report(s, want).first()) == (1, 0, 1, 3)


def test_label_rules(spark, tmp_path):
    good = {"task_id": "math_1", "dataset_category": "math", "category": "math", "prompt": "What is 2 + 2 in total?", "label": "local_ok", "correct": True, "verified": True, "latency_s": 1.0, "completion_tokens": 3, "model": "m", "provenance": {"schema_version": 1, **{h: "a" * 64 for h in Q.HASHES}, "budget_seconds": 18.0, "threads": 2}}
    bad = good | {"task_id": " x", "label": "escalate", "latency_s": -1.0, "provenance": {}}
    (tmp_path / "l.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(bad) + "\n")
    got = [r["v"] for r in readers.labels(spark, str(tmp_path / "l.jsonl")).select(Q.violations(Q.label_rules()).alias("v")).collect()]
    assert got[0] == [] and got[1][:3] == ["task_id is blank or untrimmed", "label contradicts correct", "latency_s is negative or no number"]
    assert Q.profile_problems({}) and not Q.profile_problems({"schemaVersion": 1, "modelType": "hashed-logistic-v1", "dimension": 4, "bias": 0.0, "threshold": 1.01, "weights": {"3": 1.0}})
    assert "weights" in Q.profile_problems({"schemaVersion": 1, "modelType": "hashed-logistic-v1", "dimension": 4, "bias": 0.0, "threshold": 0.5, "weights": {"4": 1.0}})


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"task_id": "a", "prompt": "p"}, {"prompt": "q"}]')
    (tmp_path / "b.json").write_text('{"tasks": [{"task_id": "b", "prompt": "r"}]}')
    assert [(r["idx"], r["task_id"]) for r in readers.tasks(spark, str(tmp_path / "a.json")).collect()] == [(0, "a"), (1, None)]
    assert readers.tasks(spark, str(tmp_path / "b.json")).count() == 1
    (tmp_path / "c.json").write_text('{"x": 1}')
    with pytest.raises(PySparkException):
        readers.tasks(spark, str(tmp_path / "c.json")).collect()
    answers = spark.createDataFrame([("a", " ")], "task_id string, answer string")
    final = writers.final_answers(readers.tasks(spark, str(tmp_path / "a.json")), answers).orderBy("idx").collect()
    assert [r["task_id"] for r in final] == ["a", "1"] and all(r["answer"] for r in final)
    shard = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "task_id string, v int")
    manifest = spark.createDataFrame([("b", 0), ("a", 1)], "task_id string, idx long")
    assert [r["task_id"] for r in readers.merged([shard, shard], manifest).collect()] == ["b", "a"]
    with pytest.raises(PySparkException):
        readers.merged([shard, spark.createDataFrame([("a", 9)], "task_id string, v int")], manifest).collect()


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    kinds = list(V.NEEDED)
    (source / "1.json").write_text("\n".join(json.dumps({"type": k, "runId": "r1"}) for k in kinds[:2]))
    (source / "2.json").write_text("\n".join(json.dumps({"type": k, "runId": r}) for k, r in [(kinds[2], "r1"), ("run.error", "r2")]))
    query = V.completed_runs(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    rows = lambda df: sorted(map(tuple, df.select("runId", "events", "failed", "complete").collect()))
    assert rows(V.latest_runs(spark, str(tmp_path / "out"))) == rows(V.lifecycle(readers.events(spark, str(source)))) == [("r1", 3, False, True), ("r2", 1, True, False)]


def test_model_choice(spark):
    m = spark.createDataFrame([("org/big-70b", 0), ("org/x-7b", 1), ("org/mini", 2), ("org/pro", 3)], "model string, idx int")
    name = lambda df: df.first()["model"]
    assert name(R.preferred(m, ["zz", "x-"])) == "org/x-7b" and name(R.preferred(m, [])) == "org/big-70b"
    assert name(R.preferred(m, [], patterns=(P.SMALL_MODEL, P.MID_MODEL))) == "org/mini"
    assert name(R.distinct_model(m, ["org/pro"], [])) == "org/big-70b" and name(R.distinct_model(m, [], ["7b"])) == "org/x-7b"
    assert name(R.configured_model(m, "org/mini", [])) == "org/mini" and name(R.configured_model(m, "", ["none"], last=True)) == "org/pro"
    with pytest.raises(ValueError):
        R.configured_model(m, "other", [])
    assert E.named(m, "mini").count() == 1 and E.grid(m, ["a", "b"], ["c"]).count() == 8


def test_training_is_the_same_in_one_task_and_in_many(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, i, float(r.random())) for k in range(60) for i in r.sample(range(20), 5)]
    features, labels = spark.createDataFrame(rows, "id long, idx int, value double").repartition(3), spark.createDataFrame([(k, k % 3 == 0) for k in range(60)], "id long, b boolean").selectExpr("id", "cast(b as int) label")
    one = L.fit(features, labels, 20, epochs=6)
    monkeypatch.setattr(L, "PACKED", 3)
    monkeypatch.setattr(L, "ADDED", 2)
    many = L.fit(features, labels, 20, epochs=6)
    assert one[0] == pytest.approx(many[0], abs=1e-7) and one[1] == pytest.approx(many[1], abs=1e-7)


def test_a_profile_is_built_and_checked(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    records = d.selectExpr("doc_id id", "case when doc_id % 5 = 0 then 'test' when doc_id % 5 = 1 then 'calibration' else 'train' end split", "text prompt", "lang category", "if(quality = 1, 'local_ok', 'escalate') label", "quality = 1 correct", "toxic = 0 verified", "n_chars / 200.0D latency_s", "n_chars div 4 completion_tokens")
    profile, computed = O.build(records, dimension=256, epochs=4)
    assert not Q.profile_problems(profile) and profile["provenance"]["profileSemanticSha256"] == L.profile_digest(profile)
    found = {x["rule"]: x["ok"] for x in O.checked(profile, computed, computed).collect()}
    assert found["fields"] and found["digest"] and all(ok for rule, ok in found.items() if not rule.startswith("gate.")) and sum(r.startswith("gate.") for r in found) == 8
    labels = {x["label"] for x in O.infer(records.select("id", "prompt", "category"), profile).collect()}
    assert labels <= {"escalate", "local_ok"}
    broken = {**profile, "threshold": 2.0}
    assert not {x["rule"]: x["ok"] for x in O.checked(broken, computed, computed).collect()}["fields"]


def test_settings(tmp_path):
    assert C.env_pairs("# x\nA=1\n\nB = 'two'\nno\n") == {"A": "1", "B": "two"} and C.with_defaults({"A": "0"}, {"A": "1", "B": "2"}) == {"A": "0", "B": "2"}
    good = {"schemaVersion": 1, "modelType": "hashed-logistic-v1", "dimension": 4, "bias": 0.0, "threshold": 0.3, "weights": {"1": 0.5}, "categoryPolicy": {"always_escalate": ["debug"]}}
    paths = [str(tmp_path / n) for n in ("missing.json", "broken.json", "bad.json", "good.json")]
    writers.write_copies("{", paths[1:2])
    writers.write_copies(json.dumps({**good, "dimension": 0}), paths[2:3])
    writers.write_copies(O.as_json(good), [paths[3], str(tmp_path / "deep" / "copy.json")])
    assert (tmp_path / "good.json").read_bytes() == (tmp_path / "deep" / "copy.json").read_bytes()
    assert C.first_profile(paths) == (paths[3], good) and C.first_profile(paths[:3]) is None
    assert C.merged({"threshold": 0.7, "expectedCompletionTokens": {"math": 5}}, good) == {"threshold": 0.3, "always_escalate": ["debug"], "trust_local": [], "expected_tokens": {"math": 5.0}, "expected_latency": {}}
    assert C.merged({}, None)["threshold"] == 0.5 and C.normalized_weights(good) == {1: 0.5}
    with pytest.raises(ValueError):
        C.normalized_weights({**good, "weights": {"4": 1.0}})


def test_a_task_without_truth_is_an_error(spark):
    todo, truth = spark.createDataFrame([("a",), ("b",)], "task_id string"), spark.createDataFrame([("a", "x")], "task_id string, answer string")
    assert O.with_truth(todo.filter("task_id = 'a'"), truth).count() == 1
    with pytest.raises(PySparkException):
        O.with_truth(todo, truth).collect()


def test_matches_say_what_was_matched(spark):
    t = [("a", "s", "write a function that adds two given numbers", None), ("b", "s", "write a function that adds two given number", None), ("c", "s", "something else", None), ("d", "r", "something else entirely, long", None)]
    grouped = G.groups(spark.createDataFrame(t, "task_id string, scope string, canonical string, explicit string")).withColumn("normalized", F.upper("canonical"))
    public = spark.createDataFrame([("s", "write a function that adds two given numbers", "f1", "p1", "x"), ("q", "no", "f2", "p2", "SOMETHING ELSE ENTIRELY, LONG")], "scope string, canonical string, source string, task_id string, normalized string")
    got = {r["leader"]: (r["task_id"], r["kind"]) for r in G.matches(grouped, public).collect()}
    assert got == {r["leader"]: ("p1", "template") for r in grouped.filter("task_id = 'a'").collect()} | {"d": ("p2", "exact")}


def test_guards_and_small_parsers(spark, tmp_path):
    from loomspark.functions import numeric as N

    x = F.col("x")
    rows = spark.createDataFrame([(1.0,), (0.5,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "x double").select(N.finite(x), N.positive(x), N.ratio(x)).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (True, True, True), (True, False, False)] + [(False, False, False)] * 3
    assert E.choices(" a, b,a", ["a", "b", "c"]) == ["a", "b"]
    for bad in ("", "z"):
        with pytest.raises(ValueError):
            E.choices(bad, ["a"])
    (tmp_path / "x.txt").write_text("abc")
    assert [tuple(r) for r in readers.file_digests(spark, str(tmp_path)).collect()] == [("x.txt", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]
    good = {"modelType": "m", "dimension": 4, "bias": 0.0, "threshold": 0.3, "weights": {}}
    assert O.revision(good, ["b", "a"]) == O.revision(good, ["a", "b"]) != O.revision(good, ["a"]) and O.revision(good, []).startswith("compact-")


def test_an_epoch_reads_examples_as_bytes(spark, monkeypatch):
    """Epochs read packed examples again and again: three bytes a number for counts, and the very numbers come back."""
    import math

    import numpy as np

    seen, written = [], L.written
    monkeypatch.setattr(L, "written", lambda df, name: seen.append(written(df, name)) or seen[-1])
    monkeypatch.setattr(L, "dropped", lambda *tables: None)
    r = random.Random(4)
    rows = [(k, i, 1 + math.log(r.randrange(1, 9))) for k in range(90) for i in r.sample(range(1000), 40)]
    L.fit(spark.createDataFrame(rows, "id long, idx int, value double").repartition(3), spark.createDataFrame([(k, k % 3 == 0) for k in range(90)], "id long, b boolean").selectExpr("id", "cast(b as int) label"), 1000, epochs=1)
    (packed,) = seen
    assert {f.dataType.simpleString() for f in packed.schema} == {"binary"}
    batches = packed.toArrow().to_batches()
    assert sum(c.nbytes for b in batches for c in b.columns) < 4 * len(rows)
    back = []
    for b in batches:
        for k in range(b.num_rows):
            sizes, at, x, y = L._arrays(b, k, 1000)
            ends = np.cumsum(sizes)
            back += [(float(label), sorted(zip(at[e - n : e].tolist(), x[e - n : e].tolist()))) for n, e, label in zip(sizes, ends, y)]
    assert sorted(back) == sorted((float(k % 3 == 0), sorted((i, v) for j, i, v in rows if j == k)) for k in range(90))
