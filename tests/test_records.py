"""Labels, answers and provenance with repeats, gaps and mixtures."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspark.functions import numeric as N
from loomspark.functions import text as T
from loomspark.operators import evaluate as E
from loomspark.operators import profile as O
from loomspark.operators import quality as Q
from loomspark.operators import solve as D
from loomspark.sources import readers


def test_the_last_answer_counts(spark, tmp_path):
    (tmp_path / "results.json").write_text(json.dumps([{"task_id": "a_1", "answer": "6"}, {"task_id": "b_1", "answer": "x"}, {"task_id": "a_1", "answer": "7"}]))
    results = readers.results(spark, str(tmp_path / "results.json"))
    tasks = spark.createDataFrame([("a_1", "p"), ("b_1", "p"), ("c_1", "p")], "task_id string, prompt string")
    truth = spark.createDataFrame([("a_1", "number", "6", 2), ("a_1", "number", "7", 3), ("a_1", "number", "8", 1), ("c_1", "number", "1", 0)], "task_id string, kind string, expected string, idx int")
    got = {r["task_id"]: (r["ok"], r["via"]) for r in E.judged(tasks, results, truth).collect()}
    assert got == {"a_1": (True, "det"), "b_1": (None, "judge"), "c_1": (False, "missing")}
    assert E.judged(tasks, results.drop("idx"), truth.drop("idx")).count() == 3


def labels(spark, rows):
    return spark.createDataFrame(rows, "task_id string, v int, provenance struct<run:string>")


def test_shards_of_one_run(spark):
    manifest = spark.createDataFrame([("b", 0), ("a", 1)], "task_id string, idx long")
    one, two = labels(spark, [("a", 1, ("r",))]), labels(spark, [("b", 2, ("r",)), ("a", 1, ("r",))])
    assert [r["task_id"] for r in readers.merged([one, two], manifest).collect()] == ["b", "a"]
    for bad in (("b", 2, ("other",)), ("b", 2, None)):
        with pytest.raises(ValueError):
            readers.merged([one, labels(spark, [bad])], manifest)
    with pytest.raises(PySparkException):
        readers.merged([one, two, labels(spark, [("a", None, ("r",))])], manifest).collect()


def test_class_support(spark):
    of = lambda *rows: Q.class_support(spark.createDataFrame([(x,) for x in rows], "label string"), least=2, least_all=5)
    assert tuple(of(*["local_ok"] * 3, *["escalate"] * 2).first()) == (5, 3, 2, True, False)
    assert of(*["local_ok"] * 9, "escalate").first()["ok"] is False and of(*["local_ok"] * 9).first()["one_class"] is True
    with pytest.raises(PySparkException):
        of("local_ok", None).collect()


def test_first_tasks_and_snippets(spark):
    findings = spark.createDataFrame([(f"t{k:03d}", "missing") for k in range(40)] + [("z", "extra")], "task_id string, finding string")
    got = {r["finding"]: (r["n"], r["task_ids"]) for r in Q.first_tasks(findings).collect()}
    assert got == {"missing": (40, [f"t{k:03d}" for k in range(10)]), "extra": (1, ["z"])}
    assert spark.range(1).select(T.snippet(F.lit("  " + "é" * 400))).first()[0] == "é" * 300


def test_system_texts(spark):
    texts = {"math": "Count.", "ner": "Name."}
    df = spark.createDataFrame([("math",), ("logic",), (None,)], "category string")
    assert [r[0] for r in df.select(D.system_text(F.col("category"), texts)).collect()] == ["Count.", None, None]
    assert [r[0] for r in df.select(D.system_text(F.col("category"), texts, "raw")).collect()] == [None] * 3
    with pytest.raises(ValueError):
        D.system_text(F.col("category"), texts, "other")


def test_compact_numbers(spark):
    values = [0.0, 5.0, -3.0, 100000.4, 999999.5, 1234567.8, 0.1, 0.25, 1 / 3, 12345.678, 0.00012, 0.00002, -0.00005, 2.5e7 + 0.5, 10.10]
    want = [str(int(v)) if v == int(v) else f"{round(v, 6):g}" for v in values]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(N.compact_number(F.col("x"))).collect()]
    assert got == want


def test_provenance_of_training(spark, tmp_path):
    for name, text in (("solver/a.py", "A"), ("solver/b.py", "B"), ("label.py", "L"), ("tasks.json", "T"), ("labels.jsonl", "{}")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    bundle = sha(f"a.py\0{sha('A')}\nb.py\0{sha('B')}\n")
    run = (bundle, sha("L"), sha("T"))
    make = lambda rows: spark.createDataFrame(rows, "task_id string, provenance struct<solver_bundle_sha256:string,labeler_sha256:string,task_manifest_sha256:string>")
    args = [f"{tmp_path}/labels.jsonl", f"{tmp_path}/solver/*.py", f"{tmp_path}/label.py", f"{tmp_path}/tasks.json"]
    got = O.training_provenance(make([("a", run), ("b", run)]), *args)
    assert got["labelRecordCount"] == 2 and got["solverFiles"] == {"a.py": sha("A"), "b.py": sha("B")} and got["labelFiles"] == [{"path": "labels.jsonl", "sha256": sha("{}")}] and got["requiredTasksSha256"] == sha("T")
    assert got["labelRecordsSha256"] == O.training_provenance(make([("b", run), ("a", run)]), *args)["labelRecordsSha256"]
    for rows in ([("a", run), ("b", None)], [("a", run), ("b", ("x", *run[1:]))], [("a", ("x", *run[1:]))], [("a", (*run[:2], "x"))]):
        with pytest.raises(ValueError):
            O.training_provenance(make(rows), *args)
