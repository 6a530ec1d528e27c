"""The audit against filters applied to lists of rows in every order, and its odd inputs."""

import re
from itertools import permutations

import pytest

from loomspark.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k}" for k in range(60))


def plain(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)} by running each order."""
    good, toxic = ({i for i, *f in labels if i is not None and f[k] == 1} for k in (0, 1))
    rows = []
    for i, t, source in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((source or "", i, fails))
    out, total = {}, {}
    for part in {p for p, *_ in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[2][f]]
                left = [r for r in left if not r[2][f]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                fails = sum(r[2][f] for r in own)
                alone = sum(r[2][f] and sum(r[2].values()) == 1 for r in own)
                out[part, order, step] = (len(left), len(gone), fails - len(gone), alone, sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone))
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def got(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id long, text string, source string, key string, E string").repartition(3)
    rows = filter_audit.audit_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}


DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (None, LONG, None), (4, None, "a"), (5, "", ""), (6, LONG + " #", "b"), (7, LONG.upper(), "b"),
    (8, "same " * 80, "a"), (9, "same " * 80, "a"), (10, "\x0b \t", None), (11, "é" * 30 + " " + LONG, "c"), (12, " ".join(["word"] * 70 + ["$"]), "c"), (None, None, "c"), (13, "x" * 200_000, "long"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (6, 0, 1), (7, None, None), (8, 1, None), (8, 0, 1), (None, 1, 1), (99, 1, 1)]


def test_audit_is_that_of_every_order(spark):
    assert got(spark, DOCS, LABELS) == plain(DOCS, LABELS)


def test_frequent_texts_and_no_rows(spark):
    docs = [(k, "copy" if k % 3 else f"{LONG} {k}", f"s{k % 2}") for k in range(3000)]
    out = got(spark, docs, [])
    assert out == {k: v for k, v in plain_counts(docs).items()}
    assert got(spark, [], []) == {}


def plain_counts(docs):
    """As plain, with the first id of each text found once."""
    first = {}
    for i, t, _ in docs:
        first[t] = min(i, first.get(t, i))
    shadow = {}
    for i, t, s in docs:
        shadow.setdefault(t, (first[t], t, "elsewhere"))
    out = {}
    for part in {s for *_, s in docs}:
        own = [r for r in docs if r[2] == part]
        kinds = {}
        for i, t, s in own:
            kinds.setdefault((len(WORD.findall(t)) < 50, i > first[t]), []).append(i)
        n = {k: len(v) for k, v in kinds.items()}
        both, a, e, ok = n.get((True, True), 0), n.get((True, False), 0), n.get((False, True), 0), n.get((False, False), 0)
        for order in map("".join, permutations("ABCDE")):
            kept = both + a + e + ok
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = {"A": a + both * ("E" not in before), "E": e + both * ("A" not in before)}.get(f, 0)
                kept -= removed
                fails = {"A": a + both, "E": e + both}.get(f, 0)
                out[part, order, step] = (kept, removed, fails - removed, {"A": a, "E": e}.get(f, 0), 0, 0, 60 * (fails + fails - both) if f in "AE" else 0)
    return out


@pytest.mark.parametrize("names", [["A"], ["A", "B", "C"]])
def test_any_filters(spark, names):
    from pyspark.sql import functions as F

    docs = spark.range(40).withColumn("v", F.when(F.col("id") > 2, F.col("id")))
    rows = filter_audit.audit(docs, {f: F.col("v") % (k + 2) == 0 for k, f in enumerate(names)}, F.lit(None).cast("string"), {"low": F.col("v") < 9}).collect()
    for r in rows:
        assert r["part"] == "" and r["step"] <= len(names)
        left = [i for i in range(40) if i < 3 or all(i % (names.index(f) + 2) for f in r["filter_order"][: r["step"]])]
        assert r["kept"] == len(left)
    assert len(rows) == {1: 1, 3: 18}[len(names)]
