"""Similar texts and leaders against nested loops, splits against a rule group by group."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.functions import udfs as U
from loomspark.operators import similar as S
from loomspark.operators import templates as G

LEAST = 0.82


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["order", "ship", "bill", "red", "blue", "town", "capital", "of", "the", "find", "a", "b2", "<num>", "<name>", "überall", "straße"]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:  # an earlier text with an edit or two
            t = list(rng.choice(out))
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 2)] = rng.choice(["", "x", " ", "ю", "an"])
            out.append("".join(t))
        else:
            out.append(rng.choice(["", "", "Где ", "東京"]) + " ".join(rng.choices(words, k=rng.randint(0, 12))))
    return sorted(set(out))


def frame(spark, texts):
    return spark.createDataFrame([(f"s{len(t) % 2}", t) for t in texts], "scope string, text string").repartition(3)


def test_pairs_are_those_of_the_nested_loop(spark):
    texts = some_texts(1, 420) + ["", "a", "ab", "ю", "юю", "ю" * 9, "ю" * 10, "ю" * 11]
    left, right = texts[::2] + texts[:30], texts[1::2] + texts[:30]
    got = {tuple(r) for r in S.pairs_between(frame(spark, left), frame(spark, right), LEAST).collect()}
    want = {(f"s{len(a) % 2}", a, b, s) for a in set(left) for b in set(right) if len(a) % 2 == len(b) % 2 and a != b and (s := U.template_similarity(a, b, LEAST)) >= LEAST}
    assert got == want and len(want) > 50


def plain_leaders(texts):
    first, out = [], {}
    for t in sorted(texts, key=lambda t: t.encode()):
        best = max(((U.template_similarity(t, f, LEAST), -k) for k, f in enumerate(first)), default=(0, 0))
        if best[0] >= LEAST:
            out[t] = first[-best[1]]
        else:
            first.append(t)
            out[t] = t
    return out


@pytest.mark.parametrize("rounds", [0, 4])
def test_leaders_are_those_of_the_sequence(spark, monkeypatch, rounds):
    monkeypatch.setattr(S, "STAR_ROUNDS", rounds)
    texts = some_texts(2, 300)
    got = {(r["scope"], r["text"]): r["leader"] for r in S.leaders(frame(spark, texts), LEAST).collect()}
    want = {}
    for scope in ("s0", "s1"):
        want |= {(scope, t): f for t, f in plain_leaders([t for t in texts if f"s{len(t) % 2}" == scope]).items()}
    assert got == want and len(set(got.values())) < len(got)


def test_few_candidates_of_many_texts(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"tell me of {''.join(rng.choices(letters, k=9))} and {''.join(rng.choices(letters, k=8))} please" for _ in range(2500)]
    texts += [t + "s" for t in texts[:200]]
    nodes, entries = S.index(spark.createDataFrame([("s", t) for t in texts], "scope string, text string"), LEAST)
    met = S.candidates(entries, entries, ordered=True)
    assert met.count() < 0.05 * len(texts) ** 2 / 2
    assert S.similar(met, nodes, LEAST).count() >= 200
    assert S.leaders(spark.createDataFrame([], "scope string, text string")).count() == 0


def test_a_dense_group_is_compared_with_its_leader(spark):
    texts = [f"please compare the long wording of this one template with number {k:04d} and nothing else of note today" for k in range(600)]
    df = spark.createDataFrame([("s", t) for t in texts], "scope string, text string")
    assert {r["leader"] for r in S.leaders(df, LEAST).collect()} == set(plain_leaders(texts).values())


def test_explicit_templates_are_keys(spark):
    rows = [("a", "s", "x", "template_id:1"), ("b", "s", "y", "template_id:1"), ("c", "s", "x", "template_id:2"), ("d", "t", "x", "template_id:1"), ("e", "s", "x", None), ("f", "s", "x", None), ("g", None, "x", None)]
    got = {r["task_id"]: r["leader"] for r in G.groups(spark.createDataFrame(rows, "task_id string, scope string, canonical string, explicit string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "e", "g": "g"}


def by_groups(groups, share, seed):
    """{group: split} by giving out one group after another. groups: {(scope, leader): Counter of strata}."""
    kinds = defaultdict(list)
    for g, strata in groups.items():
        kinds[tuple(sorted(strata.items()))].append(g)
    total = sum(groups.values(), Counter())
    have, seen, out = {s: Counter() for s in share}, Counter(), {}
    for kind in sorted(kinds, key=lambda k: (-sum(m for _, m in k), k)):
        members = kinds[kind]
        for _ in members:
            seen.update(dict(kind))
        took = {s: math.floor(share[s] * len(members) + 1e-9) for s in share}
        for s in share:
            for _ in range(took[s]):
                have[s].update(dict(kind))
        while sum(took.values()) < len(members):
            owed = {s: round(sum((share[s] * seen[k] - have[s][k]) * m / total[k] for k, m in kind), 9) for s in share}
            s = max(share, key=owed.get)
            took[s] += 1
            have[s].update(dict(kind))
        drawn = sorted(members, key=lambda g: (hashlib.md5(":".join((str(seed), *g)).encode()).hexdigest(), g))
        out |= dict(zip(drawn, [s for s in share for _ in range(took[s])]))
    return out


def test_split_is_that_of_single_groups(spark):
    rng = random.Random(8)
    rows = [(f"s{g % 3}", f"g{g}", rng.choice(["math", "logic", None]), rng.choice(["ok", "no"])) for g in range(400) for _ in range(rng.choice([1, 1, 1, 2, 2, 5]))]
    df = spark.createDataFrame(rows, "scope string, leader string, category string, label string").repartition(4)
    groups = defaultdict(Counter)
    for s, g, c, k in rows:
        groups[s, g][c or "", k] += 1
    for seed in (7, 19):
        parted = G.split(df, seed=seed)
        got = {(r["scope"], r["leader"]): r["split"] for r in parted.collect()}
        assert got == by_groups(groups, G.shares(), seed) and parted.count() == len(rows)
    told = {r["split"]: r for r in G.split_diagnostics(parted).collect()}
    assert sum(r["records"] for r in told.values()) == len(rows) and sum(r["groups"] for r in told.values()) == len(groups)
    assert all(sum(r["strata"].values()) == r["records"] for r in told.values())
    assert abs(told["train"]["records"] / len(rows) - 0.6) < 0.02


def test_no_split_stays_empty_and_shares_are_checked(spark):
    for sizes in ([1, 1, 1], [5, 1, 1], [1, 1, 1, 9]):
        df = spark.createDataFrame([("s", f"g{g}", "c", "k") for g, n in enumerate(sizes) for _ in range(n)], "scope string, leader string, category string, label string")
        assert {r[0] for r in G.split(df).select("split").collect()} == set(G.NAMES)
    assert G.split(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        G.split(df, calibration=0.5, test=0.5)
    assert G.split_each(spark.range(9).select(F.col("id").cast("string").alias("task_id"), F.lit("c").alias("category"), F.lit("k").alias("label"))).count() == 9
