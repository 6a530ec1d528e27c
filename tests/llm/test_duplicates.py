import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import graph, jaccard, substrings

from . import brute


def small_corpus(seed=3):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(50, 120))) for _ in range(12)]
    noise = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 80)))
    docs = [(i, "".join(r.choice(base) if r.random() < 0.5 else noise() for _ in range(r.randint(0, 8)))) for i in range(150)]
    docs += [(1000 + i, "a" * r.randint(0, 200)) for i in range(15)] + [(2000, None), (2001, ""), (2002, "ab" * 100), (2003, "ba" * 80)]
    docs += [(3000 + i, docs[5][1]) for i in range(20)]
    r.shuffle(docs)
    return docs


def removed(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(df).collect())


@pytest.mark.parametrize("frequent", [2000, 4])
def test_substrings(spark, monkeypatch, frequent):
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "TIMES_MEAN", 0)
    docs = small_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("n_bytes", F.lit(1)).withColumn("tie", F.lit("x"))
    assert removed(df) == sorted(brute.without_repeats(docs))


def test_substrings_of_equal_ids_and_nothing(spark):
    t = "one string of more than fifty bytes, which is here for a while"
    df = spark.createDataFrame([(1, t), (1, "x" + t), (1, t), (None, "q" + t)], "doc_id long, text string")
    got = removed(df.filter("doc_id is not null"))
    assert [g[2] for g in got] == [0, 0, 0]
    assert sorted(r["n_removed"] for r in substrings.remove_repeats(df).collect()) == [0, 62, 62, 62]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_pointers_tell_strings_apart():
    r = np.random.default_rng(1)
    data = r.integers(0, 2, 400).astype(np.uint8)
    left = np.arange(len(data), 0, -1)
    pointer = substrings.refine(data, left, 20)
    seen = {}
    for k in range(len(data)):
        s = data[k : k + 20].tobytes()
        assert (pointer[k] < 0) == (len(s) < 20)
        if len(s) == 20:
            assert seen.setdefault(s, pointer[k]) == pointer[k]
    assert len(set(seen.values())) == len(seen)


def similar_corpus(seed=5):
    r = random.Random(seed)
    voc = [f"w{k}" for k in range(300)]
    docs, i = [], 0
    for _ in range(40):
        base = [r.choice(voc) for _ in range(r.randint(1, 60))]
        for _ in range(r.randint(1, 6)):
            w = [x if r.random() > 0.03 else r.choice(voc) for x in base]
            docs.append((i, " ".join(w) + r.choice(["", " ", " x"])))
            i += 1
    hot = [r.choice(voc) for _ in range(80)]
    for _ in range(60):
        w = list(hot)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(80)] = r.choice(voc) + "X"
        docs.append((i, " ".join(w)))
        i += 1
    docs += [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "A b"), (i + 4, "a B"), (i + 5, docs[0][1])]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("piece, hot", [(2048, 50_000), (16, 50_000), (16, 8), (2048, 3)])
def test_similarity_join(spark, monkeypatch, piece, hot):
    shares = jaccard._shares
    # workers take constants from the module's file, functions from the closure
    monkeypatch.setattr(jaccard, "_shares", lambda tokens, counts: shares(tokens, counts * np.uint32(50_000 // hot)))
    monkeypatch.setattr(jaccard, "PIECE", piece)
    monkeypatch.setattr(jaccard, "PIECE_SHINGLES", 40 * piece)  # a few texts a block
    monkeypatch.setattr(jaccard, "MEETING", min(piece, jaccard.MEETING) // 4)
    docs = similar_corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("component_id", F.lit(0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(df).collect()}
    assert got == brute.components(docs)


def test_long_lists_that_begin_alike_both_count(spark):
    kind = "docs array<long>, ns array<long>, ls array<long>, family long, times long"
    row = lambda docs, family: (docs, [10] * len(docs), [1] * len(docs), family, 1)
    # lists 1 2 3 4 and 1 2 5 6 in pieces of two; 1 and 2 share both, as many as they need
    lists = [row([1, 2], f) for f in (11, 22)] + [row([3, 4], 11), row([5, 6], 22)]
    full = jaccard._with_totals(spark.createDataFrame(lists, kind))
    assert sorted((r["docs"], r["family"], r["times"]) for r in full.collect()) == [([1, 2], 11, 1), ([1, 2], 22, 1), ([3, 4], 11, 1), ([5, 6], 22, 1)]
    pairs = jaccard._rest_pairs(full, spark.createDataFrame([], "node long, component long"), 75)
    assert [sorted(r["left"] + r["right"]) for r in pairs.collect()] == [[1, 2]]
    # one list of two documents, where one doc_id has sets of two sizes
    two = [([1, 2], [n, 10], [1, 1], 0, 1) for n in (10, 11)]
    assert jaccard._with_totals(spark.createDataFrame(two, kind)).count() == 2


def test_exact_shingles_tell_what_hashes_may_not(monkeypatch):
    texts = ["a b c d e f", "A b c d e f", "a b c d", "a b c d e", "b c d e f", "", " ", "x", "a b c d e a b c d e", "c d e f a"]
    sets = jaccard.exact_sets(pa.array(texts, pa.large_string()))
    names = {}
    for t, s in zip(texts, sets, strict=True):
        own = brute.shingle_set(t)
        assert len(own) == len(s)
        names[frozenset(own)] = names.get(frozenset(own), tuple(s.tolist()))
        assert names[frozenset(own)] == tuple(s.tolist())
    for a, x in zip(texts, sets):
        for b, y in zip(texts, sets):
            assert len(np.intersect1d(x, y)) == len(brute.shingle_set(a) & brute.shingle_set(b))


def test_links_hold_where_hashes_collide(spark, monkeypatch):
    plain = jaccard.common.hash_words
    # a few hundred hashes for all words: many shingles collide, and only verified links count
    monkeypatch.setattr(jaccard.common, "hash_words", lambda d: plain(d) % np.uint64(400))
    docs = similar_corpus()[:120]
    links = jaccard._verified(spark.createDataFrame([([a], [b], b) for a, _ in docs for b, _ in docs if a < b], "left array<long>, right array<long>, hub long"), spark.createDataFrame([(i, t or "") for i, t in docs], "node long, text string"), 5, 75)
    top = brute.components(docs)
    got = graph.components(links).distinct().collect()
    assert {r["node"]: r["component"] for r in got if r["node"] != r["component"]} == {i: c for i, (_, c) in top.items() if i != c}


def test_similarity_join_on_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.components(docs)


def test_similarity_join_of_equal_ids_and_nothing(spark):
    a, b = "one two three four five six", "other words are in this text here"
    df = spark.createDataFrame([(9, a), (9, b), (9, a), (4, b), (None, None), (7, a)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.classes(df).collect()), key=str)
    assert got == [(4, 4), (7, 4), (9, 4), (9, 4), (9, 4), (None, None)]
    assert jaccard.classes(df.limit(0)).count() == 0


def test_least_shared_never_exceeds_what_similar_sets_share():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 40)
        x = set(range(n))
        y = (x - {k for k in x if r.random() < 0.1}) | set(range(100, 100 + r.randint(0, 3)))
        if not y or 100 * len(x & y) < 75 * len(x | y):
            continue
        order = {k: r.random() for k in x | y}
        parts, l = [], [r.randint(1, jaccard.least_overlap(len(s))) for s in (x, y)]
        for s, m in zip((x, y), l):
            parts.append(set(sorted(s, key=order.get)[: len(s) - jaccard.least_overlap(len(s)) + m]))
        need = jaccard.least_shared(np.array([len(x)]), np.array([l[0]]), np.array([len(y)]), np.array([l[1]]))[0]
        assert len(parts[0] & parts[1]) >= need


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(1, 2), (2, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert all(got[k] == 10 for k in range(10, 41)) and got[1] == got[2] == got[3] == 1
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_random_edges(spark):
    r = random.Random(4)
    for n, m in ((30, 12), (60, 45), (40, 80)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        top = list(range(n))
        for _ in range(n):
            for a, b in edges:
                top[a] = top[b] = min(top[a], top[b])
        got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {k: top[k] for a, b in edges if a != b for k in (a, b)}
