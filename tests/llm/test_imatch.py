"""Fingerprints against sets of words taken one by one, next documents against a sorted list."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import common, imatch

SPACE = " \t\n\x0b\f\r"


def words(text):
    out, word = set(), ""
    for c in (text or "") + " ":
        if c in SPACE:
            out |= {word} - {""}
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def key(word):
    return xxhash.xxh3_64_intdigest(word.encode())


def plain_lexicon(texts):
    n = Counter(w for t in texts for w in words(t))
    return {w for w, k in n.items() if k >= max(2, imatch.LEAST_SHARE * len(texts)) and k <= imatch.MOST_SHARE * len(texts)}


def mix(x):
    return int(common.mix(np.array([x % (1 << 64)], np.uint64))[0])


def plain_print(text, lexicon):
    """(level, {(rate, subset): sorted distinct words of it})."""
    own = words(text)
    own = own & lexicon or own
    if not own:
        return -1, {}
    level = len(own).bit_length() - 1
    out = {}
    for k in range(imatch.SUBSETS):
        seed = mix((k + 1) * 0x9E3779B97F4A7C15)
        for rate in range(imatch.RATES):
            chosen = sorted(key(w) for w in own if mix(key(w) ^ seed) < 1 << 64 - level - rate)
            if chosen:
                out[level + rate, k] = tuple(chosen)
    return level, out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    levels = {a[0] + r for r in range(imatch.RATES)} & {b[0] + r for r in range(imatch.RATES)} if min(a[0], b[0]) >= 0 else set()
    slots = {s for s in [*a[1], *b[1]] if s[0] in levels}
    return sum(a[1].get(s) == b[1].get(s) for s in slots) / max(len(slots), 1)


def plain(docs):
    """Rows of the query as a list, by plain steps. The order of rows with one id is that of the result's own hash."""
    lexicon = plain_lexicon([t for _, t in docs])
    out = []
    for k, (i, t) in enumerate(docs):
        t, following = t or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(t) // 4
        new = t[: len(t) - q] + following[:q]
        own = plain_print(t, lexicon)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), plain_likeness(own, plain_print(new, lexicon)), plain_likeness(own, plain_print(following, lexicon))))
    return out


def got(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).withColumns({c: F.lit(c) for c in ("part", "edge", "tie", "next", "n_chars")})
    return imatch.compare(df).collect()


def rows(found):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], pytest.approx(r["near_edited"]), pytest.approx(r["near_next"])) for r in sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))]


def test_rows_as_by_plain_steps(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(rng.choices(vocabulary, [1 / (n + 1) for n in range(400)], k=rng.choice([0, 1, 3, 9, 40, 200])))) for k in range(150)]
    docs[20], docs[21], docs[40] = (20, None), (21, ""), (40, " \n\t\x0b")
    docs += [(500, "É𝄞 " * 30 + "Wort"), (501, docs[30][1]), (502, "w0 " * 100_000)]
    docs.insert(0, (None, "w1 w2 w3 w399"))
    for parts in (1, 7):
        found = got(spark, docs, parts)
        assert rows(found) == plain(docs)
        prints = {r["doc_id"]: r["fingerprint"] for r in found}
        assert prints[30] == prints[501] and prints[20] == prints[21] == prints[40] == ""


def test_few_rows_and_ties(spark):
    assert got(spark, []) == []
    (one,) = got(spark, [(4, "a b c d e f g h")])
    assert one["edited_sha256"] == hashlib.sha256(b"a b c d e f a b").hexdigest() and one["near_next"] == 1.0  # 15 characters, 3 of them new
    docs = [(1, "a b c d"), (1, "e f g h"), (1, "a b c d"), (None, "x y"), (None, None)]
    once, again = (sorted(map(repr, got(spark, docs, p))) for p in (1, 4))
    assert once == again and len(once) == 5


def test_lexicon_is_the_band(spark):
    texts = [f"all w{k % 2} v{k % 30} u{k}" for k in range(300)]
    terms = imatch.lexicon(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert terms.tolist() == sorted(key(w) for w in plain_lexicon(texts)) == sorted(key(f"v{k}") for k in range(30))


def test_lexicon_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(imatch, "MOST_TERMS", 10)
    texts = [f"v{k % 30} " + " ".join(f"t{n}" for n in range(5) if k % (15 + n) == 0) for k in range(300)]
    terms = imatch.lexicon(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert 0 < len(terms) <= 10


def test_edited_texts_are_nearer_than_next_ones(spark):
    found = imatch.compare(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    wide = [r for r in found if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] for r in wide]) > 0.4 and np.mean([r["near_next"] for r in wide]) < 0.1
    assert np.mean([r["near_edited"] > r["near_next"] or r["near_next"] == 1 for r in wide]) > 0.98


def test_fingerprints_of_no_terms():
    level, hashes = imatch.fingerprints(pa.array(["", "b c"], pa.large_string()), np.zeros(0, np.uint64))
    assert level.tolist() == [-1, 1] and not hashes[0].any() and hashes[1].any()
