"""Toxic spans by a linear-chain conditional random field of two labels (other, toxic), and document scores from it.

Labels are given for documents, so tokens are labelled from them: in a toxic document a word is toxic if it or a
beginning of it is found in documents of which nearly all are toxic; in other documents no word is. The field is fitted to
these labels: weights of words and word beginnings, a bias, and weights of label pairs.

Most words have no weighted feature. A run of them multiplies the messages by one power of a fixed 2 x 2 matrix, so
forward and backward passes visit only words with features and give the same marginals as over all words.

A document's score is a logistic function of its expected number of toxic words and its greatest marginal. Runs of words that
are more likely toxic than not are returned as offending spans of characters.

The fit reads texts on the executors only: they count features, and give the places of words with features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each class that the fit uses at most, in the order of a hash of the id.
MOST_ROWS = 4000
#: Lengths of word beginnings, documents that must have a feature, the share of them that must be toxic (lower bound).
PREFIXES, LEAST_DOCS, SURE = (3, 4, 5, 6, 7), 5, 0.55
STEPS, RATE, DECAY = 80, 0.15, 1e-3
MARGINS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»‘’“”–—…¡¿"


def features(word: str) -> list[str]:
    """The word itself ('=') and its beginnings, lower-cased and without the signs around it."""
    w = word.lower().strip(MARGINS)
    return ["=" + w, *(w[:k] for k in PREFIXES if len(w) >= k)] if w else []


@dataclass
class Field:
    """Weights of a fitted field. pair: scores of (other, toxic), (toxic, other), (toxic, toxic); (other, other) has 0."""

    weights: dict[str, float]
    bias: float
    pair: tuple[float, float, float]
    doc: tuple[float, float, float] = (0.0, 1.0, 1.0)

    def score(self, word: str) -> float | None:
        """The toxic label's score of a word; None: it has no weighted feature."""
        found = [w for f in features(word) if (w := self.weights.get(f)) is not None]
        return sum(found) + self.bias if found else None


def _steps(bias: float, pair: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair potentials A, and eigenvalues and vectors of a featureless word's matrix A diag(1, e^bias)."""
    a = np.exp(np.array([[0.0, pair[0]], [pair[1], pair[2]]]))
    values, vectors = np.linalg.eig(a * np.exp(np.array([0.0, bias])))
    order = np.argsort(-values.real)
    return a, values.real[order], vectors.real[:, order]


def _power(values: np.ndarray, vectors: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers n of the matrix, divided by its greatest eigenvalue to n; and the logarithm of that."""
    ratio = np.power(values[1] / values[0], n)
    inverse = np.linalg.inv(vectors)
    one, two = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1])
    return one[None] + ratio[:, None, None] * two[None], n * math.log(values[0])


def marginals(emit: np.ndarray, place: np.ndarray, offs: np.ndarray, lengths: np.ndarray, bias: float, pair: tuple[float, float, float], backward: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each featured word is toxic, and log Z of each text.

    emit: toxic scores of featured words, text after text by offs; place: their places among the lengths words of a text.
    """
    a, values, vectors = _steps(bias, pair)
    n, counts = len(offs) - 1, np.diff(offs)
    order = np.argsort(-counts, kind="stable")
    # the word before the first one has label `other`, so a first word's pair is scored like any other's
    forward = np.zeros((n, 2))
    forward[:, 0] = 1
    log_z = np.zeros(n)
    last = np.full(n, -1, np.int64)
    top = np.maximum(emit, 0)
    keep = np.zeros((len(emit), 2))
    for k in range(int(counts.max(initial=0))):
        who = order[: np.searchsorted(-counts[order], -k, "left")]
        at = offs[who] + k
        step, grown = _power(values, vectors, place[at] - last[who] - 1)
        f = np.einsum("ni,nij->nj", forward[who], step) @ a
        f *= np.exp(np.stack([-top[at], emit[at] - top[at]], axis=1))
        total = f.sum(axis=1)
        forward[who] = f / total[:, None]
        log_z[who] += grown + np.log(total) + top[at]
        keep[at] = forward[who]
        last[who] = place[at]
    step, grown = _power(values, vectors, lengths - last - 1)
    total = np.einsum("ni,nij->n", forward, step)
    log_z += grown + np.log(total)
    if not backward:
        return np.zeros(0), log_z
    back = step.sum(axis=2)
    out = np.zeros(len(emit))
    for k in range(int(counts.max(initial=0)) - 1, -1, -1):
        who = order[: np.searchsorted(-counts[order], -k, "left")]
        at = offs[who] + k
        both = keep[at] * back[who]
        out[at] = both[:, 1] / both.sum(axis=1)
        before = np.where(k > 0, place[np.maximum(at - 1, 0)], -1)
        b = back[who] * np.exp(np.stack([-top[at], emit[at] - top[at]], axis=1))
        step, _ = _power(values, vectors, place[at] - before - 1)
        b = np.einsum("nij,nj->ni", step, b @ a.T)
        back[who] = b / b.sum(axis=1)[:, None]
    return out, log_z


def sparse(texts: pa.Array, table: dict[str, int]) -> tuple[list[list[int]], list[int], list[list[list[int]]]]:
    """Of each text the places of its words with features in table, its number of words, and the features of those words."""
    codes, words, distinct = common.words_of(texts)
    rows = [[table[f] for f in features(w) if f in table] for w in distinct.to_pylist()]
    has = np.array([bool(r) for r in rows], bool) if rows else np.zeros(0, bool)
    at = np.flatnonzero(has[codes]) if len(codes) else np.zeros(0, np.int64)
    cuts = np.searchsorted(at, words).tolist()
    found = (at - words[np.searchsorted(words, at, "right") - 1]).tolist()
    own = [rows[c] for c in codes[at].tolist()]
    return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])], np.diff(words).tolist(), [own[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _lower_bound(k: Column, n: Column) -> Column:
    """Wilson's lower bound of a share."""
    z = 1.96
    return (k / n + z * z / (2 * n) - z * F.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit(names: list[str], documents: list[tuple[int, list[int], int, list[list[int]]]], weight: tuple[float, float] = (1.0, 1.0)) -> Field:
    """Fits a field to labelled documents (class, places, words, features of the word at each place). names: of the features; weight: of a text of class 0 and 1 in the document score."""
    patterns: dict[tuple[int, ...], int] = {}
    word = np.array([patterns.setdefault(tuple(f), len(patterns)) for d in documents for f in d[3]], np.int64)
    rows = [list(f) for f in patterns]
    place = np.array([p for d in documents for p in d[1]], np.int64)
    offs = np.concatenate([[0], np.cumsum([len(d[1]) for d in documents])]).astype(np.int64)
    lengths, toxic = np.array([d[2] for d in documents], np.int64), [d[0] for d in documents]
    table = {f: i for i, f in enumerate(names)}
    owner = np.repeat(np.arange(len(documents)), np.diff(offs))
    y = np.array(toxic, np.int64)
    label = y[owner] if len(owner) else np.zeros(0, np.int64)
    pick = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([i for r in rows for i in r], np.int64)
    w, shared = np.zeros(len(table)), np.array([-4.0, -3.0, -0.5, -1.0])  # bias, and the three pairs
    first = np.ones(len(word), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) if len(word) else first[1:]
    before = np.zeros(len(word), np.int64)
    before[1:] = np.where(first[1:], 0, label[:-1])
    ends = np.zeros(len(word), bool)  # toxic words with another label behind them
    if len(word):
        nxt = np.append(np.where(first[1:], 0, label[1:]), 0)
        ends = (label == 1) & (nxt == 0) & (place + 1 < lengths[owner])
    counts = np.array([label.sum(), ((label == 1) & (before == 0)).sum(), ends.sum(), ((label == 1) & (before == 1)).sum()], float)
    n = max(1.0, float(len(documents)))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    own = np.zeros(len(rows))
    for step in range(1, STEPS + 1):
        own = np.bincount(pick, w[feature], len(rows)) if len(feature) else np.zeros(len(rows))
        p, z = marginals(own[word] + shared[0], place, offs, lengths, shared[0], tuple(shared[1:]))
        by_word = np.bincount(word, label - p, len(rows)) if len(word) else np.zeros(len(rows))
        grad = np.bincount(feature, by_word[pick], len(w)) if len(feature) else np.zeros(len(w))
        slope = np.zeros(4)
        for k in range(4):  # expected counts of what all texts share, by a small difference of log Z
            moved = shared.copy()
            moved[k] += 1e-4
            slope[k] = counts[k] - (marginals(own[word] + moved[0], place, offs, lengths, moved[0], tuple(moved[1:]), backward=False)[1].sum() - z.sum()) / 1e-4
        g = np.concatenate([grad - DECAY * n * w, slope]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, shared = w + change[: len(w)], np.clip(shared + change[len(w) :], -12, 6)
    field = Field({f: float(w[i]) for f, i in table.items()}, float(shared[0]), tuple(float(x) for x in shared[1:]))
    own = np.bincount(pick, w[feature], len(rows)) if len(feature) else np.zeros(len(rows))
    p, _ = marginals(own[word] + shared[0], place, offs, lengths, shared[0], tuple(shared[1:]))
    expected, most = _summary(p, offs)
    x, c = np.stack([np.ones(len(y)), np.log1p(expected), most], axis=1), np.where(y == 1, weight[1], weight[0])
    b = np.zeros(3)
    for _ in range(30):  # Newton steps of a logistic regression
        q = 1 / (1 + np.exp(-x @ b))
        h = (x * (c * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        b += np.linalg.solve(h, x.T @ (c * (y - q)) - 1e-2 * b)
    field.doc = tuple(float(t) for t in b)
    return field


def _summary(p: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    expected = np.diff(np.concatenate([[0.0], np.cumsum(p)])[offs])
    most = np.zeros(len(offs) - 1)
    full = np.flatnonzero(np.diff(offs) > 0)
    if len(full):
        most[full] = np.maximum.reduceat(p, offs[full])
    return np.maximum(expected, 0), most


def tag(texts: pa.Array, field: Field) -> tuple[np.ndarray, list[list[int]]]:
    """Score of each text, and the places of its words that are more likely toxic than not."""
    codes, words, distinct = common.words_of(texts)
    scores = [field.score(w) for w in distinct.to_pylist()]
    has = np.array([s is not None for s in scores], bool)
    each = np.array([0.0 if s is None else s for s in scores], float)
    at = np.flatnonzero(has[codes]) if len(codes) else np.zeros(0, np.int64)
    offs = np.searchsorted(at, words)
    owner = np.searchsorted(words, at, "right") - 1
    p, _ = marginals(each[codes[at]] if len(at) else np.zeros(0), at - words[owner], offs, np.diff(words), field.bias, field.pair)
    expected, most = _summary(p, offs)
    score = 1 / (1 + np.exp(-(field.doc[0] + field.doc[1] * np.log1p(expected) + field.doc[2] * most)))
    found = at - words[owner]
    spans = [found[a:b][p[a:b] >= 0.5].tolist() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
    return score, spans


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: the checksum of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Field:
    """Fits a field to at most most_rows labelled documents of each class that are not held out.

    Counts of the classes are taken from all labelled rows that may be learnt from. Without documents of both classes every
    text gets the share of toxic labels (one half without any). Of several labels of one doc_id the greatest counts.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = min(max(counts.get(1, 0) / sum(counts.values()), 1e-3), 1 - 1e-3) if counts else 0.5
    constant = Field({}, -5.0, (-3.0, 0.0, 0.0), (math.log(share / (1 - share)), 0.0, 0.0))
    if len(counts) < 2:
        return constant
    some = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 * most_rows ids
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("toxic", "text")
    # a text that occurs again teaches nothing new
    rows = common.materialize(rows.withColumn("key", F.sha2("text", 256)).dropDuplicates(["toxic", "key"]), "labelled")
    used = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(used) < 2:
        return constant
    weight = tuple(counts[y] / used[y] for y in (0, 1))

    def count(batches):
        for batch in common.slices(batches, "text"):
            seen = Counter(), Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[y].update({f for w in set(text.split()) for f in features(w)})
            found = [(f, y, n) for y in (0, 1) for f, n in seen[y].items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["feature", "toxic", "n"])

    seen = rows.select("text", "toxic").mapInArrow(count, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("m"))
    sure = seen.filter((F.col("k") >= LEAST_DOCS) & (_lower_bound(F.col("k") * weight[1], F.col("k") * weight[1] + F.col("m") * weight[0]) >= SURE))
    names = sorted(r["feature"] for r in sure.select("feature").collect())  # of at most most_rows toxic texts, and only those that nearly none else has
    table = {f: i for i, f in enumerate(names)}

    def places(batches):
        for batch in common.slices(batches, "text"):
            at, n, own = sparse(batch.column("text"), table)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.list_(pa.int32())))], ["key", "toxic", "places", "words", "features"])

    found = rows.mapInArrow(places, "key string, toxic int, places array<int>, words long, features array<array<int>>").collect()  # no texts
    common.discard(rows)
    return fit(names, [(r["toxic"], r["places"], r["words"], r["features"]) for r in sorted(found, key=lambda r: (r["key"], r["toxic"]))], weight)


_WORD = re.compile("[^ \t-\r]+")


def _characters(text: str, places: list[int]) -> list[dict[str, int]]:
    """Spans of characters (begin, end) of the runs of words at these places."""
    wanted, out, last = set(places), [], -2
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            if k == last + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"begin": m.start(), "end": m.end()})
            last = k
    return out


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), toxic_words (places of words, counted from 0) and toxic_spans (characters that runs of them take).

    Only the text counts. Null and empty texts have no words and get the score of a text without toxic words. Texts of
    any length are read whole; equal texts score alike; other columns are ignored; no rows give no rows.
    """
    shared = common.tune(docs).sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in common.slices(batches, "text"):
            texts = common.as_text(batch.column("text"))
            s, spans = tag(texts, shared.value)
            characters = [_characters(texts[k].as_py(), w) if w else [] for k, w in enumerate(spans)]
            values = [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.int64())), pa.array(characters, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *values], ["doc_id", "score", "predicted", "toxic_words", "toxic_spans"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, toxic_words array<long>, toxic_spans array<struct<begin:long,end:long>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_words", "toxic_spans")
