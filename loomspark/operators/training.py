"""Full-batch logistic regression on hashed features with Adam: gradients are sums over the table, steps are on the driver."""

from __future__ import annotations

import json
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources.shared import dropped, written


#: Numbers of the examples that one packed row holds, and rows of gradients that are added up before they go to the driver.
PACKED, ADDED = 1 << 20, 64


#: A packed row as bytes, which Spark copies whole where it would go through arrays number by number, in every epoch.
EXAMPLES = "sizes binary, at binary, values binary, x binary, label binary"


def _least(n: int) -> np.dtype:
    """The narrowest type for places among n."""
    return np.min_scalar_type(max(n - 1, 0))


def _packed(batches, dimension: int):
    """Examples (at, x, label) as few rows of bytes: a row's examples behind one another. x is a place among its distinct values, which are few where features are counts."""
    import pyarrow as pa

    def row(held):
        sizes, at, x, y = (np.concatenate(c) for c in zip(*held))
        values, place = np.unique(x, return_inverse=True)
        columns = (sizes, at.astype(_least(dimension)), values, place.astype(_least(len(values))), y)
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["sizes", "at", "values", "x", "label"])

    held, n = [], 0
    for b in batches:
        at, x = b.column("at"), b.column("x")
        held.append((np.asarray(at.value_lengths(), dtype=np.int32), np.asarray(at.flatten()), np.asarray(x.flatten()), np.asarray(b.column("label"))))
        n += len(held[-1][1])
        if n >= PACKED:
            yield row(held)
            held, n = [], 0
    if held:
        yield row(held)


def _arrays(batch, k: int, dimension: int):
    """(sizes, idx, value, label) of the examples of a packed row."""
    read = lambda c, kind: np.frombuffer(batch.column(c)[k].as_buffer(), kind)
    values = read("values", np.float64)
    return read("sizes", np.int32), read("at", _least(dimension)), values[read("x", _least(len(values)))], read("label", np.float64)


def _gradient(examples, w: np.ndarray, heavy: float) -> np.ndarray:
    """Sums over the examples, of which each has a feature at least; the bias last."""
    sizes, idx, value, y = examples
    logit = w[-1] + np.add.reduceat(w[idx] * value, np.cumsum(sizes) - sizes)
    r = np.where(y == 1, heavy, 1.0) * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
    return np.append(np.bincount(idx, np.repeat(r, sizes) * value, len(w) - 1), r.sum())


def _adam(gradient, dimension: int, epochs: int, rate: float, l2: float, norm: float) -> np.ndarray:
    """Weights after all epochs; gradient: sums for weights."""
    w, m, v = np.zeros(dimension + 1), np.zeros(dimension + 1), np.zeros(dimension + 1)
    for t in range(1, epochs + 1):
        g = gradient(w) / norm
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(features: DataFrame, labels: DataFrame, dimension: int = 2048, epochs: int = 350, rate: float = 0.04, l2: float = 0.0002) -> tuple[float, dict[int, float]]:
    """(bias, weights by index). features: id, idx, value; labels: id, label (1: escalate).

    Each epoch is one job over examples that are written once, packed in few rows: every task gives one vector of
    `dimension` sums, and where there are many tasks ADDED vectors are one before they come to the driver. Examples never
    leave the executors, and every size goes the same way. The rarer class weighs as much as the other; the bias has no
    penalty; weights are rounded and tiny ones dropped.
    """
    import pyarrow as pa

    positives, count = labels.agg(F.sum("label"), F.count("*")).first()
    if not positives or positives == count:
        raise ValueError("both labels are needed")
    heavy = (count - positives) / positives
    norm = (count - positives) + positives * heavy
    rows = features.groupBy("id").agg(F.collect_list("idx").alias("at"), F.collect_list("value").alias("x")).join(labels, "id").select("at", "x", F.col("label").cast("double").alias("label"))
    packed = written(rows.mapInArrow(lambda batches: _packed(batches, dimension), EXAMPLES), "examples")
    tasks = packed.rdd.getNumPartitions()

    def vector(g: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([g.tolist()], pa.list_(pa.float64()))], ["g"])

    def added(batches):
        yield vector(sum((np.asarray(v.values) for b in batches for v in b.column("g")), np.zeros(dimension + 1)))

    def epoch(w: np.ndarray) -> np.ndarray:
        def sums(batches):
            yield vector(sum((_gradient(_arrays(b, k, dimension), w, heavy) for b in batches for k in range(b.num_rows)), np.zeros(dimension + 1)))

        vectors, left = packed.mapInArrow(sums, "g array<double>"), tasks
        while left > ADDED:
            left = -(-left // ADDED)
            vectors = vectors.repartition(left).mapInArrow(added, "g array<double>")
        return np.sum([r["g"] for r in vectors.collect()], axis=0)

    w = _adam(epoch, dimension, epochs, rate, l2, norm)
    dropped(packed)
    return round(float(w[-1]), 10), {i: round(float(x), 10) for i, x in enumerate(w[:-1]) if abs(x) >= 1e-9}


def features(tasks: DataFrame, dimension: int = 2048) -> DataFrame:
    """(id, idx, value) of tasks (id, prompt, category)."""
    from .routing import feature_counts

    return feature_counts(tasks, "id", "prompt", F.col("category"), dimension).select("id", "idx", N.damped(F.col("n")).alias("value"))


def profile_digest(profile: dict) -> str:
    """SHA-256 of a profile as compact sorted JSON, without the field that holds the digest."""
    body = {k: v for k, v in profile.items() if k != "provenance"}
    if isinstance(p := profile.get("provenance"), dict):
        body["provenance"] = {k: v for k, v in p.items() if k != "profileSemanticSha256"}
    return hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
