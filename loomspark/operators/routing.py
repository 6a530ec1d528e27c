"""Plans: which tasks go to the hosted tier, in which order the others run, and where each answer comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import patterns as P


def feature_counts(tasks: DataFrame, key: str, prompt: str, category: Column, dimension: int) -> DataFrame:
    """(key, idx, n): how often each hashed feature occurs. Features are counted before they leave the row's task."""
    each = tasks.select(key, F.explode(N.feature_texts(prompt, category)).alias("feature"))
    return each.groupBy(key, N.feature_index(F.col("feature"), dimension).alias("idx")).agg(F.count("*").alias("n"))


def scores(counts: DataFrame, key: str, weight: Column | DataFrame, bias: float) -> DataFrame:
    """(key, logit, score) from feature counts and weights: a column of idx, or a table (idx, weight)."""
    if isinstance(weight, DataFrame):
        counts, w = counts.join(weight, "idx", "left"), F.coalesce(F.col("weight"), F.lit(0.0))
    else:
        w = weight
    sums = counts.groupBy(key).agg((F.lit(bias) + F.sum(w * N.damped(F.col("n")))).alias("logit"))
    return sums.withColumn("score", N.sigmoid(F.col("logit")))


def plan(tasks: DataFrame, threshold: float, always: list[str], remote_first: bool = False, remote: bool = True) -> DataFrame:
    """Adds route: solved, remote or local. tasks: category, score, solved. Without a hosted tier all unsolved ones are local."""
    hosted = N.routed(F.col("category"), F.col("score"), threshold, F.array(*map(F.lit, always)).cast("array<string>"))
    if not remote:
        hosted = F.lit(False)
    elif remote_first:
        hosted = F.lit(True)
    return tasks.withColumn("route", F.when(F.col("solved"), "solved").when(hosted, "remote").otherwise("local"))


def admission(local: DataFrame, part: str, cost: str, idx: str, deadline: float, reserve: float) -> DataFrame:
    """Adds started and admitted: cheapest first, each only if it fits in what is left.

    As costs ascend, all after the first that does not fit do not fit either; so a running sum decides. part: the queue.
    """
    order = Window.partitionBy(part).orderBy(cost, idx)
    before = F.coalesce(F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return local.withColumn("started", before).withColumn("admitted", F.col(cost) <= F.lit(deadline) - before - F.lit(reserve))


def share_left(local: DataFrame, part: str, cost: str, idx: str, deadline: float) -> DataFrame:
    """Adds todo_left and budget: an even share of the time left, between 3 and 25 seconds."""
    order = Window.partitionBy(part).orderBy(cost, idx)
    left = F.count("*").over(Window.partitionBy(part)) - F.row_number().over(order) + 1
    before = F.coalesce(F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    budget = F.greatest(F.lit(3.0), F.least(F.lit(25.0), (F.lit(deadline) - before - 5.0) / left))
    return local.withColumn("todo_left", left).withColumn("budget", budget)


def answer_path(route: Column, verified: Column, trusted: Column, remote_ok: Column, admitted: Column) -> Column:
    """Where an answer comes from: exact, remote, local, local_backup or fallback."""
    accepted = verified | trusted
    return (
        F.when(route == "solved", "exact")
        .when((route == "remote") & remote_ok, "remote")
        .when((route == "remote") & admitted, "local_backup")
        .when(route == "remote", "fallback")
        .when(admitted & accepted, "local")
        .when(remote_ok, "remote")
        .when(admitted, "local_backup")
        .otherwise("fallback")
    )


def consensus(a: Column, b: Column, agree: Column, vote: Column) -> Column:
    """One of two answers: the one that is there, the first if they agree, else the arbiter's choice, else the second."""
    there = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    return F.when(~there(b), a).when(~there(a), b).when(agree | F.coalesce(vote == "A", F.lit(False)), a).otherwise(b)


def preferred(models: DataFrame, hints: list[str], key: str = "model", place: str = "idx", patterns: tuple[str, ...] = ()) -> DataFrame:
    """The first model of the first hint that any name contains, then of the first pattern that any matches, else the first one; a row or none."""
    tests = [F.lower(key).contains(h) for h in hints] + [F.col(key).rlike(f"(?i){p}") for p in patterns]
    rank = F.lit(len(tests))
    for k in range(len(tests) - 1, -1, -1):
        rank = F.when(tests[k], k).otherwise(rank)
    return models.withColumn("hint", rank).orderBy("hint", place).limit(1)


def distinct_model(models: DataFrame, exclude: list[str], hints: list[str], key: str = "model", place: str = "idx") -> DataFrame:
    """Another model than those excluded, by hints and then by names of larger ones."""
    return preferred(models.filter(~F.col(key).isin(exclude)) if exclude else models, [*hints, *P.LARGE_HINTS], key, place)


def configured_model(models: DataFrame, configured: str, hints: list[str], last: bool = False, key: str = "model", place: str = "idx") -> DataFrame:
    """The configured model, which must be among the models; without one the first of the first hint, else the first or last of all."""
    if configured:
        chosen = models.filter(F.col(key) == configured)
        if chosen.isEmpty():
            raise ValueError("the configured model is not an allowed one")
        return chosen.limit(1)
    hit = F.lit(False)
    for h in hints:
        hit = hit | F.col(key).rlike(f"(?i){h}")
    if last and models.filter(hit).isEmpty():
        return models.orderBy(F.col(place).desc()).limit(1)
    return preferred(models, [], key, place, tuple(hints)).drop("hint")
