"""Statistics of labelled answers, category policies, what-if simulation and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import patterns as P



def nearest_rank(records: DataFrame, value: str, *keys: str, share: float = 0.9) -> DataFrame:
    """(keys, value): by keys the value at place int(share * n) of all in order, counted from 0 and at most the last.

    Equal values are counted before they are put in order, so a key costs its distinct values, and no array holds them.
    """
    counts = records.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy(value))
    n = F.sum("m").over(Window.partitionBy(*keys))
    place = F.least(n - 1, F.floor(F.lit(share) * n))
    return counts.select(*keys, value, (upto > place).alias("reached")).filter("reached").groupBy(*keys).agg(F.min(value).alias(value))


def category_stats(records: DataFrame, *keys: str) -> DataFrame:
    """Counts, accuracy, Wilson's bound of the unverified answers and nearest-rank p90s, by keys."""
    good, seen = F.col("correct"), F.col("verified")
    unverified, right = F.count_if(~seen), F.count_if(good & ~seen)
    counts = records.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.count_if(good) / F.count("*"), 3).alias("accuracy"),
        F.count_if(good & seen).alias("verified_correct"),
        right.alias("unverified_correct"),
        unverified.alias("unverified_count"),
        F.round(F.try_divide(right, unverified), 4).alias("unverified_accuracy"),
        F.round(N.wilson_lower(right, unverified), 4).alias("unverified_wilson"),
    )
    tokens = nearest_rank(records, "completion_tokens", *keys)
    latency = nearest_rank(records, "latency_s", *keys)
    out = counts.join(tokens, list(keys), "left").join(latency, list(keys), "left")
    p90 = [F.coalesce("completion_tokens", F.lit(0)).alias("p90_tokens"), F.round(F.coalesce("latency_s", F.lit(0.0)), 3).alias("p90_latency")]
    return out.select(*counts.columns, *p90)


def policy(records: DataFrame, key: str = "category") -> DataFrame:
    """(category, accuracy, wilson, decision): always_escalate below an accuracy; trust_local with enough good unverified answers; else none."""
    unverified, right = F.count_if(~F.col("verified")), F.count_if(F.col("correct") & ~F.col("verified"))
    stats = records.groupBy(key).agg((F.count_if("correct") / F.count("*")).alias("accuracy"), unverified.alias("unverified"), N.wilson_lower(right, unverified).alias("wilson"))
    trust = (F.col("unverified") >= P.MIN_UNVERIFIED) & (F.col("wilson") >= P.TRUST_ACC)
    return stats.withColumn("decision", F.when(F.col("accuracy") < P.ALWAYS_ESCALATE_ACC, "always_escalate").when(trust, "trust_local").otherwise("none"))


def with_policy(records: DataFrame, decisions: DataFrame, key: str = "category") -> DataFrame:
    """Adds always and trusted of each record's category. decisions: a row for each category."""
    d = decisions.select(key, (F.col("decision") == "always_escalate").alias("always"), (F.col("decision") == "trust_local").alias("trusted"))
    false = F.lit(False)
    return records.join(d, key, "left").withColumns({c: F.coalesce(F.col(c), false) for c in ("always", "trusted")})


def slow(latency: Column) -> Column:
    """Whether a failed local attempt leaves too little time for a hosted call."""
    return F.coalesce(latency, F.lit(0.0)) > P.REACTIVE_DEADLINE_S - P.MIN_REMOTE_WINDOW_S


def slow_failure(correct: Column, verified: Column, latency: Column) -> Column:
    return ~correct & ~verified & slow(latency)


def planned(threshold: float) -> Column:
    return F.col("always") | (F.col("score") >= threshold)


def confusion_sums(threshold: float) -> list[Column]:
    p, y = planned(threshold), ~F.col("correct")
    return [F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn")]


def confusion_fields(c=F.col) -> dict[str, Column]:
    tp, fp, tn, fn = (c(x) for x in ("tp", "fp", "tn", "fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "tp": tp, "fp": fp, "tn": tn, "fn": fn, "n": tp + fp + tn + fn, "accuracy": N.share(tp + tn, tp + fp + tn + fn), "escalate_precision": N.share(tp, tp + fp), "escalate_recall": N.share(tp, tp + fn),
        "local_precision": N.share(tn, tn + fn), "local_recall": N.share(tn, tn + fp), "balanced_accuracy": F.round((rate(tp, tp + fn) + rate(tn, tn + fp)) / 2, 4),
    }


def confusion(records: DataFrame, threshold: float) -> DataFrame:
    """One row: the confusion matrix of escalating what is planned, and ratios from it. records: with_policy."""
    return records.agg(*confusion_sums(threshold)).select(*(v.alias(k) for k, v in confusion_fields().items()))


def safety_sums(threshold: float) -> list[Column]:
    p, ok, seen = planned(threshold), F.col("correct"), F.col("verified")
    reactive, late = ~p & ~seen & ~F.col("trusted"), slow_failure(ok, seen, F.col("latency_s"))
    return [
        F.count("*").alias("n"), F.count_if(~ok).alias("failures"), F.count_if(~ok & p).alias("planned_failures"), F.count_if(~ok & (p | reactive)).alias("escalated_failures"),
        F.count_if(late).alias("slow_failures"), F.count_if(late & p).alias("slow_planned"), F.count_if(~p & ~reactive & ~ok).alias("unsafe_local"),
    ]


def safety_fields(c=F.col) -> dict[str, Column]:
    return {
        "n": c("n"), "failures": c("failures"), "slow_failures": c("slow_failures"), "unsafe_local": c("unsafe_local"), "planned_recall": N.share(c("planned_failures"), c("failures"), 1.0),
        "final_recall": N.share(c("escalated_failures"), c("failures"), 1.0), "slow_planned_recall": N.share(c("slow_planned"), c("slow_failures"), 1.0), "unsafe_rate": N.share(c("unsafe_local"), c("n")),
    }


def safety(records: DataFrame, threshold: float) -> DataFrame:
    """One row: which failures are escalated up front or after a failed check, and which wrong answers stay."""
    return records.agg(*safety_sums(threshold)).select(*(v.alias(k) for k, v in safety_fields().items()))


def _parts(accuracy: float) -> dict[str, tuple[Column, Column]]:
    """What a record adds to each sum if it is escalated up front, and if it is not."""
    ok, seen = F.col("correct"), F.col("verified")
    kept = seen | F.col("trusted")
    risky, wrong = ~kept & slow(F.col("latency_s")), F.when(ok, 0.0).otherwise(1.0)
    miss = F.when(kept | risky, wrong).otherwise(1.0 - accuracy)
    one, zero = F.lit(1.0), F.lit(0.0)
    as_number = lambda b: F.when(b, one).otherwise(zero)
    late = as_number(slow_failure(ok, seen, F.col("latency_s")))
    return {
        "misses": (F.lit(1.0 - accuracy), miss), "escalations": (one, as_number(~kept)), "kept": (zero, as_number(kept)), "planned": (one, zero), "reactive": (zero, as_number(~kept)),
        "at_risk": (zero, as_number(risky)), "fallback": (zero, F.when(risky, wrong).otherwise(zero)), "slow": (late, late), "slow_planned": (late, zero),
    }


def projection_fields(size: int = 19, tokens: float = 180.0, c=F.col) -> dict[str, Column]:
    n = c("n")
    scale = F.lit(float(size)) / n
    return {
        "expected_misses": F.round(c("misses") * scale, 3), "expected_escalations": F.round(c("escalations") * scale, 2), "expected_tokens": F.round(c("escalations") * scale * tokens, 0), "local_share": F.round(c("kept") / n, 3),
        "projected_accuracy": F.round(1 - c("misses") / n, 4), "planned_escalations": F.round(c("planned") * scale, 2), "reactive_escalations": F.round(c("reactive") * scale, 2), "reactive_at_risk": F.round(c("at_risk") * scale, 2),
        "fallback_misses": F.round(c("fallback") * scale, 3), "slow_failures": c("slow").cast("long"), "slow_recall": F.round(F.coalesce(F.try_divide(c("slow_planned"), c("slow")), F.lit(1.0)), 4),
    }


def projection_sums(threshold: float, accuracy: float = 0.95) -> list[Column]:
    p = planned(threshold)
    return [F.count("*").alias("n"), *(F.sum(F.when(p, a).otherwise(b)).alias(k) for k, (a, b) in _parts(accuracy).items())]


def _projection(size: int, tokens: float) -> list[Column]:
    return [v.alias(k) for k, v in projection_fields(size, tokens).items()]


def simulate(records: DataFrame, threshold: float, size: int = 19, tokens: float = 180.0, accuracy: float = 0.95) -> DataFrame:
    """One row: misses, escalations and tokens to expect of `size` tasks. records: with_policy."""
    return records.agg(*projection_sums(threshold, accuracy)).select(F.lit(threshold).alias("threshold"), *_projection(size, tokens))


#: Steps of the score between which running sums are carried over.
STEPS = 1024


def sweep(records: DataFrame, size: int = 19, tokens: float = 180.0, accuracy: float = 0.95) -> DataFrame:
    """simulate for each score that occurs and for 0, 0.5 and the sentinel that routes none.

    Sums are made once for each score; a running sum from the top then gives what is planned, and the rest is not. So the
    work is a sort of distinct scores, not a pass over the records for each of them.
    """
    parts = _parts(accuracy)
    open_ = ~F.col("always")
    sums = [F.sum(F.when(open_, a).otherwise(0.0)).alias(f"{k}_in") for k, (a, b) in parts.items()] + [F.sum(F.when(open_, b).otherwise(0.0)).alias(f"{k}_out") for k, (a, b) in parts.items()]
    fixed = [F.sum(F.when(open_, 0.0).otherwise(a)).alias(f"{k}_always") for k, (a, b) in parts.items()]
    by_score = records.groupBy("score").agg(F.count("*").alias("m"), *sums, *fixed)
    zero = [F.lit(0.0).alias(c) for c in by_score.columns if c not in ("score", "m")]
    spark = records.sparkSession
    extra = spark.createDataFrame([(0.0,), (0.5,), (P.ROUTE_NONE,)], "score double").select("score", F.lit(0).cast("long").alias("m"), *zero)
    rows = by_score.unionByName(extra).groupBy("score").agg(*(F.sum(c).alias(c) for c in by_score.columns if c != "score"))
    # sums from the top within steps of the score, and of all steps above: only the steps, of fixed number, meet in one order
    step = F.greatest(F.lit(-1), F.least(F.lit(STEPS + STEPS // 50), F.floor(F.col("score") * STEPS)))
    rows = rows.withColumn("step", step)
    names = [c for c in rows.columns if c not in ("score", "step")]
    steps = rows.groupBy("step").agg(*(F.sum(c).alias(c) for c in names))
    above, whole = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = steps.select("step", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in names), *(F.sum(c).over(whole).alias(f"{c}_whole") for c in names))
    here = Window.partitionBy("step").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(steps), "step")  # STEPS rows and some at most
    top = lambda c: F.sum(c).over(here) + F.col(f"{c}_above")
    totals = {k: top(f"{k}_in") + F.col(f"{k}_out_whole") - top(f"{k}_out") + F.col(f"{k}_always_whole") for k in parts}
    out = rows.select("score", F.col("m_whole").alias("n"), *(v.alias(k) for k, v in totals.items()))
    return out.select(F.col("score").alias("threshold"), *_projection(size, tokens))


def pick(swept: DataFrame, most_misses: float = 1.0, least_slow: float = P.MIN_SLOW_RECALL) -> DataFrame:
    """The threshold of fewest tokens within the limits, else the one of the best recall, fewest misses and tokens; the least of equals."""
    fits = (F.col("expected_misses") <= most_misses) & (F.col("slow_recall") >= least_slow)
    order = [F.when(fits, 0).otherwise(1), F.when(fits, F.col("expected_tokens")).otherwise(-F.col("slow_recall")), F.col("expected_misses"), F.when(fits, 0.0).otherwise(F.col("expected_tokens")), "threshold"]
    return swept.orderBy(*order).limit(1)
