"""Hashing, scores, costs and bounds as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import found, text_or_empty


def fnv1a_32(x: Column) -> Column:
    """The unsigned 32-bit FNV-1a hash of a text's UTF-8 bytes."""
    digits = F.hex(F.encode(x, "UTF-8"))
    places = F.filter(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: i <= F.length(digits))
    each = F.transform(F.when(F.length(digits) > 0, places).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(each, F.lit(P.FNV_START).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(P.FNV_PRIME)).bitwiseAND(F.lit(P.FNV_MASK)))


def feature_texts(prompt: Column | str, category: Column) -> Column:
    """The features of a prompt as texts: category, length, tokens, pairs of tokens and shapes."""
    raw = text_or_empty(prompt)
    tokens = F.slice(F.regexp_extract_all(F.lower(raw), F.lit(P.FEATURE_TOKEN), F.lit(0)), 1, P.FEATURE_TOKENS)
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("b:"), a, F.lit("|"), b))
    shapes = F.array(F.when(raw.rlike("[0-9]"), "shape:digits"), F.when(raw.rlike("(?i)" + P.CODE_HINT), "shape:code"), F.when(raw.contains("?"), "shape:question"))
    head = F.array(F.concat(F.lit("category:"), category), F.concat(F.lit("length:"), F.least(F.lit(8), F.floor(F.length(raw) / 80)).cast("string")))
    return F.concat(head, F.transform(tokens, lambda t: F.concat(F.lit("u:"), t)), pairs, F.filter(shapes, lambda s: s.isNotNull()))


def feature_index(feature: Column, dimension: int) -> Column:
    return F.pmod(fnv1a_32(feature), F.lit(dimension)).cast("int")


def damped(count: Column) -> Column:
    return 1 + F.ln(count.cast("double"))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))


def wilson_lower(successes: Column, total: Column, z: float = P.WILSON_Z) -> Column:
    """Lower end of Wilson's interval for a share; 0 without observations."""
    n = total.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    bound = (p + z * z / 2 / n - z * F.sqrt(p * (1 - p) / n + z * z / 4 / (n * n))) / (1 + z * z / n)
    return F.when(total > 0, bound).otherwise(0.0)


def nearest_rank(values: Column, share: float = 0.9) -> Column:
    """The element at place int(share * n), counted from 0 and at most the last, of an array in order; null if empty."""
    n = F.size(values)
    place = F.least(n - 1, F.floor(F.lit(share) * n).cast("int"))
    return F.when(n > 0, F.get(F.array_sort(values), place))


def by_name(values: Mapping[str, float], key: Column, other: float) -> Column:
    """A constant by name, as a map lookup."""
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(float(other)))


def local_cost(prompt: Column | str, category: Column, tok_s: Column, measured_tokens: Column, measured_latency: Column) -> Column:
    """Estimated seconds of a local answer; measured values replace caps and retry headroom, and are a floor for the time."""
    speed = F.greatest(F.lit(0.5), tok_s.cast("double"))
    read = F.greatest(F.lit(8.0), F.length(text_or_empty(prompt)) / 4.0) / (speed * P.PREFILL_RATIO)
    known = F.coalesce((measured_tokens > 0) & ~F.isnan(measured_tokens.cast("double")), F.lit(False))
    tokens = F.when(known, measured_tokens.cast("double")).otherwise(by_name(P.LOCAL_CAPS, category, P.DEFAULT_CAP) * by_name(P.RETRY_HEADROOM, category, P.DEFAULT_HEADROOM))
    return F.greatest(read + tokens / speed + P.TASK_OVERHEAD_S, F.coalesce(measured_latency.cast("double"), F.lit(0.0)))


def routed(category: Column, score: Column, threshold: float | Column, always: Column) -> Column:
    """Whether a task goes to the hosted tier: its category always does, or its score reaches the threshold."""
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return F.array_contains(always, category) | F.coalesce(score >= limit, F.lit(False))


def resolved_threshold(override: Column, configured: Column) -> Column:
    """The first of override, configured and 0.5 that lies in [0, 1.01]."""
    ok = lambda x: F.when((x >= 0) & (x <= P.ROUTE_NONE) & ~F.isnan(x), x)
    return F.coalesce(ok(override.try_cast("double")), ok(configured.try_cast("double")), F.lit(0.5))


def remaining_budget(timeout: Column, started: Column, cap: Column, now: Column, deadline: Column) -> Column:
    """Seconds that a hosted call may take; null if under one is left."""
    left = F.least(timeout, started + cap - now, deadline - now - 2.0)
    return F.when(left >= 1.0, left)


def compact_number(x: Column) -> Column:
    """Whole numbers without a point; others rounded to six places and given with six significant digits, with an exponent below -4 and from 6 on."""
    y = F.round(x, 6)
    # the exponent after rounding to six digits says how many places are left; worked out once for each number
    power = lambda v: F.substring_index(v["long"], "e", -1).cast("int")
    plain = lambda v: F.call_function("format_string", F.concat(F.lit("%."), (5 - power(v)).cast("string"), F.lit("f")), v["y"])
    bare = lambda t: F.regexp_replace(t, r"(\.\d*?[1-9])0+(?=e|$)|\.0+(?=e|$)", "$1")
    told = F.transform(F.array(F.struct(y.alias("y"), F.format_string("%.5e", y).alias("long"))), lambda v: F.when(power(v).between(-4, 5), plain(v)).otherwise(v["long"]))
    return F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(bare(F.get(told, F.lit(0))))


def usage_tokens(usage: Column) -> Column:
    """struct(tokens, source) of a usage object (JSON): the provider's total, else the parts' sum, else unknown."""
    of = lambda k: F.when(F.get_json_object(usage, f"$.{k}").try_cast("long") >= 0, F.get_json_object(usage, f"$.{k}").try_cast("long"))
    total, parts = of("total_tokens"), of("prompt_tokens") + of("completion_tokens")
    source = F.when(total.isNotNull(), "provider").when(parts.isNotNull(), "derived").otherwise("unknown")
    return F.struct(F.coalesce(total, parts).alias("tokens"), source.alias("source"))


def poisoned_sum(x: Column) -> Column:
    """A sum that is unknown if any of its values is; an aggregate."""
    return F.when(F.count_if(x.isNull()) == 0, F.coalesce(F.sum(x), F.lit(0)))


def share(part: Column, whole: Column, empty: float = 0.0, digits: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty)), digits)


def finite(x: Column) -> Column:
    """Whether a number is there and finite."""
    d = x.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))


def positive(x: Column) -> Column:
    return finite(x) & F.coalesce(x > 0, F.lit(False))


def ratio(x: Column) -> Column:
    """Whether a number lies between 0 and 1."""
    return finite(x) & F.coalesce(x.between(0, 1), F.lit(False))
