"""Payloads of providers and requests as columns: texts, usage, options, limits and reasons of rejection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as T
from . import udfs as U


def usage_number(value: Column) -> Column:
    """A count of tokens: rounded, null unless it is finite and not negative."""
    return F.when((value >= 0) & (value < float("inf")) & ~F.isnan(value), F.floor(value + 0.5).cast("long"))


def usage(data: Column) -> Column:
    """struct(prompt, completion, reasoning, total) of a response's usage; reasoning tokens from the details, else beside them."""
    # as numbers of a schema, so that quoted ones are none
    u = F.from_json(data, f"usage struct<{', '.join(f'{c}_tokens:double' for c in ('prompt', 'completion', 'reasoning', 'total'))}, completion_tokens_details:struct<reasoning_tokens:double>>")["usage"]
    of = lambda name: usage_number(u[name])
    reasoning = F.coalesce(usage_number(u["completion_tokens_details"]["reasoning_tokens"]), of("reasoning_tokens"))
    return F.struct(of("prompt_tokens").alias("prompt"), of("completion_tokens").alias("completion"), reasoning.alias("reasoning"), of("total_tokens").alias("total"))


def chat_text(data: Column) -> Column:
    """The first choice's text, trimmed and in NFKC; null if there is none."""
    text = T.strip(F.get_json_object(data, "$.choices[0].message.content"))
    return U.nfkc(F.when(text != "", text))


# Options of a request that may be passed on.
EXTRA_KEYS = ("reasoning_effort",)


def extra_options(data: Column, keys: tuple[str, ...] = EXTRA_KEYS) -> Column:
    """The options of a JSON object that may be passed on, as a map of texts; empty for anything else."""
    return F.coalesce(F.map_filter(F.from_json(data, "map<string,string>"), lambda k, v: k.isin(*keys)), F.create_map().cast("map<string,string>"))


def positive_int(value: Column, otherwise: int, most: int = 1000) -> Column:
    """The whole number with which a text begins, at most `most`; the default unless it is positive."""
    n = F.regexp_extract(T.strip(T.text_or_empty(value)), r"^([+-]?\d+)", 1).try_cast("long")
    return F.when(n > 0, F.least(n, F.lit(most))).otherwise(otherwise)


def phase_timeouts(remaining: Column) -> Column:
    """struct(connect, read): a fifth for the connection, between 0.25 and 3 seconds, and nearly all of the rest for the answer."""
    connect = F.least(F.lit(3.0), F.greatest(F.lit(0.25), remaining * 0.20))
    return F.struct(connect.alias("connect"), F.greatest(F.lit(0.25), remaining - connect - 0.25).alias("read"))


# Limits of a request, and how close recomputed scores must be.
MOST_PROMPT, MOST_BODY, MOST_REVISION, MOST_LATENCY_MS, SCORE_EPSILON = 8000, 24_000, 128, 60_000, 1e-12
LABELS = ("local_ok", "escalate")


def rejected(content_type: Column, body: Column) -> Column:
    """Why a request is refused, as a status: 415 no JSON, 413 too large, 400 not valid; null: it is accepted."""
    parsed = F.from_json(body, "prompt string, category string, localDecision struct<label:string,pEscalate:double,threshold:double,latencyMs:double,revision:string>", {"mode": "PERMISSIVE"})
    d, within = parsed["localDecision"], lambda x, low, high: F.coalesce(x.between(low, high), F.lit(False))
    prompt, revision = T.strip(parsed["prompt"]), d["revision"]
    valid = (
        F.coalesce((prompt != "") & (F.length(prompt) <= MOST_PROMPT), F.lit(False)) & F.coalesce(parsed["category"].isin(*P.CATEGORIES) & d["label"].isin(*LABELS), F.lit(False))
        & within(d["pEscalate"], 0, 1) & within(d["threshold"], 0, P.ROUTE_NONE) & within(d["latencyMs"], 0, MOST_LATENCY_MS) & F.coalesce((T.strip(revision) != "") & (F.length(revision) <= MOST_REVISION), F.lit(False))
    )
    return F.when(~F.coalesce(F.contains(F.lower(content_type), F.lit("application/json")), F.lit(False)), 415).when(F.octet_length(body) > MOST_BODY, 413).when(~valid, 400)


def decision_matches(sent: Column, own: Column) -> Column:
    """Whether a decision (category, revision, label, pEscalate, threshold) is the recomputed one."""
    same = lambda c: F.coalesce(sent[c] == own[c], F.lit(False))
    near = lambda c: F.coalesce(F.abs(sent[c] - own[c]) <= SCORE_EPSILON, F.lit(False))
    return same("category") & same("revision") & same("label") & near("pEscalate") & near("threshold")
