"""A join of similar texts with an exact index, and leaders of groups by rounds over it.

Two texts are similar if sequence and token similarity both reach `least`, or the sequence similarity alone a higher bound
(functions.udfs.template_similarity). Either way they share an element of a prefix: of n tokens those of a Jaccard join; of
the 3-grams so many that as many edits as two such texts can differ by would not touch them all. Rare elements come first
in every prefix, so frequent wording is hardly ever a reason to compare two texts.
"""

from __future__ import annotations

import functools
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import patterns as P
from ..functions import udfs as U
from ..sources.shared import dropped, written

#: Classes of characters that are counted to bound how many of two texts can match.
LETTERS = 48
#: Rounds that settle what only leaders of a list decide, before the links of the rest are all found.
STAR_ROUNDS = 4
#: If more than this share of the texts is left after a round, another would not pay.
STAR_PROGRESS = 0.8

_TOKEN = re.compile(r"<[^>]+>|[a-z0-9_]+")


def edits(size: int, least: float) -> int:
    """How many characters a text of this size and a similar one can have in which they don't match: 2 M >= least (a + b), and M is at most the size."""
    return math.floor(2 * size * (1 - least) / least + 1e-9)


def elements(text: str, least: float) -> list[tuple[str, int]]:
    """(element, length of the prefix of its kind) of a text; kinds are told apart by the element's first character."""
    tokens = sorted(set(_TOKEN.findall(text)))
    out = [("t" + t, len(tokens) - math.ceil(least * len(tokens) - 1e-9) + 1) for t in tokens]
    # without tokens the sequence alone decides, from `least` on
    for kind, q, bound in [("g", 3, max(least, P.SEQUENCE_ESCAPE))] + ([("s", 2, least)] if not tokens else []):
        count: dict[str, int] = {}
        grams = []
        for k in range(len(text) - q + 1):
            g = text[k : k + q]
            count[g] = count.get(g, 0) + 1
            grams.append(f"{kind}{count[g]}:{g}")  # repeated ones count
        touched = q * edits(len(text), bound)
        out += [(g, touched + 1) for g in grams]
        if len(grams) <= touched:  # edits may touch all of it: two such texts meet here
            out.append((kind, touched + 2))
    return out


def index(texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, entries) of distinct texts (scope, text), both written. nodes: id (ascending by scope and text), scope, text, n, letters, tokens; entries: scope, element, id, n and the sequence similarity that a pair which only meets in this kind of element needs."""

    def spread(batches):
        for batch in batches:
            ids, scopes, found, sizes, prefix = [], [], [], [], []
            for i, s, t in zip(*(batch.column(c).to_pylist() for c in ("id", "scope", "text"))):
                listed = elements(t, least)
                ids += [i] * len(listed)
                scopes += [s] * len(listed)
                sizes += [len(t)] * len(listed)
                found += [e for e, _ in listed]
                prefix += [p for _, p in listed]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scopes, pa.string()), pa.array(found, pa.string()), pa.array(sizes, pa.int32()), pa.array(prefix, pa.int32())], ["id", "scope", "element", "n", "prefix"])

    tokens = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(_TOKEN.pattern), F.lit(0))), lambda t: F.xxhash64(t))
    ordered = texts.select("scope", "text").distinct().repartitionByRange("scope", "text").sortWithinPartitions("scope", "text")
    nodes = written(ordered.withColumn("id", F.monotonically_increasing_id()).withColumns({"n": F.length("text"), "letters": letter_counts("text"), "tokens": tokens}), "nodes")
    every = nodes.select("id", "scope", "text").mapInArrow(spread, "id long, scope string, element string, n int, prefix int")
    keyed = every.select("id", "scope", F.xxhash64("element").alias("element"), F.left("element", F.lit(1)).alias("kind"), "n", "prefix")
    often = keyed.groupBy("scope", "element").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("id", "kind").orderBy("times", "element"))
    entries = keyed.join(often, ["scope", "element"]).withColumn("place", place).filter(F.col("place") <= F.col("prefix"))
    needs = F.when(F.col("kind") == "g", F.lit(float(max(least, P.SEQUENCE_ESCAPE)))).otherwise(F.lit(float(least)))
    return nodes, written(entries.select("scope", "element", "id", "n", needs.alias("needs")), "entries")


@F.pandas_udf(K.ArrayType(K.ShortType()))
def letter_counts(x: pd.Series) -> pd.Series:
    """How many characters a text has of each of LETTERS classes."""

    def one(text: str) -> list[int]:
        out = [0] * LETTERS
        for c in text:
            out[ord(c) % LETTERS] += 1
        return [min(n, 32767) for n in out]

    return x.map(one)


def candidates(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """(a, b, needs) of entries that share an element and whose lengths allow the similarity; ordered: only b before a."""
    l, r = (x.select("scope", "element", F.col("id").alias(i), F.col("n").alias(n), *more) for x, i, n, more in ((left, "a", "an", ["needs"]), (right, "b", "bn", [])))
    met = l.join(r, ["scope", "element"]).filter(2 * F.least("an", "bn") >= F.col("needs") * (F.col("an") + F.col("bn")))  # no more characters match than the shorter text has
    met = met.filter("b < a") if ordered else met.filter("a <> b")
    return met.groupBy("a", "b").agg(F.min("needs").alias("needs"))


def similar(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs that are similar. Tokens say what sequence similarity a pair needs, lengths and counts of letters whether it can have it; these turn away most others in the JVM, and Python compares the rest."""
    side = lambda i, *columns: nodes.select(F.col("id").alias(i), *(F.col(c).alias(f"{i}_{c}") for c in columns))
    known = ("letters", "tokens", "n")
    met = pairs.join(side("a", *known), "a").join(side("b", *known), "b")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    overlap = F.coalesce(F.try_divide(both.cast("double"), F.size("a_tokens") + F.size("b_tokens") - both), F.lit(1.0))
    met = met.withColumn("needs", F.when(overlap >= least, F.col("needs")).otherwise(F.lit(float(max(least, P.SEQUENCE_ESCAPE)))))
    met = met.filter(2 * F.least("a_n", "b_n") >= F.col("needs") * (F.col("a_n") + F.col("b_n")))
    shared = F.aggregate(F.zip_with("a_letters", "b_letters", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    met = met.filter((F.greatest("a_n", "b_n") > 32767) | (2 * shared >= F.col("needs") * (F.col("a_n") + F.col("b_n")))).select("a", "b")
    met = met.join(side("a", "text"), "a").join(side("b", "text"), "b")
    told = met.select("a", "b", _similarity("a_text", "b_text", F.lit(least)).alias("similarity"))
    return told.filter(F.col("similarity") >= least)


def _told(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
    tokens = functools.lru_cache(1 << 12)(U.template_tokens)
    return pd.Series([U.template_similarity(a, b, t, tokens) for a, b, t in zip(left, right, least)], dtype="float64")


#: Said to be nondeterministic so that a filter on the result doesn't work it out twice.
_similarity = F.pandas_udf(_told, K.DoubleType()).asNondeterministic()


def pairs_between(left: DataFrame, right: DataFrame, least: float = P.SIMILAR_TEMPLATE) -> DataFrame:
    """(scope, left, right, similarity) of the texts (scope, text) of both sides that are similar within a scope and not equal."""
    nodes, entries = index(left.unionByName(right), least)
    of = lambda side: side.select("scope", "text").distinct().join(nodes.select("scope", "text", "id"), ["scope", "text"]).select("id")
    met = candidates(entries.join(of(left), "id", "left_semi"), entries.join(of(right), "id", "left_semi"))
    found = written(similar(met, nodes, least), "similar")
    named = lambda i: nodes.select(F.col("id").alias(i), F.col("text").alias("left" if i == "a" else "right"), *(["scope"] if i == "a" else []))
    out = written(found.join(named("a"), "a").join(named("b"), "b").select("scope", "left", "right", "similarity"), "pairs")
    dropped(nodes, entries, found)
    return out


def leaders(texts: DataFrame, least: float = P.SIMILAR_TEMPLATE) -> DataFrame:
    """(scope, text, leader) of distinct texts (scope, text): in order of the texts, each goes to the most similar leader before it (of equal ones the first) or leads itself.

    That order is sequential by definition; who leads is still settled in rounds. A text that comes first in all its lists
    of the index has nothing before it that it could follow, and leads; what is similar to it follows someone, and leads
    nobody. When such rounds settle little more, the links of what is left are found, and a text leads when no text before
    it that it is similar to is unsettled. At the end each follower is compared with the leaders that it shares an element
    with. No group holds a scope, and a dense group is compared with its leader, not pair by pair.
    """
    nodes, entries = index(texts, least)
    waste = [nodes, entries]
    open_ = nodes.select("id")
    chosen = open_.limit(0)
    left = nodes.count()
    for _ in range(STAR_ROUNDS):
        live = entries.join(open_, "id", "left_semi")
        first = live.groupBy("scope", "element").agg(F.min("id").alias("first"))
        later = live.join(first, ["scope", "element"]).filter("first < id").select("id").distinct()
        new = written(open_.join(later, "id", "left_anti"), "leaders")
        follow = similar(candidates(live, entries.join(new, "id", "left_semi"), ordered=True), nodes, least)
        rest = written(open_.join(new, "id", "left_anti").join(follow.select(F.col("a").alias("id")).distinct(), "id", "left_anti"), "open")
        waste += [new, rest]
        chosen, open_, before, left = chosen.unionByName(new), rest, left, rest.count()
        if left > STAR_PROGRESS * before:
            break
    if left:
        live = entries.join(open_, "id", "left_semi")
        links = written(similar(candidates(live, live, ordered=True), nodes, least).select("a", "b"), "links")
        waste.append(links)
    while left:
        ahead = links.join(open_.select(F.col("id").alias("b")), "b", "left_semi")
        new = written(open_.join(ahead.select(F.col("a").alias("id")).distinct(), "id", "left_anti"), "leaders")
        gone = links.join(new.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        rest = written(open_.join(new, "id", "left_anti").join(gone, "id", "left_anti"), "open")
        waste += [new, rest]
        chosen, open_, left = chosen.unionByName(new), rest, rest.count()
    followers = nodes.select("id").join(chosen, "id", "left_anti")
    met = candidates(entries.join(followers, "id", "left_semi"), entries.join(chosen, "id", "left_semi"), ordered=True)
    best = similar(met, nodes, least).groupBy("a").agg(F.max(F.struct("similarity", (-F.col("b")).alias("b"))).alias("best")).select(F.col("a").alias("id"), (-F.col("best.b")).alias("leader"))
    led = best.unionByName(chosen.select("id", F.col("id").alias("leader")))
    text = nodes.select(F.col("id").alias("leader"), F.col("text").alias("leader_text"))
    out = written(nodes.select("id", "scope", "text").join(led, "id").join(text, "leader").select("scope", "text", F.col("leader_text").alias("leader")), "led")
    dropped(*waste)
    return out
