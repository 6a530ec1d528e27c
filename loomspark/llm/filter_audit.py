"""What quality filters remove alone, together and in every order: an audit of their interaction.

The audit walks the trie of filter orders depth first. A node's survivors are a persisted DataFrame; applying one more
filter to it is an edge, and what the edge removes is counted from the survivors themselves. Orders that begin with the
same filters, however arranged, reach the same survivors, so a node is known by its set of filters and visited once:
2^n nodes in place of n! orders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"
#: A text with more than this share of all rows is looked up in a broadcast list, which so has 1,000 rows at most.
HOT_SHARE = 1000


def copies(docs: DataFrame, firsts: DataFrame, total: int, id: str = "doc_id", key: str = "key") -> DataFrame:
    """docs (columns id, key and others) with `copy`: whether a lesser id has the same key. firsts: first_ids(docs); total: number of rows.

    A null id is neither less nor greater than another. A frequent key's first id is broadcast, so its rows stay where they are.
    """
    hot = F.col("__n") * HOT_SHARE > total
    frequent = firsts.filter(hot).select(F.col("__key"), F.col("__first").alias("__hot"))
    near = docs.withColumn("__key", F.col(key)).join(F.broadcast(frequent), "__key", "left")
    # rows that are done take keys of their own, which spreads them
    asked = near.withColumn("__key", F.when(F.col("__hot").isNull(), F.col("__key")).otherwise(F.concat("__key", F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))))
    out = asked.join(firsts.filter(~hot).select("__key", "__first"), "__key", "left")
    return out.withColumn("copy", F.coalesce(F.col(id) > F.coalesce("__hot", "__first"), F.lit(False))).drop("__key", "__hot", "__first")


def first_ids(docs: DataFrame, id: str = "doc_id", key: str = "key") -> DataFrame:
    """(__key, __first, __n): the least id and the number of rows of each key that several rows have."""
    return docs.groupBy(F.col(key).alias("__key")).agg(F.min(id).alias("__first"), F.count("*").alias("__n")).filter("__n > 1 and __first is not null")


def text_rules(text: str = "text") -> dict[str, Column]:
    """The failure conditions of the query that a text alone decides, by name. A null text is an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 5 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def trie(root: DataFrame, filters: list[str], gains: list[str]) -> Iterator[DataFrame]:
    """A table for each node of the trie but the last: (part, state, kept, and for each filter left a struct with the counts of its edge; null for those applied).

    root: part, a failure column for each filter, a flag for each gain. A node's survivors are persisted while its
    descendants are visited, so no more than one DataFrame a level is held at a time; a lost one is made anew from root.
    """
    seen: set[frozenset] = set()

    def counts(rows: DataFrame, done: frozenset) -> DataFrame:
        lost = lambda f: F.struct(F.count_if(f).alias("removed"), *(F.count_if(F.col(f) & F.col(g)).alias(g) for g in gains))
        none = F.lit(None).cast("struct<removed:bigint," + ",".join(f"{g}:bigint" for g in gains) + ">")
        state = sum(1 << filters.index(f) for f in done)
        edges = [(none if f in done else lost(f)).alias(f"edge_{k}") for k, f in enumerate(filters)]
        return rows.groupBy("part").agg(F.lit(state).alias("state"), F.count("*").alias("kept"), *edges)

    def visit(rows: DataFrame, done: frozenset) -> Iterator[DataFrame]:
        if done in seen or len(done) == len(filters):
            return
        seen.add(done)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield counts(rows, done)
            for f in filters:
                if f not in done:
                    yield from visit(rows.filter(~F.col(f)).drop(f), done | {f})
        finally:
            rows.unpersist()

    yield from visit(root, frozenset())


def audit(docs: DataFrame, filters: dict[str, Column], part: Column, gains: dict[str, Column]) -> DataFrame:
    """For each part, order of all filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails, <gain>_lost, shapley).

    filters: failure conditions by one-letter name, each of one row alone (so survivors don't depend on the order); a null
    verdict is a pass. gains: flags whose removed rows are counted, null: no. An empty table gives no rows; a null part is
    an empty string. Repeated rows count each. docs should be a written table, as lost survivors are made anew from it.

    Counts of a node are one row a part; a part's rows of all nodes come together in one, from which every order reads its
    edges. The counts stay in the shared folder, as the result reads them.
    """
    names, flags = list(filters), list(gains)
    no = F.lit(False)
    root = docs.select(F.coalesce(part, F.lit("")).alias("part"), *(F.coalesce(c, no).alias(f) for f, c in filters.items()), *(F.coalesce(c, no).alias(g) for g, c in gains.items()))
    folder = common.new_folder(docs.sparkSession, "trie")
    for node in trie(root, names, flags):  # one job for each node, while its survivors are held
        node.write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(folder)
    counted = docs.sparkSession.read.schema(node.schema).parquet(folder)
    every = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("kept", *(f"edge_{k}" for k in range(len(names))))))).alias("nodes"))
    return _orders(every, names, flags)


def _orders(every: DataFrame, names: list[str], flags: list[str]) -> DataFrame:
    """All orders and steps of each part. every: part, nodes (a map from a set of filters, as bits, to its counts)."""
    size = len(names)
    node = lambda state: F.col("nodes")[F.lit(state)]
    # a part without survivors at a node has no counts there: zero
    count = lambda state, k, what: F.coalesce(node(state)[f"edge_{k}"][what], F.lit(0))
    weight = [math.factorial(n) * math.factorial(size - n - 1) for n in range(size)]
    totals = []
    for k in range(size):
        states = [s for s in range(1 << size) if not s >> k & 1]
        shapley = sum((weight[bin(s).count("1")] * count(s, k, "removed") for s in states), F.lit(0))
        totals.append(F.struct(count(0, k, "removed").alias("fails"), count((1 << size) - 1 - (1 << k), k, "removed").alias("unique_fails"), shapley.cast("long").alias("shapley")))
    steps = []
    for order in permutations(range(size)):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append((''.join(names[i] for i in order), step, k, before))
            before |= 1 << k
    listed = ", ".join(f"struct('{o}', {s}, {k}, {b})" for o, s, k, b in steps)
    # the orders are fixed text of the plan: each part's row becomes one for each of them
    rows = every.withColumn("totals", F.array(*totals)).select("part", "nodes", "totals", F.explode(F.expr(f"array({listed})")).alias("at"))
    at = lambda k: F.col("at")[f"col{k}"]
    here = F.col("nodes")[at(4)]
    edge = F.coalesce(*(F.when(at(3) == k, here[f"edge_{k}"]) for k in range(size)))
    total = F.element_at("totals", at(3) + 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = rows.select("part", at(1).alias("filter_order"), at(2).alias("step"), zero(here["kept"]).alias("before"), edge.alias("edge"), total.alias("total"))
    removed = zero(F.col("edge.removed"))
    return rows.select(
        "part", "filter_order", "step", (F.col("before") - removed).alias("kept"), removed.alias("removed"), (F.col("total.fails") - removed).alias("redundant"), F.col("total.unique_fails"),
        *(zero(F.col(f"edge.{g}")).alias(f"{g}_lost") for g in flags), F.col("total.shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of four text rules and of E, exact copies, over documents (doc_id, text, source) by source, with what is lost of labels' good (quality 1) and toxic (toxic 1) documents.

    Texts are read once, for verdicts and a SHA-256; what follows is narrow. Of several labels of one doc_id any counts. A
    null doc_id has no label and is no copy.
    """
    read = docs.select("doc_id", "source", *(c.alias(f) for f, c in text_rules().items()), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"))
    read = common.materialize(read, "verdicts")
    firsts = common.materialize(first_ids(read), "copies")
    marked = copies(read, firsts, read.count()).withColumnRenamed("copy", "E").drop("key")
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    # null ids meet no label and are not joined, so they stay spread
    labelled = marked.filter("doc_id is not null").join(known, "doc_id", "left").unionByName(marked.filter("doc_id is null"), allowMissingColumns=True)
    whole = common.materialize(labelled, "labelled")
    for done in (read, firsts):
        common.discard(done)
    out = audit(whole, {f: F.col(f) for f in "ABCDE"}, F.col("source"), {"good": F.col("good"), "toxic": F.col("toxic")})
    common.discard(whole)
    return out
