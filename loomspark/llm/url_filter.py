"""URL rules by a blocked Bloom filter and an exact hash join, in DataFrame operations only.

A rule names a host and the beginning of a path. Everything that a rule can be for a URL, each suffix of its host with
each prefix of its path that is as long as some rule's, is a key. A block is one 64-bit word: a key's hash picks the
word, three further hashes pick bits in it, so a probe reads one word. Keys that pass are joined with the rules by their
exact text, which removes false positives; the longest rule decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the filter for each rule (64 bits each), bits set for a key, rules whose join may be a broadcast.
WORDS_PER_RULE, PROBES, MOST_BROADCAST = 1, 3, 100_000
#: Keys of one URL that may pass the filter to be looked up in place; rows with more are spread and put together again.
IN_PLACE = 4
#: Words of the filter that are held as a literal; a longer rule list uses a table of words, joined by word.
MOST_WORDS = 1 << 16
SCHEMA = "host string, path string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(words)).cast("int")


def _bits(key: Column) -> Column:
    """The bits of a key in its word."""
    out = F.lit(0).cast("long")
    for k in range(PROBES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(23 + k)), F.lit(64)).cast("int")))
    return out


def bloom(rules: DataFrame, words: int) -> DataFrame:
    """The filter's words that have bits (word, bits). rules: a column `rule`."""
    return rules.groupBy(_word(F.col("rule"), words).alias("word")).agg(F.bit_or(_bits(F.col("rule"))).alias("bits"))


def candidate_keys(host: Column, path: Column, lengths: Iterable[int]) -> Column:
    """Every rule text that can fit: suffixes of the host with prefixes of the path, the longest first."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths), reverse=True)]), lambda x: x.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.array_distinct(keys)


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Each row of pages (page_id, url) with host, path, rule (the longest that fits, else null) and verdict.

    rules: host, path, verdict; a rule fits its host and all subdomains where the path begins with the rule's. The
    longest rule is that of most characters, of equal ones the one with the longer host. Of rules given twice `allow`
    wins. A null URL has an empty host and path and fits no rule. Equal rows are judged alike and all returned. Other
    columns are ignored. No pages give no rows, and without rules all get `otherwise`.
    """
    spark = pages.sparkSession
    texts = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), "verdict").filter("rule is not null and host <> ''")
    # a key is host and path behind one another; the path begins with / or is empty, so the text tells both
    texts = texts.groupBy("rule").agg(F.max("host_length").alias("host_length"), F.min("verdict").alias("rule_verdict"))
    n, most = texts.agg(F.count("*"), F.max(F.length("rule"))).first()
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None] if n else []  # a few lengths
    words = max(1, 1 << math.ceil(math.log2(max(1, WORDS_PER_RULE * n))))
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    keys = candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")
    keys = F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>"))
    filled = bloom(texts, words)
    fits = texts.select("rule", F.struct(F.length("rule").alias("n"), "host_length", F.col("rule").alias("rule"), "rule_verdict").alias("fit"))
    broadcast = n <= MOST_BROADCAST and (most or 0) <= 2048
    if words <= MOST_WORDS:
        held = {r["word"]: r["bits"] for r in filled.collect()}  # bounded by MOST_WORDS
        table = F.array(*[F.lit(held.get(k, 0)).cast("long") for k in range(words)]) if words <= 256 else _literal(spark, held, words)
        rows = rows.withColumn("possible", F.filter(keys, lambda k: F.get(table, _word(k, words)).bitwiseAND(_bits(k)) == _bits(k)))
    else:
        rows = rows.withColumn("possible", keys)
    known = ["page_id", "url", "host", "path"]
    judged = []
    if broadcast:
        # one hash join for each of the few keys that pass; nothing is shuffled
        few = rows.filter(F.size("possible") <= IN_PLACE)
        for k in range(IN_PLACE):
            few = few.withColumn("key", F.get("possible", F.lit(k))).join(F.broadcast(fits.select(F.col("rule").alias("key"), F.col("fit").alias(f"fit{k}"))), "key", "left").drop("key")
        judged.append(few.select(*known, F.greatest(*(f"fit{k}" for k in range(IN_PLACE))).alias("best")))
        rows = rows.filter(F.size("possible") > IN_PLACE)
    # a row that several keys fit comes together again by its place, never with others like it
    spread = rows.withColumn("row", F.monotonically_increasing_id()).select("row", *known, F.explode_outer("possible").alias("rule"))
    if words > MOST_WORDS:
        spread = spread.withColumn("word", _word(F.col("rule"), words)).join(filled, "word", "left")
        spread = spread.withColumn("rule", F.when(F.col("bits").bitwiseAND(_bits(F.col("rule"))) == _bits(F.col("rule")), F.col("rule")))
    spread = spread.join(F.broadcast(fits) if broadcast else fits, "rule", "left")
    judged.append(spread.groupBy("row", *known).agg(F.max("fit").alias("best")).drop("row"))
    out = judged[0].unionByName(judged[1]) if len(judged) == 2 else judged[0]
    return out.select(*known, F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(otherwise)).alias("verdict"))


def _literal(spark: SparkSession, held: dict[int, int], words: int) -> Column:
    """The filter's words as one constant array."""
    return F.from_json(F.lit("[" + ",".join(str(held.get(k, 0)) for k in range(words)) + "]"), "array<bigint>")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, text): the host ends at the first /."""
    rows = [(t.partition("/")[0], "/" + t.partition("/")[2] if "/" in t else "", v) for v, t in rules]
    return spark.createDataFrame(rows, SCHEMA)
