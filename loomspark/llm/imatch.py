"""Document fingerprints by I-Match: hashes of what texts share with randomised subsets of a lexicon of informative words.

The lexicon has the words whose inverse document frequency lies in a band, counted over all documents. Each of SUBSETS
random subsets of it is given at every rate 1, 1/2, 1/4, ...; a text uses the rate at which one to two of its words are to
be expected and the RATES - 1 below, so that long and short texts differ alike when a share of their words changes, and
texts of which one has some times the words of the other still have a rate in common. Sorted distinct words that are in a
subset are hashed; two texts are as like as the share of subsets with equal hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Shares of all documents that have a word of the lexicon, at least and at most: the band of inverse document frequency is 2.3 to 8.1.
LEAST_SHARE, MOST_SHARE = 0.0003, 0.1
#: Documents that have a word of the lexicon, at least, so that a word of one document is never in it.
LEAST_DOCUMENTS = 2
#: Words that a lexicon may have: what is broadcast is 8 bytes for each. The band's lower end doubles until it has no more.
MOST_TERMS = 4_000_000
SUBSETS, RATES = 32, 4
#: Hexadecimal digits of a fingerprint for one subset at one rate; zeros stand for a subset without any word of the text.
DIGITS = 3
#: Distinct words that a task counts before it passes on what it has.
HELD_TERMS = 1 << 19

RESULT = "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
U64 = np.uint64


def term_counts(docs: DataFrame) -> DataFrame:
    """(key, n): the number of documents with each word, by a hash of it. docs: text."""

    def count(batches):
        keys, counts, held = [], [], 0
        for batch in common.slices(batches, "text"):
            row, key = distinct_terms(common.as_text(batch.column("text")))
            k, n = np.unique(key, return_counts=True)
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > HELD_TERMS:
                k, n = _summed(keys, counts)
                keys, counts, held = [k], [n], len(k)
                if held > HELD_TERMS // 2:
                    yield _pairs(k, n)
                    keys, counts, held = [], [], 0
        if keys:
            yield _pairs(*_summed(keys, counts))

    return common.tune(docs.select("text")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def _pairs(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["key", "n"])


def lexicon(docs: DataFrame) -> np.ndarray:
    """The sorted hashes of the words in the band; at most MOST_TERMS. As the mean document has d distinct words, at most d / LEAST_SHARE words can be in it, whatever the corpus."""
    total = docs.count()
    share = LEAST_SHARE
    counted = common.materialize(term_counts(docs).filter((F.col("n") >= LEAST_DOCUMENTS) & (F.col("n") >= share * total) & (F.col("n") <= MOST_SHARE * total)), "terms")
    chosen = counted
    while chosen.count() > MOST_TERMS:
        share *= 2
        chosen = counted.filter(F.col("n") >= share * total)
    keys = np.asarray(chosen.select("key").toArrow().column("key"), dtype=np.int64).view(U64)
    common.discard(counted)
    return np.sort(keys)


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of a word) of the distinct words of each text, in order of both. Words are parted by ASCII white space; A-Z count as a-z."""
    codes, offs, words = common.words_of(texts, lower=True)
    h = common.hash_words(words)
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    row = np.repeat(np.arange(len(texts)), np.diff(offs))
    both = np.unique(row * max(len(h), 1) + rank[codes])
    row, at = both // max(len(h), 1), both % max(len(h), 1)
    return row, h[order][at]


def fingerprints(texts: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, hashes) of texts; level: -1 for a text without words, hashes: numbers of DIGITS digits by text, rate and subset (0: no word).

    A text without any word of the lexicon uses all its words.
    """
    row, key = distinct_terms(texts)
    size = len(texts)
    if len(terms):
        known = terms[np.minimum(np.searchsorted(terms, key), len(terms) - 1)] == key
        some = np.bincount(row[known], minlength=size) > 0
        keep = known | ~some[row]
        row, key = row[keep], key[keep]
    count = np.bincount(row, minlength=size)
    level = np.frexp(count.astype(np.float64))[1].astype(np.int64) - 1  # the whole part of the binary logarithm
    out = np.zeros((size, RATES, SUBSETS), np.uint16)
    bound = (~np.zeros(size, U64)) >> np.maximum(level, 0).astype(U64)
    seeds = common.mix(np.arange(1, SUBSETS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    for k in range(SUBSETS):
        draw = common.mix(key ^ seeds[k])
        chosen = np.flatnonzero(draw <= bound[row])
        r, x, d = row[chosen], key[chosen], draw[chosen]
        for rate in range(RATES):
            if rate:
                half = d <= bound[r] >> U64(rate)
                r, x, d = r[half], x[half], d[half]
            if len(r):
                first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
                hashed = common.mix(np.add.reduceat(common.mix(x + place.astype(U64) * U64(0xD1B54A32D192ED03)), first))
                out[r[first], rate, k] = hashed % U64(16**DIGITS - 1) + U64(1)
    level[count == 0] = -1
    return level, out


def as_strings(level: np.ndarray, hashes: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal digits, the level first; an empty string for a text without words."""
    digits = np.char.mod(f"%0{DIGITS}x", np.arange(16**DIGITS))
    return [f"{n:02x}{''.join(digits[row])}" if n >= 0 else "" for n, row in zip(level.tolist(), hashes.reshape(len(level), -1))]


def likeness(level: np.ndarray, hashes: np.ndarray, other_level: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The share of equal hashes at the rates that two fingerprints have in common, of those where either has a word; 1 for equal ones."""
    equal, either = np.zeros(len(level)), np.zeros(len(level))
    for a in range(RATES):
        for b in range(RATES):
            same = level + a == other_level + b
            x, y = hashes[:, a], other[:, b]
            equal += same * ((x == y) & (x > 0)).sum(1)
            either += same * ((x > 0) | (y > 0)).sum(1)
    out = equal / np.maximum(either, 1)
    out[(level == other_level) & (hashes == other).all((1, 2))] = 1.0
    return out


def edited(text: str, following: str) -> str:
    """A text whose last quarter of code points gives way to the first as many (or all) of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _compared(ids: pa.Array, texts: list[str], following: list[str], terms: np.ndarray) -> list:
    """The columns of RESULT for texts with the text that follows each."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    own, next_, new = (fingerprints(pa.array(x, pa.large_string()), terms) for x in (texts, following, changed))
    return _columns(ids, texts, changed, own, next_, new)


def _columns(ids, texts, changed, own, next_, new) -> list:
    return [
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array(as_strings(*own), pa.string()),
        pa.array(as_strings(*new), pa.string()), pa.array(likeness(*own, *new)), pa.array(likeness(*own, *next_)),
    ]


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs (doc_id, text).

    A null text is empty, and so is its fingerprint; two empty fingerprints are alike. The next document is that of the
    next doc_id (null is the least; rows of one doc_id come in order of a hash of their texts), and after the last the
    first, which of a single row is the row itself. Other columns are not read; an empty table gives no rows.

    Texts are shuffled once, into ranges of doc_id, where each goes by with the one after it. Only a range's last text
    has its next elsewhere: those go to the first text of the next range that has any, by a join on the range's number.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = spark.sparkContext.broadcast(lexicon(texts))
    names = [c.split()[0] for c in RESULT.split(", ")]
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // common.PART_BYTES))
    keyed = common.tune(texts).withColumn("tie", F.xxhash64("text"))
    ranges = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def walk(batches):
        last = None
        for batch in common.slices(batches, "text"):
            lexical, part, ids = terms.value, batch.column("part"), batch.column("doc_id")
            here = common.as_text(batch.column("text"))
            prints, held = fingerprints(here, lexical), here.to_pylist()
            if last is None:
                yield _edge("first", ids[:1], part[:1], held[0])
            else:
                ids = pa.concat_arrays([last[0], ids])
                prints = tuple(np.concatenate([a, b]) for a, b in zip(last[2], prints))
                held.insert(0, last[1])
            changed = [edited(t, f) for t, f in zip(held, held[1:])]
            if changed:
                own, next_ = (tuple(x[cut] for x in prints) for cut in (slice(None, -1), slice(1, None)))
                new = fingerprints(pa.array(changed, pa.large_string()), lexical)
                rows = _columns(ids[:-1], held[:-1], changed, own, next_, new)
                none = [pa.nulls(len(changed), t) for t in (pa.string(), pa.int32(), pa.string())]
                yield pa.RecordBatch.from_arrays([*rows, *none], [*names, "edge", "part", "text"])
            last = (ids[-1:], held[-1], tuple(x[-1:] for x in prints), part[-1:])
        if last is not None:
            yield _edge("last", last[0], last[3], last[1])

    def _edge(which, ids, part, text):
        rest = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([ids, *rest, pa.array([which]), part.cast(pa.int32()), pa.array([text], pa.string())], [*names, "edge", "part", "text"])

    def ends(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays(_compared(one.column("doc_id"), one.column("text").to_pylist(), one.column("following").to_pylist(), terms.value), names)

    schema = RESULT.format(kind)
    walked = common.materialize(ranges.mapInArrow(walk, f"{schema}, edge string, part int, text string"), "fingerprints")
    edges = walked.filter("edge is not null").select("edge", "part", "doc_id", "text")
    filled = [r["part"] for r in edges.filter("edge = 'last'").select("part").orderBy("part").collect()]  # a number for each range
    after = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1])), "part int, next int")
    firsts = edges.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    pairs = edges.filter("edge = 'last'").join(F.broadcast(after), "part").join(firsts, "next").select("doc_id", "text", "following")
    return walked.filter("edge is null").select(*names).unionByName(pairs.mapInArrow(ends, schema))
