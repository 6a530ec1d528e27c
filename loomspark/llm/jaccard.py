"""Similarity join on word shingles with adaptive multi-match prefixes.

Shingles have one order for all documents: frequency in the corpus, estimated by a sketch of fixed size, then their hash.
Two sets that share t shingles share at least l among the first |x| - t + l of each. A document takes the l whose prefix
promises the least work (entries to read, and candidates that reach l matches). How many matches a pair needs follows
from both prefixes and sizes.

1. sketch    one pass counts shingles in a table of fixed size and gives each document the fingerprint of its set
2. lists     prefix shingles are dealt to buckets; a bucket keeps shingles of two sets or more, as lists of documents
3. stars     each list proposes few pairs; verified ones already join most copies into components
4. rest      components that still meet in lists often enough are compared, in blocks of their documents

A long list is held in pieces. No step pairs its pieces: stars go to documents of the piece and to few that the whole list
has in common, and the rest pairs what a list holds of different components, each once. Pairs inside one component are
never formed, so a group of copies costs its size, not its square. Verification compares words, not hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, sketch

SIZE, PERCENT = 5, 75
#: Candidate lengths l of matches, and the work to verify a candidate against reading one entry.
MATCHES, VERIFY_COST = (1, 2, 3, 4, 6, 8), 20.0
#: Bytes of prefixes in a bucket, documents in one piece of a list, bytes of texts in a group that verifies pairs.
BUCKET_BYTES, PIECE, GROUP_BYTES = 6 << 20, 2048, 2 << 20
#: Shingles of the documents in one block of a component, so that few long texts are a block as many short ones are.
PIECE_SHINGLES = 1 << 19
#: Estimated documents of a shingle from which its list is made in several buckets.
HOT = 50_000
#: Entries of different components that are paired at once; comparisons in a group, and blocks against one hub there.
MEETING, COMPARISONS, AT_HUB = 512, 50_000, 250
#: Bytes of texts whose shingles are held at once.
TEXT_BYTES = 2 << 20
#: Entries of lists that one task takes of lists with one least component.
HELD = 400_000
#: Bits of the map of wanted documents that is broadcast: fixed, so a larger corpus only lets more documents pass it.
WANTED_BITS = 23
NULL_ID = -(1 << 63)


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than a shingle the whole sequence is one."""
    codes, offs, distinct = common.words_of(texts, lower=True)
    h = common.hash_words(distinct)[codes]
    keys, ends = common.shingles(h, offs, size)
    counts = np.diff(offs)
    out = []
    cut, word = ends.tolist(), offs.tolist()
    for k in range(len(texts)):
        if cut[k + 1] > cut[k]:
            s = keys[cut[k] : cut[k + 1]]
            s.sort()
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
        elif counts[k]:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[word[k] : word[k + 1]].tobytes(), seed=int(counts[k]))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def exact_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as numbers that are equal for equal words only, the same in all these texts."""
    codes, offs, _ = common.words_of(texts, lower=True)
    counts = np.diff(offs)
    row = np.repeat(np.arange(len(texts)), counts)
    # a word behind each text's last ones: shorter runs are told apart too, and stand for texts of fewer words
    left = offs[1:][row] - np.arange(len(codes))
    key = codes.astype(np.int64) + 1
    for k in range(1, size):
        step = np.zeros(len(codes), np.int64)
        step[: max(len(codes) - k, 0)] = codes[k:] + 1
        step[left <= k] = 0
        _, key = np.unique(key * (int(codes.max(initial=0)) + 2) + step, return_inverse=True)
    keep = (left >= size) | (counts[row] < size) & (left == counts[row])
    key, row = key[keep], row[keep]
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, bool)
    key, row = key[new], row[new]
    return np.split(key, np.searchsorted(row, np.arange(1, len(texts)))) if len(texts) else []


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """What a set of n shares at least with a set that is similar enough."""
    return -(-percent * n // 100)


def _first_pass(docs: DataFrame, size: int) -> DataFrame:
    """Rows of documents (node, tie, n, fp, fq) and, one set for each task, slices of its counts (slice, task, blob)."""

    def run(batches):
        counts = sketch.empty()
        names = ["node", "tie", "n", "fp", "fq", "slice", "task", "blob"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        task = TaskContext.get().partitionId()
        for batch in common.slices(batches, "text", TEXT_BYTES):
            sets = shingle_sets(common.as_text(batch.column("text")), size)
            sketch.add(counts, np.concatenate(sets))
            prints = [fingerprint(s) for s in sets]
            n = len(sets)
            values = [batch.column("node"), batch.column("tie"), [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints], [None] * n, [None] * n, [None] * n]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) if isinstance(v, list) else v for v, k in zip(values, kinds)], names)
        values = [[None] * sketch.SLICES] * 5 + list(sketch.packed(counts, task))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    return docs.select("node", "tie", "text").mapInArrow(run, "node long, tie long, n long, fp long, fq long, slice int, task long, blob binary")


def choose_prefix(s: np.ndarray, level: np.ndarray, excess: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """(prefix shingles, l) of one set. level: the order's first key of each shingle; excess: its estimated other documents."""
    n = len(s)
    order = np.lexsort((s, level))
    need = least_overlap(n, percent)
    work = np.cumsum(excess[order] + 0.05)
    best = None
    for match in MATCHES:
        p = n - need + match
        if match > need or p > n:
            break
        cost = work[p - 1] * (1 + VERIFY_COST / match)
        if best is None or cost < best[0]:
            best = (cost, match, p)
    return s[order[: best[2]]], best[1]


def _lists(docs: DataFrame, counts: np.ndarray, buckets: int, size: int, percent: int) -> DataFrame:
    """Lists of documents that share a prefix shingle, equal lists once with their number: (docs, ns, ls, family, times).

    Blobs of a batch are keyed by bucket; a set that occurs again in a batch is sent once, and again once in a bucket. A
    list of more than PIECE documents becomes pieces of one family (0: a list of one piece). Entries of a shingle that very
    many documents have (by the sketch, so that all agree) are dealt to several buckets by their sets; what the buckets
    make of them are pieces of one family too, whose name is made of all of them.
    """
    mean = float(counts.sum(dtype=np.float64)) / len(counts)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = np.dtype([("token", "<u8"), ("doc", "<u4")])

    def emit(batches):
        counts, pack = shared.value, zstandard.ZstdCompressor(level=1).compress
        for batch in common.slices(batches, "text", TEXT_BYTES):
            sets = shingle_sets(common.as_text(batch.column("text")), size)
            nodes = np.asarray(batch.column("node"), dtype=np.int64)
            first: dict[bytes, int] = {}
            for k in np.argsort(nodes, kind="stable").tolist():
                if len(sets[k]):
                    first.setdefault(xxhash.xxh3_128_digest(sets[k].tobytes()), k)
            rows = sorted(first.values())
            parts, match = [], []
            for k in rows:
                c = counts[sketch.place(sets[k])].astype(np.float64)
                excess = np.maximum(c - mean - 3 * math.sqrt(mean + 1), 0)
                level = np.floor(4 * np.log2(excess + 1)).astype(np.int64)
                prefix, l = choose_prefix(sets[k], level, excess, percent)
                parts.append(prefix)
                match.append(l)
            if not rows:
                continue
            entries = np.empty(sum(map(len, parts)), schema)
            entries["token"] = np.concatenate(parts)
            entries["doc"] = np.repeat(np.arange(len(rows), dtype=np.uint32), [len(p) for p in parts])
            table = np.empty(len(rows), [("node", "<i8"), ("fp", "<i8"), ("n", "<u4"), ("l", "<u4")])
            table["node"], table["l"] = nodes[rows], match
            table["fp"] = [fingerprint(sets[k])[0] for k in rows]
            table["n"] = [len(sets[k]) for k in rows]
            print64 = table["fp"].astype(np.uint64)[entries["doc"]]
            share = common.mix(print64) % _shares(entries["token"], counts)
            where = (common.mix(entries["token"] + share * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            order, found = common.present(where, entries["token"])
            entries = entries[order]
            blobs = []
            for _, lo, hi in found:
                part = entries[lo:hi]
                used, doc = np.unique(part["doc"], return_inverse=True)
                # tokens ascend; documents are numbers in this blob's own table
                blobs.append(pack(b"".join([np.array([len(used), hi - lo], "<u4").tobytes(), table[used].tobytes(), part["token"].tobytes(), doc.astype("<u2" if len(used) < 65536 else "<u4").tobytes()])))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _, _ in found], pa.int32()), "blob": pa.array(blobs, pa.binary())})

    kind = np.dtype([("node", "<i8"), ("fp", "<i8"), ("n", "<u4"), ("l", "<u4")])

    def meet(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        tables, tokens, docs_ = [], [], []
        base = 0
        for blob in group.column("blob").to_pylist():
            plain = unpack(blob)
            n, m = np.frombuffer(plain, "<u4", 2)
            tables.append(np.frombuffer(plain, kind, n, 8))
            at = 8 + int(n) * kind.itemsize
            tokens.append(np.frombuffer(plain, "<u8", m, at))
            docs_.append(np.frombuffer(plain, "<u2" if n < 65536 else "<u4", m, at + 8 * int(m)).astype(np.int64) + base)
            base += int(n)
        table, token, doc = np.concatenate(tables), np.concatenate(tokens), np.concatenate(docs_)
        # sets that several batches sent: each stands for the least document that has it
        _, same = np.unique(table[["fp", "n"]], return_inverse=True)
        least = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, table["node"])
        doc = same[doc]
        one = np.zeros(len(least), np.int64)
        one[same] = np.arange(len(table))
        sizes, matches = table["n"][one].astype(np.int64), table["l"][one].astype(np.int64)
        order = np.lexsort((doc, token))
        token, doc = token[order], doc[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])
        token, doc = token[new], doc[new]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        ends = np.append(starts[1:], len(token))
        hot = _shares(token[starts], shared.value) > 1
        keep = (ends - starts > 1) | hot
        seen: dict[tuple[bytes, int], list] = {}
        for lo, hi, name in zip(starts[keep].tolist(), ends[keep].tolist(), np.where(hot, token[starts].view(np.int64), 0)[keep].tolist()):
            key = doc[lo:hi].tobytes(), name
            if key in seen:
                seen[key][1] += 1
            else:
                seen[key] = [doc[lo:hi], 1]
        out: dict[str, list] = {c: [] for c in ("docs", "ns", "ls", "family", "times", "shingle")}
        for (_, name), (members, times) in seen.items():
            members = members[np.lexsort((least[members], sizes[members]))]
            family = xxhash.xxh3_64_intdigest(b"".join(v[members].tobytes() for v in (least, sizes, matches))) >> 1 if len(members) > PIECE else 0
            for lo in range(0, len(members), PIECE):
                part = members[lo : lo + PIECE]
                for c, v in zip(out, (least[part], sizes[part], matches[part], family, times, name or None)):
                    out[c].append(v)
        arrays = pa.list_(pa.int64())
        return pa.table({c: pa.array(out[c], arrays if c in ("docs", "ns", "ls") else pa.int64()) for c in out})

    blobs = docs.select("node", "text").mapInArrow(emit, "bucket int, blob binary")
    lists = common.dealt(blobs, "bucket", buckets * BUCKET_BYTES).groupBy("bucket").applyInArrow(common.grouped(meet), "docs array<long>, ns array<long>, ls array<long>, family long, times long, shingle long")
    lists = common.materialize(lists, "lists")
    # equal lists of several shingles have equal pieces in all buckets, and so one name
    hot = lists.filter("shingle is not null")
    whole = hot.groupBy("shingle").agg(F.xxhash64(F.sum(F.xxhash64("docs", "ns", "ls").cast("decimal(38,0)")), F.count("*"), F.sum(F.size("docs"))).alias("family"))
    named = hot.drop("family").join(whole.withColumn("family", F.when(F.col("family") != 0, F.col("family")).otherwise(1)), "shingle")
    every = lists.filter("shingle is null").unionByName(named.select(lists.columns))
    bare = common.materialize(every.groupBy("docs", "ns", "ls", "family").agg(F.sum("times").alias("times")), "lists")
    common.discard(lists)
    return bare


def _shares(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """In how many parts the entries of each shingle are dealt."""
    c = counts[sketch.place(tokens)] // np.uint32(HOT)
    return (np.uint64(1) << np.ceil(np.log2(c + 1.0)).astype(np.uint64)).astype(np.uint64)


def least_shared(na, la, nb, lb, percent: int = PERCENT):
    """Prefix shingles that two similar sets share at least; na, nb: their sizes, la, lb: the matches they chose.

    Similar sets share t = percent / (100 + percent) of na + nb. All shared ones up to the end of the prefix that ends
    first are in both prefixes; the others are behind it, where that set has n - |prefix| shingles.
    """
    t = -(-percent * (na + nb) // (100 + percent))
    behind = np.maximum(-(-percent * na // 100) - la, -(-percent * nb // 100) - lb)
    return t - behind


def _with_totals(lists: DataFrame) -> DataFrame:
    """Adds ts, for each document of a list the prefix shingles of it that any other document has too, in all lists; and k1 and k2, which name a list, all its pieces alike.

    A row is put together again by all that `_lists` keeps apart: long lists can begin alike, and rows of one doc_id can have sets of several sizes.
    """
    totals = lists.select("times", F.explode("docs").alias("doc")).groupBy("doc").agg(F.sum("times").alias("t"))
    row = ("docs", "ns", "ls", "family")
    keyed = lists.select(F.xxhash64(*row, F.lit(1)).alias("r1"), F.xxhash64(*row, F.lit(2)).alias("r2"), "family", "times", F.posexplode(F.arrays_zip("docs", "ns", "ls")).alias("at", "e"))
    known = keyed.withColumn("doc", F.col("e.docs")).join(totals, "doc")
    whole = known.groupBy("r1", "r2").agg(
        F.first("family").alias("family"), F.first("times").alias("times"), F.array_sort(F.collect_list(F.struct("at", "doc", F.col("e.ns").alias("n"), F.col("e.ls").alias("l"), "t"))).alias("es")
    )
    long = F.col("family") != 0
    return whole.select(F.when(long, F.col("family")).otherwise(F.col("r1")).alias("k1"), F.when(long, 0).otherwise(F.col("r2")).alias("k2"), "family", "times", F.col("es.doc").alias("docs"), F.col("es.n").alias("ns"), F.col("es.l").alias("ls"), F.col("es.t").alias("ts"))


def _tops(lists: DataFrame, percent: int) -> DataFrame:
    """(family, tops): few documents of each list of several pieces, by orders that all lists have in common."""
    e = lists.filter("family <> 0").select("family", F.explode(F.arrays_zip(F.col("docs").alias("node"), F.col("ns").alias("n"), F.col("ls").alias("l"), F.col("ts").alias("t"))).alias("e"))
    ratio = F.col("e.t") / (F.col("e.n") - F.ceil(F.col("e.n") * percent / 100) + F.col("e.l"))
    picks = [F.min_by("e", "e.node"), F.max_by("e", F.struct(ratio, -F.col("e.node"))), *(F.min_by("e", F.xxhash64("e.node", F.lit(r))) for r in (3, 5))]
    return e.groupBy("family").agg(F.array_distinct(F.array(*picks)).alias("tops"))


def _star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Few pairs of each list: each document with the first in some orders that all lists have in common, of its piece and of the whole list.

    Half of the least shared shingles suffice, as a pair is not formed in all of its lists.
    """

    def emit(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                yield _summed(_stars_of(batch.slice(lo, 200), percent), ["a", "b"])

    held, names = ["times", "docs", "ns", "ls", "ts"], ("node", "n", "l", "t")
    # only pieces need the whole list's: all other lists have one family
    short = lists.filter("family = 0").select(*held, *(F.array().cast("array<long>").alias(f"top_{c}") for c in names))
    long = lists.filter("family <> 0").join(_tops(lists, percent), "family").select(*held, *(F.col(f"tops.{c}").alias(f"top_{c}") for c in names))
    pairs = short.unionByName(long).mapInArrow(emit, "a long, b long, need long, shared long")
    pairs = pairs.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("shared").alias("shared"))
    return pairs.filter("2 * shared >= need").select(F.array("a").alias("left"), F.array("b").alias("right"), F.col("b").alias("hub"))


def _arrays(batch, row: int, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(c)[row].values, dtype=np.int64) for c in names]


def _stars_of(batch, percent: int) -> list[tuple[np.ndarray, ...]]:
    found = []
    for row, times in enumerate(batch.column("times").to_pylist()):
        node, n, l, t = _arrays(batch, row, "docs", "ns", "ls", "ts")
        held = len(node)
        # of near copies, that with the most common prefix shingles has the fewest of its own and so is nearest to all
        central = np.lexsort((node, -t / (n - -(-percent * n // 100) + l)))[0]
        tops = {int(np.argmin(node)), int(central)} | {int(np.argmin(common.mix(node.astype(np.uint64) * np.uint64(r)))) for r in (3, 5)}
        others = _arrays(batch, row, "top_node", "top_n", "top_l", "top_t")
        new = np.flatnonzero(~np.isin(others[0], node[sorted(tops)]))
        node, n, l = (np.concatenate([x, y[new]]) for x, y in zip((node, n, l), others))
        i = np.repeat(np.array(sorted(tops) + list(range(held, len(node)))), held)
        j = np.tile(np.arange(held), len(tops) + len(new))
        ok = (node[i] != node[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        found.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), least_shared(n[i], l[i], n[j], l[j], percent), np.full(len(i), times)))
    return found


def _summed(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    """Rows with equal keys as one: the least need, the sum of shared. found: keys, need and shared."""
    *keys, need, shared = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort(keys[::-1])
    keys, need, shared = [k[order] for k in keys], need[order], shared[order]
    first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])) if len(need) else np.zeros(0, np.int64)
    values = [*(k[first] for k in keys), np.minimum.reduceat(need, first) if len(first) else need, np.add.reduceat(shared, first) if len(first) else shared]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], [*names, "need", "shared"])


def _meetings(lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each list holds of different components, in rows of at most two blocks of MEETING: (k1, lo, times, second, components, ns, ls, ts); and the written table that this reads.

    Documents of a component that are alike in all that counts are one entry. `second` is where the second block begins
    (0: one block, all of whose entries are paired; else only those of different blocks). Entries of one component lie in one block.
    """
    entries = lists.select("k1", "k2", "times", F.explode(F.arrays_zip("docs", "ns", "ls", "ts")).alias("e"))
    known = entries.withColumn("node", F.col("e.docs")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    alike = known.groupBy("k1", "k2", "component", F.col("e.ns").alias("n"), F.col("e.ls").alias("l")).agg(F.max("e.ts").alias("t"), F.max("times").alias("times"))
    size = alike.groupBy("k1", "k2").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("times").alias("times")).filter("lo < hi")
    size = size.withColumn("blocks", F.ceil(F.col("size") / MEETING))
    dealt = alike.select("k1", "k2", F.struct("component", "n", "l", "t").alias("e")).join(size, ["k1", "k2"])
    blocks = dealt.groupBy("k1", "k2", F.pmod(F.xxhash64("e.component"), "blocks").alias("block")).agg(F.first("lo").alias("lo"), F.first("times").alias("times"), F.first("blocks").alias("blocks"), F.sort_array(F.collect_list("e")).alias("es"))
    blocks = common.materialize(blocks, "met")
    one = blocks.select("k1", "lo", "times", F.lit(0).alias("second"), "es")
    several = blocks.filter("blocks > 1")
    left = several.select("k1", "k2", "lo", "times", F.col("block").alias("i"), F.col("es").alias("xs"), F.explode(F.expr("sequence(block + 1, blocks)")).alias("j")).filter("j > i")
    two = left.join(several.select("k1", "k2", F.col("block").alias("j"), F.col("es").alias("ys")), ["k1", "k2", "j"]).select("k1", "lo", "times", F.size("xs").alias("second"), F.concat("xs", "ys").alias("es"))
    return one.unionByName(two).selectExpr("k1", "lo", "times", "second", "es.component as components", "es.n as ns", "es.l as ls", "es.t as ts"), blocks


def _rest_pairs(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Blocks of documents of different components that may still be similar (left, right, hub).

    Two components meet in lists; what any of their documents share is at most the lists where they meet. Only components
    that meet often enough for the least demand of their documents are compared.
    """
    mixed, entries = _meetings(lists, labels)
    mixed = mixed.withColumn("held", F.size("components"))
    # lists of the same documents mostly share their least component; where they come together, each pair is one row
    load = mixed.groupBy("lo").agg(F.sum("held").alias("load"))
    mixed = mixed.join(load, "lo").repartition("lo", F.pmod("k1", F.ceil(F.col("load") / HELD)))

    def meet(batches):
        found, held = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                n, l, t, component = _arrays(batch, row, "ns", "ls", "ts", "components")
                second, times = (batch.column(c)[row].as_py() for c in ("second", "times"))
                names, own = np.unique(component, return_inverse=True)
                if second:
                    i = np.repeat(np.arange(second), len(own) - second)
                    j = np.tile(np.arange(second, len(own)), second)
                else:
                    i, j = np.triu_indices(len(own), 1)
                ok = (own[i] != own[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                need = least_shared(n[i], l[i], n[j], l[j], percent)
                ok = need <= np.minimum(t[i], t[j])  # neither shares more with all others together
                i, j, need = i[ok], j[ok], need[ok]
                if len(i):
                    pair = np.minimum(own[i], own[j]) * len(names) + np.maximum(own[i], own[j])
                    at = np.argsort(pair, kind="stable")
                    pair, need = pair[at], need[at]
                    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                    pair, k = pair[first], len(first)
                    found.append((names[pair // len(names)], names[pair % len(names)], np.minimum.reduceat(need, first), np.full(k, times)))
                    held += k
                    if held > 1 << 19:
                        rows = _summed(found, ["a", "b"])
                        found, held = [tuple(np.asarray(c) for c in rows.columns)], rows.num_rows
                        if held > 1 << 18:
                            yield rows
                            found, held = [], 0
        if found:
            yield _summed(found, ["a", "b"])

    met = mixed.mapInArrow(meet, "a long, b long, need long, shared long")
    met = met.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("shared").alias("shared")).filter("shared >= need").select("a", "b")
    nodes = lists.select(F.explode(F.arrays_zip("docs", "ns")).alias("e")).groupBy(F.col("e.docs").alias("node")).agg(F.max("e.ns").alias("n")).join(labels, "node", "left")
    # a component's documents in blocks of a bounded number and of bounded texts
    size = nodes.groupBy(F.coalesce("component", "node").alias("component")).agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    dealt = nodes.withColumn("component", F.coalesce("component", "node")).join(size, "component")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.greatest(F.col("size") / PIECE, F.col("shingles") / PIECE_SHINGLES))))
    blocks = dealt.groupBy("component", "block").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    one = blocks.select(F.col("component").alias("a"), F.col("nodes").alias("x"))
    two = blocks.select(F.col("component").alias("b"), F.col("nodes").alias("y"))
    both = met.join(one, "a").join(two, "b")
    larger = F.size("x") >= F.size("y")
    out = both.select(F.when(larger, F.col("y")).otherwise(F.col("x")).alias("left"), F.when(larger, F.col("x")).otherwise(F.col("y")).alias("right")).withColumn("hub", F.xxhash64("right"))
    out = common.materialize(out, "pairs")
    common.discard(entries)
    return out


def first_similar(z: np.ndarray, flat: np.ndarray, ends: np.ndarray, percent: int) -> int:
    """The first of the sets flat[ends[k]:ends[k + 1]] that is similar to z; -1: none."""
    if not len(z) or not len(flat):
        return -1
    at = np.minimum(np.searchsorted(z, flat), len(z) - 1)
    both = np.diff(np.concatenate([[0], np.cumsum(z[at] == flat)])[ends])
    n = np.diff(ends)
    good = np.flatnonzero((both > 0) & (100 * both >= percent * (n + len(z) - both)))
    return int(good[0]) if len(good) else -1


def _verified(blocks: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between blocks: for each document of the smaller side the first similar one of the larger side.

    One is enough, as the larger side is in one component, and none is sought where links of the same group connect both
    already. A block is compared where its `hub` is; what stands against a hub with very many blocks is spread.
    """
    texts = common.materialize(_packed(docs, blocks), "texts")
    packed = texts.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    work = blocks.agg(F.sum(F.size("left") * F.size("right"))).first()[0] or 0
    # compressed texts are about a third of the texts, and a text may go to several groups
    groups = max(1, -(-4 * packed // GROUP_BYTES), -(-work // COMPARISONS))
    load = blocks.groupBy("hub").agg(F.sum(F.size("left")).alias("load"))
    spread = F.when(F.col("load") > AT_HUB, F.pmod(F.xxhash64("left"), F.ceil(F.col("load") / AT_HUB))).otherwise(0)
    dealt = blocks.join(load, "hub").select("left", "right", "hub", F.pmod(F.xxhash64("hub", spread), F.lit(groups)).alias("g"))
    wanted = _documents(dealt, "g").distinct()
    none = F.lit(None).cast("array<long>")
    shipped = texts.join(wanted.hint("shuffle_hash"), "node").select("g", "node", "packed", none.alias("left"), none.alias("right"))
    rows = shipped.unionByName(dealt.select("g", F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("packed"), "left", "right"))

    def check(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        sets: dict[int, list[np.ndarray]] = {}
        texts_ = group.filter(pc.is_valid(group.column("packed")))
        plain = pa.array([unpack(x.as_py()).decode() for x in texts_.column("packed")], pa.large_string())
        for node, s in zip(texts_.column("node").to_pylist(), exact_sets(plain, size)):
            sets.setdefault(node, []).append(s)
        del plain
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        pairs = group.filter(pc.is_valid(group.column("left")))
        out = []
        for left, right in sorted(zip(pairs.column("left").to_pylist(), pairs.column("right").to_pylist())):
            own = [(y, s) for y in right for s in sets.get(y, ())]
            flat = np.concatenate([s for _, s in own]) if own else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for _, s in own], dtype=np.int64)])
            for x in left:
                if root(x) == root(right[0]):
                    continue
                for z in sets.get(x, ()):
                    k = first_similar(z, flat, ends, percent)
                    if k >= 0:
                        a, b = sorted((x, own[k][0]))
                        ra, rb = root(a), root(b)
                        top[max(ra, rb)] = min(ra, rb)
                        out.append((a, b))
                        break
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    links = common.materialize(common.dealt(rows, "g", groups * GROUP_BYTES).groupBy("g").applyInArrow(common.grouped(check), "a long, b long"), "links")
    common.discard(texts)
    return links


def _documents(blocks: DataFrame, *keys: str) -> DataFrame:
    """The documents of blocks, by keys; those of a hub once, however many blocks it is in."""
    hubs = blocks.select(*keys, "hub", "right").dropDuplicates([*keys, "hub"])
    return hubs.select(*keys, F.explode("right").alias("node")).unionByName(blocks.select(*keys, F.explode("left").alias("node")))


def _packed(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Compressed texts (node, packed) of the blocks' documents. A map of fixed size drops most others before the join."""
    wanted = _documents(blocks).select("node").distinct()
    place = F.pmod(F.xxhash64("node"), F.lit(1 << WANTED_BITS))
    words = wanted.select(F.floor(place / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit"))
    bits = np.zeros((1 << WANTED_BITS) // 64, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # one row for each word of the map at most
        bits[r["word"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = np.asarray(batch.column("place"), dtype=np.int64)
            batch = batch.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 > 0))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([z.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["node", "packed"])

    # the same way at every size: the ids are the side that is hashed
    return docs.select("node", "text", place.alias("place")).mapInArrow(pack, "node long, packed binary").join(wanted.hint("shuffle_hash"), "node", "left_semi")


def _shared_ids(linked: DataFrame) -> DataFrame:
    """Edges between the representatives of sets that rows with one doc_id have. linked: node, rep."""
    reps = linked.select("node", "rep").distinct()
    least = reps.groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).filter("a < top").select("node", "a")
    return reps.join(least, "node").filter("rep > a").select("a", F.col("rep").alias("b")).distinct()


#: Parts into which rows of one set are split where its representative is sought and told.
SET_PARTS = 64


def _sets(own: DataFrame) -> DataFrame:
    """(fp, fq, parts, rep): the least document of each set and the parts that have rows of it; a set of very many rows is gathered part by part."""
    parts = own.groupBy("fp", "fq", "part").agg(F.min("node").alias("least"))
    return parts.groupBy("fp", "fq").agg(F.min("least").alias("rep"), F.collect_list("part").alias("parts"))


def _told(own: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The rows with columns of their sets."""
    return own.join(sets.select("fp", "fq", F.explode("parts").alias("part"), *columns), ["fp", "fq", "part"])


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Each row of documents as doc_id, tie (a hash of its text), n_shingles and component_id.

    Null and blank texts have no shingles and are linked with nothing: their component is their own id. A null doc_id
    counts as the least id and is returned as null; rows with one doc_id are one document in the links, whatever their
    texts. Equal texts share a set and so a component. Texts of any length are taken whole. Other columns are ignored.
    """
    common.tune(docs)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("node"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    first = common.materialize(_first_pass(docs, size), "sets")
    own = first.filter("node is not null")
    shingles, rows = own.agg(F.sum("n"), F.count("*")).first()
    counts = sketch.collected(first.filter("slice is not null").select("slice", "task", "blob"))
    buckets = max(1, -(-(shingles or 0) * 4 // BUCKET_BYTES))
    bare = _lists(docs, counts, buckets, size, percent)
    lists = common.materialize(_with_totals(bare), "lists")
    common.discard(bare)
    stars = common.materialize(_star_pairs(lists, percent), "pairs")
    found = _verified(stars, docs, size, percent)
    # documents with one set have one node in the lists, whichever they are
    full = own.filter("n > 0").withColumn("part", F.pmod(F.xxhash64("node", "tie"), F.lit(SET_PARTS)))
    sets = common.materialize(_sets(full), "sets")
    labels = common.materialize(graph.components(found), "labels")
    rest = _rest_pairs(lists, labels, percent)
    more = _verified(rest, docs, size, percent)
    final = graph.components(found.unionByName(more).unionByName(_shared_ids(_told(full, sets, "rep"))))
    final = common.materialize(final, "labels")
    for done in (lists, stars, rest, labels, found, more):
        common.discard(done)
    classed = sets.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "fq", "parts", F.coalesce("component", "rep").alias("least"))
    linked = _told(full, classed, "least").select("node", "tie", "n", F.least("node", "least").alias("component"))
    alone = own.filter("n = 0").select("node", "tie", "n", F.col("node").alias("component"))
    out = linked.unionByName(alone)
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(back("node").alias("doc_id"), "tie", F.col("n").alias("n_shingles"), back("component").alias("component_id"))
