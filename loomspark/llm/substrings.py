"""Removal of long byte strings that a document with a smaller id has too, by suffix arrays where such strings can be.

1. counts    a sketch of fixed size counts seeds: each string of LENGTH bytes chooses its seed of least hash
2. seeds     seeds go to buckets by their hash; those of two texts or more are reported to the documents' groups. Equal texts
             are found by their digest: all but the first lose all, and take no part in what follows
3. pieces    the strings around a shared seed are one piece, sent to a bucket by the seed; a piece that several documents
             of a group have is sent once. Around a very frequent seed (by the sketch, so that all agree) each string is a
             piece of its own and goes by its own bytes, so no bucket gathers all that surrounds a common passage.
4. refine    each bucket sorts its distinct pieces' suffixes by bucket pointers; strings in one final bucket are equal, and
             the least document among them keeps its own
5. remove    the ranges found are united in each document

The texts are dealt to groups of bounded size once; steps 3 and 5 share that exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sketch

#: Bytes of a string that counts, and of the seed that each such string chooses.
LENGTH, SEED = 50, 20
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of texts in a group, bytes of texts for a bucket of seeds and for a bucket of pieces.
GROUP_BYTES, SEED_BYTES, PIECE_BYTES = 4 << 20, 24 << 20, 3 << 20
#: Bytes of texts whose seeds one row of blobs holds.
SLICE_BYTES = 4 << 20
#: Bytes of texts whose seeds are chosen at once.
RUN_BYTES = 512 << 10
#: A seed is very frequent from so many places on, and from so many times the mean of a counter.
FREQUENT, TIMES_MEAN = 2000, 8
#: Stands for a null doc_id, which counts as less than all others.
NULL_ID = -(1 << 63)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    if 0 not in _powers or len(_powers[0][0]) < n:
        size = max(n, RUN_BYTES + 1)
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        step, back, have = BASE, pow(BASE, -1, 1 << 64), 1
        while have < size:
            take = min(have, size - have)
            np.multiply(up[:take], np.uint64(step), out=up[have : have + take])
            np.multiply(down[:take], np.uint64(back), out=down[have : have + take])
            have, step, back = have + take, step * step % (1 << 64), back * back % (1 << 64)
        _powers[0] = up, down
    return _powers[0]


def _runs(data: np.ndarray, offs: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds chosen by the strings of `length` bytes of each text: (hash, place of the seed, first and last string that chose it).

    Every string chooses its seed of least hash, the first of several; so equal strings choose equal seeds at the same
    distance, and neighbours mostly share one. No string crosses texts.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    up, down = _power(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    h = prefix[seed:] - prefix[:-seed]
    h *= down[: len(h)]
    del prefix
    h = common.mix(h)
    # the place in the low bits makes the first of equal hashes the least
    bits = np.uint64(max(1, int(n).bit_length()))
    low = h >> bits << bits
    low |= np.arange(len(h), dtype=np.uint64)
    width, span = length - seed + 1, 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    long = np.diff(offs) >= length
    np.add.at(valid, offs[:-1][long], 1)
    np.add.at(valid, offs[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1])[: len(place)] > 0)
    place = place[at]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(at)) - 1
    return h[place[new]], place[new], at[new], at[last] if len(at) else at


def runs_of(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_runs over some texts at a time, so that its arrays stay small whatever the batch."""
    parts, at, n = [], 0, len(offs) - 1
    while at < n:
        end = min(max(int(np.searchsorted(offs, offs[at] + RUN_BYTES, "right")) - 1, at + 1), n)
        h, place, first, last = _runs(data[offs[at] : offs[end]], offs[at : end + 1] - offs[at], length, seed)
        parts.append((h, place + offs[at], first + offs[at], last + offs[at]))
        at = end
    if not parts:
        return _runs(data[:0], offs[:1], length, seed)
    return tuple(np.concatenate(x) for x in zip(*parts))


def refine(data: np.ndarray, left: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers after `length` bytes: equal for the places of data from which equal strings of that length begin.

    left: bytes from each place to the end of its piece; places with fewer than `length` get -1. Buckets of the first
    eight bytes are refined by sorting each on the pointers of the places `depth` further on; pointers that a pass has
    updated serve the next one, which so looks twice as far. A bucket of one place is finished and is never sorted again.
    """
    n = len(data)
    pointer = np.full(n, -1, np.int32)
    depth = min(8, length)
    live = np.flatnonzero(left >= depth).astype(np.int32)
    key = np.zeros(len(live), np.uint64)
    for k in range(depth):
        key <<= np.uint64(8)
        key |= data[live + np.int32(k)]
    pointer[live] = _ranks(key)
    while depth < length:
        step = min(depth, length - depth)
        size = np.bincount(pointer[live])
        live = live[left[live] >= depth + step]
        crowded = size[pointer[live]] > 1
        again, lone = live[crowded], live[~crowded]
        pair = pointer[again].astype(np.int64) << np.int64(32) | pointer[again + np.int32(step)]
        new = np.full(n, -1, np.int32)
        new[again] = _ranks(pair)
        new[lone] = np.arange(len(lone)) + (int(new.max(initial=-1)) + 1)
        pointer, depth = new, depth + step
    return pointer


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), np.int32)
    if len(keys):
        out[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1], dtype=np.int32)])
    return out


def covered_strings(data: np.ndarray, sizes: np.ndarray, first_doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For pieces behind one another, of sizes bytes: at which places a string begins that a smaller document's piece has too.

    first_doc: the least document that has the piece.
    """
    ends = np.cumsum(sizes)
    pointer = refine(data, (np.repeat(ends, sizes) - np.arange(len(data))).astype(np.int32), length)
    at = np.flatnonzero(pointer >= 0)
    owner = np.repeat(first_doc, np.maximum(sizes - length + 1, 0))
    order = np.argsort(pointer[at], kind="stable")
    s = pointer[at][order]
    hit = np.zeros(len(data), bool)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        least = np.minimum.reduceat(owner[order], first)
        hit[at[order]] = np.repeat(least, np.diff(np.append(first, len(s)))) < owner[order]
    return hit


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("node"), dtype=np.int64), np.asarray(batch.column("tie"), dtype=np.int64)


def _count(docs: DataFrame, length: int, seed: int) -> np.ndarray:
    def run(batches):
        counts, task = sketch.empty(), TaskContext.get().partitionId()
        for batch in common.slices(batches, "text", SLICE_BYTES):
            sketch.add(counts, runs_of(*common.raw(common.as_text(batch.column("text"))), length, seed)[0])
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(sketch.packed(counts, task), (pa.int32(), pa.int64(), pa.binary()))], ["slice", "task", "blob"])

    return sketch.collected(docs.select("text").mapInArrow(run, sketch.SCHEMA))


def _by_group(group: np.ndarray, node: np.ndarray, tie: np.ndarray, row: np.ndarray, *values: np.ndarray):
    """(group, blob) for entries of documents: the group's own documents, the entries' places among them, their values."""
    order = np.lexsort((row, group[row]))
    row, values = row[order], [v[order] for v in values]
    g = group[row]
    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
    for lo, hi in zip(cut, [*cut[1:], len(g)]):
        used, at = np.unique(row[lo:hi], return_inverse=True)
        yield int(g[lo]), common.pack(node[used], tie[used], at.astype(np.uint32), *(v[lo:hi] for v in values))


def _shared_seeds(docs: DataFrame, frequent, total: int, length: int, seed: int) -> DataFrame:
    """(g, blob): by group of documents the places of seeds that two documents or more have; very frequent ones are left out."""
    buckets = max(1, -(-total // SEED_BYTES))

    def emit(batches):
        for batch in common.slices(batches, "text", SLICE_BYTES):
            data, offs = common.raw(common.as_text(batch.column("text")))
            node, tie = _ids(batch)
            group = np.asarray(batch.column("g"), dtype=np.int64)
            h, place, _, _ = runs_of(data, offs, length, seed)
            keep = ~frequent.value.of(h)
            h, place = h[keep], place[keep]
            row = np.searchsorted(offs, place, "right") - 1
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order, parts = common.present(bucket)
            found, blobs = [], []
            for b, lo, hi in parts:
                at = order[lo:hi]
                used, doc = np.unique(row[at], return_inverse=True)
                low = h[at] & np.uint64((1 << 40) - 1)
                start = place[at] - offs[row[at]]
                found.append(b)
                # places ascend in each document, so their differences are small
                step = np.diff(start, prepend=0)
                blobs.append(common.pack(node[used], tie[used], group[used].astype(np.uint32), doc.astype(np.uint16 if len(used) < 65536 else np.uint32), (low >> np.uint64(32)).astype(np.uint8), low.astype(np.uint32), step.astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        base = 0
        for blob in table.column("blob"):
            node, tie, group, doc, high, low, step = common.unpack(blob.as_py())
            for x, v in zip(parts, (node, tie, group, doc.astype(np.uint32) + np.uint32(base), (high.astype(np.uint64) << np.uint64(32)) | low, np.cumsum(step).astype(np.uint32))):
                x.append(v)
            base += len(node)
        node, tie, group, row, h, start = (np.concatenate(x) for x in parts)
        parts.clear()
        order = np.argsort(h, kind="stable").astype(np.uint32)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(first, len(h)))
        del h
        # copies of one text are known as such, so a seed matters if two texts have it
        t = tie[row[order]]
        shared = np.minimum.reduceat(t, first) < np.maximum.reduceat(t, first)
        del t, first
        keep = order[np.repeat(shared, times)]
        del order, times, shared
        rows = list(_by_group(group.astype(np.int64), node, tie, row[keep], start[keep]))
        return pa.table({"g": pa.array([g for g, _ in rows], pa.int64()), "blob": pa.array([b for _, b in rows], pa.binary())})

    sent = docs.select("node", "tie", "g", "text").mapInArrow(emit, "bucket int, blob binary")
    return common.dealt(sent, "bucket", total).groupBy("bucket").applyInArrow(common.grouped(meet), "g long, blob binary")


class Frequent:
    """Which seeds are very frequent, by the corpus's sketch: the same answer everywhere."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.least = max(FREQUENT, TIMES_MEAN * float(counts.sum(dtype=np.float64)) / len(counts))

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.counts[sketch.place(h)] >= self.least


def _slots(node: np.ndarray, tie: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Entries of all blobs of a group, with each document as its row in the group's table; values as they are."""
    where: dict[tuple[int, int], int] = {}
    for k, key in enumerate(zip(node.tolist(), tie.tolist())):
        where.setdefault(key, k)
    rows, values = [], []
    for blob in blobs:
        n, t, at, *rest = common.unpack(blob)
        mine = np.array([where[key] for key in zip(n.tolist(), t.tolist())], np.int64)
        rows.append(mine[at])
        values.append(rest)
    if not rows:
        return (np.zeros(0, np.int64),)
    return (np.concatenate(rows), *(np.concatenate(v) for v in zip(*values)))


def _copies(node: np.ndarray, tie: np.ndarray, table: pa.Table) -> np.ndarray:
    """Which documents of a group the table names as copies of an earlier one."""
    held = table.filter(pc.is_valid(table.column("node")))
    keys = set(zip(held.column("node").to_pylist(), held.column("tie").to_pylist()))
    return np.array([key in keys for key in zip(node.tolist(), tie.tolist())], bool)


def _pieces(texts: pa.Table, seeds: pa.Table, frequent: Frequent, buckets: int, length: int, seed: int) -> pa.Table:
    """(bucket, blob): the distinct pieces of a group with the places that have them."""
    out: dict[str, list] = {"bucket": [], "blob": []}
    if texts.num_rows:
        g = texts.column("g")[0].as_py()
        node, tie = _ids(texts)
        column = common.as_text(texts.column("text"))
        row, *start = _slots(node, tie, [x for x in seeds.column("blob").to_pylist() if x is not None])
        copies = _copies(node, tie, seeds)
        data, offs = common.raw(column)
        wanted = np.unique(offs[row] + start[0]) if start else np.zeros(0, np.int64)
        # equal rows (one id, one text) are found as the first of them
        h, place, lo, hi = runs_of(data, offs, length, seed)
        often = frequent.of(h)
        keep = (often | np.isin(place, wanted)) & ~copies[np.searchsorted(offs, lo, "right") - 1]
        h, lo, hi, often = h[keep], lo[keep], hi[keep], often[keep]
        n = hi[often] - lo[often] + 1
        single = np.repeat(lo[often] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        lo, hi = np.concatenate([lo[~often], single]), np.concatenate([hi[~often], single])
        h = np.concatenate([h[~often], np.zeros(len(single), np.uint64)])
        view, digest = memoryview(data), xxhash.xxh3_64_intdigest
        text = [view[a:b] for a, b in zip(lo.tolist(), (hi + length).tolist())]
        own = np.fromiter(map(digest, text), np.uint64, len(lo))
        h[len(h) - len(single) :] = common.mix(own[len(h) - len(single) :])
        doc = np.searchsorted(offs, lo, "right") - 1
        bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order, parts = common.present(bucket, own)
        for b, begin, end in parts:
            at = order[begin:end]
            new = np.concatenate([[True], own[at[1:]] != own[at[:-1]]])
            for k in np.flatnonzero(~new).tolist():  # the digest is only a guess
                new[k] = text[at[k]] != text[at[k - 1]]
            used, local = np.unique(doc[at], return_inverse=True)
            kept = at[new]
            plain = np.frombuffer(b"".join([text[k] for k in kept.tolist()]), np.uint8)
            out["bucket"].append(b)
            out["blob"].append(common.pack(np.array([g]), node[used], tie[used], local.astype(np.uint32), (np.cumsum(new) - 1).astype(np.uint32), (lo[at] - offs[doc[at]]).astype(np.uint32), (hi[kept] - lo[kept]).astype(np.uint8 if length <= 256 else np.uint32), plain, level=3))
    return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})


def _covered(table: pa.Table, length: int) -> pa.Table:
    """(g, blob): by group of documents the ranges of bytes that a smaller document has."""
    parts: list[list[np.ndarray]] = [[] for _ in range(8)]
    n_docs = n_pieces = 0
    for blob in table.column("blob"):
        g, node, tie, doc, piece, start, wide, text = common.unpack(blob.as_py())
        for x, v in zip(parts, (np.repeat(g, len(node)), node, tie, doc.astype(np.int64) + n_docs, piece.astype(np.int64) + n_pieces, start.astype(np.int64), wide.astype(np.int64), text)):
            x.append(v)
        n_docs, n_pieces = n_docs + len(node), n_pieces + len(wide)
    group, node, tie, doc, which, start, wide, text = (np.concatenate(x) for x in parts)
    parts.clear()
    # equal pieces of several groups become one, by all their bytes
    plain, cuts = text.tobytes(), np.concatenate([[0], np.cumsum(wide + length)])
    known: dict[bytes, int] = {}
    same = np.array([known.setdefault(plain[a:b], len(known)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], np.int64)
    del plain
    text = np.frombuffer(b"".join(known), np.uint8)
    one = np.zeros(len(known), np.int64)
    one[same] = np.arange(len(same))
    known.clear()
    wide, piece = wide[one], same[which]
    first = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(first, piece, node[doc])
    hit = covered_strings(text, wide + length, first, length)
    # ranges of bytes of each piece that are covered in its least document
    cuts = np.concatenate([[0], np.cumsum(wide + length)])
    flag = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(flag > 0), np.flatnonzero(flag < 0) + length - 1
    of = np.searchsorted(cuts, begin, "right") - 1
    spans = np.searchsorted(of, np.arange(len(one) + 1))
    later = node[doc] > first[piece]
    row, lo, hi = [doc[later]], [start[later]], [start[later] + wide[piece[later]] + length]
    some = np.flatnonzero(~later)
    at, ends = common.gather(spans, piece[some])
    mine = np.repeat(some, np.diff(ends))
    row.append(doc[mine])
    lo.append(start[mine] + begin[at] - cuts[of[at]])
    hi.append(start[mine] + end[at] - cuts[of[at]])
    row, lo, hi = (np.concatenate(x) for x in (row, lo, hi))
    rows = list(_by_group(group, node, tie, row, lo.astype(np.uint32), hi.astype(np.uint32)))
    return pa.table({"g": pa.array([g for g, _ in rows], pa.int64()), "blob": pa.array([b for _, b in rows], pa.binary())})


def _remove(texts: pa.Table, ranges: pa.Table, passed: list[str], length: int, as_text: bool) -> pa.Table:
    node, tie = _ids(texts)
    data, offs = common.raw(common.as_text(texts.column("text")))
    row, *ends = _slots(node, tie, [x for x in ranges.column("blob").to_pylist() if x is not None])
    change = np.zeros(len(data) + 1, np.int32)
    whole = np.flatnonzero(_copies(node, tie, ranges) & (np.diff(offs) >= length))
    np.add.at(change, offs[whole], 1)
    np.add.at(change, offs[whole + 1], -1)
    if ends:
        # ranges of one document never leave it, so one count over the whole group serves
        np.add.at(change, offs[row] + ends[0], 1)
        np.add.at(change, offs[row] + ends[1], -1)
    gone = np.cumsum(change[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    begins = gone & np.concatenate([[True], ~gone[:-1]])[: len(gone)]
    starts_of_doc = offs[:-1][np.diff(offs) > 0]
    begins[starts_of_doc] = gone[starts_of_doc]
    spans = np.concatenate([[0], np.cumsum(begins)])
    kept = data[~gone].tobytes()
    cut = (offs - total[offs]).tolist()
    first: dict[tuple[int, int], int] = {}
    source = [first.setdefault(key, k) for k, key in enumerate(zip(node.tolist(), tie.tolist()))]
    rest = [kept[cut[k] : cut[k + 1]] for k in source]
    source = np.array(source, np.int64)
    columns = {c: texts.column(c) for c in passed} | {
        "n_bytes": pa.array(np.diff(offs), pa.int64()),
        "n_removed": pa.array(np.diff(total[offs])[source], pa.int64()),
        "n_spans": pa.array(np.diff(spans[offs])[source], pa.int64()),
        "kept": pa.array([x.decode("utf-8", "ignore") for x in rest], pa.string()) if as_text else pa.array(rest, pa.binary()),
    }
    return pa.table(columns)


RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")
#: Parts into which rows of one text are split before their least id is sought and told.
COPY_PARTS = 64


def _later_copies(keyed: DataFrame) -> DataFrame:
    """(g, node, tie) of the rows whose text a row with a lesser id has too.

    A text that very many rows have is looked at in COPY_PARTS parts; texts of one row take no part in the join.
    """
    slim = keyed.select("node", "tie", "g", F.sha2("text", 256).alias("digest"), F.pmod(F.xxhash64("node", "tie"), F.lit(COPY_PARTS)).alias("part"))
    parts = slim.groupBy("digest", "part").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    whole = parts.groupBy("digest").agg(F.min("least").alias("first"), F.max("most").alias("last"), F.collect_list("part").alias("parts"))
    firsts = whole.filter("first < last").select("digest", "first", F.explode("parts").alias("part"))
    return slim.join(firsts, ["digest", "part"]).filter("node > first").select("g", "node", "tie").distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, as_text: bool = False) -> DataFrame:
    """Each row of documents with n_bytes, n_removed, n_spans and kept (the remaining bytes); all other columns but text stay.

    With as_text kept is a string, without the characters of which only a part remains.
    Columns that already have one of the four names are replaced. A byte goes if a string of `length` bytes that covers it
    also begins in a document with a smaller doc_id, in the texts as they were. Null texts count as empty, texts shorter
    than `length` lose nothing, and texts of any length are taken whole. A null doc_id counts as the least, as does the
    least 64-bit number. Rows with one doc_id do not affect each other. An empty table gives an empty one.
    """
    common.tune(docs)
    columns = [c for c in docs.columns if c != "text" and c not in RESULTS]
    passed = [f"c{k}" for k in range(len(columns))]  # so no name meets one of the steps'
    keyed = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(columns, passed)), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("node"), F.xxhash64("text").alias("tie"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = keyed.withColumn("g", F.pmod(F.xxhash64("node", "tie"), F.lit(max(1, -(-total // GROUP_BYTES)))))
    frequent = docs.sparkSession.sparkContext.broadcast(Frequent(_count(keyed, length, seed)))
    none = F.lit(None).cast("long")
    seeds = _shared_seeds(keyed, frequent, total, length, seed).select("g", none.alias("node"), none.alias("tie"), "blob")
    seeds = common.materialize(seeds.unionByName(_later_copies(keyed).withColumn("blob", F.lit(None).cast("binary"))), "seeds")
    buckets = max(1, -(-total // PIECE_BYTES))

    def pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        return _pieces(left, right, frequent.value, buckets, length, seed)

    def covered(table: pa.Table) -> pa.Table:
        return _covered(table, length)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        return _remove(left, right, passed, length, as_text)

    texts = common.dealt(keyed, "g", total).groupBy("g")
    found = texts.cogroup(common.dealt(seeds, "g", total).groupBy("g")).applyInArrow(common.cogrouped(pieces), "bucket int, blob binary")
    ranges = common.dealt(found, "bucket", total).groupBy("bucket").applyInArrow(common.grouped(covered), "g long, blob binary").select("g", none.alias("node"), none.alias("tie"), "blob")
    ranges = common.dealt(ranges.unionByName(seeds.filter("node is not null")), "g", total)
    kinds = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(columns, passed))
    out = texts.cogroup(ranges.groupBy("g")).applyInArrow(common.cogrouped(remove), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    return out.select(*(F.col(p).alias(c) for c, p in zip(columns, passed)), *RESULTS)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
