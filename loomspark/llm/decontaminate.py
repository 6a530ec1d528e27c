"""Benchmark decontamination: rare word pairs join documents to test items, local alignment scores what surrounds them.

An item's seeds are pairs of words that stand next to each other or with one word between them; so are a document's. An
alignment that scores at least s of an item's n words keeps ceil(s n - 1) of the item's places whose pair some pair of the
document equals: between so many of its matches there is one edit at most. The item's most common pairs, by counts over all
documents, are no seeds, at half of that number of places; at least the rest must be found near one another before a
Smith-Waterman alignment of words scores the place between 0 and 1 (1: the whole item, in order). So every document that
aligns well enough is found, and what the counts are only decides how much is aligned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distances of the words of a pair, the part of an item's demanded places that may go without a seed.
GAPS, COMMON_PART = (1, 2), 0.5
#: Alignment scores, the least share of an item's best score, bytes of test items that are held at once.
MATCH, MISMATCH, GAP, LEAST_SCORE = 2, -1, -1, 0.5
BLOCK_BYTES = 8 << 20
#: Cells of alignment rows that are computed together.
CELLS = 1 << 18
#: Items of fewer words are found where all their words stand in order.
SHORT = 3
MARGINS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»‘’“”–—…"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without the signs around them, and n + 1 offsets; words of signs alone are left out."""
    import xxhash

    codes, offs, distinct = common.words_of(texts)
    digest, margins = xxhash.xxh3_64_intdigest, MARGINS
    names = np.fromiter((digest(x) if (x := w.lower().strip(margins)) else 0 for w in distinct.to_pylist()), np.uint64, len(distinct))
    words = names[codes]
    keep = words != 0
    return words[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def pairs(words: np.ndarray, offs: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of each word with the one `gap` further on in the same text."""
    if len(words) <= gap:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = np.ones(len(words), bool)
    for k in range(1, gap + 1):
        last = offs[1:] - k
        ok[last[last >= offs[:-1]]] = False
    at = np.flatnonzero(ok)
    return common.mix(words[at] * np.uint64(0x9E3779B97F4A7C15) + words[at + gap]), at


def demanded(n: np.ndarray, least: float) -> np.ndarray:
    """Places of an item of n words whose pair a text that scores `least` has too."""
    return np.maximum(np.ceil(least * n - 1 - 1e-9), 1).astype(np.int64)


def reach(n: np.ndarray, least: float) -> np.ndarray:
    """Words of a text that an alignment of such a score can take: 3 m - 2 s n with at most n matches m."""
    return np.ceil((3 - 2 * least) * n + 1e-9).astype(np.int64)


class Items:
    """Test items with an index from pair to its places in them."""

    def __init__(self, ids: list[int | None], texts: list[str], least: float = LEAST_SCORE):
        self.ids, self.known, self.least = np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], bool), least
        self.words, self.offs = tokens(pa.array(texts, pa.large_string()))
        self.size = n = np.diff(self.offs)
        self.short = [(k, {}) for k in range(1, SHORT)]
        for k, known in self.short:
            for i in np.flatnonzero(n == k).tolist():
                known.setdefault(self.words[self.offs[i] : self.offs[i + 1]].tobytes(), []).append(i)
        owner = np.repeat(np.arange(len(ids)), n)
        found = [pairs(self.words, self.offs, g) for g in GAPS]
        keys, place = (np.concatenate(x) for x in zip(*found))
        keep = n[owner[place]] >= SHORT
        keys, place = keys[keep], place[keep]
        order = np.argsort(keys, kind="stable")
        self.entries, self.place = keys[order], place[order]
        self.item = owner[self.place]
        self.need = demanded(n, least)
        self._index()

    def _index(self) -> None:
        self.keys, self.first = np.unique(self.entries, return_index=True)
        self.ends = np.append(self.first[1:], len(self.entries))
        self.mask = np.zeros(1 << 22, bool)
        self.mask[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of grams that are among the items', and which key each is."""
        some = np.flatnonzero(self.mask[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(some) or not len(self.keys):
            return some[:0], some[:0]
        at = np.minimum(np.searchsorted(self.keys, grams[some]), len(self.keys) - 1)
        ok = self.keys[at] == grams[some]
        return some[ok], at[ok]

    def whole(self, words: np.ndarray, offs: np.ndarray):
        """(row, item, begin, words) of the first place of each short item in each text that holds it."""
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        for k, known in self.short:
            if not known or len(words) < k:
                continue
            first = np.unique(np.array([np.frombuffer(x, np.uint64)[0] for x in known], np.uint64))
            at = np.flatnonzero(np.isin(words[: len(words) - k + 1], first))
            at = at[row[at] == row[at + k - 1]]
            seen: set[tuple[int, bytes]] = set()
            for p, r in zip(at.tolist(), row[at].tolist()):
                key = words[p : p + k].tobytes()
                if key in known and (r, key) not in seen:
                    seen.add((r, key))
                    yield from ((r, i, p - int(offs[r]), k) for i in known[key])

    def keep_rare(self, counts: np.ndarray) -> None:
        """counts: of each key in the corpus. Drops the pairs of each item's most common places, and demands as many fewer."""
        load = np.zeros(len(self.words), np.int64)
        np.add.at(load, self.place, counts[np.repeat(np.arange(len(self.keys)), self.ends - self.first)])
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.lexsort((-load, owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - self.offs[owner[order]]
        spare = (COMMON_PART * (self.need - 1)).astype(np.int64)
        keep = (rank >= spare[owner])[self.place]
        self.entries, self.place, self.item = self.entries[keep], self.place[keep], self.item[keep]
        self.need = self.need - spare
        self._index()


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each item against its window, and the place in the window behind the last aligned word."""
    n, m, w = len(items), max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((n, m), np.uint64), np.ones((n, w), np.uint64)
    for k in range(n):
        a[k, : len(items[k])] = items[k]
        b[k, : len(windows[k])] = windows[k]
    far = np.arange(w, dtype=np.int32) * -GAP
    row, top, end = np.zeros((n, w), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(m):
        step = np.where(a[:, i : i + 1] == b, MATCH, MISMATCH).astype(np.int32)
        step[:, 1:] += row[:, :-1]
        np.maximum(step, row + GAP, out=step)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + far, axis=1) - far
        best = row.argmax(axis=1)
        value = row[np.arange(n), best]
        better = value > top
        top[better], end[better] = value[better], best[better] + 1
    return top, end


def _tiles(words: np.ndarray, offs: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, begin, end) of the stretches of texts in which enough of an item's places have a pair.

    Stretches are twice as long as an alignment can be and begin every such length, so that each alignment lies in one whole.
    """
    found = []
    for g in GAPS:
        grams, at = pairs(words, offs, g)
        hit, key = items.hits(grams)
        n = items.ends[key] - items.first[key]
        entry = np.repeat(items.first[key] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        found.append(np.stack([np.repeat(at[hit], n), items.item[entry], items.place[entry]]))
    at, item, place = np.concatenate(found, axis=1)
    row = np.searchsorted(offs, at, "right") - 1
    step = reach(items.size, items.least)[item]
    tile = (at - offs[row]) // step
    row, item, place, tile = (np.concatenate([x, y[tile > 0]]) for x, y in ((row, row), (item, item), (place, place), (tile, tile - 1)))
    if not len(row):
        return row, item, row, row
    order = np.lexsort((place, tile, item, row))
    row, item, place, tile = row[order], item[order], place[order], tile[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (tile[1:] != tile[:-1])])
    first = np.flatnonzero(new)
    different = np.add.reduceat((new | np.concatenate([[True], place[1:] != place[:-1]])).astype(np.int64), first)
    first = first[different >= items.need[item[first]]]
    row, item, tile = row[first], item[first], tile[first]
    step = reach(items.size, items.least)[item]
    begin = offs[row] + tile * step
    return row, item, begin, np.minimum(begin + 2 * step, offs[row + 1])


def find(texts: pa.Array, items: Items) -> dict[str, np.ndarray]:
    """For each text and item that align well enough: row, item, score, begin and end (in the text's words); of several places the best, then the first."""
    words, offs = tokens(texts)
    row, item, lo, hi = _tiles(words, offs, items)
    out: dict[str, list] = {c: [] for c in ("row", "item", "score", "begin", "end")}
    order = np.lexsort((hi - lo, items.size[item]))  # what is alike in size together
    at = 0
    while at < len(order):
        most = np.maximum.accumulate((hi - lo)[order[at : at + CELLS]])
        end = at + max(1, int(np.searchsorted(most * np.arange(1, len(most) + 1), CELLS, "right")))
        some = order[at:end]
        at = end
        own = [items.words[items.offs[i] : items.offs[i + 1]] for i in item[some].tolist()]
        seen = [words[a:b] for a, b in zip(lo[some].tolist(), hi[some].tolist())]
        top, last = align(own, seen)
        score = top / (MATCH * items.size[item[some]])
        good = np.flatnonzero(score >= items.least)
        if len(good):
            _, far = align([own[g][::-1] for g in good], [seen[g][: last[g]][::-1] for g in good])
            for g, f in zip(good.tolist(), far.tolist()):
                k = some[g]
                stop = int(lo[k] - offs[row[k]]) + int(last[g])
                for c, v in zip(out, (int(row[k]), int(item[k]), float(score[g]), stop - f, stop)):
                    out[c].append(v)
    for r, i, begin, k in items.whole(words, offs):
        for c, v in zip(out, (r, i, 1.0, begin, begin + k)):
            out[c].append(v)
    found = {c: np.array(v, np.float64 if c == "score" else np.int64) for c, v in out.items()}
    order = np.lexsort((found["begin"], -found["score"], found["item"], found["row"]))
    found = {c: v[order] for c, v in found.items()}
    if len(order):
        best = np.concatenate([[True], (found["row"][1:] != found["row"][:-1]) | (found["item"][1:] != found["item"][:-1])])
        found = {c: v[best] for c, v in found.items()}
    return found


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items (item_id, text) in blocks of bounded size; a larger benchmark gives more blocks, never a larger one."""
    items = common.tune(benchmark).select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * total // BLOCK_BYTES)
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def seeds(docs: DataFrame, block: DataFrame, least: float) -> Items:
    """The block's items with their rare pairs, by counts over all documents."""
    rows = sorted((r["item_id"] is not None, r["item_id"] or 0, r["text"]) for r in block.collect())  # bounded by BLOCK_BYTES
    items = Items([r[1] if r[0] else None for r in rows], [r[2] for r in rows], least)
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches):
        total = np.zeros(len(shared.value.keys), np.int64)
        for batch in common.slices(batches, "text"):
            words, offs = tokens(common.as_text(batch.column("text")))
            for g in GAPS:
                total += np.bincount(shared.value.hits(pairs(words, offs, g)[0])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["key", "n"])

    counts = np.zeros(len(items.keys), np.int64)
    found = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    for r in found.collect():  # a row for each pair of the block at most
        counts[r["key"]] = r["n"]
    items.keep_rare(counts)
    shared.unpersist()
    return items


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Pairs of a document and a test item that it holds, whole or edited: doc_id, item_id, score, begin, end (words).

    Null and empty texts match nothing. Items of one or two words match where they stand whole. Equal rows match alike,
    and null ids of documents and items come back as null. Of several places for one item the best counts, then the
    first. Texts of any length are read whole; other columns are ignored; no items or no documents give no rows.
    """
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, begin long, end long")
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(seeds(docs, block, least))

        def run(batches, shared=shared):
            for batch in common.slices(batches, "text"):
                items = shared.value
                m = find(common.as_text(batch.column("text")), items)
                ids = batch.column("doc_id").cast(pa.int64()).take(pa.array(m["row"]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(items.ids[m["item"]], mask=~items.known[m["item"]]), *(pa.array(m[c]) for c in ("score", "begin", "end"))], ["doc_id", "item_id", "score", "begin", "end"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, out.schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents that hold no test item, all columns as they are. What one block of items leaves is written before the next."""
    every = docs
    for k, block in enumerate(blocks(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(seeds(every, block, least))

        def run(batches, shared=shared):
            for batch in common.slices(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[find(common.as_text(batch.column("text")), shared.value)["row"]] = False
                yield batch.filter(pa.array(keep))

        docs = (common.materialize(docs, "left") if k else docs).mapInArrow(run, docs.schema)
    return docs
