"""Quality rules on repetition inside a document, by a suffix array over its words.

Suffixes are ranked by prefix doubling; the common prefix of neighbours in suffix order comes from the same ranks. Runs of
neighbours that share a prefix are the longest-common-prefix intervals: each is a substring that occurs as often as the
interval has suffixes, and it is a maximal repeat if its occurrences differ in the word before. The spans of all
occurrences of maximal repeats of MIN_REPEAT words or more are united; the covered fraction and the longest repeat are
limited. Short repeats count too, so a text of words that are each said four times is rejected, which has no window of five words
twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

#: Words of the windows of the base rule, and the base rule's limits.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
#: A repeat counts from so many words on; the verdict's limits.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 3, 0.50, 60
#: Words of texts that share one suffix array; a longer text has one of its own.
ARRAY_WORDS = 150_000
SYMBOLS = b"#*$%&|<>"


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a sequence, and the common prefix of each suffix with the one before it in that order (first: 0).

    Ranks of all doublings are held: 4 bytes a word for each doubling of the longest repeat.
    """
    n = len(codes)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int64)
    rank = (np.unique(codes, return_inverse=True)[1] + 1).astype(np.int32)
    levels, k = [(1, rank)], 1
    while k < n and rank.max() < n:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - k] += rank[k:]
        rank = (np.unique(key, return_inverse=True)[1] + 1).astype(np.int32)
        k *= 2
        levels.append((k, rank))
    order = np.argsort(rank, kind="stable")
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for k, rank in reversed(levels):
        inside = np.flatnonzero((a + k <= n) & (b + k <= n))
        same = inside[rank[a[inside]] == rank[b[inside]]]
        lcp[same] += k
        a[same] += k
        b[same] += k
        if k == 1:
            break
        a, b = np.minimum(a, n), np.minimum(b, n)
    return order, np.concatenate([[0], lcp])


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest-common-prefix intervals of the suffix order with a length of at least `least`: (first, last, length), and the interval of each place of lcp that has its length (-1: none).

    Only places with a common prefix of that length are visited.
    """
    firsts: list[int] = []
    lasts: list[int] = []
    lengths: list[int] = []
    owner = np.full(len(lcp), -1, np.int64)
    at = np.flatnonzero(lcp >= least)
    stack: list[int] = []
    before = -2
    own = []
    for i, h in zip(at.tolist(), lcp[at].tolist()):
        if i != before + 1:  # all that are open end with the run
            for k in stack:
                lasts[k] = before
            stack.clear()
        first = i - 1
        while stack and lengths[stack[-1]] > h:
            k = stack.pop()
            lasts[k], first = i - 1, firsts[k]
        if not stack or lengths[stack[-1]] < h:
            stack.append(len(lengths))
            firsts.append(first)
            lengths.append(h)
            lasts.append(i)
        own.append(stack[-1])
        before = i
    for k in stack:
        lasts[k] = before
    owner[at] = own
    return np.array(firsts, np.int64), np.array(lasts, np.int64), np.array(lengths, np.int64), owner


def maximal(codes: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, last, length) of the intervals, whether each is a maximal repeat, and the deepest interval of each place of the order (-1: none)."""
    order, lcp = suffix_array(codes)
    first, last, length, owner = intervals(lcp, least)
    # a repeat can be lengthened to the left if the word before is one and the same everywhere; a text's first word has none
    prior = np.where(order > 0, codes[order - 1], -1) if len(codes) else order
    change = np.concatenate([[0], np.cumsum((prior[1:] != prior[:-1]) | (prior[1:] < 0))]) if len(codes) else order
    wide = change[last] > change[first] if len(first) else np.zeros(0, bool)
    after, held = np.append(lcp[1:], 0), np.append(owner[1:], -1)
    deepest = np.where(after > lcp, held, owner) if len(codes) else owner
    return order, first, last, length, wide, deepest


def maximal_repeats(codes: np.ndarray, least: int = MIN_REPEAT) -> list[tuple[int, list[int]]]:
    """(length, starts) of every substring that occurs twice and can't be lengthened on either side in all its occurrences."""
    order, first, last, length, wide, _ = maximal(codes, least)
    return [(int(length[k]), sorted(order[first[k] : last[k] + 1].tolist())) for k in np.flatnonzero(wide).tolist()]


def repeated(codes: np.ndarray, least: int = MIN_REPEAT) -> np.ndarray:
    """For each position the length of the longest maximal repeat that begins there (0: none of `least` words).

    The spans of these cover all that maximal repeats cover: what else begins at a position is shorter.
    """
    order, _, _, length, wide, deepest = maximal(codes, least)
    reach = np.zeros(len(codes), np.int64)
    some = np.flatnonzero(deepest >= 0)
    some = some[wide[deepest[some]]]
    reach[order[some]] = length[deepest[some]]
    return reach


def spans(reach: np.ndarray, least: int) -> np.ndarray:
    """Positions in spans of at least `least` that begin at each position."""
    at = np.flatnonzero(reach >= least)
    change = np.zeros(len(reach) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + reach[at], -1)
    return np.cumsum(change[:-1]) > 0


def twice(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which entries have an equal entry of the same owner elsewhere."""
    if not len(keys):
        return np.zeros(0, bool)
    both = keys ^ common.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(both, kind="stable")
    s, o = both[order], owner[order]
    same = (s[1:] == s[:-1]) & (o[1:] == o[:-1])
    out = np.zeros(len(keys), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return out


def dup_lines(data: np.ndarray, offs: np.ndarray, texts: list[bytes], some: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text, for the texts in `some`."""
    out = np.zeros(len(offs) - 1, np.int64)
    for k in some.tolist():
        lines = [x for x in texts[k].split(b"\n") if x.split()]
        out[k] = len(lines) - len(set(lines))
    return out


def _repeats(codes: np.ndarray, words: np.ndarray, texts: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words in repeats of min_repeat, words in repeats of WINDOW, longest repeat) of the chosen texts, by suffix arrays over many of them."""
    out = [np.zeros(len(texts), np.int64) for _ in range(3)]
    size, top = np.diff(words)[texts], int(codes.max(initial=0)) + 1
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(np.cumsum(size[at:]), ARRAY_WORDS, "right")), 1) + at
        some = texts[at:end]
        # a word of its own behind each text: no repeat crosses it
        n = size[at:end] + 1
        ends = np.concatenate([[0], np.cumsum(n)])
        whole = np.empty(ends[-1], np.int64)
        marks = ends[1:] - 1
        inside = np.ones(ends[-1], bool)
        inside[marks] = False
        whole[marks] = top + np.arange(len(some))
        whole[inside] = codes[common.gather(words, some)[0]] if len(some) else 0
        # so that equal texts of different documents don't count, each text's words are its own
        whole += np.repeat(np.arange(len(some)), n) * (top + len(some))
        reach = repeated(whole, min(min_repeat, WINDOW))
        for k, least in ((0, min_repeat), (1, WINDOW)):
            out[k][at:end] = np.add.reduceat(spans(reach, least), ends[:-1])
        longest = np.maximum.reduceat(reach, ends[:-1])
        out[2][at:end] = np.where(longest >= min_repeat, longest, 0)
        at = end
    return tuple(out)


def measure(texts: pa.Array, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The base counts and the repetition of every text of a batch."""
    data, offs = common.raw(texts)
    codes, words, distinct = common.words_of(texts)
    n = len(texts)
    n_words = np.diff(words)
    chars = np.asarray(pc.utf8_length(distinct), dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(chars[codes])])
    flag = np.zeros(256, bool)
    flag[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(flag[data], dtype=np.int32)])
    n_symbols = np.diff(symbols[offs])
    del symbols
    # a text without a window of the shorter kind twice has no repeats; equal windows have equal hashes
    hashes = common.mix(np.arange(1, len(distinct) + 1, dtype=np.uint64))[codes]
    keys, ends = common.shingles(hashes, words, min(WINDOW, min_repeat))
    del hashes
    owner = np.repeat(np.arange(n), np.diff(ends))
    suspect = np.unique(owner[twice(keys, owner)])
    del keys, owner
    n_covered, n_repeat, longest = (np.zeros(n, np.int64) for _ in range(3))
    n_covered[suspect], n_repeat[suspect], longest[suspect] = _repeats(codes, words, suspect, min_repeat)
    newlines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)])
    lines = (newlines[offs[1:]] - newlines[offs[:-1]]) > 0
    plain = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    some = np.flatnonzero(lines)
    held = plain.take(pa.array(some)).to_pylist()
    rows = dict(zip(some.tolist(), held))
    return {
        "n_words": n_words,
        "word_chars": np.diff(total[words]),
        "n_symbols": n_symbols,
        "n_dup_lines": dup_lines(data, offs, rows, some),
        "n_repeat_words": n_repeat,
        "n_covered": n_covered,
        "longest_repeat": longest,
    }


def verdict(m: dict[str, np.ndarray], max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of the measured texts."""
    base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    kept = ~base & (m["n_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)
    return base, kept


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def judge(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, keep_columns: bool = False) -> DataFrame:
    """Each document with its counts, base_failed and kept; with keep_columns only the kept rows with their own columns.

    Null texts have no words and fail the base rule. Long texts are measured whole. Equal rows get equal verdicts. An
    empty table gives an empty one. Other columns are ignored or, with keep_columns, passed on untouched.
    """
    common.tune(docs)
    if keep_columns:

        def keep(batches):
            for batch in common.slices(batches, "text"):
                _, kept = verdict(measure(common.as_text(batch.column("text")), min_repeat), max_covered, max_repeat)
                yield batch.filter(pa.array(kept))

        return docs.mapInArrow(keep, docs.schema)

    def run(batches):
        for batch in common.slices(batches, "text"):
            m = measure(common.as_text(batch.column("text")), min_repeat)
            base, kept = verdict(m, max_covered, max_repeat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(m[c], pa.int64()) for c in COUNTS), pa.array(base), pa.array(kept)],
                ["doc_id", *COUNTS, "base_failed", "kept"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean")
