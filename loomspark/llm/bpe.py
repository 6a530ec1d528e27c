"""BPE by a pair occurrence index.

The distinct words of a piece of a partition lie behind one another in one array of symbols. The index maps each
mergeable pair to all its positions there. Active ranks are taken in ascending order; a merge rewrites every position of
its pair at once and adds the pairs that it made to the lists of their ranks. A position that another merge has changed
is skipped when its list is taken, so lists are never searched.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common
from .token_store import words_apart

#: Symbols of words handled at once.
INDEX_SYMBOLS = 1 << 20
#: Bytes of texts whose distinct words are handled together; more of them share more words and take more memory.
WORD_BYTES = 16 << 20
#: Words whose ids a task keeps from one batch to the next; beyond that it starts anew.
WORDS_KEPT = 150_000

_coded: dict[str, tuple] = {}


class Merges:
    """Vocabulary and merges of a tokenizer file, with pairs as sorted numbers for lookups of whole arrays."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE file")
        vocab = model["vocab"]
        self.tokens = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.suffix, self.size = model.get("end_of_word_suffix") or "", len(self.tokens)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks = (left * self.size + right)[order], order
        self.single = {t: i for t, i in vocab.items() if len(t.removesuffix(self.suffix) if self.suffix else t) == 1}
        # Taking a rank's positions all at once equals the word-by-word order if no merge makes a pair of a lower rank.
        born = np.full(self.size, -1, np.int64)
        np.maximum.at(born, self.made, np.arange(len(pairs)))
        self.rising = bool((np.maximum(born[left], born[right]) < np.arange(len(pairs))).all())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1: it never merges."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_words(m: Merges, sym: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the symbols sym[offs[w]:offs[w + 1]] of each word w; returns the remaining symbols and their offsets."""
    n = len(sym)
    if not n:
        return sym, offs
    if not m.rising:
        return _one_by_one(m, sym, offs)
    sym = sym.copy()
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    full = offs[:-1][np.diff(offs) > 0]
    ends = offs[1:][np.diff(offs) > 0] - 1
    nxt[ends], prv[full] = -1, -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(pos: np.ndarray) -> None:
        """Enters the pairs that begin at pos."""
        rank = m.rank(sym[pos], sym[nxt[pos]])
        keep = rank >= 0
        pos, rank = pos[keep], rank[keep]
        if not len(pos):
            return
        if len(pos) > 1:
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            parts, firsts = np.split(pos, cut), rank[np.concatenate([[0], cut])].tolist()
        else:
            parts, firsts = [pos], rank.tolist()
        for r, part in zip(firsts, parts):
            if r not in index:
                index[r] = [part]
                heapq.heappush(heap, r)
            else:
                index[r].append(part)

    add(np.flatnonzero(nxt >= 0))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b, c = m.left[r], m.right[r], m.made[r]
        pos = pos[sym[pos] == a]
        after = nxt[pos]
        keep = (after >= 0) & (sym[after] == b)
        pos, after = pos[keep], after[keep]
        if not len(pos):
            continue
        if a == b and len(pos) > 1:  # in a run of one symbol every second pair is taken, from the left
            chained = np.concatenate([[False], after[:-1] == pos[1:]])
            start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(pos))))
            keep = (np.arange(len(pos)) - start) % 2 == 0
            pos, after = pos[keep], after[keep]
        beyond = nxt[after]
        sym[pos], sym[after] = c, -1
        nxt[pos] = beyond
        inner = beyond >= 0
        prv[beyond[inner]] = pos[inner]
        before = prv[pos]
        add(np.unique(np.concatenate([before[before >= 0], pos[inner]])))
    left = sym >= 0
    return sym[left], np.concatenate([[0], np.cumsum(left)])[offs]


def _one_by_one(m: Merges, sym: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For merges whose order an array step can't keep: lowest rank first, leftmost first, in each word."""
    out, ends = [], [0]
    table = dict(zip(m.keys.tolist(), m.ranks.tolist()))
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
        w = sym[lo:hi].tolist()
        while len(w) > 1:
            r, k = min((table.get(w[i] * m.size + w[i + 1], len(table)), i) for i in range(len(w) - 1))
            if r == len(table):
                break
            w[k : k + 2] = [int(m.made[r])]
        out += w
        ends.append(len(out))
    return np.array(out, np.int64), np.array(ends, np.int64)


_loaded: dict[str, tuple] = {}


def load(path: str):
    """Merges and the library's normalizer and pre-tokenizer of a file, once for each worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
        if t.decoder is not None:
            raise ValueError("this decoder joins tokens by one space; the file names another")
        if not words_apart(path):
            raise ValueError("this tokenizer looks across white space")
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        plain = [x for x, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(letters))] == [letters.lower()] if t.normalizer and t.pre_tokenizer else False
        _loaded[path] = Merges(path), t.normalizer, t.pre_tokenizer, special, plain
    return _loaded[path]


def _cut(word: str, special: dict[str, int]) -> list[str | int]:
    """Splits at the special tokens' strings, leftmost and then longest first."""
    out: list[str | int] = []
    while word:
        found = min(((at, -len(s), s) for s in special if (at := word.find(s)) >= 0), default=None)
        if not found:
            return [*out, word]
        if found[0]:
            out.append(word[: found[0]])
        out.append(special[found[2]])
        word = word[found[0] - found[1] :]
    return out


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word (a piece of text without ASCII white space) and their offsets."""
    m, normalizer, pre, special, plain = load(path)
    pieces: list[list[str | int]] = []
    marks = tuple(special)
    for w in words:
        if any(s in w for s in marks):
            parts = _cut(w, special)
        else:
            parts = [w]
        row: list[str | int] = []
        for p in parts:
            if isinstance(p, int):
                row.append(p)
            elif plain and p.isascii() and p.isalpha():
                row.append(p.lower())
            else:
                row += [x for x, _ in pre.pre_tokenize_str(normalizer.normalize_str(p))]
        pieces.append(row)
    distinct: dict[str, int] = {}
    for row in pieces:
        for p in row:
            if not isinstance(p, int):
                distinct.setdefault(p, len(distinct))
    get, suffix = m.single.get, m.suffix
    flat: list[int] = []
    ends = [0]
    out_ids, out_offs, lengths = [], [], 0
    for p in distinct:
        # a symbol that the vocabulary lacks is dropped, as there is no unknown token
        flat += [i for i in map(get, [*p[:-1], p[-1] + suffix]) if i is not None]
        ends.append(len(flat))
        if len(flat) >= INDEX_SYMBOLS:
            ids, offs = merge_words(m, np.array(flat, np.int64), np.array(ends, np.int64))
            out_ids.append(ids)
            out_offs.append(offs[:-1] + lengths)
            lengths += len(ids)
            flat, ends = [], [0]
    ids, offs = merge_words(m, np.array(flat, np.int64), np.array(ends, np.int64))
    out_ids.append(ids)
    ids, offs = np.concatenate(out_ids), np.concatenate([*out_offs, offs + lengths])
    simple = [len(row) == 1 and not isinstance(row[0], int) for row in pieces]
    if all(simple):
        at, ends_ = common.gather(offs, np.array([distinct[row[0]] for row in pieces], np.int64))
        return ids[at], ends_
    flat, ends = [], [0]
    for row in pieces:
        for p in row:
            flat += [p] if isinstance(p, int) else ids[offs[distinct[p]] : offs[distinct[p] + 1]].tolist()
        ends.append(len(flat))
    return np.array(flat, np.int64), np.array(ends, np.int64)


def spoken(ids: list[int], tokens: list[str], names: dict[int, str]) -> str:
    """The tokens of ids, a space before each, special ones included; ids without a token are left out."""
    if names.keys().isdisjoint(ids):
        return "".join([tokens[i] for i in ids if 0 <= i < len(tokens)])
    return "".join([names[i] if i in names else tokens[i] for i in ids if i in names or 0 <= i < len(tokens)])


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of ids: their tokens joined by one space."""
    m, _, _, special, _ = load(path)
    return spoken(ids.tolist(), [f" {t}" for t in m.tokens], {i: f" {s}" for s, i in special.items()})[1:]


def code_batch(texts: pa.Array, path: str) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """n_tokens of each text; then for all words in order ' id id' and ' token token', and the words' offsets by text."""
    m, _, _, special, _ = load(path)
    known, id_text, token_text = _coded.setdefault(path, ({}, [f" {i}" for i in range(m.size)], [f" {t}" for t in m.tokens]))
    names = {i: f" {s}" for s, i in special.items()}
    codes, offs, distinct = common.words_of(texts)
    words = distinct.to_pylist()
    rows = [known.get(w) for w in words]
    new = [k for k, r in enumerate(rows) if r is None]
    ids, ends = encode_words([words[k] for k in new], path)
    again = (np.bincount(codes, minlength=len(words)) > 1).tolist()
    if len(known) > WORDS_KEPT:
        known.clear()
    each, ends = ids.tolist(), ends.tolist()
    for k, a, b in zip(new, ends[:-1], ends[1:]):
        own = each[a:b]
        rows[k] = (b - a, "".join([f" {i}" if i >= m.size else id_text[i] for i in own]), spoken(own, token_text, names))
        if again[k]:
            known[words[k]] = rows[k]
    sizes = np.fromiter((r[0] for r in rows), np.int64, len(rows))
    at = pa.array(codes)
    as_ids, as_text = (pa.array([r[c] for r in rows], pa.large_string()).take(at) for c in (1, 2))
    n = np.concatenate([[0], np.cumsum(sizes[codes])])[offs]
    return np.diff(n), as_ids, as_text, offs


def digests(strings: pa.Array, offs: np.ndarray) -> list[str]:
    """SHA-256 of each text's words' strings joined, without the first space."""
    data, ends = common.raw(strings)
    ends = ends[offs].tolist()
    view = memoryview(data)
    return [hashlib.sha256(view[min(a + 1, b) : b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]


def encode_decode(docs: DataFrame, path: str, word_bytes: int = WORD_BYTES) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (the decoded text).

    Null texts count as empty: no ids and an empty decoded text. A long text is handled whole; repeated rows give
    repeated rows; other columns are ignored.
    """

    def run(batches):
        for batch in common.slices(batches, "text", word_bytes):
            n, ids, text, offs = code_batch(common.as_text(batch.column("text")), path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests(ids, offs)), pa.array(digests(text, offs))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        for words, *_ in _coded.values():
            words.clear()
        common.trim()

    return common.tune(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
