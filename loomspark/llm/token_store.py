"""Token ids in binary shards: independent Zstandard frames, a document index, a seek table and a checksum for each frame.

A shard is a plain Zstandard file in the public seekable format:

    skippable frame   header: JSON with the version and the bytes of one id
    frames            little-endian ids; a document lies in one frame
    skippable frame   document index: id, ids and frame of each document, compressed
    skippable frame   seek table: sizes and XXH64 checksum of each frame before it, then the footer

A reader takes the footer, the seek table and the index, and decompresses only the frames of the documents it wants.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the public seekable format.
SEEK_MAGIC, SKIPPABLE_SEEK, SKIPPABLE_HEADER, SKIPPABLE_INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50, 0x184D2A51
CHECKSUM_FLAG = 0x80
#: Bytes of ids after which a frame is closed.
FRAME_BYTES = 256 << 10

#: Bytes of texts of a shard.
LEAST_SHARD, MOST_SHARD = 8 << 20, 256 << 20
#: Bytes of texts whose distinct words are encoded together.
WORD_BYTES = 16 << 20
#: Words of which a task keeps the ids from one batch to the next; beyond that it starts anew.
WORDS_KEPT = 600_000

_encoders: dict[str, object] = {}
_words: dict[str, dict[str, bytes]] = {}
_apart: dict[str, bool] = {}


def encoder(path: str):
    """The tokenizer of a file, unused truncation and padding, loaded once by a worker."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
    return _encoders[path]


#: Normalizers that change no text across white space; Replace counts only for white space itself.
LOCAL_NORMALIZERS = frozenset(["NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "Strip"])


def words_apart(path: str) -> bool:
    """Whether a tokenizer drops white space and never looks across it, so that words between it can be encoded by themselves."""
    if path not in _apart:
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)

        def flat(part: dict | None, inner: str) -> list[dict]:
            return [] if not part else [x for p in part[inner] for x in flat(p, inner)] if part["type"] == "Sequence" else [part]

        tok, white = encoder(path), " \t\n\r\x0b\x0c"
        local = all(n["type"] in LOCAL_NORMALIZERS or n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " " for n in flat(conf["normalizer"], "normalizers"))
        first = next(iter(flat(conf["pre_tokenizer"], "pretokenizers")), {"type": ""})
        drops = first["type"] in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer") or first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]
        marks = all(not (set(t["content"]) & set(white)) and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in conf["added_tokens"])
        # and by trial: nothing is left of white space, alone or between words
        tried = not tok.encode(white, add_special_tokens=False).ids and all(
            tok.encode(f"{a}{c}{b}", add_special_tokens=False).ids == [i for x in (a, b) for i in tok.encode(x, add_special_tokens=False).ids] for a in ("Ab", "3", "é.", "'") for b in ("s", "4", "...") for c in white
        )
        _apart[path] = local and drops and marks and tried
    return _apart[path]


def encode(texts: pa.Array, path: str, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order and n + 1 offsets.

    by_word: each distinct word between ASCII white space is encoded once. That is the same as encoding whole texts
    for a tokenizer whose normalizer and pre-tokenizer never look across white space and drop it.
    """
    tok = encoder(path)
    if not by_word:
        lists = [x.ids for x in tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]) if lists else np.zeros(1, np.int64)
        return np.fromiter((i for x in lists for i in x), np.uint32, int(offs[-1])), offs
    codes, offs, distinct = common.words_of(texts)
    words, known = distinct.to_pylist(), _words.setdefault(path, {})
    parts = [known.get(w) for w in words]
    missing = [k for k, p in enumerate(parts) if p is None]
    again = np.bincount(codes, minlength=len(words)) > 1
    if len(known) > WORDS_KEPT:
        known.clear()
    for lo in range(0, len(missing), 20_000):
        some = missing[lo : lo + 20_000]
        for k, x in zip(some, tok.encode_batch_fast([words[k] for k in some], add_special_tokens=False)):
            parts[k] = array("I", x.ids).tobytes()
            if again[k]:
                known[words[k]] = parts[k]
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]) // 4
    at, word_offs = common.gather(ends, codes)
    return np.frombuffer(b"".join(parts), np.uint32)[at], word_offs[offs]


def skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


class ShardWriter:
    """Writes documents in the order they come. out: an open binary file."""

    def __init__(self, out, id_bytes: int, level: int = 3):
        self.out, self.width, self.zstd = out, np.dtype("<u2" if id_bytes == 2 else "<u4"), zstandard.ZstdCompressor(level=level)
        self.seek: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.frames: list[int] = []
        self.open: list[np.ndarray] = []
        self.held = self.n_frames = 0
        self._put(skippable(SKIPPABLE_HEADER, json.dumps({"version": 1, "id_bytes": id_bytes}).encode()), 0, b"")

    def _put(self, block: bytes, size: int, plain: bytes) -> None:
        self.out.write(block)
        self.seek.append((len(block), size, xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.frames.append(self.n_frames)
        if len(ids) and int(ids.max()) > np.iinfo(self.width).max:
            raise ValueError(f"id {int(ids.max())} does not fit {self.width.itemsize} bytes")
        self.open.append(ids.astype(self.width))
        self.held += len(ids) * self.width.itemsize
        if self.held >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            plain = np.concatenate(self.open).tobytes()
            self._put(self.zstd.compress(plain), len(plain), plain)
            self.open, self.held, self.n_frames = [], 0, self.n_frames + 1

    def close(self) -> None:
        self._close_frame()
        known = np.array([d is not None for d in self.docs], np.uint8)
        columns = (np.array([d or 0 for d in self.docs], "<i8"), np.array(self.sizes, "<u4"), np.array(self.frames, "<u4"), known)
        index = struct.pack("<I", len(self.docs)) + b"".join(c.tobytes() for c in columns)
        self._put(skippable(SKIPPABLE_INDEX, self.zstd.compress(index)), 0, b"")
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(skippable(SKIPPABLE_SEEK, table))


class ShardReader:
    """Reads a shard's tables at once and its frames on demand. file: an open seekable binary file."""

    def __init__(self, file):
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.seek(0, 2)
        frames, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end")
        table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.width = np.dtype("<u2" if json.loads(self._at(8, table[0, 0] - 8))["id_bytes"] == 2 else "<u4")
        plain = self.zstd.decompress(self._at(starts[-2] + 8, table[-1, 0] - 8))
        (n,) = struct.unpack_from("<I", plain)
        self.doc_ids = np.frombuffer(plain, "<i8", n, 4)
        self.sizes = np.frombuffer(plain, "<u4", n, 4 + 8 * n).astype(np.int64)
        self.frame_of = np.frombuffer(plain, "<u4", n, 4 + 12 * n)
        self.known = np.frombuffer(plain, np.uint8, n, 4 + 16 * n).astype(bool)
        self.frames, self.starts, self.kept = table[1:-1], starts[1:-2], (-1, b"")
        before = np.concatenate([[0], np.cumsum(self.sizes)])
        first = np.searchsorted(self.frame_of, np.arange(len(self.frames)))
        self.starts_of = before[:-1]
        self.within = before[:-1] - before[first][self.frame_of] if n else before[:-1]

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(int(start))
        return self.file.read(int(n))

    def frame(self, k: int) -> bytes:
        """The ids' bytes of a frame; a wrong checksum is an error."""
        if self.kept[0] != k:
            packed, size, check = self.frames[k]
            plain = self.zstd.decompress(self._at(self.starts[k], packed), max_output_size=int(size))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k}: checksum differs")
            self.kept = (k, plain)
        return self.kept[1]

    def ids(self, row: int) -> np.ndarray:
        """The ids of the shard's row-th document."""
        k, w = int(self.frame_of[row]), self.width.itemsize
        return np.frombuffer(self.frame(k), self.width, int(self.sizes[row]), int(self.within[row]) * w)

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The wanted documents that the shard has; frames of no such document stay compressed."""
        for row in np.flatnonzero(self.known & np.isin(self.doc_ids, np.fromiter(doc_ids, np.int64))):
            yield int(self.doc_ids[row]), self.ids(row)


def opened(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_bytes: int = 4, by_word: bool | None = None, shards: int | None = None) -> DataFrame:
    """Writes the ids of documents (doc_id, text) as shards in ascending doc_id order; returns a manifest (shard, path, n_docs, n_tokens).

    Null texts count as empty, a null doc_id comes first, rows with one doc_id are ordered by a hash of their text and
    then by it; such rows can lie in neighbouring shards. Other columns are ignored. No documents give no shards. A task
    that is run again writes its own temporary file and renames it, so a shard is whole or absent. An id that does not
    fit id_bytes is an error. by_word encodes each distinct word once (None: where the tokenizer allows that).

    There are as many shards as the session has partitions, fewer where they had under LEAST_SHARD bytes of text, and more
    where they had over MOST_SHARD.
    """
    spark = common.tune(docs).sparkSession
    by_word = words_apart(tokenizer) if by_word is None else by_word
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = shards or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_SHARD)), -(-total // MOST_SHARD))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def write(batches):
        task = TaskContext.get()
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"{base}/ids-{task.partitionId():06d}.zst"
        part, writer, total = f"{name}.{task.taskAttemptId()}.part", None, 0
        for batch in common.slices(batches, "text", WORD_BYTES):
            if writer is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(part)
                writer = ShardWriter(out, id_bytes)
            ids, offs = encode(common.as_text(batch.column("text")), tokenizer, by_word)
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                one = ids[offs[k] : offs[k + 1]]
                writer.add(doc, one if end_id is None else np.append(one, np.uint32(end_id)))
            total += len(ids) + (end_id is not None) * batch.num_rows
        _words.clear()
        if writer is not None:
            writer.close()
            out.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [f"{folder}/ids-{task.partitionId():06d}.zst"], "n_docs": [len(writer.docs)], "n_tokens": [total]})

    return rows.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """The documents of all shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32. One task reads a shard, a frame at a time."""
    n = max(1, manifest.count())  # a task for each file
    # one row for each file, so this order without a partition stays small
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = manifest.withColumn("before", before).repartition(n, "shard")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                with opened(path) as file:
                    shard = ShardReader(file)
                    for lo in range(0, len(shard.sizes), 5000):
                        part = range(lo, min(lo + 5000, len(shard.sizes)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.doc_ids[part.start : part.stop], pa.int64(), mask=~shard.known[part.start : part.stop]),
                                pa.array(shard.starts_of[part.start : part.stop] + base, pa.int64()),
                                pa.array(shard.sizes[part.start : part.stop], pa.int64()),
                                pa.array([zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in part], pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_ids(docs: DataFrame, folder: str, tokenizer: str, **options) -> DataFrame:
    """Writes shards and their manifest (a table beside them), then reads the documents back from the files."""
    spark = docs.sparkSession
    write_shards(docs, folder, tokenizer, **options).write.parquet(f"{folder}/manifest")
    return read_shards(spark.read.schema("shard long, path string, n_docs long, n_tokens long").parquet(f"{folder}/manifest"))
