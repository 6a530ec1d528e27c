"""What the corpus operators share: the shared folder, written tables, Arrow views and hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker holds at once, whatever the partition's size.
BATCH_BYTES = 2 << 20
#: Rows that Spark hands to Python at once; what belongs together is put together there, up to a number of bytes.
ARROW_ROWS = 1000

#: Bytes of input that one partition of an exchange by group or bucket is meant to hold.
PART_BYTES = 128 << 20

U64 = np.uint64


def trim() -> None:
    """Gives freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tune(df: DataFrame) -> DataFrame:
    """Keeps batches between the JVM and Python small in the frame's session, and returns the frame."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages start from files that outlive any executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    # nobody asks for the marker file, and on a local file system each file of the driver's starts a process
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._loomspark_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_groups(df: DataFrame, group_bytes: int = BATCH_BYTES) -> int:
    """A number of groups that grows with the documents, so that one group's texts stay near group_bytes."""
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // group_bytes))


def dealt(df: DataFrame, key: str, size: int) -> DataFrame:
    """df by key in partitions of about PART_BYTES of `size`; where the session's number of partitions does, that is left to it."""
    parts = -(-int(size) // PART_BYTES)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def present(bucket: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by bucket (then by ties), and (bucket, begin, end) in that order of each bucket that occurs."""
    order = np.lexsort((*ties[::-1], bucket)) if ties else np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return order, list(zip(b[first].tolist(), first.tolist(), [*first[1:].tolist(), len(b)]))


def as_text(arr) -> pa.Array:
    """One array of strings without nulls (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return pc.fill_null(arr, "") if arr.null_count else arr


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values behind one another, and n + 1 offsets into them."""
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    width = np.dtype(np.int64 if big else np.int32)
    offs = np.frombuffer(arr.buffers()[1], width, n + 1, arr.offset * width.itemsize).astype(np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column`; one value is never divided."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = raw(as_text(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offs, offs[at] + most - size, "right")) - 1
            end = min(max(end, at + (not held)), batch.num_rows)
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(offs[end] - offs[at])
            if end < batch.num_rows or size >= most:
                yield _one(held)
                held, size = [], 0
                trim()
            at = end
    if held:
        yield _one(held)
        held = []
        trim()


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space of every text: codes of all words in order, n + 1 offsets, the distinct words by code."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offs = np.asarray(lists.offsets, dtype=np.int64)
    offs = offs - offs[0]
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes, distinct = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
    empty = pc.index(distinct, "").as_py() if len(distinct) else -1
    if empty >= 0:
        keep = codes != empty
        offs = np.concatenate([[0], np.cumsum(keep)])[offs]
        codes = codes[keep]
    return codes, offs, distinct


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit numbers."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def hash_words(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    import xxhash

    f = xxhash.xxh3_64_intdigest
    return np.fromiter(map(f, distinct.cast(pa.binary()).to_pylist()), U64, len(distinct))


def shingles(h: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words that lies in one text, with n + 1 offsets. h: the words' hashes."""
    counts = np.maximum(np.diff(offs) - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if not out[-1]:
        return np.zeros(0, U64), out
    at = np.repeat(offs[:-1] - out[:-1], counts) + np.arange(out[-1])
    key = np.zeros(out[-1], U64)
    for j in range(size):
        key = (key + h[at + j]) * U64(0x9E3779B97F4A7C15)
        key ^= key >> U64(29)
    return mix(key), out


def grouped(f):
    """A function of one group's table that gives back its memory when it is done."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            trim()

    return run


def cogrouped(f):
    """The same for a group of two tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            trim()

    return run


def gather(offs: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs offs[c]:offs[c + 1] for every chosen c behind one another, and their offsets."""
    n = offs[chosen + 1] - offs[chosen]
    out = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(offs[chosen] - out[:-1], n) + np.arange(out[-1]), out


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of numbers as one compressed value."""
    import zstandard

    head = b"".join(a.dtype.str.encode().ljust(4) + len(a).to_bytes(4, "little") for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(bytes([len(arrays)]) + head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(blob)
    n, out = plain[0], []
    at = 1 + 8 * n
    for k in range(n):
        kind = np.dtype(plain[1 + 8 * k : 5 + 8 * k].decode().strip())
        size = int.from_bytes(plain[5 + 8 * k : 9 + 8 * k], "little")
        out.append(np.frombuffer(plain, kind, size, at))
        at += size * kind.itemsize
    return out
