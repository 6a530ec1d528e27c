import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspark.llm import bpe, common, queries, token_store

from .brute import sha

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "   ", "a<|endoftext|>b <|startoftext|> x", "it's DON'T 've 'VE ﬁ ½ ١٢٣ 漢字かな é ́x İstanbul ΣΑΣ ß", "aaaa aaaaaaa zzzzzz hahahaha ....... !!!??", "  x y 　z\x1cq\x85w", "😀👩‍👩‍👧 ok\x00b", "a" * 3000, "<|endoftext", "Ǆ ﷺ", "word\u0301 \u0301word",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def documents(spark, sf):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]


def test_words_at_a_time_equal_whole_texts(spark, sf, library):
    texts = ODD + documents(spark, sf)
    ids, offs = token_store.encode(pa.array(texts), PATH, True)
    for k, t in enumerate(texts):
        assert ids[offs[k] : offs[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


def test_bpe_equals_the_library(spark, sf, library):
    rows = list(enumerate(ODD + documents(spark, sf)[:60])) + [(900, None), (1, ODD[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(1))
    got = sorted(map(tuple, bpe.encode_decode(df, PATH).collect()))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


def test_decode_round_trip(library):
    ids = library.encode("plain words of text", add_special_tokens=False).ids
    assert bpe.decode_ids(np.array(ids), PATH) == library.decode(ids, skip_special_tokens=False)


def test_merges_of_one_symbol_and_unsorted_ranks():
    m = bpe.Merges(PATH)
    words = ["aaaa", "aaaaaaa", "hahaha", "zzz"]
    flat = [m.single[c] for w in words for c in [*w[:-1], w[-1] + m.suffix]]
    offs = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    fast, slow = bpe.merge_words(m, np.array(flat), offs), bpe._one_by_one(m, np.array(flat), offs)
    assert m.rising and fast[0].tolist() == slow[0].tolist() and fast[1].tolist() == slow[1].tolist()


def test_store_query(spark, sf, library):
    rows = queries.op1_token_store(spark, sf).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(rows, documents(spark, sf), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_store_of_odd_rows(spark):
    rows = [(None, "x"), (5, None), (5, "b a"), (5, "b a"), (2, ""), (7, "word " * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(0))
    got = token_store.store_ids(df, common.new_folder(spark, "t"), PATH, end_id=2, by_word=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 2, 5, 5, 5, 7] and [r["n_tokens"] for r in got][0::5] == [2, 90_001]
    assert token_store.store_ids(df.limit(0), common.new_folder(spark, "t"), PATH).count() == 0


def test_shards_decompress_only_what_is_wanted():
    out = io.BytesIO()
    w = token_store.ShardWriter(out, 4)
    docs = {k: np.arange(k * 7, k * 7 + 9000, dtype=np.uint32) for k in range(40)}
    for k, ids in docs.items():
        w.add(k, ids)
    w.close()
    r = token_store.ShardReader(io.BytesIO(out.getvalue()))
    seen = []
    plain, r.frame = r.frame, lambda k: seen.append(k) or plain(k)
    assert [(i, x.tolist()) for i, x in r.find([3, 33])] == [(k, docs[k].tolist()) for k in (3, 33)]
    assert len(r.frames) > 4 and len(set(seen)) == 2
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(x.astype("<u4").tobytes() for x in docs.values())
    broken = bytearray(out.getvalue())
    at = int(r.starts[0])
    broken[at + 20] ^= 255
    with pytest.raises(Exception):
        token_store.ShardReader(io.BytesIO(bytes(broken))).ids(0)


def test_ids_that_do_not_fit_are_an_error():
    w = token_store.ShardWriter(io.BytesIO(), 2)
    w.add(1, np.array([65535], np.uint32))
    with pytest.raises(ValueError):
        w.add(2, np.array([70_000], np.uint32))


def test_words_apart_only_where_white_space_is_dropped(tmp_path):
    import json

    assert token_store.words_apart(PATH) and not token_store.words_apart(public_tokenizers.path("byte_bpe_50k.json"))
    conf = json.load(open(PATH, encoding="utf-8"))
    for part in ({"normalizer": {"type": "Prepend", "prepend": "x"}}, {"pre_tokenizer": None}, {"added_tokens": [{**conf["added_tokens"][0], "lstrip": True}]}):
        other = tmp_path / f"{len(part)}{next(iter(part))}.json"
        other.write_text(json.dumps({**conf, **part}), encoding="utf-8")
        assert not token_store.words_apart(str(other))


@pytest.mark.parametrize("least, most", [(1 << 10, 256 << 20), (8 << 20, 4 << 10)])
def test_shards_by_size(spark, monkeypatch, least, most):
    monkeypatch.setattr(token_store, "LEAST_SHARD", least)
    monkeypatch.setattr(token_store, "MOST_SHARD", most)
    df = spark.createDataFrame([(k, f"w{k} " * 50) for k in range(300)], "doc_id long, text string")
    manifest = token_store.write_shards(df, common.new_folder(spark, "t"), PATH).collect()
    assert sum(r["n_docs"] for r in manifest) == 300 and (len(manifest) == 4 if most > 1 << 20 else 8 < len(manifest) <= 18)
