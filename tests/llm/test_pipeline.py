import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from . import brute


def test_pipeline_equals_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in rows if brute.quality(t)[-1]]
    top = brute.components(kept)
    kept = [(i, t) for i, t in kept if top[i][1] == i]
    kept = [(x[0], x[4].decode("utf-8", "ignore")) for x in brute.without_repeats(kept) if x[4].decode("utf-8", "ignore") or not x[2]]
    kept = [(i, t) for i, t in kept if not any(b in t for b in bench)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in kept:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(want)


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_unlike_rows_of_one_id_are_kept(spark, sf):
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    near = texts[1] + " more"
    rows = [(None, texts[0], "s"), (None, texts[1], "s"), (None, texts[2], "s"), (7, texts[3], "s"), (7, texts[4], "s"), (9, near, "s"), (8, texts[3], "s"), (5, texts[4], "s"), (3, texts[5], "s"), (3, texts[5], "s"), (4, None, "s"), (6, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    want = [(None, t, "s") for t in texts[:3]] + [(7, texts[3], "s"), (5, texts[4], "s"), (3, texts[5], "s"), (4, None, "s"), (6, "", "s")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
