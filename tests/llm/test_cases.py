"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables for every operator and stage."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomspark.llm import bpe, decontaminate, jaccard, licenses, main_text, repetition, substrings, toxicity, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{k}" for k in range(300_000))
TEXTS = [None, "", " \n\t", "one two three four five six", "one two three four five six", "é" * 60, LONG]
#: Names that the steps use themselves.
CLASHES = ["node", "tie", "g", "n", "kept", "n_removed", "n_bytes", "bucket", "blob", "key", "class", "component_id", "score", "c2", "__tie", "part"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 0 else k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})
    return df.withColumn("n_chars", F.length("text").cast("long")).repartition(2).cache()


def benchmark(spark):
    return spark.createDataFrame([(1, "w11 w12 w13 w14 w15 w16 w17"), (2, None), (None, "five six")], "item_id long, text string")


def run(name, spark, docs):
    return {
        "substrings": lambda: substrings.remove_repeats(docs),
        "bpe": lambda: bpe.encode_decode(docs, PATH),
        "licenses": lambda: licenses.scan(docs),
        "decontaminate": lambda: decontaminate.matches(docs, benchmark(spark)),
        "clean": lambda: decontaminate.clean(docs, benchmark(spark)),
        "toxicity": lambda: toxicity.score(docs, toxicity.Field({"=one": 4.0}, -3.0, (-1.0, 0.0, 0.0))),
        "quality": lambda: repetition.judge(docs),
        "jaccard": lambda: jaccard.classes(docs),
        "main_text": lambda: main_text.extract(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "score", "kept")),
        "url_filter": lambda: url_filter.judge(docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("x://"), "text").alias("url"), "score", "kept"), spark.createDataFrame([("w0 w1", "", "block")], url_filter.SCHEMA)),
    }[name]()


#: Rows of each operator for the nine rows above.
ROWS = {"substrings": 9, "bpe": 9, "licenses": 0, "decontaminate": 5, "clean": 4, "toxicity": 9, "quality": 9, "jaccard": 9, "main_text": 9, "url_filter": 9}


@pytest.mark.parametrize("name", ROWS)
def test_odd_rows(spark, docs, name):
    rows = run(name, spark, docs).collect()
    assert len(rows) == ROWS[name]
    assert run(name, spark, docs.limit(0)).count() == 0
    key = "page_id" if rows and "page_id" in rows[0] else "doc_id"
    twice = [repr(r) for r in rows if r[key] == 3]
    assert len(twice) == 2 * len(set(twice))  # equal rows get equal results
    if name == "substrings":
        of = {(r["doc_id"], r["node"]): r for r in rows}
        assert all(r["node"] == f"node:{'none' if r['doc_id'] is None else r['doc_id']}" and r["tie"][:4] == "tie:" for r in rows)
        assert of[6, "node:6"]["n_bytes"] == len(LONG) and of[6, "node:6"]["n_removed"] == 0 and of[5, "node:5"]["n_bytes"] == 120
    if name == "quality":
        assert {r["doc_id"]: r["n_words"] for r in rows}[6] == 300_000
    if name == "main_text":
        assert {len(r["text"]) for r in rows if r["page_id"] == 6} == {len(LONG)}
    if name == "bpe":
        empty = hashlib.sha256(b"").hexdigest()
        assert all((r["n_tokens"] == 0) == (r["ids_sha256"] == empty) for r in rows) and sum(r["n_tokens"] == 0 for r in rows) == 3


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, docs, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHES)
    if name == "n-gram Jaccard join":
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == [(False, 0), (False, 0), (True, 1), (True, 2), (True, 5), (True, 6)]
    if name == "suffix-array dedup":
        assert {r["n_chars"] for r in rows if r["doc_id"] == 6} == {len(LONG)}
    assert stage(spark, docs.limit(0), sf).count() == 0
