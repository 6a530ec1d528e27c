import pytest
from pyspark.sql import functions as F

from loomspark.functions import numeric as N
from loomspark.functions import text as T
from loomspark.functions import udfs as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "prompt, want",
    [
        ("Classify the sentiment of this review: fine", "sentiment"), ("Summarize this in one sentence", "summarization"), ("Extract the people and locations", "ner"), ("Fix the bug: def f(x): return x", "debug"),
        ("Write a function that adds", "codegen"), ("Who owns the cat? each owns a different pet", "logic"), ("What is 12 percent of 50?", "math"), ("It takes twice as long. What is the total?", "math"),
        ("Tell me of rivers", "factual"), ("", "factual"), (None, "factual"), ("écost 5", "factual"),
    ],
)
def test_classify(spark, prompt, want):
    assert one(spark, T.classify(F.lit(prompt).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("Total: $1,250.50", 1250.5), ("Answer: 195.", 195), ("none", None), ("", None), (None, None), ("-3 then -4.25!", -4.25)])
def test_last_number(spark, text, want):
    assert one(spark, T.last_number(F.lit(text).cast("string"))) == want


def test_lines_and_counts(spark):
    assert one(spark, T.labeled_line(F.lit("Answer: 1\n**Answer:** 42\nx"), "Answer")) == "42"
    assert one(spark, T.labeled_line(F.lit("no label"), "Answer")) is None
    assert one(spark, T.sentence_count(F.lit("One. Two! Three?"))) == 3
    assert one(spark, T.sentence_count(F.lit("It is 3.5 in it."))) == 1
    assert one(spark, T.word_count(F.lit("a b  c"))) == 3
    assert one(spark, T.without_expression(F.lit("Expression: 1+1\nAnswer: 2"))) == "Answer: 2"


def test_constraints(spark):
    c = one(spark, T.summary_constraints(F.lit("Summarize in exactly one sentence.")))
    assert c["sentences_exact"] == 1 and c["words_max"] is None
    assert one(spark, T.summary_constraints(F.lit("no more than 10 words")))["words_max"] == 10
    assert one(spark, T.summary_constraints(F.lit("fewer than 10 words")))["words_max"] == 9
    broken = T.summary_violations(F.lit("One. Two."), F.struct(F.lit(1).alias("sentences_exact"), F.lit(1).alias("words_max"), F.lit(None).cast("int").alias("words_exact")))
    assert one(spark, broken) == ["expected 1 sentence(s), got 2", "over 1 words (2)"]
    fixed = T.enforced_summary(F.lit("One here. Two there! Three."), F.struct(F.lit(1).alias("sentences_exact"), F.lit(4).alias("words_max")))
    assert one(spark, fixed) == "One here; Two there."


def test_agreement(spark):
    long = "Canberra is the capital city of Australia."
    assert one(spark, T.answers_agree(F.lit(long), F.lit("The capital of Australia is Canberra")))
    assert not one(spark, T.answers_agree(F.lit(long), F.lit("Sydney, a harbour town")))
    assert not one(spark, T.answers_agree(F.lit("The tower is 300 m"), F.lit("The tower is 324 m")))
    assert not one(spark, T.answers_agree(F.lit(""), F.lit("")))


def test_numbers_equal(spark):
    assert one(spark, T.numbers_equal(F.lit(0.1) + F.lit(0.2), F.lit(0.3)))
    assert not one(spark, T.numbers_equal(F.lit(None).cast("double"), F.lit(1.0)))


@pytest.mark.parametrize("text, want", [("", 2166136261), ("hello", 1335831723), ("category:math", 4216891947), ("u:🧪", 784774262)])
def test_fnv(spark, text, want):
    assert one(spark, N.fnv1a_32(F.lit(text))) == want


def test_features(spark):
    from loomspark.operators import routing as R

    df = spark.createDataFrame([(1, "What is 2 + 2?")], "id long, prompt string")
    counts = R.feature_counts(df, "id", "prompt", F.lit("math"), 2048)
    got = {r["idx"]: r["n"] for r in counts.collect()}
    assert got == {113: 1, 500: 1, 555: 1, 584: 1, 632: 1, 722: 1, 835: 1, 951: 1, 1032: 1, 1294: 1, 1391: 1, 1428: 1, 1523: 1, 1860: 2}
    import math

    weights = spark.createDataFrame([(1860, 2.0)], "idx int, weight double")
    score = R.scores(counts, "id", weights, -1.0).first()["score"]
    assert score == pytest.approx(1 / (1 + math.exp(-(-1 + 2 * (1 + math.log(2))))))


def test_wilson_and_rank(spark):
    assert one(spark, N.wilson_lower(F.lit(10), F.lit(10))) < 0.90 <= one(spark, N.wilson_lower(F.lit(40), F.lit(40)))
    assert one(spark, N.wilson_lower(F.lit(0), F.lit(0))) == 0
    assert one(spark, N.nearest_rank(F.array(*map(F.lit, range(1, 11))))) == 10
    assert one(spark, N.nearest_rank(F.array(*map(F.lit, (160, 80, 120))))) == 160


@pytest.mark.parametrize("text, want", [("240 * 0.85 - 60.", 144), ("1,200 / 4", 300), ("round(10 / 3, 2)", 3.33), ("-7 // 2", -4), ("2 ** 8", 256), ("$5 × 3 ÷ 2", 7.5)])
def test_arithmetic(text, want):
    assert U.arithmetic(text) == pytest.approx(want)


@pytest.mark.parametrize("text", ["10 ** 100", "x + 1", "lambda: 1", "", None, "1 / 0", "__import__('os')", "(1).real", "1 if 2 else 3", "9" * 400, "max(1, key=2)"])
def test_arithmetic_rejects(text):
    with pytest.raises(ValueError):
        U.arithmetic(text)


def test_puzzle():
    text = "Sam, Jo and Lee each own a different pet: cat, dog, bird. Jo owns the dog. Lee does not own the cat. Who owns the cat?"
    assert U.assignment(text) == ("Sam", "cat", {"Sam": "cat", "Jo": "dog", "Lee": "bird"})
    assert U.assignment("Sam, Jo and Lee each own a different pet: cat, dog, bird. Who owns the cat?") is None


def test_code_runs():
    tests = [{"args": [5], "expected": 120}]
    assert U.run_tests("def f(n):\n    return 1 if n < 2 else n * f(n - 1)", tests)["results"] == [{"got": "120", "passed": True}]
    assert U.run_tests("def f(n):\n    while True: pass", tests, seconds=1.0)["ok"] is False
    assert "no function" in U.run_tests("x = 1", tests)["error"]


def test_usage(spark):
    of = lambda s: tuple(one(spark, N.usage_tokens(F.lit(s).cast("string"))))
    assert of('{"total_tokens": 5}') == (5, "provider")
    assert of('{"prompt_tokens": 2, "completion_tokens": 3}') == (5, "derived")
    assert of('{"total_tokens": -1}') == (None, "unknown")
    assert of(None) == (None, "unknown")


def test_labels_of_answers(spark):
    assert one(spark, T.baseline_label(F.lit("EASY, local ok"))) == "local_ok"
    assert one(spark, T.baseline_label(F.lit("easy or hard"))) is None
    assert one(spark, T.settled_sentiment(F.lit("Positive: both positive and negative"))).startswith("Mixed")
    assert one(spark, T.entity_lines_ok(F.lit("Ann - person\n\nOslo – Location")))
    assert not one(spark, T.entity_lines_ok(F.lit("")))
    assert one(spark, T.extract_code(F.lit("a\n```python\ndef f(n):\n  return n\n```"))) == "def f(n):\n  return n"
    assert one(spark, T.smoke_tests(F.lit("def f(n): pass"))) == '[{"args":[5]}]'
    assert one(spark, T.placeholder(F.lit("your_key")))
    assert one(spark, T.csv_items(F.lit(" a, ,b"))) == ["a", "b"]


def test_templates_mask(spark):
    got = one(spark, T.canonical_template(F.lit("math"), F.lit("Ann Lee paid $1,200 on the 3rd.")))
    assert got == "math\n<name> paid <num> on the <num> ."
    assert one(spark, T.canonical_template(F.lit("codegen"), F.lit("Write a Python function that adds"))) == "codegen\nadds"


@pytest.mark.parametrize("rule", ["normalized_prompt", "nfkc"])
def test_python_gets_whole_texts_in_batches_of_bounded_size(spark, rule):
    import pandas as pd

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    held = F.pandas_udf(lambda x: pd.Series([int(x.str.len().sum())] * len(x)), "long")
    texts = spark.range(3000).coalesce(1).select(F.concat(F.lit("Ä "), F.repeat(F.lit("ｘy "), 1000)).alias("x"))
    out = texts.select(held("x").alias("held"), F.length(getattr(U, rule)("x")).alias("n")).agg(F.max("held").alias("held"), F.count_if(F.col("n") >= 3000).alias("n")).first()
    assert out["n"] == 3000 and out["held"] < 2 << 20  # 9 million characters
    spark.conf.set(name, "300k")
    getattr(U, rule)("x")
    assert spark.conf.get(name) == "300k"  # a smaller setting stays
    spark.conf.unset(name)
