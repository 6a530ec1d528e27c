"""Answers of a task from what a model said: checks by category, retries, repairs, hosted answers and what is left at the end.

Every attempt is a column (null: it was not made, for want of time or of another model), so a plan over attempts is one
expression. Code is run only for rows of code categories, and never on text of untrusted tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import patterns as P
from ..functions import text as T
from ..functions import udfs as U

CODE = ("codegen", "debug")


def _there(x: Column) -> Column:
    return F.coalesce(T.strip(x) != "", F.lit(False))


def _result(answer: Column, verified: Column) -> Column:
    return F.struct(F.coalesce(answer, F.lit("")).alias("answer"), F.coalesce(verified, F.lit(False)).alias("verified"))


def arithmetic_verdict(text: Column) -> Column:
    """struct(value, stated, ok): the value of the expression line, the number that is stated, whether they are equal."""
    line = T.labeled_line(text, "Answer")
    value, stated = U.safe_eval(T.labeled_line(text, "Expression")), T.last_number(F.when(line != "", line).otherwise(text))
    return F.struct(value.alias("value"), stated.alias("stated"), T.numbers_equal(value, stated).alias("ok"))


def solve_math(first: Column, second: Column) -> Column:
    """The first attempt whose expression gives its number; a second one also if both state one number; else the last exact value, unverified."""
    one, two = arithmetic_verdict(first), arithmetic_verdict(second)
    made, same = second.isNotNull(), T.numbers_equal(one["stated"], two["stated"])
    value, text = F.coalesce(two["value"], one["value"]), F.when(two["value"].isNotNull(), second).otherwise(first)
    exact = F.concat(T.without_expression(text), F.lit("\nFinal answer: "), N.compact_number(value))
    return (
        F.when(one["ok"], _result(T.without_expression(first), F.lit(True)))
        .when(made & (two["ok"] | same), _result(T.without_expression(second), F.lit(True)))
        .otherwise(_result(F.when(value.isNotNull(), exact).otherwise(T.without_expression(text)), F.lit(False)))
    )


def tests_for(prompt: Column, code: Column) -> Column:
    """Tests that the wording implies, else a call that the parameter's name suggests."""
    implied = T.spec_tests(prompt)
    return F.when(implied != "[]", implied).otherwise(T.smoke_tests(code))


def solve_code(prompt: Column, first: Column, code_only: Column, repair: Column) -> Column:
    """The attempt with code (the code-only one where the first has none) if it passes its tests, else the repaired code after the first one's prose."""
    bare = T.extract_code(first) == ""
    text = F.when(bare & (T.extract_code(code_only) != ""), code_only).otherwise(first)
    code, fixed = T.extract_code(text), T.extract_code(repair)
    tests = tests_for(prompt, code)
    prose = T.strip(F.split(text, "```")[0])
    mended = F.concat(F.when(prose != "", F.concat(prose, F.lit("\n\n"))).otherwise(""), F.lit("```python\n"), fixed, F.lit("\n```"))
    passes = U.code_passes(F.when(code != "", code), tests)
    return (
        F.when((code != "") & passes, _result(text, F.lit(True)))
        .when((code != "") & (fixed != "") & U.code_passes(F.when((code != "") & (fixed != ""), fixed), tests), _result(mended, F.lit(True)))
        .otherwise(_result(text, F.lit(False)))
    )


def puzzle_answer(solved: Column) -> Column:
    """The answer to a solved puzzle, with everyone's items."""
    each = F.transform(F.map_entries(solved["assignment"]), lambda e: F.concat(e["key"], F.lit(" has the "), e["value"]))
    return F.concat(solved["person"], F.lit(" owns the "), solved["item"], F.lit(". This is the only assignment consistent with all the constraints: "), F.array_join(each, "; "), F.lit("."))


def solve_logic(prompt: Column, text: Column, always_check: bool = False) -> Column:
    """An exact solution of the puzzle, else the text, verified if it has an answer line and no doubts (never with always_check)."""
    solved = U.solve_puzzle(prompt)
    sure = (T.labeled_line(text, "Answer") != "") & T.looks_confident(text) & F.lit(not always_check)
    return F.when(solved["person"].isNotNull(), _result(puzzle_answer(solved), F.lit(True))).otherwise(_result(text, sure))


def solve_summary(prompt: Column, first: Column, second: Column) -> Column:
    """The first text that keeps the prompt's constraints; else the last one, forced into them."""
    limits = T.summary_constraints(prompt)
    keeps = lambda x: (F.size(T.summary_violations(x, limits)) == 0) & (T.text_or_empty(x) != "")
    again = F.when(T.text_or_empty(first) != "", second)
    last = F.when(T.text_or_empty(again) != "", again).otherwise(first)
    forced = T.enforced_summary(last, limits)
    return F.when(keeps(first), _result(first, F.lit(True))).when(keeps(again), _result(again, F.lit(True))).otherwise(_result(forced, keeps(forced)))


def solve_simple(category: Column, text: Column) -> Column:
    """Sentiment with a label that fits its own reasons, entities in lines, facts without doubts."""
    settled = T.settled_sentiment(text)
    return (
        F.when(category == "sentiment", _result(settled, T.sentiment_label(settled).isNotNull() & T.looks_confident(settled, 10)))
        .when(category == "ner", _result(text, T.entity_lines_ok(text)))
        .otherwise(_result(text, T.looks_confident(text)))
    )


def solve(category: Column, prompt: Column, first: Column, second: Column, repair: Column) -> Column:
    """struct(answer, verified) of a task by its category."""
    only = lambda x, *names: F.when(category.isin(*names), x)  # noqa: E731  # Python rules see rows of their category alone
    return (
        F.when(category == "math", solve_math(only(first, "math"), only(second, "math")))
        .when(category.isin(*CODE), solve_code(only(prompt, *CODE), only(first, *CODE), only(second, *CODE), only(repair, *CODE)))
        .when(category == "logic", solve_logic(only(prompt, "logic"), first))
        .when(category == "summarization", solve_summary(prompt, first, second))
        .otherwise(solve_simple(category, first))
    )


def remote_verified(category: Column, prompt: Column, text: Column) -> Column:
    """Whether a hosted answer passes the check of its category; where there is none, any answer does. A blank one never does."""
    verdict = arithmetic_verdict(F.when(category == "math", text))
    code = T.extract_code(F.when(category.isin(*CODE), text))
    tests = tests_for(prompt, code)
    return _there(text) & (
        F.when(category == "math", verdict["ok"])
        .when(category.isin(*CODE), (code != "") & ((tests == "[]") | U.code_passes(F.when((code != "") & (tests != "[]"), code), tests)))
        .when(category == "summarization", F.size(T.summary_violations(text, T.summary_constraints(prompt))) == 0)
        .when(category == "sentiment", T.sentiment_label(text).isNotNull())
        .otherwise(F.lit(True))
    )


def postprocessed(category: Column, text: Column) -> Column:
    """A hosted answer as it is returned."""
    return F.when(category == "math", T.without_expression(text)).otherwise(T.strip(T.text_or_empty(text)))


def escalated(category: Column, prompt: Column, first: Column, second: Column, left: Column) -> Column:
    """The hosted answer: the first if it is verified, else another model's if enough seconds are left and it is verified, or if the first is blank."""
    again = (left >= P.RETRY_LEFT_S) & second.isNotNull()
    other = again & (remote_verified(category, prompt, second) | ~_there(first))
    return postprocessed(category, F.when(~remote_verified(category, prompt, first) & F.coalesce(other, F.lit(False)), second).otherwise(first))


def endgame(remote: Column, local: Column, local_ok: Column, backup: Column, emergency: Column, emergency_ok: Column, left: Column) -> Column:
    """struct(answer, path): a verified local answer, else the hosted one, else the kept local one, else an emergency attempt if time is left, else the fallback."""
    checked = lambda ok: F.when(F.coalesce(ok, F.lit(False)), P.PATHS[0]).otherwise(P.PATHS[1])
    row = lambda answer, path: F.struct(answer.alias("answer"), path.alias("path"))
    return (
        F.when(_there(local) & local_ok, row(local, F.lit(P.PATHS[0])))
        .when(_there(remote), row(remote, F.lit(P.PATHS[2])))
        .when(_there(backup), row(backup, F.lit(P.PATHS[1])))
        .when(_there(emergency) & (left > P.EMERGENCY_LEFT_S), row(emergency, checked(emergency_ok)))
        .otherwise(row(F.lit(P.FALLBACK_ANSWER), F.lit(P.PATHS[3])))
    )


def run_statistics(answers: DataFrame) -> DataFrame:
    """One row: answers by path, calls attempted and succeeded, tokens by what is known of them. answers: path, planned, attempted, succeeded, usage (JSON)."""
    usage = N.usage_tokens(F.when(F.col("succeeded"), F.col("usage")))
    known = answers.withColumn("u", usage)
    of = lambda s: F.count_if(F.col("succeeded") & (F.col("u.source") == s))
    return known.agg(
        F.count("*").alias("n"), *(F.count_if(F.col("path") == p).alias(p.replace("-", "_")) for p in P.PATHS), F.count_if("planned").alias("planned"), F.count_if("attempted").alias("attempted"), F.count_if("succeeded").alias("succeeded"),
        F.coalesce(F.sum("u.tokens"), F.lit(0)).alias("known_tokens"), of("derived").alias("usage_derived"), of("unknown").alias("usage_unknown"),
    )


def run_summary(answers: DataFrame) -> DataFrame:
    """One row: answered and empty tasks, average seconds."""
    blank = ~_there(F.col("answer"))
    return answers.agg(F.count_if(~blank).alias("answered"), F.count_if(blank).alias("empty"), F.round(F.avg("seconds"), 2).alias("mean_seconds"))


def presolved(category: Column, prompt: Column) -> Column:
    """Whether a logic prompt is a puzzle that is solved exactly before anything is planned."""
    return F.coalesce(U.solve_puzzle(F.when(category == "logic", prompt))["person"].isNotNull(), F.lit(False))


def bulk_waves(pending: DataFrame, part: str, order: str, answered: Column, definitive: Column, first: int = 3) -> DataFrame:
    """Adds wave and sent: the first rows of a part go at once; the others unless all of the first failed, and one for good."""
    from ..streaming.runs import probe_waves

    waves = probe_waves(pending.withColumns({"_answered": answered, "_definitive": definitive}), part, order, first)
    probes = waves.filter("wave = 1").groupBy(part).agg(F.max(F.col("_answered").cast("int")).alias("_some"), F.max(F.col("_definitive").cast("int")).alias("_final"))
    sent = (F.col("wave") == 1) | (F.col("_some") == 1) | (F.col("_final") == 0)
    return waves.join(probes, part).withColumn("sent", sent).drop("_answered", "_definitive", "_some", "_final")


def system_text(category: Column, texts: dict[str, str], style: str = "category") -> Column:
    """The instructions that go before a prompt: none in style raw, those of its category (texts) in style category; null where there are none."""
    if style not in ("raw", "category"):
        raise ValueError(f"no such style: {style}")
    if style == "raw" or not texts:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*(F.lit(x) for pair in texts.items() for x in pair)), category)


def remote_cap(category: Column) -> Column:
    """Tokens that a hosted answer may have."""
    return N.by_name(P.REMOTE_CAPS, category, P.DEFAULT_REMOTE_CAP).cast("int")
