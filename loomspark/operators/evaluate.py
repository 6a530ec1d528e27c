"""Grading answers against truth, accuracy reports and model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions import text as T
from ..sources.readers import last_wins


def label_matches(got: Column, expected: Column) -> Column:
    """Equal labels; neutral and mixed count as one."""
    soft = got.isin("neutral", "mixed") & expected.isin("neutral", "mixed")
    return F.coalesce((got == expected) | soft, F.lit(False))


def items(expected: Column) -> Column:
    return F.from_json(expected, "array<string>")


def grade(kind: Column, expected: Column, answer: Column, prompt: Column | None = None) -> Column:
    """Whether an answer is right; false if blank, null for kinds that need a judge or run code.

    expected: a number or text for number, label and contains; a JSON array for contains_any, contains_all and entities
    (name:type); an object with keyterms for summary.
    """
    a = T.strip(T.text_or_empty(answer))
    low = F.lower(a)
    among = lambda x: F.filter(x, lambda e: F.contains(low, F.lower(e)))
    names = F.transform(items(expected), lambda e: F.lower(F.split(e, ":")[0]))
    need = F.greatest(F.lit(1), F.floor(F.lit(0.75) * F.size(names)).cast("int"))
    terms = F.coalesce(F.from_json(expected, "keyterms array<string>")["keyterms"], F.array().cast("array<string>"))
    summary = (F.size(T.summary_violations(a, T.summary_constraints(prompt if prompt is not None else F.lit("")))) == 0) & ((F.size(terms) == 0) | (F.size(among(terms)) > 0))
    right = (
        F.when(kind == "number", _number_equal(T.last_number(a), expected))
        .when(kind == "label", label_matches(T.sentiment_label(a), expected))
        .when(kind == "contains", F.contains(low, F.lower(expected)))
        .when(kind == "contains_any", F.size(among(items(expected))) > 0)
        .when(kind == "contains_all", F.size(among(items(expected))) == F.size(items(expected)))
        .when(kind == "entities", F.size(F.filter(names, lambda e: F.contains(low, e))) >= need)
        .when(kind == "summary", summary)
    )
    return F.when(a == "", F.lit(False)).otherwise(right)


def _number_equal(got: Column, expected: Column) -> Column:
    return T.numbers_equal(got, expected.try_cast("double"))


def judged(tasks: DataFrame, results: DataFrame, truth: DataFrame, order: str = "idx") -> DataFrame:
    """Tasks (task_id, prompt) with category, ok and via (missing, det or judge); ok is null where a judge must say.

    Of several answers or expectations of a task the last counts: by the column `order` where a table has it, else any. So
    each task is one row for each time it stands in tasks.
    """
    results, truth = (last_wins(df if order in df.columns else df.withColumn(order, F.lit(0)), "task_id", order).drop(order) for df in (results, truth))
    joined = tasks.join(results, "task_id", "left").join(truth, "task_id", "left")
    missing = T.text_or_empty("answer") == ""
    ok = F.when(missing, F.lit(False)).when(F.col("kind").isNotNull(), grade(F.col("kind"), F.col("expected"), F.col("answer"), F.col("prompt")))
    via = F.when(missing, "missing").when(ok.isNotNull(), "det").otherwise("judge")
    return joined.select("task_id", T.id_prefix("task_id").alias("category"), ok.alias("ok"), via.alias("via"))


def accuracy(graded: DataFrame) -> DataFrame:
    """Right and all by category and over all (category null), with what that projects for 19 tasks; ungraded rows don't count."""
    rows = graded.filter("ok is not null").rollup("category").agg(F.count_if("ok").alias("right"), F.count("*").alias("n"))
    percent = 100 * F.col("right") / F.col("n")
    band = F.when(percent >= 90, "PASS").when(percent >= 84, "THIN").otherwise("AT RISK")
    return rows.select("category", "right", "n", F.round(percent, 1).alias("percent"), F.round(F.col("right") / F.col("n") * 19, 1).alias("of_19"), band.alias("band"))


def model_report(runs: DataFrame, *keys: str) -> DataFrame:
    """Accuracy and tokens of each model run; calls with an error stay in n and are wrong. runs: ok, tokens, error."""
    fine = F.col("error").isNull()
    right, total = F.count_if(fine & F.col("ok")), F.coalesce(F.sum(F.when(fine, F.col("tokens"))), F.lit(0))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n"), right.alias("correct"), F.round(right / F.count("*"), 3).alias("accuracy"), total.alias("total_tokens"),
        F.round(total / F.greatest(F.lit(1), right), 1).alias("tokens_per_correct"), F.count_if(~fine).alias("call_errors"),
    )


def ranked(report: DataFrame, least: float = 0.9) -> DataFrame:
    """Models in order: safe ones first, then accuracy, errors, tokens for a right answer, tokens. Adds safe and place."""
    from pyspark.sql import Window

    safe = (F.col("call_errors") == 0) & (F.col("accuracy") >= least)
    order = [F.when(safe, 0).otherwise(1), F.col("accuracy").desc(), "call_errors", "tokens_per_correct", "total_tokens", "model"]
    # one row for each model
    return report.filter("n > 0").withColumn("safe", safe).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def grid(models: DataFrame, modes: list[str], styles: list[str]) -> DataFrame:
    """Every model with every mode and style."""
    return models.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).withColumn("style", F.explode(F.array(*map(F.lit, styles))))


def choices(raw: str, allowed: list[str]) -> list[str]:
    """The names of a comma list, each once; one that is not allowed is an error, and so is an empty list."""
    found = list(dict.fromkeys(x.strip() for x in raw.split(",") if x.strip()))
    if not found or set(found) - set(allowed):
        raise ValueError(f"choose from {', '.join(allowed)}")
    return found


def named(models: DataFrame, wanted: str, key: str = "model") -> DataFrame:
    """The model of that id or last path part."""
    return models.filter((F.col(key) == wanted) | (F.element_at(F.split(key, "/"), -1) == wanted))


def policy_total(routing: Column, answer: Column) -> Column:
    """Tokens of routing and answer; unknown if either is."""
    return routing + answer


def saved(cheap: Column, dear: Column) -> Column:
    """struct(tokens, percent) that the cheaper policy saves; the percentage only of a positive total."""
    tokens = dear - cheap
    return F.struct(tokens.alias("tokens"), F.when(dear > 0, F.round(tokens / dear * 100, 2)).alias("percent"))




def simulated_usage(prompt: Column, completion: Column) -> Column:
    """Tokens of a simulated call: a quarter of the prompt's characters, eight at least, and the completion."""
    return F.greatest(F.lit(8), F.round(F.length(prompt) / 4).cast("int")) + completion
