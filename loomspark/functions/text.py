"""Text rules as columns: classification, extraction, constraints and agreement. All run inside the JVM, but for the normal form of characters other than ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import udfs as U


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def strip(x: Column | str) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(_c(x), P.unicode(r"^\s+|\s+$"), "")


def found(x: Column, pattern: str, flags: str = "") -> Column:
    return x.rlike(P.unicode(pattern, flags))


def classify(prompt: Column | str) -> Column:
    """Category of a prompt: the first cue in a fixed order that it shows, else factual."""
    raw = text_or_empty(prompt)
    p, code = F.lower(raw), found(raw, P.CODE_HINT, "i")
    math = found(p, P.MATH)
    return (
        F.when(found(p, P.SENTIMENT), "sentiment")
        .when(found(p, P.SUMMARY), "summarization")
        .when(found(p, P.ENTITIES), "ner")
        .when(code & found(p, P.DEBUG), "debug")
        .when(found(p, P.CODEGEN) | (code & found(p, P.CODE_VERB)), "codegen")
        .when(found(p, P.LOGIC), "logic")
        .when(math & (found(p, r"\d") | found(p, P.NUMBER_WORD)), "math")
        .otherwise("factual")
    )


def id_prefix(task_id: Column | str) -> Column:
    """What stands before the last underscore; an id without one is its own prefix."""
    return F.regexp_replace(_c(task_id), "(?s)_[^_]*$", "")


def task_scope(explicit: Column | str, task_id: Column | str, prompt: Column | str) -> Column:
    """An explicit category, else a category that the id names, else the classifier's."""
    given, prefix = strip(text_or_empty(explicit)), id_prefix(text_or_empty(task_id))
    return F.when(given != "", given).when(prefix.isin(*P.CATEGORIES), prefix).otherwise(classify(prompt))


def last_number(x: Column | str) -> Column:
    """The last number of a text as double, without $ and thousands commas; null if there is none."""
    raw = F.try_element_at(F.regexp_extract_all(text_or_empty(x), F.lit(P.unicode(P.NUMBER)), F.lit(0)), F.lit(-1))
    bare = F.regexp_replace(F.regexp_replace(raw, r"[$,]", ""), r"\.$", "")
    return F.when(~bare.isin("", "-"), bare.try_cast("double"))


def labeled_line(x: Column | str, label: str) -> Column:
    """What follows `label:` on the last line that has it; markdown stars around it are dropped."""
    line = P.unicode(rf"^\s*\**\Q{label}\E\**\s*[:=]\s*\**\s*(.+?)\s*$", "i")
    lines = F.filter(F.split(text_or_empty(x), r"\r\n|[\n\r]"), lambda s: s.rlike(line))
    return strip(F.regexp_extract(F.try_element_at(lines, F.lit(-1)), line, 1))


def numbers_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal within a relative tolerance; false if either is null."""
    near = F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return F.coalesce(near, F.lit(False))


def sentence_count(x: Column | str) -> Column:
    """Sentences by their end signs; common abbreviations and decimals don't end one."""
    t = F.regexp_replace(text_or_empty(x), P.unicode(P.ABBREVIATIONS), "$1")
    t = strip(F.regexp_replace(t, P.unicode(P.DECIMAL), "0"))
    return F.size(F.filter(F.split(t, P.unicode(P.SENTENCE_END)), lambda s: F.regexp_replace(s, P.unicode(r"\s"), "") != ""))


def word_count(x: Column | str) -> Column:
    return F.size(F.regexp_extract_all(text_or_empty(x), F.lit(P.unicode(r"\S+")), F.lit(0)))


def extract_code(x: Column | str) -> Column:
    """The first fenced block, else everything from the first line that begins with def; empty without either."""
    raw = text_or_empty(x)
    fence = r"(?is)```(?:python|py)?\s*\n(.*?)```"
    start = r"(?sm)(^def \w+.*)"
    return F.when(raw.rlike(fence), strip(F.regexp_extract(raw, fence, 1))).when(raw.rlike(start), strip(F.regexp_extract(raw, start, 1))).otherwise("")


def summary_constraints(prompt: Column | str) -> Column:
    """struct(sentences_exact, words_max, words_exact) that a prompt asks for; null: not asked."""
    p = F.lower(text_or_empty(prompt))
    exact = F.regexp_extract(p, P.SENTENCES_EXACT, 1)
    named = F.when(exact.isin("one", "1"), 1).when(exact.isin("two", "2"), 2).when(exact.isin("three", "3"), 3)
    single = F.when(found(p, P.SENTENCE_SINGLE), 1)
    how, n = F.regexp_extract(p, P.WORDS_LIMIT, 1), F.regexp_extract(p, P.WORDS_LIMIT, 2).try_cast("int")
    strict = how.isin("under", "fewer than", "less than").cast("int")
    words = F.regexp_extract(p, P.WORDS_EXACT, 1).try_cast("int")
    return F.struct(F.coalesce(named, single).alias("sentences_exact"), (n - strict).alias("words_max"), words.alias("words_exact"))


def summary_violations(answer: Column | str, constraints: Column) -> Column:
    """The constraints that an answer breaks, as an array of messages."""
    sentences, words = sentence_count(answer), word_count(answer)
    c = constraints
    checks = F.array(
        F.when(sentences != c["sentences_exact"], F.format_string("expected %d sentence(s), got %d", c["sentences_exact"], sentences)),
        F.when(words > c["words_max"], F.format_string("over %d words (%d)", c["words_max"], words)),
        F.when(words != c["words_exact"], F.format_string("expected exactly %d words", c["words_exact"])),
    )
    return F.filter(checks, lambda m: m.isNotNull())


def without_expression(x: Column | str) -> Column:
    """The text without its `Expression:` lines."""
    lines = F.filter(F.split(text_or_empty(x), r"\r\n|[\n\r]"), lambda s: ~s.rlike(P.unicode(P.EXPRESSION_LINE, "i")))
    return strip(F.array_join(lines, "\n"))


def enforced_summary(x: Column | str, constraints: Column) -> Column:
    """The text forced into the constraints: sentences joined by semicolons, surplus words cut."""
    t = strip(text_or_empty(x))
    joined = F.concat(F.regexp_replace(F.regexp_replace(t, r"[.!?]+$", ""), r"[.!?]+\s+", "; "), F.lit("."))
    t = F.when((constraints["sentences_exact"] == 1) & (t != ""), joined).otherwise(t)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, F.greatest(F.coalesce(constraints["words_max"], F.lit(0)), F.lit(0))), " "), r"[,;:]+$", ""), F.lit("."))
    return F.when(F.size(words) > constraints["words_max"], cut).otherwise(t)


def looks_confident(x: Column | str, least: int = 15) -> Column:
    a = strip(text_or_empty(x))
    return (F.length(a) >= least) & ~found(a, P.HEDGE, "i")


def sentiment_label(x: Column | str) -> Column:
    """The first sentiment label of a text in lower case; null if there is none."""
    got = F.lower(F.regexp_extract(text_or_empty(x), P.unicode(P.SENTIMENT_LABEL, "i"), 1))
    return F.when(got != "", got)


def settled_sentiment(x: Column | str) -> Column:
    """An answer that finds both polarities gets Mixed for its first label."""
    raw = text_or_empty(x)
    both = F.lower(raw).contains("both positive") & F.lower(raw).contains("negative")
    return F.when(both, F.regexp_replace(raw, P.unicode(r"^(.*?)\b(positive|negative|neutral|mixed)\b", "is"), "$1Mixed")).otherwise(raw)


def entity_lines_ok(x: Column | str) -> Column:
    """Whether there are lines and each is `entity - type`."""
    lines = F.filter(F.transform(F.split(text_or_empty(x), r"\r\n|[\n\r]"), lambda s: strip(s)), lambda s: s != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda s: s.rlike(P.unicode(P.ENTITY_LINE, "i")))


def content_words(x: Column | str) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(x)), F.lit(r"[a-z0-9']+"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, P.AGREE_STOP)))


def answers_agree(a: Column | str, b: Column | str) -> Column:
    """No two different last numbers, and enough of the shorter answer's content words in the other."""
    na, nb = last_number(a), last_number(b)
    wa, wb = content_words(a), content_words(b)
    least = F.least(F.size(wa), F.size(wb))
    overlap = F.size(F.array_intersect(wa, wb)) >= F.lit(P.AGREE_SHARE) * least
    clash = na.isNotNull() & nb.isNotNull() & ~numbers_equal(na, nb)
    return ~clash & (least > 0) & overlap


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of template tokens; two texts without tokens are alike."""
    of = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(x)), F.lit(r"<[^>]+>|[a-z0-9_]+"), F.lit(0)))
    union = F.size(F.array_union(of(a), of(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(of(a), of(b))).cast("double"), union), F.lit(1.0))


def masked(x: Column | str) -> Column:
    """A prompt with numbers and proper names masked, in lower case, white space collapsed."""
    t = F.regexp_replace(text_or_empty(x), P.unicode(P.MASKED_NUMBER, "i"), " <num> ")
    t = F.regexp_replace(t, P.unicode(P.MASKED_NAME), " <name> ")
    return strip(F.regexp_replace(F.lower(t), P.unicode(r"\s+"), " "))


def explicit_template(*fields: str) -> Column:
    """`field:value` of the first of these columns that has a template's id; null if none has."""
    return F.coalesce(*(F.when(strip(text_or_empty(f)) != "", F.concat(F.lit(f"{f}:"), strip(text_or_empty(f)))) for f in fields))


def composed(x: Column | str) -> Column:
    """NFKC of a text. Only texts with other than ASCII characters go to Python."""
    t = text_or_empty(x)
    other = U.nfkc(F.when(t.rlike(r"[^\x00-\x7F]"), t))
    return F.coalesce(other, t)


def canonical_template(scope: Column, prompt: Column, explicit: Column | None = None) -> Column:
    """Scope and masked prompt, without wording that only varies between siblings; or scope and an explicit template (see explicit_template)."""
    t, s = strip(composed(prompt)), F.lower(scope)
    codegen = F.regexp_replace(t, P.CODEGEN_OPENING, "")
    body = F.regexp_extract(t, P.DEBUG_BODY, 1)
    debug = F.when(body != "", F.regexp_replace(body, P.DEBUG_CLOSING, "")).otherwise(t)
    summary = F.regexp_replace(t, P.SUMMARY_OPENING, "")
    t = F.when(s.isin("codegen", "code_generation"), codegen).when(s.isin("debug", "code_debugging"), debug).when(s.isin("summarization", "summary"), summary).otherwise(t)
    out = F.concat(scope, F.lit("\n"), masked(t))
    if explicit is None:
        return out
    given = strip(text_or_empty(explicit))
    return F.when(given != "", F.concat(scope, F.lit("\nexplicit:"), given)).otherwise(out)


def baseline_label(x: Column | str) -> Column:
    """The one route that an answer mentions, however often; null if it names none or both."""
    mentions = F.regexp_extract_all(F.lower(text_or_empty(x)), F.lit(P.unicode(P.BASELINE_MENTION)), F.lit(1))
    labels = F.array_distinct(F.transform(mentions, lambda m: F.when(m.isin("escalate", "hard"), "escalate").otherwise("local_ok")))
    return F.when(F.size(labels) == 1, F.get(labels, F.lit(0)))


def simulated_label(prompt: Column | str) -> Column:
    p = text_or_empty(prompt)
    return F.when(found(p, P.BASELINE_HARD, "i") | (F.length(p) > 280), "escalate").otherwise("local_ok")


def spec_tests(prompt: Column | str) -> Column:
    """Tests (JSON) that the wording of a prompt implies; the first pattern counts."""
    p, out = F.lower(text_or_empty(prompt)), F.lit(None).cast("string")
    for pattern, tests in reversed(P.SPEC_TESTS):
        out = F.when(found(p, pattern), tests).otherwise(out)
    return F.coalesce(out, F.lit("[]"))


def smoke_tests(code: Column | str) -> Column:
    """One call (JSON) with an argument that fits the name of a function's only parameter."""
    inside = F.regexp_extract(text_or_empty(code), r"def \w+\(([^)]*)\)", 1)
    names = F.transform(F.filter(F.split(inside, ","), lambda s: strip(s) != ""), lambda s: strip(F.regexp_extract(strip(s), r"^([^:=]*)", 1)))
    names = F.filter(names, lambda s: s != "self")
    name = F.lower(F.get(names, F.lit(0)))
    call = F.coalesce(*(F.when(name.rlike(p), tests) for p, tests in P.SMOKE_ARGUMENTS))
    return F.when(F.size(names) == 1, F.coalesce(call, F.lit("[]"))).otherwise("[]")


def snippet(x: Column | str, most: int = 300) -> Column:
    """The beginning of a text, for a message or a log."""
    return F.left(strip(x), F.lit(most))


def placeholder(x: Column | str) -> Column:
    """Whether a credential looks like a template's value."""
    return text_or_empty(x).rlike("(?i)" + P.PLACEHOLDER)


def csv_items(x: Column | str) -> Column:
    """Trimmed items of a comma list, empty ones left out."""
    return F.filter(F.transform(F.split(text_or_empty(x), ","), lambda s: strip(s)), lambda s: s != "")
