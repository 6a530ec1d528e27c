"""SQL for DuckDB that gives the same rows as the queries of the same name."""

from __future__ import annotations

from ..functions import patterns as P
from .adapters import ANSWERS, PROMPTS, RECORDS, RUNS

# Word boundaries of that engine know ASCII only: other letters become one that it knows.
LATIN = r"regexp_replace({}, '[\x{{80}}-\x{{10FFFF}}]', 'z', 'g')"


#: The stand-in records for templates: what the rules make of their prompts.
TEMPLATES = r"""WITH o AS (SELECT *, o_orderkey AS k, 'T' || (o_orderkey // 50) % 3 AS named FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  p AS (SELECT *, CASE WHEN k % 100 = 0 THEN 'template_id:' || named WHEN k % 50 = 0 THEN 'template_group:' || named END AS explicit,
    'please ' || list_extract(['ship', 'bill', 'cancel', 'explain'], CAST(k % 4 AS INT) + 1) || ' order <num> worth <num> of ' || lower(c_mktsegment) || ' for ' || lower(n_name) || list_extract(['', ' final', ' with <name> # <num>', ' <name>', ''], CAST(k % 5 AS INT) + 1) AS text FROM o),
  t AS (SELECT CAST(k AS VARCHAR) AS task_id, o_orderpriority AS scope, explicit, o_orderpriority || chr(10) || CASE WHEN explicit IS NOT NULL THEN 'explicit:' || explicit ELSE text END AS canonical FROM p)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(x: str, pattern: str, flags: str = "") -> str:
    options = f", {quoted(flags)}" if flags else ""
    return f"regexp_matches({x}, {quoted(pattern)}{options})"


def classified(x: str) -> str:
    raw = LATIN.format(f"coalesce({x}, '')")
    p = f"lower({raw})"
    code = has(raw, P.CODE_HINT, "i")
    math = has(p, P.MATH)
    return (
        f"CASE WHEN {has(p, P.SENTIMENT)} THEN 'sentiment' WHEN {has(p, P.SUMMARY)} THEN 'summarization' WHEN {has(p, P.ENTITIES)} THEN 'ner' WHEN {code} AND {has(p, P.DEBUG)} THEN 'debug' "
        f"WHEN {has(p, P.CODEGEN)} OR ({code} AND {has(p, P.CODE_VERB)}) THEN 'codegen' WHEN {has(p, P.LOGIC)} THEN 'logic' WHEN {math} AND ({has(p, '[0-9]')} OR {has(p, P.NUMBER_WORD)}) THEN 'math' ELSE 'factual' END"
    )


def pick(values: list[str], at: str) -> str:
    return f"list_extract([{', '.join(map(quoted, values))}], CAST({at} AS INT) + 1)"


def lookup(values: dict[str, float], key: str, other: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {float(v)}" for k, v in values.items()) + f" ELSE {float(other)} END"


def last_number(x: str) -> str:
    return f"TRY_CAST(regexp_replace(replace(replace(list_extract(regexp_extract_all({x}, {quoted(P.NUMBER)}), -1), '$', ''), ',', ''), '\\.$', '') AS DOUBLE)"


def equal(a: str, b: str) -> str:
    return f"coalesce(abs({a} - {b}) <= 1e-6 * greatest(1.0, abs({a}), abs({b})), FALSE)"


def content(x: str) -> str:
    stop = ", ".join(map(quoted, P.AGREE_STOP))
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9'']+')), lambda w: w NOT IN ({stop}))"


def agree(a: str, b: str) -> str:
    na, nb, wa, wb = last_number(a), last_number(b), content(a), content(b)
    return f"(NOT (({na}) IS NOT NULL AND ({nb}) IS NOT NULL AND NOT {equal(na, nb)}) AND least(len({wa}), len({wb})) > 0 AND len(list_intersect({wa}, {wb})) >= 0.75 * least(len({wa}), len({wb})))"


def wilson(k: str, n: str) -> str:
    p = f"(CAST({k} AS DOUBLE) / nullif({n}, 0))"
    return f"CASE WHEN {n} > 0 THEN ({p} + 3.8416 / 2 / {n} - 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / 4 / ({n} * CAST({n} AS DOUBLE)))) / (1 + 3.8416 / {n}) ELSE 0.0 END"


def ratio(a: str, b: str, empty: float = 0.0) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), {empty}), 4)"


FEATURES = f"""tasks AS (SELECT conv_id * 1000 + turn AS id, text AS prompt FROM conversations WHERE role = 'user'),
tok AS (SELECT id, prompt, list_slice(regexp_extract_all(lower(prompt), '[a-z0-9_]+|[^\\sA-Za-z0-9_]'), 1, 256) AS t FROM tasks),
feat AS (SELECT id, unnest(list_concat(['category:factual', 'length:' || CAST(least(8, length(prompt) // 80) AS VARCHAR)], list_transform(t, lambda x: 'u:' || x),
  list_transform(range(2, len(t) + 1), lambda i: 'b:' || t[i - 1] || '|' || t[i]),
  list_filter([CASE WHEN regexp_matches(prompt, '[0-9]') THEN 'shape:digits' END, CASE WHEN {has('prompt', P.CODE_HINT, 'i')} THEN 'shape:code' END, CASE WHEN contains(prompt, '?') THEN 'shape:question' END], lambda x: x IS NOT NULL))) AS f FROM tok),
named AS (SELECT f, list_reduce(list_concat([2166136261::BIGINT], list_transform(range(0, octet_length(encode(f))), lambda i: CAST(('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2]) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 2048 AS idx FROM (SELECT DISTINCT f FROM feat)),
counts AS (SELECT id, idx, count(*) AS n FROM feat JOIN named USING (f) GROUP BY ALL)"""

COSTED = f"""{PROMPTS}, costed AS (SELECT id, category, CAST((id * 7919) % 1000 AS DOUBLE) / 1000.0 AS score,
  greatest(greatest(8.0, length(prompt) / 4.0) / (8.0 * 6.0) + (CASE WHEN id % 3 = 0 AND id % 90 > 0 THEN CAST(id % 90 AS DOUBLE) ELSE ({lookup(P.LOCAL_CAPS, 'category', 200)}) * ({lookup(P.RETRY_HEADROOM, 'category', 1.2)}) END) / 8.0 + 1.5, CASE WHEN id % 4 = 0 THEN 9.5 ELSE 0.0 END) AS cost
  FROM (SELECT *, {pick(list(P.CATEGORIES), 'id % 8')} AS category FROM prompts))"""
PLANNED = f"{COSTED}, planned AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'solved' WHEN category = 'debug' OR score >= 0.6 THEN 'remote' ELSE 'local' END AS route FROM costed)"
QUEUED = f"{PLANNED}, queued AS (SELECT id, id // 40 AS queue, round(cost, 3) AS cost FROM planned WHERE route = 'local')"
POLICED = f"{RECORDS}, policed AS (SELECT *, category = 'de' AS always, category = 'en' AS trusted, (NOT correct AND NOT verified AND latency_s > 17) AS late FROM records)"

CONFUSION = f"""{POLICED}, m AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND NOT y) AS tn, count(*) FILTER (NOT p AND y) AS fn FROM (SELECT always OR score >= 0.5 AS p, NOT correct AS y FROM policed)),
confusion AS (SELECT *, tp + fp + tn + fn AS n, {ratio('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {ratio('tp', 'tp + fp')} AS escalate_precision, {ratio('tp', 'tp + fn')} AS escalate_recall, {ratio('tn', 'tn + fn')} AS local_precision, {ratio('tn', 'tn + fp')} AS local_recall,
  round((coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) + coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0)) / 2, 4) AS balanced_accuracy FROM m)"""
SAFETY = f"""s0 AS (SELECT *, always OR score >= 0.5 AS p, NOT (always OR score >= 0.5) AND NOT verified AND NOT trusted AS r FROM policed),
s1 AS (SELECT count(*) AS n, count(*) FILTER (NOT correct) AS failures, count(*) FILTER (NOT correct AND p) AS pf, count(*) FILTER (NOT correct AND (p OR r)) AS ef, count(*) FILTER (late) AS slow_failures, count(*) FILTER (late AND p) AS sp, count(*) FILTER (NOT p AND NOT r AND NOT correct) AS unsafe_local FROM s0),
safety AS (SELECT n, failures, slow_failures, unsafe_local, {ratio('pf', 'failures', 1.0)} AS planned_recall, {ratio('ef', 'failures', 1.0)} AS final_recall, {ratio('sp', 'slow_failures', 1.0)} AS slow_planned_recall, {ratio('unsafe_local', 'n')} AS unsafe_rate FROM s1)"""


def simulated(thresholds: str, policed: str | None = None) -> str:
    """simulate for every threshold, by joining each with all records."""
    return f"""{policed or POLICED}, t AS ({thresholds}),
q AS (SELECT threshold, *, always OR score >= threshold AS p, verified OR trusted AS k, latency_s > 17 AS tight FROM policed CROSS JOIN t),
a AS (SELECT threshold, count(*) AS n, sum(CASE WHEN p THEN 1.0 - 0.95::DOUBLE WHEN k OR tight THEN (CASE WHEN correct THEN 0.0 ELSE 1.0 END) ELSE 1.0 - 0.95::DOUBLE END) AS misses, CAST(count(*) FILTER (p OR NOT k) AS DOUBLE) AS escalations, CAST(count(*) FILTER (NOT p AND k) AS DOUBLE) AS kept,
  CAST(count(*) FILTER (p) AS DOUBLE) AS planned, CAST(count(*) FILTER (NOT p AND NOT k) AS DOUBLE) AS reactive, CAST(count(*) FILTER (NOT p AND NOT k AND tight) AS DOUBLE) AS risk, CAST(count(*) FILTER (NOT p AND NOT k AND tight AND NOT correct) AS DOUBLE) AS fb, count(*) FILTER (late) AS slow_failures, count(*) FILTER (late AND p) AS sp FROM q GROUP BY threshold),
sim AS (SELECT CAST(threshold AS DOUBLE) AS threshold, round(misses * (19.0::DOUBLE / n), 3) AS expected_misses, round(escalations * (19.0::DOUBLE / n), 2) AS expected_escalations, round(escalations * (19.0::DOUBLE / n) * 180, 0) AS expected_tokens, round(kept / n, 3) AS local_share, round(1 - misses / n, 4) AS projected_accuracy,
  round(planned * (19.0::DOUBLE / n), 2) AS planned_escalations, round(reactive * (19.0::DOUBLE / n), 2) AS reactive_escalations, round(risk * (19.0::DOUBLE / n), 2) AS reactive_at_risk, round(fb * (19.0::DOUBLE / n), 3) AS fallback_misses, slow_failures, {ratio('sp', 'slow_failures', 1.0)} AS slow_recall FROM a)"""


#: The calibration split under the policy of the training split.
CALIBRATED = f"""{RECORDS}, ps AS (SELECT category, CAST(count(*) FILTER (correct) AS DOUBLE) / count(*) AS accuracy, count(*) FILTER (NOT verified) AS unverified, count(*) FILTER (correct AND NOT verified) AS k FROM records WHERE id % 5 > 1 GROUP BY category),
pw AS (SELECT category, CASE WHEN accuracy < 0.70 THEN 'always_escalate' WHEN unverified >= 10 AND {wilson('k', 'unverified')} >= 0.90 THEN 'trust_local' ELSE 'none' END AS decision FROM ps),
policed AS (SELECT records.*, coalesce(decision = 'always_escalate', FALSE) AS always, coalesce(decision = 'trust_local', FALSE) AS trusted, (NOT correct AND NOT verified AND latency_s > 17) AS late FROM records LEFT JOIN pw USING (category) WHERE id % 5 = 1)"""
ALL_THRESHOLDS = "SELECT DISTINCT score AS threshold FROM policed UNION SELECT 0.0 UNION SELECT 0.5 UNION SELECT 1.01"
GRADED = f"""{PROMPTS}, given AS (SELECT task_id, id, {pick(["The total is 1,250.", "Mixed feelings", "Canberra is the capital", "", "Ann and Bob met", "42", "red, green and blue"], 'id % 7')} AS answer,
  CASE WHEN id % 9 > 0 THEN nullif({pick(["number", "label", "contains", "contains", "entities", "judge", "contains_all", "contains_any"], '(id * 3) % 8')}, 'judge') END AS kind FROM prompts),
graded AS (SELECT regexp_replace(task_id, '_[^_]*$', '') AS category, CASE WHEN answer = '' THEN 'missing' WHEN kind IS NOT NULL THEN 'det' ELSE 'judge' END AS via,
  CASE WHEN answer = '' THEN FALSE WHEN kind = 'number' THEN {equal(last_number('answer'), '1250.0')} WHEN kind = 'label' THEN contains(lower(answer), 'mixed') WHEN kind = 'contains' THEN contains(lower(answer), 'canberra')
    WHEN kind = 'entities' THEN CAST(contains(lower(answer), 'ann') AS INT) + CAST(contains(lower(answer), 'bob') AS INT) + CAST(contains(lower(answer), 'cy') AS INT) >= 2
    WHEN kind = 'contains_all' THEN contains(lower(answer), 'red') AND contains(lower(answer), 'blue') WHEN kind = 'contains_any' THEN contains(lower(answer), 'met') OR contains(lower(answer), 'total') END AS ok FROM given)"""
SENTENCES = r"len(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace({}, '\b(e\.g|i\.e|etc|vs|Mr|Mrs|Ms|Dr|St)\.', '\1', 'g'), '[0-9]+\.[0-9]+', '0', 'g')), '[.!?]+(?:\s|$)'), lambda s: regexp_replace(s, '\s', '', 'g') <> ''))"
WORDS = r"len(regexp_extract_all({}, '\S+'))"
ASKS = """asked AS (SELECT id, turn, answer, CASE (id + turn) % 5 WHEN 0 THEN 2 WHEN 2 THEN 1 END AS sentences_exact, CASE (id + turn) % 5 WHEN 1 THEN 30 WHEN 2 THEN 24 END AS words_max, CASE (id + turn) % 5 WHEN 3 THEN 12 END AS words_exact FROM answers)"""
SENTIMENT_TEXT = "(CASE id % 3 WHEN 0 THEN 'Positive. It has both positive and negative sides: ' WHEN 1 THEN 'NEUTRAL. ' ELSE 'Unclear. ' END || answer)"
CODES = f"""codes AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE 'def f(' || {pick(["nums", "text", "n", "self, items", "a, b", "word: str = 'x'"], 'p_partkey % 6')} || '):' || chr(10) || '    return ' || CAST(p_size AS VARCHAR) END AS code, p_partkey % 6 AS k FROM part)"""
SPECS = ["the second-largest of a list", "compute a factorial", "is it a palindrome", "reverse a string", "find the maximum value in a list", "the smallest of the list", "sum of all even numbers", "sum of the odd ones", "counts the number of vowels", "is prime", "FizzBuzz", "say hello"]
SPEC_CASE = "CASE " + " ".join(f"WHEN {has('ask', p)} THEN {quoted(t)}" for p, t in P.SPEC_TESTS) + " ELSE '[]' END"
USAGE = """usage AS (SELECT o_orderkey % 4 AS k, o_orderkey AS o FROM orders)"""
MODEL_RUNS = "model_runs AS (SELECT 'org/model-' || CAST(l_suppkey % 12 AS VARCHAR) AS model, l_quantity > 3 + l_suppkey % 12 AS ok, CAST(l_quantity AS BIGINT) AS tokens, (l_suppkey % 12) % 4 = 1 AND l_partkey % 50 = 0 AS bad FROM lineitem)"
TEMPLATE_NUMBER = "CAST(o_orderkey AS VARCHAR)"

ENDED = """ended AS (SELECT o_orderkey, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 8 = 1 THEN 'local-verified' WHEN o_orderkey % 3 = 0 THEN 'escalated' WHEN o_orderkey % 5 = 0 THEN 'local-unverified' WHEN o_orderkey % 7 = 0 AND o_orderkey % 11 > 0 THEN CASE WHEN o_orderkey % 14 = 0 THEN 'local-verified' ELSE 'local-unverified' END ELSE 'fallback' END AS path FROM orders)"""

EVALUATION = f"""WITH {POLICED}, sp AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'test' WHEN id % 5 = 1 THEN 'calibration' ELSE 'train' END AS split, always OR score >= 0.5 AS p, NOT (always OR score >= 0.5) AND NOT verified AND NOT trusted AS r FROM policed),
m AS (SELECT split, count(*) AS n, count(*) FILTER (p AND NOT correct) AS tp, count(*) FILTER (p AND correct) AS fp, count(*) FILTER (NOT p AND correct) AS tn, count(*) FILTER (NOT p AND NOT correct) AS fn, count(*) FILTER (NOT correct AND (p OR r)) AS ef, count(*) FILTER (late) AS slow, count(*) FILTER (late AND p) AS slowp, count(*) FILTER (NOT p AND NOT r AND NOT correct) AS unsafe,
  sum(CASE WHEN p THEN 1.0 - 0.95::DOUBLE WHEN verified OR trusted OR latency_s > 17 THEN (CASE WHEN correct THEN 0.0 ELSE 1.0 END) ELSE 1.0 - 0.95::DOUBLE END) AS misses, count(*) FILTER (p OR r) AS escalations, count(*) FILTER (NOT p AND NOT r) AS kept, count(*) FILTER (r) AS reactive, count(*) FILTER (r AND latency_s > 17) AS risk, count(*) FILTER (r AND latency_s > 17 AND NOT correct) AS fb, count(*) FILTER (p) AS planned FROM sp GROUP BY split),
v AS (SELECT split, unnest([{{'section': 'confusion', 'field': 'n', 'value': CAST(n AS DOUBLE)}}, {{'section': 'confusion', 'field': 'tp', 'value': CAST(tp AS DOUBLE)}}, {{'section': 'confusion', 'field': 'fp', 'value': CAST(fp AS DOUBLE)}}, {{'section': 'confusion', 'field': 'tn', 'value': CAST(tn AS DOUBLE)}}, {{'section': 'confusion', 'field': 'fn', 'value': CAST(fn AS DOUBLE)}},
  {{'section': 'confusion', 'field': 'accuracy', 'value': {ratio('tp + tn', 'n')}}}, {{'section': 'confusion', 'field': 'escalate_precision', 'value': {ratio('tp', 'tp + fp')}}}, {{'section': 'confusion', 'field': 'escalate_recall', 'value': {ratio('tp', 'tp + fn')}}}, {{'section': 'confusion', 'field': 'local_precision', 'value': {ratio('tn', 'tn + fn')}}}, {{'section': 'confusion', 'field': 'local_recall', 'value': {ratio('tn', 'tn + fp')}}},
  {{'section': 'safety', 'field': 'planned_recall', 'value': {ratio('tp', 'tp + fn', 1.0)}}}, {{'section': 'safety', 'field': 'final_recall', 'value': {ratio('ef', 'tp + fn', 1.0)}}}, {{'section': 'safety', 'field': 'slow_planned_recall', 'value': {ratio('slowp', 'slow', 1.0)}}}, {{'section': 'safety', 'field': 'unsafe_rate', 'value': {ratio('unsafe', 'n')}}},
  {{'section': 'projection', 'field': 'expected_misses', 'value': round(misses * (19.0::DOUBLE / n), 3)}}, {{'section': 'projection', 'field': 'expected_escalations', 'value': round(escalations * (19.0::DOUBLE / n), 2)}}, {{'section': 'projection', 'field': 'expected_tokens', 'value': round(escalations * (19.0::DOUBLE / n) * 180, 0)}}, {{'section': 'projection', 'field': 'local_share', 'value': round(CAST(kept AS DOUBLE) / n, 3)}}, {{'section': 'projection', 'field': 'projected_accuracy', 'value': round(1 - misses / n, 4)}}, {{'section': 'projection', 'field': 'planned_escalations', 'value': round(planned * (19.0::DOUBLE / n), 2)}}, {{'section': 'projection', 'field': 'reactive_escalations', 'value': round(reactive * (19.0::DOUBLE / n), 2)}}, {{'section': 'projection', 'field': 'reactive_at_risk', 'value': round(risk * (19.0::DOUBLE / n), 2)}}, {{'section': 'projection', 'field': 'fallback_misses', 'value': round(fb * (19.0::DOUBLE / n), 3)}}, {{'section': 'projection', 'field': 'slow_recall', 'value': {ratio('slowp', 'slow', 1.0)}}}]) AS e FROM m),
evaluation AS (SELECT split, e.section AS section, e.field AS field, e.value AS value FROM v)"""

ORACLE: dict[str, str] = {
    "category_histogram": f"WITH {PROMPTS} SELECT {classified('prompt')} AS category, count(*) AS n FROM prompts GROUP BY ALL",
    "task_scope": f"""WITH {PROMPTS} SELECT CASE WHEN id % 5 = 0 THEN 'math' WHEN id % 5 = 1 THEN 'logic' ELSE {classified('prompt')} END AS scope, regexp_replace(task_id, '_[^_]*$', '') AS prefix, count(*) AS n FROM prompts GROUP BY ALL""",
    "hash_features": f"WITH {FEATURES} SELECT CAST(idx AS INT) AS idx, CAST(sum(n) AS BIGINT) AS n, count(*) AS prompts FROM counts GROUP BY idx",
    "route_scores": f"WITH {FEATURES}, s AS (SELECT id, -0.25 + sum(((idx * 37) % 201 - 100) / 1000.0 * (1 + ln(n))) AS logit FROM counts GROUP BY id) SELECT id, round(1 / (1 + exp(-greatest(-30.0, least(30.0, logit)))), 6) AS score FROM s",
    "local_cost": f"WITH {COSTED} SELECT id, category, round(cost, 6) AS cost FROM costed",
    "route_plan": f"WITH {PLANNED} SELECT category, route, count(*) AS n, round(sum(cost), 4) AS cost FROM planned GROUP BY ALL",
    "route_plan_modes": f"WITH {PLANNED} SELECT 'remote_first' AS mode, CASE WHEN route = 'solved' THEN route ELSE 'remote' END AS route, count(*) AS n FROM planned GROUP BY ALL UNION ALL SELECT 'no_remote', CASE WHEN route = 'solved' THEN route ELSE 'local' END, count(*) FROM planned GROUP BY ALL",
    "deadline_admission": f"WITH {QUEUED}, o AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY queue ORDER BY cost, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS started FROM queued) SELECT id, queue, round(started, 3) AS started, cost <= 200.0 - started - 5.0 AS admitted FROM o",
    "remaining_share": f"WITH {QUEUED}, o AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY queue ORDER BY cost, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS started, count(*) OVER (PARTITION BY queue) - row_number() OVER (PARTITION BY queue ORDER BY cost, id) + 1 AS todo_left FROM queued) SELECT id, todo_left, round(greatest(3.0, least(25.0, (540.0 - started - 5.0) / todo_left)), 4) AS budget FROM o",
    "answer_paths": f"""WITH {RECORDS}, x AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'solved' WHEN score >= 0.6 THEN 'remote' ELSE 'local' END AS route, id % 7 <> 0 AS rok, latency_s < 20 AS adm FROM records)
SELECT CASE WHEN route = 'solved' THEN 'exact' WHEN route = 'remote' THEN (CASE WHEN rok THEN 'remote' WHEN adm THEN 'local_backup' ELSE 'fallback' END) WHEN adm AND (verified OR category = 'en') THEN 'local' WHEN rok THEN 'remote' WHEN adm THEN 'local_backup' ELSE 'fallback' END AS path, count(*) AS n FROM x GROUP BY ALL""",
    "final_answers": f"""WITH {ANSWERS}, t AS (SELECT conv_id * 1000 + turn AS idx FROM conversations WHERE role = 'user'), a AS (SELECT id * 1000 + turn - 1 AS idx, CASE WHEN turn % 3 > 0 THEN answer END AS answer FROM answers)
SELECT t.idx, CAST(t.idx AS VARCHAR) AS task_id, coalesce(CASE WHEN t.idx % 13 > 0 AND trim(answer) <> '' THEN answer END, '{P.FALLBACK_ANSWER}') AS answer FROM t LEFT JOIN a ON a.idx = t.idx""",
    "last_number": "SELECT o_orderkey, round(o_totalprice, 2) AS number FROM orders",
    "labeled_line": f"WITH {ANSWERS} SELECT id, turn, CAST(turn AS VARCHAR) || ' units' AS line, trim(answer) AS rest FROM answers",
    "sentence_word_counts": f"""SELECT doc_id, CAST({SENTENCES.format("('Dr. No paid 3.5 dollars, e.g. in cash. ' || coalesce(text, ''))")} AS INT) AS sentences, CAST({WORDS.format("coalesce(text, '')")} AS INT) AS words FROM documents""",
    "summary_constraints": f"""WITH {ANSWERS}, {ASKS}, c AS (SELECT *, {SENTENCES.format('answer')} AS s, {WORDS.format('answer')} AS w FROM asked)
SELECT id, turn, CAST(sentences_exact AS INT) AS sentences_exact, CAST(words_max AS INT) AS words_max, CAST(words_exact AS INT) AS words_exact, array_to_string(list_filter([CASE WHEN s <> sentences_exact THEN 'expected ' || sentences_exact || ' sentence(s), got ' || s END, CASE WHEN w > words_max THEN 'over ' || words_max || ' words (' || w || ')' END, CASE WHEN w <> words_exact THEN 'expected exactly ' || words_exact || ' words' END], lambda x: x IS NOT NULL), '; ') AS violations FROM c""",
    "enforced_summary": rf"""WITH {ANSWERS}, j AS (SELECT id, turn, CASE WHEN turn % 4 = 1 AND trim(answer) <> '' THEN regexp_replace(regexp_replace(trim(answer), '[.!?]+$', ''), '[.!?]+\s+', '; ', 'g') || '.' ELSE trim(answer) END AS t FROM answers), w AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS ws FROM j)
SELECT id, turn, CASE WHEN len(ws) > 9 THEN regexp_replace(array_to_string(list_slice(ws, 1, 9), ' '), '[,;:]+$', '') || '.' ELSE t END AS fixed FROM w""",
    "confidence_filter": f"WITH {ANSWERS} SELECT length(trim(CASE WHEN id % 3 = 0 THEN answer || ' but I''m not sure.' ELSE answer END)) >= 15 AND id % 3 <> 0 AS confident, count(*) AS n FROM answers GROUP BY ALL",
    "answer_agreement": f"""WITH {ANSWERS}, x AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'It is the ' || answer ELSE prompt END AS other FROM answers) SELECT id, turn, {agree('answer', 'other')} AS agree, FALSE AS clash FROM x""",
    "factual_consensus": f"""WITH {ANSWERS}, x AS (SELECT *, CASE WHEN id % 5 = 0 THEN '' ELSE prompt END AS b FROM answers)
SELECT id, turn, sha256(CASE WHEN trim(b) = '' THEN answer WHEN trim(answer) = '' THEN b WHEN {agree('answer', 'b')} OR turn % 4 = 1 THEN answer ELSE b END) AS chosen FROM x""",
    "sentiment_answers": rf"""WITH {ANSWERS}, x AS (SELECT id, turn, {SENTIMENT_TEXT} AS t FROM answers) SELECT id, turn, nullif(lower(regexp_extract({LATIN.format('t')}, '\b(positive|negative|neutral|mixed)\b', 1, 'i')), '') AS label, CASE id % 3 WHEN 0 THEN regexp_replace(t, '^Positive', 'Mixed') ELSE t END AS settled FROM x""",
    "entity_lines": "SELECT n_name, c_custkey % 3 < 2 AS ok, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "baseline_labels": rf"""WITH {PROMPTS} SELECT CASE id % 5 WHEN 1 THEN 'escalate' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'local_ok' END AS parsed, CASE WHEN {has(LATIN.format('prompt'), P.BASELINE_HARD, 'i')} OR length(prompt) > 280 THEN 'escalate' ELSE 'local_ok' END AS simulated, count(*) AS n FROM prompts GROUP BY ALL""",
    "code_answers": f"""WITH {CODES} SELECT p_partkey, code, CASE WHEN code = '' OR k = 4 THEN '[]' WHEN k IN (0, 3) THEN '[{{"args":[[3,1,2]]}}]' WHEN k = 2 THEN '[{{"args":[5]}}]' ELSE '[{{"args":["hello"]}}]' END AS smoke FROM codes""",
    "spec_tests": f"WITH a AS (SELECT lower('Write code: ' || {pick(SPECS, f'p_partkey % {len(SPECS)}')}) AS ask FROM part) SELECT {SPEC_CASE} AS tests, count(*) AS n FROM a GROUP BY ALL",
    "compact_numbers": r"WITH x AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_discount END AS v FROM lineitem) SELECT CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.6f', v), '0+$', ''), '\.$', '') END AS number, count(*) AS n FROM x GROUP BY ALL",
    "fallback_thresholds": "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 0.7::DOUBLE WHEN o_orderkey % 3 = 0 THEN 0.25 ELSE 0.5 END AS threshold, count(*) AS n FROM orders GROUP BY ALL",
    "remote_budget": f"WITH {RECORDS}, x AS (SELECT id, least(20.0, latency_s / 2 + 25.0 - latency_s, 540.0 - latency_s - 2.0) AS s FROM records) SELECT id, CASE WHEN s >= 1.0 THEN round(s, 6) END AS seconds FROM x",
    "category_stats": f"""WITH {RECORDS}, s AS (SELECT category, count(*) AS n, count(*) FILTER (correct) AS good, count(*) FILTER (correct AND verified) AS verified_correct, count(*) FILTER (correct AND NOT verified) AS unverified_correct, count(*) FILTER (NOT verified) AS unverified_count, list_sort(list(completion_tokens)) AS toks, list_sort(list(latency_s)) AS lats FROM records GROUP BY category)
SELECT category, n, round(CAST(good AS DOUBLE) / n, 3) AS accuracy, verified_correct, unverified_correct, unverified_count, round(CAST(unverified_correct AS DOUBLE) / nullif(unverified_count, 0), 4) AS unverified_accuracy, round({wilson('unverified_correct', 'unverified_count')}, 4) AS unverified_wilson,
  toks[least(n - 1, CAST(floor(0.9::DOUBLE * n) AS BIGINT)) + 1] AS p90_tokens, round(lats[least(n - 1, CAST(floor(0.9::DOUBLE * n) AS BIGINT)) + 1], 3) AS p90_latency FROM s""",
    "stats_with_total": f"WITH {RECORDS} SELECT category, count(*) AS n, count(*) FILTER (correct) AS \"right\", round(CAST(count(*) FILTER (correct) AS DOUBLE) / count(*), 3) AS accuracy, round(avg(latency_s), 2) AS mean_latency FROM records GROUP BY ROLLUP (category)",
    "wilson_policy": f"""WITH {RECORDS}, s AS (SELECT category, CAST(count(*) FILTER (correct) AS DOUBLE) / count(*) AS accuracy, count(*) FILTER (NOT verified) AS unverified, count(*) FILTER (correct AND NOT verified) AS k FROM records GROUP BY category), w AS (SELECT *, {wilson('k', 'unverified')} AS wilson FROM s)
SELECT category, round(accuracy, 6) AS accuracy, unverified, round(wilson, 6) AS wilson, CASE WHEN accuracy < 0.70 THEN 'always_escalate' WHEN unverified >= 10 AND wilson >= 0.90 THEN 'trust_local' ELSE 'none' END AS decision FROM w""",
    "confusion_metrics": f"WITH {CONFUSION} SELECT * FROM confusion",
    "safety_metrics": f"WITH {POLICED}, {SAFETY} SELECT * FROM safety",
    "simulate_threshold": f"WITH {simulated('SELECT 0.5::DOUBLE AS threshold')} SELECT * FROM sim",
    "threshold_sweep": f"WITH {simulated(ALL_THRESHOLDS)} SELECT * FROM sim",
    "picked_threshold": f"""WITH {simulated(ALL_THRESHOLDS)}, r AS (SELECT *, expected_misses <= 1.0 AND slow_recall >= 0.9 AS fits FROM sim)
SELECT * EXCLUDE (fits) FROM r ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, CASE WHEN fits THEN expected_tokens ELSE -slow_recall END, expected_misses, CASE WHEN fits THEN 0 ELSE expected_tokens END, threshold LIMIT 1""",
    "router_gates": f"""WITH {simulated('SELECT 0.5::DOUBLE AS threshold')}, {CONFUSION.partition('policed AS')[2].partition('), m AS')[2].join(['m AS', ''])}, {SAFETY},
g AS (SELECT unnest([{{'rule': 'count', 'value': c.n::DOUBLE, 'ok': c.n >= 40}}, {{'rule': 'class_support', 'value': least(tp + fn, tn + fp)::DOUBLE, 'ok': least(tp + fn, tn + fp) >= 8}}, {{'rule': 'balanced_accuracy', 'value': balanced_accuracy, 'ok': balanced_accuracy >= 0.65}}, {{'rule': 'escalate_recall', 'value': escalate_recall, 'ok': escalate_recall >= 0.80}},
  {{'rule': 'final_recall', 'value': final_recall, 'ok': final_recall >= 0.95}}, {{'rule': 'slow_recall', 'value': slow_planned_recall, 'ok': slow_planned_recall >= 0.90}}, {{'rule': 'unsafe_rate', 'value': unsafe_rate, 'ok': unsafe_rate <= 0.02}}, {{'rule': 'misses_19', 'value': expected_misses, 'ok': expected_misses <= 2.0}}]) AS x FROM confusion c, safety s, sim)
SELECT x.rule AS rule, x.value AS value, x.ok AS ok FROM g""",
    "judge_accuracy": f"""WITH {GRADED}, a AS (SELECT category, count(*) FILTER (ok) AS "right", count(*) AS n FROM graded WHERE ok IS NOT NULL GROUP BY ROLLUP (category))
SELECT category, "right", n, round(100.0::DOUBLE * "right" / n, 1) AS percent, round(CAST("right" AS DOUBLE) / n * 19, 1) AS of_19, CASE WHEN 100.0 * "right" / n >= 90 THEN 'PASS' WHEN 100.0 * "right" / n >= 84 THEN 'THIN' ELSE 'AT RISK' END AS band FROM a""",
    "judge_paths": f"WITH {GRADED} SELECT via, ok, count(*) AS n FROM graded GROUP BY ALL",
    "model_ranking": f"""WITH {MODEL_RUNS}, r AS (SELECT model, count(*) AS n, count(*) FILTER (ok AND NOT bad) AS correct, coalesce(CAST(sum(tokens) FILTER (NOT bad) AS BIGINT), 0) AS total_tokens, count(*) FILTER (bad) AS call_errors FROM model_runs GROUP BY model),
s AS (SELECT model, n, correct, round(CAST(correct AS DOUBLE) / n, 3) AS accuracy, total_tokens, round(CAST(total_tokens AS DOUBLE) / greatest(1, correct), 1) AS tokens_per_correct, call_errors FROM r)
SELECT *, call_errors = 0 AND accuracy >= 0.9 AS safe, CAST(row_number() OVER (ORDER BY CASE WHEN call_errors = 0 AND accuracy >= 0.9 THEN 0 ELSE 1 END, accuracy DESC, call_errors, tokens_per_correct, total_tokens, model) AS INT) AS place FROM s""",
    "model_grid": "SELECT 'org/' || s_name AS model, mode, style FROM supplier, (VALUES ('default'), ('reasoning_off')) m(mode), (VALUES ('raw'), ('category')) s(style)",
    "hint_pick": "SELECT p_name AS model, p_partkey AS idx, CAST(CASE WHEN contains(lower(p_name), 'zzz') THEN 0 WHEN contains(lower(p_name), '9') THEN 1 WHEN contains(lower(p_name), '1') THEN 2 ELSE 3 END AS INT) AS hint FROM part ORDER BY hint, idx LIMIT 1",
    "usage_tokens": f"WITH {USAGE} SELECT CASE k WHEN 0 THEN 'provider' WHEN 1 THEN 'derived' ELSE 'unknown' END AS source, count(*) AS n, CAST(sum(CASE k WHEN 0 THEN o WHEN 1 THEN o + 7 END) AS BIGINT) AS tokens FROM usage GROUP BY ALL",
    "policy_tokens": f"WITH {RUNS} SELECT event_id, CASE WHEN tokens IS NOT NULL THEN event_id % 40 END AS saved, CASE WHEN event_id % 40 + tokens > 0 THEN round(CAST(event_id % 40 AS DOUBLE) / (event_id % 40 + tokens) * 100, 2) END AS percent, CAST(greatest(8, round(length(stage) / 4.0)) + 5 AS INT) AS simulated FROM runs",
    "null_poisoned_totals": f"WITH {RUNS} SELECT session, stage, CASE WHEN count(*) FILTER (tokens IS NULL) = 0 THEN CAST(sum(tokens) AS BIGINT) END AS total, count(*) AS n FROM runs GROUP BY ALL",
    "session_totals": f"WITH {RUNS} SELECT session, count(*) AS queries, coalesce(CAST(sum(tokens) AS BIGINT), 0) AS tokens, count(*) FILTER (tokens IS NULL) > 0 AS tokens_unknown FROM runs GROUP BY session",
    "recent_history": f"WITH {RUNS}, o AS (SELECT session, event_id, CAST(row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM runs) SELECT * FROM o WHERE place <= 8",
    "rate_limit_windows": f"WITH {RUNS}, o AS (SELECT session, date_trunc('day', ts) AS window_start, row_number() OVER (PARTITION BY session, date_trunc('day', ts) ORDER BY ts, event_id) AS k FROM runs) SELECT session, CAST(window_start AS TIMESTAMP) AS window_start, count(*) FILTER (k <= 2) AS allowed, count(*) FILTER (k > 2) AS denied FROM o GROUP BY ALL",
    "run_lifecycle": "WITH e AS (SELECT event_id // 6 AS runId, (event_id * 5) % 7 AS k FROM events) SELECT runId, count(*) AS events, count(*) FILTER (k = 6) > 0 AS failed, count(*) FILTER (k = 2) > 0 AND count(*) FILTER (k = 4) > 0 AND count(*) FILTER (k = 5) > 0 AND count(*) FILTER (k = 6) = 0 AS complete FROM e GROUP BY runId",
    "late_events": f"WITH {RUNS} SELECT stage, count(*) AS n FROM runs WHERE ts <= date_trunc('day', ts) + INTERVAL 18 HOUR GROUP BY stage",
    "current_runs": f"WITH {RUNS}, s AS (SELECT session, event_id // 500 AS sequence, max(event_id // 500) OVER (PARTITION BY session) AS newest FROM runs) SELECT session, count(*) AS n, max(sequence) AS sequence FROM s WHERE sequence = newest GROUP BY session",
    "run_states": """WITH e AS (SELECT event_id, event_id // 8 AS runId, event_id % 8 AS p, epoch_us(ts) + 60000000 * ((event_id * 37) % 11) AS micros FROM events),
  k AS (SELECT *, CASE WHEN p < 6 THEN p + CASE WHEN runId % 11 = 0 THEN 1 ELSE 0 END WHEN p = 6 THEN runId % 8 ELSE (runId * 3) % 8 END AS k, min(micros) OVER (PARTITION BY runId) + 3600000000 AS deadline FROM e),
  s AS (SELECT *, list_extract(['run.started', 'baseline.started', 'baseline.completed', 'answer.started', 'answer.completed', 'comparison.completed', 'run.error', 'run.note'], CAST(k + 1 AS INT)) AS kind FROM k),
  o AS (SELECT *, row_number() OVER (PARTITION BY runId ORDER BY micros, event_id, kind) AS place FROM s),
  a AS (SELECT runId, list(CASE WHEN micros > deadline THEN 9 ELSE k END ORDER BY place) AS ks, list_filter(list(CASE WHEN micros <= deadline THEN k END ORDER BY place), lambda x: x IS NOT NULL) AS timely FROM o GROUP BY runId),
  f AS (SELECT o.*, list_reduce(list_prepend(0, ks[: place - 1]), lambda s, x: CASE WHEN s >= 100 THEN s WHEN x IN (6, 9) THEN 100 WHEN x = s THEN CASE WHEN s = 5 THEN 100 ELSE s + 1 END ELSE s END) AS state,
    list_reduce(list_prepend(0, timely), lambda s, x: CASE WHEN s >= 100 THEN s WHEN x = 6 THEN 100 WHEN x = s THEN CASE WHEN s = 5 THEN 100 ELSE s + 1 END ELSE s END) AS final FROM o JOIN a USING (runId))
SELECT runId, micros, event_id, kind, CASE WHEN state >= 100 OR micros > deadline THEN 'after the end' WHEN k = 6 OR k = state THEN 'accepted' WHEN k = 7 THEN 'unknown' WHEN k < state THEN 'repeated' ELSE 'out of order' END AS verdict FROM f
UNION ALL SELECT runId, deadline, NULL, 'run.timeout', 'timed out' FROM f WHERE place = 1 AND final < 100""",
    "final_events": """WITH e AS (SELECT event_id, event_id // 8 AS runId, event_id % 8 AS p, epoch_us(ts) + 60000000 * ((event_id * 37) % 11) AS micros FROM events),
  k AS (SELECT *, CASE WHEN p < 6 THEN p + CASE WHEN runId % 11 = 0 THEN 1 ELSE 0 END WHEN p = 6 THEN runId % 8 ELSE (runId * 3) % 8 END AS k, row_number() OVER (PARTITION BY runId ORDER BY micros, event_id) AS place FROM e)
SELECT runId, event_id, CASE WHEN place > min(place) FILTER (k = 6) OVER (PARTITION BY runId) THEN 'late' ELSE 'on time' END AS verdict FROM k""",
    "superseded_events": f"WITH {RUNS}, s AS (SELECT *, event_id // 500 - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS sequence FROM runs) SELECT event_id, session, sequence, CASE WHEN sequence >= max(sequence) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) THEN 'current' ELSE 'stale' END AS verdict FROM s",
    "limited_requests": f"WITH {RUNS} SELECT event_id, session, CASE WHEN row_number() OVER (PARTITION BY session, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 THEN 'allowed' ELSE 'denied' END AS verdict FROM runs",
    "probe_waves": f"WITH {RECORDS}, o AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) AS k FROM records) SELECT category, CAST(CASE WHEN k <= 3 THEN 1 ELSE 2 END AS INT) AS wave, count(*) AS n, max(id) AS last FROM o GROUP BY ALL",
    "coverage_report": f"""WITH {PROMPTS}, f AS (SELECT task_id, CASE WHEN id % 10 > 0 AND id % 7 = 0 AND id % 21 <> 1 THEN 'missing' WHEN id % 10 = 0 AND (id % 7 > 0 OR id % 21 = 1) THEN 'extra' WHEN id % 10 > 0 AND id % 7 > 0 AND id % 21 = 1 THEN 'duplicate' WHEN id % 10 > 0 AND id % 7 > 0 AND id % 12 = 5 THEN 'mismatch' END AS finding FROM prompts) SELECT * FROM f WHERE finding IS NOT NULL""",
    "dedupe_last_wins": f"WITH {RUNS} SELECT session, max(event_id) AS last, arg_max(stage, event_id) AS stage, min(event_id) AS first FROM runs GROUP BY session",
    "unlabeled_tasks": f"WITH {PROMPTS} SELECT regexp_replace(task_id, '_[^_]*$', '') AS prefix, count(*) AS n FROM prompts WHERE id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL",
    "split_invariants": f"WITH {RECORDS} SELECT count(*) FILTER (id % 25 = 5 AND id % 10 <> 3) AS overlapping, 0::BIGINT AS repeated, 0::BIGINT AS unknown, count(*) FILTER (id % 10 = 3 AND id % 25 <> 5) AS uncovered FROM records",
    "exact_decontamination": r"WITH k AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key FROM documents) SELECT doc_id FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 20 = 0)",
    "jaccard_near_dups": f"WITH {ANSWERS}, t AS (SELECT id, turn, list_distinct(regexp_extract_all(lower(prompt), '<[^>]+>|[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(answer), '<[^>]+>|[a-z0-9_]+')) AS b FROM answers) SELECT id, turn, round(coalesce(CAST(len(list_intersect(a, b)) AS DOUBLE) / nullif(len(list_distinct(list_concat(a, b))), 0), 1.0), 6) AS similarity FROM t",
    "stratum_counts": f"WITH {RECORDS} SELECT category, label, count(*) AS n FROM records GROUP BY ALL",
    "subset_picks": f"WITH {RECORDS}, o AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY category) AS n FROM records) SELECT category, id, CAST(k AS INT) AS k FROM o WHERE k IN (0, n // 2, n - 1)",
    "running_ids": f"WITH {RECORDS} SELECT id, category || '_' || lpad(CAST(row_number() OVER (PARTITION BY category ORDER BY id) AS VARCHAR), 6, '0') AS name FROM records",
    "record_digests": "WITH f AS (SELECT lang || '/' || source AS path, sha256(coalesce(text, '')) AS d FROM documents), p AS (SELECT path, sha256(concat_ws(':', count(*), "
    + ", ".join(f"CAST(sum(CAST('0x' || d[{8 * k + 1}:{8 * k + 8}] AS BIGINT)) AS VARCHAR)" for k in range(8))
    + ")) AS digest FROM f GROUP BY path) SELECT sha256(string_agg(path || chr(0) || digest || chr(10), '' ORDER BY path)) AS digest FROM p",
    "waived_digest": "SELECT sha256(string_agg(n_name || chr(0) || sha256(n_name) || chr(10), '' ORDER BY n_name)) AS digest FROM nation",
    "label_violations": f"""WITH {RECORDS}, v AS (SELECT unnest(CASE WHEN len(b) = 0 THEN [NULL] ELSE b END) AS rule FROM (SELECT list_filter([CASE WHEN id % 9 = 0 THEN 'label is unknown' END, CASE WHEN id % 17 = 0 THEN 'task_id is blank or untrimmed' END, CASE WHEN id % 9 = 0 THEN 'label contradicts correct' END, CASE WHEN id % 5 = 0 THEN 'category is unknown' END, CASE WHEN id % 5 = 0 THEN 'category is not the classifier''s' END, CASE WHEN id % 10 = 1 THEN 'dataset_category is unknown' END,
  CASE WHEN id % 6 = 0 THEN 'latency_s is negative or no number' END, CASE WHEN id % 11 = 0 THEN 'completion_tokens is negative or missing' END, CASE WHEN id % 8 = 0 THEN 'model is blank' END, CASE WHEN id % 7 = 0 THEN 'provenance has another schema version' END, CASE WHEN id % 13 = 0 THEN 'provenance.gguf_sha256 is no digest' END, CASE WHEN id % 14 = 0 THEN 'provenance.budget_seconds is not positive' END, CASE WHEN id % 15 = 0 THEN 'provenance.threads is not positive' END], lambda x: x IS NOT NULL) AS b FROM records)) SELECT rule, count(*) AS n FROM v GROUP BY rule""",
    "records_digest": "WITH r AS (SELECT sha256(concat_ws('|', doc_id, coalesce(lang, '~'), coalesce(source, '~'), coalesce(CAST(n_chars AS VARCHAR), '~'), coalesce(sha256(text), '~'))) AS d FROM documents) SELECT sha256(concat_ws(':', count(*), "
    + ", ".join(f"CAST(sum(CAST('0x' || d[{8 * k + 1}:{8 * k + 8}] AS BIGINT)) AS VARCHAR)" for k in range(8))
    + ")) AS digest FROM r",
    "request_guards": f"WITH {PROMPTS} SELECT CASE WHEN trim(prompt) = '' THEN 'blank' WHEN length(trim(prompt)) > 8000 THEN 'too long' WHEN strlen(prompt) > 24000 THEN 'too large' ELSE 'ok' END AS reason, count(*) AS n FROM prompts GROUP BY ALL",
    "safe_eval": """SELECT l_quantity, l_linenumber, round(CASE l_linenumber WHEN 1 THEN l_quantity * 3 - 5 WHEN 2 THEN 1200.0::DOUBLE / l_quantity WHEN 3 THEN CAST(greatest(l_quantity, 7) ** 2 AS DOUBLE) WHEN 4 THEN NULL ELSE CAST(floor(-l_quantity / l_linenumber) AS DOUBLE) END, 6) AS value, count(*) AS n FROM lineitem GROUP BY ALL""",
    "code_test_runs": "SELECT r_regionkey, r_regionkey % 2 = 0 AS passes FROM region",
    "normalized_prompts": rf"WITH {PROMPTS} SELECT id, sha256(replace(trim(regexp_replace(lower(prompt), '\s+', ' ', 'g')), 'ß', 'ss')) AS digest FROM prompts",
    "puzzle_solver": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 'Cy' WHEN n_nationkey % 2 = 1 AND n_nationkey % 3 = 0 THEN 'Cy' WHEN n_nationkey % 2 = 1 THEN 'Bob' END AS person, CASE WHEN n_nationkey % 2 = 1 OR n_nationkey % 3 = 0 THEN 'cat' END AS item FROM nation",
    "math_solutions": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 97 + 1 AS a FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN 'Answer: ' || (a * 3) WHEN k % 4 = 0 THEN 'Answer: ' || (a * 3 + 1) || chr(10) || 'Final answer: ' || (a * 3) WHEN k % 4 = 1 THEN '**Answer:** ' || (a * 3) WHEN k % 4 = 2 THEN 'The answer is ' || (a * 3 + 1) ELSE 'Answer: 7.5' || chr(10) || 'Final answer: ' || (a * 3) END AS answer,
  k % 3 = 0 OR k % 4 IN (1, 2) AS verified FROM o""",
    "code_solutions": """WITH c AS (SELECT n_nationkey, n_nationkey % 5 AS k, '```python' || chr(10) || 'def f(n):' || chr(10) || '    return 1 if n < 2 else n * f(n - 1)' || chr(10) || '```' AS good, '```python' || chr(10) || 'def f(n):' || chr(10) || '    return n' || chr(10) || '```' AS bad FROM nation)
SELECT n_nationkey, CASE k WHEN 0 THEN 'Here it is.' || chr(10) || good WHEN 1 THEN 'Try this:' || chr(10) || chr(10) || good WHEN 2 THEN 'So' || chr(10) || bad WHEN 3 THEN good ELSE 'No code' END AS answer, k IN (0, 1, 3) AS verified FROM c""",
    "task_solutions": """WITH s AS (SELECT s_suppkey, s_suppkey % 10 AS k FROM supplier)
SELECT s_suppkey, list_extract(['Mixed, as it has both positive and negative parts.', 'I find no label in there.', 'Ann - person' || chr(10) || 'Oslo - location', 'Ann is a person', 'Canberra is the capital of Australia.', 'I''m not sure about that at all.', 'This text is short.', 'It is still too.', 'Cy owns the cat. This is the only assignment consistent with all the constraints: Ann has the dog; Bob has the bird; Cy has the cat.', '**Answer:** the second of them, clearly'], CAST(k AS INT) + 1) AS answer,
  k IN (0, 2, 4, 6, 7, 8, 9) AS verified FROM s""",
    "remote_checks": "WITH p AS (SELECT p_partkey % 9 AS k FROM part) SELECT k, k IN (0, 3, 5, 8) AS verified, count(*) AS n FROM p GROUP BY ALL",
    "hosted_answers": """WITH p AS (SELECT p_partkey, p_partkey % 9 AS k, p_partkey % 2 = 0 AS again FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'Answer: 42' WHEN 1 THEN CASE WHEN again THEN 'Answer: 42' ELSE 'Answer: 41' END WHEN 2 THEN 'Answer: 42' WHEN 3 THEN 'mixed feelings' WHEN 4 THEN CASE WHEN again THEN 'Neutral' ELSE 'no label' END WHEN 5 THEN 'One sentence only.' WHEN 6 THEN CASE WHEN again THEN 'One it is.' ELSE 'Two. Sentences.' END WHEN 7 THEN CASE WHEN again THEN 'Found by the other' ELSE '' END ELSE 'Any answer' END AS answer FROM p""",
    "final_paths": f"WITH {ENDED} SELECT o_orderkey, CASE path WHEN 'local-verified' THEN CASE WHEN k % 8 = 1 THEN 'local' ELSE 'late' END WHEN 'escalated' THEN 'hosted' WHEN 'local-unverified' THEN CASE WHEN k % 5 = 0 THEN 'kept' ELSE 'late' END ELSE {quoted(P.FALLBACK_ANSWER)} END AS answer, path FROM ended",
    "run_statistics": f"""WITH {ENDED} SELECT count(*) AS n, count(*) FILTER (path = 'local-verified') AS local_verified, count(*) FILTER (path = 'local-unverified') AS local_unverified, count(*) FILTER (path = 'escalated') AS escalated, count(*) FILTER (path = 'fallback') AS fallback, count(*) FILTER (k % 2 = 0) AS planned, count(*) FILTER (k % 3 < 2) AS attempted, count(*) FILTER (k % 3 = 0) AS succeeded,
  CAST(sum(CASE WHEN k % 9 = 0 THEN 50 WHEN k % 6 = 0 THEN 27 ELSE 0 END) AS BIGINT) AS known_tokens, count(*) FILTER (k % 6 = 0 AND k % 9 > 0) AS usage_derived, count(*) FILTER (k % 3 = 0 AND k % 9 > 0 AND k % 6 > 0) AS usage_unknown FROM ended""",
    "run_summary": f"WITH {ENDED} SELECT count(*) FILTER (path <> 'fallback') AS answered, count(*) FILTER (path = 'fallback') AS empty, round(avg(CAST(floor(o_totalprice) AS BIGINT) % 60), 2) AS mean_seconds FROM ended JOIN orders USING (o_orderkey)",
    "response_fields": "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN 'Said ' || event_type END AS answer, CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(NULL AS BIGINT) AS completion_tokens, CAST(CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 6 END AS BIGINT) AS reasoning_tokens, CASE WHEN event_id % 4 > 0 THEN CAST(floor(value) AS BIGINT) END AS total_tokens FROM events",
    "extra_options": """SELECT CASE WHEN p_partkey % 3 = 0 THEN '{"reasoning_effort":"none"}' ELSE '{}' END AS options, count(*) AS n FROM part GROUP BY ALL""",
    "phase_timeouts": "WITH t AS (SELECT l_linenumber AS k, l_quantity / 2 AS r, least(3.0, greatest(0.25, l_quantity / 2 * 0.2)) AS c FROM lineitem) SELECT round(CAST(c AS DOUBLE), 6) AS connect, round(CAST(greatest(0.25, r - c - 0.25) AS DOUBLE), 6) AS read, CAST(CASE WHEN k = 1 THEN 5 ELSE least(1000, k * 400 - 400) END AS BIGINT) AS runs, count(*) AS n FROM t GROUP BY ALL",
    "request_statuses": rf"""WITH {PROMPTS} SELECT CAST(CASE WHEN id % 10 = 0 THEN 415 WHEN strlen(CAST(to_json(prompt) AS VARCHAR)) + strlen('{{"prompt":,"category":"math","localDecision":{{"label":"","pEscalate":,"threshold":0.5,"latencyMs":3,"revision":" r1 "}}}}') + CASE WHEN id % 7 = 0 THEN 5 ELSE 8 END + CASE WHEN id % 9 = 0 THEN 3 ELSE 4 END > 24000 THEN 413
  WHEN id % 7 = 0 OR id % 9 = 0 OR trim(prompt) = '' OR length(trim(prompt, ' ' || chr(9) || chr(10) || chr(13))) > 8000 THEN 400 END AS INT) AS status, count(*) AS n FROM prompts GROUP BY ALL""",
    "decision_checks": f"WITH {RECORDS} SELECT id % 10 AS k, NOT (id % 10 IN (1, 2, 4, 5) OR (id % 10 = 3 AND label <> 'local_ok')) AS matches, count(*) AS n FROM records GROUP BY ALL",
    "runtime_settings": f"""WITH {RECORDS}, t AS (SELECT * FROM records WHERE id % 5 > 1), o AS (SELECT category, count(*) AS n, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (NOT verified) AS u, count(*) FILTER (correct AND NOT verified) AS uc, list_sort(list(completion_tokens)) AS ct, list_sort(list(latency_s)) AS lat FROM t GROUP BY category)
SELECT category, CASE WHEN accuracy < 0.7 THEN 'always_escalate' WHEN u >= 10 AND {wilson('uc', 'u')} >= 0.9 THEN 'trust_local' ELSE 'none' END AS decision, ct[CAST(least(n - 1, floor(0.9 * n)) AS BIGINT) + 1] AS expected_tokens, round(lat[CAST(least(n - 1, floor(0.9 * n)) AS BIGINT) + 1], 3) AS expected_latency FROM o""",
    "split_evaluation": EVALUATION + " SELECT split, section, field, value FROM evaluation",
    "recomputed_metrics": EVALUATION + " SELECT section, field, NOT (field IN ('fp', 'tp', 'accuracy')) AS ok, count(*) AS n FROM evaluation GROUP BY ALL",
    "score_metrics": f"WITH {RECORDS}, m AS (SELECT count(*) AS n, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn FROM (SELECT score >= 0.5 AS p, label = 'escalate' AS y FROM records)) SELECT n, round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(n, 0), 0), 3) AS accuracy, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 3) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 3) AS recall FROM m",
    "labeling_report": f"""WITH {RECORDS}, every AS (SELECT * FROM records UNION ALL SELECT * REPLACE (NULL AS category) FROM records),
  s AS (SELECT category, count(*) AS n, count(*) FILTER (correct) AS good, count(*) FILTER (correct AND verified) AS verified_correct, count(*) FILTER (correct AND NOT verified) AS unverified_correct, count(*) FILTER (NOT verified) AS unverified_count, round(avg(latency_s), 2) AS mean_latency, list_sort(list(completion_tokens)) AS toks, list_sort(list(latency_s)) AS lats FROM every GROUP BY category)
SELECT category, n, round(CAST(good AS DOUBLE) / n, 3) AS accuracy, verified_correct, unverified_correct, unverified_count, round(CAST(unverified_correct AS DOUBLE) / nullif(unverified_count, 0), 4) AS unverified_accuracy, round({wilson('unverified_correct', 'unverified_count')}, 4) AS unverified_wilson,
  toks[least(n - 1, CAST(floor(0.9::DOUBLE * n) AS BIGINT)) + 1] AS p90_tokens, round(lats[least(n - 1, CAST(floor(0.9::DOUBLE * n) AS BIGINT)) + 1], 3) AS p90_latency, mean_latency FROM s""",
    "calibrated_threshold": f"""WITH {simulated(ALL_THRESHOLDS, CALIBRATED)}, r AS (SELECT *, expected_misses <= 1.0 AND slow_recall >= 0.9 AS fits FROM sim)
SELECT * EXCLUDE (fits) FROM r ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, CASE WHEN fits THEN expected_tokens ELSE -slow_recall END, expected_misses, CASE WHEN fits THEN 0 ELSE expected_tokens END, threshold LIMIT 1""",
    "provenance_checks": f"""WITH {RECORDS} SELECT count(*) AS records, count(*) FILTER (id % 10 = 0) AS missing, count(DISTINCT CASE WHEN id % 10 > 0 THEN id % 4 = 0 END) AS "distinct", count(*) FILTER (id % 10 = 0) = 0 AND count(DISTINCT CASE WHEN id % 10 > 0 THEN id % 4 = 0 END) = 1 AS ok FROM records""",
    "excluded_groups": "WITH e AS (SELECT n_name AS task_id FROM nation UNION ALL SELECT unnest(['', 'CHINA']) FROM (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey = 1)) SELECT task_id, count(*) AS n, count(*) = 1 AND task_id <> '' AS ok FROM e GROUP BY task_id",
    "excluded_prompts": rf"WITH {PROMPTS}, k AS (SELECT id, trim(regexp_replace(lower(prompt), '\s+', ' ', 'g')) AS key FROM prompts) SELECT id, key IN (SELECT trim(regexp_replace(lower(prompt), '\s+', ' ', 'g')) FROM prompts WHERE id % 20 = 0) OR key IN (SELECT key FROM k WHERE id % 30 = 0) AS excluded FROM k",
    "open_tasks": "SELECT c_custkey AS task_id, n_name AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "phrased_specs": "SELECT n_nationkey AS id, replace(p, '{}', lower(n_name)) AS prompt FROM nation CROSS JOIN (SELECT unnest(['Write a function for {}.', 'Please implement {} and {}', 'Code it']) AS p)",
    "run_timeouts": "WITH r AS (SELECT event_id // 6 AS runId, min(ts) AS started, min(ts) FILTER (event_id % 4 = 3) AS ended FROM events GROUP BY ALL) SELECT runId, epoch_us(started) AS started_us, coalesce(floor(epoch(ended)) - floor(epoch(started)) > 432000, TRUE) AS timed_out FROM r",
    "failure_texts": "SELECT r_regionkey, list_extract(['tests failed', 'input [5], expected 120, got 5', 'no function defined', 'input [5], expected 120, raised ZeroDivisionError(''integer division or modulo by zero''); input [0], raised ZeroDivisionError(''integer division or modulo by zero'')', 'exec: ValueError(''no'')'], CAST(r_regionkey AS INT) + 1) AS failures FROM region",
    "snapshot_runs": f"WITH {RUNS} SELECT session, max(event_id) AS event_id, arg_max(stage, event_id) AS stage, arg_max_null(tokens, event_id) AS tokens FROM runs GROUP BY session",
    "orders_tree_digest": """WITH r AS (SELECT '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS row FROM orders),
  l AS (SELECT row_number() OVER (ORDER BY row) - 1 AS place, sha256(row) AS digest FROM r), n AS (SELECT place // 1024 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM l GROUP BY place // 1024)
SELECT sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM n""",
    "canonical_templates": rf"{TEMPLATES} SELECT canonical, count(*) AS n FROM t GROUP BY canonical",
    "explicit_groups": rf"{TEMPLATES} SELECT scope, explicit, min(task_id) AS leader, count(*) AS n, count(DISTINCT canonical) AS texts FROM t WHERE explicit IS NOT NULL GROUP BY scope, explicit",
    "split_records": rf"""WITH {RECORDS}, g AS (SELECT id, category, label, row_number() OVER (PARTITION BY category, label ORDER BY md5('7::' || task_id), task_id) AS place FROM records),
  c AS (SELECT category, label, count(*) AS n FROM g GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY category, label) AS k, floor(n * 0.6 + 1e-9) AS a, floor(n * 0.2 + 1e-9) AS b FROM c),
  owed AS (SELECT k.*, n - a - 2 * b AS over, round((0.6 * n - a) / n, 9) AS x, round((0.2 * n - b) / n, 9) AS y FROM k),
  firsts AS (SELECT *, CASE WHEN over > 0 AND x >= y THEN 1 ELSE 0 END AS a1, CASE WHEN over > 0 AND x < y THEN 1 ELSE 0 END AS b1 FROM owed),
  seconds AS (SELECT *, round((0.6 * n - a - a1) / n, 9) AS x2, round((0.2 * n - b - b1) / n, 9) AS y2, round((0.2 * n - b) / n, 9) AS z2 FROM firsts),
  ends AS (SELECT category, label, a + a1 + CASE WHEN over > 1 AND x2 >= y2 AND x2 >= z2 THEN 1 ELSE 0 END AS train, b + b1 + CASE WHEN over > 1 AND y2 > x2 AND y2 >= z2 THEN 1 ELSE 0 END AS cal FROM seconds)
SELECT id, CASE WHEN place <= train THEN 'train' WHEN place <= train + cal THEN 'calibration' ELSE 'test' END AS split FROM g JOIN ends USING (category, label)""",
    "task_files": "SELECT row_number() OVER (ORDER BY n_name) - 1 AS idx, n_name AS task_id, 'Tell me of ' || n_name AS prompt FROM nation",
    "truth_files": "SELECT n_name AS task_id, 'contains' AS kind, lower(n_name) AS answer FROM nation",
    "result_files": "SELECT n_name AS task_id, lower(n_name) AS answer FROM nation UNION ALL SELECT CAST(c_custkey AS VARCHAR), lower(c_name) FROM customer",
    "label_files": f"WITH {RECORDS} SELECT label, correct, FALSE AS broken, CAST(2 AS INT) AS threads, count(*) AS n, round(sum(latency_s), 3) AS seconds, CAST(sum(completion_tokens) AS BIGINT) AS tokens FROM records GROUP BY label, correct UNION ALL SELECT NULL, NULL, TRUE, NULL, 1, NULL, NULL",
    "event_files": "WITH e AS (SELECT list_extract(['run.started', 'baseline.started', 'baseline.completed', 'answer.started', 'answer.completed', 'comparison.completed', 'run.error'], CAST((event_id * 5) % 7 AS INT) + 1) AS type, event_id // 6 AS run, CAST(floor(value) AS BIGINT) AS tokens FROM events) SELECT type, count(DISTINCT run) AS runs, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY type",
    "upserted_runs": f"WITH {RUNS} SELECT session, max(event_id) AS event_id, arg_max(stage, event_id) AS stage FROM runs GROUP BY session",
    "presolved_plan": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 0 AND (n_nationkey % 2 = 1 OR n_nationkey % 3 = 0) THEN 'solved' WHEN n_nationkey / 25.0 >= 0.5 THEN 'remote' ELSE 'local' END AS route, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 400 ELSE 300 END AS INT) AS cap FROM nation",
    "bulk_waves": f"WITH {RECORDS}, o AS (SELECT id % 7 AS part, row_number() OVER (PARTITION BY id % 7 ORDER BY id) AS k FROM records) SELECT part, CAST(CASE WHEN k <= 3 THEN 1 ELSE 2 END AS INT) AS wave, k <= 3 OR part <> 5 AS sent, count(*) AS n FROM o GROUP BY ALL",
    "model_picks": "SELECT 'distinct' AS kind, 'org/' || lower(s_name) AS model, s_suppkey AS idx FROM supplier WHERE s_suppkey = 2 UNION ALL SELECT 'configured', 'org/' || lower(s_name), s_suppkey FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT * FROM (SELECT 'last', 'org/' || lower(s_name), s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 1)",
    "credential_lists": "WITH s AS (SELECT s_suppkey, unnest([0, 1, 2]) AS place, unnest(['your_key', trim(s_name), CASE WHEN s_suppkey % 2 = 0 THEN 'Replace-Me' ELSE 'sk-1' END]) AS item FROM supplier) SELECT s_suppkey, CAST(place AS INT) AS place, item, item = 'your_key' OR item = 'Replace-Me' AS placeholder FROM s",
}
# streams give what tables give
ORACLE |= {"streamed_states": ORACLE["run_states"], "streamed_runs": ORACLE["run_lifecycle"]}
ORACLE["merged_labels"] = f"WITH {RECORDS} SELECT id * 7919 % 100003 AS idx, task_id, label, correct FROM records"
