"""The subpackage's queries (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, decontaminate, filter_audit, imatch, jaccard, licenses, main_text, repetition, substrings, token_store, toxicity, turn_repair, url_filter

#: Fixed by the queries' contracts.
VOCABULARY, END_ID = "word_bpe_49k.json", 2


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "ids")
    return token_store.store_ids(table(spark, sf_dir, "documents"), folder, vocabulary(), end_id=END_ID, id_bytes=2)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Fixed by the query's contract: verdict, and host with path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, URL_RULES)
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT row_number() OVER () AS row, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT s.row, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY s.row ORDER BY length(rhost || rpath) DESC) AS k
  FROM s JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM s LEFT JOIN fit ON fit.row = s.row AND k = 1
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")))


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))


#: 50-byte strings as hexadecimal digits, cut from blocks so that no cut starts far into a text.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT doc_id, b * 500 AS start, least(500, n - 49 - b * 500) AS size, substr(h, CAST(b * 1000 + 1 AS BIGINT), 1098) AS part FROM (SELECT doc_id, n, h, unnest(range(0, (n - 49 + 499) // 500)) AS b FROM d WHERE n >= 50)
), strings AS (
  SELECT doc_id, start + i AS place, substr(part, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM (SELECT *, unnest(range(0, size)) AS i FROM blocks)
), hit AS (
  SELECT doc_id, place FROM (SELECT doc_id, place, min(doc_id) OVER (PARTITION BY s) AS first FROM strings) WHERE first < doc_id
), marked AS (
  SELECT doc_id, place, coalesce(place > lag(place) OVER o + 50, TRUE) AS new FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY place)
), spans AS (
  SELECT doc_id, min(place) AS lo, max(place) + 50 AS hi FROM (SELECT doc_id, place, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS k FROM marked) GROUP BY doc_id, k
), totals AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
), gaps AS (
  SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM (SELECT doc_id, lo, hi FROM spans UNION ALL SELECT doc_id, -1, 0 FROM totals)
), kept AS (
  SELECT g.doc_id, string_agg(substr(h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (coalesce(hi, n) - lo) AS BIGINT)), '' ORDER BY lo) AS rest FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Repeats of n words are runs of equal windows at one distance.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), g AS (
  SELECT doc_id, len(w) AS n, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (SELECT unnest([3, 5]) AS k) WHERE len(w) >= k
), h AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS x FROM g
), again AS (SELECT doc_id, k, i, x FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, x) AS m FROM h) WHERE m > 1
), covered AS (
  SELECT doc_id, k, sum(least(k, coalesce(later - i, k))) AS words FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id, k ORDER BY i) AS later FROM again) GROUP BY ALL
), runs AS (
  SELECT a.doc_id, b.i - a.i AS gap, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS run FROM again a JOIN again b ON a.doc_id = b.doc_id AND a.k = 3 AND b.k = 3 AND a.x = b.x AND a.i < b.i
), longest AS (SELECT doc_id, max(m) + 2 AS words FROM (SELECT doc_id, count(*) AS m FROM runs GROUP BY doc_id, gap, run) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(five.words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(three.words, 0) AS BIGINT) AS n_covered, CAST(coalesce(g.words, 0) AS BIGINT) AS longest_repeat
  FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN (SELECT * FROM covered WHERE k = 5) five USING (doc_id) LEFT JOIN (SELECT * FROM covered WHERE k = 3) three USING (doc_id) LEFT JOIN longest g USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * n_covered <= n_words AND longest_repeat <= 60 AS kept FROM m
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS shingle FROM d
), n AS (
  SELECT d.doc_id, count(shingle) AS n_shingles FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(x.n_shingles) + any_value(y.n_shingles) - count(*))
), links AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (
  WITH RECURSIVE r(node, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, links.b FROM r JOIN links ON r.other = links.a) SELECT * FROM r
)
SELECT n.doc_id, n_shingles, min(other) AS component_id FROM n JOIN reach ON node = n.doc_id GROUP BY ALL
"""

#: Every subset of filters as five bits; what an order has applied before a step is one of them.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), v AS (
  SELECT part, doc_id, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(first < doc_id, FALSE)] AS fails FROM d
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), kinds AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM v LEFT JOIN l USING (doc_id) GROUP BY ALL
), f(k) AS (VALUES (1), (2), (3), (4), (5)
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks, 'ABCDE'[a.k] || 'ABCDE'[b.k] || 'ABCDE'[c.k] || 'ABCDE'[d.k] || 'ABCDE'[e.k] AS filter_order
  FROM f a JOIN f b ON b.k <> a.k JOIN f c ON c.k NOT IN (a.k, b.k) JOIN f d ON d.k NOT IN (a.k, b.k, c.k) JOIN f e ON e.k NOT IN (a.k, b.k, c.k, d.k)
), steps AS (SELECT filter_order, ks[: s.k - 1] AS before, CAST(s.k AS INT) AS step, ks[s.k] AS k FROM orders, f s
), r AS (
  SELECT part, filter_order, step, k, sum(CASE WHEN ok AND NOT fails[k] THEN n ELSE 0 END) AS kept, sum(CASE WHEN ok AND fails[k] THEN n ELSE 0 END) AS removed, sum(CASE WHEN NOT ok AND fails[k] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[k] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN ok AND fails[k] THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN ok AND fails[k] THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda x: fails[x])) = 0 AS ok FROM kinds, steps) GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM r
"""

def _edited(best: str, cost: str, edit: str) -> str:
    """SQL: a state's best edits with one more. A state is its cost in nine digits and its audit, so that the least string is the best; ~ is none."""
    return f"CASE WHEN {best} = '~' THEN '~' ELSE lpad(CAST(CAST({best}[:9] AS INT) + {cost} AS VARCHAR), 9, '0') || {best}[10:] || '{edit}' END"


def _inserted(states: str) -> str:
    """SQL: the four states (start, s, u, a) after any inserts."""
    user = f"list_transform([{states}], lambda q: [q[1], q[2], least(q[3], {_edited('least(q[1], q[2], q[4])', '5', 'I')}), q[4]])[1]"
    return f"list_transform([{user}], lambda q: [q[1], q[2], q[3], least(q[4], {_edited('q[3]', '5', 'I')})])[1]"


_WANTED = {"3": "least(q[1], q[2], q[4])", "4": "q[3]"}
_TURNED = ", ".join(
    f"least({_edited(f'q[{k}]', '2', 'D')}, CASE WHEN t[1] = '{initial}' AND t[2] NOT IN ('blank', 'duplicate') THEN {_edited(source, cut, 'K')} ELSE '~' END"
    + (f", CASE WHEN t[2] NOT IN ('blank', 'duplicate') THEN {_edited(source, '1 + ' + cut, 'R')} ELSE '~' END" if k in _WANTED else "") + ")"
    for k, initial, source in (("1", "-", "'~'"), ("2", "s", "q[1]"), ("3", "u", _WANTED["3"]), ("4", "a", _WANTED["4"])) for cut in ["CASE WHEN t[2] = 'truncated' THEN 5 ELSE 0 END"]
)  # fmt: skip
#: The lattice is gone through turn by turn, with the best edits of each state.
OP12_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), h AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM c
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(2) AS again(n) WHERE kind > 0 AND (n = 0 OR kind = 3)
), placed AS (
  SELECT *, role[1] AS initial, rtrim(text, E' 	

') AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role[1], md5(length(role) || ':' || role || ':' || text)) AS place FROM damaged
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY place) AS pair FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list([initial, fault, '', ''] ORDER BY place) AS turns FROM judged GROUP BY conv_id
), best AS (
  SELECT * EXCLUDE (turns, q), least(q[1], q[4]) AS best FROM (
    SELECT *, list_transform([list_reduce(list_prepend(['000000000', '~', '~', '~'], turns), lambda acc, t: list_transform([{_inserted('acc')}], lambda q: [{_TURNED}])[1])], lambda acc: {_inserted('acc')})[1] AS q FROM counted)
), edits AS (
  SELECT conv_id, n, best[9 + n] AS edit, n - length(replace(best[10 : 9 + n], 'I', '')) AS inserted FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS n FROM best)
), lines AS (
  SELECT e.conv_id, n, edit, role, text, edit = 'K' AND initial = 's' AS system, count(*) OVER (PARTITION BY e.conv_id ORDER BY n) AS line, count(*) FILTER (edit = 'K' AND initial = 's') OVER (PARTITION BY e.conv_id ORDER BY n) AS systems
  FROM edits e LEFT JOIN judged j ON j.conv_id = e.conv_id AND edit <> 'I' AND place = n - inserted WHERE edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (line - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY n) AS repaired FROM lines GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(best[:9] AS BIGINT), 0) AS cost, coalesce(best[10:], '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN best b ON b.conv_id = i.conv_id LEFT JOIN texts t ON t.conv_id = i.conv_id
"""

QUERIES = {"op1_token_store": op1_token_store, "op2_substrings": op2_substrings, "op3_main_text": op3_main_text, "op4_bpe": op4_bpe, "op5_licenses": op5_licenses, "op6_decontaminate": op6_decontaminate, "op7_url_filter": op7_url_filter, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality, "op10_jaccard": op10_jaccard, "op11_filter_audit": op11_filter_audit, "op12_turn_repair": op12_turn_repair, "op13_imatch": op13_imatch}
ORACLE: dict[str, str] = {"op2_substrings": OP2_SQL, "op7_url_filter": OP7_SQL, "op9_quality": OP9_SQL, "op10_jaccard": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_turn_repair": OP12_SQL}
