import itertools
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import decontaminate, licenses, main_text, queries, repetition, toxicity, url_filter

from . import brute


def test_suffix_arrays_and_repeats():
    r = random.Random(1)
    for _ in range(150):
        c = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(0, 30))]
        a = np.array(c, np.int64)
        order, lcp = repetition.suffix_array(a)
        assert order.tolist() == sorted(range(len(c)), key=lambda k: c[k:])
        for x in range(1, len(c)):
            s, t = c[order[x - 1] :], c[order[x] :]
            assert lcp[x] == next((k for k in range(min(len(s), len(t))) if s[k] != t[k]), min(len(s), len(t)))
        for least in (1, 2, 3):
            cover, longest = brute.repeats(c, least)
            reach = repetition.repeated(a, least)
            assert set(np.flatnonzero(repetition.spans(reach, least))) == cover and reach.max(initial=0) == longest
            found = repetition.maximal_repeats(a, least)
            assert {k for n, at in found for p in at for k in range(p, p + n)} == cover
            # each occurs at all its places and nowhere else, and neither side can be lengthened
            for n, at in found:
                assert at == [k for k in range(len(c) - n + 1) if c[k : k + n] == c[at[0] : at[0] + n]]
                assert len({c[k - 1] if k else None for k in at}) > 1 or 0 in at
                assert len({c[k + n] if k + n < len(c) else None for k in at}) > 1 or at[-1] + n == len(c)


@pytest.mark.parametrize("words", [150_000, 50])
def test_quality_rows(spark, sf, monkeypatch, words):
    monkeypatch.setattr(repetition, "ARRAY_WORDS", words)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n \n", "a b c d e a b c d e", "x|y\n\nx|y", "long " * 300, "a b c " * 4, " ".join(f"{w} {w} {w} {w}" for w in "abcdefghij"), "same text of some words in a row, said once here", "same text of some words in a row, said once here"]
    rows = {k: r for k, r in zip(range(len(texts)), map(brute.quality, texts))}
    batches = repetition.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1))).collect()
    assert {r["doc_id"]: tuple(r[c] for c in (*repetition.COUNTS, "base_failed", "kept")) for r in batches} == rows
    # the method's verdict is not the base rule's
    assert any(not r["base_failed"] and not r["kept"] for r in batches)


def test_quality_keeps_columns(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x"))
    df = df.unionByName(df.limit(3))
    kept = repetition.judge(df, keep_columns=True)
    assert kept.columns == df.columns and kept.count() == repetition.judge(df).filter("kept").count()
    assert repetition.judge(df.limit(0)).count() == 0 and repetition.judge(df.limit(0), keep_columns=True).count() == 0


def test_a_long_repeat_is_rejected_below_the_base_limit(spark):
    words = [f"w{k}" for k in range(2000)]
    text = " ".join(words + words[:80])
    row = repetition.judge(spark.createDataFrame([(1, text), (2, " ".join(words))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (row[0]["base_failed"], row[0]["kept"], row[0]["longest_repeat"]) == (False, False, 80) and row[1]["kept"]


def items():
    r = random.Random(7)
    voc = [f"w{k}" for k in range(400)]
    return r, voc, [" ".join(r.choice(voc) for _ in range(r.randint(15, 40))) for _ in range(12)]


def test_decontamination(spark):
    r, voc, tests = items()
    noise = lambda n: " ".join(r.choice(voc) for _ in range(n))
    docs, want = [], set()
    for k, t in enumerate(tests):
        docs.append((k, f"{noise(30)} {t.upper()}. {noise(20)}"))
        w = t.split()
        for j in range(5, len(w), 6):
            w[j] = "edited"
        docs.append((100 + k, f"{noise(9)} {' '.join(w)} {noise(9)}"))
        want |= {(k, k), (100 + k, k)}
    docs += [(200 + k, noise(60)) for k in range(40)] + [(300, None), (301, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
    bench = spark.createDataFrame([*enumerate(tests), (50, None), (51, "two words")], "item_id long, text string")
    got = decontaminate.matches(df, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert all(x["score"] == 1 and x["end"] - x["begin"] == len(tests[x["item_id"]].split()) for x in got if x["doc_id"] < 100)
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and {x["doc_id"] for x in left.collect()} == set(range(200, 240)) | {300, 301}
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), bench).count() == 0


def test_benchmark_items_of_one_or_two_words(spark):
    docs = [(1, "it says: Two words. here, two words"), (2, "two other words"), (3, "Word!"), (4, "two"), (5, "words two"), (6, None), (7, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two words"), (2, "word"), (3, "Two, words"), (4, "..."), (5, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.matches(df, bench).collect())
    assert got == [(1, 1, 1.0, 2, 4), (1, 3, 1.0, 2, 4), (3, 2, 1.0, 0, 1)]
    assert {r["doc_id"] for r in decontaminate.clean(df, bench).collect()} == {2, 4, 5, 6, 7}


def plain_score(a, b):
    h, best = [0] * (len(b) + 1), 0
    for x in a:
        left, old = 0, h
        h = [0]
        for j, y in enumerate(b):
            left = max(0, old[j] + (2 if x == y else -1), old[j + 1] - 1, left - 1)
            h.append(left)
        best = max(best, *h)
    return best


def test_alignment_equals_plain_one():
    r = random.Random(3)
    for _ in range(60):
        a, b = ([r.randint(1, 4) for _ in range(r.randint(1, 9))] for _ in range(2))
        top, end = decontaminate.align([np.array(a, np.uint64)], [np.array(b, np.uint64)])
        assert top[0] == plain_score(a, b)
        if top[0]:
            assert plain_score(a, b[: end[0]]) == top[0]


@pytest.mark.parametrize("cells, block", [(1 << 18, 8 << 20), (200, 1500)])
def test_every_alignment_is_found(spark, monkeypatch, cells, block):
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(11)
    voc = [f"w{k}" for k in range(60)]
    tests = [[r.choice(voc) for _ in range(r.randint(3, 24))] for _ in range(25)]
    edits = {
        "third": lambda w: [x if k % 3 < 2 else "edit" for k, x in enumerate(w)],
        "apart": lambda w: [x for y in w for x in (y, "between")],
        "less": lambda w: [x for k, x in enumerate(w) if k % 4],
        "mixed": lambda w: [x for y in w for x in ([y] if r.random() < 0.7 else r.choice([[], ["new"], [y, "more"]]))],
    }
    docs = [[r.choice(voc) for _ in range(r.randint(0, 30))] + f(t) + [r.choice(voc) for _ in range(r.randint(0, 30))] for t in tests for f in edits.values()]
    docs += [[r.choice(voc[:5]) for _ in range(300)], tests[0] * 40]
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(tests)], "item_id long, text string")
    want = {(k, i): s / 2 / len(t) for k, d in enumerate(docs) for i, t in enumerate(tests) if (s := plain_score(t, d)) >= len(t)}
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.matches(df, bench).collect()}
    assert got == want and len(want) > 100
    assert {x["doc_id"] for x in decontaminate.clean(df, bench).collect()} == set(range(len(docs))) - {k for k, _ in want}


def test_benchmark_against_a_long_text():
    text = pa.array(["a b c d e f g h " * 40_000, "x " * 10], pa.large_string())
    known = decontaminate.Items([1, 2], ["a b c d e f g h i j k l", "h a b c"])
    found = decontaminate.find(text, known)
    assert found["item"].tolist() == [0, 1] and found["score"].tolist() == [8 / 12, 1.0]


def test_benchmark_passages_in_tables(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    held = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if b["text"] in d["text"]}
    assert held <= {(r["doc_id"], r["item_id"]) for r in queries.op6_decontaminate(spark, sf).collect()}


def test_licenses(spark):
    r, voc, _ = items()
    noise = lambda n: " ".join(r.choice(voc) for _ in range(n))
    docs, want = [], set()
    for k, (name, texts) in enumerate(licenses.TEMPLATES.items()):
        for j, t in enumerate(texts):
            for pad in (0, 1, 7, 50):
                docs.append((len(docs), f"{noise(pad)} {t} {noise(pad)}"))
                want.add((len(docs) - 1, name, j))
    docs += [(5000, None), (5001, ""), (5002, noise(3000)), (5003, "the terms of the license")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("license", F.lit(0))
    got = licenses.scan(df).collect()
    assert want <= {(x["doc_id"], x["license"], x["template"]) for x in got}
    assert all(x["doc_id"] < 5000 for x in got) and licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, names",
    [
        ("Licensed under the Apache License, Version 1.1.", {"Apache-1.1"}),
        ("Licensed under the Apache License, Version 9.9.", set()),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
        ("This work is licensed under the GNU Affero General Public License, version 3.", {"AGPL-3.0"}),
        ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0"}),
        ("Licensed under the MIT License.", {"MIT"}),
    ],
)
def test_name_and_version_decide_on_a_license(text, names):
    known = licenses.Templates()
    assert {known.names[f[1]] for f in licenses.find(pa.array([f"some words {text} and more"]), known)} == names


@pytest.mark.parametrize("name", ["BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "GFDL-1.2", "GFDL-1.3", "MPL-2.0", "Apache-2.0"])
def test_whole_texts_of_licenses(name):
    known = licenses.Templates()
    found = [known.names[f[1]] for f in licenses.find(pa.array([licenses.TEMPLATES[name][-1]]), known) if known.sizes[f[1]] > 80]
    assert name in found and set(found) <= {name} | ({"MIT"} if name == "MIT" else set())


def test_license_bands_miss_nothing(sf, spark):
    r, voc, _ = items()
    known = licenses.Templates()
    assert known.bands < 64
    docs = [x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for texts in licenses.TEMPLATES.values():
        for t in texts:
            w = t.split()
            for share in (0.0, 0.03, 0.06):
                docs.append(" ".join([r.choice(voc) for _ in range(r.randint(0, 40))] + [r.choice(voc) if r.random() < share else x for x in w[:400]] + [r.choice(voc) for _ in range(9)]))
    texts = pa.array(docs, pa.large_string())
    every = licenses.find(texts, known, bands=False)
    assert licenses.find(texts, known) == every and len({f[1] for f in every}) > 60


def test_every_occurrence_of_a_license_counts(spark):
    t = "Licensed under the Apache License, Version 2.0."
    df = spark.createDataFrame([(1, f"one {t} two {t} {'word ' * 30} {t}"), (1, t), (1, t)], "doc_id long, text string")
    got = sorted((x["first_word"], x["n_words"]) for x in licenses.scan(df).collect() if (x["license"], x["template"]) == ("Apache-2.0", 0))
    assert got == [(0, 7), (0, 7), (1, 7), (9, 7), (46, 7)]


def test_url_rules_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = sorted(map(repr, map(tuple, queries.op7_url_filter(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect())))
    assert got == sorted(map(repr, con.execute(queries.OP7_SQL).fetchall()))


def fits(host, path, rules):
    found = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[2:] if found else (None, "allow")


@pytest.mark.parametrize("place, most, words", [(4, 100_000, 1 << 16), (2, 100_000, 1 << 16), (4, 0, 1 << 16), (4, 0, 1)])
def test_url_rules_of_every_kind(spark, monkeypatch, place, most, words):
    for name, value in (("IN_PLACE", place), ("MOST_BROADCAST", most), ("MOST_WORDS", words)):
        monkeypatch.setattr(url_filter, name, value)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "", "block"), ("a.b", "/x", "block"), *((f"h{k}.org", "/p", "block") for k in range(300))]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "https://example.com/en", "https://EXAMPLE.com/en/#x", "x://net", "x://sub.net?q", "x://com", "x://com/", "x://notcom/", "http://a.b/xyz", "http://z.a.b/x", "http://a.b:80/x", "x://h7.org/pq", "x://www.h299.org/p", "x://h7.org/q", "http://É.com/", "x://com/", "x://" + "a." * 600 + "com/" + "p" * 50_000]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(3, urls[3]), (None, None)], "page_id long, url string").withColumn("host", F.lit(1))
    got = url_filter.judge(pages, spark.createDataFrame(rules, url_filter.SCHEMA)).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert (r["rule"], r["verdict"]) == fits(r["host"], r["path"], rules), r
    assert {r["page_id"]: (r["host"], r["path"]) for r in got}[4] == ("www.example.com", "/en/a")
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(rules, url_filter.SCHEMA)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, spark.createDataFrame([], url_filter.SCHEMA)).collect()} == {"allow"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, many of them</div>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="layout"><div class="post"><h1>A &amp; B</h1><p>First   paragraph,<br>with <b>bold</b> text and a <a href="x">link</a>.<p>Second one &lt;here&gt;.</p>
<form><input>Mail</form><ul><li>point</ul></div><div class="comments"><p>Nice post by all of you, thank you very much!</p></div></div><aside>Side</aside><!-- <p>no</p> --><footer>&copy; foot</footer>"""


def test_main_text():
    want = "A & B\nFirst paragraph, with bold text and a link.\nSecond one <here>.\npoint"
    assert main_text.main_text(PAGE) == want
    assert main_text.main_text(PAGE.replace('<div class="post">', "<article>").replace('</div><div class="comments">', '</article><div class="comments">')) == want
    assert [main_text.main_text(x) for x in (None, "", "<", "mere text", "<p></p>", "<script>x")] == ["", "", "<", "mere text", "", ""]
    assert main_text.main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


def test_main_text_beside_the_densest_node():
    line = "A sentence of the text, long enough to be one of many that a reader meets on a page like this."
    many = [f"{line} Number {k}." for k in range(10)]
    tags = lambda lines: "".join(f"<p>{x}</p>" for x in lines)
    page = "<html><body><nav><a href=x>Home</a></nav><div class=post>{}</div><div><a href=y>One</a> <a href=z>Two</a></div></body></html>"
    # paragraphs of their own beside the densest node, short ones too
    assert main_text.main_text(page.format(f"<p>{line}</p><p>Short.</p><div>{tags(many)}</div><p>End.</p>")) == "\n".join([line, "Short.", *many, "End."])
    # a short section beside a long one, and one whose lines lie deeper
    assert main_text.main_text(page.format(f"<section>{tags(many)}</section><section><h2>Last</h2>{tags(many[:2])}</section>")) == "\n".join([*many, "Last", *many[:2]])
    assert main_text.main_text(page.format(f"<div>{tags(many)}</div><div><div>{tags(many[:3])}</div></div>")) == "\n".join([*many, *many[:3]])
    # a bare row of links is no text
    assert main_text.main_text(f"<body><a href=x>Home</a> | <a href=y>About us</a><div><div>{tags(many)}</div><p>{line}</p></div></body>") == "\n".join([*many, line])
    # sections without a node around them
    assert main_text.main_text(f"<body><h1>Top</h1><p>{line}</p><div>{tags(many)}</div></body>") == "\n".join(["Top", line, *many])


@pytest.mark.parametrize("tag", ["article", "main"])
def test_links_of_an_article_are_text(tag):
    links = [f"<a href=/{k}>A long title of work number {k}</a>" for k in range(3)]
    inside = f"<p>Text of some length, with no link at all.</p><p>{links[0]} and {links[1]}</p><ul>{''.join(f'<li>{x}</li>' for x in links)}</ul><table><tr><td>{links[0]}<td>{links[1]}</table>"
    lines = [f"A long title of work number {k}" for k in range(3)]
    page = f"<body><ul><li><a href=a>Home</a><li><a href=b>About</a></ul><{tag}>{inside}<nav>{links[2]}</nav></{tag}></body>"
    assert main_text.main_text(page) == "\n".join(["Text of some length, with no link at all.", f"{lines[0]} and {lines[1]}", *lines, *lines[:2]])


def random_page(r, depth=0):
    """A random tree of elements, names and texts."""
    words = lambda n: " ".join(r.choices(["one", "two", "three&amp;", "und", "weiter", "a"], k=n))
    out = []
    for _ in range(r.randint(1, 4 if depth < 3 else 2)):
        kind = r.random()
        if depth > 4 or kind < 0.25:
            out.append(words(r.choice([0, 1, 6, 40])))
        elif kind < 0.35:
            out.append(f"<a href=x>{words(r.randint(1, 8))}</a>")
        elif kind < 0.6:
            out.append(f"<p>{words(r.choice([2, 20, 45]))}</p>")
        else:
            tag = r.choice(["div", "div", "div", "section", "article", "main", "ul", "li", "table", "nav", "footer", "aside", "form", "span", "h1", "h2", "blockquote", "header", "b"])
            name = r.choice(["", "", "", "", " class=ad", " class='content comments'", " class=modal", " class='side x'", " role=banner", " class=banner"])
            out.append(f"<{tag}{name}>{random_page(r, depth + 1)}</{tag}>")
    return "".join(out)


def test_main_text_is_the_plain_one():
    r = random.Random(12)
    found = 0
    for k in range(1500):
        page = f"<html><body>{random_page(r)}</body></html>"
        plain = brute.Plain(main_text.parse(page)).text()
        assert main_text.main_text(page) == plain, page
        found += bool(plain)
    assert found > 1000


LINE = "A sentence of the text, long enough to be one of many that a reader meets on a page like this one here."
PARAGRAPHS = "".join(f"<p>{LINE} Number {k}.</p>" for k in range(6))
MANY = "\n".join(f"{LINE} Number {k}." for k in range(6))
MENU = "<nav><a href=a>Home</a><a href=b>About</a></nav>"


@pytest.mark.parametrize("name", ["banner", "modal", "popup overlay", "cookie"])
def test_a_name_has_no_say_over_the_article(name):
    assert main_text.main_text(f"<body>{MENU}<div class='{name}'>{PARAGRAPHS}</div><footer>x</footer></body>") == MANY
    inner = f"<article><h1>Top</h1>{PARAGRAPHS}<div class=ad>Buy this.</div></article>"
    assert main_text.main_text(f"<body>{MENU}<div class='{name}'>{inner}</div><p>outside</p></body>") == f"Top\n{MANY}"
    # beside an article it is what it says, and comments always are
    assert main_text.main_text(f"<body><div class='{name}'>{PARAGRAPHS}</div><article><p>{LINE}</p><p>{LINE}</p></article></body>") == f"{LINE}\n{LINE}"
    assert main_text.main_text(f"<body><article><p>{LINE}</p></article><div class=comments>{PARAGRAPHS}</div></body>") == LINE
    assert main_text.main_text(f"<body>{MENU}<div class=comments>{PARAGRAPHS}</div></body>") == ""


@pytest.mark.parametrize("advert", ["<p>Buy our wonderful cheese now, it is very good.</p>", "<ul><li>Buy our cheese now</li><li>and our wine</li></ul>", "<table><tr><td>Buy our wonderful cheese</td></tr></table>", "<div>Buy our wonderful cheese now, it is very good.</div>", "Buy cheese"])
def test_what_is_outside_of_main_is_no_text(advert):
    for tag in ("main", "article"):
        for inner, want in ((PARAGRAPHS, MANY), (f"<p>{LINE}</p>", LINE), (f"<div><div>{PARAGRAPHS}</div><p>End.</p></div>", f"{MANY}\nEnd.")):
            for page in (f"{advert}<{tag}>{inner}</{tag}>", f"<{tag}>{inner}</{tag}>{advert}", f"<div><{tag}>{inner}</{tag}></div>{advert}"):
                assert main_text.main_text(f"<body>{MENU}{page}</body>") == want
                assert main_text.main_text(f"<body><div><h1>Top</h1></div>{page}</body>") == f"Top\n{want}"


def test_main_text_of_tables(spark, sf):
    import html
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").join(queries.op3_main_text(spark, sf).drop("url"), "page_id").collect():
        inner = r["html"].partition("<article>")[2].partition("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_field_marginals():
    r = random.Random(1)
    for _ in range(25):
        n, bias, pair = r.randint(1, 8), r.uniform(-3, 1), tuple(r.uniform(-2, 2) for _ in range(3))
        emit = {k: r.uniform(-2, 4) for k in range(n) if r.random() < 0.5}
        table, z, m = [[0, pair[0]], [pair[1], pair[2]]], 0.0, [0.0] * n
        for y in itertools.product((0, 1), repeat=n):
            e = math.exp(sum(table[a][b] for a, b in zip((0, *y), y)) + sum(emit.get(k, bias) for k in range(n) if y[k]))
            z += e
            m = [x + e * b for x, b in zip(m, y)]
        at = sorted(emit)
        p, log_z = toxicity.marginals(np.array([emit[k] for k in at], float), np.array(at, np.int64), np.array([0, len(at)]), np.array([n]), bias, pair)
        assert log_z[0] == pytest.approx(math.log(z)) and p.tolist() == pytest.approx([m[k] / z for k in at])


def test_spans_of_characters():
    assert toxicity._characters("é  bad\tworse\u3000x ok bad", [1, 2, 4]) == [{"begin": 3, "end": 14}, {"begin": 18, "end": 21}]


def test_toxicity_on_tables(spark, sf):
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)


def test_toxicity(spark):
    r, voc, _ = items()
    docs = []
    for k in range(300):
        w = [r.choice(voc) for _ in range(40)]
        bad = k % 3 == 0
        if bad:
            for j in (5, 20):
                w[j] = r.choice(["vile", "rotten", "foulgrin", "foulsnap"]) + r.choice(["", ".", "!"])
        docs.append((k, " ".join(w), int(bad)))
    df = spark.createDataFrame(docs + [(900, None, 0), (901, "", 0)], "doc_id long, text string, y int")
    labels = df.select("doc_id", F.col("y").alias("toxic"), F.lit(1).alias("quality"))
    got = toxicity.score(df, toxicity.learn(df, labels)).join(df.select("doc_id", "y"), "doc_id").collect()
    held = [x for x in got if x["held_out"]]
    assert 30 < len(held) < 100 and all(x["predicted"] == x["y"] for x in held)
    assert all(0 <= x["score"] <= 1 for x in got) and [x["toxic_words"] for x in got if x["doc_id"] == 3] == [[5, 20]]
    assert len({x["score"] for x in got if x["doc_id"] >= 900}) == 1
    text = dict((d[0], d[1]) for d in docs)
    for x in got:
        if x["doc_id"] < 900:
            w = text[x["doc_id"]].split()
            assert [text[x["doc_id"]][a["begin"] : a["end"]].split() for a in x["toxic_spans"]] == [[w[k]] for k in x["toxic_words"]]
    strangers = labels.withColumn("doc_id", F.col("doc_id") + 10_000)
    share = {x["score"] for x in toxicity.score(df.limit(5), toxicity.learn(df, strangers)).collect()}
    assert len(share) == 1 and 0.25 < share.pop() < 0.4
    none = toxicity.learn(df, labels.limit(0))
    assert {x["score"] for x in toxicity.score(df, none).collect()} == {0.5} and toxicity.score(df.limit(0), none).count() == 0
