"""URL filter, page text, quality model, language model: held-out accuracy and brute force."""

import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scriptloom.llm import language_model, page_text, quality_model, queries, url_filter
from scriptloom.llm.page_tree import parse

RULES = queries.URL_RULES


# ------------------------------------------------------------------ URLs


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


@pytest.fixture(scope="module")
def urls(spark):
    rows = [(i, f"http://{('www.', 'm.', '')[i % 3]}site{i % 17}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'fr', 'es')[i % 4]}/{i}") for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "no scheme"), (1003, "HTTP://WWW.Example.COM"), (1004, "http://a.NET/es/ü?x://b#c"), (1005, "x://example.com/en/"), (1005, "x://example.com/en/"), (None, "http://a.com/" + "y" * 50_000), (1006, "http://notcom/"), (1007, "http://com/\nz")]
    return spark.createDataFrame(rows, "page_id long, url string")


def test_rules_and_verdicts(urls):
    rows, given = url_filter.judged(urls, RULES).collect(), urls.collect()
    assert len(rows) == len(given)
    for r, g in zip(sorted(rows, key=lambda r: (r.page_id or 0, r.host)), sorted(given, key=lambda r: (r.page_id or 0, split_url(r.url)[0])), strict=True):
        assert (r.host, r.path) == split_url(g.url)
        rule = rule_of(r.host, r.path)
        assert r.rule == (rule.name if rule else None) and r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == rule.verdict
    assert {r.verdict for r in rows if r.page_id in (1000, 1001)} == {"allow"}


def test_models_tell_kinds_apart(spark):
    """Held-out URLs of the kinds that rules block or allow."""
    kinds = [(f"http://news{i % 9}.site.org/story/{i}", False) for i in range(400)] + [(f"http://win{i % 9}.cheap-pills.biz/buy?id={i}", True) for i in range(400)]
    ratio = url_filter.train(spark.createDataFrame(kinds, "url string, blocked boolean"))
    own = ratio.differences(pa.array(["http://news77.site.org/story/9999", "http://win55.cheap-pills.biz/buy?id=777"]))
    assert own[0] <= ratio.threshold < own[1]


def test_probabilities_of_next_bytes_sum_to_one(spark):
    ratio = url_filter.train(spark.createDataFrame([(f"http://a{i}.b/{i}", i % 2 == 0) for i in range(50)], "url string, blocked boolean"))
    for _, _, _, byte, contexts in url_filter._steps(pa.array(["http://a1.b/"])):
        every = np.arange(256, dtype=np.uint8)
        for i in range(0, len(byte), 5):
            p = np.exp(ratio.accepted.log_probability(every, [np.repeat(c[i], 256) for c in contexts]))
            assert abs(p.sum() - 1) < 1e-9


def test_more_counts_than_an_executor_holds_change_nothing(urls, monkeypatch):
    by_id = lambda r: (r.page_id or 0, r.host, r.path)
    whole = sorted(url_filter.judged(urls, RULES).collect(), key=by_id)
    monkeypatch.setattr(url_filter, "MODEL_ROWS", 50)
    for a, b in zip(whole, sorted(url_filter.judged(urls, RULES).collect(), key=by_id), strict=True):
        assert a[:5] == b[:5] and b.difference == pytest.approx(a.difference, abs=1e-9)


def test_joined_counts_make_no_row_for_each_step(urls, monkeypatch):
    """A slice of URLs has a row for each of its grams, and these hold all contexts of a step."""
    monkeypatch.setattr(url_filter, "MODEL_ROWS", 50)
    assert "Generate" not in url_filter.judged(urls, RULES)._jdf.queryExecution().executedPlan().toString()
    for _, _, _, around, back in url_filter._places(pa.array(["http://a1.b/é", None, "x"])):
        gram = url_filter._grams(around, back)
        for k, context in enumerate(url_filter._contexts(around, back)):
            cut = url_filter._cut(gram[gram >> 48 >= k], k)
            again = url_filter._contexts([(cut >> (8 * i)) & 255 for i in range(url_filter.ORDER + 1)], np.full(len(cut), k))[k]
            assert (again == context[context != 0]).all() and (cut & 255 == around[0][gram >> 48 >= k]).all()


def test_no_examples_allow_all(spark, empty):
    rows = url_filter.judged(spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string"), RULES).collect()
    assert [(r.rule, r.verdict) for r in rows] == [(None, "allow")]
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


# ------------------------------------------------------------------ pages


@pytest.fixture(scope="module")
def pages_model():
    return page_text.train(page_text.labelled_pages())


def test_main_text_of_held_out_layouts(pages_model):
    pages, right, total = page_text.labelled_pages(150, seed=31), 0, 0
    for page, got in zip(pages, pages_model.texts(pages), strict=True):
        tree = parse(page)
        wanted = Counter(x for x, y in zip(tree.text, tree.label, strict=True) if x is not None and y)
        found = Counter(got.split("\n\n")) if got else Counter()
        right += sum((wanted & found).values())
        total += max(sum(wanted.values()), sum(found.values()))
    assert right / total > 0.97


def test_messages_are_exact_marginals():
    """Against all labellings of a small tree."""
    tree = parse("<body><nav><p>menu here</p></nav><article><p>One sentence.</p></article></body>")
    names = {f: i for i, f in enumerate(sorted({f for fs in tree.features for f in fs}))}
    random = np.random.default_rng(1)
    weights, pair = random.normal(size=len(names)), random.normal(size=(2, 2, 2))
    got, joint = page_text.Forest([tree], names).marginals(weights, pair)
    n, total, mass = len(tree.parent), 0.0, np.zeros(len(tree.parent))
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        score = sum(weights[names[f]] for i in range(n) if y[i] for f in tree.features[i])
        score += sum(pair[int(tree.text[i] is not None), y[tree.parent[i]], y[i]] for i in range(1, n))
        total += math.exp(score)
        mass += math.exp(score) * np.array(y)
    assert np.allclose(got, mass / total) and np.allclose(joint[1:].sum((1, 2)), 1)


def test_markup_of_pages(spark, pages_model, empty):
    body = "<article><h1>The  title</h1><p>One &amp; two.<br>three</p><p><b>Open bold text here.<br><p>Next &#233; para.</p><p>  </p><script>no('<p>')</script></article>"
    page = f"<html><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav>{body}<footer>&copy; someone</footer>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "u", ""), (3, "u", page[: page.index("Next") + 7]), (4, "u", "<<<>>> &am <p"), (5, "u", "<div>" * 3000 + "deep")]
    got = page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), pages_model).collect()
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == "The title\n\nOne & two. three\n\nOpen bold text here.\n\nNext é para." and len(got) == len(rows)
    assert texts[3].endswith("Next &#") and texts[2] == texts[None] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_text.main_text(none, pages_model).count() == 0


def test_page_queries_match_article_markup(spark, pages_model):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for page, got in ((r.html, r.text) for r in rows.join(page_text.main_text(rows, pages_model).select("page_id", "text"), "page_id").collect()):
        article = page.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", article))
        assert got == "\n\n".join(b for b in blocks if b)


# ------------------------------------------------------------------ quality


@pytest.fixture(scope="module")
def labelled(spark, invented):
    rows = []
    for i in range(400):
        text = invented(60).capitalize()
        rows.append((i, text.replace(" ", "*** ") if i % 4 == 0 else text.upper() if i % 4 == 1 else text, int(i % 4 > 1)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_of_held_out_documents(labelled):
    network = quality_model.train(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality"))
    rows = quality_model.scored(labelled, network).join(labelled.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95 and all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_of_messy_rows(spark, messy, empty, labelled):
    network = quality_model.train(labelled, labelled)
    rows = quality_model.scored(messy, network).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows) and quality_model.scored(empty, network).count() == 0
    none = quality_model.train(messy, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert {r.score for r in quality_model.scored(messy, none).collect()} == {0.5}


@pytest.mark.parametrize("page, texts", [
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>5</mn></math> hold.</p><p>Next</p>", ["Let x=5 hold.", "Next"]),
    ("<p>One</p><object data=x><p>Two</p></object><p>Three</p>", ["One", "Two", "Three"]),
    ("<p>One</p><svg><path d='M0'/><p>Two</p><p>Three</p>", ["One", "Two", "Three"]),
    ("<p>One</p><video src=x><p>Two</p>", ["One", "Two"]),
    ("<p title=Bob's>One</p><p>It's two</p>", ["One", "It's two"]),
    ("<p alt=\"5\" disc\">One</p><p>Two</p>", ["One", "Two"]),
    ("<p>a<script src=https://x/y/>var q=1;</script>b</p><p>c</p>", ["ab", "c"]),
    ("<p>a<script src='x' />var q=1;</script>b</p><style type=x/>p {}</style><title/>t</title><p>c</p>", ["ab", "c"]),
    ("<p>a</p><svg><title/><style/></svg><p>b</p><textarea rows=2/>own</textarea><iframe src=y/ />z</iframe><p>c</p>", ["a", "b", "c"]),
    ("<p alt=\"a > b\" id = 'c > d'>One</p><script>if (a > b) {}</script>", ["One"]),
])
def test_no_text_of_a_page_vanishes(page, texts):
    assert [t for t in parse(page).text if t] == texts


# ------------------------------------------------------------------ language model

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_scores(rows):
    texts = [(d, [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UPPER)), None]) for d, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    c = Counter(w for (_, ws), h in zip(texts, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (d, ws), h in zip(texts, held, strict=True)]


@pytest.mark.parametrize("head", [200_000, 20])
def test_base_scores(spark, messy, invented, head, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD_WORDS", head)
    df = messy.select("doc_id", "text").union(spark.createDataFrame([(100 + i, invented(50)) for i in range(60)], "doc_id long, text string"))
    rows = df.collect()
    got = sorted((tuple(r)[:6] for r in language_model.scored(df).collect()), key=lambda r: (r[0] or -1, r[2], r[5]))
    for a, b in zip(got, sorted(base_scores([(r.doc_id, r.text) for r in rows]), key=lambda r: (r[0] or -1, r[2], r[5])), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])


def test_model_is_normalised_and_beats_the_base(spark, invented):
    r = invented.random
    words = [[f"{c}{i}" for i in range(40)] for c in "xyz"]
    docs = [(i, " ".join(r.choice(words[i % 3]) for _ in range(120))) for i in range(300)]
    rows = [x for x in language_model.scored(spark.createDataFrame(docs, "doc_id long, text string"), passes=8).collect() if x.held_out]
    assert sum(x.score for x in rows) > 0.9 * sum(x.base_score for x in rows)
    model = language_model.LogBilinear(np.full(language_model.UNITS, 1 / language_model.UNITS))
    logs = model.log10_normalised(np.arange(5), np.arange(5))
    assert np.allclose((10.0**logs).sum(1), 1, atol=1e-4)


def test_words_beyond_the_frequent_ones_have_contexts(spark, invented):
    """Pairs of 400 words: the second of a pair is certain after the first, whatever their counts; all units sum to one."""
    r = invented.random
    pairs = [(f"first{i} ", f"then{i * 7919 % 100003} ") for i in range(200)]
    docs = [(i, "".join("".join(r.choice(pairs)) for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = [x for x in language_model.scored(df, passes=8).collect() if x.held_out]
    # a unigram has 2.6 a word; half of them are certain
    assert sum(x.score for x in held) > 0.6 * sum(x.base_score for x in held)
    counted = language_model.word_counts(df.select("text"))
    counts = language_model.gather_counts(counted, len(docs))
    assert len(counts.frequent) + len(counts.vocabulary) == 400
    model = language_model.LogBilinear(np.full(language_model.UNITS, 1e-3), counts.leaf_count / counts.n)
    every = np.arange(language_model.UNITS + len(counts.vocabulary))
    logs = model.log10_probability(every, np.full(len(every), 300), np.full(len(every), 3))
    assert abs((10.0**logs).sum() - 1) < 1e-4


def test_scores_do_not_depend_on_partitions(spark, invented, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 1500)
    docs = spark.createDataFrame([(i, invented(40)) for i in range(200)], "doc_id long, text string")
    one = {r.doc_id: round(r.score, 4) for r in language_model.scored(docs.coalesce(1)).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert {r.doc_id: round(r.score, 4) for r in language_model.scored(docs.repartition(5)).collect()} == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_language_model_without_training_rows(spark, empty):
    assert language_model.scored(empty).count() == 0
    rows = language_model.scored(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert (rows[0].n_known, rows[0].train_tokens, rows[0].n_tokens) == (0, 0, 3)
