import re

from pyspark.sql import functions as F

from scriptloom import script_queries
from scriptloom.operators import chart, romanize, spans, stats
from scriptloom.plans import char_classes
from scriptloom.sql import register

#: Text, language, and its edges (start, end, reading, type).
PLAIN, VOWEL = "standard-unicode-based-romanization", "standard-unicode-based-romanization-plus-abudiga-default-vowel"
CHARTS = [
    ("क्षमा", None, [(0, 2, "k", "virama"), (2, 3, "ssa", VOWEL), (3, 4, "m", PLAIN), (4, 5, "aa", PLAIN)]),
    ("ज़मीन", None, [(0, 2, "za", "multi-char-mapping"), (2, 3, "m", PLAIN), (3, 4, "ii", PLAIN), (4, 5, "n", "schwa-deletion")]),
    ("पढ़ा", None, [(0, 1, "pa", VOWEL), (1, 3, "ddh", "multi-char-mapping"), (3, 4, "aa", PLAIN)]),
    ("ग‍घ", "san", [(0, 2, "ga", "zero-width-char"), (2, 3, "gha", VOWEL)]),
    ("व़व", "san", [(0, 2, "va", "nukta"), (2, 3, "va", VOWEL)]),
    ("せっけん", None, [(0, 1, "se", PLAIN), (1, 2, "k", "japanese-consonant-doubling"), (2, 3, "ke", PLAIN), (3, 4, "n", "multi-char-mapping")]),
    ("カード", None, [(0, 2, "kaa", "japanese-vowel-lengthening"), (2, 3, "do", PLAIN)]),
    ("เกม", None, [(0, 2, "ke", "thai-vowel-consonant-swap"), (2, 3, "m", PLAIN)]),
    ("กอน", None, [(0, 1, "k", PLAIN), (1, 2, "o", "thai-middle-o-ang"), (2, 3, "n", PLAIN)]),
    ("อก กอ", None, [(0, 1, "", "thai-initial-o-ang-drop"), (1, 2, "k", PLAIN), (2, 3, " ", "ASCII"), (3, 4, "k", PLAIN), (4, 5, "", "thai-final-o-ang-drop")]),
    ("5μm με", None, [(0, 1, "5", "ASCII"), (1, 2, "µ", "greek-mu-to-micro-sign"), (2, 3, "m", "ASCII"), (3, 4, " ", "ASCII"), (4, 5, "m", PLAIN), (5, 6, "e", PLAIN)]),
    ("한☃", None, [(0, 1, "han", "Hangul"), (1, 2, "☃", "pictograph")]),
    ("ਪੱਕਾ", None, [(0, 1, "pa", VOWEL), (1, 2, "k", "gurmukhi-consonant-doubling"), (2, 3, "k", PLAIN), (3, 4, "aa", PLAIN)]),
    ("ប៉", None, [(0, 2, "ba", "diacritic")]),
    ("ငြိ", None, [(0, 2, "ngr", "subjoined-character"), (2, 3, "i", PLAIN)]),
    ("कं", None, [(0, 1, "ka", VOWEL), (1, 2, "m", "syllable-end-consonant")]),
    ("् ़", None, [(0, 1, "", "unexpected-virama"), (1, 2, " ", "ASCII"), (2, 3, "", "unexpected-nukta")]),
    ("μπαμ", None, [(0, 2, "b", "multi-char-mapping"), (2, 3, "a", PLAIN), (3, 4, "m", PLAIN)]),
    ("ие", "rus", [(0, 2, "iye", "multi-char-mapping")]),
    ("", None, []),
    (None, None, []),
]


def test_charts(spark):
    rows = spark.createDataFrame([(i, t, lc, "x") for i, (t, lc, _) in enumerate(CHARTS)] * 2, "key int, text string, lcode string, start string").dropDuplicates()
    found = {}
    for e in chart.chart_edges(rows, "key", "text", "lcode").collect():
        found.setdefault(e.key, []).append((e.start, e.end, e.txt, e.type))
    assert {i: sorted(found.get(i, [])) for i in range(len(CHARTS))} == {i: edges for i, (_, _, edges) in enumerate(CHARTS)}


def test_all_edges_of_a_chart_and_long_words(spark):
    rows = spark.createDataFrame([(1, "μπ"), (2, "क्" * 3000)], "key int, text string")
    every = chart.chart_edges(rows, "key", "text", every=True).where("key = 1").collect()
    # the place behind a match is read only if a shorter match ends there
    assert sorted((e.start, e.end, e.txt) for e in every) == [(0, 2, "b")]
    long = chart.chart_edges(rows, "key", "text").where("key = 2").collect()
    assert len(long) == 3000 and {(e.end - e.start, e.txt, e.type) for e in long} == {(2, "k", "virama")}


def test_classes_are_disjoint_and_cover_what_they_name():
    spans = char_classes.ranges()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    of = lambda c: next((label for first, last, label in spans if first <= ord(c) <= last), char_classes.OTHER)
    expected = {"A": "ASCII Latin letter", "$": "ASCII currency", "É": "non-ASCII Latin letter", "×": "non-ASCII punctuation", "½": "fraction", "ֱ": "Hebrew point", "ـ": "Arabic tatweel", "؋": "Arabic currency", "฿": "Thai currency",
                "৴": "Bengali currency", "൰": "Malayalam digit", "𓁨": "Egyptian hieroglyph number", "౸": "Telegu fraction", "୲": "Oriya fraction", "​": "zero-width space", "ﷺ": "Arabic presentation letter", "😀": "pictograph", "𠀀": "CJK character", "\U000e0101": "variation selector", "ࡰ": "other character"}
    assert {c: of(c) for c in expected} == expected


def test_class_profile_of_odd_texts(spark):
    rows = spark.createDataFrame([("x", "aא☃"), ("x", None), ("x", ""), (None, "가가"), ("y", "\U0010fffd")], "lang string, text string")
    got = {(r.lang, r.char_class, r.is_letter, r.n) for r in stats.class_profile(rows, "text", "lang").collect()}
    assert got == {("x", "ASCII Latin letter", True, 1), ("x", "Hebrew letter", True, 1), ("x", "pictograph", False, 1), (None, "Korean Hangul syllable", True, 2), ("y", "private use character", False, 1)}
    assert stats.class_profile(rows.limit(0), "text", "lang").count() == 0


def test_lattice_in_sql(spark):
    register(spark)
    edges = lambda text, lcode: {tuple(r) for r in spark.sql(f"select * from lattice_edges({text}, {lcode})").collect()}
    assert edges("'μπ'", "null") == {(0, 1, "m", "rom"), (1, 2, "p", "rom"), (0, 2, "b", "rom")}
    assert (0, 2, "iye", "rom") in edges("'ие'", "'rus'") and (0, 2, "iye", "rom") not in edges("'ие'", "'ukr'")
    assert edges("null", "null") == edges("''", "null") == set()
    assert edges("'x'", "null") == {(0, 1, "x", "orig")}


def test_lattice_lists(spark):
    """The lattice of a text is one row, with the edges that SQL gives, each once, and no text is shuffled for them."""
    register(spark)
    rows = spark.createDataFrame([(0, "μπ ντα", None), (1, "ие", "rus"), (2, "ие", "ukr"), (3, None, None), (4, "", "rus"), (5, "x\U00020000é\u0301", None), (6, "νντ", ""), (6, "μπμπ", None)], "key int, text string, lcode string")
    lists = spans.lattice_lists(rows, "key", "text", "lcode")
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    rows.createOrReplaceTempView("lattice_texts")
    wanted = spark.sql("select key, e.* from lattice_texts, lateral lattice_edges(text, lcode) e").collect()
    got = lists.collect()
    assert len(got) == 8 and sorted((r.key, *e) for r in got for e in r.edges) == sorted(tuple(r) for r in wanted)
    assert [tuple(e) for e in got[1].edges] == [(0, 1, "i", "rom"), (0, 2, "iye", "rom"), (1, 2, "e", "rom")] and got[3].edges == got[4].edges == []


def test_lattice_in_sql_makes_no_row_for_each_edge(spark, tmp_path):
    spark.createDataFrame([(1, "nt ant"), (2, ""), (3, None), (4, "n t"), (5, "Ntntx")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counted = script_queries.lattice_in_sql(spark, str(tmp_path))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "UDTF" not in plan and "Exchange" not in plan
    assert {tuple(r) for r in counted.collect()} == {(1, 9, 2, 1), (4, 3, 0, 0), (5, 6, 1, 0)}


def test_quick_takes_the_longest_match_from_the_left(spark):
    rows = spark.createDataFrame([("しゃ きょку",), ("μουντ",), ("เกาะ",), ("щи ие",), ("abc",), ("",), (None,)], "t string")
    got = [(r.q, r.rus) for r in rows.select(romanize.quick(F.col("t")).alias("q"), romanize.quick(F.col("t"), "rus").alias("rus")).collect()]
    assert [q for q, _ in got] == ["sha kyoku", "mound", "ko", "shchi ie", "abc", "", None]
    assert got[3][1] == "shchi iye" and got[0][0] == got[0][1]


def test_quick_is_one_pass(spark):
    """No step for each letter that has a long reading; spans that overlap go from the left, and end where the text ends."""
    rows = spark.createDataFrame([("しゃしゃ",), ("ουου ß",), ("γγκ",), ("γκγκ",), ("γ",), ("κγκ",), (None,), ("a\U00020000щ",)], "t string").coalesce(1)
    read = rows.select(romanize.quick(F.col("t")).alias("q"))
    assert "replace(" not in read._jdf.queryExecution().executedPlan().toString()
    assert [r.q for r in read.collect()] == ["shasha", "ouou ß", "ngk", "ngng", "g", "kng", None, "a\U00020000shch"]


def test_chart_lists(spark):
    """The edges of a text are one row, in order, and no text is shuffled for them."""
    rows = spark.createDataFrame([(i, t, lc) for i, (t, lc, _) in enumerate(CHARTS)], "key int, text string, lcode string")
    lists = chart.chart_lists(rows, "key", "text", "lcode")
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    assert {r.key: [tuple(e) for e in r.edges] for r in lists.collect()} == {i: edges for i, (t, _, edges) in enumerate(CHARTS) if t}


def test_chart_sums(spark, monkeypatch):
    """What is counted of edges is summed from the pieces: no array of edges of a text goes to the JVM; by joins it is the same."""
    types = "virama", "diacritic", "ASCII"
    rows = spark.createDataFrame([(i, t, lc) for i, (t, lc, _) in enumerate(CHARTS)] * 2 + [(50, "क्षमा ប៉ x" * 300, None)], "key int, text string, lcode string")
    sums = chart.chart_sums(rows, "key", "text", types, "lcode")
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not re.search(r"\bedges#", plan)
    of = lambda edges: (len(edges), [sum(e[3] == t for e in edges) for t in types], sum(e[1] - e[0] for e in edges), "".join(e[2] for e in edges))
    got = sorted(tuple(r) for r in sums.collect())
    assert [x for x in got if x[0] < 50] == sorted((i, *of(edges)) for i, (t, _, edges) in enumerate(CHARTS) if t for _ in range(2))
    assert got[-1][1:4] == (2400, [300, 300, 900], 3000) and got[-1][4] == "kssamaa ba x" * 300
    monkeypatch.setattr(chart.r.in_place, "MOST", -1)
    assert sorted(tuple(r) for r in chart.chart_sums(rows, "key", "text", types, "lcode").collect()) == got


def test_queries_count_edges_from_pieces(spark, tmp_path):
    spark.createDataFrame([(1, "kes ha"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("chart_edges_documents", "romanize_edges_documents"):
        found = getattr(script_queries, name)(spark, str(tmp_path))
        assert not re.search(r"\bedges#", found._jdf.queryExecution().executedPlan().toString())
        assert [r.doc_id for r in found.collect()] == [1]
