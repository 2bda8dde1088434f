import hashlib
import re

from pyspark.sql import functions as F

from scriptloom.llm import scratch
from scriptloom.llm.decontamination import _rows_of_100_bytes, build_index, contamination, decontaminated, find, read_test_set

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORDS.findall((t or "").translate(UPPER))


def brute(docs, items, size):
    windows = [(str(i), tuple(w[s : s + min(size, len(w))])) for i, t in items if (w := words(t)) for s in range(len(w) - min(size, len(w)) + 1)]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def test_as_brute_force(spark, invented):
    r = invented.random
    items = [(i, invented(r.randint(1, 30))) for i in range(12)] + [(50, "the The THE the"), (51, None), (52, ""), (53, "the the the the"), (54, "Éa Éa")]
    docs = []
    for i in range(60):
        parts = [invented(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 1))
            parts += [" ".join(w[a : a + r.randint(1, 20)]), invented(r.randint(0, 5)), r.choice(["the the the the the", "THE-the_the the", "éa éa"])]
        docs.append((i, " ".join(parts)))
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window=10)
    assert got(found) == brute(docs, items, 10)
    assert all(r.n_near >= 0 for r in found.collect())


def test_messy_rows(spark, messy):
    items = [(1, "plain text with"), (2, "x"), (None, "a b"), (3, " ".join(["word"] * 12))]
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    expected = brute(docs, [x for x in items if x[0]], 10)
    found = got(contamination(messy, spark.createDataFrame(items, "item_id long, text string")))
    assert [x[:2] + x[3:5] for x in found] == [x[:2] + x[3:5] for x in expected]
    kept = decontaminated(messy, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == messy.columns and 11 not in [r.doc_id for r in kept.collect()]


def test_empty_tables(spark, messy, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated for r in contamination(messy, none).collect())
    assert contamination(empty, none).collect() == []


def test_proximity_finds_reordered_passages(spark):
    item = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    docs = [(1, "x " * 30 + "beta alpha gamma delta zeta epsilon eta theta kappa iota"), (2, "alpha " + "y " * 200 + "kappa " + "z " * 200 + "gamma")]
    test = read_test_set(spark.createDataFrame(item, "item_id long, text string"))
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"), test)
    near = find(index, test, window=10, slop=5).near.join(index.documents, "uid")
    assert [r.doc_id for r in near.collect()] == [1]


def test_long_items_are_weighed_by_bytes_and_joined_by_shuffles(spark, invented, monkeypatch):
    weight = lambda texts: _rows_of_100_bytes(spark.createDataFrame([(t,) for t in texts], "t string"), F.octet_length("t"))
    assert (weight(["a", "b"]), weight(["a" * 1000, "é" * 50]), weight([])) == (2, 13, 0)
    items = [(1, invented(400)), (2, invented(12)), (3, invented(3))]
    docs = [(i, f"{invented(5)} {items[i % 3][1]} {invented(7)}") for i in range(6)]
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    assert got(contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items, 10)


def test_native_plan(spark, messy):
    plan = contamination(messy, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
