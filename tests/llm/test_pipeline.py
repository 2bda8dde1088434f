import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptloom.llm import decontamination, ngram_join, page_text, page_tree, quality_model, scratch, source_mixing, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def folder(spark, path, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_on_nulls_repeats_and_clashes(spark, tmp_path, invented):
    """One row with a leak or a copy never takes along the clean rows of its id, or the others without an id."""
    item = invented(14)
    clean = [invented(60) for _ in range(12)]
    texts = [(1, clean[0]), (1, clean[1]), (None, clean[2]), (None, clean[3]), (2, clean[4]), (3, clean[4]), (3, clean[5]), (4, f"{invented(30)} {item} {invented(30)}"), (4, clean[6]), (None, item), (5, None), (6, ""), (7, clean[7]), (7, clean[7]), (8, clean[8] + " password = hunter2hunter")]
    rows = [(i, t, "en", None if k % 4 == 0 else "s", len(t or ""), "x") for k, (i, t) in enumerate(texts)]
    sf = folder(spark, tmp_path, rows, [(1, None, None), (None, 1, 0)], [(1, item), (None, item), (3, None), (4, "")])
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf), "test-stage")
        assert docs.columns == DOCS.replace(",", "").split()[::2]
        kept.append(Counter((r.doc_id, r.text) for r in docs.collect()))
    quality, copies, leaks, secrets = kept
    assert quality == Counter(texts)  # without usable labels every document has the base rate
    gone = Counter(texts) - copies
    assert gone == Counter([(3, clean[4]), (7, clean[7])])
    assert copies - leaks == Counter([t for t in texts if t[1] and item in t[1]])
    assert [t for _, t in secrets if t and "hunter2hunter" in t] == [] and sum(secrets.values()) == sum(leaks.values())
    taken = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert taken <= {i for i, t in secrets if t}


def test_run_on_empty_tables(spark, tmp_path):
    sf = folder(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_tables_of_a_stage_are_deleted_but_its_result(spark):
    with scratch.cleared(spark):
        first = scratch.table(spark.range(3).toDF("n"), "first")
        last = scratch.table(first.where("n > 0"), "last")
    assert last.count() == 2 and not os.path.exists(first.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    with pytest.raises(ValueError, match="stop"), scratch.cleared(spark):
        first = scratch.table(spark.range(3).toDF("n"), "first")
        raise ValueError("stop")
    assert first.count() == 3


def test_rows_not_ids_are_deduplicated(spark, invented):
    a, b, c = invented(40), invented(40), invented(40)
    rows = [(None, a), (1, a), (None, b), (2, c), (2, b + " more"), (9, c)]
    kept = ngram_join.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=8, den=10)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(1, a), (2, c), (2, b + " more")])


def test_leaking_texts_go_and_others_of_the_id_stay(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(None, f"x {item} y"), (None, "clean words"), (1, item), (1, "other"), (2, None)], "doc_id long, text string")
    kept = decontamination.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(repr, (tuple(r) for r in kept.collect()))) == sorted(map(repr, [(None, "clean words"), (1, "other"), (2, None)]))


def test_long_passes_are_ordered_in_ranges(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    target = source_mixing.Target(budget=1.4, block_tokens=20)
    whole = sorted(map(tuple, source_mixing.mixed(docs, target).collect()))
    monkeypatch.setattr(source_mixing, "BLOCKS_AT_ONCE", 7)
    assert sorted(map(tuple, source_mixing.mixed(docs, target).collect())) == whole


def test_fragments_and_tasks_of_any_number_find_the_same(spark, invented, monkeypatch):
    words = [invented(50).split() for _ in range(6)]
    data = [(i, " ".join([*words[i % 6][:40], f"w{i}", *words[i % 6][40:]])) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    find = lambda: sorted(map(tuple, ngram_join.jaccard_components(df, k=3, num=8, den=10).collect()))
    whole = find()
    for name, value in (("BLOCK", 8), ("TASK_MEMBERS", 16), ("TASK_GRAMS", 50), ("FRAGMENT_GRAMS", 200)):
        monkeypatch.setattr(ngram_join, name, value)
    assert find() == whole


def test_markov_models_as_brute_force():
    urls = ["http://a.b/x", "http://a.c/yy", "http://ab.com/", "x", ""]

    def steps(url):
        b = bytes([url_filter.EDGE]) + url.encode() + bytes([url_filter.EDGE])
        return [[(b[i - k : i], b[i]) for k in range(url_filter.ORDER + 1) if i >= k] for i in range(1, len(b))]

    def counted(texts):
        return Counter(pair for u in texts for step in steps(u) for pair in step)

    def log_p(counts, step):
        p = 1 / 256
        for context, byte in step:
            own = {b: n for (c, b), n in counts.items() if c == context}
            if own:
                p = (own.get(byte, 0) + len(own) * p) / (sum(own.values()) + len(own))
        return math.log(p)

    def model(texts):
        rows = Counter()
        for _, _, _, byte, contexts in url_filter._steps(pa.array(texts)):
            for context in contexts:
                rows.update((int(c), int(b)) for c, b in zip(context, byte, strict=True) if c)
        keys = list(rows)
        return url_filter.Markov(np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint8), np.array([rows[k] for k in keys], np.int64))

    good, bad = urls[:2], urls[2:4]
    got = url_filter.Ratio(model(good), model(bad)).differences(pa.array(urls))
    for u, d in zip(urls, got, strict=True):
        own = [log_p(counted(bad), s) - log_p(counted(good), s) for s in steps(u)]
        assert d == pytest.approx(sum(own) / len(own))


def test_pooled_vectors_and_network_as_brute_force(invented):
    texts = [invented(30), "A b, C!! 12", "", "same same same"]
    vectors = quality_model.word_vectors(np.random.default_rng(1).normal(size=(quality_model.BUCKETS, quality_model.LENGTH)).astype(np.float32))
    marks = quality_model.random_vectors(quality_model.MARKS, quality_model.LENGTH, 2)
    got = quality_model.pooled(pa.array(texts), vectors)
    for t, x in zip(texts, got, strict=True):
        data = np.frombuffer(t.encode(), np.uint8)
        word, _, mark, _ = quality_model._units(data, np.array([0, len(data)]))
        mean = lambda codes, of: sum((of[c].astype(float) for c in codes), np.zeros(of.shape[1])) / max(1, len(codes))
        assert np.allclose(x, [*mean(word, vectors), *mean(mark, marks), math.log1p(len(word)) / 8], atol=1e-4)
    network = quality_model.Network(vectors, [np.full((got.shape[1], 2), 0.1), np.array([0.1, -0.2]), np.array([1.0, -1.5]), np.array(0.3)], got.mean(0), got.std(0) + 0.1, 2.0)
    for x, s in zip(got, network.scores(pa.array(texts)), strict=True):
        z = sum(w * max(0.0, sum(0.1 * (v - m) / d for v, m, d in zip(x, network.mean, network.spread, strict=True)) + b) for w, b in ((1.0, 0.1), (-1.5, -0.2))) + 0.3
        assert s == pytest.approx(1 / (1 + math.exp(-z / 2.0)), abs=1e-4)


def test_deep_pages_take_linear_time_and_keep_their_text():
    model = page_text.train(page_text.labelled_pages(60), rounds=20)
    n = 20_000
    for page in ("<div>" * n + "x" + "</section>" * n, "<ul>" + "<div>" * n + "<td>a" * 100, "<i>" * n + "<b>" * n + "t" + "</i>" * n):
        tree = page_tree.parse(page)
        assert "".join(x for x in tree.text if x) in ("x", "a" * 100, "t") and len(model.texts([page])) == 1
    assert model.texts(["Just plain &amp; simple text."]) == ["Just plain & simple text."]
