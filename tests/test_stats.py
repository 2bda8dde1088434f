"""Statistics against brute force."""

import math
from collections import Counter

import pytest

from scriptloom.operators import stats


def test_mutual_information_without_one_task_for_all_pairs(spark):
    rows = [(f"w{i * i % 37}", i % 5) for i in range(500)] + [(None, 1), ("w1", None), (None, None)]
    got = stats.mutual_information(spark.createDataFrame(rows, "word string, label int"), "word", "label")
    kept = [r for r in rows if None not in r]
    joint, words, labels = Counter(kept), Counter(w for w, _ in kept), Counter(x for _, x in kept)
    found = {(r.word, r.label): (r.n, r.pmi) for r in got.collect()}
    assert found.keys() == joint.keys() and got.columns == ["word", "label", "n", "pmi"]
    for (w, x), n in joint.items():
        assert found[w, x] == (n, pytest.approx(math.log2(n * len(kept) / (words[w] * labels[x]))))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert stats.mutual_information(spark.createDataFrame([], "word string, label int"), "word", "label").count() == 0
