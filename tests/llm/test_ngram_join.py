import re
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

import numpy as np
from scriptloom.llm import ngram_join
from scriptloom.llm.components import connected_components
from scriptloom.llm.ngram_join import deduplicated, jaccard_components, overlaps

WORDS = re.compile("[^\x20\x09-\x0d]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text, k):
    w = WORDS.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    """doc position -> (set size, least id of its component)."""
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def got(df, k, num, den):
    return sorted((tuple(r) for r in jaccard_components(df, k=k, num=num, den=den).collect()), key=repr)


def test_messy_rows_as_brute_force(messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert got(messy, 3, 9, 10) == brute(rows, 3, 9, 10)
    assert got(messy, 5, 8, 10) == brute(rows, 5, 8, 10)


def test_large_groups_of_near_copies_as_brute_force(spark, invented, monkeypatch):
    """Groups of several blocks, chains, and a passage that many texts share."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    r = invented.random
    passage, rows = invented(60), []
    for size in (90, 40, 7, 2):
        words = invented(100).split()
        for _ in range(size):
            own = list(words)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = "changed" + str(r.random())
            rows.append(" ".join(own))
    chain = invented(80).split()
    for i in range(30):
        chain[(i * 7) % 80] = f"link{i}"
        rows.append(" ".join(chain))
    rows += [invented(r.randint(20, 60)) + " " + passage for _ in range(80)] + [invented(50) for _ in range(100)]
    rows += [passage + f" {i} {i + 1}" for i in range(40)]
    r.shuffle(rows)
    data = list(enumerate(rows))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert got(df, 3, 9, 10) == brute(data, 3, 9, 10)
    assert got(df, 5, 8, 10) == brute(data, 5, 8, 10)


def test_frequent_in_batch_ngrams_lose_no_link(spark, invented, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_IN_BATCH", 3)
    words = invented(60).split()
    data = [(i, " ".join([*words[:50], f"w{i}", *words[50:]])) for i in range(30)] + [(100 + i, invented(40)) for i in range(30)]
    assert got(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 3, 9, 10) == brute(data, 3, 9, 10)


def test_empty_table(empty):
    assert got(empty, 3, 9, 10) == []


def test_deduplicated_keeps_one_of_each_group(spark, messy):
    kept = deduplicated(messy, k=3, num=9, den=10)
    assert kept.columns == messy.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids.count(1) == 2 and 10 not in ids and 9 in ids and 6 not in ids and {2, 3, 4} <= set(ids)


@given(st.lists(st.sets(st.integers(0, 30)), max_size=8))
def test_overlaps_sums_fragments(sets):
    found = overlaps([np.array(sorted(s), np.int64) for s in sets])
    assert found.shape == (len(sets), len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert found[i, j] == len(a & b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}
