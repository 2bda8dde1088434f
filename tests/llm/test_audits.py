"""Filter audit and conversation repair, against plain versions; toxicity, by its held-out fold."""

import hashlib
import os
import random
import zlib
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from scriptloom.llm import conversation_repair, filter_audit, queries, toxicity

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_filter_audit"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(found.fetchall())


# ------------------------------------------------------------------ filter audit


def split_words(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_audit(rows, labels):
    """Every order walked for every document."""
    least, docs = {}, []
    for i, text, part in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, part in rows:
        text = text or ""
        words = split_words(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > least[text]}
        docs.append((part or "", {f for f in fails if fails[f]}, *labels.get(i, (0, 0))))
    out = defaultdict(lambda: [0] * 6)
    for order in map("".join, permutations("ABCDE")):
        for part, fails, good, toxic in docs:
            gone = False
            for step, f in enumerate(order, 1):
                n = out[part, order, step]
                here = not gone and f in fails
                n[2] += gone and f in fails
                gone |= here
                n[0], n[1], n[3], n[4], n[5] = n[0] + (not gone), n[1] + here, n[3] + (fails == {f}), n[4] + (here and good), n[5] + (here and toxic)
    shapley = defaultdict(int)
    for (part, order, step), n in out.items():
        shapley[part, order[step - 1]] += n[1]
    return sorted((part, order, step, *n, shapley[part, order[step - 1]]) for (part, order, step), n in out.items())


def test_audit_of_messy_rows(spark, messy, empty):
    docs = messy.withColumn("lang", messy["source"]).withColumn("mask", messy["n"])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 1, None), (6, None, 1), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels)
    assert sorted(map(tuple, got.collect())) == plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], {1: (1, 1), 5: (1, 0), 6: (0, 1), 9: (0, 0)})
    assert filter_audit.audit(empty.withColumn("lang", empty["source"]), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_lattice_has_80_edges_and_600_steps(spark):
    assert len(set(filter_audit.lattice_edges())) == 80
    assert filter_audit.steps(spark).count() == 600


# ------------------------------------------------------------------ conversation repair


def plain_repair(rows):
    """(faults, cost, audit, hash) of ordered (turn, role, text), by a search over every edit."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {("", 0): (0, "", ())}
    for i, (_, role, text) in enumerate(rows):
        new = {}
        layer = dict(best)
        for _ in range(3):  # insertions before the row
            for (state, n), (cost, audit, out) in list(layer.items()):
                for x in follows[state]:
                    if x != "s":
                        key, value = (x, n + 1), (cost + 2, audit + "I", (*out, ("user:" if x == "u" else "assistant:")))
                        if n < 3:
                            layer[key] = min(layer.get(key, value), value)
        for (state, _), (cost, audit, out) in layer.items():
            options = [(state, cost + 3, audit + "D", out)]
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                options += [(x, cost + cut, audit + "K", (*out, f"{role}:{text}")) for x in follows[state] if role[:1] == x]
                options += [(x, cost + 2 + cut, audit + "R", (*out, f"{'user' if x == 'u' else 'assistant'}:{text}")) for x in follows[state] if x != "s"]
            for x, *value in options:
                new[x, 0] = min(new.get((x, 0), tuple(value)), tuple(value))
        best = new
    ends = []
    for (state, _), (cost, audit, out) in best.items():
        more = {"": 0, "s": 2, "u": 1, "a": 0}[state]
        ends.append((cost + 2 * more, audit + "I" * more, (*out, *(("user:", "assistant:")[2 - more :]))))
    cost, audit, out = min(ends)
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), pairs, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture(scope="module")
def talks(spark):
    """Conversations of all shapes: turns missing, null or repeated once, odd roles, blank and repeated texts, one long one."""
    r = random.Random(8)
    rows = []
    for conv in [*range(60), None]:
        n = 60 if conv == 7 else r.randint(1, 9)
        turns = r.sample(range(n * 2), n)
        if conv == 9:
            turns[0] = None
        for t in turns:
            rows.append((conv, t, r.choice(["user", "assistant", "system", "tool", "", None, "unknown"]), r.choice(["Yes.", "No!", "cut off", " \n", "", None, f"Text {t}?", "é…", "a\nb."])))
    r.shuffle(rows)
    return spark.createDataFrame([(*x, "own", 1) for x in rows], "conv_id long, turn long, role string, text string, copies string, seg int")


def plain_damage(conv, turn, role, text):
    fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = (" " if role is None else role), (" " if text is None else text)
    row = (turn, "user" if fault == 4 else role, "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text)
    return [] if fault == 0 else [row, row] if fault == 3 else [row]


def expected(talks):
    by = defaultdict(list)
    for r in talks.collect():
        by[r.conv_id].extend(plain_damage(r.conv_id, r.turn, r.role, r.text))
    out = {}
    for conv, rows in by.items():
        rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
        out[conv] = plain_repair(rows) if rows else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    return out


@pytest.mark.parametrize("long, turns", [(512, 256), (3, 2), (5, 7)])
def test_repair_equals_search(talks, monkeypatch, long, turns):
    """Whole, and cut into blocks: the same results."""
    monkeypatch.setattr(conversation_repair, "LONG", long)
    monkeypatch.setattr(conversation_repair, "BLOCK_TURNS", turns)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repaired(conversation_repair.damaged(talks)).collect()}
    assert got == expected(talks)


def test_many_rows_of_one_turn_are_cut_by_hash(spark, monkeypatch):
    rows = spark.createDataFrame([(1, None if k % 2 else 4, "user" if k % 3 else "assistant", f"Text {k % 40}."[: 8 if k % 5 else 6]) for k in range(90)], "conv_id long, turn long, role string, text string")
    got = conversation_repair.repaired(conversation_repair.damaged(rows)).collect()
    monkeypatch.setattr(conversation_repair, "LONG", 6)
    assert conversation_repair.repaired(conversation_repair.damaged(rows)).collect() == got


def test_no_conversations(spark, talks):
    assert conversation_repair.repaired(conversation_repair.damaged(talks.limit(0))).count() == 0


# ------------------------------------------------------------------ toxicity


@pytest.fixture(scope="module")
def spoken(spark, invented):
    """Documents of which a tenth hold some of 12 words of one stem; half of them are labelled."""
    r = random.Random(2)
    bad = [f"vronk{x}" for x in "a e i o u al er ix um os ay an".split()]
    docs, labels = [], []
    for i in range(3000):
        words = invented(r.randint(5, 60)).split(" ")
        toxic = i % 10 == 0
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad))
        docs.append((i, " ".join(words)))
        if i % 20 < 10:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_words_are_learned(spark, spoken, messy, empty):
    docs, labels = spoken
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert [r.held_out for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows]
    assert np.mean([r.predicted for r in held if r.doc_id % 10 == 0]) > 0.95
    assert np.mean([r.predicted for r in held if r.doc_id % 10]) < 0.02
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    odd = toxicity.scored(messy, model).collect()
    assert len(odd) == messy.count() and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.scored(empty, model).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark, spoken):
    docs, labels = spoken
    from pyspark.sql import functions as F

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert a.prior == b.prior and np.array_equal(a.weights, b.weights)


def test_nothing_to_learn_from(spark, spoken, empty):
    docs, labels = spoken
    rows = toxicity.scored(docs, toxicity.train(docs, labels.where("toxic = 0"))).collect()
    assert {r.predicted for r in rows} == {0}
    assert toxicity.scored(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_memorising_unlabelled_texts_does_not_pay():
    """Without any word that tells the classes apart, scores stay near the prior."""
    r = np.random.default_rng(1)
    sizes = np.full(600, 20)
    model = toxicity.fit(r.integers(0, 50_000, 600 * 20).astype(np.int32), sizes, np.arange(600) < 100, 0.1)
    assert not model.weights.any() or abs(model.weights).max() < 1
    assert np.allclose(1 / (1 + np.exp(-model.base)), 0.1, atol=0.05)
