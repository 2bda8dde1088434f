import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptloom.llm.source_mixing import Target, exponent, mixed


def brute(docs, target, order):
    """Walk each source's passes; ``order`` gives the hashes that Spark uses."""
    tokens = defaultdict(int)
    for _, s, n in docs:
        tokens[s] += n
    total = sum(tokens.values())
    measure = lambda a: [(t / total) ** a for t in tokens.values()]

    def measures(a):
        p = measure(a)
        w = [x / sum(p) for x in p]
        return sum(p), -sum(x * math.log(x) for x in w), max(x * target.budget * total / t for x, t in zip(w, tokens.values(), strict=True))

    a = exponent(measures, len(tokens), target)
    taken = Counter()
    for s, t in tokens.items():
        quota = math.floor((t / total) ** a / measures(a)[0] * target.budget * total)
        nb = math.ceil(t / target.block_tokens)
        blocks = defaultdict(list)
        for d, source, n in docs:
            if source == s:
                blocks[order["salt"](d, n) % nb].append((d, n))
        start, epoch = 0, 0
        while start < quota:
            for b in sorted(blocks, key=lambda b: (order["block"](epoch, s, b), b)):
                if start >= quota:
                    break
                size, used = sum(n for _, n in blocks[b]), start
                for d, n in sorted(blocks[b], key=lambda x: (order["inside"](order["salt"](*x), epoch), x)):
                    used += n
                    if used <= quota:
                        taken[d, s, epoch, b] += 1
                start += size
            epoch += 1
    return a, taken


@pytest.mark.parametrize("target", [Target(0.99, 4.0, 1.0, 50), Target(1.0, 2.0, 1.5, 30), Target(0.5, 4.0, 0.3, 1000), Target(0.97, 1.0, 2.5, 64)])
def test_as_walked_by_hand(spark, target):
    docs = [(i, f"s{min(i % 13, 4)}" if i % 7 else None, 1 + i * i % 23) for i in range(200)]
    df = spark.createDataFrame([(d, s, "w " * n) for d, s, n in docs], "doc_id long, source string, text string")
    keys = [f"s{k}" for k in range(5)] + [None]
    salt = {(r.doc_id, r.n): r.h for r in spark.createDataFrame([(d, n) for d, _, n in docs], "doc_id long, n long").withColumn("h", F.xxhash64(F.lit(target.seed), "doc_id", "n")).collect()}
    block = {(r.e, r.s, r.b): r.h for r in spark.createDataFrame([(e, s, b) for e in range(8) for s in keys for b in range(80)], "e int, s string, b long").withColumn("h", F.xxhash64(F.lit(target.seed), "e", "s", "b")).collect()}
    inside = {(r.salt, r.e): r.h for r in spark.createDataFrame([(h, e) for h in salt.values() for e in range(8)], "salt long, e int").withColumn("h", F.xxhash64("salt", "e")).collect()}
    a, expected = brute(docs, target, {"salt": lambda d, n: salt[d, n], "block": lambda e, s, b: block[e, s, b], "inside": lambda h, e: inside[h, e]})
    rows = mixed(df, target).collect()
    assert Counter((r.doc_id, r.source, r.epoch, r.block) for r in rows) == expected
    used = defaultdict(int)
    for r in rows:
        used[r.source] += r.n_tokens
    assert sum(used.values()) <= target.budget * sum(n for _, _, n in docs) and all(0 <= r.at < 1 for r in rows)


def test_exponent_meets_targets():
    shares = [0.7, 0.2, 0.06, 0.04]

    def measures(a):
        p = [s**a for s in shares]
        w = [x / sum(p) for x in p]
        return sum(p), -sum(x * math.log(x) for x in w), max(x / s for x, s in zip(w, shares, strict=True))

    a = exponent(measures, 4, Target(entropy=0.9, repeats=10))
    assert measures(a)[1] == pytest.approx(0.9 * math.log(4), abs=1e-6)
    b = exponent(measures, 4, Target(entropy=1.0, repeats=2))
    assert measures(b)[2] == pytest.approx(2, abs=1e-6) and exponent(measures, 4, Target(entropy=0.1)) == 1.0


def test_messy_and_empty(messy, empty):
    rows = mixed(messy, Target(budget=2.0)).collect()
    assert rows and all(r.n_tokens > 0 for r in rows) and mixed(empty).collect() == []


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decisions on a small corpus with a copy, a leak, a secret and junk."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where(F.length("text") > 150).first().text
    base = docs.where("length(text) between 1500 and 4000 and lang = 'en'").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").first().text
    own = [(900001, base + " extra"), (900002, base + " extra"), (900003, "The thing. " + item + " and that."), (900004, base[: len(base) // 3] + ' token = "0123456789abcdef0123456789abcdef" ')]
    more = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in own], docs.schema)
    at = docs.union(more)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, at, sf).write.parquet(path)
        at = spark.read.parquet(path)
        seen.append({r.doc_id for r in at.select("doc_id").collect()})
        if name != "source_mixing":
            assert at.columns == docs.columns
    quality, copies, leaks, secrets, mixture = seen
    assert len({900001, 900002} & copies) <= 1 and 900003 not in leaks and secrets == leaks and mixture <= secrets
    masked = spark.read.parquet(str(tmp_path / "secret_scan")).where("text like '%0123456789abcdef0123456789abcdef%'")
    assert masked.count() == 0 and len(mixture) > 0.9 * len(secrets)
