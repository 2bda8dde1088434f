"""Toxicity: classifiers learned from confirmed toxic texts and unlabelled ones.

A text is the set of its words and of the beginnings of its words, hashed to
buckets.  Linear logistic classifiers are trained in numpy by non-negative
positive-unlabelled learning: no text counts as clean, but the risk of calling
clean texts toxic is what unlabelled texts show, less the share of it that the
toxic ones among them (by the class prior) explain.  Where that difference falls
below zero, the step goes the other way, so that the classifier can't gain by
remembering single unlabelled texts.  The score is the mean of the classifiers'
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import FOLDED, U64, hashes, text_slices, words
from .quality_model import fold
from .scratch import table

#: Confirmed toxic and unlabelled documents that training takes, about: those of the least hashes.
TOXIC_DOCUMENTS, UNLABELLED_DOCUMENTS = 8_000, 16_000
#: Buckets of words and beginnings; lengths of beginnings in bytes.
BUCKETS, BEGINNINGS = 1 << 18, (4, 5, 6, 7)
#: Standard errors by which a bucket's shares of toxic and of unlabelled documents must differ for it to have a weight.
LEAST_DIFFERENCE = 5.0
CLASSIFIERS, ROUNDS, BATCHES, RATE, DECAY = 3, 40, 8, 0.02, 0.01
#: Classes that have no toxic text in sight still have this prior.
LEAST_PRIOR = 1e-3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of each row, and their rows, in the order of rows."""
    starts, ends, row = words(data, offsets, _LETTER)
    _, first = np.unique(hashes(data, starts, ends, FOLDED) ^ (row.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    starts, ends, row = starts[first], ends[first], row[first]
    found = [row * BUCKETS + (hashes(data, starts, ends, FOLDED) % U64(BUCKETS)).astype(np.int64)]
    for n in BEGINNINGS:
        long = ends - starts > n
        found.append(row[long] * BUCKETS + (hashes(data, starts[long], starts[long] + n, FOLDED) * U64(2 * n + 1) % U64(BUCKETS)).astype(np.int64))
    keys = np.unique(np.concatenate(found))
    return keys % BUCKETS, keys // BUCKETS


@dataclass
class Classifiers:
    """A weight for each bucket and a base, one column for each classifier; without weights, the prior."""

    weights: np.ndarray
    base: np.ndarray
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        out = np.zeros(len(texts))
        for first, data, offsets in text_slices(texts, 1 << 20):
            rows = len(offsets) - 1
            bucket, row = buckets(data, offsets)
            z = np.stack([np.bincount(row, w[bucket], rows) for w in self.weights.T], 1) + self.base
            out[first : first + rows] = (1 / (1 + np.exp(-np.clip(z, -50, 50)))).mean(1)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _slice(bucket: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of some documents, and the place of each one's document among them."""
    starts = np.concatenate(([0], ends))[docs]
    size = ends[docs] - starts
    at = np.repeat(np.arange(len(docs)), size)
    return bucket[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)], at


def fit(bucket: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, prior: float, seed: int = 5) -> Classifiers:
    """Train on documents given by their buckets, one after the other, and how many each has."""
    prior = min(0.9, max(LEAST_PRIOR, prior))
    known, open_ = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    if len(known) < 10 or len(open_) < 10:
        return Classifiers(np.zeros((0, CLASSIFIERS), np.float32), np.zeros(CLASSIFIERS), prior)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    p, u = (np.bincount(bucket[mark[doc]], minlength=BUCKETS) / mark.sum() for mark in (toxic, ~toxic))
    both = (np.bincount(bucket, minlength=BUCKETS) + 1) / (len(sizes) + 2)
    kept = np.abs(p - u) > LEAST_DIFFERENCE * np.sqrt(both * (1 - both) * (1 / len(known) + 1 / len(open_)))
    doc = doc[kept[bucket]]
    number = np.cumsum(kept) - 1
    bucket, ends = number[bucket[kept[bucket]]], np.cumsum(np.bincount(doc, minlength=len(sizes)))
    weights, base = np.zeros((BUCKETS, CLASSIFIERS), np.float32), np.zeros(CLASSIFIERS)
    for c in range(CLASSIFIERS):
        random = np.random.default_rng(seed + c)
        w, b = np.zeros(int(kept.sum())), np.log(prior / (1 - prior))
        mean, square, mean_b, square_b, step = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
        for _ in range(ROUNDS):
            for p_docs, u_docs in zip(np.array_split(random.permutation(known), BATCHES), np.array_split(random.permutation(open_), BATCHES), strict=True):
                if not len(p_docs) or not len(u_docs):
                    continue
                p_bucket, p_at = _slice(bucket, ends, p_docs)
                u_bucket, u_at = _slice(bucket, ends, u_docs)
                zp = np.bincount(p_at, w[p_bucket], len(p_docs)) + b
                zu = np.bincount(u_at, w[u_bucket], len(u_docs)) + b
                clean_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                # slopes of the two parts: of calling toxic texts clean, and of calling clean texts toxic
                up = -prior * _sigmoid(-zp) / len(zp)
                down_u, down_p = _sigmoid(zu) / len(zu), -prior * _sigmoid(zp) / len(zp)
                gp, gu = (up + down_p, down_u) if clean_risk >= 0 else (-down_p, -down_u)
                g = np.bincount(p_bucket, gp[p_at], len(w)) + np.bincount(u_bucket, gu[u_at], len(w))
                gb = gp.sum() + gu.sum()
                step += 1
                mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
                mean_b, square_b = 0.9 * mean_b + 0.1 * gb, 0.999 * square_b + 0.001 * gb * gb
                fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
                w -= RATE * ((mean / fix) / (np.sqrt(square / fix2) + 1e-6) + DECAY * w)
                b -= RATE * (mean_b / fix) / (np.sqrt(square_b / fix2) + 1e-6)
        weights[kept, c], base[c] = w, b
    return Classifiers(weights, base, prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, buckets): the buckets of each text as packed 32-bit numbers."""
    for batch in batches:
        packed = []
        for _, data, offsets in text_slices(batch.column(1), 1 << 20):
            bucket, row = buckets(data, offsets)
            ends = np.searchsorted(row, np.arange(len(offsets)))
            packed += [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["toxic", "buckets"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2, prior: float | None = None) -> Classifiers:
    """Learn from some TOXIC_DOCUMENTS confirmed and UNLABELLED_DOCUMENTS other documents of all folds but ``held``.

    Labels say which texts are toxic, and without a given ``prior`` what share of
    the labelled documents is; no text is taken as clean.  Equal rows count
    once, and of several texts of a confirmed id one is taken.  The sample is by hashes of id and text, its size doesn't grow with
    the tables; a label of 1 wins over others of its id.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = table(known.groupBy("id").agg(F.max("y").alias("y")).where(fold("id", folds) != held), "toxic-labels")
    n, n_toxic = known.agg(F.count("*"), F.count_if(F.col("y") == 1)).first()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(fold("id", folds) != held)
    drawn = lambda share, *of: F.pmod(F.xxhash64(F.lit(7), *of), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))
    confirmed = known.where("y = 1").where(drawn(TOXIC_DOCUMENTS / max(1, n_toxic), "id")).select("id")
    confirmed = rows.join(F.broadcast(confirmed), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(F.lit(True).alias("toxic"), "text")
    others = rows.where(drawn(UNLABELLED_DOCUMENTS / max(1, docs.count()), "id", "text")).dropDuplicates(["id", "text"]).select(F.lit(False).alias("toxic"), "text")
    got = confirmed.union(others).mapInArrow(_features, "toxic boolean, buckets binary").toArrow()
    packed = got.column("buckets").to_pylist()
    sizes = np.array([len(x) // 4 for x in packed], np.int64)
    # the order of rows depends on the cluster, and the order of training on theirs: sorted, it doesn't
    order = sorted(range(len(packed)), key=packed.__getitem__)
    joined = np.frombuffer(b"".join(packed[i] for i in order), np.int32)
    return fit(joined, sizes[order], got.column("toxic").to_numpy()[order], n_toxic / max(1, n) if prior is None else prior)


def score_column(spark: SparkSession, text: Column, model: Classifiers) -> Column:
    """The classifiers' mean probability that a text is toxic."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts), pa.float64())

    return score(text)


def scored(docs: DataFrame, model: Classifiers, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Only the text makes the score; null and empty texts get that of no words.
    Texts are read whole, in slices that never cut a text.  Each row is scored by
    itself: repeated rows repeat, a null doc_id is in the fold of empty text, an
    empty table gives no rows, other columns play no part.  A score equal to the
    threshold is predicted 1.  Without ten toxic and ten other documents to learn
    from, all scores are the prior.
    """
    score = score_column(docs.sparkSession, F.col("text"), model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", score.alias("score"))
    return rows.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
