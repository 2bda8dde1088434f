"""Quality classifier: random-indexing vectors pooled for each document, and a two-layer network on them.

A text is a sequence of units: words, runs of one symbol, and marks of how a
word is written.  Each unit has a sparse random vector, and a context vector:
the sum of its neighbours' random vectors in the training texts.  A document is
the mean of its units' vectors; a network of two layers gives its probability,
calibrated by a temperature on labelled documents kept out of the training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import FOLDED, U64, hashes, mix, text_slices, words
from .scratch import table

#: Labelled documents at most that train the model: those of the least hashes of their ids.
TRAINING_DOCUMENTS = 20_000
#: Word vectors (words share them by hash), their length, and non-zero entries of a random vector.
BUCKETS, LENGTH, ENTRIES = 1 << 14, 48, 6
MARKS = 512
HIDDEN, ROUNDS, RATE = 32, 40, 0.003
WINDOW = 2

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = ~_LETTER
_SYMBOL[[32, 9, 11, 12, 13]] = False
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word and the row it is in; the same of each mark: written form, repetition, symbol runs, lengths."""
    starts, ends, row = words(data, offsets, _LETTER)
    code = hashes(data, starts, ends, FOLDED)
    capitals = np.concatenate(([0], np.cumsum(_CAPITAL[data])))
    caps, size = capitals[ends] - capitals[starts], ends - starts
    form = np.where(caps == 0, 0, np.where((caps == size) & (size > 1), 2, 1))
    again = np.zeros(len(code), np.int64)
    again[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    s_starts, s_ends, s_row = words(data, offsets, _SYMBOL)
    symbol = 64 + (hashes(data, s_starts, s_ends) % U64(MARKS - 64)).astype(np.int64)
    marks = [form * 2 + again, 8 + np.minimum(size, 15), symbol]
    return (code % U64(BUCKETS)).astype(np.int64), row, np.concatenate(marks), np.concatenate([row, row, s_row])


def random_vectors(count: int, length: int, seed: int) -> np.ndarray:
    """Sparse vectors of +1 and -1, the same in every process."""
    out = np.zeros((count, length), np.float32)
    for j in range(ENTRIES):
        bits = mix(np.arange(count, dtype=U64) * U64(64) + U64(seed * 1000 + j))
        out[np.arange(count), (bits % U64(length)).astype(np.int64)] += np.where(bits >> U64(63), 1, -1)
    return out / np.sqrt(ENTRIES).astype(np.float32)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sums of the neighbours' random vectors of every bucket."""
    index = random_vectors(BUCKETS, LENGTH, 1)
    pairs = np.zeros((BUCKETS, LENGTH), np.float32)
    for batch in batches:
        for _, data, offsets in text_slices(batch.column(0), 1 << 20):
            word, row, _, _ = _units(data, offsets)
            for gap in range(1, WINDOW + 1):
                same = row[gap:] == row[:-gap]
                left, right = word[:-gap][same], word[gap:][same]
                for a, b in ((left, right), (right, left)):
                    order = np.argsort(a.astype(np.uint16), kind="stable")
                    edge = np.flatnonzero(np.concatenate(([True], a[order][1:] != a[order][:-1]))) if len(order) else order
                    if len(order):
                        pairs[a[order][edge]] += np.add.reduceat(index[b[order]], edge, axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary())], names=["sums"])


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Random vector and direction of the context vector of each bucket, side by side."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.concatenate([random_vectors(BUCKETS, LENGTH, 1), sums / np.maximum(norm, 1e-6)], 1).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean mark vector and logarithm of length of each text."""
    marks = random_vectors(MARKS, LENGTH, 2)
    out = np.zeros((len(texts), vectors.shape[1] + LENGTH + 1), np.float32)

    def means(code: np.ndarray, row: np.ndarray, rows: int, of: np.ndarray) -> np.ndarray:
        pair, count = np.unique(row * len(of) + code, return_counts=True)
        total = np.zeros((rows, of.shape[1]), np.float32)
        if len(pair):
            at = pair // len(of)
            edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            total[at[edge]] = np.add.reduceat(of[pair % len(of)] * count[:, None].astype(np.float32), edge, axis=0)
        return total / np.maximum(1, np.bincount(row, minlength=rows))[:, None]

    for first, data, offsets in text_slices(texts, 1 << 20):
        rows = len(offsets) - 1
        word, row, mark, mark_row = _units(data, offsets)
        part = out[first : first + rows]
        part[:, : vectors.shape[1]] = means(word, row, rows, vectors)
        part[:, vectors.shape[1] : -1] = means(mark, mark_row, rows, marks)
        part[:, -1] = np.log1p(np.bincount(row, minlength=rows)) / 8
    return out


@dataclass
class Network:
    """Two layers and a temperature; without layers, the base rate of the training labels."""

    vectors: np.ndarray
    layers: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    temperature: float = 1.0
    base_rate: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum(((x - self.mean) / self.spread) @ a + b, 0) @ c + d

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.base_rate)
        z = self.logits(pooled(texts, self.vectors)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Train on four fifths of the rows, set the temperature on the rest."""
    rate = (y.sum() + 1) / (len(y) + 2)
    network = Network(vectors, [], np.zeros(x.shape[1]), np.ones(x.shape[1]), base_rate=float(rate))
    if len(y) < 20 or y.min() == y.max():
        return network
    random = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 0
    tx, ty = x[~held], y[~held]
    network.mean, network.spread = tx.mean(0), tx.std(0) + 1e-2
    tx = (tx - network.mean) / network.spread
    shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ()]
    layers = network.layers = [(random.normal(size=s) * (0.5 / np.sqrt(max(1, s[0] if s else 1)))).astype(np.float32) if i in (0, 2) else np.zeros(s, np.float32) for i, s in enumerate(shapes)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(ROUNDS):
        order = random.permutation(len(ty))
        for i in range(0, len(order), 128):
            bx, by = tx[order[i : i + 128]], ty[order[i : i + 128]]
            h = bx @ layers[0] + layers[1]
            active = np.maximum(h, 0)
            error = (1 / (1 + np.exp(-np.clip(active @ layers[2] + layers[3], -50, 50))) - by) / len(by)
            back = (error[:, None] * layers[2]) * (h > 0)
            step += 1
            for k, g in enumerate((bx.T @ back, back.sum(0), active.T @ error, error.sum())):
                g = g + 1e-4 * layers[k] if k in (0, 2) else g
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = (layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    z, hy = network.logits(x[held]), y[held]
    temperatures = np.geomspace(1, 8, 41)
    loss = [np.mean(np.logaddexp(0, z / t) - hy * z / t) for t in temperatures]
    network.temperature = float(temperatures[int(np.argmin(loss))])
    return network


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> Network:
    """Fit to labelled documents of all folds but 0, at most TRAINING_DOCUMENTS of them."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y")).where(fold("id", folds) != 0)
    known = table(known, "labels")
    share = min(1.0, 1.2 * TRAINING_DOCUMENTS / max(1, known.count()))  # few more than are taken, so that the sort is small
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40))).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id").limit(TRAINING_DOCUMENTS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = table(rows.join(F.broadcast(known), "id").select("id", "text", "y"), "labelled").repartition(8, "id")
    sums = np.zeros((BUCKETS, LENGTH), np.float32)
    for r in rows.select("text").mapInArrow(_context_sums, "sums binary").toLocalIterator():
        sums += np.frombuffer(r[0], np.float32).reshape(BUCKETS, LENGTH)
    vectors = word_vectors(sums)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "y", "x"])

    got = rows.mapInArrow(features, "id long, y double, x binary").toArrow().sort_by("id")
    x = np.frombuffer(b"".join(got.column(2).to_pylist()), np.float32).reshape(len(got), -1) if len(got) else np.zeros((0, vectors.shape[1] + LENGTH + 1), np.float32)
    return fit_network(vectors, x, got.column(1).to_numpy())


def score_column(spark: SparkSession, text: Column, network: Network) -> Column:
    """The network's probability of label 1."""
    shared = spark.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts), pa.float64())

    return score(text)


def scored(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Only the text makes the score; null and empty texts get that of no words.
    Each row is scored by itself: repeated rows repeat, a null doc_id is in the
    fold of empty text, an empty table gives no rows, other columns play no part.  A
    score equal to the threshold is predicted 1.
    """
    score = score_column(docs.sparkSession, F.col("text"), network)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", score.alias("score"))
    return rows.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
