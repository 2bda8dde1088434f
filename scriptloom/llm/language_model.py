"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, beside a smoothed unigram base.

The model predicts units: the end, and every word that occurs LEAST_COUNT times
or more in training, so the vocabulary grows with the corpus; rarer words are in
groups by their last bytes.  Its score is bilinear in the units before and the
unit itself.  The other words (leaves) are dealt to classes and these to
families, each of about the cube root of their number.  The end, the most
frequent words, the groups and the families stand at the top; a leaf's
probability is its family's times its class's within the family times its own
within the class.  All three levels are normalised by batched matrix products; a
word of a group has its smoothed share of the group's count.  So the
probabilities of all words and one unknown word for each group sum to one.

Word counts and training cover every training document.  Training goes in
rounds: in each, every task trains on its next share of its documents from the
parameters that all tasks have then; those are averaged, at the top and of
classes by tokens, those of a unit by how often each task met it.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from itertools import groupby
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import FOLDED, U64, as_long, hashes, mix, text_slices, words
from .heavy import heaviest
from .quality_model import fold
from .scratch import table

#: Units: the end, frequent words, groups of rare words; those from UNITS on are leaves.
END, FREQUENT, GROUPS = 0, 127, 64
UNITS = 1 + FREQUENT + GROUPS
#: A word of at least so many training tokens is a unit of its own, however many there are.
LEAST_COUNT = 20
#: Words at most whose counts every executor holds besides those of units, the most frequent ones; those beyond are joined.
HEAD_WORDS = 200_000
LENGTH, NOISE, RATE = 16, 24, 0.01
#: Tokens of a step: the first steps are short, and grow with the tokens that a task has seen.
FIRST_STEP, LAST_STEP, STEP_GROWTH = 64, 4096, 128
#: A step in one family or class has this part of the tokens; noise that its tokens share; the rate of the rows of units.
CLASS_PART, CLASS_NOISE, ROW_RATE = 8, 12, 0.1
#: Rows of parameters, or contexts, handled at a time.
BLOCK, SCORED = 1024, 256
#: Tokens of a shard: each shard trains a model of its own in each round, so this and the corpus set their number, not the cluster.
SHARD_TOKENS = 16_000_000
#: Times that the tasks' models are brought together; each document is in one round.
ROUNDS = 3
SMOOTH = 0.1
BATCH_TOKENS = 1_000_000


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its group by its last two bytes, and its row."""
    starts, ends, row = words(data, offsets)
    last = FOLDED[data[ends - 1]] if len(ends) else np.zeros(0, U64)
    before = np.where(ends - starts > 1, FOLDED[data[np.maximum(ends - 2, 0)]], U64(0)) if len(ends) else last
    return hashes(data, starts, ends), (mix(last + before * U64(3)) % U64(GROUPS)).astype(np.int64), row


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, part, c): how often each word, by its hash, occurs in all of ``texts`` (text), and its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def summed() -> pa.RecordBatch:
            word, part = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            word, at, count = np.unique(word, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(as_long(word)), pa.array(part[at].astype(np.int32)), pa.array(count.astype(np.int64))], names=["word", "part", "c"])

        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                word, part, _ = _words(data, offsets)
                held.append((word, part))
                total += len(word)
                if total >= BATCH_TOKENS:
                    yield summed()
                    held, total = [], 0
        if total:
            yield summed()

    return texts.mapInArrow(run, "word long, part int, c long").groupBy("word").agg(F.first("part").alias("part"), F.sum("c").alias("c"))


@dataclass
class Counts:
    """What every executor holds of the word counts."""

    n: int  # training tokens
    v: int  # distinct ones
    docs: int
    head: np.ndarray  # sorted hashes
    head_count: np.ndarray
    frequent: np.ndarray  # sorted hashes of the words that are units
    group_count: np.ndarray
    group_words: np.ndarray
    vocabulary: np.ndarray  # sorted hashes of the leaves
    leaf: np.ndarray  # and their places in the order of the classes
    leaf_count: np.ndarray  # by place

    def group_log(self) -> np.ndarray:
        """log10 of each group's smoothed total."""
        return np.log10(self.group_count + SMOOTH * (self.group_words + 1))

    def units(self, word: np.ndarray, part: np.ndarray) -> np.ndarray:
        unit = 1 + FREQUENT + part
        for known, place in ((self.vocabulary, UNITS + self.leaf), (self.frequent, 1 + np.arange(len(self.frequent)))):
            if len(known):
                at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                unit = np.where(known[at] == word, place[at], unit)
        return unit

    def head_of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words, and which of them the head holds."""
        if not len(self.head):
            return np.zeros(len(word)), np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.head, word), len(self.head) - 1)
        return self.head_count[at].astype(np.float64), self.head[at] == word


def gather_counts(counted: DataFrame, docs: int) -> Counts:
    """The head, the leaves and the sums of ``counted``."""
    totals = counted.groupBy("part").agg(F.sum("c"), F.count("*")).collect()
    held = [df.select("word", "part", "c").toArrow() for df in (heaviest(counted, "c", HEAD_WORDS), counted.where(F.col("c") >= LEAST_COUNT))]
    word, part, c = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in range(3))
    word, at = np.unique(word.view(U64), return_index=True)
    part, c = part[at], c[at]
    order = np.lexsort((as_long(word), -c))[:FREQUENT]
    leaves = np.setdiff1d(np.flatnonzero(c >= LEAST_COUNT), order)
    group_count, group_words = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in totals:
        group_count[r[0]] += r[1]
        group_words[r[0]] += r[2]
    own = np.concatenate([order, leaves])
    np.subtract.at(group_count, part[own], c[own])
    np.subtract.at(group_words, part[own], 1)
    by_class = np.lexsort((as_long(word[leaves]), -c[leaves], part[leaves]))
    place = np.empty(len(leaves), np.int64)
    place[by_class] = np.arange(len(leaves))
    n, v = int(sum(r[1] for r in totals)) + docs, int(sum(r[2] for r in totals)) + (docs > 0)
    return Counts(n, v, docs, word, c, np.sort(word[order]), group_count, group_words, word[leaves], place, c[leaves][by_class].astype(np.float64))


def sequence(unit: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units with an end after each row, the two units before each, and the rows."""
    size = np.bincount(row, minlength=rows)
    stop = np.cumsum(size + 1) - 1
    units = np.zeros(len(unit) + rows, np.int32)
    units[np.arange(len(unit)) + row] = unit
    units[stop] = END
    one, two = np.full(len(units), END, np.int32), np.full(len(units), END, np.int32)
    one[1:], two[2:] = units[:-1], units[:-2]
    two[stop - size] = END
    return units, one, two, np.repeat(np.arange(rows), size + 1)


def _summed(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different places, and the sum of the rows at each."""
    packed = np.sort((where.astype(np.int64) << 32) | np.arange(len(where)))
    where = packed >> 32
    edge = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    return where[edge], np.add.reduceat(what.take(packed & 0xFFFFFFFF, axis=0), edge, axis=0)


def _runs(sorted_values: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values, cut to ``most`` at most."""
    edges = np.flatnonzero(np.diff(sorted_values, prepend=-1, append=-1)) if len(sorted_values) else np.zeros(1, np.int64)
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for i in range(first, last, most):
            yield i, min(i + most, last)


def _step_size(seen: int) -> int:
    return min(LAST_STEP, FIRST_STEP + seen // STEP_GROWTH)


class LogBilinear:
    """s(x | a, b) = (R[a] A + R[b] B, 1) . Q[x], with a Q for the top, one for the classes and one for the leaves; its last column is a bias."""

    def __init__(self, unit_share: np.ndarray, leaf_share: np.ndarray | None = None, seed: int = 5):
        random = np.random.default_rng(seed)
        make = lambda *s: random.normal(scale=0.1, size=s).astype(np.float32)
        with_bias = lambda share: np.concatenate([make(len(share), LENGTH), np.log(share).astype(np.float32)[:, None]], 1)
        eye = np.eye(LENGTH, dtype=np.float32)
        leaf_share = np.zeros(0) if leaf_share is None else leaf_share
        self.leaves = len(leaf_share)
        self.size = max(16, int(np.ceil(np.cbrt(self.leaves))))
        sums = lambda x: np.add.reduceat(x, np.arange(0, len(x), self.size)) if len(x) else x
        classes = sums(leaf_share)
        families = sums(classes)
        self.noise = np.concatenate([unit_share, families])
        self.noise /= self.noise.sum()
        #: Of the classes and of the leaves: the share within the family or class.
        self.within = [(own / np.repeat(above, self.size)[: len(own)]).astype(np.float32) for own, above in ((classes, families), (leaf_share, classes))]
        self.parts = [make(UNITS + self.leaves, LENGTH), eye.copy(), 0.5 * eye, with_bias(self.noise), *map(with_bias, self.within)]

    def top(self, units: np.ndarray) -> np.ndarray:
        return np.where(units < UNITS, units, UNITS + (units - UNITS) // (self.size * self.size))

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """What each context multiplies the rows of Q with; the last column is 1."""
        r, a, b = self.parts[:3]
        out = np.ones((len(one), LENGTH + 1), np.float32)
        out[:, :LENGTH] = r.take(one, axis=0) @ a  # take gathers rows several times faster than r[one]
        out[:, :LENGTH] += r.take(two, axis=0) @ b
        return out

    def log10_normalised(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 P(unit or family | context) for all that stand at the top, for each context."""
        z = self.hidden(one, two) @ self.parts[3].T
        return (z - self._log_sum(z.copy())[:, None]) / np.float32(np.log(10))

    @staticmethod
    def _log_sum(z: np.ndarray) -> np.ndarray:
        """The logarithm of the sum of exponentials of each row; changes ``z``."""
        most = z.max(1)
        z -= most[:, None]
        np.exp(z, out=z)
        return most + np.log(z @ np.ones(z.shape[1], np.float32))

    def log10_probability(self, units: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 P(unit | context) of each token."""
        q = self.parts[3]
        across, top, out = np.ascontiguousarray(q.T), self.top(units), np.empty(len(units), np.float32)
        context, at = np.unique(one.astype(np.int64) * (UNITS + self.leaves) + two, return_inverse=True)
        hidden = self.hidden(context // (UNITS + self.leaves), context % (UNITS + self.leaves))
        sums = np.concatenate([self._log_sum(hidden[i : i + SCORED] @ across) for i in range(0, len(hidden), SCORED)] or [np.zeros(0, np.float32)])
        for i in range(0, len(units), 16 * BLOCK):
            j = at[i : i + 16 * BLOCK]
            out[i : i + 16 * BLOCK] = np.einsum("ij,ij->i", hidden.take(j, axis=0), q.take(top[i : i + 16 * BLOCK], axis=0)) - sums[j]
        low = np.flatnonzero(units >= UNITS)
        low = low[np.argsort(units[low])]
        leaf, at, below = units[low] - UNITS, at[low], np.zeros(len(low), np.float32)
        for child, q in ((leaf // self.size, self.parts[4]), (leaf, self.parts[5])):
            for i, j in _runs(child // self.size, 2 * BLOCK):
                begin = int(child[i]) // self.size * self.size
                z = hidden.take(at[i:j], axis=0) @ q[begin : begin + self.size].T
                below[i:j] += z[np.arange(j - i), child[i:j] - begin]
                below[i:j] -= self._log_sum(z)
        out[low] += below
        return out / np.float32(np.log(10))

    def _train_below(self, level: int, child: np.ndarray, h: np.ndarray, state: dict, random: np.random.Generator) -> np.ndarray:
        """One step of the children of the family or class that all the tokens are in; returns what moves ``h``."""
        begin = int(child[0]) // self.size * self.size
        at, k = slice(begin, begin + self.size), 4 + level
        q, share, own = self.parts[k][at], self.within[level][at], child - begin
        noise = np.minimum(np.searchsorted(np.cumsum(share), random.random(CLASS_NOISE, np.float32)), len(share) - 1)
        less = np.log(share * np.float32(CLASS_NOISE))
        z = less[noise] - h @ q.take(noise, axis=0).T
        np.exp(z, out=z)
        z += 1
        moves = np.reciprocal(z, out=z) @ (-np.eye(len(share), dtype=np.float32)[noise])
        moves[np.arange(len(own)), own] += 1 / (1 + np.exp(np.einsum("ij,ij->i", h, q.take(own, axis=0)) - less[own]))
        back, g = moves @ q, moves.T @ h
        moved = state[k][at]
        moved += g * g
        q += np.float32(ROW_RATE * state["rate"]) * g / (np.sqrt(moved) + np.float32(1e-12))
        return back

    def _train_context(self, x: np.ndarray, y: np.ndarray, back: np.ndarray, state: dict) -> None:
        """A step of the rows of the context's units, shorter the more a row has moved."""
        a, b = self.parts[1:3]
        where, g = _summed(np.concatenate([x, y]), np.concatenate([back @ a.T, back @ b.T]))
        moved = state[0][where] + np.einsum("ij,ij->i", g, g) / np.float32(LENGTH)
        state[0][where] = moved
        self.parts[0][where] = self.parts[0].take(where, axis=0) + g * (np.float32(ROW_RATE * state["rate"]) / (np.sqrt(moved) + np.float32(1e-12)))[:, None]

    def train(self, units: np.ndarray, one: np.ndarray, two: np.ndarray, state: dict, random: np.random.Generator) -> None:
        """Noise-contrastive estimation over all given tokens, each once at every level that it has: first the top in random order, then family by family and class by class.

        The tokens of a step share their noise.  ``state`` keeps what the steps
        remember, and their rate as a part of the full one.
        """
        if "step" not in state:
            state |= {0: np.zeros(len(self.parts[0]), np.float32), 4: np.zeros_like(self.parts[4]), 5: np.zeros_like(self.parts[5]), "seen": 0, "step": 0}
            state |= {k: (np.zeros_like(self.parts[k]), np.zeros_like(self.parts[k])) for k in (1, 2, 3)}
        self._train_top(units, one, two, state, random)
        low = random.permutation(np.flatnonzero(units >= UNITS))
        low = low[np.argsort((units[low] - UNITS) // self.size, kind="stable")]
        leaf, one, two = units[low] - UNITS, one[low], two[low]
        step = _step_size(state["seen"]) // CLASS_PART
        for i, j in _runs(leaf // (self.size * self.size), 32 * step):
            h = self.hidden(one[i:j], two[i:j])
            back, mixed = np.empty_like(h), random.permutation(j - i)
            for a in range(0, j - i, 4 * step):
                own = mixed[a : a + 4 * step]
                back[own] = self._train_below(0, leaf[i:j][own] // self.size, h.take(own, axis=0), state, random)
            for a, b in _runs(leaf[i:j] // self.size, step):
                back[a:b] += self._train_below(1, leaf[i + a : i + b], h[a:b], state, random)
            self._train_context(one[i:j], two[i:j], np.ascontiguousarray(back[:, :LENGTH]), state)

    def _train_top(self, units: np.ndarray, one: np.ndarray, two: np.ndarray, state: dict, random: np.random.Generator) -> None:
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        tops, top, columns = len(self.noise), self.top(units), np.arange(LENGTH + 1)
        order, i = random.permutation(len(units)), 0
        while i < len(order):
            pick = order[i : i + _step_size(state["seen"])]
            i += len(pick)
            state["seen"] += len(pick)
            state["step"] = t = state["step"] + 1
            q, x, y, u = self.parts[3], one[pick], two[pick], top[pick]
            noise = random.choice(tops, NOISE, p=self.noise)
            h, of_u = self.hidden(x, y), q.take(u, axis=0)
            data = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, of_u) - log_noise[u]))
            false = log_noise[noise] - h @ q[noise].T
            np.exp(false, out=false)
            false += 1
            np.reciprocal(false, out=false)
            back = data[:, None] * of_u - false @ q[noise]
            back = np.ascontiguousarray(back[:, :LENGTH])
            gq = np.zeros_like(q)
            np.add.at(gq.reshape(-1), ((u * (LENGTH + 1))[:, None] + columns).ravel(), (data[:, None] * h).ravel())
            np.subtract.at(gq, noise, false.T @ h)
            g_a, g_b = (self.parts[0].take(w, axis=0).T @ back for w in (x, y))
            self._train_context(x, y, back, state)
            for k, g in ((1, g_a), (2, g_b), (3, gq)):
                m, v = state[k]
                g = g / np.float32(len(pick))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.parts[k] = (self.parts[k] + state["rate"] * RATE / (1 + t / 400) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)).astype(np.float32)

    def copied(self) -> LogBilinear:
        """A model to train without a change of this one."""
        other = copy.copy(self)
        other.parts = [p.copy() for p in self.parts]
        return other

    def blocks(self, met: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, weights, rows): -1 is the top and the classes; else BLOCK units' rows, weighted by how often they were met."""
        yield -1, np.full(1, met.sum()), np.concatenate([p.ravel() for p in self.parts[1:5]])[None]
        for i in range(0, UNITS + self.leaves, BLOCK):
            yield i // BLOCK, met[i : i + BLOCK], self._rows(i)

    def _rows(self, i: int) -> np.ndarray:
        """Parameters of the units from ``i`` on: of the context, and 0 or those of the leaf."""
        rows = np.zeros((min(BLOCK, UNITS + self.leaves - i), 2 * LENGTH + 1), np.float32)
        rows[:, :LENGTH] = self.parts[0][i : i + BLOCK]
        skip = max(0, UNITS - i)
        rows[skip:, LENGTH:] = self.parts[5][i + skip - UNITS : i + BLOCK - UNITS]
        return rows

    def put(self, block: int, flat: np.ndarray) -> None:
        if block < 0:
            for k in range(1, 5):
                self.parts[k], flat = flat[: self.parts[k].size].reshape(self.parts[k].shape).copy(), flat[self.parts[k].size :]
            return
        i, rows = block * BLOCK, flat.reshape(-1, 2 * LENGTH + 1)
        self.parts[0][i : i + BLOCK] = rows[:, :LENGTH]
        skip = max(0, UNITS - i)
        self.parts[5][i + skip - UNITS : i + BLOCK - UNITS] = rows[skip:, LENGTH:]


def _averaged(t: pa.Table) -> pa.Table:
    """The weighted mean of what all tasks moved a block's rows by."""
    total, weights = 0.0, 0.0
    for w, m in zip(t.column("weights"), t.column("moves"), strict=True):
        w = np.frombuffer(w.as_py(), np.float32).astype(np.float64)[:, None] + 1e-9
        total, weights = total + w * np.frombuffer(m.as_py(), np.float16).reshape(len(w), -1), weights + w
    return pa.table({"block": t.column("block").slice(0, 1), "moves": pa.array([(total / weights).astype(np.float32).tobytes()], pa.binary())})


def _shard_runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first place, end) of each run of equal values."""
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else np.zeros(1, np.int64)
    return [(int(values[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _places(spark: SparkSession, shards: int) -> list[int]:
    """For each shard a number whose hash is dealt to a partition of its own."""
    numbers = spark.range(40 * shards + 200).select("id", F.pmod(F.hash("id"), F.lit(shards)).alias("at"))
    return [r[0] for r in numbers.groupBy("at").agg(F.min("id").alias("id")).orderBy("at").select("id").collect()]


def fit(texts: DataFrame, counts: Counts, rounds: int = ROUNDS, passes: int = 1) -> LogBilinear:
    """Train on all of ``texts`` (text, h), a model for each shard, averaged by blocks of rows after each round.

    A document's hash ``h`` gives its round, its shard and its place there, so
    the same corpus gives the same model on any cluster.  ``passes``: how often a step
    goes through its tokens.
    """
    unit_count = np.full(UNITS, 0.5)
    unit_count[END] += counts.docs
    if len(counts.frequent):
        unit_count[1 : 1 + len(counts.frequent)] += counts.head_of(counts.frequent)[0]
    unit_count[1 + FREQUENT :] += counts.group_count
    total = unit_count.sum() + counts.leaf_count.sum()
    model = LogBilinear(unit_count / total, counts.leaf_count / total)
    share = np.concatenate([unit_count, counts.leaf_count]) / total
    shards = max(1, -(-counts.n // SHARD_TOKENS))

    def trained(slices: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        (start, turn), info = shared.value, fixed.value
        own, state = start.copied(), {"rate": 1 / (1 + turn)}
        random = np.random.default_rng(11)
        met, held, total = np.zeros(UNITS + own.leaves), [], 0

        def step() -> None:
            units, one, two = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            np.add.at(met, units, 1)
            for _ in range(passes):
                own.train(units, one, two, state, random)

        for _, data, offsets in slices:
            word, part, row = _words(data, offsets)
            held.append(sequence(info.units(word, part), row, len(offsets) - 1)[:3])
            total += len(held[-1][0])
            if total >= BATCH_TOKENS:
                step()
                held, total = [], 0
        if total:
            step()
        if met.any():
            state.clear()
            # a unit that a shard hardly met was noise there: that counts for a quarter of its share
            weighted = met + 0.25 * met.sum() * share
            for (block, weights, rows), (_, _, before) in zip(own.blocks(weighted), start.blocks(weighted), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([(rows - before).astype(np.float16).tobytes()], pa.binary())], names=["block", "weights", "moves"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Train each shard of a partition, one after the other."""
        pieces = ((batch, piece) for batch in batches for piece in _shard_runs(batch.column(1).to_numpy()))
        for _, some in groupby(pieces, lambda x: x[1][0]):
            yield from trained(found for batch, (_, first, end) in some for found in text_slices(batch.column(0).slice(first, end - first)))

    context = texts.sparkSession.sparkContext
    placed = F.element_at(F.array(*map(F.lit, _places(texts.sparkSession, shards))), (F.pmod(F.shiftright("h", 20), F.lit(shards)) + 1).cast("int"))
    keyed = texts.withColumn("shard", placed)
    fixed = context.broadcast(counts)
    for turn in range(rounds):
        shared = context.broadcast((model, turn))
        # each text is shuffled in one round only
        sorted_texts = keyed.where(F.pmod("h", F.lit(rounds)) == turn).repartition(shards, "shard").sortWithinPartitions("shard", "h").select("text", "shard")
        got = sorted_texts.mapInArrow(run, "block long, weights binary, moves binary").groupBy("block").applyInArrow(lambda t: _averaged(t), "block long, moves binary").toArrow()
        shared.destroy()  # workers keep what isn't destroyed
        before = {block: rows for block, _, rows in model.blocks(share)}
        for block, moves in zip(got.column("block").to_pylist(), got.column("moves"), strict=True):
            model.put(block, before[block].ravel() + np.frombuffer(moves.as_py(), np.float32))
    fixed.destroy()
    return model


def _local_scores(docs: DataFrame, counts: Counts, model: LogBilinear) -> DataFrame:
    """Scores of ``docs`` (uid, doc_id, text) without the counts of words beyond the head, and those words."""
    shared = docs.sparkSession.sparkContext.broadcast((model, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, info = shared.value
        z, group_log = np.log10(info.n + SMOOTH * (info.v + 1)), info.group_log()
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2), 8 << 20):
                rows = len(offsets) - 1
                word, part, row = _words(data, offsets)
                unit = info.units(word, part)
                units, one, two, of = sequence(unit, row, rows)
                score = np.bincount(of, own.log10_probability(units, one, two), rows)
                count, in_head = info.head_of(word)
                own_log = np.where(in_head, np.log10(count + SMOOTH), 0.0)
                tokens = np.bincount(row, minlength=rows) + 1
                base = np.bincount(row, own_log, rows) + np.log10(info.docs + SMOOTH) - tokens * z
                grouped = (unit > FREQUENT) & (unit < UNITS)
                score += np.bincount(row[grouped], own_log[grouped] - group_log[part[grouped]], rows)
                known = np.bincount(row[in_head], minlength=rows) + (info.docs > 0)
                rest = ~in_head
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[rest], minlength=rows)))).astype(np.int32)), pa.array(as_long(word[rest])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), lists], names=["uid", "doc_id", "n_tokens", "known", "base", "score", "rest"])

    return docs.mapInArrow(run, "uid long, doc_id long, n_tokens long, known long, base double, score double, rest array<long>")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, passes: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Words are runs without white space, A-Z in lower case; each text has one
    end token more.  Training leaves out fold 0 of the ids.  base_score: log10
    probability by smoothed word counts; score: that of the log-bilinear model.

    Null and empty texts consist of the end.  Repeated rows each count, in
    training and in the result; a null doc_id is in the fold of empty text, 0.
    Words of equal count are ordered by their hashes.  Without training rows
    all counts are 0; an empty table gives no rows; other columns play no part.
    Words go by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    training = rows.where(fold("doc_id", folds) != 0).select("text")
    counted = table(word_counts(training), "word-counts")
    counts = gather_counts(counted, training.count())
    hashed = rows.where(fold("doc_id", folds) != 0).select("text", F.xxhash64("doc_id", "text").alias("h"))
    model = fit(hashed, counts, passes=passes)
    local = table(_local_scores(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), counts, model), "scores")
    rest = local.select("uid", F.explode("rest").alias("word")).join(counted.select("word", "c"), "word", "left")
    beyond = rest.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"), F.count("c").alias("more_known"))
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    joined = local.drop("rest").join(beyond, "uid", "left")
    return joined.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "n_tokens", (F.col("known") + more_known).alias("n_known"), F.lit(counts.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
