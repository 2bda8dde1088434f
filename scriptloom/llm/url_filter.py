"""URL filters: host and path rules, and beyond them the ratio of two character language models.

URLs that rules allow or block are the accepted and rejected examples of two
smoothed Markov models of variable order.  A URL without a rule is blocked if
its log-likelihood difference for each character exceeds a threshold that is
set on examples kept out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import U64, as_long, mix, text_slices
from .scratch import table

ORDER = 5
#: Counts at most, of contexts and next bytes of both sides, that executors hold; more of them are joined, none is dropped.
MODEL_ROWS = 200_000
#: One example in so many sets the threshold instead of adding to the counts.
CALIBRATION = 5
BINS, REACH = 4000, 8.0
EDGE = 10  # a line feed before and after each URL

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules_from(text: str) -> tuple[Rule, ...]:
    """Rules of "verdict host/path" items, split at commas."""
    parts = (item.split() for item in text.split(","))
    return tuple(Rule(verdict, *(place[: place.index("/")], place[place.index("/") :])) for verdict, place in parts)


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _places(urls: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(first row, rows, row of each step, its next byte and the ORDER bytes before it, how many of these the URL has)."""
    for row, data, offsets in text_slices(urls, 1 << 20):
        rows = len(offsets) - 1
        sizes = np.diff(offsets)
        begin = offsets[:-1] + 2 * np.arange(rows)
        padded = np.full(len(data) + 2 * rows, EDGE, np.uint8)
        padded[np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, sizes)] = data
        of = np.repeat(np.arange(rows), sizes + 2)
        inside = np.ones(len(padded), bool)
        inside[begin] = False
        place = np.flatnonzero(inside)
        yield row, rows, of[place], [padded[np.maximum(place - k, 0)] for k in range(ORDER + 1)], place - begin[of[place]]


def _contexts(around: list[np.ndarray], back: np.ndarray) -> list[np.ndarray]:
    """Contexts of orders 0 to ORDER; 0: the URL is too short for it."""
    context, contexts = np.full(len(back), 0x51ED270B, U64), []
    for k in range(ORDER + 1):
        if k:
            context = context * U64(0x100000001B3) + around[k].astype(U64) + U64(1)
        full = mix(context + U64(k << 56)) | U64(1)
        contexts.append(np.where(back >= k, full, U64(0)))
    return contexts


def _steps(urls: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(first row, rows, row and next byte of each step, contexts of orders 0 to ORDER)."""
    for row, rows, of, around, back in _places(urls):
        yield row, rows, of, around[0], _contexts(around, back)


def _grams(around: list[np.ndarray], back: np.ndarray) -> np.ndarray:
    """A step in one number: its next byte, the bytes before it, and how many these are."""
    order = np.minimum(back, ORDER)
    return sum((np.where(order >= k, x, 0).astype(np.int64) << (8 * k) for k, x in enumerate(around)), order.astype(np.int64) << 48)


def _cut(gram: np.ndarray, order: int) -> np.ndarray:
    """The grams with no more than ``order`` bytes before."""
    return (gram & ((1 << (8 * order + 8)) - 1)) | (order << 48)


def _pair(context: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(context + byte.astype(U64) * U64(0x9E3779B97F4A7C15))


class Markov:
    """Interpolated Witten-Bell probabilities from all counts of (context, next byte)."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, count: np.ndarray):
        pair = _pair(context, byte)
        order = np.argsort(pair)
        self.pair, self.count = pair[order], count[order].astype(np.float64)
        self.context, at, kinds = np.unique(context, return_inverse=True, return_counts=True)
        self.total, self.kinds = np.bincount(at, count, len(self.context)), kinds.astype(np.float64)

    @staticmethod
    def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(where, what), len(where) - 1)
        return at, where[at] == what

    def log_probability(self, byte: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(byte), 1 / 256)
        if not len(self.pair):
            return np.log(p)
        for context in contexts:
            at, known = self._find(self.context, context)
            pair_at, seen = self._find(self.pair, _pair(context, byte))
            total, kinds = self.total[at], self.kinds[at]
            count = np.where(seen, self.count[pair_at], 0.0)
            p = np.where(known, (count + kinds * p) / (total + kinds), p)
        return np.log(p)


@dataclass
class Ratio:
    """Rejected against accepted; threshold: the highest difference that is allowed.

    The models are None where their counts are too many for an executor; then
    ``contexts`` is joined.
    """

    accepted: Markov | None
    rejected: Markov | None
    threshold: float = float("inf")
    contexts: DataFrame | None = None

    def differences(self, urls: pa.Array) -> np.ndarray:
        out = np.zeros(len(urls))
        for row, rows, of, byte, contexts in _steps(urls):
            step = self.rejected.log_probability(byte, contexts) - self.accepted.log_probability(byte, contexts)
            out[row : row + rows] = np.bincount(of, step, rows) / np.maximum(1, np.bincount(of, minlength=rows))
        return out

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows``, which have a url, with their difference."""
        if self.contexts is not None:
            return _joined(rows, self.contexts)
        shared = rows.sparkSession.sparkContext.broadcast((self.accepted, self.rejected))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Ratio(*shared.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.differences(batch.column("url")))], names=[*batch.schema.names, "difference"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("difference", T.DoubleType())]))


def _by_context(counts: DataFrame) -> DataFrame:
    """A row for each context: of both sides, how often it occurs and before how many bytes, and the counts of each."""
    of_side = lambda side, what: F.sum(F.when(F.col("blocked") == side, what))
    whole = [of_side(bool(i), what).alias(f"{name}{i}") for i in (0, 1) for name, what in (("total", F.col("count")), ("kinds", F.lit(1)))]
    return counts.groupBy("context").agg(*whole, F.collect_list(F.struct("blocked", "byte", "count")).alias("seen"))


def _joined(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """As Ratio.scored, by joins: each different gram is looked up once, in the order of its length.

    A gram's probability needs that of the gram that is one byte shorter, and at
    most 256 grams share such a one, so no key is hot.  A slice of URLs has one
    row for each of its grams, with their places; what they are worth is summed
    for the whole slice.
    """
    rows = table(rows.withColumn("uid", F.monotonically_increasing_id()), "urls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for row, n, of, around, back in _places(batch.column(1)):
                gram = _grams(around, back)
                order = np.argsort(gram, kind="stable")
                first = np.flatnonzero(np.diff(gram[order], prepend=-1))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)).astype(np.int32)), pa.array(of[order].astype(np.int32)))
                uids = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(len(first) + 1), 1).astype(np.int32) * n), pa.array(uid[row : row + n]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), uid[row])), pa.array(gram[order[first]]), places, uids], names=["slice", "gram", "places", "uids"])

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for k in range(ORDER + 1):
                gram = np.unique(_cut(every[every >> 48 >= k], k))
                around = [(gram >> (8 * i)) & 255 for i in range(ORDER + 1)]
                context = _contexts(around, np.full(len(gram), k))[k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram), pa.array(_cut(gram, max(0, k - 1))), pa.array(as_long(context)), pa.array(around[0].astype(np.int32))], names=["k", "gram", "below", "context", "byte"])

    steps = table(rows.select("uid", "url").mapInArrow(run, "slice long, gram long, places array<int>, uids array<long>"), "url-steps")
    grams = steps.select("gram").distinct().mapInArrow(shorter, "k int, gram long, below long, context long, byte int").distinct()
    count = lambda i: F.coalesce(F.get(F.filter("seen", lambda x: (x.blocked == bool(i)) & (x.byte == F.col("byte"))), F.lit(0))["count"], F.lit(0)).alias(f"c{i}")
    looked_up = table(grams.join(contexts, "context", "left").select("k", "gram", "below", count(0), count(1), "total0", "total1", "kinds0", "kinds1"), "url-grams")
    levels: list[DataFrame] = []
    for k in range(ORDER + 1):
        level = looked_up.where(F.col("k") == k).drop("k")
        level = level.join(levels[-1].select(F.col("gram").alias("below"), "p0", "p1"), "below") if levels else level.withColumns({"p0": F.lit(1 / 256), "p1": F.lit(1 / 256)})
        after = [F.when(F.col(f"total{i}").isNull(), F.col(f"p{i}")).otherwise((F.col(f"c{i}") + F.col(f"kinds{i}") * F.col(f"p{i}")) / (F.col(f"total{i}") + F.col(f"kinds{i}"))).alias(f"p{i}") for i in (0, 1)]
        levels.append(table(level.select("gram", *after), "url-level"))
    step = reduce(DataFrame.union, levels).select("gram", (F.log("p1") - F.log("p0")).alias("step"))

    def summed(t: pa.Table) -> pa.Table:
        places, uids = (t.column(c).combine_chunks() for c in ("places", "uids"))
        uid, at = uids.flatten().to_numpy(), places.flatten().to_numpy()
        total = np.bincount(at, np.repeat(t.column("step").to_numpy(), places.value_lengths().to_numpy()), len(uid))
        return pa.table({"uid": pa.array(uid), "difference": pa.array(total / np.bincount(at, minlength=len(uid)))})

    each = steps.join(step, "gram").drop("gram").groupBy("slice").applyInArrow(summed, "uid long, difference double")
    return rows.join(each, "uid", "left").drop("uid")


def _counts(examples: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocked = np.array(batch.column(1).to_pylist(), bool)
            for row, rows, of, byte, contexts in _steps(batch.column(0)):
                own = blocked[row : row + rows][of]
                for side in (False, True):
                    for context in contexts:
                        take = (own == side) & (context != 0)
                        key = np.stack([context[take], byte[take].astype(U64)], 1)
                        pairs, counts = np.unique(key, axis=0, return_counts=True)
                        if len(counts):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), side)), pa.array(as_long(pairs[:, 0])), pa.array(pairs[:, 1].astype(np.int32)), pa.array(counts.astype(np.int64))], names=["blocked", "context", "byte", "count"])

    return examples.select("url", "blocked").mapInArrow(run, "blocked boolean, context long, byte int, count long").groupBy("blocked", "context", "byte").agg(F.sum("count").alias("count"))


def train(examples: DataFrame, order_by: str = "url") -> Ratio:
    """Fit the two models and the threshold to ``examples`` (url, blocked): all of them are counted, on the executors."""
    fold = F.pmod(F.xxhash64(order_by), F.lit(CALIBRATION))
    counts = table(_counts(examples.where(fold != 0)), "url-counts")
    size = {r[0]: r[1] for r in counts.groupBy("blocked").count().collect()}
    if sum(size.values()) > MODEL_ROWS:
        ratio = Ratio(None, None, contexts=table(_by_context(counts), "url-contexts"))
    else:
        rows = counts.toArrow()
        blocked, context, byte, count = (rows.column(c).to_numpy() for c in ("blocked", "context", "byte", "count"))
        ratio = Ratio(*(Markov(context[own].view(U64), byte[own], count[own]) for own in (blocked == side for side in (False, True))))
    if len(size) < 2:
        return ratio
    at = F.floor((F.col("difference") + REACH) * (BINS / (2 * REACH)))
    held = ratio.scored(examples.where(fold == 0).select("url", "blocked"))
    kept_out = held.groupBy("blocked", F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).alias("bin")).count().collect()
    seen = np.zeros((2, BINS))
    for r in kept_out:
        seen[int(r[0]), r[1]] += r[2]
    total = np.maximum(seen.sum(1), 1)
    wrong = (seen[0].sum() - np.cumsum(seen[0])) / total[0] + np.cumsum(seen[1]) / total[1]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    ratio.threshold = float((best[len(best) // 2] + 1) * 2 * REACH / BINS - REACH)
    return ratio


def judged(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, difference) for every row.

    The longest rule that fits decides; else the models do, over the whole URL.
    A null URL, or one without "://", has empty host and path, and no rule; a
    null or empty one is allowed.  If rules allow or block no URL at all, the
    models allow everything.  Each row is judged by itself: repeated rows
    repeat, a null id stays null, an empty table gives no rows, other columns
    play no part.  A difference equal to the threshold is allowed.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    rows = rows.select("page_id", "url", "host", "path", name.alias("rule"), verdict.alias("by_rule"))
    ratio = train(rows.where("by_rule is not null").select("url", (F.col("by_rule") == "block").alias("blocked")))
    scored = ratio.scored(rows)
    blocked = (F.length(F.coalesce("url", F.lit(""))) > 0) & (F.col("difference") > ratio.threshold)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "difference")
