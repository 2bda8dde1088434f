"""Mixing sources to target weights by a temperature, realised as budgeted permutations of blocks.

A source's weight is its share of the tokens to the power of an exponent from 0
(all alike) to 1 (as they are).  The exponent is found by bisection: the
largest that reaches the target entropy, but none by which a source would be
repeated more often than allowed.  A source's documents are dealt to blocks of
about equal size; each pass over the source takes its blocks in another order,
and the last pass stops where the source's part of the budget ends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import bounded, table

#: Sources up to which the bisection runs over a local copy of their token counts (two numbers each); beyond, each step is a Spark job.
LOCAL_SOURCES = 1_000_000
BISECTIONS = 50
#: Blocks that a task puts in order at a time: a pass over more blocks is ordered in ranges, with the same result.
BLOCKS_AT_ONCE = 100_000


@dataclass(frozen=True)
class Target:
    """entropy: share of the highest possible entropy; repeats: passes over a source at most; budget: tokens, as a multiple of all there are."""

    entropy: float = 0.97
    repeats: float = 4.0
    budget: float = 1.0
    block_tokens: int = 20_000
    seed: int = 1


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def _measures(sources: DataFrame, n: int, total: float, budget: float) -> Callable[[float], tuple[float, float, float]]:
    """Of an exponent: sum of the powers of the shares, entropy of the weights, and most passes over a source."""
    if n <= LOCAL_SOURCES:
        tokens = np.array([r[0] for r in sources.orderBy("tokens").select("tokens").collect()], float)

        def local(a: float) -> tuple[float, float, float]:
            powers = (tokens / total) ** a
            w = powers / powers.sum()
            return float(powers.sum()), float(-(w * np.log(w)).sum()), float((w * budget / tokens).max())

        return local

    def spread(a: float) -> tuple[float, float, float]:
        share = F.col("tokens") / F.lit(total)
        power = F.pow(share, F.lit(a))
        s, weighted, most = sources.agg(F.sum(power), F.sum(power * F.log(power)), F.max(power / F.col("tokens"))).first()
        return s, float(np.log(s) - weighted / s), most * budget / s

    return spread


def exponent(measures: Callable[[float], tuple[float, float, float]], n: int, target: Target) -> float:
    """The largest exponent of the target entropy, or the least that keeps to the repeats if that is larger."""

    def least_true(test: Callable[[float], bool]) -> float:
        low, high = 0.0, 1.0
        if test(low):
            return low
        for _ in range(BISECTIONS):
            middle = (low + high) / 2
            low, high = (low, middle) if test(middle) else (middle, high)
        return high

    goal = target.entropy * np.log(n) if n > 1 else 0.0
    if measures(1.0)[1] >= goal:
        return 1.0
    flat_enough = least_true(lambda a: measures(a)[1] < goal)
    return max(flat_enough, least_true(lambda a: measures(a)[2] <= target.repeats))


def _placed(blocks: DataFrame, seed: int) -> DataFrame:
    """``blocks`` (of, epoch, block, blocks, size) with start: the sizes of those before it in its pass, whose order is that of a hash.

    The order is cut into ranges of about BLOCKS_AT_ONCE blocks, so no task
    sees all blocks of a large source.
    """
    place = F.xxhash64(F.lit(seed), "epoch", "of", "block")
    ranges = F.ceil(F.col("blocks") / F.lit(BLOCKS_AT_ONCE))
    part = F.floor((F.shiftright(place, 40) + F.lit(1 << 23)) * ranges / F.lit(1 << 24))
    blocks = table(blocks.withColumns({"place": place, "range": part}), "passes")
    ahead = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = blocks.groupBy("of", "epoch", "range").agg(F.sum("size").alias("size"))
    sums = sums.select(F.col("of").alias("s"), F.col("epoch").alias("e"), F.col("range").alias("r"), ahead(Window.partitionBy("of", "epoch").orderBy("range")).alias("before"))
    inside = blocks.withColumn("within", ahead(Window.partitionBy("of", "epoch", "range").orderBy("place", "block")))
    both = inside.join(sums, F.col("of").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("range") == F.col("r")))
    return both.withColumn("start", F.col("before") + F.col("within")).drop("s", "e", "r", "before", "within", "place", "range")


def mixed(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, block, at): a row for each time a document is taken.

    Ordering by ``at`` (0 to 1: how much of its source's part is used up
    before the document's block), epoch, block and doc_id mixes the sources
    evenly.  A document is taken if it still fits what its source has left, in
    the order of its pass; no source exceeds its part of the budget.

    Documents without words (null and empty texts) are never taken.  Repeated
    rows are documents of their own; rows of one doc_id, source and length are
    interchangeable.  A null source is a source like others, a null doc_id
    stays.  Ties in a pass's order go by doc_id.  An empty table gives no rows;
    other columns play no part.
    """
    seed = target.seed
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), token_count(F.col(text_col)).alias("n_tokens")).where("n_tokens > 0")
    rows = table(rows.withColumn("salt", F.xxhash64(F.lit(seed), "doc_id", "n_tokens")), "lengths")
    sources = table(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    n, total = sources.agg(F.count("*"), F.sum("tokens")).first()
    budget = target.budget * (total or 0)
    if n:
        measures = _measures(sources, n, float(total), budget)
        a = exponent(measures, n, target)
        share = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a)) / F.lit(measures(a)[0])
    else:
        share = F.lit(0.0)
    quotas = sources.select(
        F.col("source").alias("of"), "tokens", share.alias("weight"), F.floor(share * F.lit(budget)).cast("long").alias("quota"), F.ceil(F.col("tokens") / F.lit(target.block_tokens)).cast("long").alias("blocks")
    ).withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("int"))
    quotas = table(quotas, "quotas")
    dealt = rows.join(bounded(quotas, n), F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.col("salt"), F.col("blocks")))
    blocks = dealt.groupBy("of", "tokens", "quota", "passes", "blocks", "block").agg(F.sum("n_tokens").alias("size"))
    blocks = _placed(blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes")))), seed)
    blocks = blocks.withColumn("start", F.col("start") + F.col("epoch") * F.col("tokens")).where("start < quota")
    blocks = blocks.withColumn("whole", F.col("start") + F.col("size") <= F.col("quota"))
    blocks = table(blocks.select(F.col("of").alias("s"), F.col("block").alias("b"), "epoch", "start", "whole", "quota"), "blocks")
    taken = dealt.drop("quota").join(bounded(blocks, blocks.count()), F.col("of").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inside = Window.partitionBy("of", "block", "epoch").orderBy(F.xxhash64("salt", "epoch"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = taken.where(~F.col("whole")).withColumn("end", F.col("start") + F.sum("n_tokens").over(inside)).where("end <= quota").drop("end")
    return taken.where("whole").unionByName(cut).select("doc_id", "source", "n_tokens", "weight", "epoch", "block", (F.col("start") / F.col("quota")).alias("at"))
