"""The trie of rule sources as a table: a row for each prefix of a source, with the rules whose whole source it is."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import LONGEST, RULES

#: A rule as the trie holds it; of two for one span, that of the higher rank holds: the more restricted, then the later one.
RULE = "struct<t:string,at_syllable_end:string,lcodes:array<string>,place:string,rank:long>"
PREFIXES = f"prefix string, rules array<{RULE}>"
#: What a restriction to languages or a place outweighs: any number of rules that were loaded later.
RESTRICTION = 10**12
RULES_SCHEMA = "s string, t string, lcodes array<string>, place string, load_order long, at_syllable_end string"
#: Prefixes up to which the table is sent to every executor; beyond it, the joins that grow spans shuffle.
BROADCAST_PREFIXES = 500_000

_tables: dict[tuple, DataFrame] = {}


def prefix_rows(rules: Iterable[tuple]) -> list[tuple]:
    """Rows of PREFIXES for rules (source, target, space-separated codes, place[, target at the end of a syllable]), in their order."""
    found: dict[str, list[tuple]] = defaultdict(list)
    for i, (s, t, lcodes, place, *more) in enumerate(rules):
        for n in range(1, len(s)):
            found[s[:n]]  # noqa: B018  # a prefix without rules of its own
        found[s].append((t, more[0] if more else None, lcodes.split(), place, ((lcodes != "") + (place != "") + 1) * RESTRICTION + i))
    return list(found.items())


def authored(spark: SparkSession) -> DataFrame:
    """The authored rules as a table of RULES_SCHEMA."""
    return spark.createDataFrame([(s, t, lc.split(), place, i, more[0] if more else None) for i, (s, t, lc, place, *more) in enumerate(RULES)], RULES_SCHEMA)


def layered(*tables: DataFrame) -> DataFrame:
    """One table of rules from several (s, t, lcodes, place[, load_order, at_syllable_end]), the later ones over the earlier.

    A rule takes the place of those before it that have its source, languages
    and place; within a table, that of the higher load_order.  Rules without a
    source are left out; a null target is an empty one, null codes are none, a
    null place is any.
    """
    rows = None
    for i, df in enumerate(tables):
        given = lambda c, other: F.col(c) if c in df.columns else other  # noqa: B023, E731
        layer = df.where(F.length("s") > 0).select(
            "s", F.coalesce("t", F.lit("")).alias("t"), F.array_sort(F.array_distinct(F.coalesce("lcodes", F.array().cast("array<string>")))).alias("lcodes"), F.coalesce("place", F.lit("")).alias("place"),
            F.struct(F.lit(i).alias("layer"), given("load_order", F.lit(0)).cast("long").alias("n")).alias("order"), given("at_syllable_end", F.lit(None)).cast("string").alias("at_syllable_end"),
        )
        rows = layer if rows is None else rows.union(layer)
    last = rows.groupBy("s", "lcodes", "place").agg(F.max(F.struct("order", "t", "at_syllable_end")).alias("r"))
    # later layers have the higher numbers; a table has fewer rules than a layer is wide
    return last.select("s", "r.t", "lcodes", "place", (F.col("r.order.layer").cast("long") * 10**10 + F.col("r.order.n")).alias("load_order"), "r.at_syllable_end")


def prefix_table(rules: DataFrame) -> tuple[DataFrame, int]:
    """The trie of a table of rules (s, t, lcodes, place, load_order[, at_syllable_end]), and the length of its longest source.

    It is sent to every executor if it has at most BROADCAST_PREFIXES rows.
    """
    end = F.col("at_syllable_end") if "at_syllable_end" in rules.columns else F.lit(None).cast("string")
    rank = ((F.size("lcodes") > 0).cast("long") + (F.col("place") != "").cast("long") + 1) * RESTRICTION + F.col("load_order")
    rule = F.struct("t", end.alias("at_syllable_end"), "lcodes", "place", rank.alias("rank"))
    rows = rules.where(F.length("s") > 0).select("s", rule.alias("rule"), F.explode(F.sequence(F.lit(1), F.length("s"))).alias("n"))
    rows = rows.select(F.substring("s", F.lit(1), F.col("n")).alias("prefix"), F.when(F.col("n") == F.length("s"), F.col("rule")).alias("rule"))
    table = rows.groupBy("prefix").agg(F.collect_list("rule").alias("rules"))
    n, longest = table.agg(F.count("*"), F.max(F.length("prefix"))).first()
    return (F.broadcast(table) if n <= BROADCAST_PREFIXES else table), int(longest or 1)


def rule_table(spark: SparkSession, more: tuple[tuple, ...] = ()) -> tuple[DataFrame, int]:
    """The trie of the authored rules and, over them, a caller's own, and the length of the longest source."""
    key = (spark.sparkContext.applicationId, more)
    if key not in _tables:
        _tables[key] = spark.createDataFrame(prefix_rows((*RULES, *more)), PREFIXES)
    return F.broadcast(_tables[key]), max(LONGEST, *(len(r[0]) for r in more)) if more else LONGEST
