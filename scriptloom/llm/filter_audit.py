"""Filter interaction audit: what every order of some filters keeps, removes and finds already removed.

Filters applied one after the other walk through a lattice of subsets: an edge
goes from what has been applied to the next filter.  What happens on an edge
depends on the subset alone, not on its order, so documents are counted once on
the 80 edges of five filters, and the 600 steps of their 120 permutations look
their edges up.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import table

#: The filters by their letters; E is the one that looks at the whole table.
FILTERS = "ABCDE"
#: Least words; least share of different words, and most capital letters, in percent.
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS = 100, 80, 10


def text_failures(text: Column) -> Column:
    """The bits 1, 2, 4 and 8 of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, "[ \t-\r]+"), "")
    few = F.size(words) < LEAST_WORDS
    repeated = F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DIFFERENT
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    loud = capitals * 100 > F.length(text) * MOST_CAPITALS
    return sum(((test.cast("int") * (1 << i)) for i, test in enumerate((few, repeated, loud, text.rlike("[#$%&*|]")))), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part and with these labels fail the filters of ``mask``.

    Texts are told apart by their SHA-256.  A document goes through the shuffles
    as its hash, id, part and bits, never as its text.  Documents of one text
    are summed before they meet, so the largest group of copies is a few rows
    for each part; null ids are dealt out by their hash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), text_failures(F.col("text")).alias("mask"))
    rows = rows.withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("hash")).otherwise(F.lit(0)))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").eqNullSafe(1).alias("good"), F.col("toxic").eqNullSafe(1).alias("toxic")).where("id is not null")
    known = known.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("deal", F.lit(0).cast("long"))
    rows = rows.join(known, ["id", "deal"], "left").fillna(False, ["good", "toxic"])
    same = ["hash", "mask", "part", "good", "toxic"]
    by_id = rows.groupBy("id", "deal", *same).agg(F.count("*").alias("n"))
    # a row for each text, part and labels: all its documents, and those of its least id or of none
    has_id = F.col("id").isNotNull()
    by_text = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.when(has_id, F.struct("id", "n"))).alias("least"), F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("without_id"))
    first = F.min("least.id").over(Window.partitionBy("hash"))
    # the parts of one text and labels can split its least id: those of every part with that id count
    found = by_text.withColumn("first", first)
    originals = F.col("without_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - originals).alias("n")))
    return found.select("part", "good", "toxic", F.inline(both)).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges() -> list[tuple[int, int]]:
    """(bits of the filters already applied, number of the next one) of all 80 edges."""
    n = len(FILTERS)
    return [(sum(1 << i for i in chosen), f) for f in range(n) for k in range(n) for chosen in combinations([i for i in range(n) if i != f], k)]


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, f): the edge of every step of every permutation."""
    orders = [(order, step, sum(1 << i for i in order[: step - 1]), order[step - 1]) for order in permutations(range(len(FILTERS))) for step in range(1, len(FILTERS) + 1)]
    return spark.createDataFrame([("".join(FILTERS[i] for i in order), step, before, f) for order, step, before, f in orders], "filter_order string, step int, before int, f int")


def edge_counts(counted: DataFrame) -> DataFrame:
    """(part, before, f) and counts: every edge, with the documents of every part that it keeps, removes or finds removed."""
    n = len(FILTERS)
    paths = {k: factorial(k) * factorial(n - 1 - k) for k in range(n)}
    edges = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(paths[b.bit_count()]).cast("long").alias("paths")) for b, f in lattice_edges()])
    rows = counted.select("part", "mask", "good", "toxic", "n", F.inline(edges))
    mask = F.col("mask")
    alive, fails = mask.bitwiseAND(F.col("before")) == 0, mask.bitwiseAND(F.col("bit")) != 0
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return rows.groupBy("part", "before", "f").agg(
        total(alive & ~fails).alias("kept"),
        total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"),
        total(alive & fails & F.col("good")).alias("good_lost"),
        total(alive & fails & F.col("toxic")).alias("toxic_lost"),
        F.coalesce(F.sum(F.when(alive & fails, F.col("n") * F.col("paths"))), F.lit(0)).alias("on_paths"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step, zeros included; see the module.

    A null or empty text fails A, and is a text of its own for E; a null id is
    neither smaller nor larger than another and so never fails E; rows that
    share the smallest id of a text don't fail it either.  A null part is the
    empty one.  A document is good or toxic if any of its labels is 1, and
    repeated rows are documents of their own.  An empty table gives no rows;
    other columns play no part.

    ``shapley`` is summed over edges: |applied|! (4 - |applied|)! permutations
    cross each.
    """
    edges = table(edge_counts(failures(docs, labels, id_col, text_col, part_col)), "edges")
    sums = edges.groupBy(F.col("part").alias("p"), F.col("f").alias("g")).agg(F.sum("on_paths").alias("shapley"))
    at = F.broadcast(steps(docs.sparkSession))
    rows = edges.drop("on_paths").join(at, ["before", "f"]).join(sums, (F.col("part") == F.col("p")) & (F.col("f") == F.col("g")))
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
