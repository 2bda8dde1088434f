"""Statistics of texts and labels as grouped Spark jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..plans import char_classes, char_tables


def character_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(char, n): occurrences of each character."""
    return df.select(F.explode(tx.characters(F.col(text_col))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def script_profile(df: DataFrame, text_col: str, by: str) -> DataFrame:
    """(by, char_type, n): characters by broad class; classes are found once for each different character."""
    counts = df.select(by, F.explode(tx.characters(F.col(text_col))).alias("char")).groupBy(by, "char").agg(F.count("*").alias("n"))
    return counts.groupBy(by, tx.character_type(F.col("char")).alias("char_type")).agg(F.sum("n").alias("n"))


def class_profile(df: DataFrame, text_col: str, by: str) -> DataFrame:
    """(by, char_class, is_letter, n): characters by their class; the class is looked up once for each different character."""
    counts = df.select(by, F.explode(tx.characters(F.col(text_col))).alias("char")).groupBy(by, "char").agg(F.count("*").alias("n"))
    return char_classes.with_class(counts, "char").groupBy(by, "char_class", "is_letter").agg(F.sum("n").alias("n"))


def right_to_left(text: Column) -> Column:
    """Whether Hebrew, Arabic, N'Ko and Thaana letters outnumber other letters."""
    rtl = F.regexp_count(text, F.lit(r"[\p{IsHebrew}\p{IsArabic}\p{IsNko}\p{IsThaana}&&\p{L}]"))
    return rtl * 2 > F.regexp_count(text, F.lit(r"\p{L}"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, pmi): joint count and pointwise mutual information (base 2) of each pair of values; nulls are left out."""
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    of_a, of_b = joint.groupBy(a).agg(F.sum("n").alias("n_a")), joint.groupBy(b).agg(F.sum("n").alias("n_b"))
    total = joint.agg(F.sum("n").alias("total"))
    both = joint.join(of_a, a).join(of_b, b).crossJoin(F.broadcast(total))  # total is one row
    return both.select(a, b, "n", F.log2(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("pmi"))


def precision_recall(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1); ratios are null where undefined."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counts = df.agg(one(predicted & actual).alias("tp"), one(predicted & ~actual).alias("fp"), one(~predicted & actual).alias("fn"))
    ratio = lambda x, y: F.when(y > 0, x / y)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def divergence(left: DataFrame, right: DataFrame, value: str, smooth: float = 1.0) -> DataFrame:
    """One row (kl): Kullback-Leibler divergence (base 2) of the values of ``left`` from those of ``right``, with added counts."""
    p, q = left.groupBy(value).agg(F.count("*").alias("p")), right.groupBy(value).agg(F.count("*").alias("q"))
    both = p.join(q, value, "full").select(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    sums = both.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.count("*").alias("k"))
    pp, qq = (F.col("p") + smooth) / (F.col("sp") + smooth * F.col("k")), (F.col("q") + smooth) / (F.col("sq") + smooth * F.col("k"))
    return both.crossJoin(F.broadcast(sums)).agg(F.sum(pp * F.log2(pp / qq)).alias("kl"))  # sums is one row


def integer_ranges(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first, last): maximal runs of consecutive integers of each key."""
    island = F.col(value) - F.dense_rank().over(Window.partitionBy(key).orderBy(value))
    return df.select(key, value).distinct().withColumn("island", island).groupBy(key, "island").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("island")


def range_text(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ranges): each key's integers as text, such as 1-3, 7."""
    shown = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct("first", shown.alias("s"))))
    return integer_ranges(df, key, value).groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x.s), ", ").alias("ranges"))


def multi_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n, pmi): joint count of the values of several columns, and how much likelier (base 2) they are together than each by itself; nulls are left out."""
    joint = df.where(F.expr(" and ".join(f"`{c}` is not null" for c in columns))).groupBy(*columns).agg(F.count("*").alias("n"))
    total = joint.agg(F.sum("n").alias("total"))
    both = joint.crossJoin(F.broadcast(total))  # total is one row
    apart = F.lit(0.0)
    for i, c in enumerate(columns):
        both = both.join(joint.groupBy(c).agg(F.sum("n").alias(f"n_{i}")), c)
        apart = apart + F.log2(F.col(f"n_{i}") / F.col("total"))
    return both.select(*columns, "n", (F.log2(F.col("n") / F.col("total")) - apart).alias("pmi"))


def character_profile(df: DataFrame, text_col: str) -> DataFrame:
    """(char, n, category, script, kind, name): each character with its count and what Unicode tells of it."""
    spark = df.sparkSession
    counts = character_counts(df, text_col).withColumn("cp", F.ascii("char"))
    known = char_tables.characters(spark).select("cp", "category", "script", "kind")
    return counts.join(F.broadcast(known), "cp", "left").join(F.broadcast(char_tables.names(spark)), "cp", "left").select("char", "n", "category", "script", "kind", "name")


def unread_numerals(df: DataFrame, text_col: str, most: int = 100) -> DataFrame:
    """(char, name, number, n): the most frequent numerals of the texts that no number is composed of."""
    counts = character_counts(df, text_col).withColumn("cp", F.ascii("char"))
    found = counts.join(F.broadcast(char_tables.rejected_numerals(df.sparkSession)), "cp").select("char", "name", "number", "n")
    return found.orderBy(F.desc("n"), "char").limit(most)


def suspicious_readings(edges: DataFrame) -> DataFrame:
    """(txt, type, n): readings with a space inside or a letter beyond ASCII, such as names that stand for themselves."""
    odd = F.col("txt").rlike(r"\S\s+\S|[\p{L}&&[^\x00-\x7F]]")
    return edges.where(odd & ~F.col("type").startswith("num")).groupBy("txt", "type").agg(F.count("*").alias("n"))


def bad_byte_counts(df: DataFrame, raw_col: str) -> DataFrame:
    """One row (lines, bad_lines, bad_bytes) of a column of bytes."""
    bad = tx.bad_bytes(F.col(raw_col))
    return df.select(bad.alias("bad")).agg(F.count("*").alias("lines"), F.count_if(F.col("bad") > 0).alias("bad_lines"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad_bytes"))
