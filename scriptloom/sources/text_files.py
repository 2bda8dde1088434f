"""Sources and sinks of lines: plain text, language directives, TSV columns, worksets, pairs, slots, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import latin
from ..functions import text as tx
from ..plans import char_tables


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): the lines of text files, numbered from 1 in each file; carriage returns and byte-order marks are dropped.

    Blocks of a file are read by different tasks; a small table of the lines of
    each block gives their numbers, so no line is shuffled.  Bytes that are no
    UTF-8 become U+FFFD.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first", before.alias("before"))
    line = F.regexp_replace(F.regexp_replace(F.make_valid_utf8("value"), "^\ufeff", ""), "\r$", "")
    return raw.join(blocks, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_no"), line.alias("line"))


def with_directives(df: DataFrame, line_col: str = "line") -> DataFrame:
    """``df`` with prefix, lcode and text of lines that may start with ``::lcode xyz``."""
    prefix, lcode, text = tx.lcode_directive(F.col(line_col))
    return df.withColumns({"prefix": prefix, "lcode": lcode, "text": text})


def workset(df: DataFrame, line_col: str = "line") -> DataFrame:
    """(snt_id, text) of ``ID.n text`` lines; others, and comments, are left out."""
    pattern = r"^([A-Za-z0-9_-]+\.[0-9]+)\s+(.*)$"
    return df.where(F.col(line_col).rlike(pattern)).select(F.regexp_extract(line_col, pattern, 1).alias("snt_id"), F.regexp_extract(line_col, pattern, 2).alias("text"))


def pairs(df: DataFrame, line_col: str = "line", keep_malformed: bool = False) -> DataFrame:
    """(s1, s2) of ``s1 TAB s2`` lines, quotes around either dropped; comments and blank lines are left out.

    Lines without a tab are left out too, or with ``keep_malformed`` give nulls.
    """
    line = F.regexp_replace(F.col(line_col), "^\ufeff", "")
    kept = df.where(~line.rlike(r"^\s*(#|$)"))
    if not keep_malformed:
        kept = kept.where(line.contains("\t"))
    part = F.split(line, "\t", 3)
    return kept.select(F.when(line.contains("\t"), tx.dequoted(part[0])).alias("s1"), F.when(line.contains("\t"), tx.dequoted(F.get(part, F.lit(1)))).alias("s2"))


def slots(df: DataFrame, names: tuple[str, ...], line_col: str = "line") -> DataFrame:
    """A column for each slot of ``::name value`` lines; comments and blank lines are left out."""
    bare = F.regexp_replace(F.col(line_col), r"\s{2,}#.*$", "")
    kept = df.where(~F.col(line_col).rlike(r"^\s*(#|$)"))
    return kept.select(*[tx.dequoted(tx.slot(bare, n)).alias(n) for n in names])


def write_lines(df: DataFrame, path: str, line_col: str, order_by: str) -> None:
    """Write lines in order: parts are ranges of ``order_by``."""
    df.repartitionByRange(order_by).sortWithinPartitions(order_by).select(F.coalesce(F.col(line_col), F.lit("")).alias("value")).write.text(path)


def write_edges(df: DataFrame, path: str, edges_col: str) -> None:
    """Write arrays of edges as JSON lines."""
    df.select(F.to_json(F.col(edges_col)).alias("value")).write.text(path)


def chart_documents(df: DataFrame, id_col: str, text_col: str, edges_col: str, lcode_col: str) -> DataFrame:
    """(value): a JSON document for each row: its id, text, language and edges."""
    return df.select(F.to_json(F.struct(F.col(id_col).alias("id"), F.col(lcode_col).alias("lang-code"), F.col(text_col).alias("text"), F.col(edges_col).alias("romanization"))).alias("value"))


def workset_blocks(df: DataFrame, id_col: str, text_col: str, rom_col: str, align_col: str) -> DataFrame:
    """(value): a block of ::snt-id, ::orig, ::rom and ::align lines for each row."""
    return df.select(F.concat_ws("\n", F.concat(F.lit("::snt-id "), id_col), F.concat(F.lit("::orig "), text_col), F.concat(F.lit("::rom "), rom_col), F.concat(F.lit("::align "), align_col), F.lit("")).alias("value"))


def unicode_data(spark: SparkSession, path: str) -> DataFrame:
    """(cp, name, category, numeric) of a UnicodeData file."""
    part = F.split("value", ";")
    return spark.read.text(path).select(F.conv(part[0], 16, 10).cast("int").alias("cp"), part[1].alias("name"), part[2].alias("category"), F.nullif(part[8], F.lit("")).alias("numeric"))


def rule_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """(s, t, lcodes, place) of rule lines with slots s, t, lcode and use-only-at-start-of-word and the like."""
    line = F.col(line_col)
    place = F.when(tx.has_slot(line, "use-only-for-whole-word"), "whole").when(tx.has_slot(line, "use-only-at-start-of-word"), "start").when(tx.has_slot(line, "use-only-at-end-of-word"), "end").otherwise("")
    rows = df.where(~line.rlike(r"^\s*(#|$)") & tx.has_slot(line, "s"))
    return rows.select(tx.dequoted(tx.slot(line, "s")).alias("s"), tx.dequoted(F.coalesce(tx.slot(line, "t"), F.lit(""))).alias("t"), F.filter(F.split(F.coalesce(tx.slot(line, "lcode"), F.lit("")), r"[\s,;]+"), lambda x: x != "").alias("lcodes"), place.alias("place"))


def json_rules(df: DataFrame, line_col: str = "line") -> DataFrame:
    """(s, t, lcodes, place) of rules that are JSON objects, one a line; lines that are none, or have no source, are left out."""
    rule = F.from_json(F.col(line_col), "s string, t string, lcodes array<string>, place string")
    rows = df.select(rule.alias("r")).where("r.s is not null")
    return rows.select("r.s", F.coalesce("r.t", F.lit("")).alias("t"), F.coalesce("r.lcodes", F.array().cast("array<string>")).alias("lcodes"), F.coalesce("r.place", F.lit("")).alias("place"))


def rule_tuples(rules: DataFrame) -> tuple[tuple[str, str, str, str], ...]:
    """Rules (s, t, lcodes, place) as the argument that romanize takes; a caller's rules are a small table."""
    return tuple((r.s, r.t, " ".join(r.lcodes), r.place) for r in rules.select("s", "t", "lcodes", "place").collect())


#: Patterns of pinyin sources: their lines' Han text and readings.
PINYIN_LINES = {
    "simple": (r"^(\p{IsHan}+)\t([^\t]+)", 1, 2),
    "unihan": (r"^U\+([0-9A-F]{4,5})\tkMandarin\t(\S+)", 1, 2),
    "cedict": (r"^\S+ (\p{IsHan}+) \[([^\]]+)\]", 1, 2),
}


def pinyin(df: DataFrame, kind: str, line_col: str = "line") -> DataFrame:
    """(s, t) of the lines of a pinyin source: Han text and its reading without tones; other lines are left out."""
    pattern, text, reading = PINYIN_LINES[kind]
    s = F.regexp_extract(line_col, pattern, text)
    if kind == "unihan":
        s = tx.character(F.conv(s, 16, 10).cast("long"))
    t = F.regexp_replace(F.lower(latin.deaccent(F.replace(F.regexp_extract(line_col, pattern, reading), F.lit("u:"), F.lit("u")))), "[0-5 ]", "")
    return df.where(F.col(line_col).rlike(pattern)).select(s.alias("s"), t.alias("t"))


def chart_header(spark: SparkSession, romanizer: str, date: str, lcode: str) -> DataFrame:
    """(value): the JSON line that stands before chart documents."""
    return spark.range(1).select(F.to_json(F.struct(F.lit(romanizer).alias("romanizer"), F.lit(date).alias("date"), F.lit(lcode).alias("lang-code"))).alias("value"))


def write_tables(spark: SparkSession, path: str) -> None:
    """Write the dimension tables as Parquet: characters, numerals, and the numerals that numbers aren't composed of."""
    table = char_tables.characters(spark)
    table.write.parquet(f"{path}/characters")
    numerals = table.where("value is not null or fraction is not null").select("cp", "script", "value", "base", "fraction")
    numerals.write.parquet(f"{path}/numerals")
    char_tables.rejected_numerals(spark).write.parquet(f"{path}/rejected-numerals")
