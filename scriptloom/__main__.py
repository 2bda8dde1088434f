"""Romanize text files: python -m scriptloom INPUT OUTPUT [--lcode xyz] [--format str|edges|lattice|alts|offsets|html] [--column N]

python -m scriptloom --text WORD ... OUTPUT romanizes its arguments instead;
--distance [--lcode xyz] [--lcode2 xyz] measures the pairs of INPUT (s1 TAB s2).

INPUT is anything that spark.read.text takes; OUTPUT a folder of text files, in
the order of the lines.  A line may start with ``::lcode xyz`` and then keeps
that prefix.  --column romanizes one tab-separated column and leaves the others.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import distance, romanize
from .sources import text_files


def converted(lines: DataFrame, lcode: str | None, rom_format: str, column: int | None, max_lines: int | None) -> DataFrame:
    """(order, value): the output line of each input line (file, line_no, line)."""
    rows = text_files.with_directives(lines).withColumn("lcode", F.coalesce("lcode", F.lit(lcode).cast("string")))
    rows = rows.withColumn("key", F.concat_ws(":", "file", F.lpad(F.col("line_no").cast("string"), 12, "0")))
    if max_lines:
        rows = rows.orderBy("key").limit(max_lines)
    if column is not None:
        parts = F.split("text", "\t", -1)
        rows = rows.withColumns({"before": F.slice(parts, 1, column - 1), "after": F.slice(parts, column + 1, F.greatest(F.size(parts) - column, F.lit(0))), "text": F.coalesce(F.get(parts, F.lit(column - 1)), F.lit(""))})
    if rom_format == "str":
        out = romanize.romanize(rows, "text", lcode_col="lcode")
        value = F.concat("prefix", "romanized")
        if column is not None:
            value = F.concat("prefix", F.array_join(F.concat("before", F.array("romanized"), "after"), "\t"))
        return out.select(F.col("key").alias("order"), value.alias("value"))
    edges = romanize.romanize_alternatives(rows, "key", "text", "lcode") if rom_format == "alts" else romanize.romanize_edges(rows, "key", "text", "lcode", "lattice" if rom_format == "lattice" else "edges")
    if rom_format == "offsets":
        out = romanize.offset_alignment(edges, "key").withColumnRenamed("alignment", "value")
    elif rom_format == "html":
        out = romanize.mouse_over(edges, rows, "key", "text").withColumnRenamed("html", "value")
    else:
        listed = F.array_sort(F.collect_list(F.struct("start", "end", "txt", "type")))
        out = edges.groupBy("key").agg(F.to_json(listed).alias("value"))
    return rows.select("key").join(out, "key", "left").select(F.col("key").alias("order"), F.coalesce("value", F.lit("[]" if rom_format in ("edges", "lattice", "alts") else "")).alias("value"))


def measured(lines: DataFrame, lc1: str, lc2: str) -> DataFrame:
    """(order, value): s1 TAB s2 TAB cost of each pair, after a line that names the languages; lines that are no pair are empty."""
    key = F.concat_ws(":", "file", F.lpad(F.col("line_no").cast("string"), 12, "0"))
    rows = lines.where(~F.col("line").rlike(r"^\s*(#|$)")).select(key.alias("order"), F.when(F.col("line").contains("\t"), F.split("line", "\t", 3)).alias("p"))
    rows = rows.select("order", text_files.tx.dequoted(F.col("p")[0]).alias("s1"), text_files.tx.dequoted(F.col("p")[1]).alias("s2"))
    cost = distance.cost_distance(F.col("s1"), F.col("s2"), lc1=lc1, lc2=lc2)
    value = F.when(F.col("s1").isNotNull(), F.concat_ws("\t", "s1", "s2", F.regexp_replace(cost.cast("string"), r"\.0$", ""))).otherwise("")
    header = lines.sparkSession.createDataFrame([("", f"# Lang-code-1: {lc1} Lang-code-2: {lc2}")], "order string, value string")
    return header.union(rows.select("order", value))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="scriptloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("input", nargs="?")
    p.add_argument("output")
    p.add_argument("--text", nargs="+")
    p.add_argument("--distance", action="store_true")
    p.add_argument("--lcode")
    p.add_argument("--lcode2")
    p.add_argument("--format", default="str", choices=["str", "edges", "lattice", "alts", "offsets", "html"])
    p.add_argument("--column", type=int)
    p.add_argument("--max-lines", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("scriptloom").getOrCreate()
    if a.text:
        source = spark.createDataFrame([("", i, t) for i, t in enumerate(a.text, 1)], "file string, line_no long, line string")
    else:
        source = text_files.lines(spark, a.input)
    if a.distance:
        text_files.write_lines(measured(source, a.lcode or "eng", a.lcode2 or a.lcode or "eng"), a.output, "value", "order")
        return
    text_files.write_lines(converted(source, a.lcode, a.format, a.column, a.max_lines), a.output, "value", "order")


if __name__ == "__main__":
    main()
