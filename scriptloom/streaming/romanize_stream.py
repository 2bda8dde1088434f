"""Romanization of streams: each micro-batch goes through the batch job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.latin import romanize_latin
from ..operators.romanize import romanize


def romanized_writer(stream: DataFrame, text_col: str, path: str, lcode_col: str | None = None) -> DataStreamWriter:
    """A writer that appends each micro-batch, romanized, to Parquet files at ``path``.

    A batch that is run again after a failure overwrites its own folder, so
    every row is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        romanize(batch, text_col, lcode_col=lcode_col).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write)


def latin_stream(stream: DataFrame, text_col: str, lcode: Column | None = None) -> DataFrame:
    """A stream of Latin text, romanized without state."""
    return stream.withColumn("romanized", romanize_latin(F.col(text_col), lcode))


def shared_folder(stream: DataFrame) -> str:
    """A new folder under spark.checkpoint.dir; in local mode a temporary one where that is unset."""
    spark = stream.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(place or tempfile.gettempdir()).rstrip('/')}/stream-{uuid.uuid4().hex}"


def romanize_available(stream: DataFrame, text_col: str, lcode_col: str | None = None) -> DataFrame:
    """Run all that the stream's source has now through ``romanized_writer``; the result as a table."""
    folder = shared_folder(stream)
    done = romanized_writer(stream, text_col, f"{folder}/rows", lcode_col).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows").drop("batch")
