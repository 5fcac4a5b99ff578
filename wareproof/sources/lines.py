"""Lines of text files with their numbers, in the order of file names and of lines in a file.

Spark packs blocks of files into tasks by size, so the order in which rows come says nothing about the order of files. The
file and the block of a row are known, though, and rows of a block come in order: blocks are counted, one row per block is
summed up in order, and a line's number is that of its block plus its place in it. Files of any size take any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, value): every line of the files, blank ones too, numbered 0, 1, ... without gaps."""
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("_file", F.xxhash64("_path"))
    blocks = rows.groupBy("_path", "_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    # One short row per block meets in this window, not the lines.
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset")
    )
    # As short a list goes to every task: shuffled by block, all lines would move, and a block would land in one task.
    return rows.join(F.broadcast(offsets), ["_file", "_start"]).select((F.col("_row") + F.col("_offset")).alias("line"), "value")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str, line: str) -> DataFrame:
    """JSON lines with a fixed schema and their number in column ``line``. A damaged line is a row of nulls; blank lines are
    counted but give no row."""
    lines = numbered_lines(spark, path).filter(F.length(F.trim("value")) > 0)
    # The inline keeps later filters from being pushed below the parser and repeating it.
    return lines.select(F.col("line").alias(line), F.inline(F.array(F.from_json("value", schema))))
