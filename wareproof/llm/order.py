"""Numbering rows in sort order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareproof.llm.common import written


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ascending order of ``keys`` (nulls first), which must tell its rows apart.

    Rows are dealt by range, counted per range, and numbered within their range from the sum of those before; one row
    per range is all that meets in a single task.
    """
    ranged = df.repartitionByRange(*(F.col(k).asc_nulls_first() for k in keys)).withColumn("__range", F.spark_partition_id())
    placed = written(ranged, "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    firsts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*(F.col(k).asc_nulls_first() for k in keys)))
    numbers = placed.withColumn("__place", place).join(firsts, "__range")
    return numbers.withColumn(name, F.col("__first") + F.col("__place") - 1).drop("__range", "__place", "__first")
