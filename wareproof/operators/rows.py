"""Rows from computed arrays and keys, each computed once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded_rows(df: DataFrame, keys: Sequence, array: Column | str, out: str, place: str | None = None) -> DataFrame:
    """Elements of a computed array as rows, optionally with their place.

    The outer form and a filter behind it: in front of a plain explode the optimizer puts a filter on
    the size of the array, and pushing that down would compute the array, and all it is made of, again.
    """
    if place is None:
        return df.select(*keys, F.explode_outer(array).alias(out)).filter(F.col(out).isNotNull())
    return df.select(*keys, F.posexplode_outer(array).alias(place, out)).filter(F.col(place).isNotNull())


def exploded_column(df: DataFrame, keys: Sequence, array: Column, out: str, place: str) -> DataFrame:
    """``exploded_rows`` of an array made in a projection, which Spark compiles in pieces however large it is; a large generator
    would be interpreted."""
    made = df.select(*keys, array.alias("_array"))
    return exploded_rows(made, [c for c in made.columns if c != "_array"], "_array", out, place)


def with_key(df: DataFrame, key: Column, min_len: int, out: str) -> DataFrame:
    """A computed text key as a column; rows whose key is shorter are dropped.

    A plain filter on the key would be pushed below its computation and compute it a second time.
    """
    computed = df.withColumn("_computed", key)
    kept = F.when(F.length("_computed") >= min_len, F.col("_computed"))
    return exploded_rows(computed, ["*"], F.array(kept), out).drop("_computed")


# Ranges per doubling of a value.
RANGES = 16


def with_median_bounds(counted: DataFrame, group: Sequence[str], value: str, count: str) -> DataFrame:
    """Mark, per group, the one or two middle values of counted distinct values.

    Adds ``_lower`` and ``_upper``: the value where it is the lower or upper middle, else null; their
    minima are the middles. Values are counted by range first, so a window holds the ranges of a group, or
    the distinct values of one range, but never all values of a group.
    """
    size = F.abs(F.col(value).cast("double"))
    ranged = counted.withColumn("_range", F.signum(F.col(value).cast("double")) * F.floor(F.log2(size + 1) * RANGES))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*group, "_range").agg(F.sum(count).alias("_n")).withColumns(
        {"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_all": F.sum("_n").over(whole)}
    )
    left, right = ranged.alias("l"), ranges.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*group, "_range"]]
    joined = left.join(right, on).select("l.*", "r._before", "r._all")
    inside = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumn("_cum", F.col("_before") + F.sum(count).over(inside))
    counts = F.col(count) > 0
    return out.withColumns(
        {
            "_lower": F.when(counts & (F.col("_cum") * 2 >= F.col("_all")), F.col(value)),
            "_upper": F.when(counts & (F.col("_cum") * 2 > F.col("_all")), F.col(value)),
        }
    ).drop("_cum", "_all", "_before", "_range")


def median_of_bounds() -> Column:
    return (F.min("_lower") + F.min("_upper")).cast("double") / 2
