"""Joins and rankings that hold when one key owns a large share of the rows.

Two building blocks, both exact and both lazy:

``attach_groups`` joins per-group facts back to rows. The sizes of the groups are known (they are
aggregated first, with partial aggregation before the shuffle), so a big group is split over as many
salts as its size asks for, and only the facts of big groups are repeated.

``ranked`` numbers rows inside groups. A group is cut into slices of consecutive positions, slices
are counted, a running total over the slices gives each its offset, and only one slice is sorted at a
time. No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# A group above this many rows is split; each salt of it holds about this many.
HOT_ROWS = 100_000
# At most this many groups are announced to every task (one key and one number each). Groups beyond
# it take the plain path: each of them is at most 1/HOT_GROUPS of all rows.
HOT_GROUPS = 10_000
# Consecutive positions per slice of a ranking.
SLICE_WIDTH = 1 << 20


def hot_groups(groups: DataFrame, keys: Sequence[str], size: str, hot_rows: int) -> DataFrame:
    """Key and number of salts of the biggest groups: at most HOT_GROUPS rows by construction."""
    salts = F.least(
        F.ceil(F.col(size) / F.lit(hot_rows)).cast("int"), F.lit(1 << 16)
    ).alias("_salts")
    return (
        groups.filter(F.col(size) > hot_rows)
        .orderBy(F.col(size).desc(), *keys)
        .limit(HOT_GROUPS)
        .select(*keys, salts)
    )


def attach_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size: str,
    spread: Sequence[str],
    keep: Column | None = None,
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Join the facts of ``groups`` to ``rows`` on ``keys``.

    ``groups`` has one row per key and the number of rows of the key in ``size``. ``spread`` names
    row columns that differ within a group; their hash picks the salt. ``keep`` drops groups before
    the join, while their sizes still spread their rows. ``how`` is inner or left.
    """
    if hot_rows is None:
        hot_rows = HOT_ROWS
    keys = list(keys)
    hot = hot_groups(groups, keys, size, hot_rows)
    kept = groups if keep is None else groups.filter(keep)
    facts = [c for c in groups.columns if c not in keys]

    # The list of hot groups is limited to HOT_GROUPS short rows, so every task can hold it.
    tagged = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts").cast("bigint")), F.lit(0).cast("bigint")),
    ).drop("_salts")
    repeated = (
        kept.withColumn(
            "_salts",
            F.when(
                F.col(size) > hot_rows,
                F.least(F.ceil(F.col(size) / F.lit(hot_rows)).cast("int"), F.lit(1 << 16)),
            ).otherwise(F.lit(1)),
        )
        .select(*keys, *facts, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
        .withColumn("_salt", F.col("_salt").cast("bigint"))
    )
    return tagged.join(repeated, [*keys, "_salt"], how).drop("_salt")


def ranked(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    at_most: int | None = None,
    slice_width: int | None = None,
) -> DataFrame:
    """Number the rows of every group 1, 2, ... by ``order``; ``at_most`` keeps only the first ones.

    ``order[0]`` must be a bigint position that is (nearly) unique and dense inside a group, such as
    the catalog position: it decides the slice a row belongs to.
    """
    keys, order = list(keys), list(order)
    width = slice_width or SLICE_WIDTH
    sliced = rows.withColumn("_slice", F.floor(F.col(order[0]) / F.lit(width)))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if at_most is not None:
        offsets = offsets.filter(F.col("_before") < at_most)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    # A null-safe match: a key column may be null.
    left, right = sliced.alias("l"), offsets.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_slice"]]
    joined = left.join(right, on, "inner").select("l.*", F.col("r._before").alias("_before"))
    numbered = joined.withColumn("_rn", F.row_number().over(inside))
    if at_most is not None:
        numbered = numbered.filter(F.col("_rn") <= at_most)
    numbered = numbered.withColumn(out, (F.col("_before") + F.col("_rn")).cast("bigint")).drop(
        "_slice", "_before", "_rn"
    )
    return numbered if at_most is None else numbered.filter(F.col(out) <= at_most)


