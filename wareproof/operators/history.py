"""Snapshots, streaks and trends of saved results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareproof.operators.summary import top_issues


def first_of_day(scans: DataFrame, fix_log: DataFrame | None = None) -> DataFrame:
    """(tenant, date, open, high, fixed): the first saved result of every UTC day."""
    first = scans.groupBy("tenant", F.to_date("created_at").alias("date")).agg(
        F.min_by(F.struct("open", "high", "created_at"), F.struct("created_at", "scan_id")).alias("_s")
    ).select("tenant", "date", "_s.*")
    if fix_log is None:
        return first.drop("created_at").withColumn("fixed", F.lit(0).cast("bigint"))
    # Fixes in place when the day's first result was saved: those of earlier days, counted per day, and
    # those of the day itself up to that time.
    in_place = fix_log.filter(~F.col("undone")).select(
        "tenant", F.col("created_at").alias("at"), F.to_date("created_at").alias("date"))
    same_day = in_place.join(first.select("tenant", "date", "created_at"), ["tenant", "date"]).filter("at <= created_at")
    same_day = same_day.groupBy("tenant", "date").agg(F.count(F.lit(1)).alias("_today"))
    per_day = in_place.groupBy("tenant", "date").agg(F.count(F.lit(1)).alias("_c"))
    days = first.select("tenant", "date", F.lit(0).cast("bigint").alias("_c")).unionByName(per_day)
    days = days.groupBy("tenant", "date").agg(F.sum("_c").alias("_c"))
    # One row per day of a tenant's history.
    w = Window.partitionBy("tenant").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    before = days.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    joined = first.join(before, ["tenant", "date"]).join(same_day, ["tenant", "date"], "left")
    fixed = (F.col("_before") + F.coalesce("_today", F.lit(0))).alias("fixed")
    return joined.select("tenant", "date", "open", "high", fixed)


def clean_streak(snapshots: DataFrame) -> DataFrame:
    """(tenant, days): consecutive days without high severity that end at the latest snapshot."""
    # Row n of an unbroken run lies n days before the day after the latest snapshot. One row per day.
    w = Window.partitionBy("tenant").orderBy(F.col("date").desc())
    latest = F.max("date").over(Window.partitionBy("tenant"))
    numbered = snapshots.withColumn("_rn", F.row_number().over(w))
    marked = numbered.withColumn("_gap", F.datediff(latest, F.col("date")) - F.col("_rn") + 1)
    broken = F.min(
        F.when((F.col("_gap") != 0) | (F.col("high") != 0), F.col("_rn"))
    )
    return marked.groupBy("tenant").agg(
        (F.coalesce(broken, F.count(F.lit(1)) + 1) - 1).cast("bigint").alias("days")
    )


def as_of(snapshots: DataFrame, cutoff: Column) -> DataFrame:
    """The newest snapshot of every tenant on or before a day."""
    facts = [c for c in snapshots.columns if c != "tenant"]
    found = snapshots.filter(F.col("date") <= cutoff).groupBy("tenant").agg(
        F.max_by(F.struct(*facts), "date").alias("_s")
    )
    return found.select("tenant", "_s.*")


def days_before(snapshots: DataFrame, today: Column, days: int) -> DataFrame:
    return as_of(snapshots, F.date_sub(today, days))


def weekly_change(open_counts: DataFrame, snapshots: DataFrame, today: Column) -> DataFrame:
    """(tenant, open, week_ago, change); change is null without a snapshot from a week ago."""
    before = days_before(snapshots, today, 7).select("tenant", F.col("open").alias("week_ago"))
    return open_counts.join(before, "tenant", "left").withColumn("change", F.col("open") - F.col("week_ago"))


def digest(findings: DataFrame, open_counts: DataFrame, snapshots: DataFrame, today: Column, n: int) -> DataFrame:
    """Weekly figures with the checks to start with, one row per tenant."""
    top = top_issues(findings, n).groupBy("tenant").agg(
        F.array_sort(F.collect_list(F.struct("rank", "rule_id", "count"))).alias("top")
    )
    return weekly_change(open_counts, snapshots, today).join(top, "tenant", "left")


def trend(history: DataFrame, n: int) -> DataFrame:
    """Open counts of the last ``n`` full scans with the change from the scan before."""
    newest = Window.partitionBy("tenant").orderBy(F.col("at").desc(), F.col("scan_id").desc())
    in_order = Window.partitionBy("tenant").orderBy("at", "scan_id")
    recent = history.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")
    return recent.withColumn("delta", F.col("open") - F.lag("open").over(in_order))
