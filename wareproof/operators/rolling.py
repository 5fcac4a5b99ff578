"""Scores and counts that move with the findings that come and go.

A state holds what the sums over all findings need: a row per item with findings, a row per tenant and check, a row per tenant. A refresh
gives signed rows, minus one for a finding that went and plus one for one that came; only the items among them
are looked up, and sums move by the difference. The result is that of summing up all findings anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.constants import ITEM_PENALTY_CAP_HALF_POINTS
from wareproof.operators.registry import checks_table
from wareproof.operators.summary import score_of

C = F.col
KEY = ["tenant", "product_id"]


@dataclass(frozen=True)
class State:
    """Sums over a findings table."""

    items: DataFrame  # tenant, product_id, points (half points), open; items with findings
    rules: DataFrame  # tenant, rule_id, count; checks with findings
    tenants: DataFrame  # tenant, total, lost, dirty, open


def _weighted(findings: DataFrame, sign: Column) -> DataFrame:
    """(tenant, product_id, rule_id, sign, points) of findings of checks that exist."""
    dim = F.broadcast(checks_table(findings.sparkSession)).select("rule_id", "half_points")  # 61 rows
    rows = findings.select(*KEY, "rule_id", sign.cast("bigint").alias("sign")).join(dim, "rule_id")
    return rows.withColumn("points", C("sign") * C("half_points"))


def _lost(points: Column) -> Column:
    return F.least(points, F.lit(ITEM_PENALTY_CAP_HALF_POINTS).cast("bigint"))


def state_of(findings: DataFrame, totals: DataFrame) -> State:
    """The sums over all findings; ``totals`` (tenant, total) has a row for every tenant."""
    rows = _weighted(findings, F.lit(1))
    items = rows.groupBy(*KEY).agg(F.sum("points").alias("points"), F.sum("sign").alias("open"))
    rules = rows.groupBy("tenant", "rule_id").agg(F.sum("sign").alias("count"))
    sums = items.groupBy("tenant").agg(F.sum(_lost(C("points"))).alias("lost"), F.count(F.lit(1)).alias("dirty"), F.sum("open").alias("open"))
    zero = F.lit(0).cast("bigint")
    tenants = totals.join(sums, "tenant", "left").select(
        "tenant", C("total").cast("bigint").alias("total"), *(F.coalesce(c, zero).alias(c) for c in ("lost", "dirty", "open")))
    return State(items, rules, tenants)


def signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tenant, product_id, rule_id, sign, points) of what went and what came, from the findings of the same items
    before and after. Findings of a check that an item keeps are not listed."""
    rows = _weighted(before, F.lit(-1)).unionByName(_weighted(after, F.lit(1)))
    moved = rows.groupBy(*KEY, "rule_id").agg(F.sum("sign").alias("sign"), F.sum("points").alias("points"))
    return moved.filter(C("sign") != 0)


def moved(state: State, changes: DataFrame, coming: DataFrame | None = None) -> State:
    """The state after ``changes`` (``signed``) and items that were added or deleted: ``coming`` (tenant, product_id, change).

    ``state.items`` may hold only the items among the changes, read by their buckets; then the rows that come back are theirs."""
    zero = F.lit(0).cast("bigint")
    delta = changes.groupBy(*KEY).agg(F.sum("points").alias("_p"), F.sum("sign").alias("_n"))
    both = state.items.join(delta, KEY, "full_outer").select(
        *KEY, F.coalesce("points", zero).alias("p0"), F.coalesce("open", zero).alias("n0"), F.coalesce("_p", zero).alias("_p"), F.coalesce("_n", zero).alias("_n"))
    after = both.withColumns({"points": C("p0") + C("_p"), "open": C("n0") + C("_n")})
    rules = state.rules.unionByName(changes.select("tenant", "rule_id", C("sign").alias("count")))
    rules = rules.groupBy("tenant", "rule_id").agg(F.sum("count").alias("count")).filter("count != 0")
    by_tenant = after.filter("_n != 0 OR _p != 0").groupBy("tenant").agg(
        F.sum(_lost(C("points")) - _lost(C("p0"))).alias("_lost"), F.sum("_n").alias("_open"),
        F.sum((C("open") > 0).cast("bigint") - (C("n0") > 0).cast("bigint")).alias("_dirty"))
    tenants = state.tenants.join(by_tenant, "tenant", "left")
    if coming is None:
        tenants = tenants.withColumn("_total", zero)
    else:
        here = coming.groupBy("tenant").agg(F.sum(F.when(C("change") == "added", 1).otherwise(-1)).cast("bigint").alias("_total"))
        tenants = tenants.join(here, "tenant", "left")
    tenants = tenants.select(
        "tenant", F.greatest(zero, C("total") + F.coalesce("_total", zero)).alias("total"),
        *((C(c) + F.coalesce(f"_{c}", zero)).alias(c) for c in ("lost", "dirty", "open")))
    return State(after.filter("open > 0").select(*KEY, "points", "open"), rules, tenants)


def summary_of(state: State) -> DataFrame:
    """(tenant, total, score, clean, open)."""
    return score_of(state.tenants)


def rule_changes(before: State, after: State, rule_id: str | None = None) -> DataFrame:
    """(tenant, rule_id, before, after): counts of every check, or of one, on both sides of a refresh."""
    sides = [s.rules if rule_id is None else s.rules.filter(C("rule_id") == rule_id) for s in (before, after)]
    zero = F.lit(0).cast("bigint")
    joined = sides[0].withColumnRenamed("count", "before").join(sides[1].withColumnRenamed("count", "after"), ["tenant", "rule_id"], "full_outer")
    return joined.select("tenant", "rule_id", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"))
