"""Scores, lists and counts over a findings table. All are partial aggregations per tenant."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareproof.constants import ITEM_PENALTY_CAP_HALF_POINTS
from wareproof.functions.numeric import int_div
from wareproof.functions.text import blank_if_null
from wareproof.operators.registry import checks_table
from wareproof.operators.skew import ranked


def _dim(df: DataFrame) -> DataFrame:
    """The fixed 61-row table of checks, as a broadcast side."""
    return F.broadcast(checks_table(df.sparkSession))


def known_findings(findings: DataFrame) -> DataFrame:
    """Findings of checks that still exist."""
    return findings.join(_dim(findings).select("rule_id"), "rule_id", "left_semi")


def drop_disabled(findings: DataFrame, disabled: DataFrame) -> DataFrame:
    """Findings of checks their tenant has not turned off."""
    return findings.join(disabled, ["tenant", "rule_id"], "left_anti")


def apply_ignores(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """Findings whose key the tenant has not ignored."""
    keys = ignores.select("tenant", F.col("key").alias("finding_key")).distinct()
    return findings.join(keys, ["tenant", "finding_key"], "left_anti")


def ignored_counts(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """(tenant, ignored): how many findings the ignores hide."""
    keys = ignores.select("tenant", F.col("key").alias("finding_key")).distinct()
    hidden = findings.join(keys, ["tenant", "finding_key"], "left_semi")
    return hidden.groupBy("tenant").agg(F.count(F.lit(1)).alias("ignored"))


def cap_findings(findings: DataFrame, at_most: int, slice_width: int | None = None) -> DataFrame:
    """The first ``at_most`` findings of every check in catalog order, for a report; nothing is stored cut.

    Early slices fill the quota, so later ones are dropped by their counts and never sorted.
    """
    order = ["pos", "variant_pos", "finding_key"]
    rows = findings.withColumn("pos", F.coalesce("pos", F.lit(0)))
    return ranked(rows, ["tenant", "rule_id"], order, "_rank", at_most, slice_width).drop("_rank")


# ---- scores --------------------------------------------------------------------------------------

def _half_points(findings: DataFrame) -> DataFrame:
    return findings.select("tenant", "product_id", "rule_id").join(
        _dim(findings).select("rule_id", "half_points", "severity"), "rule_id"
    )


def quality_score(findings: DataFrame, totals: DataFrame) -> DataFrame:
    """(tenant, total, score, clean, open) from findings and (tenant, total).

    Every item loses at most ten points; the score is the rounded average kept on a scale to 100.
    """
    per_item = (
        _half_points(findings)
        .groupBy("tenant", "product_id")
        .agg(F.sum("half_points").alias("_p"), F.count(F.lit(1)).alias("_n"))
    )
    per_tenant = per_item.groupBy("tenant").agg(
        F.sum(F.least(F.col("_p"), F.lit(ITEM_PENALTY_CAP_HALF_POINTS))).alias("_lost"),
        F.count(F.lit(1)).alias("_dirty"),
        F.sum("_n").alias("open"),
    )
    return score_of(totals.join(per_tenant, "tenant", "left").withColumnsRenamed({"_lost": "lost", "_dirty": "dirty"}))


def score_of(sums: DataFrame) -> DataFrame:
    """(tenant, total, score, clean, open) from sums per tenant: total, lost (half points), dirty and open."""
    total = F.col("total").cast("bigint")
    lost = F.coalesce(F.col("lost"), F.lit(0))
    # round(100 - lost / 2 / total * 10) with halves rounded up, in integers
    score = F.when(total > 0, F.greatest(F.lit(0).cast("bigint"), _round_up_half(total * 100 - lost * 5, total)))
    return sums.select(
        "tenant", total.alias("total"),
        F.coalesce(score, F.lit(100).cast("bigint")).alias("score"),
        F.greatest(F.lit(0).cast("bigint"), total - F.coalesce("dirty", F.lit(0))).alias("clean"),
        F.coalesce("open", F.lit(0)).cast("bigint").alias("open"),
    )


def _round_up_half(num: Column, den: Column) -> Column:
    return F.when(num <= 0, F.lit(0).cast("bigint")).otherwise(int_div(num * 2 + den, den * 2))


def rule_counts(findings: DataFrame) -> DataFrame:
    """(tenant, rule_id, count) of known checks."""
    return known_findings(findings).groupBy("tenant", "rule_id").agg(F.count(F.lit(1)).alias("count"))


def failing_rules(findings: DataFrame) -> DataFrame:
    """Failing checks with their present label and severity, worst first."""
    out = rule_counts(findings).join(
        _dim(findings).select("rule_id", "label", "area", "severity", "fixable", "half_points", "check_pos"), "rule_id"
    )
    return out.orderBy("tenant", F.col("half_points").desc(), F.col("count").desc(), "check_pos").select(
        "tenant", "rule_id", "label", "area", "severity", "fixable", "count"
    )


def check_status(
    tenants: DataFrame,
    findings: DataFrame,
    disabled: DataFrame | None = None,
    attribute_rules: DataFrame | None = None,
) -> DataFrame:
    """Every check of every tenant: failed, off, skipped (nothing configured for it) or passed."""
    spark = findings.sparkSession
    ids = [r["rule_id"] for r in _fixed_rows()]
    every = tenants.select("tenant").distinct().withColumn(
        "rule_id", F.explode(F.array(*[F.lit(i) for i in ids]))
    )
    out = every.join(rule_counts(findings), ["tenant", "rule_id"], "left")
    if disabled is None:
        out = out.withColumn("_off", F.lit(False))
    else:
        out = out.join(disabled.withColumn("_off", F.lit(True)), ["tenant", "rule_id"], "left")
    if attribute_rules is None:
        out = out.withColumns({"_required": F.lit(False), "_pattern": F.lit(False)})
    else:
        set_up = attribute_rules.groupBy("tenant").agg(
            F.bool_or(F.coalesce("required", F.lit(False))).alias("_required"),
            F.bool_or(blank_if_null(F.col("pattern")) != "").alias("_pattern"),
        )
        out = out.join(set_up, "tenant", "left")
    idle = ((F.col("rule_id") == "metafield_required") & ~F.coalesce("_required", F.lit(False))) | (
        (F.col("rule_id") == "metafield_pattern") & ~F.coalesce("_pattern", F.lit(False))
    )
    status = (
        F.when(F.col("count") > 0, F.lit("failed"))
        .when(F.coalesce("_off", F.lit(False)), F.lit("off"))
        .when(idle, F.lit("skipped"))
        .otherwise("passed")
    )
    dim = F.broadcast(checks_table(spark)).select("rule_id", "area", "severity", "label")
    return out.select(
        "tenant", "rule_id", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), status.alias("status")
    ).join(dim, "rule_id")


def _fixed_rows() -> list[dict]:
    from wareproof.operators.registry import META

    return list(META.values())


def severity_by_area(findings: DataFrame) -> DataFrame:
    """Counts by area and severity with all subtotals (null means all)."""
    facts = known_findings(findings).select("tenant", "rule_id").join(
        _dim(findings).select("rule_id", "area", "severity"), "rule_id"
    )
    # The cube runs over the few (tenant, rule) counts, not over the findings.
    counted = facts.groupBy("tenant", "area", "severity").agg(F.count(F.lit(1)).alias("_c"))
    return counted.groupingSets(
        [
            [F.col("tenant"), F.col("area"), F.col("severity")], [F.col("tenant"), F.col("area")],
            [F.col("tenant"), F.col("severity")], [F.col("tenant")],
        ],
        "tenant", "area", "severity",
    ).agg(F.sum("_c").alias("count"))


def locked_area_counts(findings: DataFrame, locked: Iterable[str]) -> DataFrame:
    """(tenant, open, locked): all findings, and those in areas the tenant cannot open."""
    areas = list(locked)
    facts = findings.select("tenant", "rule_id").join(_dim(findings).select("rule_id", "area"), "rule_id")
    return facts.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("open"), F.count_if(F.col("area").isin(areas)).alias("locked")
    )


def top_issues(findings: DataFrame, n: int, without_areas: Sequence[str] = ()) -> DataFrame:
    """The checks to start with: by weight times count, then count."""
    counts = rule_counts(findings).join(
        _dim(findings).select("rule_id", "area", "severity", "half_points", "check_pos"), "rule_id"
    )
    if without_areas:
        counts = counts.filter(~F.col("area").isin(list(without_areas)))
    weighted = counts.withColumn("weight", F.col("half_points") * F.col("count"))
    # At most 61 rows per tenant reach this window.
    w = Window.partitionBy("tenant").orderBy(F.col("weight").desc(), F.col("count").desc(), "check_pos")
    return weighted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "tenant", "rank", "rule_id", "area", "severity", "count", "weight"
    )


# ---- search --------------------------------------------------------------------------------------

def search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows where the text occurs, in any case, in one of the columns. A blank query keeps all."""
    q = query.strip().lower()
    if not q:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(blank_if_null(F.col(c))), F.lit(q))
    return df.filter(hit)


def search_findings(findings: DataFrame, rule_id: str, query: str, first: int) -> DataFrame:
    """Page of one check: the first findings that match, in catalog order."""
    found = search(findings.filter(F.col("rule_id") == rule_id), query, ["product_title", "sku", "detail"])
    return found.orderBy("pos", "variant_pos", "finding_key").limit(first)


def current_value() -> Column:
    """What a finding row shows: the edit's current value, else its own, else the detail without the
    variant title in front."""
    prefix = F.concat(F.col("variant_title"), F.lit(": "))
    bare = F.when(
        F.startswith(F.col("detail"), prefix),
        F.substring(F.col("detail"), F.length(prefix) + 1, F.length("detail")),
    ).otherwise(F.col("detail"))
    return F.coalesce(F.col("edit.current"), F.col("current"), bare, F.lit(""))
