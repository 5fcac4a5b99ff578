"""The catalogue of checks as a table, and which of them run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareproof.constants import (
    AREAS, BULK_FIXABLE, CHECKS, DEFAULT_PRESET, PRESET_TIERS, SEVERITY_HALF_POINTS,
)

META = {
    c[0]: dict(zip(("rule_id", "area", "severity", "family", "tier", "grain", "label"), c)) for c in CHECKS
}
RULE_IDS = [c[0] for c in CHECKS]
CATALOG_RULES = [c[0] for c in CHECKS if c[5] == "catalog"]
ROW_RULES = [c[0] for c in CHECKS if c[5] != "catalog"]
SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}

CHECKS_DDL = (
    "rule_id string, area string, severity string, family string, tier string, grain string, "
    "label string, fixable boolean, check_pos int, area_pos int, half_points int"
)


def checks_table(spark: SparkSession) -> DataFrame:
    """One row per check: a fixed table of 61 rows, safe to send to every task."""
    rows = [
        (*c, c[0] in BULK_FIXABLE, i, AREAS.index(c[1]), SEVERITY_HALF_POINTS[c[2]])
        for i, c in enumerate(CHECKS)
    ]
    return spark.createDataFrame(rows, CHECKS_DDL)


def disabled_by_preset(preset: str | None, custom: Iterable[str] = ()) -> list[str]:
    """Check ids a preset turns off; ``custom`` uses the given list, anything else the default."""
    if preset == "custom":
        return [r for r in RULE_IDS if r in set(custom)]
    tiers = PRESET_TIERS.get(preset, PRESET_TIERS[DEFAULT_PRESET])
    return [r for r in RULE_IDS if META[r]["tier"] not in tiers]


def enabled_rules(preset: str | None = None, custom: Iterable[str] = ()) -> list[str]:
    off = set(disabled_by_preset(preset, custom))
    return [r for r in RULE_IDS if r not in off]


def disabled_table(settings: DataFrame) -> DataFrame:
    """(tenant, rule_id) for every check a tenant has off, from (tenant, preset, disabled)."""
    spark = settings.sparkSession
    tiers = spark.createDataFrame(
        [(p, r) for p in PRESET_TIERS for r in disabled_by_preset(p)], "preset string, rule_id string"
    )
    known = F.when(F.col("preset").isin([*PRESET_TIERS, "custom"]), F.col("preset")).otherwise(DEFAULT_PRESET)
    chosen = settings.withColumn("preset", known)
    by_preset = chosen.join(F.broadcast(tiers), "preset").select("tenant", "rule_id")
    by_hand = chosen.filter(F.col("preset") == "custom").select(
        "tenant", F.explode("disabled").alias("rule_id")
    )
    return by_preset.unionByName(by_hand).distinct()


def family_counts(spark: SparkSession, enabled: Iterable[str]) -> DataFrame:
    """Checks on and checks in total per family, in page order."""
    on = F.col("rule_id").isin(list(enabled))
    return (
        checks_table(spark)
        .groupBy("family", "area", "area_pos")
        .agg(F.count_if(on).alias("on"), F.count(F.lit(1)).alias("total"), F.min("check_pos").alias("_p"))
        .orderBy("area_pos", "_p")
        .drop("_p")
    )


def rule_literal(rule_id: Column, key: str) -> Column:
    """Metadata of a check as a CASE over the fixed catalogue."""
    pairs = [x for r in RULE_IDS for x in (F.lit(r), F.lit(META[r][key]))]
    return F.try_element_at(F.create_map(*pairs), rule_id)


