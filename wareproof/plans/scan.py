"""A scan as one plan: features, row findings, catalog findings, ignores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareproof.functions.text import PLAIN_TEXT, plain_text
from wareproof.operators import catalog_checks, item_checks, spelling, summary, variant_checks
from wareproof.operators.generic import required
from wareproof.operators.item_checks import Limits
from wareproof.operators.profile import (
    attribute_facts, catalog_profile, common_vendors, ending_facts, types_by_collection, with_item_profile,
    with_variant_profile,
)
from wareproof.operators.registry import CATALOG_RULES, RULE_IDS
from wareproof.schema import FINDING
from wareproof.sources.records import Catalog

ITEM_PROFILE_RULES = ("missing_vendor", "metafield_required", "metafield_pattern")


@dataclass(frozen=True)
class Context:
    """What the checks need beside the catalog."""

    limits: Limits
    dictionary: DataFrame | None = None  # word, freq
    learned: DataFrame | None = None  # tenant, word
    names: DataFrame | None = None  # tenant, word; stored by an earlier scan
    attribute_rules: DataFrame | None = None
    profile: DataFrame | None = None  # stored by an earlier scan
    types: DataFrame | None = None  # stored by an earlier scan


# Bytes of a row group of stored features. Readers cut files between row groups, so a file that one task wrote is read by many.
ROW_GROUP = 8 << 20


def stored(catalog: Catalog, folder: str) -> Catalog:
    """The feature tables written once below the caller's folder and read back, the plain text of descriptions with them. The branches of a scan then read
    their columns from there instead of deriving all features from the source again, each for itself."""
    def one(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    items = catalog.items
    if PLAIN_TEXT not in items.columns:
        items = items.withColumn(PLAIN_TEXT, plain_text(items))
    return Catalog(
        one(items, "items"), one(catalog.variants, "variants"), one(catalog.memberships, "memberships")
    )


def _union(parts: Sequence[DataFrame], catalog: Catalog) -> DataFrame:
    if not parts:
        return catalog.items.sparkSession.createDataFrame([], FINDING)
    return reduce(DataFrame.unionByName, parts)


def row_findings(catalog: Catalog, ctx: Context, rules: Sequence[str] = RULE_IDS) -> DataFrame:
    """Findings of the enabled row checks. Checks are chosen before the projection is built, so
    the predicates of the others are never evaluated."""
    wanted = [r for r in rules if r not in CATALOG_RULES]
    lim = ctx.limits
    parts = []
    on_items = [r for r in item_checks.ITEM_CHECKS if r in wanted and r not in ITEM_PROFILE_RULES]
    if on_items:
        parts.append(item_checks.item_findings(catalog.items, on_items, lim))
    on_variants = [r for r in variant_checks.VARIANT_CHECKS if r in wanted and r != "price_below_cost"]
    if catalog.donors is not None and [r for r in on_variants if r in variant_checks.SIBLING_RULES] == ["missing_weight"]:
        # Rows are narrowed before the donor of a weight joins them; the siblings themselves do not move.
        light = catalog.slim_variants.filter(variant_checks.lacks_weight()).join(catalog.donors, ["tenant", "product_id"], "left")
        parts.append(variant_checks.variant_findings(light, ["missing_weight"], lim))
        on_variants.remove("missing_weight")
    if on_variants:
        asks = any(r in variant_checks.SIBLING_RULES for r in on_variants)
        parts.append(variant_checks.variant_findings(catalog.variants if asks else catalog.slim_variants, on_variants, lim))
    # Checks that quote the catalog profile: rows are narrowed before the profile joins them.
    if "missing_vendor" in wanted:
        vendors = ctx.profile if ctx.profile is not None else common_vendors(catalog.items)
        blank = with_item_profile(catalog.items.filter(required("vendor")), vendors)
        parts.append(item_checks.item_findings(blank, ["missing_vendor"], lim))
    on_attributes = [r for r in ("metafield_required", "metafield_pattern") if r in wanted]
    attributes = None
    if on_attributes and ctx.attribute_rules is not None:
        attributes = attribute_facts(catalog.items, ctx.attribute_rules)
    elif on_attributes and ctx.profile is not None and "attribute_rules" in ctx.profile.columns:
        attributes = ctx.profile
    if attributes is not None:
        parts.append(item_checks.item_findings(with_item_profile(catalog.items, attributes), on_attributes, lim))
    if "price_below_cost" in wanted:
        endings = ctx.profile if ctx.profile is not None else ending_facts(catalog.slim_variants)
        below = with_variant_profile(catalog.slim_variants.filter("price > 0 and price < cost"), endings)
        parts.append(variant_checks.variant_findings(below, ["price_below_cost"], lim))
    if "missing_product_type" in wanted:
        parts.append(catalog_checks.missing_product_type(catalog, lim, ctx.types))
    if "option_values_inconsistent" in wanted:
        parts.append(catalog_checks.option_values_inconsistent(catalog, lim))
    if "spelling" in wanted and ctx.dictionary is not None:
        trusted = spelling.seed_words(catalog.items, ctx.learned)
        names = ctx.names if ctx.names is not None else spelling.trusted_names(catalog.items, ctx.dictionary)
        parts.append(spelling.spelling(catalog, ctx.dictionary, trusted, names))
    return _union(parts, catalog)


def catalog_findings(catalog: Catalog, ctx: Context, rules: Sequence[str] = RULE_IDS) -> DataFrame:
    """Findings of the enabled whole-catalog checks."""
    parts = [f(catalog, ctx.limits) for r, f in catalog_checks.CATALOG_CHECKS.items() if r in rules]
    return _union(parts, catalog)


def run_checks(catalog: Catalog, ctx: Context, rules: Sequence[str] = RULE_IDS) -> DataFrame:
    """All findings of the enabled checks."""
    return row_findings(catalog, ctx, rules).unionByName(catalog_findings(catalog, ctx, rules))


@dataclass(frozen=True)
class ScanResult:
    """What a scan produces; every part is a DataFrame still to be written or read."""

    findings: DataFrame  # after ignores
    summary: DataFrame  # tenant, total, score, clean, open
    ignored: DataFrame | None
    profile: DataFrame
    types: DataFrame
    names: DataFrame | None
    covered: DataFrame  # tenant, product_id


def scan(
    catalog: Catalog,
    ctx: Context,
    rules: Sequence[str] = RULE_IDS,
    ignores: DataFrame | None = None,
    disabled: DataFrame | None = None,
    folder: str | None = None,
) -> ScanResult:
    """A full scan of every tenant in the catalog. ``disabled`` turns checks off per tenant. With ``folder``, a folder
    all executors share, the source is read and its features are computed once, and so are the findings."""
    if folder is not None:
        catalog = stored(catalog, folder)
    profile = ctx.profile if ctx.profile is not None else catalog_profile(catalog, ctx.attribute_rules)
    types = ctx.types if ctx.types is not None else types_by_collection(catalog.items, catalog.memberships)
    names = ctx.names
    if names is None and ctx.dictionary is not None:
        names = spelling.trusted_names(catalog.items, ctx.dictionary)
    full = Context(ctx.limits, ctx.dictionary, ctx.learned, names, ctx.attribute_rules, profile, types)
    found = run_checks(catalog, full, rules)
    if disabled is not None:
        found = summary.drop_disabled(found, disabled)
    if folder is not None:
        found.write.mode("overwrite").parquet(f"{folder}/findings")
        found = found.sparkSession.read.schema(found.schema).parquet(f"{folder}/findings")
    visible = found if ignores is None else summary.apply_ignores(found, ignores)
    ignored = None if ignores is None else summary.ignored_counts(found, ignores)
    totals = profile.select("tenant", F.col("n_items").alias("total"))
    return ScanResult(
        visible, summary.quality_score(visible, totals), ignored, profile, types,
        names, catalog.items.select("tenant", F.col("id").alias("product_id")),
    )
