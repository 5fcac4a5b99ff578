"""What a catalog as a whole suggests, per tenant, and how it reaches the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareproof.functions import patterns
from wareproof.functions import text as tx
from wareproof.functions.numeric import cents, least_as_one_number
from wareproof.operators.skew import attach_groups
from wareproof.sources.records import Catalog

RULES_TYPE = (
    "array<struct<full_key: string, name: string, type: string, required: boolean, pattern: string, "
    "product_type: string, usable: boolean>>"
)


def ending_facts(variants: DataFrame, min_priced: int = 10, default: str = "99") -> DataFrame:
    """(tenant, n_variants_all, n_priced, price_ending): the most used last two digits of a positive price, of equally used ones
    the one seen first. One pass that counts by ending in hash maps; variants without a price count under none."""
    priced = F.col("price") > 0
    ending = F.when(priced, F.lpad(F.pmod(cents(F.col("price")), F.lit(100)).cast("string"), 2, "0"))
    per_ending = variants.groupBy("tenant", ending.alias("_ending")).agg(
        F.count(F.lit(1)).alias("_c"), least_as_one_number(F.col("pos"), F.col("variant_pos")).alias("_first")
    )
    named = F.col("_ending").isNotNull()
    top = per_ending.groupBy("tenant").agg(
        F.max_by("_ending", F.when(named, F.struct("_c", -F.col("_first")))).alias("_top"),
        F.sum(F.when(named, F.col("_c")).otherwise(0)).alias("n_priced"), F.sum("_c").alias("n_variants_all"),
    )
    return top.select(
        "tenant", "n_variants_all", "n_priced", F.when(F.col("n_priced") >= min_priced, F.col("_top")).otherwise(default).alias("price_ending")
    )


def price_endings(variants: DataFrame, min_priced: int = 10, default: str = "99") -> DataFrame:
    """(tenant, price_ending) of tenants that have a price."""
    return ending_facts(variants.filter(F.col("price") > 0), min_priced, default).select("tenant", "price_ending")


def common_vendors(items: DataFrame, min_items: int = 10, share: tuple[int, int] = (6, 10)) -> DataFrame:
    """(tenant, n_items, common_vendor): the vendor of more than the share of all items, else blank."""
    vendor = tx.trimmed(tx.blank_if_null(F.col("vendor")))
    per_vendor = items.groupBy("tenant", vendor.alias("_vendor")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("pos").alias("_first")
    )
    named = F.col("_vendor") != ""
    top = per_vendor.groupBy("tenant").agg(
        F.sum("_c").alias("n_items"),
        F.max_by(F.when(named, F.col("_vendor")), F.when(named, F.struct("_c", -F.col("_first")))).alias("_top"),
        F.max(F.when(named, F.col("_c"))).alias("_top_c"),
    )
    clear = (F.col("n_items") >= min_items) & (F.col("_top_c") * share[1] > F.col("n_items") * share[0])
    return top.select("tenant", "n_items", F.when(clear, F.col("_top")).otherwise("").alias("common_vendor"))


def types_by_collection(items: DataFrame, memberships: DataFrame, min_items: int = 3) -> DataFrame:
    """(tenant, collection_id, n_members, common_type): the most used type among a collection's items.

    ``common_type`` is null below ``min_items`` items of that type; ``n_members`` counts all members.
    """
    typed = items.select(
        "tenant", F.col("id").alias("product_id"), "pos",
        tx.trimmed(tx.blank_if_null(F.col("product_type"))).alias("_type"),
    )
    # One row per item on the right, so the join key of neither side repeats on both.
    members = memberships.join(typed, ["tenant", "product_id"])
    per_type = members.groupBy("tenant", "collection_id", "_type").agg(
        F.count(F.lit(1)).alias("_c"), F.min("pos").alias("_first")
    )
    named = F.col("_type") != ""
    top = per_type.groupBy("tenant", "collection_id").agg(
        F.sum("_c").alias("n_members"),
        F.max_by(F.when(named, F.col("_type")), F.when(named, F.struct("_c", -F.col("_first")))).alias("_top"),
        F.max(F.when(named, F.col("_c"))).alias("_top_c"),
    )
    return top.select(
        "tenant", "collection_id", "n_members",
        F.when(F.col("_top_c") >= min_items, F.col("_top")).alias("common_type"),
    )


def grouped_attribute_rules(rules: DataFrame) -> DataFrame:
    """One row per tenant with its attribute rules as a list; unusable patterns are marked."""
    pattern = F.coalesce(F.col("pattern"), F.lit(""))
    entry = F.struct(
        F.concat_ws(".", "namespace", "key").alias("full_key"), F.col("name"), F.col("type"),
        F.coalesce("required", F.lit(False)).alias("required"), patterns.to_engine(pattern).alias("pattern"),
        F.coalesce("product_type", F.lit("")).alias("product_type"),
        ((pattern != "") & patterns.problem(pattern).isNull()).alias("usable"),
    )
    return rules.groupBy("tenant").agg(
        F.sort_array(F.collect_list(entry)).cast(RULES_TYPE).alias("attribute_rules")
    )


def catalog_profile(catalog: Catalog, attribute_rules: DataFrame | None = None) -> DataFrame:
    """One row per tenant: n_items, n_variants_all, price_ending, common_vendor, attribute_rules."""
    vendors = common_vendors(catalog.items)
    out = vendors.join(ending_facts(catalog.slim_variants).drop("n_priced"), "tenant", "left").withColumns(
        {
            "price_ending": F.coalesce("price_ending", F.lit("99")),
            "n_variants_all": F.coalesce("n_variants_all", F.lit(0)),
        }
    )
    if attribute_rules is None:
        return out.withColumn("attribute_rules", F.array().cast(RULES_TYPE))
    return out.join(grouped_attribute_rules(attribute_rules), "tenant", "left").withColumn(
        "attribute_rules", F.coalesce("attribute_rules", F.array().cast(RULES_TYPE))
    )


def attribute_facts(items: DataFrame, attribute_rules: DataFrame) -> DataFrame:
    """(tenant, n_items, attribute_rules) of tenants with rules."""
    sizes = items.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_items"))
    return grouped_attribute_rules(attribute_rules).join(sizes, "tenant")


def with_item_profile(items: DataFrame, profile: DataFrame) -> DataFrame:
    """Items with what the profile (or the part of it that is given) says about their tenant."""
    defaults = {"common_vendor": F.lit(""), "attribute_rules": F.array().cast(RULES_TYPE)}
    given = {c: d for c, d in defaults.items() if c in profile.columns}
    joined = attach_groups(items, profile.select("tenant", "n_items", *given), ["tenant"], "n_items", ["id"], how="left")
    return joined.withColumns({c: F.coalesce(c, d) for c, d in given.items()}).drop("n_items")


def with_variant_profile(variants: DataFrame, profile: DataFrame) -> DataFrame:
    """Variants with the price ending of their tenant."""
    facts = profile.select("tenant", "n_variants_all", "price_ending")
    joined = attach_groups(variants, facts, ["tenant"], "n_variants_all", ["product_id", "id"], how="left")
    return joined.withColumn("price_ending", F.coalesce("price_ending", F.lit("99"))).drop("n_variants_all")


def collection_type_suggestions(items: DataFrame, memberships: DataFrame, types: DataFrame) -> DataFrame:
    """(tenant, product_id, common_type) for the given items: the type of the first collection with one."""
    wanted = items.select("tenant", F.col("id").alias("product_id"))
    members = memberships.join(wanted, ["tenant", "product_id"])
    joined = attach_groups(
        members, types, ["tenant", "collection_id"], "n_members", ["product_id"],
        keep=F.col("common_type").isNotNull(),
    )
    return joined.groupBy("tenant", "product_id").agg(F.min_by("common_type", "member_pos").alias("common_type"))


