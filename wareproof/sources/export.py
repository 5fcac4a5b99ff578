"""The flat JSON-lines export: items and their children on separate lines, in any order.

Children point at their item through ``__parentId``. They stay separate tables, so an item may own
any number of lines; a child without its item is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareproof.schema import EXPORT_LINE
from wareproof.sources.lines import read_json_lines
from wareproof.sources.records import Catalog, from_tables

C = F.col


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Typed lines with their place in the order of files and lines; blank and damaged lines are dropped."""
    placed = read_json_lines(spark, path, EXPORT_LINE, "line")
    return placed.filter(C("id").isNotNull()).withColumn("tenant", F.coalesce("tenant", F.lit("")))


def item_lines(lines: DataFrame) -> DataFrame:
    """One row per item. A repeated id keeps its last line, at the place of its first."""
    items = lines.filter(C("__parentId").isNull())
    last = items.groupBy("tenant", "id").agg(
        F.max_by(F.struct(*[c for c in items.columns if c not in ("tenant", "id", "line")]), "line").alias("_r"),
        F.min("line").alias("pos"),
    )
    r = "_r."
    issues = F.transform(
        F.filter(C(r + "feedback.details"), lambda d: F.coalesce(d["state"] == "REQUIRES_ACTION", F.lit(False))),
        lambda d: F.struct(
            F.when(F.coalesce(d["app"]["title"], F.lit("")) != "", d["app"]["title"]).otherwise("A sales channel").alias("app"),
            F.filter(
                F.transform(F.coalesce(d["messages"], F.array().cast("array<struct<message: string>>")), lambda m: m["message"]),
                lambda m: F.coalesce(m, F.lit("")) != "",
            ).alias("messages"),
        ),
    )
    options = F.transform(
        C(r + "options"),
        lambda o: F.struct(
            o["id"].alias("id"), o["name"].alias("name"),
            F.transform(o["optionValues"], lambda v: v["name"]).alias("values"),
            F.transform(o["optionValues"], lambda v: v["id"]).alias("value_ids"),
        ),
    )
    category = F.when(
        C(r + "category").isNotNull(),
        F.struct(
            C(r + "category.id").alias("id"), C(r + "category.name").alias("name"),
            C(r + "category.fullName").alias("full_name"),
            F.coalesce(C(r + "category.isLeaf"), F.lit(False)).alias("is_leaf"),
            F.coalesce(C(r + "category.level"), F.lit(0)).alias("level"),
        ),
    )
    return last.select(
        "tenant", "pos", "id", C(r + "title").alias("title"), C(r + "handle").alias("handle"),
        C(r + "status").alias("status"), C(r + "createdAt").alias("created_at"),
        C(r + "updatedAt").alias("updated_at"), C(r + "publishedAt").alias("published_at"),
        C(r + "totalInventory").alias("total_inventory"), C(r + "variantsCount.count").alias("variants_count"),
        C(r + "vendor").alias("vendor"), C(r + "productType").alias("product_type"), C(r + "tags").alias("tags"),
        C(r + "descriptionHtml").alias("description_html"), C(r + "seo.title").alias("seo_title"),
        C(r + "seo.description").alias("seo_description"), category.alias("category"),
        C(r + "resourcePublicationsCount.count").alias("publications"),
        C(r + "availablePublicationsCount.count").alias("publications_ok"),
        issues.alias("channel_issues"), options.alias("options"),
    )


def child_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variant, media and membership rows. Any other type of child counts as media.

    Places are line numbers: they order the children of one item, wherever its lines are.
    """
    children = lines.filter(C("__parentId").isNotNull()).withColumnRenamed("__parentId", "product_id")
    kind = F.coalesce(C("__typename"), F.lit(""))
    variants = children.filter(kind == "ProductVariant").select(
        "tenant", "product_id", "line", "id", "title", "sku", "barcode", "price",
        C("compareAtPrice").alias("compare_at_price"), C("inventoryItem.unitCost.amount").alias("cost"),
        C("inventoryPolicy").alias("inventory_policy"), C("inventoryQuantity").alias("inventory_quantity"),
        C("updatedAt").alias("updated_at"), C("inventoryItem.locationsCount.count").alias("locations"),
        C("inventoryItem.tracked").alias("tracked"),
        C("inventoryItem.requiresShipping").alias("requires_shipping"),
        C("inventoryItem.id").alias("inventory_item_id"),
        C("inventoryItem.measurement.weight.value").alias("weight"),
        C("inventoryItem.measurement.weight.unit").alias("weight_unit"),
    )
    named = F.when(kind == "MediaImage", F.lit("IMAGE")).when(kind != "", F.lit("OTHER"))
    media = children.filter(~kind.isin("ProductVariant", "Collection")).select(
        "tenant", "product_id", F.coalesce("mediaContentType", named).alias("media_type"),
        C("image.width").alias("width"), C("image.height").alias("height"),
    )
    memberships = children.filter(kind == "Collection").select(
        "tenant", "product_id", C("line").alias("member_pos"), C("id").alias("collection_id")
    )
    return variants, media, memberships


def read_export(spark: SparkSession, path: str) -> Catalog:
    """Feature tables from an export in one file or several; a later file goes on where the one before ends."""
    lines = read_lines(spark, path)
    variants, media, memberships = child_tables(lines)
    return from_tables(item_lines(lines), variants.withColumnRenamed("line", "variant_pos"), media, memberships)
