"""From nested records or flat tables to the two feature tables the checks read.

``Catalog.items`` has one row per item with facts about its children rolled up, ``Catalog.variants``
one row per variant with facts about its siblings and its item. Records carry their children, so
everything is computed inside the row without a shuffle; flat tables are aggregated and joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wareproof.constants import MIN_IMAGE_PX
from wareproof.functions.numeric import array_median, as_one_number, cents, parse_money, parse_optional_money
from wareproof.functions.text import blank_if_null
from wareproof.operators.rows import median_of_bounds, with_median_bounds
from wareproof.operators.skew import HOT_ROWS, attach_groups, hot_groups
from wareproof.schema import RECORD, VARIANT_FIELDS
from wareproof.sources.lines import read_json_lines

ITEM_BASE = [
    "tenant", "pos", "id", "title", "handle", "status", "created_at", "updated_at", "published_at",
    "total_inventory", "variants_count", "collection_count", "vendor", "product_type", "tags",
    "description_html", "seo_title", "seo_description", "category", "publications",
    "publications_ok", "channel_issues", "options", "meta",
]
ROLLUPS = [
    "n_variants", "only_sku", "any_tracked", "any_continue", "n_media", "n_images", "n_small_images",
    "smallest_px",
]
VARIANT_BASE = [
    "id", "title", "sku", "barcode", "price", "compare_at_price", "cost", "inventory_policy",
    "inventory_quantity", "updated_at", "locations", "tracked", "requires_shipping",
    "inventory_item_id", "weight", "weight_unit",
]
SIBLINGS = ["n_variants", "sib_priced", "sib_median_cents", "donor_weight", "donor_unit"]


@dataclass(frozen=True)
class Catalog:
    """Feature tables of one or many tenants."""

    items: DataFrame
    variants: DataFrame
    memberships: DataFrame  # tenant, product_id, member_pos, collection_id
    # The variants without the facts about their siblings, where leaving these out saves work.
    alone: DataFrame | None = None
    donors: DataFrame | None = None  # beside alone: tenant, product_id, donor_weight, donor_unit

    @property
    def slim_variants(self) -> DataFrame:
        """Variants for those who ask nothing about siblings."""
        return self.variants if self.alone is None else self.alone


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records with the fixed schema; damaged lines come back as null rows, never as failures. A record
    without a ``pos`` takes the place of its line in the order of files and lines."""
    records = read_json_lines(spark, path, RECORD, "_line")
    return records.withColumn("pos", F.coalesce("pos", "_line")).drop("_line")


# ---- normalizing ---------------------------------------------------------------------------------

def _default(c: str, value) -> Column:
    return F.coalesce(F.col(c), F.lit(value)).alias(c)


def _empty_list(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind)).alias(c)


def with_missing_columns(df: DataFrame, schema_ddl: str, spark: SparkSession) -> DataFrame:
    """Columns the input lacks are added as typed nulls."""
    wanted = spark.createDataFrame([], schema_ddl).schema
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted
        ]
    )


def typed_fields(v: Column | Mapping[str, Column]) -> list[Column]:
    """The fields of a variant, typed, with the defaults of an absent value."""
    return [
        v["id"].alias("id"),
        blank_if_null(v["title"]).alias("title"),
        v["sku"].alias("sku"),
        v["barcode"].alias("barcode"),
        parse_money(v["price"]).alias("price"),
        parse_optional_money(v["compare_at_price"]).alias("compare_at_price"),
        parse_optional_money(v["cost"]).alias("cost"),
        v["inventory_policy"].alias("inventory_policy"),
        F.coalesce(v["inventory_quantity"], F.lit(0)).alias("inventory_quantity"),
        v["updated_at"].alias("updated_at"),
        F.coalesce(v["locations"], F.lit(0)).alias("locations"),
        F.coalesce(v["tracked"], F.lit(False)).alias("tracked"),
        F.coalesce(v["requires_shipping"], F.lit(True)).alias("requires_shipping"),
        v["inventory_item_id"].alias("inventory_item_id"),
        F.coalesce(v["weight"], F.lit(0.0)).alias("weight"),
        F.coalesce(v["weight_unit"], F.lit("KILOGRAMS")).alias("weight_unit"),
    ]


def normalize_variant(v: Column) -> Column:
    """Typed variant struct with the defaults of an absent value."""
    return F.struct(*typed_fields(v))


def meta_map(metafields: Column) -> Column:
    """Attribute key to value; of a repeated key the last entry counts."""
    last = F.filter(
        metafields,
        lambda m, i: ~F.exists(F.slice(metafields, i + 2, F.size(metafields)), lambda o: o["key"] == m["key"]),
    )
    return F.map_from_entries(
        F.transform(last, lambda m: F.struct(m["key"].alias("k"), blank_if_null(m["value"]).alias("v")))
    )


def normalize_records(records: DataFrame) -> DataFrame:
    """Nested records with the fixed schema, defaults filled and money typed.

    Without a ``pos`` the order of the rows stands in for the catalog order.
    """
    df = with_missing_columns(records, RECORD, records.sparkSession)
    return df.select(
        _default("tenant", ""),
        F.coalesce(F.col("pos"), F.monotonically_increasing_id()).alias("pos"),
        "id",
        *[_default(c, "") for c in ("title", "handle")],
        "status", "created_at", "updated_at", "published_at",
        _default("total_inventory", 0),
        F.coalesce("variants_count", F.size(_empty_list("variants", df.schema["variants"].dataType.simpleString())), F.lit(0)).alias("variants_count"),
        F.coalesce("collection_count", F.size(_empty_list("collection_ids", "array<string>")), F.lit(0)).alias("collection_count"),
        _empty_list("collection_ids", "array<string>"),
        "vendor", "product_type",
        _empty_list("tags", "array<string>"),
        "description_html",
        *[_default(c, "") for c in ("seo_title", "seo_description")],
        "category", "publications", "publications_ok",
        _empty_list("channel_issues", df.schema["channel_issues"].dataType.simpleString()),
        _empty_list("options", df.schema["options"].dataType.simpleString()),
        _empty_list("metafields", df.schema["metafields"].dataType.simpleString()),
        "media_count",
        _empty_list("images", df.schema["images"].dataType.simpleString()),
        F.transform(
            F.coalesce("variants", F.array().cast(df.schema["variants"].dataType)), normalize_variant
        ).alias("variants"),
    )


# ---- records to feature tables -------------------------------------------------------------------

def _image_px(i: Column) -> Column:
    return F.greatest(i["width"], i["height"])


def from_records(records: DataFrame) -> Catalog:
    """Feature tables from nested records, without a shuffle."""
    r = normalize_records(records)
    small = F.filter(
        F.col("images"),
        lambda i: (i["width"] > 0) & (i["height"] > 0) & (_image_px(i) < MIN_IMAGE_PX),
    )
    v = F.col("variants")
    items = r.select(
        *[c for c in ITEM_BASE if c != "meta"],
        meta_map(F.col("metafields")).alias("meta"),
        F.size(v).alias("n_variants"),
        F.when(F.size(v) == 1, blank_if_null(F.try_element_at(v, F.lit(1))["sku"])).alias("only_sku"),
        F.exists(v, lambda x: x["tracked"]).alias("any_tracked"),
        F.exists(v, lambda x: F.coalesce(x["inventory_policy"] == "CONTINUE", F.lit(False))).alias("any_continue"),
        F.coalesce("media_count", F.size("images")).alias("n_media"),
        F.size("images").alias("n_images"),
        F.size(small).alias("n_small_images"),
        F.array_min(F.transform(small, _image_px)).alias("smallest_px"),
    )
    prices = F.filter(F.transform(v, lambda x: cents(x["price"])), lambda p: p > 0)
    donor = F.try_element_at(F.filter(v, lambda x: x["weight"] > 0), F.lit(1))
    variants = r.select(
        "tenant", "pos", F.col("id").alias("product_id"), F.col("title").alias("product_title"),
        F.col("handle").alias("product_handle"), meta_map(F.col("metafields")).alias("meta"),
        F.size(v).alias("n_variants"),
        F.size(prices).alias("sib_priced"),
        array_median(prices).alias("sib_median_cents"),
        donor["weight"].alias("donor_weight"),
        donor["weight_unit"].alias("donor_unit"),
        F.posexplode_outer(v).alias("variant_pos", "_v"),
    ).filter(F.col("variant_pos").isNotNull()).select(
        "tenant", "pos", "product_id", "product_title", "product_handle", "meta", "variant_pos",
        *SIBLINGS, *[F.col(f"_v.{c}").alias(c) for c in VARIANT_BASE],
    )
    memberships = r.select(
        "tenant", F.col("id").alias("product_id"),
        F.posexplode_outer("collection_ids").alias("member_pos", "collection_id"),
    ).filter(F.col("member_pos").isNotNull())
    return Catalog(items, variants, memberships)


# ---- flat tables to feature tables ---------------------------------------------------------------

_FLAT_ITEM = (
    "tenant string, pos bigint, id string, title string, handle string, status string, "
    "created_at timestamp, updated_at timestamp, published_at timestamp, total_inventory int, "
    "variants_count int, vendor string, product_type string, tags array<string>, "
    "description_html string, seo_title string, seo_description string, "
    "category struct<id: string, name: string, full_name: string, is_leaf: boolean, level: int>, "
    "publications int, publications_ok int, "
    "channel_issues array<struct<app: string, messages: array<string>>>, "
    "options array<struct<id: string, name: string, values: array<string>, value_ids: array<string>>>, "
    "metafields array<struct<key: string, name: string, type: string, value: string>>"
)


def sibling_facts(variants: DataFrame) -> DataFrame:
    """Per item: what its variants say together. Equal prices are counted before anything is sorted,
    so a huge item holds its distinct prices only."""
    group = ["tenant", "product_id"]
    per_price = variants.groupBy(*group, cents(F.col("price")).alias("_price")).agg(
        F.count(F.lit(1)).alias("_c"),
        F.min(F.when(F.col("weight") > 0, F.struct("variant_pos", "weight", "weight_unit"))).alias("_donor"),
    )
    priced = per_price.withColumn("_pc", F.when(F.col("_price") > 0, F.col("_c")).otherwise(0))
    return with_median_bounds(priced, group, "_price", "_pc").groupBy(*group).agg(
        F.sum("_c").cast("int").alias("n_variants"),
        F.sum("_pc").cast("int").alias("sib_priced"),
        median_of_bounds().alias("sib_median_cents"),
        F.min("_donor").alias("_donor"),
    ).select(
        *group, "n_variants", "sib_priced", "sib_median_cents",
        F.col("_donor.weight").alias("donor_weight"), F.col("_donor.weight_unit").alias("donor_unit"),
    )


def item_facts(variants: DataFrame) -> DataFrame:
    """Per item: what its row says about its variants. Nothing is sorted, so tasks add up their rows before a shuffle."""
    return variants.groupBy("tenant", F.col("product_id").alias("id")).agg(
        F.count(F.lit(1)).cast("int").alias("n_variants"),
        F.bool_or("tracked").alias("any_tracked"),
        F.bool_or(F.coalesce(F.col("inventory_policy") == "CONTINUE", F.lit(False))).alias("any_continue"),
        F.when(F.count(F.lit(1)) == 1, blank_if_null(F.min("sku"))).alias("only_sku"),
    )


def donor_facts(variants: DataFrame) -> DataFrame:
    """Per item: the weight of its first variant that has one, of several in one place the least. Tasks keep a row per item and
    unit before a shuffle and sort nothing. Weights in one place and unit are told apart up to 1e12, by millionths."""
    group = ["tenant", "product_id"]
    place = as_one_number(F.col("variant_pos"), F.floor(F.least("weight", F.lit(1e12)) * 1e6))
    per_unit = variants.filter(F.col("weight") > 0).groupBy(*group, "weight_unit").agg(
        F.min(place).alias("_place"), F.min_by("weight", place).alias("weight")
    )
    return per_unit.groupBy(*group).agg(F.min(F.struct("_place", "weight", "weight_unit")).alias("_donor")).select(
        *group, F.col("_donor.weight").alias("donor_weight"), F.col("_donor.weight_unit").alias("donor_unit")
    )


def with_sibling_facts(variants: DataFrame, of_item: DataFrame, spread: Sequence[str], hot_rows: int | None) -> DataFrame:
    """Variants with what their siblings and their item say. An item of at most ``hot_rows`` variants meets in one window, so its
    rows move once; the facts of larger items, at most HOT_GROUPS, are made in ranges of prices and joined in splits."""
    # The item first: a sort compares the start of its first key, and most rows share a tenant.
    group = ["product_id", "tenant"]
    limit = HOT_ROWS if hot_rows is None else hot_rows
    counts = variants.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    hot = F.broadcast(hot_groups(counts, group, "_size", limit).drop("_salts"))
    whole = Window.partitionBy(*group)
    donor = F.min(F.when(F.col("weight") > 0, F.struct("variant_pos", "weight", "weight_unit"))).over(whole)
    priced = F.when(F.col("price") > 0, cents(F.col("price")))
    small = variants.join(hot, group, "left_anti").withColumn("_priced", priced).withColumns({
        "n_variants": F.count(F.lit(1)).over(whole).cast("int"),
        "sib_priced": F.count("_priced").over(whole).cast("int"),
        "sib_median_cents": F.percentile("_priced", F.lit(0.5)).over(whole),
        "_donor": donor,
    }).withColumns({"donor_weight": F.col("_donor.weight"), "donor_unit": F.col("_donor.weight_unit")}).drop("_priced", "_donor")
    # The window has put the variants in place for this join already.
    joined = small.join(of_item.hint("merge"), group)
    large = variants.join(hot, group)
    per_item = of_item.join(sibling_facts(large), group)
    split = attach_groups(large, per_item, group, "n_variants", spread, hot_rows=hot_rows)
    return joined.unionByName(split.select(*joined.columns))


def from_tables(
    items: DataFrame,
    variants: DataFrame,
    media: DataFrame | None = None,
    memberships: DataFrame | None = None,
    spread: Sequence[str] = ("id",),
    hot_rows: int | None = None,
) -> Catalog:
    """Feature tables from one table per level, keyed by (tenant, product_id).

    ``variants`` needs product_id and variant_pos, ``media`` media_type, width and height (a null type
    counts as an image), ``memberships`` collection_id and member_pos. Children of unknown items are
    dropped. An item may own any share of the variants: the join back is split by its size.
    """
    spark = items.sparkSession
    base = with_missing_columns(items, _FLAT_ITEM, spark)
    base = base.select(
        _default("tenant", ""),
        F.coalesce(F.col("pos"), F.monotonically_increasing_id()).alias("pos"),
        "id", *[_default(c, "") for c in ("title", "handle")],
        "status", "created_at", "updated_at", "published_at", _default("total_inventory", 0),
        "variants_count", "vendor", "product_type", _empty_list("tags", "array<string>"),
        "description_html", *[_default(c, "") for c in ("seo_title", "seo_description")],
        "category", "publications", "publications_ok",
        *[_empty_list(c, base.schema[c].dataType.simpleString()) for c in ("channel_issues", "options")],
        meta_map(_empty_list("metafields", base.schema["metafields"].dataType.simpleString())).alias("meta"),
    )
    # A variant of no item is dropped, here already those that name none: they would meet in one group.
    typed = _typed_variants(variants, spark).filter(F.col("product_id").isNotNull())
    out = base.join(item_facts(typed), ["tenant", "id"], "left").withColumns(
        {
            "n_variants": F.coalesce("n_variants", F.lit(0)),
            "any_tracked": F.coalesce("any_tracked", F.lit(False)),
            "any_continue": F.coalesce("any_continue", F.lit(False)),
            "variants_count": F.coalesce("variants_count", "n_variants", F.lit(0)),
        }
    )
    out = _join_media(out, media)
    out = _join_memberships(out, memberships)

    of_item = base.select(
        "tenant", F.col("id").alias("product_id"), "pos", F.col("title").alias("product_title"),
        F.col("handle").alias("product_handle"), "meta",
    )
    # An item owns one row on this side, so Spark splits a large item's variants by itself.
    alone = typed.join(of_item, ["tenant", "product_id"]).select(
        "tenant", "pos", "product_id", "product_title", "product_handle", "meta", "variant_pos", *VARIANT_BASE
    )
    joined = with_sibling_facts(typed, of_item, spread, hot_rows)
    flat_variants = joined.select(
        "tenant", "pos", "product_id", "product_title", "product_handle", "meta", "variant_pos",
        *SIBLINGS, *VARIANT_BASE,
    )
    if memberships is None:
        memberships = spark.createDataFrame(
            [], "tenant string, product_id string, member_pos bigint, collection_id string"
        )
    return Catalog(out.select(*ITEM_BASE, *ROLLUPS), flat_variants, memberships, alone, donor_facts(typed))


def _typed_variants(variants: DataFrame, spark: SparkSession) -> DataFrame:
    ddl = "tenant string, product_id string, variant_pos bigint, " + VARIANT_FIELDS
    v = with_missing_columns(variants, ddl, spark)
    # Columns, not one struct: Spark would make all of its fields for whoever reads one.
    return v.select(
        F.coalesce("tenant", F.lit("")).alias("tenant"), "product_id",
        F.coalesce("variant_pos", F.lit(0)).alias("variant_pos"),
        *typed_fields({c: F.col(c) for c in VARIANT_BASE}),
    )


def _join_media(items: DataFrame, media: DataFrame | None) -> DataFrame:
    if media is None:
        return items.withColumns(
            {"n_media": F.lit(0), "n_images": F.lit(0), "n_small_images": F.lit(0), "smallest_px": F.lit(None).cast("int")}
        )
    is_image = F.coalesce(F.col("media_type") == "IMAGE", F.lit(True))
    px = F.greatest("width", "height")
    small = is_image & (F.col("width") > 0) & (F.col("height") > 0) & (px < MIN_IMAGE_PX)
    facts = media.groupBy("tenant", F.col("product_id").alias("id")).agg(
        F.count(F.lit(1)).cast("int").alias("n_media"),
        F.count_if(is_image).cast("int").alias("n_images"),
        F.count_if(small).cast("int").alias("n_small_images"),
        F.min(F.when(small, px)).cast("int").alias("smallest_px"),
    )
    joined = items.join(facts, ["tenant", "id"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_media", "n_images", "n_small_images")})


def _join_memberships(items: DataFrame, memberships: DataFrame | None) -> DataFrame:
    if memberships is None:
        return items.withColumn("collection_count", F.lit(0))
    counts = memberships.groupBy("tenant", F.col("product_id").alias("id")).agg(
        F.count(F.lit(1)).cast("int").alias("collection_count")
    )
    return items.join(counts, ["tenant", "id"], "left").withColumn(
        "collection_count", F.coalesce("collection_count", F.lit(0))
    )
