"""How the plain test tables become catalogs.

Every expression below is SQL that means the same to any engine, so a check can be compared with a
plain SQL statement over the same tables. The tables are very clean, so defects are written into the
values by key arithmetic; every row of every table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareproof.sources.records import Catalog, from_records, from_tables

AS_OF = "timestamp '2001-08-01 00:00:00'"


def tenant_of(key: str) -> str:
    return f"CASE WHEN {key} % 3 = 0 THEN 'north' ELSE 'south' END"


def day(base: str, minus: str) -> str:
    return f"cast(date '{base}' - cast({minus} as int) as timestamp)"


def money(c: str) -> str:
    """Cents to two-decimal text."""
    return f"concat(cast(cast(floor({c} / 1e2) as bigint) as string), '.', lpad(cast({c} % 100 as string), 2, '0'))"


K = "p_partkey"
NAME_TITLE = (
    "upper(substr(p_name, 1, 1)) || substr(p_name, 2, instr(p_name, ' ') - 1) || "
    "upper(substr(p_name, instr(p_name, ' ') + 1, 1)) || substr(p_name, instr(p_name, ' ') + 2)"
)
SLUG = "replace(p_name, ' ', '-')"

# part as items
ITEM = [
    ("tenant", tenant_of(K)),
    ("pos", f"cast({K} as bigint)"),
    ("id", f"cast({K} as string)"),
    ("title", f"CASE WHEN {K} % 53 = 7 THEN upper(p_name) WHEN {K} % 59 = 3 THEN p_name || '!!' "
              f"WHEN {K} % 61 = 5 THEN repeat(p_name || ' and ', 8) || 'more' WHEN {K} % 67 = 9 THEN p_name || ' \U0001F389' "
              f"WHEN {K} % 71 = 11 THEN p_brand || ' ' || p_name || ' ' || p_brand "
              f"WHEN {K} % 73 = 13 THEN p_name || ' coming soon' WHEN {K} % 17 = 1 THEN {NAME_TITLE} ELSE p_name END"),
    ("handle", f"CASE WHEN {K} % 29 = 0 THEN 'copy-of-' || {SLUG} WHEN {K} % 31 = 0 THEN cast({K} as string) "
               f"WHEN {K} % 37 = 0 THEN {SLUG} || '-2' ELSE {SLUG} END"),
    ("status", f"CASE WHEN {K} % 5 = 0 THEN 'DRAFT' WHEN {K} % 5 = 1 THEN 'ARCHIVED' ELSE 'ACTIVE' END"),
    ("created_at", day("2001-07-01", f"{K} % 365")),
    ("updated_at", f"CASE WHEN {K} % 4 = 0 THEN NULL ELSE {day('2001-07-31', f'{K} % 61')} END"),
    ("published_at", f"CASE WHEN {K} % 7 = 0 THEN NULL ELSE {day('2001-06-01', f'{K} % 61')} END"),
    ("total_inventory", "cast(p_size - 25 as int)"),
    ("variants_count", "cast(p_size * 3 as int)"),
    ("collection_count", "cast(p_size % 4 as int)"),
    ("vendor", f"CASE WHEN {K} % 37 = 0 THEN '' WHEN {K} % 41 = 0 THEN upper(p_brand) "
               f"WHEN {K} % 43 = 0 THEN lower(p_brand) ELSE p_brand END"),
    ("product_type", f"CASE WHEN {K} % 19 = 0 THEN ' ' WHEN {K} % 23 = 0 THEN lower(p_type) ELSE p_type END"),
    ("tags_text", f"CASE WHEN {K} % 47 = 0 THEN '' WHEN {K} % 13 = 0 THEN upper(p_name) ELSE p_name END"),
    ("category_id", f"CASE WHEN {K} % 11 = 0 THEN NULL ELSE 'c' || cast(p_size as string) END"),
    ("publications", f"cast(CASE WHEN {K} % 6 = 0 THEN NULL ELSE {K} % 6 - 1 END as int)"),
    ("publications_ok", f"cast(CASE WHEN {K} % 6 = 0 THEN NULL WHEN {K} % 9 = 4 THEN 0 ELSE {K} % 6 - 1 END as int)"),
    ("issue_app", f"CASE WHEN {K} % 79 = 2 THEN 'Market' ELSE NULL END"),
    ("attr_brand", f"CASE WHEN {K} % 83 = 1 THEN ' ' ELSE p_brand END"),
    ("n_images", f"cast({K} % 4 as int)"),
    ("image_px", f"cast(500 + ({K} * 37) % 700 as int)"),
    ("color_a", "p_type"),
    ("color_b", f"CASE WHEN {K} % 97 = 6 THEN lower(p_type) ELSE 'Other' END"),
]

L = "l_partkey"
N = "(l_orderkey * 10 + l_linenumber)"


def _digit(i: int) -> str:
    return f"(cast(floor({N} / 1e{i}) as bigint) % 10)"


CHECK_SUM = " + ".join(f"{_digit(i)} * {3 if i % 2 == 0 else 1}" for i in range(12))

# lineitem as variants, in two steps: whole cents first, then what is built from them
OFFER_CENTS = [
    ("c_price", "cast(round(l_extendedprice * 100) as bigint)"),
    ("c_check", f"(10 - ({CHECK_SUM}) % 10) % 10"),
]
OFFER = [
    ("tenant", tenant_of(L)),
    ("product_id", f"cast({L} as string)"),
    ("variant_pos", "cast(l_orderkey * 8 + l_linenumber as bigint)"),
    ("id", f"concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast({L} as string), '-', cast(l_suppkey as string))"),
    ("title", "CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || ' / ' || l_linestatus ELSE 'Default Title' END"),
    ("sku", "CASE WHEN l_orderkey % 83 = 0 THEN ' ' WHEN l_orderkey % 89 = 0 THEN concat('s', cast(l_orderkey as string), '-', cast(l_linenumber as string)) "
            "ELSE concat('S', cast(l_orderkey as string), '-', cast(l_linenumber as string)) END"),
    ("barcode", f"CASE WHEN {L} % 77 = 0 THEN '' WHEN {L} % 91 = 0 THEN concat(lpad(cast({N} as string), 12, '0'), cast((c_check + 1) % 10 as string)) "
                f"ELSE concat(lpad(cast({N} as string), 12, '0'), cast(c_check as string)) END"),
    ("price", f"CASE WHEN l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 103 = 0 THEN '0' ELSE {money('c_price')} END"),
    ("compare_at_price", "CASE WHEN l_linenumber = 1 THEN " + money("cast(floor(c_price * 9 / 1e1) as bigint)")
     + " WHEN l_linenumber = 2 THEN " + money("c_price * 6") + " WHEN l_linenumber = 3 THEN "
     + money("cast(floor(c_price * 13 / 1e1) as bigint)") + " ELSE NULL END"),
    ("cost", "CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE " + money("cast(floor(c_price * (80 + l_linenumber * 5) / 1e2) as bigint)") + " END"),
    ("inventory_policy", "CASE WHEN l_suppkey % 4 = 0 THEN 'CONTINUE' ELSE 'DENY' END"),
    ("inventory_quantity", "cast(l_quantity as int) - 3"),
    ("updated_at", "cast(l_shipdate as timestamp)"),
    ("locations", "cast(l_linenumber % 3 as int)"),
    ("tracked", "l_returnflag <> 'R'"),
    ("requires_shipping", "l_linestatus = 'O'"),
    ("inventory_item_id", f"CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE concat('i', cast({N} as string)) END"),
    ("weight", f"CASE WHEN {L} % 13 = 0 THEN cast(0 as double) ELSE l_quantity END"),
    ("weight_unit", "CASE WHEN l_orderkey % 10 = 0 THEN 'POUNDS' ELSE 'KILOGRAMS' END"),
]

# documents as items with long descriptions
DOC = [
    ("tenant", "lang"),
    ("pos", "cast(doc_id as bigint)"),
    ("id", "cast(doc_id as string)"),
    ("title", "concat('Document ', cast(doc_id as string))"),
    ("description_html", "CASE WHEN doc_id % 97 = 5 THEN ' ' WHEN doc_id % 89 = 3 THEN concat('<p>document&nbsp;', cast(doc_id as string), '</p>') ELSE text END"),
    ("seo_description", "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN concat(substr(text, 1, 60), '...') "
                        "WHEN doc_id % 13 = 0 THEN substr(text, 1, 200) ELSE concat('About ', cast(doc_id as string)) END"),
]

# pages as items with markup
PAGE = [
    ("tenant", "CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END"),
    ("pos", "cast(page_id as bigint)"),
    ("id", "cast(page_id as string)"),
    ("title", "regexp_extract(html, '<title>([^<]*)</title>', 1)"),
    ("seo_title", "CASE WHEN page_id % 9 = 4 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END"),
    ("description_html", "CASE WHEN page_id % 5 = 1 THEN concat(html, '<a href=\"#\">top</a><a name=x></a>') "
                         "WHEN page_id % 5 = 2 THEN concat(html, '<p> </p>') "
                         "WHEN page_id % 5 = 3 THEN concat(html, ' see https://example.org/x or click here ') ELSE html END"),
]

ATTRIBUTE_RULES = [
    (t, "facts", "brand", "Brand", "single_line_text_field", True, r"^Brand#\d$", "")
    for t in ("north", "south")
] + [("south", "facts", "size", "Size", "number_integer", True, "", "promo")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns])


def as_sql(columns: list[tuple[str, str]], source: str) -> str:
    """The same projection as a SELECT over a table or subquery."""
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns) + f" FROM {source}"


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as nested records."""
    p = table(spark, sf_dir, "part").selectExpr("*", *[f"{e} AS {n}" for n, e in ITEM])
    name_words = F.split("tags_text", " ")
    return p.select(
        "tenant", "pos", "id", "title", "handle", "status", "created_at", "updated_at", "published_at",
        "total_inventory", "variants_count", "collection_count",
        F.transform(F.sequence(F.lit(1), F.col("p_size") % 4), lambda i: F.concat(F.lit("g"), (F.col("p_size") + i).cast("string"))).alias("_ids"),
        "vendor", "product_type",
        F.when(F.col("tags_text") == "", F.array().cast("array<string>")).otherwise(name_words).alias("tags"),
        F.when(F.col("category_id").isNotNull(), F.struct(
            F.col("category_id").alias("id"), F.lit("c").alias("name"), F.lit("c").alias("full_name"),
            F.lit(True).alias("is_leaf"), F.lit(1).alias("level"))).alias("category"),
        "publications", "publications_ok",
        F.when(F.col("issue_app").isNotNull(), F.array(F.struct(
            F.col("issue_app").alias("app"), F.array(F.concat(F.lit("fix "), F.col("id"))).alias("messages")))).alias("channel_issues"),
        F.array(F.struct(
            F.concat(F.lit("o"), F.col("id")).alias("id"), F.lit("Color").alias("name"),
            F.array("color_a", "color_b").alias("values"), F.array(F.lit("v1"), F.lit("v2")).alias("value_ids"))).alias("options"),
        F.array(
            F.struct(F.lit("facts.brand").alias("key"), F.lit("Brand").alias("name"), F.lit("text").alias("type"), F.col("attr_brand").alias("value")),
            F.struct(F.lit("facts.size").alias("key"), F.lit("Size").alias("name"), F.lit("number_integer").alias("type"),
                     F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_size").cast("string")).alias("value")),
        ).alias("metafields"),
        F.transform(
            F.slice(F.sequence(F.lit(1), F.lit(3)), F.lit(1), F.col("n_images")),
            lambda i: F.struct(
                F.concat(F.lit("m"), i.cast("string")).alias("id"), F.lit(None).cast("string").alias("alt"),
                (F.col("image_px") + i * 10).alias("width"), F.lit(400).alias("height")),
        ).alias("images"),
    ).withColumn(
        "collection_ids", F.when(F.col("collection_count") > 0, F.col("_ids")).otherwise(F.array().cast("array<string>"))
    ).drop("_ids")


def part_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """part as a catalog without variants: no shuffle anywhere."""
    return from_records(part_records(spark, sf_dir))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a flat variant table."""
    li = table(spark, sf_dir, "lineitem").selectExpr("*", *[f"{e} AS {n}" for n, e in OFFER_CENTS])
    return shaped(li, OFFER)


def offer_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """part as items and lineitem as their variants."""
    items = part_records(spark, sf_dir)
    memberships = items.select(
        "tenant", F.col("id").alias("product_id"), F.posexplode("collection_ids").alias("member_pos", "collection_id")
    )
    media = items.select("tenant", F.col("id").alias("product_id"), F.explode("images").alias("_m")).select(
        "tenant", "product_id", F.lit("IMAGE").alias("media_type"), "_m.width", "_m.height"
    )
    return from_tables(items, offers(spark, sf_dir), media, memberships)


def doc_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return from_records(shaped(table(spark, sf_dir, "documents"), DOC))


def page_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return from_records(shaped(table(spark, sf_dir, "pages"), PAGE))
