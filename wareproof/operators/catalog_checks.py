"""Checks that look at the whole catalog: duplicates, majorities and spellings.

Each is an instance of a table operator of ``generic`` plus the wording of its findings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.functions import text as tx
from wareproof.functions.numeric import number_text
from wareproof.operators import generic as g
from wareproof.operators.findings import edit, payload, to_findings
from wareproof.operators.item_checks import Limits, item_keys
from wareproof.operators.profile import collection_type_suggestions, types_by_collection
from wareproof.operators.skew import attach_groups
from wareproof.operators.variant_checks import _stock_edit, _text, _titled, _variant_edit, variant_keys
from wareproof.sources.records import Catalog

C = F.col

# Only the columns a finding needs travel through the shuffles.
ITEM_SLIM = ["tenant", "id", "title", "pos", "only_sku", "n_variants", "meta"]
VARIANT_SLIM = ["tenant", "product_id", "product_title", "pos", "id", "title", "variant_pos", "sku", "meta"]


def _item_rows(items: DataFrame, *extra: str) -> DataFrame:
    return items.select(*ITEM_SLIM, *[c for c in extra if c not in ITEM_SLIM])


def _finish(df: DataFrame, keys: Sequence[Column], made: Column) -> DataFrame:
    return to_findings(df.select(*keys, made.alias("_f")).select("*", "_f.*").drop("_f"))


def _used(value: Column) -> Column:
    return _text(value, " used ", C("group_size").cast("string"), " times")


def duplicate_sku(catalog: Catalog, lim: Limits) -> DataFrame:
    rows = catalog.slim_variants.select(*VARIANT_SLIM).withColumn("_sku", tx.trimmed(tx.blank_if_null(C("sku"))))
    numbered = g.numbered_duplicates(rows, F.upper("_sku"), ["pos", "variant_pos", "id"])
    suffixed = _text(C("_sku"), "-", C("member").cast("string"))
    suggested = F.when(C("member") == 1, C("_sku")).otherwise(suffixed)
    made = payload(
        "duplicate_sku", detail=_titled(_used(C("_sku"))),
        edit=_variant_edit("sku", _used(C("_sku")), suggested, raw=C("_sku"), apply=C("member") > 1),
    )
    return _finish(numbered, variant_keys(), made)


def duplicate_barcode(catalog: Catalog, lim: Limits) -> DataFrame:
    code = tx.trimmed(tx.blank_if_null(C("barcode")))
    rows = catalog.slim_variants.select(*VARIANT_SLIM, "barcode").withColumn("_code", code).filter("_code != ''")
    key = F.upper(tx.without_spaces_and_hyphens(C("_code")))
    groups = g.duplicate_key(rows, key, ["product_id", "id"], min_len=0)
    made = payload(
        "duplicate_barcode", detail=_titled(_used(C("_code"))),
        edit=_variant_edit("barcode", _used(C("_code")), C("_code"), raw=C("_code")),
    )
    return _finish(groups, variant_keys(), made)


def _shared_by(suffix: str = " products") -> Column:
    return _text(C("group_size").cast("string"), suffix)


def duplicate_title(catalog: Catalog, lim: Limits) -> DataFrame:
    groups = g.duplicate_key(_item_rows(catalog.items), tx.norm(C("title")), ["id"], min_len=0)
    current = _text(C("title"), " · ", _shared_by())
    made = payload(
        "duplicate_title", detail=_shared_by(),
        edit=edit("product", field="title", current=current, suggested=C("title"), raw=C("title")),
    )
    return _finish(groups, item_keys(), made)


def duplicate_description(catalog: Catalog, lim: Limits) -> DataFrame:
    rows = catalog.items.select(*ITEM_SLIM, tx.plain_text(catalog.items).alias("_plain"))
    groups = g.duplicate_key(
        rows, F.lower("_plain"), ["id"],
        min_group=lim.min_group_description, min_len=lim.min_chars_description, long_key=True,
    )
    n = C("group_size").cast("string")
    made = payload(
        "duplicate_description", detail=_text("shared by ", n, " products"),
        edit=edit(
            "product", field="descriptionHtml", multiline=True, suggested=C("_plain"), raw=C("_plain"),
            current=_text(tx.first_chars(C("_plain"), 80), " · shared by ", n),
        ),
    )
    return _finish(groups, item_keys(), made)


def seo_title_competing(catalog: Catalog, lim: Limits) -> DataFrame:
    rows = _item_rows(catalog.items, "seo_title")
    groups = g.duplicate_key(rows, tx.norm(C("seo_title")), ["id"])
    suggested = tx.cut_at_word(C("title"), lim.max_seo_title)
    made = payload(
        "seo_title_competing", detail=_shared_by(),
        edit=edit(
            "product", field="seoTitle", current=C("seo_title"), suggested=suggested,
            apply=tx.norm(suggested) != tx.norm(C("seo_title")),
        ),
    )
    return _finish(groups, item_keys(), made)


def title_casing_outlier(catalog: Catalog, lim: Limits) -> DataFrame:
    off = g.majority_style(
        _item_rows(catalog.items), tx.is_title_case(C("title")), ["id"], min_rows=lim.min_rows
    )
    suggested = F.when(C("majority"), tx.to_title_case(C("title"))).otherwise(tx.to_sentence_case(C("title")))
    detail = F.when(C("majority"), F.lit("others are in Title Case")).otherwise("others are in sentence case")
    made = payload(
        "title_casing_outlier", detail=detail,
        edit=edit("product", field="title", current=C("title"), suggested=suggested, apply=suggested != C("title")),
    )
    return _finish(off, item_keys(), made)


def _casing(catalog: Catalog, rule_id: str, column: str, fld: str) -> DataFrame:
    trimmed = tx.trimmed(tx.blank_if_null(C(column)))
    rows = _item_rows(catalog.items, column).withColumn("_raw", trimmed)
    off = g.inconsistent_spelling(rows, "_raw", ["pos"], ["id"])
    made = payload(
        rule_id, detail=F.array_join("spellings", " / "),
        edit=edit("product", field=fld, current=C("_raw"), suggested=C("keep"), apply=True),
    )
    return _finish(off, item_keys(), made)


def vendor_casing(catalog: Catalog, lim: Limits) -> DataFrame:
    return _casing(catalog, "vendor_casing", "vendor", "vendor")


def product_type_casing(catalog: Catalog, lim: Limits) -> DataFrame:
    return _casing(catalog, "product_type_casing", "product_type", "productType")


def tag_casing(catalog: Catalog, lim: Limits) -> DataFrame:
    tags = catalog.items.select("tenant", "id", "pos", F.posexplode("tags").alias("_i", "_tag"))
    groups = g.spelling_groups(tags, "_tag", ["pos", "_i"])
    # Only tags off the kept spelling travel; the items they sit on come back with all their tags.
    changed = attach_groups(
        tags.drop("pos"), groups, ["tenant", "_tag"], "n", ["id"], keep=C("mixed") & (C("keep") != C("_tag"))
    )
    per_item = changed.groupBy("tenant", "id").agg(
        F.map_from_entries(F.collect_list(F.struct("_i", "keep"))).alias("_keep")
    )
    rows = _item_rows(catalog.items, "tags").join(per_item, ["tenant", "id"])
    fixed = F.transform("tags", lambda t, i: F.coalesce(F.try_element_at(C("_keep"), i), t))
    off = F.filter("tags", lambda t, i: F.try_element_at(C("_keep"), i).isNotNull())
    changed_text = F.array_join(off, ", ")
    made = payload(
        "tag_casing", detail=changed_text,
        edit=edit(
            "product", field="tags", current=changed_text, suggested=F.array_join(fixed, ", "),
            raw=F.array_join("tags", ", "), apply=True,
        ),
    )
    return _finish(rows, item_keys(), made)


def weight_units_mixed(catalog: Catalog, lim: Limits) -> DataFrame:
    rows = catalog.slim_variants.select(*VARIANT_SLIM, "weight", "weight_unit", "inventory_item_id")
    off = g.mixed_unit(
        rows, "weight_unit", "weight", ["pos", "variant_pos"], ["product_id", "id"], min_rows=lim.min_rows
    )
    shown = _text(number_text(C("weight")), " ", F.lower("weight_unit"))
    converted = F.round("converted", 2).cast("decimal(18,2)").cast("string")
    made = payload(
        "weight_units_mixed", detail=_titled(shown, F.lit(", usual here: "), F.lower("majority_unit")),
        edit=_stock_edit(
            "weight", shown, converted, raw=number_text(C("weight")), apply=True, unit=C("majority_unit")
        ),
    )
    return _finish(off, variant_keys(), made)


CATALOG_CHECKS = {
    f.__name__: f
    for f in (
        duplicate_sku, duplicate_title, duplicate_description, title_casing_outlier, vendor_casing,
        seo_title_competing, tag_casing, duplicate_barcode, product_type_casing, weight_units_mixed,
    )
}


# ---- item checks that need more than the item ----------------------------------------------------

def missing_product_type(catalog: Catalog, lim: Limits, types: DataFrame | None = None) -> DataFrame:
    """Blank type, with the type most used in the first collection of the item that has one."""
    blank = catalog.items.filter(g.required("product_type"))
    if types is None:
        types = types_by_collection(catalog.items, catalog.memberships)
    suggested = collection_type_suggestions(blank, catalog.memberships, types).withColumnRenamed("product_id", "id")
    rows = _item_rows(blank).join(suggested, ["tenant", "id"], "left")
    value = F.coalesce("common_type", F.lit(""))
    made = payload(
        "missing_product_type",
        edit=edit("product", field="productType", current="", suggested=value, apply=value != ""),
    )
    return _finish(rows, item_keys(), made)


def option_values_inconsistent(catalog: Catalog, lim: Limits) -> DataFrame:
    """Values of one option that share a normalized form, one finding per group.

    The spelling used most in the variant titles is suggested; ties go to the first one listed.
    """
    # A look inside the row first: only items with a collision are exploded and shuffled.
    collides = F.exists(
        "options",
        lambda o: F.size(F.array_distinct(F.transform(o["values"], tx.norm))) < F.size(o["values"]),
    )
    affected = catalog.items.filter(collides)
    values = affected.select(
        "tenant", "id", F.posexplode("options").alias("_o", "_opt")
    ).select(
        "tenant", "id", "_o", C("_opt.name").alias("_option"), C("_opt.id").alias("_option_id"),
        F.posexplode(
            F.transform(
                "_opt.values",
                lambda v, i: F.struct(
                    F.try_element_at(C("_opt.value_ids"), i + 1).alias("id"), v.alias("name")
                ),
            )
        ).alias("_i", "_value"),
    ).withColumn("_norm", tx.norm(C("_value.name")))
    group = ["tenant", "id", "_o", "_norm"]
    colliding = values.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_i").alias("_first"),
        F.first("_option").alias("_option"),
        F.first("_option_id").alias("_option_id"),
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_value"))), lambda x: x["_value"]).alias("_values"),
    ).filter("_n > 1")
    names = colliding.select(*group, F.posexplode("_values.name").alias("_k", "_name"))
    # Title parts of the affected items only, counted before they meet the names.
    parts = (
        catalog.slim_variants.select("tenant", C("product_id").alias("id"), "title")
        .join(colliding.select("tenant", "id").distinct(), ["tenant", "id"], "left_semi")
        .select("tenant", "id", F.explode(F.split("title", " / ")).alias("_name"))
        .groupBy("tenant", "id", "_name").agg(F.count(F.lit(1)).alias("_uses"))
    )
    keep = (
        names.join(parts, ["tenant", "id", "_name"], "left")
        .groupBy(*group)
        .agg(F.max_by("_name", F.struct(F.coalesce("_uses", F.lit(0)), -C("_k"))).alias("_keep"))
    )
    rows = _item_rows(affected).join(colliding.join(keep, group), ["tenant", "id"])
    shown = F.array_join("_values.name", " / ")
    complete = C("_option_id").isNotNull() & F.forall("_values", lambda v: v["id"].isNotNull())
    made = payload(
        "option_values_inconsistent", detail=_text(C("_option"), ": ", shown),
        edit=F.when(
            complete,
            edit(
                "option", target_id=C("_option_id"), values=C("_values"), current=shown, raw=shown,
                suggested=C("_keep"), apply=True, apply_label=_text("Use ", C("_keep")),
            ),
        ),
    )
    return _finish(rows, item_keys(), made)
