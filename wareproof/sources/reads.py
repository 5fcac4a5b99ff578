"""Reading parts of a catalog: the first items, given items, new items, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.operators.skew import ranked
from wareproof.sources.buckets import ItemTables
from wareproof.sources.records import Catalog


def _subset(catalog: Catalog, items: DataFrame) -> Catalog:
    ids = items.select("tenant", F.col("id").alias("product_id"))
    on = ["tenant", "product_id"]
    alone = None if catalog.alone is None else catalog.alone.join(ids, on, "left_semi")
    return Catalog(
        items, catalog.variants.join(ids, on, "left_semi"), catalog.memberships.join(ids, on, "left_semi"), alone, catalog.donors
    )


def first_items(items: DataFrame, n: int, slice_width: int | None = None) -> DataFrame:
    """The first ``n`` items of every tenant in catalog order."""
    return ranked(items, ["tenant"], ["pos", "id"], "_rank", n, slice_width).drop("_rank")


def limited(catalog: Catalog, n: int) -> tuple[Catalog, DataFrame]:
    """The first ``n`` items, and per tenant the uncut total and whether anything was left out."""
    totals = count_items(catalog.items).select(
        "tenant", F.col("count").alias("catalog_total"), (F.col("count") > n).alias("truncated")
    )
    return _subset(catalog, first_items(catalog.items, n)), totals


def by_ids(catalog: Catalog | ItemTables, ids: DataFrame) -> Catalog:
    """The given items (tenant, product_id). Ids that no longer exist are simply absent. Of tables in buckets only
    those of the given items are read."""
    if isinstance(catalog, ItemTables):
        catalog = catalog.catalog(catalog.numbers(ids))
    wanted = ids.select("tenant", F.col("product_id").alias("id")).distinct()
    return _subset(catalog, catalog.items.join(wanted, ["tenant", "id"], "left_semi"))


def count_items(items: DataFrame, since: Column | None = None) -> DataFrame:
    """(tenant, count), of all items or of those created at or after a second."""
    rows = items if since is None else items.filter(created_since(since))
    return rows.groupBy("tenant").agg(F.count(F.lit(1)).alias("count"))


def created_since(since: Column) -> Column:
    """Created at or after the second ``since`` falls in; plain comparison, so it reaches the scan."""
    return F.col("created_at") >= F.date_trunc("second", since)


def new_ids(items: DataFrame, since: Column) -> DataFrame:
    """(tenant, product_id, created_at) of all items created since."""
    return items.filter(created_since(since)).select("tenant", F.col("id").alias("product_id"), "created_at")


def attribute_value(meta: str, full_key: str) -> Column:
    """One tracked attribute as a column; blank where unset."""
    return F.coalesce(F.try_element_at(F.col(meta), F.lit(full_key)), F.lit(""))
