"""Bulk corrections: plan, log, apply, undo and list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareproof.functions.text import blank_if_null, js_trim
from wareproof.operators.registry import META
from wareproof.operators.skew import attach_groups
from wareproof.sources.records import Catalog

LOG_DDL = (
    "tenant string, batch_id string, rule_id string, field string, target_id string, product_id string, "
    "title string, before string, after string, undone boolean, created_at timestamp"
)
FIX_NAMES = {"vendor_casing": "Vendor spelling", "compare_at_not_higher": "Sale price cleared"}
C = F.col


def as_json(c: Column) -> Column:
    """A value as JSON text; null becomes the text null."""
    inner = F.to_json(F.struct(c.cast("string").alias("v")), {"ignoreNullFields": "false"})
    return F.substring(inner, F.lit(6), F.length(inner) - 6)


def from_json_text(c: Column) -> Column:
    return F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]


def _flagged(findings: DataFrame, rule_id: str) -> DataFrame:
    """Flagged items with their edit."""
    return (
        findings.filter(C("rule_id") == rule_id)
        .groupBy("tenant", "product_id")
        .agg(F.min("pos").alias("pos"), F.first("edit", ignorenulls=True).alias("_edit"))
    )


def _vendor_rows(flagged: DataFrame, catalog: Catalog) -> DataFrame:
    """What the vendor fix would do to each flagged item that still exists."""
    now = catalog.items.select(
        "tenant", C("id").alias("product_id"), C("title").alias("_title"),
        js_trim(blank_if_null(C("vendor"))).alias("before"),
    )
    wanted = C("_edit.suggested")
    action = (
        F.when(wanted.isNull() | (C("before") == wanted), F.lit("unchanged"))
        .when(C("before") != C("_edit.current"), F.lit("skipped"))
        .otherwise("fixed")
    )
    return flagged.join(now, ["tenant", "product_id"]).select(
        "tenant", "product_id", "pos", F.lit(0).cast("bigint").alias("variant_pos"),
        F.lit("vendor").alias("field"), C("product_id").alias("target_id"), C("_title").alias("title"),
        "before", wanted.alias("after"), action.alias("action"),
    )


def _compare_at_rows(flagged: DataFrame, catalog: Catalog) -> DataFrame:
    """Variants of flagged items whose sale is no reduction right now."""
    now = catalog.variants.select(
        "tenant", "product_id", "product_title", C("id").alias("target_id"), C("title").alias("_t"),
        "variant_pos", "price", "compare_at_price", "n_variants",
    ).filter(C("compare_at_price") <= C("price"))
    sizes = flagged.join(
        now.groupBy("tenant", "product_id").agg(F.count(F.lit(1)).alias("_n")), ["tenant", "product_id"]
    ).select("tenant", "product_id", "pos", "_n")
    rows = attach_groups(now, sizes, ["tenant", "product_id"], "_n", ["target_id"])
    return rows.select(
        "tenant", "product_id", "pos", "variant_pos", F.lit("compareAt").alias("field"), "target_id",
        F.concat("product_title", F.lit(" / "), "_t").alias("title"),
        C("compare_at_price").cast("string").alias("before"), F.lit(None).cast("string").alias("after"),
        F.lit("fixed").alias("action"),
    )


FIXERS = {"vendor_casing": _vendor_rows, "compare_at_not_higher": _compare_at_rows}


def plan_fix(findings: DataFrame, catalog: Catalog, rule_id: str) -> DataFrame:
    """One row per change with ``action``: fixed, skipped (changed since the scan) or unchanged."""
    if rule_id not in FIXERS:
        raise ValueError(f"no bulk fix for {rule_id}")
    return FIXERS[rule_id](_flagged(findings, rule_id), catalog)


def fix_result(plan: DataFrame) -> DataFrame:
    """(tenant, fixed, skipped, unchanged): changes by what becomes of them."""
    return plan.groupBy("tenant").agg(
        *[F.count_if(C("action") == action).alias(action) for action in ("fixed", "skipped", "unchanged")]
    )


def log_entries(plan: DataFrame, rule_id: str, batch_id: str, created_at: Column) -> DataFrame:
    """Before and after of every change that was made, as JSON text."""
    return plan.filter("action = 'fixed'").select(
        "tenant", F.lit(batch_id).alias("batch_id"), F.lit(rule_id).alias("rule_id"), "field", "target_id",
        "product_id", "title", as_json(C("before")).alias("before"), as_json(C("after")).alias("after"),
        F.lit(False).alias("undone"), created_at.alias("created_at"),
    )


def apply_changes(table: DataFrame, entries: DataFrame, key: str, columns: dict[str, str], value: str = "after") -> DataFrame:
    """A table with logged values written over its own.

    ``columns`` maps logged fields to table columns; rows without an entry pass through unchanged. Of several
    entries for a value the newest counts, of equally new ones that of the later batch. To write what a fix wrote
    (``after``), entries that were undone are left out.
    """
    out = table
    valid = entries.filter(~F.coalesce(C("undone"), F.lit(False))) if value == "after" else entries
    for field, column in columns.items():
        new = valid.filter(C("field") == field).groupBy("tenant", C("target_id").alias(key)).agg(
            F.max_by(F.struct(C(value).alias("_v")), F.struct("created_at", "batch_id")).alias("_e")
        ).select("tenant", key, from_json_text(C("_e._v")).alias("_new"), F.lit(True).alias("_hit"))
        kind = table.schema[column].dataType
        out = out.join(new, ["tenant", key], "left").withColumn(
            column, F.when(C("_hit"), C("_new").cast(kind)).otherwise(C(column))
        ).drop("_new", "_hit")
    return out


def current_values(table: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(tenant, target_id, field, now) of the loggable columns."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), C(c).cast("string").alias("now")) for f, c in columns.items()]
    )
    return table.select("tenant", C(key).alias("target_id"), F.explode(pairs).alias("_p")).select(
        "tenant", "target_id", "_p.field", "_p.now"
    )


def plan_undo(
    log: DataFrame, current: DataFrame, tenant: str, batch_id: str, product_id: str | None = None
) -> DataFrame:
    """Entries of a tenant's batch (or one item of it) with ``outcome``: undone where the value is still what
    the fix wrote, stale where it changed or is gone. Both are closed."""
    entries = log.filter((C("tenant") == tenant) & (C("batch_id") == batch_id) & ~C("undone"))
    if product_id is not None:
        entries = entries.filter(C("product_id") == product_id)
    found = current.withColumn("_found", F.lit(True))
    joined = entries.join(found, ["tenant", "target_id", "field"], "left")
    intact = C("_found") & C("now").eqNullSafe(from_json_text(C("after")))
    outcome = F.when(F.coalesce(intact, F.lit(False)), F.lit("undone")).otherwise("stale")
    return joined.withColumn("outcome", outcome).drop("now", "_found")


def close_entries(log: DataFrame, closed: DataFrame) -> DataFrame:
    """The log with the given entries marked undone."""
    key = ["tenant", "batch_id", "field", "target_id"]
    marks = closed.select(*key, F.lit(True).alias("_closed")).distinct()
    return log.join(marks, key, "left").withColumn(
        "undone", C("undone") | F.coalesce("_closed", F.lit(False))
    ).select(*log.columns)


def fix_label(rule_id: Column) -> Column:
    names = {**{r: m["label"] for r, m in META.items()}, **FIX_NAMES, "edit": "Edit"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, rule_id), F.replace(rule_id, F.lit("_"), F.lit(" ")))


def recent_fixes(log: DataFrame, n: int) -> DataFrame:
    """The newest batches still in place, per tenant, with counts and the title of a single item."""
    per_item = log.filter(~C("undone")).groupBy("tenant", "batch_id", "rule_id", "product_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("created_at").alias("_at"), F.max("title").alias("_title")
    )
    batches = per_item.groupBy("tenant", "batch_id", "rule_id").agg(
        F.sum("_n").alias("count"), F.max("_at").alias("at"),
    )
    items = per_item.groupBy("tenant", "batch_id", "product_id").agg(F.max("_title").alias("_title")).groupBy(
        "tenant", "batch_id"
    ).agg(F.count(F.lit(1)).alias("product_count"), F.max("_title").alias("_title"))
    w = Window.partitionBy("tenant").orderBy(C("at").desc(), "batch_id", "rule_id")
    newest = batches.withColumn("rank", F.row_number().over(w)).filter(C("rank") <= n)
    return newest.join(items, ["tenant", "batch_id"]).select(
        "tenant", "rank", "batch_id", "rule_id", fix_label(C("rule_id")).alias("label"), "count", "product_count",
        F.when(C("product_count") == 1, C("_title")).alias("product_title"), "at",
    )


def batch_detail(log: DataFrame, tenant: str, batch_id: str) -> DataFrame:
    """Items of a tenant's batch still in place: changes and the fields they touched, by title."""
    rows = log.filter((C("tenant") == tenant) & (C("batch_id") == batch_id) & ~C("undone"))
    return rows.groupBy("tenant", "product_id").agg(
        F.min_by("title", F.struct("created_at", "target_id")).alias("title"),
        F.count(F.lit(1)).alias("changes"),
        F.array_sort(F.collect_set("field")).alias("fields"),
    ).orderBy("tenant", "title", "product_id")


def fixed_count(log: DataFrame, since: Column | None = None) -> DataFrame:
    """(tenant, fixed): changes in place, ever or since a time."""
    rows = log.filter(~C("undone"))
    if since is not None:
        rows = rows.filter(C("created_at") >= since)
    return rows.groupBy("tenant").agg(F.count(F.lit(1)).alias("fixed"))
