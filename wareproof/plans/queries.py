"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareproof.operators import (
    fixes, generic, history, incremental, registry, rolling, spelling, summary, validate,
)
from wareproof.operators import profile as prof
from wareproof.operators.item_checks import Limits
from wareproof.operators.rows import exploded_rows
from wareproof.operators.skew import ranked
from wareproof.plans import bindings as b
from wareproof.plans.scan import Context, catalog_findings, row_findings, scan, stored
from wareproof.schema import ATTRIBUTE_RULE
from wareproof.session import configure, scratch_path
from wareproof.sources import export, reads, store
from wareproof.sources.buckets import ItemTables
from wareproof.streaming import changes as ch

C = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_catalogs: dict[tuple, object] = {}


def catalog(spark: SparkSession, sf_dir: str, kind: str):
    """The bound catalog; its lazy plan is built once per session and folder."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _catalogs:
        _catalogs[key] = getattr(b, f"{kind}_catalog")(spark, sf_dir)
    return _catalogs[key]


def features(spark: SparkSession, sf_dir: str, kind: str):
    """The bound catalog with its features written once: for what reads them more than once."""
    return stored(catalog(spark, sf_dir, kind), scratch_path(spark, f"{kind}-features"))


def attribute_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(b.ATTRIBUTE_RULES, ATTRIBUTE_RULE)


def context(spark: SparkSession, **over) -> Context:
    return Context(**{"limits": Limits(as_of=F.expr(b.AS_OF), max_seo_title=over.pop("max_seo_title", 60)), **over})


def shown(findings: DataFrame, *columns: str) -> DataFrame:
    """Columns of a finding as plain text."""
    known = {
        "current": F.coalesce("edit.current", "current"), "suggested": C("edit.suggested"),
        "apply": F.coalesce("edit.apply", F.lit(False)), "raw": C("edit.raw"),
    }
    return findings.select(*[known.get(c, C(c)).alias(c) for c in ("product_id", *columns)])


def query(name: str):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(configure(spark), sf_dir)
        return f

    return add


# ---- the checks ----------------------------------------------------------------------------------

ON_PART = {
    "placeholder_text": ("detail", "current"), "title_all_caps": ("suggested",), "title_too_long": ("detail",),
    "title_formatting": ("suggested", "apply"), "vendor_repeated_in_title": ("suggested",),
    "emoji_in_title": ("suggested",), "handle_junk": ("detail",), "missing_image": ("current",),
    "few_images": ("current",), "small_image": ("detail", "current"), "too_many_variants": ("detail",),
    "draft_stale": ("detail", "current"), "no_collection": ("current",), "not_published": ("current",),
    "unpublished_everywhere": ("current",), "channel_feedback": ("detail", "current"),
    "missing_vendor": ("suggested",), "no_tags": ("current",), "category_missing": ("current",),
    "metafield_required": ("field", "detail"), "metafield_pattern": ("field", "detail", "current"),
    "missing_product_type": ("suggested",), "option_values_inconsistent": ("detail", "suggested"),
}
ON_OFFER = {
    "missing_sku": ("suggested",), "missing_barcode": ("detail",), "barcode_invalid": ("detail",),
    "missing_weight": ("suggested", "apply"), "zero_price": ("suggested",),
    "compare_at_not_higher": ("detail", "current"), "missing_cost": ("detail",),
    "price_below_cost": ("detail", "suggested"), "thin_margin": ("detail",), "deep_discount": ("detail",),
    "stale_sale": ("detail", "current"), "price_outlier": ("detail", "suggested"),
    "negative_inventory": ("detail", "suggested"), "no_location": ("detail",),
}
ON_DOC = {
    "missing_description": ("current",), "short_description": ("detail", "current"),
    "description_too_long": ("detail", "current"), "language_mismatch": ("current",),
    "description_is_title": ("current",), "meta_copies_description": ("current",),
    "meta_description_missing": ("suggested", "apply"), "meta_description_too_long": ("detail", "suggested"),
}
ON_PAGE = {
    "dead_link": ("detail",), "description_junk": ("detail",), "seo_title_missing": ("suggested",),
    "seo_title_too_long": ("detail", "suggested"),
}
CATALOG_ON = {
    "duplicate_sku": ("offer", ("variant_id", "detail", "suggested", "apply")),
    "duplicate_barcode": ("offer", ("variant_id", "detail")),
    "weight_units_mixed": ("offer", ("variant_id", "detail", "suggested")),
    "duplicate_title": ("part", ("detail",)),
    "title_casing_outlier": ("part", ("detail", "suggested", "apply")),
    "vendor_casing": ("part", ("detail", "suggested")),
    "product_type_casing": ("part", ("detail", "suggested")),
    "tag_casing": ("part", ("detail", "suggested")),
    "duplicate_description": ("doc", ("detail", "current")),
    "seo_title_competing": ("page", ("detail", "suggested")),
}


# Checks that try many patterns on every text: worth a pass that cuts the stored texts for many tasks.
MANY_PATTERNS = ("language_mismatch",)


def _row_check(rule: str, kind: str, columns: tuple[str, ...], **over) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        if kind == "offer":
            columns_out = ("variant_id", *columns)
        else:
            columns_out = columns
        if rule.startswith("metafield"):
            extra = {"attribute_rules": attribute_rules(spark)}
        else:
            extra = {}
        made = (features if rule in MANY_PATTERNS else catalog)(spark, sf_dir, kind)
        return shown(row_findings(made, context(spark, **over, **extra), [rule]), *columns_out)

    return run


def _catalog_check(rule: str, kind: str, columns: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = (features if kind in ("doc", "page") else catalog)(spark, sf_dir, kind)
        return shown(catalog_findings(made, context(spark), [rule]), *columns)

    return run


for _rule, _cols in ON_PART.items():
    QUERIES[f"check_{_rule}"] = _row_check(_rule, "part", _cols)
for _rule, _cols in ON_OFFER.items():
    QUERIES[f"check_{_rule}"] = _row_check(_rule, "offer", _cols)
for _rule, _cols in ON_DOC.items():
    QUERIES[f"check_{_rule}"] = _row_check(_rule, "doc", _cols)
for _rule, _cols in ON_PAGE.items():
    QUERIES[f"check_{_rule}"] = _row_check(_rule, "page", _cols, max_seo_title=50)
for _rule, (_kind, _cols) in CATALOG_ON.items():
    QUERIES[f"check_{_rule}"] = _catalog_check(_rule, _kind, _cols)


@query("suite_row_findings")
def _(spark, sf_dir):
    ctx = context(spark, attribute_rules=attribute_rules(spark))
    found = row_findings(catalog(spark, sf_dir, "part"), ctx, list(ON_PART))
    return found.groupBy("tenant", "rule_id", "area", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("suite_variant_findings")
def _(spark, sf_dir):
    found = row_findings(catalog(spark, sf_dir, "offer"), context(spark), list(ON_OFFER))
    return found.groupBy("tenant", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("product_id").alias("items")
    )


@query("peer_outlier_by_part")
def _(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("amount")
    )
    out = generic.peer_outlier(li, "amount", ["l_partkey"], ["l_orderkey", "l_linenumber"])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "amount", "peers", F.col("median").cast("double").alias("median"))


# ---- parametric checks on plain tables -----------------------------------------------------------

@query("contains_any_of")
def _(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    return docs.filter(generic.contains_any(["text", "source"], ["license", "copyright", "src1"])).select("doc_id")


@query("pattern_violations")
def _(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", generic.pattern_violation("p_brand", "^Brand#[0-4]", negate=True).alias("brand_off"),
        generic.pattern_violation("p_name", "(?i)ring").alias("name_hit"),
    )


@query("any_long_line")
def _(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    return docs.filter(generic.any_item(F.split("text", "\n"), lambda line: F.length(line) > 400)).select("doc_id")


@query("learned_word_list")
def _(spark, sf_dir):
    """Words learned from benchmark items, without those taught by every second one."""
    items = b.table(spark, sf_dir, "benchmark").select("item_id", F.explode(spelling.words_of(C("text"))).alias("word"))
    words = items.select("item_id", F.lit("all").alias("tenant"), F.lower("word").alias("word"))
    known = incremental.learn_words(spark.createDataFrame([], "tenant string, word string"), words)
    return incremental.list_words(incremental.forget_words(known, words.filter("item_id % 2 = 0")))


@query("result_by_id")
def _(spark, sf_dir):
    newest = event_scans(spark, sf_dir).filter("tenant = 't1'").agg(F.max("scan_id")).first()[0]
    return store.by_id(event_scans(spark, sf_dir), "t1", newest or 0).select("tenant", "scan_id", "total", "open")


# ---- spelling ------------------------------------------------------------------------------------

def dictionary(spark: SparkSession, sf_dir: str, min_docs: int = 5) -> DataFrame:
    """Lower-case words of at least four letters that enough English documents use."""
    docs = b.table(spark, sf_dir, "documents").filter("lang = 'en'")
    words = F.array_distinct(spelling.long_words_of(F.lower("text")))
    return (
        exploded_rows(docs, ["doc_id"], words, "word")
        .groupBy("word").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= min_docs)
    )


@query("check_spelling")
def _(spark, sf_dir):
    found = spelling.misspellings(features(spark, sf_dir, "doc").items, dictionary(spark, sf_dir), with_suggestions=False)
    return found.select(C("id").alias("product_id"), "word", "field")


@query("spelling_suggestions")
def _(spark, sf_dir):
    known = store.materialize(dictionary(spark, sf_dir), "dictionary")
    words = spelling.unknown_words(catalog(spark, sf_dir, "page").items, known).select("lower").distinct()
    return spelling.suggestions(words, known)


@query("trusted_names")
def _(spark, sf_dir):
    return spelling.trusted_names(catalog(spark, sf_dir, "page").items, dictionary(spark, sf_dir))


@query("seed_words")
def _(spark, sf_dir):
    learned = b.table(spark, sf_dir, "part").selectExpr(f"{b.tenant_of('p_partkey')} AS tenant", "p_type AS word").distinct()
    return spelling.seed_words(catalog(spark, sf_dir, "part").items, learned)


# ---- reads ---------------------------------------------------------------------------------------

@query("normalize_item")
def _(spark, sf_dir):
    items = catalog(spark, sf_dir, "part").items
    return items.select(
        "tenant", C("id").alias("product_id"), "title", "handle", "total_inventory", "variants_count",
        "collection_count", F.size("tags").alias("n_tags"), "n_media", "n_small_images", "publications",
        F.coalesce("only_sku", F.lit("-")).alias("only_sku"), C("meta")["facts.size"].alias("size_value"),
    )


@query("normalize_variant")
def _(spark, sf_dir):
    v = catalog(spark, sf_dir, "offer").variants
    return v.select(
        "tenant", "product_id", C("id").alias("variant_id"), C("price").cast("string").alias("price"),
        C("compare_at_price").cast("string").alias("compare_at"), C("cost").cast("string").alias("cost"),
        "n_variants", "sib_priced", C("sib_median_cents").cast("double").alias("median"),
    )


@query("jsonl_rebuild")
def _(spark, sf_dir):
    """Items and variants written as an export of several files and read back. A quarter of the items stands in an earlier file
    too, in an older version and in reverse order: the later line counts, at the place of the first."""
    items = b.part_records(spark, sf_dir)
    parents = items.select(
        "tenant", "id", "title", "handle", C("total_inventory").alias("totalInventory"), "vendor", "tags",
        F.struct(C("variants_count").alias("count")).alias("variantsCount"), "pos",
    )
    children = b.offers(spark, sf_dir).select(
        "tenant", "id", C("product_id").alias("__parentId"), F.lit("ProductVariant").alias("__typename"), "title", "sku",
        "price", C("inventory_quantity").alias("inventoryQuantity"),
    )
    media = items.select("tenant", C("id").alias("__parentId"), F.explode("images").alias("_m")).select(
        "tenant", F.concat_ws("-", "__parentId", "_m.id").alias("id"), "__parentId", F.lit("MediaImage").alias("__typename"),
        F.struct(C("_m.width").alias("width"), C("_m.height").alias("height")).alias("image"),
    )
    older = parents.filter("pos % 4 = 0").withColumns({"title": F.concat(F.lit("old "), "title"), "vendor": F.lit("nobody")})
    path = scratch_path(spark, "export")
    older.orderBy(C("pos").desc()).drop("pos").write.json(f"{path}/1")
    children.unionByName(media, allowMissingColumns=True).write.json(f"{path}/2")
    parents.orderBy("pos").drop("pos").write.json(f"{path}/3")
    rebuilt = export.read_export(spark, f"{path}/*")
    placed = store.materialize(rebuilt.items.select(
        "tenant", "pos", "id", "title", "vendor", "n_variants", "n_media", "n_small_images", F.size("tags").alias("n_tags"), "any_tracked",
    ), "rebuilt")
    return ranked(placed, ["tenant"], ["pos", "id"], "place").drop("pos").withColumnRenamed("id", "product_id")


@query("scan_limit")
def _(spark, sf_dir):
    limited, totals = reads.limited(catalog(spark, sf_dir, "part"), 100)
    return limited.items.select("tenant", C("id").alias("product_id")).join(totals, "tenant")


@query("read_by_ids")
def _(spark, sf_dir):
    wanted = b.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").selectExpr(
        f"{b.tenant_of('l_partkey')} AS tenant", "cast(l_partkey as string) AS product_id"
    )
    part = reads.by_ids(catalog(spark, sf_dir, "part"), wanted)
    return part.items.select("tenant", C("id").alias("product_id"), "title")


@query("read_new_since")
def _(spark, sf_dir):
    found = reads.new_ids(catalog(spark, sf_dir, "part").items, F.lit("2001-03-01 00:00:00.5").cast("timestamp"))
    return found.select("tenant", "product_id")


@query("count_since")
def _(spark, sf_dir):
    return reads.count_items(catalog(spark, sf_dir, "part").items, F.lit("2001-03-01").cast("timestamp"))


@query("tracked_attribute")
def _(spark, sf_dir):
    items = catalog(spark, sf_dir, "part").items
    return items.select(C("id").alias("product_id"), reads.attribute_value("meta", "facts.brand").alias("brand"), reads.attribute_value("meta", "facts.none").alias("none"))


# ---- profile -------------------------------------------------------------------------------------

@query("profile_price_ending")
def _(spark, sf_dir):
    return prof.price_endings(catalog(spark, sf_dir, "offer").slim_variants)


@query("profile_common_vendor")
def _(spark, sf_dir):
    return prof.common_vendors(catalog(spark, sf_dir, "part").items, share=(2, 100))


@query("profile_type_by_group")
def _(spark, sf_dir):
    c = catalog(spark, sf_dir, "part")
    return prof.types_by_collection(c.items, c.memberships)


# ---- summaries -----------------------------------------------------------------------------------

BASE_RULES = [
    "missing_vendor", "no_tags", "no_collection", "category_missing", "handle_junk", "title_too_long",
    "title_all_caps", "missing_image", "few_images", "unpublished_everywhere",
]


def base_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_findings(catalog(spark, sf_dir, "part"), context(spark), BASE_RULES)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.count_items(catalog(spark, sf_dir, "part").items).withColumnRenamed("count", "total")


def ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignores kept for the items of one brand."""
    p = b.table(spark, sf_dir, "part").filter("p_brand = 'Brand#7'")
    return p.selectExpr(
        f"{b.tenant_of('p_partkey')} AS tenant", "concat('few_images|', cast(p_partkey as string), '||') AS key",
        "cast(p_partkey as string) AS product_id",
    )


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("north", "custom", ["few_images", "no_tags"]), ("south", "essential", [])],
        "tenant string, preset string, disabled array<string>",
    )


@query("enabled_checks_preset")
def _(spark, sf_dir):
    off = registry.disabled_table(settings(spark))
    return summary.drop_disabled(base_findings(spark, sf_dir), off).groupBy("tenant", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("cap_findings")
def _(spark, sf_dir):
    return shown(summary.cap_findings(base_findings(spark, sf_dir), 100), "tenant", "rule_id")


@query("apply_ignores")
def _(spark, sf_dir):
    left = summary.apply_ignores(base_findings(spark, sf_dir), ignores(spark, sf_dir))
    return shown(left, "rule_id")


@query("ignored_counts")
def _(spark, sf_dir):
    return summary.ignored_counts(base_findings(spark, sf_dir), ignores(spark, sf_dir))


@query("quality_score")
def _(spark, sf_dir):
    return summary.quality_score(base_findings(spark, sf_dir), totals(spark, sf_dir))


@query("failing_rules")
def _(spark, sf_dir):
    return summary.failing_rules(base_findings(spark, sf_dir)).drop("label")


@query("check_status")
def _(spark, sf_dir):
    off = registry.disabled_table(settings(spark))
    items = catalog(spark, sf_dir, "part").items
    found = summary.drop_disabled(base_findings(spark, sf_dir), off)
    return summary.check_status(items.select("tenant"), found, off).select("tenant", "rule_id", "count", "status")


@query("severity_by_area_cube")
def _(spark, sf_dir):
    return summary.severity_by_area(base_findings(spark, sf_dir))


@query("locked_area_counts")
def _(spark, sf_dir):
    return summary.locked_area_counts(base_findings(spark, sf_dir), ["media", "seo"])


@query("top_issues")
def _(spark, sf_dir):
    return summary.top_issues(base_findings(spark, sf_dir), 5, without_areas=["seo"])


@query("search_findings")
def _(spark, sf_dir):
    return shown(summary.search_findings(base_findings(spark, sf_dir), "few_images", "RING", 100), "product_title")


@query("finding_current_value")
def _(spark, sf_dir):
    found = row_findings(catalog(spark, sf_dir, "offer"), context(spark), ["negative_inventory", "no_location", "missing_sku"])
    return found.select("rule_id", "variant_id", summary.current_value().alias("value"))


@query("family_counts")
def _(spark, sf_dir):
    """Findings per family beside the checks it has on."""
    on = [r for r in registry.RULE_IDS if r in BASE_RULES]
    dim = registry.checks_table(spark).select("rule_id", "family")
    counts = base_findings(spark, sf_dir).join(F.broadcast(dim), "rule_id").groupBy("family").agg(F.count(F.lit(1)).alias("findings"))
    return registry.family_counts(spark, on).join(counts, "family").select("family", "area", "on", "total", "findings")


# ---- incremental ---------------------------------------------------------------------------------

def _tables(spark: SparkSession, sf_dir: str) -> ItemTables:
    """The features of the parts, written once in buckets of items."""
    return ItemTables(spark, scratch_path(spark, "tables"), 16).store(catalog(spark, sf_dir, "part"))


def _stored(spark: SparkSession, sf_dir: str, tables: ItemTables | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and covered ids of an older scan: one item in ten was not there yet, and two items
    that are gone by now were."""
    part = catalog(spark, sf_dir, "part") if tables is None else tables.catalog()
    base = row_findings(part, context(spark), BASE_RULES).filter("pos % 10 <> 0").withColumn("detail", F.concat(F.lit("old "), F.coalesce("detail", F.lit(""))))
    twin = catalog_findings(part, context(spark), ["vendor_casing"]).filter("pos % 10 <> 0")
    gone = base.filter("rule_id = 'few_images'").withColumn("product_id", F.concat(F.lit("x"), "product_id"))
    covered = part.items.filter("pos % 10 <> 0").select("tenant", C("id").alias("product_id"))
    return base.unionByName(twin).unionByName(gone), covered.unionByName(gone.select("tenant", "product_id"))


def _stored_tables(spark: SparkSession, sf_dir: str) -> tuple[ItemTables, DataFrame]:
    """``_stored`` with the findings, written in the same buckets, and the covered ids."""
    tables = _tables(spark, sf_dir)
    findings, covered = _stored(spark, sf_dir, tables)
    tables.write("findings", findings)
    return tables, store.materialize(covered, "covered")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to recheck: everything of one brand, new or known, and everything that is gone."""
    p = b.table(spark, sf_dir, "part").filter("p_brand = 'Brand#7' or p_partkey % 41 = 0").selectExpr(
        f"{b.tenant_of('p_partkey')} AS tenant", "cast(p_partkey as string) AS product_id"
    )
    return p.unionByName(p.select("tenant", F.concat(F.lit("x"), "product_id").alias("product_id")))


@query("recheck_merge")
def _(spark, sf_dir):
    tables, covered = _stored_tables(spark, sf_dir)
    r = incremental.recheck(
        tables, store.materialize(_asked(spark, sf_dir), "asked"), tables.read("findings"), covered, context(spark), BASE_RULES,
        folder=scratch_path(spark, "touched"),
    )
    return shown(r.findings, "rule_id", "detail")


def _refreshed(spark: SparkSession, sf_dir: str, asked: DataFrame, acted_on: str | None = None) -> tuple[rolling.State, rolling.State]:
    """The sums before and after a recheck that reads only the buckets of the items asked for."""
    tables, covered = _stored_tables(spark, sf_dir)
    held = covered.groupBy("tenant").agg(F.count(F.lit(1)).alias("total"))
    before = rolling.state_of(tables.read("findings"), held)
    tables.write("item_sums", before.items)
    before = rolling.State(before.items, store.materialize(before.rules, "rules"), store.materialize(before.tenants, "tenants"))
    _, after = incremental.refreshed(
        tables, store.materialize(asked, "asked"), covered, context(spark), before, BASE_RULES, acted_on=acted_on, folder=scratch_path(spark, "touched"))
    return before, after


@query("recheck_summary")
def _(spark, sf_dir):
    """Totals, scores and counts after a recheck, moved from those before by what came and went."""
    return rolling.summary_of(_refreshed(spark, sf_dir, _asked(spark, sf_dir))[1])


@query("recheck_rule_counts")
def _(spark, sf_dir):
    return rolling.rule_changes(*_refreshed(spark, sf_dir, _asked(spark, sf_dir)))


@query("refresh_check_counts")
def _(spark, sf_dir):
    """One check refreshed: the items it lists are looked at again; its counts before and after."""
    listed = store.materialize(incremental.items_of_check(_stored(spark, sf_dir)[0], "few_images"), "listed")
    return rolling.rule_changes(*_refreshed(spark, sf_dir, listed, "few_images"), "few_images")


@query("added_deleted")
def _(spark, sf_dir):
    _, covered = _stored(spark, sf_dir)
    present = catalog(spark, sf_dir, "part").items.select("tenant", C("id").alias("product_id"))
    return incremental.added_deleted(_asked(spark, sf_dir), covered, present)


@query("scan_new_merge")
def _(spark, sf_dir):
    findings, covered = _stored(spark, sf_dir)
    r = incremental.scan_new(
        catalog(spark, sf_dir, "part"), F.lit("2001-03-01").cast("timestamp"), findings, covered, context(spark), BASE_RULES
    )
    return shown(r.findings, "rule_id", "detail")


@query("drop_disabled")
def _(spark, sf_dir):
    rules = attribute_rules(spark)
    ctx = context(spark, attribute_rules=rules)
    found = row_findings(catalog(spark, sf_dir, "part"), ctx, ["metafield_required", "metafield_pattern", "no_tags"])
    changed = rules.withColumn("pattern", F.when(C("tenant") == "north", F.lit("")).otherwise(C("pattern")))
    off = registry.disabled_table(settings(spark))
    return shown(incremental.apply_settings(found, off, changed), "rule_id", "field")


@query("learn_word")
def _(spark, sf_dir):
    found = spelling.misspellings(catalog(spark, sf_dir, "doc").items, dictionary(spark, sf_dir), with_suggestions=False).select(
        "tenant", C("id").alias("product_id"), F.lit("spelling").alias("rule_id"), "word"
    )
    learned = b.table(spark, sf_dir, "benchmark").select(F.explode(spelling.words_of(C("text"))).alias("word")).select(F.lit("en").alias("tenant"), "word")
    known = incremental.learn_words(spark.createDataFrame([], "tenant string, word string"), learned)
    return incremental.drop_learned(found, known).select("product_id", "word")


@query("mark_saved")
def _(spark, sf_dir):
    found = base_findings(spark, sf_dir)
    marks = ignores(spark, sf_dir).select(
        "tenant", C("key").alias("finding_key"),
        F.struct(F.lit("b1").alias("batch_id"), C("product_id").alias("value"), F.expr(b.AS_OF).alias("at"), F.lit(True).alias("quick")).alias("saved"),
    )
    out = incremental.mark_saved(found, marks)
    return out.groupBy("tenant", "rule_id").agg(F.count("saved").alias("marked"), F.count(F.lit(1)).alias("n"))


@query("ignore_and_unignore")
def _(spark, sf_dir):
    """Ignores of a brand, some taken back: what stays hidden and what must be rechecked."""
    all_ignores = incremental.upsert_ignores(ignores(spark, sf_dir), ignores(spark, sf_dir))
    stay, items = incremental.unignore(all_ignores, all_ignores.filter("tenant = 'north'"))
    hidden = stay.select("tenant", "product_id", F.lit("hidden").alias("state"))
    return hidden.unionByName(items.withColumn("state", F.lit("recheck")))


@query("attribute_rule_upsert")
def _(spark, sf_dir):
    """Rules per brand, changed from the brands of the parts; one tenant sends a bad pattern."""
    p = b.table(spark, sf_dir, "part").selectExpr(f"{b.tenant_of('p_partkey')} AS tenant", "p_brand", "p_type")
    rules = p.groupBy("tenant", C("p_brand").alias("key")).agg(F.count(F.lit(1)).alias("_n")).select(
        "tenant", F.lit("brand").alias("namespace"), "key", C("key").alias("name"), F.lit("text").alias("type"),
        F.lit(True).alias("required"), F.lit("").alias("pattern"), F.lit("").alias("product_type"),
    )
    change = p.groupBy("tenant", C("p_type").alias("key")).agg(F.count(F.lit(1)).alias("_n")).select(
        "tenant", F.lit("brand").alias("namespace"),
        F.when(C("key") == "PROMO", F.lit("Brand#3")).otherwise(C("key")).alias("key"), C("key").alias("name"),
        F.lit("text").alias("type"), F.lit(False).alias("required"),
        F.when((C("tenant") == "north") & (C("key") == "SMALL"), F.lit("(a+)+")).otherwise("^a$").alias("pattern"),
        F.lit("").alias("product_type"),
    )
    return incremental.upsert_attribute_rules(rules, change).select("tenant", "namespace", "key", "name", "required", "pattern")


# ---- events: queue, history ----------------------------------------------------------------------

def event_changes(events: DataFrame) -> DataFrame:
    """events as item changes; ids beyond the known ones are new or unknown."""
    return events.selectExpr(
        f"{b.tenant_of('user_id')} AS tenant", "cast(user_id as string) AS product_id",
        "event_type = 'purchase' AS created", "cast(ts as timestamp) AS at", "event_id",
    )


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of four micro-batches, each of so many files as Spark deals a part of the events to. The last part
    repeats events of the first, and files hold events of all times, so most of a later batch is late."""
    events = b.table(spark, sf_dir, "events")
    path = scratch_path(spark, "events")
    dealt = events.withColumn("file", C("event_id") % 3).unionByName(events.filter("event_id % 3 = 0").withColumn("file", F.lit(3).cast("bigint")))
    dealt.hint("rebalance", "file").write.partitionBy("file").parquet(path)
    # Spark splits large parts into more files. A batch takes more of them then: more batches would each go over all items.
    files = len(spark.read.schema(events.schema).parquet(path).inputFiles())
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, -(-files // 4))).parquet(f"{path}/*")
    return event_changes(raw).drop("event_id")


@query("stream_pending_queue")
def _(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "pending"), scratch_path(spark, "checkpoint")
    ch.pending_stream(_event_stream(spark, sf_dir), out, checkpoint).awaitTermination()
    return ch.pending(spark, out).select("tenant", "product_id", "created", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("stream_recheck")
def _(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "recheck"), scratch_path(spark, "checkpoint")
    tables, known = _stored_tables(spark, sf_dir)
    ch.recheck_stream(
        _event_stream(spark, sf_dir), lambda s: tables, lambda s: context(s), lambda s: known, out, checkpoint, BASE_RULES,
    ).awaitTermination()
    return shown(ch.current_findings(spark, tables.read("findings"), out), "rule_id", "detail")


@query("drain_pending")
def _(spark, sf_dir):
    queue = ch.queue_items(event_changes(b.table(spark, sf_dir, "events")))
    covered = catalog(spark, sf_dir, "part").items.filter("pos % 2 = 0").select("tenant", C("id").alias("product_id"))
    room = spark.createDataFrame([("north", 3), ("south", 20)], "tenant string, room int")
    return ch.drain(queue, covered, room).select("tenant", "product_id", "created", "known", "action")


@query("pending_count")
def _(spark, sf_dir):
    return ch.pending_count(ch.queue_items(event_changes(b.table(spark, sf_dir, "events"))))


def event_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a saved result."""
    return b.table(spark, sf_dir, "events").selectExpr(
        "concat('t', cast(user_id % 5 as string)) AS tenant", "event_id AS scan_id", "cast(50 as bigint) AS score",
        "cast(100 + event_id % 7 as bigint) AS total", "cast(10 as bigint) AS clean",
        "cast(round(value * 10) as bigint) AS open", "CASE WHEN event_type = 'error' THEN event_id % 3 ELSE 0 END AS high",
        "event_id % 4 = 0 AS full", "cast(101 + event_id % 5 as bigint) AS catalog_total", "cast(0 as bigint) AS ignored",
        "cast(ts as timestamp) AS read_at", "cast(ts as timestamp) AS created_at",
    )


def event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two counts per saved result, one of them of a check that no longer exists."""
    s = event_scans(spark, sf_dir)
    return s.select("tenant", "scan_id", F.lit("missing_sku").alias("rule_id"), C("open").alias("count")).unionByName(
        s.select("tenant", "scan_id", F.lit("retired_check").alias("rule_id"), F.lit(5).cast("bigint").alias("count"))
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as logged changes."""
    return b.table(spark, sf_dir, "events").selectExpr(
        "concat('t', cast(user_id % 5 as string)) AS tenant", "concat('b', cast(cast(floor(event_id / 20e0) as bigint) as string)) AS batch_id",
        "CASE WHEN event_id % 40 < 20 THEN 'vendor_casing' ELSE 'compare_at_not_higher' END AS rule_id",
        "CASE WHEN event_id % 2 = 0 THEN 'vendor' ELSE 'compareAt' END AS field", "cast(event_id as string) AS target_id",
        "cast(user_id as string) AS product_id", "concat('Item ', cast(user_id as string)) AS title",
        "'\"a\"' AS before", "CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '\"b\"' END AS after",
        "event_type = 'error' AS undone", "cast(ts as timestamp) AS created_at",
    )


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("daily_snapshot")
def _(spark, sf_dir):
    return history.first_of_day(event_scans(spark, sf_dir), event_log(spark, sf_dir)).withColumn("date", C("date").cast("string"))


@query("clean_streak")
def _(spark, sf_dir):
    return history.clean_streak(history.first_of_day(event_scans(spark, sf_dir)))


@query("snapshot_as_of")
def _(spark, sf_dir):
    snaps = history.first_of_day(event_scans(spark, sf_dir))
    return history.days_before(snaps, F.lit("2024-01-20").cast("date"), 7).withColumn("date", C("date").cast("string"))


@query("weekly_change")
def _(spark, sf_dir):
    snaps = history.first_of_day(event_scans(spark, sf_dir))
    newest = store.latest(event_scans(spark, sf_dir)).select("tenant", "open")
    return history.weekly_change(newest, snaps, F.lit("2024-01-30").cast("date"))


@query("weekly_digest")
def _(spark, sf_dir):
    found = base_findings(spark, sf_dir)
    counts = summary.quality_score(found, totals(spark, sf_dir)).select("tenant", "open")
    snaps = history.first_of_day(event_scans(spark, sf_dir)).withColumn("tenant", F.when(C("tenant") == "t0", "north").otherwise("south")).groupBy(
        "tenant", "date").agg(F.max("open").alias("open"), F.max("high").alias("high"))
    out = history.digest(found, counts, snaps, F.lit("2024-01-30").cast("date"), 5)
    return out.select("tenant", "open", "week_ago", "change", F.array_join(F.transform("top", lambda t: t["rule_id"]), ",").alias("top"))


@query("scan_trend")
def _(spark, sf_dir):
    h = store.history(event_scans(spark, sf_dir), event_rules(spark, sf_dir), 12)
    return history.trend(h, 12).select("tenant", "scan_id", "total", "open", "delta")


@query("latest_result")
def _(spark, sf_dir):
    return store.latest(event_scans(spark, sf_dir)).select("tenant", "scan_id", "total", "open", _stamp("created_at"))


@query("latest_summary")
def _(spark, sf_dir):
    out = store.latest_summary(event_scans(spark, sf_dir), event_rules(spark, sf_dir))
    return out.select("tenant", "scan_id", "open", "high", "truncated")


@query("saved_since")
def _(spark, sf_dir):
    s = event_scans(spark, sf_dir)
    ref = s.filter("full").groupBy("tenant").agg(F.max("scan_id").alias("scan_id"))
    return store.saved_since(s, ref)


@query("retention")
def _(spark, sf_dir):
    return store.retained(event_scans(spark, sf_dir), 20, 12)


@query("save_and_prune")
def _(spark, sf_dir):
    """A result saved on top of the events as older ones: saved, snapshot taken and pruned in one step."""
    s = store.Store(spark, scratch_path(spark, "store"))
    merged = F.when(C("tenant").isin("t0", "t1"), F.lit("north")).otherwise(F.lit("south"))
    older, rules = (df.withColumn("tenant", merged) for df in (event_scans(spark, sf_dir), event_rules(spark, sf_dir)))
    s.commit(appended={"scans": older, "scan_rules": rules.filter("rule_id = 'missing_sku'")})
    result = scan(catalog(spark, sf_dir, "part"), context(spark), ["no_tags", "few_images"], folder=scratch_path(spark, "scan"))
    version = store.save_and_prune(s, result, 1 << 40, "2030-01-01 10:00:00", rows=20, full_rows=12)
    counts = s.read("scan_rules", at=version).groupBy("tenant", "scan_id").agg(F.sum("count").alias("counted"))
    days = s.read("daily_snapshot", at=version).select("tenant", F.lit(1 << 40).alias("scan_id"), C("open").alias("snapshot_open"))
    kept = s.read("scans", at=version).select("tenant", "scan_id", "open", "full")
    return kept.join(counts, ["tenant", "scan_id"]).join(days, ["tenant", "scan_id"], "left")


@query("tenant_erase")
def _(spark, sf_dir):
    s = store.without_tenant(event_scans(spark, sf_dir), "t3")
    return s.groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))


@query("store_stats")
def _(spark, sf_dir):
    s = event_scans(spark, sf_dir)
    return store.store_stats(s, event_log(spark, sf_dir), s)


@query("restore_check")
def _(spark, sf_dir):
    """A check comes back for the tenant with exactly one result saved since."""
    found = base_findings(spark, sf_dir)
    off = found.filter("rule_id <> 'no_tags'")
    stamps = found.groupBy("tenant").agg(F.count(F.lit(1)).alias("_n")).select(
        "tenant", F.explode(F.when(C("tenant") == "north", F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(3)))).alias("scan_id"),
        F.expr(b.AS_OF).alias("read_at"),
    )
    out = incremental.restore_check(off, found, stamps, stamps.filter("scan_id = 1"), "no_tags")
    return out.groupBy("tenant", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("items_of_check")
def _(spark, sf_dir):
    return incremental.items_of_check(base_findings(spark, sf_dir), "no_tags")


# ---- fixes ---------------------------------------------------------------------------------------

def _live(spark: SparkSession, sf_dir: str):
    """The catalog some time after the scan: some vendors were changed or corrected meanwhile."""
    c = catalog(spark, sf_dir, "part")
    vendor = F.when(C("pos") % 5 == 0, F.lit("Else")).when(C("pos") % 7 == 0, F.concat(F.upper(F.substring("vendor", 1, 1)), F.lower(F.substring(C("vendor"), F.lit(2), F.length("vendor"))))).otherwise(C("vendor"))
    return type(c)(c.items.withColumn("vendor", vendor), c.variants, c.memberships, c.alone, c.donors)


def _vendor_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog_findings(catalog(spark, sf_dir, "part"), context(spark), ["vendor_casing"])
    return fixes.plan_fix(found, _live(spark, sf_dir), "vendor_casing")


@query("fix_dominant_spelling")
def _(spark, sf_dir):
    return _vendor_plan(spark, sf_dir).select("tenant", "product_id", "before", "after", "action")


@query("fix_budget")
def _(spark, sf_dir):
    """What becomes of the planned changes, counted per tenant."""
    return fixes.fix_result(_vendor_plan(spark, sf_dir))


@query("fix_clear_compare_at")
def _(spark, sf_dir):
    c = catalog(spark, sf_dir, "offer")
    found = row_findings(c, context(spark), ["compare_at_not_higher"])
    plan = fixes.plan_fix(found, c, "compare_at_not_higher")
    return plan.select("tenant", "product_id", "target_id", "before", "action")


@query("apply_fixes")
def _(spark, sf_dir):
    """Two batches over the same items, the older one and a newer one of which every third entry was undone."""
    older = fixes.log_entries(_vendor_plan(spark, sf_dir), "vendor_casing", "b1", F.expr(b.AS_OF))
    newer = older.withColumns({
        "batch_id": F.lit("b2"), "created_at": C("created_at") + F.expr("interval 1 day"),
        "after": fixes.as_json(F.concat(F.lit("New "), fixes.from_json_text(C("after")))),
        "undone": C("product_id").cast("bigint") % 3 == 0,
    })
    log = older.unionByName(newer)
    items = _live(spark, sf_dir).items
    return fixes.apply_changes(items, log, "id", {"vendor": "vendor"}).select("tenant", C("id").alias("product_id"), "vendor")


@query("undo_batch")
def _(spark, sf_dir):
    log = event_log(spark, sf_dir)
    now = log.select(
        "tenant", "target_id", "field",
        F.when(C("target_id").cast("bigint") % 5 == 0, F.lit("c")).otherwise(fixes.from_json_text(C("after"))).alias("now"),
    ).filter(C("target_id").cast("bigint") % 11 != 0)
    one = fixes.plan_undo(log.withColumn("batch_id", F.lit("all")), now, "t1", "all")
    return one.select("tenant", "target_id", "field", "outcome")


@query("undo_closes_entries")
def _(spark, sf_dir):
    log = event_log(spark, sf_dir)
    closed = log.filter("field = 'vendor'")
    return fixes.close_entries(log, closed).groupBy("tenant", "field", "undone").agg(F.count(F.lit(1)).alias("n"))


@query("recent_fixes")
def _(spark, sf_dir):
    return fixes.recent_fixes(event_log(spark, sf_dir), 5).drop("label").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("fix_batch_detail")
def _(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("batch_id", F.lit("all"))
    return fixes.batch_detail(log, "t2", "all").withColumn("fields", F.array_join("fields", ","))


@query("fixed_in_window")
def _(spark, sf_dir):
    return fixes.fixed_count(event_log(spark, sf_dir), F.lit("2024-01-23").cast("timestamp"))


# ---- validation ----------------------------------------------------------------------------------

def proposed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposed edit per order, of a kind chosen by its key, with a value built from its columns."""
    return b.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS edit_id", f"{EDIT_KIND} AS kind", f"{EDIT_FIELD} AS field", "'' AS value_type", f"{EDIT_VALUE} AS value"
    )


EDIT_KIND = (
    "CASE o_orderkey % 8 WHEN 0 THEN 'product' WHEN 1 THEN 'variant' WHEN 2 THEN 'weight' WHEN 3 THEN 'cost' "
    "WHEN 4 THEN 'inventory' WHEN 5 THEN 'option' WHEN 6 THEN 'word' ELSE 'other' END"
)
EDIT_FIELD = (
    "CASE o_orderkey % 8 WHEN 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'title' ELSE 'status' END "
    "WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 'price' ELSE 'compareAt' END ELSE '' END"
)
EDIT_VALUE = (
    "CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN cast(cast(o_totalprice as decimal(18,2)) as string) "
    "WHEN 2 THEN '-3' WHEN 3 THEN 'DRAFT' ELSE repeat(o_orderpriority, 40) END"
)


@query("validate_values")
def _(spark, sf_dir):
    checked = validate.validate_edits(proposed_edits(spark, sf_dir))
    return checked.select("edit_id", C("error").isNotNull().alias("refused"))


@query("validate_attribute_types")
def _(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").selectExpr("event_id", f"{ATTR_TYPE} AS type", f"{ATTR_VALUE} AS value")
    return rows.select("event_id", validate.attribute_error(C("type"), C("value")).isNotNull().alias("refused"))


ATTR_TYPE = (
    "CASE event_id % 8 WHEN 0 THEN 'number_integer' WHEN 1 THEN 'number_decimal' WHEN 2 THEN 'boolean' WHEN 3 THEN 'url' "
    "WHEN 4 THEN 'date' WHEN 5 THEN 'json' WHEN 6 THEN 'single_line_text_field' ELSE 'multi' END"
)
ATTR_VALUE = (
    "CASE user_id % 6 WHEN 0 THEN cast(user_id as string) WHEN 1 THEN '-1.5' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'https://example.org' "
    "WHEN 4 THEN '2024-01-02' ELSE props END"
)


@query("validate_finding_keys")
def _(spark, sf_dir):
    refs = b.table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_returnflag = 'A' THEN 'missing_sku' WHEN l_returnflag = 'N' THEN 'nothing' ELSE 'spelling' END AS rule_id",
        "CASE WHEN l_linenumber = 1 THEN cast(l_partkey as string) ELSE concat('gid://shop/Product/', cast(l_partkey as string)) END AS product_id",
        "CASE WHEN l_linenumber = 2 THEN 'gid://shop/x' WHEN l_linenumber = 3 THEN NULL ELSE concat('gid://shop/Variant/', cast(l_orderkey as string)) END AS variant_id",
        "CASE WHEN l_linenumber = 4 THEN repeat('a', 101) ELSE 'word' END AS word", "cast(NULL as string) AS field",
    )
    return validate.validate_finding_refs(refs).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("lint_attribute_rules")
def _(spark, sf_dir):
    rules = b.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 14 WHEN 0 THEN '^[A-Z]+$' WHEN 1 THEN '(a+)+$' WHEN 2 THEN '(x)\\\\1' WHEN 3 THEN repeat('a', 201) "
        "WHEN 4 THEN '^{.*}$' WHEN 5 THEN '[a[b]' WHEN 6 THEN '([a' WHEN 7 THEN 'a**' WHEN 8 THEN '(?<=[A-Z]-)\\\\d+' WHEN 9 THEN '(?<!a)b*' "
        "WHEN 10 THEN 'x*(?<=a+)b' WHEN 11 THEN '(?<y>a)\\\\k<y>' WHEN 12 THEN '\\\\cA[\\\\cb]' WHEN 13 THEN '(?<!(a|b))c+' ELSE '' END AS pattern"
    )
    return validate.lint_attribute_rules(rules).select("p_partkey", C("error").isNotNull().alias("refused"))


# ---- the whole scan ------------------------------------------------------------------------------

@query("full_scan_summary")
def _(spark, sf_dir):
    """Row and catalog checks of the parts, ignores applied, scored per tenant."""
    rules = [*BASE_RULES, "vendor_casing", "duplicate_title", "tag_casing"]
    result = scan(catalog(spark, sf_dir, "part"), context(spark), rules, ignores(spark, sf_dir), folder=scratch_path(spark, "scan"))
    return result.summary


@query("full_scan_all")
def _(spark, sf_dir):
    """All 61 checks over the parts as items and the line items as their variants, counted per tenant and check."""
    words = store.materialize(dictionary(spark, sf_dir), "dictionary")
    ctx = context(spark, attribute_rules=attribute_rules(spark), dictionary=words)
    # Findings are read once here, for their counts: only the features are stored, and no texts are made.
    result = scan(features(spark, sf_dir, "offer"), ctx)
    return summary.rule_counts(result.findings)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short, long and duplicate descriptions of the documents, counted by check."""
    configure(spark)
    docs = features(spark, sf_dir, "doc")
    found = row_findings(docs, context(spark), ["short_description", "description_too_long"]).unionByName(
        catalog_findings(docs, context(spark), ["duplicate_description"])
    )
    return found.groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("tenant").alias("tenants")
    )


QUERIES["description_quality"] = flagship
