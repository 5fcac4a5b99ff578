"""Keeping stored results current without a full scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.functions.text import blank_if_null, js_trim
from wareproof.operators.registry import CATALOG_RULES, RULE_IDS
from wareproof.operators.rolling import State, moved, signed
from wareproof.operators.summary import apply_ignores, known_findings
from wareproof.operators.validate import pattern_error
from wareproof.plans.scan import Context, row_findings, stored
from wareproof.sources.buckets import ItemTables
from wareproof.sources.reads import by_ids, new_ids
from wareproof.sources.records import Catalog

C = F.col
KEY = ["tenant", "product_id"]


@dataclass(frozen=True)
class Recheck:
    """The outcome of a partial refresh."""

    findings: DataFrame
    covered: DataFrame  # tenant, product_id
    changes: DataFrame  # tenant, product_id, change: added or deleted
    fresh: DataFrame


def added_deleted(ids: DataFrame, covered: DataFrame, present: DataFrame) -> DataFrame:
    """(tenant, product_id, change) of the given ids: deleted when covered but no longer present, added
    when present but not covered. A tenant with no covered ids on record knows every id."""
    asked = ids.select(*KEY).distinct()
    # What was not asked for goes first: few ids do not make the whole list of covered ids move.
    known = covered.select(*KEY).join(asked, KEY, "left_semi").distinct().withColumn("_known", F.lit(True))
    there = present.select(*KEY).join(asked, KEY, "left_semi").distinct().withColumn("_there", F.lit(True))
    recorded = covered.select("tenant").distinct().withColumn("_recorded", F.lit(True))
    flags = (
        asked.join(known, KEY, "left").join(there, KEY, "left").join(recorded, "tenant", "left")
        .select(
            *KEY, F.coalesce("_known", F.col("_recorded").isNull()).alias("_known"),
            F.coalesce("_there", F.lit(False)).alias("_there"),
        )
    )
    change = F.when(C("_known") & ~C("_there"), F.lit("deleted")).when(~C("_known") & C("_there"), F.lit("added"))
    return flags.withColumn("change", change).filter(C("change").isNotNull()).select(*KEY, "change")


def splice(
    findings: DataFrame,
    touched: DataFrame,
    fresh: DataFrame,
    deleted: DataFrame | None = None,
    acted_on: str | None = None,
) -> DataFrame:
    """Stored findings with those of touched items replaced.

    Touched items keep their catalog-wide findings except of the check acted on; deleted items keep
    nothing. Splicing the same input again changes nothing.
    """
    keep_rules = [r for r in CATALOG_RULES if r != acted_on]
    marks = touched.select(*KEY).distinct().withColumn("_touched", F.lit(True))
    kept = known_findings(findings).join(marks, KEY, "left").filter(
        C("_touched").isNull() | C("rule_id").isin(keep_rules)
    ).drop("_touched")
    if deleted is not None:
        kept = kept.join(deleted.select(*KEY).distinct(), KEY, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def recheck(
    catalog: Catalog | ItemTables,
    ids: DataFrame,
    findings: DataFrame,
    covered: DataFrame,
    ctx: Context,
    rules: Sequence[str] = RULE_IDS,
    ignores: DataFrame | None = None,
    acted_on: str | None = None,
    folder: str | None = None,
) -> Recheck:
    """Re-run the row checks on the given items and splice the outcome into the stored findings. With ``folder``
    the features of the given items are written there once for all checks; of a catalog in buckets only theirs are read."""
    part = by_ids(catalog, ids)
    if folder is not None:
        part = stored(part, folder)
    fresh = row_findings(part, ctx, rules)
    if ignores is not None:
        fresh = apply_ignores(fresh, ignores)
    present = part.items.select("tenant", C("id").alias("product_id"))
    changes = added_deleted(ids, covered, present)
    deleted = changes.filter("change = 'deleted'")
    out = splice(findings, ids, fresh, deleted, acted_on)
    now_covered = covered.select(*KEY).join(deleted.select(*KEY), KEY, "left_anti").unionByName(
        changes.filter("change = 'added'").select(*KEY)
    )
    return Recheck(out, now_covered, changes, fresh)


def refreshed(
    tables: ItemTables, ids: DataFrame, covered: DataFrame, ctx: Context, state: State, rules: Sequence[str] = RULE_IDS,
    ignores: DataFrame | None = None, acted_on: str | None = None, folder: str | None = None,
) -> tuple[Recheck, State]:
    """``recheck`` of tables in buckets, with the sums moved along: the outcome for the given items alone, and the state after it.

    ``tables`` hold the findings under ``findings`` and may hold the sums by item under ``item_sums``: of both, as of the features, only the buckets of the
    given items are read, and the sums by item that come back are those of these buckets. The other findings stay as they are."""
    numbers = tables.numbers(ids)
    here = tables.read("findings", numbers)
    if "item_sums" in tables.schemas:
        state = State(tables.read("item_sums", numbers), state.rules, state.tenants)
    out = recheck(tables, ids, here, covered, ctx, rules, ignores, acted_on, folder)
    if folder is not None:
        out.findings.write.mode("overwrite").parquet(f"{folder}/spliced")
        spliced = out.findings.sparkSession.read.schema(out.findings.schema).parquet(f"{folder}/spliced")
        out = Recheck(spliced, out.covered, out.changes, out.fresh)
    touched = ids.select(*KEY).distinct()
    before, after = (known_findings(f).join(touched, KEY, "left_semi") for f in (here, out.findings))
    return out, moved(state, signed(before, after), out.changes)


def scan_new(
    catalog: Catalog,
    since: Column,
    findings: DataFrame,
    covered: DataFrame,
    ctx: Context,
    rules: Sequence[str] = RULE_IDS,
    ignores: DataFrame | None = None,
) -> Recheck:
    """Row checks for items created since the last read that the stored result does not cover."""
    ids = new_ids(catalog.items, since).select(*KEY).join(covered.select(*KEY), KEY, "left_anti")
    part = by_ids(catalog, ids)
    fresh = row_findings(part, ctx, rules)
    if ignores is not None:
        fresh = apply_ignores(fresh, ignores)
    old = known_findings(findings).join(ids, KEY, "left_anti")
    added = part.items.select("tenant", C("id").alias("product_id"))
    return Recheck(
        old.unionByName(fresh, allowMissingColumns=True), covered.select(*KEY).unionByName(added),
        added.withColumn("change", F.lit("added")), fresh,
    )


# ---- settings, ignores, words, marks -------------------------------------------------------------

def apply_settings(findings: DataFrame, disabled: DataFrame, attribute_rules: DataFrame) -> DataFrame:
    """Findings of checks and attributes that are still switched on."""
    on = findings.join(disabled, ["tenant", "rule_id"], "left_anti")
    active = attribute_rules.select(
        "tenant", F.concat_ws(".", "namespace", "key").alias("field"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.coalesce("required", F.lit(False)), F.lit("metafield_required")),
                    F.when(blank_if_null(C("pattern")) != "", F.lit("metafield_pattern")),
                )
            )
        ).alias("rule_id"),
    ).distinct().withColumn("_active", F.lit(True))
    by_attribute = C("rule_id").isin("metafield_required", "metafield_pattern")
    joined = on.join(active, ["tenant", "field", "rule_id"], "left")
    return joined.filter(~by_attribute | C("_active")).drop("_active").select(*findings.columns)


def upsert_ignores(ignores: DataFrame, new: DataFrame) -> DataFrame:
    """Ignores with new ones added; a key that is already there stays as it is."""
    fresh = new.dropDuplicates(["tenant", "key"]).join(ignores, ["tenant", "key"], "left_anti")
    return ignores.unionByName(fresh, allowMissingColumns=True)


def ignore_finding(findings: DataFrame, keys: DataFrame) -> DataFrame:
    """Findings without those of the given (tenant, finding_key)."""
    return findings.join(keys.select("tenant", "finding_key").distinct(), ["tenant", "finding_key"], "left_anti")


def unignore(ignores: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ignores that stay, and the items of the removed ones, to be rechecked."""
    gone = keys.select("tenant", "key").distinct()
    items = ignores.join(gone, ["tenant", "key"], "left_semi").select("tenant", "product_id").distinct()
    return ignores.join(gone, ["tenant", "key"], "left_anti"), items


def learn_words(dictionary: DataFrame, words: DataFrame) -> DataFrame:
    """The learned words with new ones added once, trimmed and in lower case."""
    clean = words.select("tenant", F.lower(js_trim(blank_if_null(C("word")))).alias("word")).filter("word != ''")
    return dictionary.select("tenant", "word").unionByName(clean).distinct()


def forget_words(dictionary: DataFrame, words: DataFrame) -> DataFrame:
    return dictionary.join(words.select("tenant", "word").distinct(), ["tenant", "word"], "left_anti")


def list_words(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("tenant", "word").orderBy("tenant", "word")


def drop_learned(findings: DataFrame, words: DataFrame) -> DataFrame:
    """Findings without the spelling findings of learned words."""
    known = words.select("tenant", F.lower("word").alias("_word"), F.lit("spelling").alias("_rule")).distinct()
    f, k = findings.alias("f"), known.alias("k")
    on = (C("f.tenant") == C("k.tenant")) & (C("f.rule_id") == C("k._rule")) & (F.lower("f.word") == C("k._word"))
    return f.join(k, on, "left_anti")


def mark_saved(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Set the ``saved`` mark of findings by key; a mark with ``saved`` null clears it."""
    m = marks.select("tenant", "finding_key", C("saved").alias("_saved"), F.lit(True).alias("_hit"))
    joined = findings.join(m, ["tenant", "finding_key"], "left")
    return joined.withColumn("saved", F.when(C("_hit"), C("_saved")).otherwise(C("saved"))).select(*findings.columns)


def restore_check(
    latest_findings: DataFrame,
    kept_findings: DataFrame,
    scans: DataFrame,
    kept_scan: DataFrame,
    rule_id: str,
) -> DataFrame:
    """Put the findings of a check back from the result saved before it was turned off.

    Only for tenants where exactly one result was saved since and the catalog was not read again;
    the others wait for their next scan.
    """
    ref = kept_scan.select("tenant", C("scan_id").alias("_ref"), C("read_at").alias("_ref_read"))
    newer = scans.join(ref, "tenant").filter(C("scan_id") > C("_ref"))
    untouched = newer.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(C("read_at") == C("_ref_read")).alias("_same")
    ).filter((C("_n") == 1) & C("_same")).select("tenant")
    back = kept_findings.filter(C("rule_id") == rule_id).join(untouched, "tenant", "left_semi")
    others = latest_findings.join(
        untouched.withColumn("rule_id", F.lit(rule_id)), ["tenant", "rule_id"], "left_anti"
    )
    return others.unionByName(back, allowMissingColumns=True)


def items_of_check(findings: DataFrame, rule_id: str) -> DataFrame:
    """(tenant, product_id) a check lists: the ids to recheck when one check is refreshed."""
    return findings.filter(C("rule_id") == rule_id).select(*KEY).distinct()


# ---- attribute rules -----------------------------------------------------------------------------

RULE_KEY = ["tenant", "namespace", "key"]


def upsert_attribute_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge changes by (tenant, namespace, key): all of a tenant's changes or none.

    One pattern that is not accepted holds back every change of its tenant.
    """
    bad = changes.filter(pattern_error(C("pattern")).isNotNull()).select("tenant").distinct()
    good = changes.join(bad, "tenant", "left_anti")
    fields = [c for c in rules.columns if c not in RULE_KEY]
    new = good.select(*RULE_KEY, *[C(c).alias(f"_{c}") for c in fields])
    return rules.join(new, RULE_KEY, "full_outer").select(
        *RULE_KEY, *[F.coalesce(C(f"_{c}"), C(c)).alias(c) for c in fields]
    )


def convert_legacy_rules(legacy: DataFrame) -> DataFrame:
    """Attribute rules from (tenant, key = namespace.key, product_type, pattern). Rules without a full
    key are left out and patterns that would not pass today are dropped."""
    full = js_trim(blank_if_null(C("key")))
    dot = F.instr(full, ".")
    name = F.substring(full, dot + 1, F.length(full))
    pattern = js_trim(blank_if_null(C("pattern")))
    words = F.transform(
        F.split(F.regexp_replace(name, "[_-]+", " "), " "),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))),
    )
    out = legacy.filter((dot > 1) & (name != "")).select(
        "tenant", F.substring(full, F.lit(1), dot - 1).alias("namespace"), name.alias("key"),
        F.array_join(words, " ").alias("name"), F.lit("single_line_text_field").alias("type"),
        F.lit(True).alias("required"),
        F.when(pattern_error(pattern).isNull(), pattern).otherwise("").alias("pattern"),
        js_trim(blank_if_null(C("product_type"))).alias("product_type"),
    )
    return out.dropDuplicates(RULE_KEY)
