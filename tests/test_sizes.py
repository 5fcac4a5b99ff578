"""What grows with the tables is shuffled: plans that small tables would let Spark shorten stay as they are."""

import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from wareproof.functions import text as tx
from wareproof.functions.numeric import as_one_number, gtin_valid, int_div, least_as_one_number
from wareproof.operators import generic, spelling
from wareproof.operators.incremental import added_deleted
from wareproof.operators.item_checks import Limits
from wareproof.operators.profile import ending_facts, price_endings
from wareproof.plans import queries
from wareproof.plans.scan import Context, row_findings, scan
from wareproof.sources.lines import numbered_lines
from wareproof.sources.records import from_tables
from wareproof.streaming import changes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_variants_of_words_are_not_sent_to_every_task(spark, tmp_path):
    spark.createDataFrame([("house", 3), ("mouse", 9), ("garden", 1)], "word string, freq bigint").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    asked = spark.createDataFrame([("hosue",), ("gardn",), ("mouze",), ("xylophone",)], "lower string")
    found = spelling.suggestions(asked, words)
    assert "Broadcast" not in plan_of(found)
    assert {tuple(r) for r in found.collect()} == {("hosue", "house"), ("gardn", "garden"), ("mouze", "mouse")}


@pytest.fixture(scope="module")
def flat(spark):
    """Thirty items of ten variants; items 0 and 1 own a hundred more each."""
    items = spark.range(30).select(
        F.lit("t").alias("tenant"), F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.lit("Item").alias("title"))
    owner = F.when(F.col("id") < 300, F.col("id") % 30).otherwise(F.col("id") % 2)
    variants = spark.range(500).select(
        F.lit("t").alias("tenant"), owner.cast("string").alias("product_id"), F.col("id").alias("variant_pos"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), F.lit("s").alias("sku"),
        (F.col("id") * 37 % 101).cast("string").alias("price"), F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id") * 1.0).alias("weight"),
        F.lit(True).alias("requires_shipping"), (F.col("id") % 7 == 0).alias("tracked"))
    lost = variants.filter("variant_pos < 5").withColumn("product_id", F.lit(None).cast("string"))
    return items, variants.unionByName(lost)


def shuffles(df):
    """Shuffles that were run, those below a broadcast included."""
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0].count("ShuffleQueryStage")


def facts_by_hand(variants):
    """Per item: variants, priced ones, their median in cents, weight of the first that has one."""
    rows, out = {}, {}
    for r in sorted(variants.filter("product_id is not null").collect(), key=lambda r: r.variant_pos):
        rows.setdefault(r.product_id, []).append(r)
    for key, mine in rows.items():
        prices = [int(r.price) * 100 for r in mine if int(r.price) > 0]
        out[key] = (len(mine), len(prices), float(median(prices)), next((r.weight for r in mine if r.weight > 0), None))
    return out


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_sibling_facts_of_small_and_large_items(flat, hot_rows):
    items, variants = flat
    got = from_tables(items, variants, hot_rows=hot_rows).variants.collect()
    want = facts_by_hand(variants)
    assert len(got) == 500
    assert all((r.n_variants, r.sib_priced, r.sib_median_cents, r.donor_weight) == want[r.product_id] for r in got)


def test_variants_move_once_to_their_siblings(flat):
    items, variants = flat
    found = row_findings(from_tables(items, variants), Context(limits=Limits(as_of=F.lit("2024-01-01").cast("timestamp"))), ["price_outlier"])
    assert shuffles(found) <= 3


def test_fields_that_nobody_asks_for_are_not_read(spark, flat, tmp_path):
    items, variants = flat
    variants.withColumns({"barcode": F.lit("b"), "cost": F.lit("1.5")}).write.parquet(f"{tmp_path}/variants")
    asked = from_tables(items, spark.read.parquet(f"{tmp_path}/variants")).variants.select("id", "price", "cost", "n_variants", "sib_median_cents")
    read = {c for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(asked)) for c in re.findall(r"(\w+):", schema)}
    assert {"id", "price", "cost"} <= read and not read & {"sku", "barcode", "requires_shipping", "tracked"}


def test_variants_are_sorted_by_item_first(flat):
    items, variants = flat
    sorts = re.findall(r"Sort \[(\w+)#\d+ ASC NULLS FIRST, (\w+)#", plan_of(from_tables(items, variants).variants.select("id", "price", "sib_priced")))
    assert ("product_id", "tenant") in sorts and ("tenant", "product_id") not in sorts


def test_siblings_do_not_move_for_a_weight(flat):
    items, variants = flat
    variants = variants.withColumn("inventory_item_id", F.concat(F.lit("i"), "id"))
    found = row_findings(from_tables(items, variants), Context(limits=Limits(as_of=F.lit("2024-01-01").cast("timestamp"))), ["missing_weight", "negative_inventory"])
    assert "Window" not in plan_of(found)
    want = facts_by_hand(variants)
    light = {r.id: r.product_id for r in variants.filter("weight = 0 and product_id is not null").collect()}
    got = {r.variant_id: (r.product_id, r.suggested) for r in found.filter("rule_id = 'missing_weight'").select("variant_id", "product_id", "edit.suggested").collect()}
    assert got == {v: (item, "" if want[item][3] is None else str(int(want[item][3]))) for v, item in light.items()}


def test_price_endings_are_counted_in_one_pass_that_sorts_nothing(spark, tmp_path):
    rows = [("a", 5, 2, "1.50"), ("a", 5, 1, "2.25"), ("a", 7, 0, "3.25"), ("a", 7, 1, "4.50"), ("a", 9, 0, None), ("b", 1, 0, "0.00"), ("c", 1, 0, "8.75")]
    spark.createDataFrame(rows, "tenant string, pos bigint, variant_pos bigint, price string").withColumn(
        "price", F.col("price").cast("decimal(18,2)")).write.parquet(f"{tmp_path}/variants")
    variants = spark.read.parquet(f"{tmp_path}/variants")
    facts = ending_facts(variants)
    assert plan_of(facts).count("FileScan") == 1
    assert not [line for line in plan_of(facts).splitlines() if "SortAggregate" in line and "min(" in line]
    assert {(r.tenant, r.n_variants_all, r.price_ending) for r in facts.collect()} == {("a", 5, "99"), ("b", 1, "99"), ("c", 1, "99")}
    assert {tuple(r) for r in price_endings(variants, min_priced=1).collect()} == {("a", "25"), ("c", "75")}


def test_counted_findings_have_no_texts_made(flat):
    items, variants = flat
    found = row_findings(from_tables(items, variants), Context(limits=Limits(as_of=F.lit("2024-01-01").cast("timestamp"))), ["price_outlier", "barcode_invalid"])
    counted = found.groupBy("rule_id").agg(F.countDistinct("product_id"))
    assert "others around" in found._jdf.queryExecution().optimizedPlan().toString()
    assert "others around" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_digits_of_a_barcode_are_cleaned_once(spark):
    assert gtin_valid(F.col("barcode"))._jc.toString().count("regexp_replace") == 1
    rows = spark.createDataFrame([("4006381333931",), ("4006381333932",), (" 400-6381333931 ",), ("12",), (None,)], "barcode string")
    assert [r[0] for r in rows.select(gtin_valid(F.col("barcode"))).collect()] == [True, False, True, None, None]


def generators(df):
    """The lines of the optimized plan that make rows out of arrays."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate " in line]


def test_checks_are_made_in_a_projection_not_in_the_generator(flat):
    items, variants = flat
    found = row_findings(from_tables(items, variants), Context(limits=Limits(as_of=F.lit("2024-01-01").cast("timestamp"))), ["price_outlier", "barcode_invalid"])
    made = generators(found.groupBy("rule_id").count())
    assert made and not [line for line in made if "CASE WHEN" in line]


def test_words_are_made_in_a_projection_not_in_the_generator(flat):
    items, variants = flat
    words = spelling.candidate_words(from_tables(items.withColumn("description_html", F.lit("Some wurds, don't we")), variants).items)
    made = generators(words)
    assert len(made) == 2 and not [line for line in made if "regexp" in line]
    assert {r.word for r in words.collect()} == {"Item", "wurds", "don't"}


def test_long_words_are_those_of_all_words_that_are_long(spark):
    texts = ["it's a 'quoted' text''s x'y ab'c d'e'f", "abc abcd 'abc abc' a1bcde", "", None, "\u00e9cole Stra\u00dfe"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    long = F.filter(spelling.words_of(F.col("t")), lambda w: F.length(w) >= spelling.MIN_WORD)
    for r in rows.select("t", long.alias("want"), spelling.long_words_of(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_units_of_two_positions_are_counted_without_sorting(spark):
    rows = spark.createDataFrame(
        [("t", 2, 0, "KILOGRAMS", 1.0), ("t", 1, 5, "POUNDS", 2.0), ("t", 1, 4, "GRAMS", 3.0), ("t", 3, 0, "OUNCES", 4.0)] * 3,
        "tenant string, pos bigint, variant_pos bigint, unit string, weight double")
    mixed = generic.mixed_unit(rows, "unit", "weight", ["pos", "variant_pos"], ["pos"], min_rows=1, share=25)
    assert not [line for line in plan_of(mixed).splitlines() if "SortAggregate" in line and "min(" in line]
    assert {r.majority_unit for r in mixed.collect()} == {"GRAMS"}


def test_the_least_pair_of_short_and_long_numbers(spark):
    pairs = [(3, 9), (3, 2**40), (2**31, 0), (2**31 - 1, 2**32 - 1), (-5, 7), (None, 8), (4, None), (4, 2**32), (2**62, -3), (0, 0)]
    for i in range(len(pairs)):
        for some in (pairs[i:], pairs[i:i + 1], pairs[:i + 1]):
            rows = spark.createDataFrame(some, "a bigint, b bigint").coalesce(1)
            got = rows.agg(least_as_one_number(F.col("a"), F.col("b")).alias("got"), F.min(as_one_number(F.col("a"), F.col("b"))).alias("want")).first()
            assert got.got == got.want, some


def test_ends_are_trimmed_alike_with_and_without_a_pattern(spark):
    texts = ["a", " a", "a ", "\u00a0a b\u3000", "\ufeff", "", None, " ", "a \u0085", "\u0085 a", "a\n", "\ta\x0b", "\u00e9 ", "~!", "\x7f ", "\u200ax\u200b", "\U0001F389 "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    seen = rows.select(
        "t", tx.js_trim(t).alias("a"), tx.trimmed(t).alias("b"), tx.is_blank(t).alias("c"), (~tx.blank_if_null(t).rlike(f"[^{tx._WS_BODY}]")).alias("d"),
        F.regexp_replace(t, f"{tx.WS}|-", "").alias("e"), tx.without_spaces_and_hyphens(t).alias("f")).collect()
    assert all((r.a, r.c, r.e) == (r.b, r.d, r.f) for r in seen)


def test_check_digits_of_one_number_are_those_by_hand(spark):
    def by_hand(code):
        digits = re.sub(r"[\s-]", "", code)
        if not re.fullmatch("[0-9]{12,14}", digits):
            return None
        padded = [int(c) for c in digits.rjust(14, "0")]
        return (10 - sum(d * (3 if i % 2 == 0 else 1) for i, d in enumerate(padded[:13])) % 10) % 10 == padded[13]

    codes = [str(7**k * 10**9 + k)[:n] for k in range(4, 40) for n in range(11, 16)] + [f"{n:0>14}" for n in range(0, 60)] + ["4006381-333931", "+12345678901", "12345678901.0"]
    rows = spark.createDataFrame([(c,) for c in codes], "barcode string").select("barcode", gtin_valid(F.col("barcode")).alias("valid"))
    assert {r.barcode: r.valid for r in rows.collect()} == {c: by_hand(c) for c in codes}


def test_whole_quotients_are_made_of_whole_numbers(spark):
    rows = spark.createDataFrame([(7, 2), (-7, 2), (10**18 - 1, 20000)], "a bigint, b bigint")
    made = rows.select(int_div(F.col("a"), F.col("b")).alias("q"))
    assert "decimal" not in made._jdf.queryExecution().analyzed().toString()
    assert [r.q for r in made.collect()] == [3, -4, (10**18 - 1) // 20000]


def test_numbering_lines_moves_no_line(spark, tmp_path):
    (tmp_path / "a.json").write_text("one\ntwo\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = numbered_lines(spark, str(tmp_path))
        assert "SortMergeJoin" not in plan_of(numbered)
        assert sorted(map(tuple, numbered.collect())) == [(0, "one"), (1, "two")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_full_scan_that_only_counts_stores_no_findings(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "scan", lambda made, ctx, *a, **over: asked.append(over) or scan(made, ctx, ["no_tags"], **over))
    counts = queries.QUERIES["full_scan_all"](spark, "/root/testdata/sf0.001")
    assert asked == [{}] and {r.rule_id for r in counts.collect()} == {"no_tags"}


def test_more_files_of_events_make_no_more_batches(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    given.repartition(6).write.parquet(f"{tmp_path}/sf/events.parquet")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        events = queries._event_stream(spark, f"{tmp_path}/sf")
        changes.pending_stream(events, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "out").glob("batch=*"))) <= 4
    assert changes.pending(spark, f"{tmp_path}/out").count() == given.select("user_id").distinct().count()


def test_covered_ids_that_were_not_asked_for_do_not_move(spark, tmp_path):
    spark.range(50_000).select(F.lit("t").alias("tenant"), F.col("id").cast("string").alias("product_id")).write.parquet(f"{tmp_path}/covered")
    spark.createDataFrame([("t", "7"), ("t", "8"), ("t", "x")], "tenant string, product_id string").write.parquet(f"{tmp_path}/ids")
    covered, ids = spark.read.parquet(f"{tmp_path}/covered"), spark.read.parquet(f"{tmp_path}/ids")
    found = added_deleted(ids, covered, ids.filter("product_id <> '8'"))
    assert {tuple(r) for r in found.collect()} == {("t", "8", "deleted"), ("t", "x", "added")}
    assert re.search(r"BroadcastHashJoin \[tenant.*LeftSemi", plan_of(found))
