"""The building blocks for skewed groups give the same rows as the plain way, hot groups included."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wareproof.operators import generic as g
from wareproof.operators.skew import attach_groups, ranked
from wareproof.operators.summary import cap_findings
from wareproof.sources.records import from_tables


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows; one key owns a third of them."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(3000).select(F.lit("t").alias("tenant"), "id", key.alias("key"), (F.col("id") * 7919 % 3000).alias("pos"))


def test_attach_groups_splits_hot_keys(spark, rows):
    groups = rows.groupBy("tenant", "key").agg(F.count(F.lit(1)).alias("n"))
    plain = rows.join(groups, ["tenant", "key"])
    split = attach_groups(rows, groups, ["tenant", "key"], "n", ["id"], hot_rows=100)
    assert sorted(map(tuple, split.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    kept = attach_groups(rows, groups, ["tenant", "key"], "n", ["id"], keep=F.col("n") < 100, hot_rows=100)
    assert kept.count() == 2000
    left = attach_groups(rows, groups.filter("n < 100"), ["tenant", "key"], "n", ["id"], how="left", hot_rows=30)
    assert left.count() == 3000 and left.filter("n is null").count() == 1000


def test_hot_rows_reach_several_partitions(spark, rows):
    groups = rows.groupBy("tenant", "key").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = attach_groups(rows, groups, ["tenant", "key"], "n", ["id"], hot_rows=50)
        spread = split.filter("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spread > 1


@pytest.mark.parametrize("width", [1, 64, 1 << 20])
def test_ranked_equals_row_number(rows, width):
    w = Window.partitionBy("tenant", "key").orderBy("pos")
    want = sorted(map(tuple, rows.withColumn("r", F.row_number().over(w).cast("bigint")).select("id", "r").collect()))
    got = sorted(map(tuple, ranked(rows, ["tenant", "key"], ["pos"], "r", slice_width=width).select("id", "r").collect()))
    assert got == want
    top = ranked(rows, ["tenant", "key"], ["pos"], "r", at_most=5, slice_width=width)
    assert sorted(map(tuple, top.select("id", "r").collect())) == [x for x in want if x[1] <= 5]


@pytest.mark.parametrize("width", [16, 1 << 20])
def test_numbered_duplicates(rows, width):
    got = g.numbered_duplicates(rows, F.col("key"), ["pos", "id"], slice_width=width).select("id", "group_size", "member")
    by_key = {}
    for r in rows.collect():
        by_key.setdefault(r.key, []).append((r.pos, r.id))
    want = {i: (len(v), n) for v in by_key.values() for n, (_, i) in enumerate(sorted(v), 1)}
    assert {r.id: (r.group_size, r.member) for r in got.collect()} == want


def test_peer_outlier_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = [(int(k), int(i), int(v)) for i, (k, v) in enumerate(zip(rng.choice([0, 0, 0, 1, 2, 3], 400), rng.lognormal(5, 1.5, 400)))]
    df = spark.createDataFrame(data, "grp bigint, id bigint, v bigint")
    got = {r.id for r in g.peer_outlier(df, "v", ["grp"], ["id"]).collect()}
    want = set()
    for k in {d[0] for d in data}:
        values = [v for kk, _, v in data if kk == k and v > 0]
        mid = np.median(values)
        want |= {i for kk, i, v in data if kk == k and v > 0 and len(values) >= 3 and (v > 5 * mid or 5 * v < mid)}
    assert got == want


def test_majority_and_units_and_long_keys(spark, rows):
    styled = rows.withColumn("style", F.col("id") % 10 == 0)
    off = g.majority_style(styled, F.col("style"), ["id"])
    assert {r.id for r in off.collect()} == set(range(0, 3000, 10))
    units = rows.select("tenant", "id", "pos", F.when(F.col("id") % 20 == 0, "POUNDS").otherwise("KILOGRAMS").alias("u"), F.lit(2.0).alias("w"))
    mixed = g.mixed_unit(units, "u", "w", ["pos"], ["id"])
    assert mixed.count() == 150 and abs(mixed.first()["converted"] - 0.90718474) < 1e-9
    long_text = rows.withColumn("text", F.concat(F.repeat(F.lit("word "), 50), F.col("key")))
    assert g.duplicate_key(long_text, F.col("text"), ["id"], min_len=40, long_key=True).count() == 3000


def test_cap_keeps_the_first_of_every_check(spark, rows):
    findings = rows.select(
        "tenant", F.col("key").alias("rule_id"), "pos", F.lit(0).cast("bigint").alias("variant_pos"), F.col("id").cast("string").alias("finding_key")
    )
    for width in (10, 1 << 20):
        kept = cap_findings(findings, 7, width)
        first = kept.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("m")).collect()
        assert all(r.n == 7 for r in first)
        hot = sorted(r.pos for r in findings.filter("rule_id = 'hot'").collect())[6]
        assert {r.rule_id: r.m for r in first}["hot"] == hot


def test_flat_item_with_many_variants(spark):
    """One item owns most variants; facts of siblings reach every variant through split joins."""
    items = spark.createDataFrame([("t", 0, "big", "Big"), ("t", 1, "small", "Small")], "tenant string, pos bigint, id string, title string")
    variants = spark.range(500).select(
        F.lit("t").alias("tenant"), F.when(F.col("id") < 497, "big").otherwise("small").alias("product_id"), F.col("id").alias("variant_pos"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), (F.col("id") % 100 + 1).cast("string").alias("price"),
    )
    c = from_tables(items, variants, hot_rows=20)
    got = {r.id: r for r in c.variants.collect()}
    assert len(got) == 500
    prices = [i % 100 + 1 for i in range(497)]
    assert got["v3"].sib_median_cents == np.median(prices) * 100 and got["v3"].n_variants == 497
    assert got["v499"].sib_priced == 3 and got["v499"].sib_median_cents == 9900
