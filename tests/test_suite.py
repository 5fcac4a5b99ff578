"""The prebuilt suite over the fixture rows: exact sets of checks, shapes, boundaries, suggestions."""

import pytest
from pyspark.sql import functions as F

from catalog_rows import AS_OF, ATTRIBUTE_RULES, EXPECTED, ROWS, dictionary_words, row, variant
from wareproof.operators import summary
from wareproof.operators.item_checks import Limits
from wareproof.operators.registry import META, RULE_IDS
from wareproof.plans.scan import Context, run_checks, scan
from wareproof.schema import ATTRIBUTE_RULE, RECORD
from wareproof.sources.records import from_records

AS_OF_LIT = f"timestamp'{AS_OF:%Y-%m-%d %H:%M:%S}'"


def context(spark, **over):
    parts = dict(
        limits=Limits(as_of=F.expr(AS_OF_LIT)),
        dictionary=spark.createDataFrame([(w, 1) for w in dictionary_words()], "word string, freq int"),
        attribute_rules=spark.createDataFrame(ATTRIBUTE_RULES, ATTRIBUTE_RULE),
    )
    parts.update(over)
    return Context(**parts)


def findings_of(spark, rows, rules=RULE_IDS, **over):
    catalog = from_records(spark.createDataFrame(rows, RECORD))
    return run_checks(catalog, context(spark, **over), rules).collect()


@pytest.fixture(scope="module")
def found(spark):
    return findings_of(spark, ROWS)


def test_exact_checks_per_row(found):
    got = {k: set() for k in EXPECTED}
    for f in found:
        got[f.product_id].add(f.rule_id)
    wrong = {k: (sorted(v), EXPECTED[k]) for k, v in got.items() if sorted(v) != EXPECTED[k]}
    assert not wrong


def test_every_check_fires(found):
    assert {f.rule_id for f in found} == set(RULE_IDS)
    assert len(RULE_IDS) == 61


def test_shapes(found):
    for f in found:
        assert f.product_title is not None and f.severity == META[f.rule_id]["severity"] and f.area == META[f.rule_id]["area"]
        if f.variant_id:
            assert f.variant_title is not None and f.sku is not None
        if f.edit:
            assert f.edit.kind and f.edit.current is not None
    words = {f.word: f.edit.suggested for f in found if f.rule_id == "spelling"}
    assert words == {"queit": "quiet", "cornar": "corner"}


def test_suggestions(found):
    by = {(f.rule_id, f.product_id): f for f in found}
    assert by["title_formatting", "loose-title"].edit.suggested == "Garden Lamp Wide"
    assert by["title_all_caps", "shouting"].edit.suggested == "Ceiling Lamp Large"
    assert by["vendor_repeated_in_title", "brand-twice"].edit.suggested == "Lumina Lamp Edition"
    assert by["emoji_in_title", "party"].edit.suggested == "Party Lamp"
    assert by["price_below_cost", "brand-twice"].edit.suggested == "88.99"
    assert by["zero_price", "spanish"].edit.suggested == "20.00"
    assert by["price_outlier", "copied-meta"].edit.suggested == "22.00"
    assert by["weight_units_mixed", "pounds"].edit.suggested == "1.81"
    assert by["vendor_casing", "acme-c"].edit.suggested == "Acme"
    assert by["vendor_casing", "acme-c"].detail == "Acme / ACME"
    assert by["tag_casing", "acme-b"].edit.suggested == "indoor"
    assert by["missing_product_type", "untyped"].edit.suggested == "Lamps"
    assert by["missing_vendor", "channel"].edit.suggested == "Lumina"
    assert by["option_values_inconsistent", "pounds"].edit.suggested == "Blue"
    assert by["dead_link", "shared-a"].detail == "2 of 2 links"
    assert by["duplicate_sku", "twin-b"].edit.suggested == "cpr-001-2"
    assert by["duplicate_sku", "twin-a"].edit.suggested is None  # keeps what it has
    assert by["description_junk", "spam"].detail == 'raw URL, empty tags, "click here"'
    assert by["draft_stale", "many"].detail == "60 days"
    assert by["missing_sku", "echo"].edit.suggested.startswith("PAPER-LAMP-CLASSIC-")
    assert by["channel_feedback", "channel"].detail == "Market: Code is missing"
    assert by["metafield_pattern", "shared-a"].finding_key == "metafield_pattern|shared-a|||custom.code"
    assert by["language_mismatch", "spanish"].current.startswith("Lámpara")
    assert by["title_casing_outlier", "acme-a"].edit.suggested == "Warm Table Lamp For Cold Days"


def test_casing_suggestions(spark):
    to_title = {
        "warm lamp, blue (large)": "Warm Lamp, Blue (Large)",
        "kids’ lamp for cold days": "Kids’ Lamp For Cold Days",
        "lamp stand for iPhone users": "Lamp Stand For iPhone Users",
        "“warm” lamp for kids": "“Warm” Lamp For Kids",
    }
    rows = ROWS + [row(f"tc-{i}", t) for i, t in enumerate(to_title)]
    got = {f.product_title: f.edit.suggested for f in findings_of(spark, rows, ["title_casing_outlier"])}
    assert {t: got.get(t) for t in to_title} == to_title
    to_sentence = {
        "Warm Lamp, Blue (Large)": "Warm lamp, blue (large)",
        "Kids’ Winter Lamp": "Kids’ winter lamp",
        "USB Cable For Lamps": "USB cable for lamps",
        "Lamp Stand For iPhone Users": "Lamp stand for iPhone users",
        "(Winter) Lamp Blue": "(Winter) lamp blue",
    }
    rows = [row(f"sc-base-{i}", f"Warm lamp for cold days {i}") for i in range(18)]
    rows += [row(f"sc-{i}", t) for i, t in enumerate(to_sentence)]
    got = {f.product_title: f.edit.suggested for f in findings_of(spark, rows, ["title_casing_outlier"])}
    assert got == to_sentence


def test_margin_boundary_and_price_suggestion(spark):
    def priced(key, price, cost):
        return row(key, "Edge Lamp " + key, variants=[variant(key, price=price, cost=cost)])

    rows = [priced("edge", "1.00", "0.90"), priced("thin", "1.00", "0.91")]
    assert [f.product_id for f in findings_of(spark, rows, ["thin_margin"])] == ["thin"]
    for ending, cost in (("99", "100.00"), ("00", "0.90"), ("01", "0.91")):
        profile = spark.createDataFrame(
            [("t1", 1, 1, ending, "", [])],
            "tenant string, n_items bigint, n_variants_all bigint, price_ending string, common_vendor string, "
            "attribute_rules array<struct<full_key: string, name: string, type: string, required: boolean, "
            "pattern: string, product_type: string, usable: boolean>>",
        )
        (low,) = findings_of(spark, [priced("low", "0.50", cost)], ["price_below_cost"], profile=profile)
        assert low.edit.suggested.endswith(ending)
        again = findings_of(
            spark, [priced("again", low.edit.suggested, cost)], ["price_below_cost", "thin_margin"], profile=profile
        )
        assert not again


def test_media_wording(spark):
    rows = [row("video", "Video Lamp", images=[], media_count=1), row("one", "One Lamp", images=[dict(id="i", alt=None, width=900, height=900)], media_count=1)]
    got = {f.product_id: (f.rule_id, f.current) for f in findings_of(spark, rows, ["few_images", "missing_image"])}
    assert got == {"video": ("few_images", "1 media item, no image"), "one": ("few_images", "1 image")}


def test_edges(spark):
    assert findings_of(spark, []) == []
    bare = [r for r in ROWS if r["id"] == "bare"]
    assert sorted({f.rule_id for f in findings_of(spark, bare)}) == EXPECTED["bare"]
    plain = Context(limits=Limits(as_of=F.expr(AS_OF_LIT)))
    assert run_checks(from_records(spark.createDataFrame(ROWS[:3], RECORD)), plain).count() > 0


def test_summary(spark, found):
    catalog = from_records(spark.createDataFrame(ROWS, RECORD))
    result = scan(catalog, context(spark))
    (s,) = result.summary.collect()
    dirty = {f.product_id for f in found}
    assert (s.total, s.open, s.clean) == (len(ROWS), len(found), len(ROWS) - len(dirty))
    weight = {"high": 3, "medium": 1.5, "low": 0.5}
    lost = sum(min(10, sum(weight[f.severity] for f in found if f.product_id == k)) for k in dirty)
    assert s.score == int(100 - lost / len(ROWS) * 10 + 0.5)
    status = summary.check_status(
        catalog.items, result.findings, attribute_rules=spark.createDataFrame(ATTRIBUTE_RULES, ATTRIBUTE_RULE)
    ).collect()
    assert len(status) == 61 and {r.status for r in status} == {"failed"}
    assert sum(r["count"] for r in status) == len(found)


def test_tenants_do_not_mix(spark, found):
    """Scanning two tenants together finds in each what scanning it alone finds."""
    ids = {"acme-a", "acme-b", "acme-c", "twin-b", "pounds", "bare", "channel"}
    other = [dict(r, tenant="t2") for r in ROWS if r["id"] in ids]
    rules = spark.createDataFrame([*ATTRIBUTE_RULES, ("t2", *ATTRIBUTE_RULES[0][1:])], ATTRIBUTE_RULE)
    both = findings_of(spark, ROWS + other, attribute_rules=rules)
    key = lambda f: repr((f.finding_key, f.detail, f.edit))
    assert sorted(key(f) for f in both if f.tenant == "t1") == sorted(map(key, found))
    alone = findings_of(spark, other, attribute_rules=rules)
    assert sorted(key(f) for f in both if f.tenant == "t2") == sorted(map(key, alone))
