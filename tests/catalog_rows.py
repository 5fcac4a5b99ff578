"""A small lamp shop: one clean row, and rows that each break a few checks on purpose.

``EXPECTED`` lists exactly the checks every row must trigger. Catalog-wide checks are planned across
the whole list: most titles are in Title Case, vendor Lumina, type Lamps, tag indoor, kilograms.
"""

from __future__ import annotations

import datetime as dt
import re

AS_OF = dt.datetime(2024, 6, 1, 12, 0, 0)


def days_ago(n):
    return AS_OF - dt.timedelta(days=n)


def gtin13(n):
    body = f"5901234{n:05d}"
    total = sum(int(d) * (1 if i % 2 == 0 else 3) for i, d in enumerate(body))
    return body + str(-total % 10)


TEXT = (
    "This quiet lamp fills the room with warm light and stands on a solid base, with a cable that is "
    "long enough for any corner of your home today."
)
META = "Quiet lamp with a solid base and a long cable, for warm light in any room."
PLAIN_WORDS = (TEXT + " " + META).lower()

counter = [0]
ROWS = []
EXPECTED = {}


def variant(key, **over):
    counter[0] += 1
    n = counter[0]
    row = dict(
        id=f"v-{key}-{n}", title="Default Title", sku=f"L-{n}", barcode=gtin13(n), price="199.99",
        compare_at_price=None, cost="100.00", inventory_policy="DENY", inventory_quantity=5,
        updated_at=days_ago(10), locations=1, tracked=True, requires_shipping=None,
        inventory_item_id=f"stock-{key}-{n}", weight=2.0, weight_unit="KILOGRAMS",
    )
    row.update(over)
    return row


def images(key, n, width=1200, height=1200):
    return [dict(id=f"img-{key}-{i}", alt=None, width=width, height=height) for i in range(n)]


def option(key, name, values):
    return dict(id=f"opt-{key}", name=name, values=values, value_ids=[f"val-{key}-{i}" for i in range(len(values))])


def code(value):
    return [dict(key="custom.code", name="Code", type="single_line_text_field", value=value)]


def row(key, title, **over):
    counter[0] += 1
    n = counter[0]
    variants = over.pop("variants", None)
    if variants is None:
        variants = [variant(key)]
    base = dict(
        tenant="t1", pos=n, id=key, title=title, handle=re.sub("[^a-z0-9]+", "-", title.lower()).strip("-"),
        status="ACTIVE", created_at=days_ago(400), updated_at=days_ago(10), published_at=days_ago(10),
        total_inventory=5, variants_count=len(variants), collection_count=1, collection_ids=["c1"],
        vendor="Lumina", product_type="Lamps", tags=["indoor"],
        description_html=f"<p>{TEXT} Model {n} of the line.</p>", seo_title=title, seo_description=META,
        category=dict(id="cat-1", name="Lamps", full_name="Home > Lamps", is_leaf=True, level=2),
        publications=2, publications_ok=2, channel_issues=[], options=[option(key, "Title", ["Default Title"])],
        metafields=code("ABC-1234"), media_count=None, images=images(key, 2), variants=variants,
    )
    base.update(over)
    return base


def add(key, title, *expected, **over):
    ROWS.append(row(key, title, **over))
    EXPECTED[key] = sorted(expected)


add("empty-text", "Desk Lamp Slim", "missing_description", "meta_description_missing", "missing_image",
    description_html="", seo_description="", images=[])
add("stub-text", "Floor Lamp Tall", "placeholder_text", "few_images",
    description_html="<div>More about this lamp is coming soon, and the whole text will be here when the "
    "first box of this line arrives at our home in the corner.</div>", images=images("stub-text", 1))
add("typos", "Wall Lamp Round", "spelling",
    description_html=f"<p>{TEXT.replace('quiet', 'queit').replace('corner', 'cornar')} Model x of the line.</p>")
add("shouting", "CEILING LAMP LARGE", "title_all_caps")
add("endless-title", "Warm Reading Lamp With A Solid Base And A Long Cable For Any Room Or Corner At Home",
    "title_too_long", "small_image", seo_title="Warm Reading Lamp",
    images=images("endless-title", 1, 600, 400) + images("endless-title", 1))
add("endless-seo", "Table Lamp Blue", "seo_title_too_long", seo_title="Table Lamp Blue " * 4 + "Home")
add("loose-title", "Garden  Lamp Wide!!", "title_formatting", seo_title="Garden Lamp Wide")
add("echo", "Paper Lamp Classic", "description_is_title", "short_description", "missing_sku",
    description_html="<p>Paper Lamp&nbsp;Classic</p>", options=[option("echo", "Color", ["Blue", "Red"])],
    variants=[variant("echo", title="Blue", sku=""), variant("echo", title="Red", sku="  ")])
add("spam", "Porch Lamp Yellow", "description_junk", "missing_barcode",
    description_html=f"<p>Click here for this lamp. {TEXT} https://example.org/lamp</p><p> </p>",
    variants=[variant("spam", barcode="")])
add("novel", "Stone Lamp Black", "description_too_long", "barcode_invalid",
    description_html=f"<p>{' '.join([TEXT] * 90)}</p>", variants=[variant("novel", barcode="4006381333930")])
add("spanish", "Glass Lamp Green", "language_mismatch", "zero_price",
    description_html="<p>" + "Lámpara de mesa muy cálida para leer por la noche con luz suave y un cable largo. " * 3 + "</p>",
    options=[option("spanish", "Color", ["Blue", "Red"])],
    variants=[variant("spanish", title="Blue", price="0", cost="10.00"), variant("spanish", title="Red", price="20.00", cost="10.00")])
add("brand-twice", "Lumina Lamp Lumina Edition", "vendor_repeated_in_title", "price_below_cost",
    variants=[variant("brand-twice", price="50.00", cost="80.00")])
add("party", "Party Lamp \U0001F389", "emoji_in_title", "thin_margin", seo_title="Party Lamp",
    variants=[variant("party", price="105.00", cost="100.00")])
add("no-seo", "Brass Lamp Red", "seo_title_missing", "deep_discount", seo_title=" ",
    variants=[variant("no-seo", price="10.00", compare_at_price="100.00", cost="5.00")])
add("endless-meta", "Oak Lamp Warm", "meta_description_too_long", "stale_sale", seo_description=META + " " + META + " " + META[:30],
    variants=[variant("endless-meta", price="150.00", compare_at_price="200.00", updated_at=days_ago(120))])
add("copied-handle", "Ring Lamp Second", "handle_junk", "compare_at_not_higher", handle="copy-of-ring-lamp",
    variants=[variant("copied-handle", compare_at_price="150.00")])
add("copied-meta", "Linen Lamp Blue", "meta_copies_description", "price_outlier",
    seo_description=TEXT[:60] + "...", options=[option("copied-meta", "Size", ["Small", "Medium", "Large"])],
    variants=[variant("copied-meta", title=t, price=p, cost="10.00") for t, p in (("Small", "20.00"), ("Medium", "22.00"), ("Large", "200.00"))])
add("weightless", "Clip Lamp Brown", "missing_cost", "missing_weight", variants=[variant("weightless", cost=None, weight=0.0)])
add("pounds", "Soft Lamp Cover", "option_values_inconsistent", "weight_units_mixed",
    options=[option("pounds", "Color", ["Blue", "blue"])],
    variants=[variant("pounds", title="Blue"), variant("pounds", title="blue", weight=4.0, weight_unit="POUNDS")])
add("many", "Lamp Every Size", "too_many_variants", "draft_stale", variants_count=101, status="DRAFT",
    updated_at=days_ago(60), published_at=None)
add("sold-out", "Beach Lamp Tan", "active_no_stock", "no_collection", total_inventory=0, collection_count=0,
    collection_ids=[], variants=[variant("sold-out", inventory_quantity=0)])
add("below-zero", "Cable Lamp Black", "negative_inventory", "not_published", published_at=None, publications=1,
    publications_ok=1, total_inventory=2, options=[option("below-zero", "Size", ["Small", "Large"])],
    variants=[variant("below-zero", title="Small"), variant("below-zero", title="Large", inventory_quantity=-3)])
add("nowhere", "Rain Lamp Green", "no_location", "unpublished_everywhere", published_at=None, publications=0,
    publications_ok=0, variants=[variant("nowhere", locations=0)])
add("channel", "Leather Lamp Brown", "channel_feedback", "missing_vendor", vendor="",
    channel_issues=[dict(app="Market", messages=["Code is missing"])])
add("untyped", "Paper Lamp Green", "missing_product_type", "no_tags", product_type="", tags=[])
add("uncategorized", "Cork Lamp Red", "category_missing", category=None)
add("acme-a", "Warm table lamp for cold days", "title_casing_outlier", vendor="Acme")
add("acme-b", "Corner Lamp Blue", "tag_casing", vendor="Acme", tags=["Indoor"])
add("acme-c", "Base Lamp Blue", "vendor_casing", "product_type_casing", vendor="ACME", product_type="lamps")
SHARED = '<p>This paper lamp gives warm light in any room of your home, see <a href="#">the line</a> or <a>more</a> below.</p>'
SHARED = SHARED.replace("below", "of it below, with a long cable and a solid base")
add("shared-a", "Shade Lamp Red", "duplicate_description", "dead_link", "metafield_pattern", description_html=SHARED, metafields=code("abc"))
add("shared-b", "Shade Lamp Green", "duplicate_description", "dead_link", "metafield_required", description_html=SHARED, metafields=code(""))
add("shared-c", "Shade Lamp Blue", "duplicate_description", "dead_link", description_html=SHARED)
TWINS = ("duplicate_sku", "duplicate_barcode", "duplicate_title", "seo_title_competing")
add("twin-a", "Copper Lamp Classic", *TWINS, variants=[variant("twin-a", sku="CPR-001", barcode="4006381333931")])
add("twin-b", "Copper Lamp Classic", *TWINS, variants=[variant("twin-b", sku="cpr-001", barcode="4006381 333931")])
add("bare", "Plain Lamp Shade", "missing_description", "missing_image", "seo_title_missing", "no_tags", "missing_vendor",
    "missing_product_type", "category_missing", "metafield_required", variants=[], images=[], description_html=None,
    options=[], tags=[], vendor=None, product_type=None, category=None, publications=None, publications_ok=None,
    handle=None, seo_title="", metafields=[])
add("bare-variant", "Simple Lamp Shade", "missing_weight", variants=[dict(
    id="v-bare-1", title="Default Title", sku="L-BARE", barcode=gtin13(99999), price="199.99", compare_at_price=None,
    cost=None, inventory_policy="DENY", inventory_quantity=5, updated_at=None, locations=1, tracked=True,
    requires_shipping=None, inventory_item_id=None, weight=0.0, weight_unit="KILOGRAMS")])
for clean in ("Desk Lamp", "Floor Lamp", "Wall Lamp", "Table Lamp", "Garden Lamp", "Ceiling Lamp"):
    add("clean-" + clean.lower().replace(" ", "-"), clean)

ATTRIBUTE_RULES = [("t1", "custom", "code", "Code", "single_line_text_field", True, r"^[A-Z]{3}-\d{4}$", "")]


def dictionary_words():
    """Every word of the fixture texts except the two planted typos."""
    words = set()
    for r in ROWS:
        text = " ".join(str(x) for x in (
            r["title"], r["description_html"], r["seo_title"], r["seo_description"], r["product_type"], *r["tags"],
            *[o["name"] + " " + " ".join(o["values"]) for o in r["options"]]))
        words |= {w.lower() for w in re.findall("[A-Za-z][A-Za-z']+", text)}
    words -= {"queit", "cornar"}
    words |= {"quiet", "corner"}
    return sorted(words)
