"""Plain SQL statements with the same results as the registered queries, for comparison."""

from __future__ import annotations

from wareproof.constants import ENGLISH_STOPWORDS, FOREIGN_WORDS
from wareproof.operators.registry import META, RULE_IDS, disabled_by_preset
from wareproof.plans import bindings as b
from wareproof.plans import queries as q

ITEM = "item AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in b.ITEM) + " FROM part)"
OFFER = (
    "o1 AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in b.OFFER_CENTS) + " FROM lineitem), "
    "offer AS (" + b.as_sql(b.OFFER, "o1") + ")"
)


def cents(c: str) -> str:
    return f"cast(round(cast({c} as decimal(18,2)) * 100) as bigint)"


MEDIAN = "quantile_cont(CASE WHEN pc > 0 THEN pc END, 0.5)"
VARIANT = (
    f"{ITEM}, {OFFER}, v0 AS (SELECT o.*, i.title AS product_title, i.handle AS product_handle, i.pos, "
    f"coalesce({cents('o.price')}, 0) AS pc, {cents('o.compare_at_price')} AS cc, {cents('o.cost')} AS kc "
    "FROM offer o JOIN item i ON i.id = o.product_id), "
    f"s AS (SELECT product_id, count(*) AS n, count(CASE WHEN pc > 0 THEN 1 END) AS priced, {MEDIAN} AS med, "
    "arg_min(CASE WHEN weight > 0 THEN weight END, CASE WHEN weight > 0 THEN variant_pos END) AS donor, "
    "arg_min(CASE WHEN weight > 0 THEN weight_unit END, CASE WHEN weight > 0 THEN variant_pos END) AS donor_unit FROM v0 GROUP BY product_id), "
    "v AS (SELECT v0.*, s.n, s.priced, s.med, s.donor, s.donor_unit FROM v0 JOIN s USING (product_id))"
)
WSQL = r"\s+"
PLAIN = (
    "trim(regexp_replace(replace(regexp_replace(coalesce(description_html, ''), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), "
    r"'\s+', ' ', 'g'))"
)


def text_base(name: str, columns, source: str) -> str:
    return (
        f"{name}0 AS ({b.as_sql(columns, source)}), {name}1 AS (SELECT *, {PLAIN} AS plain FROM {name}0), "
        f"{name} AS (SELECT *, lower(plain) AS low, CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END AS words FROM {name}1)"
    )


DOC = text_base("doc", b.DOC, "documents")
PAGE = text_base("page", b.PAGE, "pages")


def norm(c: str) -> str:
    return rf"regexp_replace(lower(trim(coalesce({c}, ''))), '\s+', ' ', 'g')"


def first_chars(c: str, n: int) -> str:
    return f"CASE WHEN length(trim({c})) > {n} THEN concat(trim(substr(trim({c}), 1, {n})), '…') ELSE trim({c}) END"


def cut(c: str, n: int) -> str:
    """Cut at a word boundary beyond 60% of the limit, else hard, without trailing separators."""
    head = f"substr(trim({c}), 1, {n + 1})"
    at = f"(length({head}) - instr(reverse({head}), ' '))"
    has = f"instr(reverse({head}), ' ') > 0 AND {at} * 10 > {n * 6}"
    return (
        f"CASE WHEN length(trim({c})) <= {n} THEN trim({c}) ELSE "
        rf"regexp_replace(CASE WHEN {has} THEN substr({head}, 1, {at}) ELSE substr({head}, 1, {n}) END, '[\s,;:.\-–]+$', '') END"
    )


def m(c: str) -> str:
    return b.money(c)


def mm(c: str) -> str:
    """Text of a median in cents, which may end in a half."""
    return m(f"cast(floor({c} + 0.5) as bigint)")


def on_item(where: str, **cols: str) -> str:
    extra = "".join(f", {e} AS {n}" for n, e in cols.items())
    return f"WITH {ITEM} SELECT id AS product_id{extra} FROM item WHERE {where}"


def on_variant(where: str, **cols: str) -> str:
    extra = "".join(f", {e} AS {n}" for n, e in cols.items())
    return f"WITH {VARIANT} SELECT product_id, id AS variant_id{extra} FROM v WHERE {where}"


def on_doc(where: str, **cols: str) -> str:
    extra = "".join(f", {e} AS {n}" for n, e in cols.items())
    return f"WITH {DOC} SELECT id AS product_id{extra} FROM doc WHERE {where}"


def on_page(where: str, **cols: str) -> str:
    extra = "".join(f", {e} AS {n}" for n, e in cols.items())
    return f"WITH {PAGE} SELECT id AS product_id{extra} FROM page WHERE {where}"


AS_OF = b.AS_OF
WORDS = r"list_filter(regexp_split_to_array(title, '[\s-]+'), lambda w: regexp_matches(w, '\p{L}'))"
CAPS = rf"list_filter({WORDS}, lambda w: regexp_matches(w, '^[^\p{{L}}]*\p{{Lu}}'))"
CLEANED = r"trim(regexp_replace(trim(regexp_replace(title, '\s{2,}', ' ', 'g')), '[.,;:!?-]+$', ''))"
AGE = f"cast(date_diff('day', coalesce(updated_at, created_at), {AS_OF}) as string)"
IMAGES = (
    "img AS (SELECT id, greatest(image_px + i * 10, 400) AS px FROM item, (VALUES (1), (2), (3)) t(i) WHERE i <= n_images)"
)
MEMBERS = (
    "mem AS (SELECT tenant, id, pos, trim(product_type) AS ty, concat('g', cast(p_size + i as string)) AS coll, i "
    "FROM item, (VALUES (1), (2), (3)) t(i) WHERE i <= collection_count)"
)
TYPES = (
    f"{MEMBERS}, tyc AS (SELECT tenant, coll, ty, count(*) AS c, min(pos) AS f FROM mem GROUP BY ALL), "
    "types AS (SELECT tenant, coll, sum(c) AS n_members, max(CASE WHEN ty <> '' THEN c END) AS top_c, "
    "arg_max(CASE WHEN ty <> '' THEN ty END, CASE WHEN ty <> '' THEN c * 1000000000 - f END) AS top FROM tyc GROUP BY ALL)"
)
ORACLES: dict[str, str] = {}
O = ORACLES

# ---- part ----
O["check_placeholder_text"] = on_item(
    "contains(lower(title), 'coming soon')", detail="'\"coming soon\"'",
    current="CASE WHEN instr(title, 'coming') > 21 THEN concat('…', substr(title, instr(title, 'coming') - 20)) ELSE title END",
)
LETTERS = "regexp_replace(title, '[^A-Za-z]', '', 'g')"
O["check_title_all_caps"] = on_item(
    f"length({LETTERS}) >= 6 AND {LETTERS} = upper({LETTERS})",
    suggested="concat(upper(substr(title, 1, 1)), lower(substr(title, 2, instr(title, ' ') - 1)), "
    "upper(substr(title, instr(title, ' ') + 1, 1)), lower(substr(title, instr(title, ' ') + 2)))",
)
O["check_title_too_long"] = on_item("length(title) > 70", detail="concat(cast(length(title) as string), ' characters')")
O["check_title_formatting"] = on_item(f"{CLEANED} <> title", suggested=CLEANED, apply=f"length({CLEANED}) > 0")
O["check_vendor_repeated_in_title"] = on_item(
    "length(trim(vendor)) >= 3 AND len(list_filter(string_split(lower(title), ' '), lambda w: w = lower(vendor))) >= 2",
    suggested=r"regexp_replace(title, ' \S+$', '')",
)
O["check_emoji_in_title"] = on_item("contains(title, '\U0001F389')", suggested="trim(replace(title, '\U0001F389', ''))")
TAIL = "regexp_extract(handle, '-([0-9]+)$', 1)"
O["check_handle_junk"] = on_item(
    f"regexp_matches(handle, 'copy-of|untitled') OR regexp_matches(handle, '^[0-9]+$') OR ({TAIL} <> '' AND NOT "
    f"ends_with(regexp_replace({norm('title')}, '[^a-z0-9]+$', ''), {TAIL}))", detail="concat('/', handle)",
)
O["check_missing_image"] = on_item("n_images = 0", current="'No images'")
O["check_few_images"] = on_item("n_images = 1", current="'1 image'")
O["check_small_image"] = (
    f"WITH {ITEM}, {IMAGES}, sm AS (SELECT id, count(*) AS n, min(px) AS p FROM img WHERE px < 800 GROUP BY id) "
    "SELECT id AS product_id, concat(cast(n as string), ' image', CASE WHEN n > 1 THEN 's' ELSE '' END, ', smallest ', cast(p as string), 'px') AS detail, "
    "concat(cast(p as string), 'px') AS current FROM sm"
)
O["check_too_many_variants"] = on_item("variants_count > 100", detail="concat(cast(variants_count as string), ' variants')")
O["check_draft_stale"] = on_item(
    f"status = 'DRAFT' AND coalesce(updated_at, created_at) < {AS_OF} - interval '30' day",
    detail=f"concat({AGE}, ' days')", current=f"concat('untouched draft, ', {AGE}, ' days')",
)
O["check_no_collection"] = on_item("status = 'ACTIVE' AND collection_count = 0", current="'in no collection'")
O["check_not_published"] = on_item(
    "status = 'ACTIVE' AND published_at IS NULL AND (publications IS NULL OR publications > 0)", current="'hidden from the online shop'"
)
O["check_unpublished_everywhere"] = on_item("status = 'ACTIVE' AND publications = 0", current="'offered nowhere'")
BROKEN = "concat(cast(publications - publications_ok as string), ' channels out of ', cast(publications as string))"
O["check_channel_feedback"] = on_item(
    "issue_app IS NOT NULL OR publications - publications_ok > 0",
    detail=f"CASE WHEN issue_app IS NOT NULL THEN concat('Market: fix ', id) ELSE {BROKEN} END",
    current=f"CASE WHEN issue_app IS NOT NULL THEN concat('Market: fix ', id) ELSE concat({BROKEN}, ' report errors') END",
)
O["check_missing_vendor"] = on_item("trim(vendor) = ''", suggested="''")
O["check_no_tags"] = on_item("tags_text = ''", current="''")
O["check_category_missing"] = on_item("category_id IS NULL", current="''")
O["check_metafield_required"] = (
    f"WITH {ITEM} SELECT id AS product_id, 'facts.brand' AS field, 'Brand' AS detail FROM item WHERE trim(attr_brand) = '' UNION ALL "
    "SELECT id, 'facts.size', 'Size' FROM item WHERE tenant = 'south' AND lower(trim(product_type)) = 'promo' AND p_size % 5 = 0"
)
O["check_metafield_pattern"] = on_item(
    "trim(attr_brand) <> '' AND NOT regexp_matches(attr_brand, '^Brand#[0-9]$')", field="'facts.brand'",
    detail="concat('Brand = \"', attr_brand, '\"')", current="attr_brand",
)
O["check_missing_product_type"] = (
    f"WITH {ITEM}, {TYPES}, hit AS (SELECT mem.id, arg_min(types.top, mem.i) AS s FROM mem JOIN types USING (tenant, coll) "
    "WHERE types.top_c >= 3 GROUP BY mem.id) SELECT item.id AS product_id, coalesce(hit.s, '') AS suggested "
    "FROM item LEFT JOIN hit ON hit.id = item.id WHERE trim(product_type) = ''"
)
O["check_option_values_inconsistent"] = on_item(
    "lower(color_a) = lower(color_b)", detail="concat('Color: ', color_a, ' / ', color_b)", suggested="color_a"
)

# ---- lineitem ----
CODE = "trim(regexp_replace(upper({0}), '[^A-Z0-9]+', '-', 'g'), '-')"
O["check_missing_sku"] = on_variant(
    "trim(sku) = ''",
    suggested=f"concat({CODE.format('product_handle')}, CASE WHEN title = 'Default Title' THEN '' ELSE concat('-', {CODE.format('title')}) END)",
)
O["check_missing_barcode"] = on_variant("trim(barcode) = ''", detail="title")
GTIN = " + ".join(f"try_cast(substr(lpad(barcode, 14, '0'), {i + 1}, 1) as int) * {3 if i % 2 == 0 else 1}" for i in range(13))
O["check_barcode_invalid"] = on_variant(
    f"length(barcode) IN (12, 13, 14) AND (10 - ({GTIN}) % 10) % 10 <> try_cast(right(barcode, 1) as int)",
    detail="concat(title, ': ', barcode)",
)
O["check_missing_weight"] = on_variant(
    "NOT weight > 0 AND requires_shipping",
    suggested="CASE WHEN inventory_item_id IS NULL THEN NULL WHEN donor IS NULL THEN '' ELSE cast(cast(donor as bigint) as string) END",
    apply="CASE WHEN inventory_item_id IS NULL THEN false ELSE donor IS NOT NULL END",
)
O["check_zero_price"] = on_variant("pc = 0", suggested=f"coalesce({mm('med')}, '')")
O["check_compare_at_not_higher"] = on_variant(
    "cc <= pc", detail=f"concat(title, ': ', {m('cc')}, ' vs ', {m('pc')})", current=f"concat('compare-at ', {m('cc')}, ' vs price ', {m('pc')})"
)
O["check_missing_cost"] = on_variant("kc IS NULL AND inventory_item_id IS NOT NULL", detail="title")
PRICE_COST = f"concat('price ', {m('pc')}, ', cost ', {m('kc')})"
MICRO = "((kc * 200000 + 9) // 18)"
TARGET = f"(({MICRO} + 9999) // 10000)"
ENDING = (
    "e0 AS (SELECT tenant, lpad(cast(pc % 100 as string), 2, '0') AS ending, count(*) AS c, min(pos * 1000000000 + variant_pos) AS f "
    "FROM v0 WHERE pc > 0 GROUP BY ALL), "
    "e AS (SELECT tenant, CASE WHEN sum(c) >= 10 THEN arg_max(ending, cast(c as hugeint) * 1000000000000000 - f) ELSE '99' END AS ending FROM e0 GROUP BY tenant)"
)
BASE_PRICE = f"({TARGET} - {TARGET} % 100 + cast(e.ending as bigint))"
O["check_price_below_cost"] = (
    f"WITH {VARIANT}, {ENDING} SELECT product_id, id AS variant_id, concat(title, ': ', {PRICE_COST}) AS detail, "
    + m(f"(CASE WHEN {BASE_PRICE} < {TARGET} THEN {BASE_PRICE} + 100 ELSE {BASE_PRICE} END)")
    + " AS suggested FROM v JOIN e USING (tenant) WHERE pc > 0 AND pc < kc"
)
O["check_thin_margin"] = on_variant(
    "pc > 0 AND pc >= kc AND (pc - kc) * 10 < pc",
    detail=f"concat(title, ': ', {PRICE_COST}, ' (', cast(((pc - kc) * 200 + pc) // (pc * 2) as string), '% margin)')",
)
O["check_deep_discount"] = on_variant(
    "pc > 0 AND cc > pc AND pc * 5 < cc",
    detail=f"concat(title, ': ', {m('pc')}, ' was ', {m('cc')}, ' (', cast(((cc - pc) * 200 + cc) // (cc * 2) as string), '% off)')",
)
O["check_stale_sale"] = on_variant(
    f"cc > pc AND updated_at < {AS_OF} - interval '90' day", detail=f"concat(title, ': ', {m('pc')}, ' was ', {m('cc')})",
    current="concat('on sale since ', strftime(updated_at, '%Y-%m-%d'))",
)
O["check_price_outlier"] = on_variant(
    "priced >= 3 AND pc > 0 AND (pc > med * 5 OR pc * 5 < med)",
    detail=f"concat(title, ': ', {m('pc')}, ', others around ', {mm('med')})", suggested=mm("med"),
)
O["check_negative_inventory"] = on_variant(
    "tracked AND inventory_quantity < 0", detail="concat(title, ': ', cast(inventory_quantity as string))",
    suggested="CASE WHEN inventory_item_id IS NOT NULL THEN '0' END",
)
O["check_no_location"] = on_variant("tracked AND locations = 0", detail="title")

# ---- documents and pages ----
O["check_missing_description"] = on_doc("words = 0", current="''")
O["check_short_description"] = on_doc(
    "words > 0 AND words < 20", detail="concat(cast(words as string), ' words')",
    current=f"concat(cast(words as string), ' words: ', {first_chars('plain', 80)})",
)
O["check_description_too_long"] = on_doc(
    "words > 2000", detail="concat(cast(words as string), ' words')", current="concat(format('{:,}', words), ' words')"
)


def words_in(ws: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in ws) + ")"


ASCII_WORDS = "regexp_extract_all(low, '[a-z'']+')"
LETTERS_ONLY = r"regexp_replace(plain, '[^\p{L}\s]', '', 'g')"
O["check_language_mismatch"] = on_doc(
    f"len({ASCII_WORDS}) >= 30 AND len(list_filter({ASCII_WORDS}, lambda w: w IN {words_in(ENGLISH_STOPWORDS)})) * 100 < len({ASCII_WORDS}) * 4 "
    rf"AND (regexp_matches({LETTERS_ONLY}, '[^A-Za-z\s]') OR len(list_filter(string_split(lower({LETTERS_ONLY}), ' '), lambda w: w IN {words_in(FOREIGN_WORDS)})) >= 2)",
    current=first_chars("plain", 80),
)
O["check_description_is_title"] = on_doc(f"low <> '' AND low = {norm('title')}", current="plain")
SEO_NORM = norm("seo_description")
O["check_meta_copies_description"] = on_doc(
    rf"length({SEO_NORM}) >= 40 AND low <> '' AND starts_with(low, regexp_replace({SEO_NORM}, '\.{{3}}$', ''))", current="seo_description"
)
O["check_meta_description_missing"] = on_doc(f"{SEO_NORM} = ''", suggested=cut("plain", 155), apply=f"({cut('plain', 155)}) <> ''")
O["check_meta_description_too_long"] = on_doc(
    "length(seo_description) > 160", detail="concat(cast(length(seo_description) as string), ' characters')",
    suggested=cut("seo_description", 160),
)
A_TAGS = (
    r"list_filter(regexp_extract_all(description_html, '(?i)<a\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhref\s*=') "
    r"OR NOT regexp_matches(t, '(?i)\b(name|id)\s*='))"
)
HREF = r"""trim(concat(regexp_extract(t, '(?i)\bhref\s*=\s*"([^"]*)"', 1), regexp_extract(t, '(?i)\bhref\s*=\s*''([^'']*)''', 1), regexp_extract(t, '(?i)\bhref\s*=\s*([^\s>"'']+)', 1)))"""
DEAD = rf"list_filter({A_TAGS}, lambda t: {HREF} = '' OR regexp_matches({HREF}, '(?i)^(#|javascript:)'))"
O["check_dead_link"] = on_page(
    f"len({DEAD}) > 0", detail=f"concat(cast(len({DEAD}) as string), ' of ', cast(len({A_TAGS}) as string), ' links')"
)
EMPTY = " OR ".join(
    rf"regexp_matches(description_html, '(?i)<{t}(\s[^>]*)?>(\s|&nbsp;|<br\s*/?>)*</{t}>')"
    for t in ("p", "div", "span", "h0", "h1", "h2", "h3", "h4", "h5", "h6", "h7", "h8", "h9")
)
URL_HIT = r"regexp_matches(plain, '(?i)https?://\S+')"
O["check_description_junk"] = on_page(
    f"{URL_HIT} OR {EMPTY} OR contains(low, 'click here') OR contains(low, 'buy now!!!') OR contains(low, 'best price guaranteed')",
    detail=f"array_to_string(list_filter([CASE WHEN {URL_HIT} THEN 'raw URL' END, CASE WHEN {EMPTY} THEN 'empty tags' END, "
    "CASE WHEN contains(low, 'click here') THEN '\"click here\"' WHEN contains(low, 'buy now!!!') THEN '\"buy now!!!\"' "
    "WHEN contains(low, 'best price guaranteed') THEN '\"best price guaranteed\"' END], lambda x: x IS NOT NULL), ', ')",
)
O["check_seo_title_missing"] = on_page("trim(seo_title) = ''", suggested=cut("title", 50))
O["check_seo_title_too_long"] = on_page(
    "length(seo_title) > 50", detail="concat(cast(length(seo_title) as string), ' characters')", suggested=cut("seo_title", 50)
)

# ---- whole catalog ----
O["check_duplicate_sku"] = (
    f"WITH {VARIANT}, d AS (SELECT *, trim(sku) AS k, count(*) OVER w AS n2, row_number() OVER (PARTITION BY tenant, upper(trim(sku)) ORDER BY pos, variant_pos, id) AS rn "
    "FROM v0 WHERE trim(sku) <> '' WINDOW w AS (PARTITION BY tenant, upper(trim(sku)))) "
    "SELECT product_id, id AS variant_id, concat(title, ': ', k, ' used ', cast(n2 as string), ' times') AS detail, "
    "CASE WHEN rn = 1 THEN NULL ELSE concat(k, '-', cast(rn as string)) END AS suggested, rn > 1 AS apply FROM d WHERE n2 >= 2"
)
O["check_duplicate_barcode"] = (
    f"WITH {VARIANT}, d AS (SELECT *, count(*) OVER (PARTITION BY tenant, upper(regexp_replace(barcode, '[\\s-]', '', 'g'))) AS n2 FROM v0 WHERE trim(barcode) <> '') "
    "SELECT product_id, id AS variant_id, concat(title, ': ', trim(barcode), ' used ', cast(n2 as string), ' times') AS detail FROM d WHERE n2 >= 2"
)
O["check_weight_units_mixed"] = (
    f"WITH {VARIANT}, c AS (SELECT tenant, weight_unit, count(*) AS c, min(pos * 1000000000 + variant_pos) AS f FROM v0 WHERE weight > 0 GROUP BY ALL), "
    "t AS (SELECT tenant, arg_max(weight_unit, cast(c as hugeint) * 1000000000000000 - f) AS maj, max(c) AS top, sum(c) AS n, count(*) AS units FROM c GROUP BY tenant) "
    "SELECT product_id, id AS variant_id, concat(title, ': ', cast(cast(weight as bigint) as string), ' ', lower(weight_unit), ', usual here: ', lower(maj)) AS detail, "
    "CASE WHEN inventory_item_id IS NOT NULL THEN cast(cast(round(weight * CASE weight_unit WHEN 'POUNDS' THEN 0.45359237 ELSE 1.0 END / "
    "CASE maj WHEN 'POUNDS' THEN 0.45359237 ELSE 1.0 END, 2) as decimal(18,2)) as string) END AS suggested "
    "FROM v0 JOIN t USING (tenant) WHERE weight > 0 AND weight_unit <> maj AND units >= 2 AND n >= 10 AND top * 100 >= n * 80"
)
O["check_duplicate_title"] = (
    f"WITH {ITEM}, d AS (SELECT id, count(*) OVER (PARTITION BY tenant, {norm('title')}) AS n FROM item) "
    "SELECT id AS product_id, concat(cast(n as string), ' products') AS detail FROM d WHERE n >= 2"
)
O["check_title_casing_outlier"] = (
    f"WITH {ITEM}, st AS (SELECT *, len({CAPS}) * 5 >= len({WORDS}) * 4 AS tc FROM item WHERE len({WORDS}) >= 2), "
    "t AS (SELECT tenant, count(*) AS n, count(CASE WHEN tc THEN 1 END) AS y FROM st GROUP BY tenant) "
    "SELECT id AS product_id, 'others are in sentence case' AS detail, "
    "CASE WHEN title = upper(title) THEN title ELSE concat(upper(substr(title, 1, 1)), lower(substr(title, 2))) END AS suggested, "
    "title <> upper(title) AS apply FROM st JOIN t USING (tenant) WHERE tc AND n >= 10 AND y * 100 <= n * 25"
)


def casing(column: str) -> str:
    return (
        f"WITH {ITEM}, s AS (SELECT tenant, trim({column}) AS raw, {norm(column)} AS k, count(*) AS n, min(pos) AS f FROM item "
        f"WHERE trim({column}) <> '' GROUP BY ALL), g AS (SELECT tenant, k, arg_max(raw, n * 1000000000 - f) AS keep, "
        "array_to_string(list(raw ORDER BY f), ' / ') AS spellings, count(*) AS c FROM s GROUP BY ALL) "
        f"SELECT id AS product_id, spellings AS detail, keep AS suggested FROM item JOIN g ON g.tenant = item.tenant AND g.k = {norm(column)} "
        f"WHERE c > 1 AND trim({column}) <> keep"
    )


O["check_vendor_casing"] = casing("vendor")
O["check_product_type_casing"] = casing("product_type")
O["check_tag_casing"] = (
    f"WITH {ITEM}, t0 AS (SELECT tenant, id, pos, string_split(tags_text, ' ') AS ts FROM item WHERE tags_text <> ''), "
    "t AS (SELECT tenant, id, pos, unnest(ts) AS tag, generate_subscripts(ts, 1) AS i FROM t0), "
    "s AS (SELECT tenant, tag, lower(tag) AS k, count(*) AS n, min(pos * 100 + i) AS f FROM t GROUP BY ALL), "
    "g AS (SELECT tenant, k, arg_max(tag, n * 1000000000 - f) AS keep, count(*) AS c FROM s GROUP BY ALL), "
    "j AS (SELECT t.*, CASE WHEN c > 1 THEN keep ELSE tag END AS fixed FROM t JOIN g ON g.tenant = t.tenant AND g.k = lower(tag)) "
    "SELECT id AS product_id, string_agg(tag, ', ' ORDER BY i) FILTER (WHERE tag <> fixed) AS detail, string_agg(fixed, ', ' ORDER BY i) AS suggested "
    "FROM j GROUP BY id HAVING count(CASE WHEN tag <> fixed THEN 1 END) > 0"
)
O["check_duplicate_description"] = (
    f"WITH {DOC}, d AS (SELECT *, count(*) OVER (PARTITION BY tenant, low) AS n FROM doc WHERE length(low) >= 40) "
    f"SELECT id AS product_id, concat('shared by ', cast(n as string), ' products') AS detail, "
    f"concat({first_chars('plain', 80)}, ' · shared by ', cast(n as string)) AS current FROM d WHERE n >= 3"
)
O["check_seo_title_competing"] = (
    f"WITH {PAGE}, d AS (SELECT *, count(*) OVER (PARTITION BY tenant, {norm('seo_title')}) AS n FROM page WHERE {norm('seo_title')} <> '') "
    f"SELECT id AS product_id, concat(cast(n as string), ' products') AS detail, {cut('title', 60)} AS suggested FROM d WHERE n >= 2"
)
O["suite_row_findings"] = (
    "WITH f AS ("
    + " UNION ALL ".join(
        f"SELECT '{r}' AS rule_id, product_id FROM ({O['check_' + r]})" for r in q.ON_PART
    )
    + f"), i AS (SELECT cast(p_partkey as string) AS id, {b.tenant_of('p_partkey')} AS tenant FROM part), "
    + "meta(rule_id, area, severity) AS (VALUES " + ", ".join(f"('{r}', '{META[r]['area']}', '{META[r]['severity']}')" for r in q.ON_PART) + ") "
    + "SELECT tenant, rule_id, area, severity, count(*) AS n FROM f JOIN i ON i.id = f.product_id JOIN meta USING (rule_id) GROUP BY ALL"
)
O["suite_variant_findings"] = (
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, product_id FROM ({O['check_' + r]})" for r in q.ON_OFFER)
    + f"), i AS (SELECT cast(p_partkey as string) AS id, {b.tenant_of('p_partkey')} AS tenant FROM part) "
    + "SELECT tenant, rule_id, count(*) AS n, count(DISTINCT product_id) AS items FROM f JOIN i ON i.id = f.product_id GROUP BY ALL"
)
O["peer_outlier_by_part"] = (
    "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint) AS amount FROM lineitem), "
    "s AS (SELECT l_partkey, count(*) AS peers, quantile_cont(amount, 0.5) AS median FROM l WHERE amount > 0 GROUP BY l_partkey) "
    "SELECT l.*, peers, cast(median as double) AS median FROM l JOIN s USING (l_partkey) WHERE peers >= 3 AND (amount > median * 5 OR amount * 5 < median)"
)

# ---- spelling ----
DICT = (
    "dict AS (SELECT word, count(*) AS freq FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z'']+'), "
    "lambda w: length(w) >= 4))) AS word FROM documents WHERE lang = 'en') GROUP BY word HAVING count(*) >= 5)"
)
UNKNOWN = (
    f"{DOC}, {DICT}, tok0 AS (SELECT id, tenant, 1 AS fp, 'Description' AS field, regexp_extract_all(regexp_replace(plain, '(?i)\\b(?:https?://|www\\.)\\S+|\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+', ' ', 'g'), '[A-Za-z][A-Za-z'']+') AS ws FROM doc "
    "UNION ALL SELECT id, tenant, 3, 'SEO description', regexp_extract_all(seo_description, '[A-Za-z][A-Za-z'']+') FROM doc), "
    "tok AS (SELECT id, tenant, fp, field, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM tok0), "
    "unk AS (SELECT id, any_value(tenant) AS tenant, word, min(fp * 1000000 + i) AS i, arg_min(field, fp * 1000000 + i) AS field FROM tok WHERE length(word) >= 4 AND word = lower(word) "
    "AND word NOT IN (SELECT word FROM dict) GROUP BY id, word), "
    "mis AS (SELECT id, tenant, word, field FROM unk)"
)
O["check_spelling"] = f"WITH {UNKNOWN} SELECT id AS product_id, word, field FROM mis"
O["learn_word"] = (
    f"WITH {UNKNOWN} SELECT id AS product_id, word FROM mis WHERE tenant <> 'en' OR word NOT IN "
    "(SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z'']+'))) FROM benchmark)"
)
O["trusted_names"] = (
    f"WITH {PAGE}, {DICT}, w AS (SELECT DISTINCT tenant, id, unnest(list_concat(regexp_extract_all(title, '[A-Za-z][A-Za-z'']+'), "
    "regexp_extract_all(seo_title, '[A-Za-z][A-Za-z'']+'))) AS word FROM page), "
    "n AS (SELECT tenant, lower(word) AS word, count(DISTINCT id) AS c FROM w WHERE length(word) >= 4 AND regexp_matches(word, '^[A-Z][a-z'']+$') GROUP BY ALL) "
    "SELECT tenant, word FROM n WHERE c >= 2 AND word NOT IN (SELECT word FROM dict)"
)
O["seed_words"] = (
    f"WITH {ITEM} SELECT DISTINCT tenant, unnest(regexp_extract_all(lower(vendor), '[a-z][a-z'']+')) AS word FROM item UNION "
    "SELECT DISTINCT tenant, lower(p_type) FROM item"
)

# ---- reads ----
O["normalize_item"] = (
    f"WITH {ITEM}, {IMAGES}, sm AS (SELECT id, count(*) AS n FROM img WHERE px < 800 GROUP BY id) SELECT tenant, item.id AS product_id, title, handle, total_inventory, "
    "variants_count, collection_count, CASE WHEN tags_text = '' THEN 0 ELSE len(string_split(tags_text, ' ')) END AS n_tags, n_images AS n_media, "
    "coalesce(sm.n, 0) AS n_small_images, publications, '-' AS only_sku, CASE WHEN p_size % 5 = 0 THEN '' ELSE cast(p_size as string) END AS size_value "
    "FROM item LEFT JOIN sm ON sm.id = item.id"
)
O["normalize_variant"] = (
    f"WITH {VARIANT} SELECT tenant, product_id, id AS variant_id, {m('pc')} AS price, {m('cc')} AS compare_at, {m('kc')} AS cost, "
    "n AS n_variants, priced AS sib_priced, cast(med as double) AS median FROM v"
).replace(f"{m('cc')} AS compare_at", f"CASE WHEN cc IS NOT NULL THEN {m('cc')} END AS compare_at").replace(
    f"{m('kc')} AS cost", f"CASE WHEN kc IS NOT NULL THEN {m('kc')} END AS cost"
)
O["jsonl_rebuild"] = (
    f"WITH {ITEM}, {IMAGES}, sm AS (SELECT id, count(*) AS n, count(CASE WHEN px < 800 THEN 1 END) AS s FROM img GROUP BY id), "
    "l AS (SELECT cast(l_partkey as string) AS id, count(*) AS n FROM lineitem GROUP BY ALL) "
    "SELECT tenant, item.id AS product_id, title, vendor, coalesce(l.n, 0) AS n_variants, coalesce(sm.n, 0) AS n_media, coalesce(sm.s, 0) AS n_small_images, "
    "CASE WHEN tags_text = '' THEN 0 ELSE len(string_split(tags_text, ' ')) END AS n_tags, false AS any_tracked, "
    "row_number() OVER (PARTITION BY tenant ORDER BY CASE WHEN pos % 4 = 0 THEN 0 ELSE 1 END, CASE WHEN pos % 4 = 0 THEN -pos ELSE pos END) AS place "
    "FROM item LEFT JOIN sm ON sm.id = item.id LEFT JOIN l ON l.id = item.id"
)
O["scan_limit"] = (
    f"WITH {ITEM}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY pos) AS rn, count(*) OVER (PARTITION BY tenant) AS n FROM item) "
    "SELECT tenant, id AS product_id, n AS catalog_total, n > 100 AS truncated FROM r WHERE rn <= 100"
)
O["read_by_ids"] = f"WITH {ITEM} SELECT tenant, id AS product_id, title FROM item WHERE pos IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')"
O["read_new_since"] = (
    f"WITH {ITEM} SELECT tenant, id AS product_id FROM item WHERE created_at >= timestamp '2001-03-01 00:00:00'"
)
O["count_since"] = f"WITH {ITEM} SELECT tenant, count(*) AS count FROM item WHERE created_at >= timestamp '2001-03-01 00:00:00' GROUP BY tenant"
O["tracked_attribute"] = f"WITH {ITEM} SELECT id AS product_id, attr_brand AS brand, '' AS none FROM item"

# ---- profile ----
O["profile_price_ending"] = f"WITH {VARIANT}, {ENDING} SELECT tenant, ending AS price_ending FROM e"
O["profile_common_vendor"] = (
    f"WITH {ITEM}, c AS (SELECT tenant, trim(vendor) AS vn, count(*) AS c, min(pos) AS f FROM item GROUP BY ALL), "
    "t AS (SELECT tenant, sum(c) AS n, arg_max(CASE WHEN vn <> '' THEN vn END, CASE WHEN vn <> '' THEN c * 1000000000 - f END) AS top, max(CASE WHEN vn <> '' THEN c END) AS tc FROM c GROUP BY tenant) "
    "SELECT tenant, cast(n as bigint) AS n_items, CASE WHEN n >= 10 AND tc * 100 > n * 2 THEN top ELSE '' END AS common_vendor FROM t"
)
O["profile_type_by_group"] = (
    f"WITH {ITEM}, {TYPES} SELECT tenant, coll AS collection_id, cast(n_members as bigint) AS n_members, CASE WHEN top_c >= 3 THEN top END AS common_type FROM types"
)

# ---- summaries ----


def findings_sql(rules: list[str], where: str = "true") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{r}' AS rule_id, '{META[r]['area']}' AS area, '{META[r]['severity']}' AS severity, "
        f"{ {'high': 6, 'medium': 3, 'low': 1}[META[r]['severity']]} AS pts, {RULE_IDS.index(r)} AS rpos, product_id"
        f", {'detail' if r in ('handle_junk', 'title_too_long') else 'cast(NULL as string)'} AS detail FROM ({O['check_' + r]})"
        for r in rules
    )
    return (
        f"f0 AS ({parts}), i AS (SELECT cast(p_partkey as string) AS id, p_partkey AS pos, p_brand, p_name, {b.tenant_of('p_partkey')} AS tenant FROM part), "
        f"f AS (SELECT f0.*, tenant, pos, p_brand FROM f0 JOIN i ON i.id = f0.product_id WHERE {where})"
    )


BASE = findings_sql(q.BASE_RULES)
OFF = {"north": ["few_images", "no_tags"], "south": disabled_by_preset("essential")}
NOT_OFF = " AND ".join(f"NOT (tenant = '{t}' AND rule_id IN {words_in(rs)})" for t, rs in OFF.items())
IGNORED = "(rule_id = 'few_images' AND p_brand = 'Brand#7')"
O["enabled_checks_preset"] = f"WITH {BASE} SELECT tenant, rule_id, count(*) AS n FROM f WHERE {NOT_OFF} GROUP BY ALL"
O["cap_findings"] = (
    f"WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant, rule_id ORDER BY pos) AS rn FROM f) SELECT product_id, tenant, rule_id FROM r WHERE rn <= 100"
)
O["apply_ignores"] = f"WITH {BASE} SELECT product_id, rule_id FROM f WHERE NOT {IGNORED}"
O["ignored_counts"] = f"WITH {BASE} SELECT tenant, count(*) AS ignored FROM f WHERE {IGNORED} GROUP BY tenant"


def score_sql(where: str = "true", base: str = BASE) -> str:
    return (
        f"WITH {base}, p AS (SELECT tenant, product_id, least(20, sum(pts)) AS lost, count(*) AS n FROM f WHERE {where} GROUP BY ALL), "
        "t AS (SELECT tenant, count(*) AS total FROM i GROUP BY tenant), a AS (SELECT tenant, sum(lost) AS lost, count(*) AS dirty, sum(n) AS open FROM p GROUP BY tenant) "
        "SELECT tenant, total, cast(greatest(0, floor(100 - lost * 5.0 / total + 0.5)) as bigint) AS score, total - dirty AS clean, cast(open as bigint) AS open FROM t JOIN a USING (tenant)"
    )


O["quality_score"] = score_sql()
O["failing_rules"] = (
    f"WITH {BASE} SELECT tenant, rule_id, area, severity, rule_id IN ('vendor_casing', 'compare_at_not_higher') AS fixable, count(*) AS count FROM f GROUP BY ALL"
)
STATUS_DIM = ", ".join(f"('{r}')" for r in RULE_IDS)
O["check_status"] = (
    f"WITH {BASE}, d(rule_id) AS (VALUES {STATUS_DIM}), t AS (SELECT DISTINCT tenant FROM i), c AS (SELECT tenant, rule_id, count(*) AS n FROM f WHERE {NOT_OFF} GROUP BY ALL) "
    "SELECT t.tenant, d.rule_id, coalesce(n, 0) AS count, CASE WHEN n > 0 THEN 'failed' "
    + " ".join(f"WHEN t.tenant = '{t}' AND d.rule_id IN {words_in(rs)} THEN 'off'" for t, rs in OFF.items())
    + " WHEN d.rule_id IN ('metafield_required', 'metafield_pattern') THEN 'skipped' ELSE 'passed' END AS status "
    "FROM t CROSS JOIN d LEFT JOIN c ON c.tenant = t.tenant AND c.rule_id = d.rule_id"
)
O["severity_by_area_cube"] = (
    f"WITH {BASE} SELECT tenant, area, severity, count(*) AS count FROM f GROUP BY GROUPING SETS ((tenant, area, severity), (tenant, area), (tenant, severity), (tenant))"
)
O["locked_area_counts"] = (
    f"WITH {BASE} SELECT tenant, count(*) AS open, count(CASE WHEN area IN ('media', 'seo') THEN 1 END) AS locked FROM f GROUP BY tenant"
)
TOP = (
    "c AS (SELECT tenant, rule_id, area, severity, count(*) AS count, cast(sum(pts) as bigint) AS weight, min(rpos) AS rpos FROM f {0} GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY weight DESC, count DESC, rpos) AS rank FROM c)"
)
O["top_issues"] = f"WITH {BASE}, {TOP.format('WHERE area <> ' + chr(39) + 'seo' + chr(39))} SELECT tenant, rank, rule_id, area, severity, count, weight FROM r WHERE rank <= 5"
O["search_findings"] = (
    f"WITH {ITEM} SELECT id AS product_id, title AS product_title FROM item WHERE n_images = 1 AND contains(lower(title), 'ring') ORDER BY pos LIMIT 100"
)
O["finding_current_value"] = (
    f"WITH {VARIANT} SELECT 'negative_inventory' AS rule_id, id AS variant_id, cast(inventory_quantity as string) AS value FROM v WHERE tracked AND inventory_quantity < 0 "
    "UNION ALL SELECT 'no_location', id, 'no location holds it' FROM v WHERE tracked AND locations = 0 UNION ALL SELECT 'missing_sku', id, '' FROM v WHERE trim(sku) = ''"
)
FAMILIES = {}
for _r in RULE_IDS:
    FAMILIES.setdefault(META[_r]["family"], []).append(_r)
O["family_counts"] = (
    f"WITH {BASE}, d(rule_id, family, area0) AS (VALUES " + ", ".join(f"('{r}', '{META[r]['family']}', '{META[r]['area']}')" for r in RULE_IDS) + "), "
    f"t AS (SELECT family, min(area0) AS area, count(CASE WHEN rule_id IN {words_in(q.BASE_RULES)} THEN 1 END) AS \"on\", count(*) AS total FROM d GROUP BY family), "
    "n AS (SELECT family, count(*) AS findings FROM f JOIN d USING (rule_id) GROUP BY family) "
    "SELECT family, area, \"on\", total, findings FROM t JOIN n USING (family)"
)

# ---- incremental ----
STORED = (
    f"{BASE}, vc AS ({O['check_vendor_casing']}), old AS (SELECT tenant, rule_id, product_id, concat('old ', coalesce(detail, '')) AS detail FROM f WHERE pos % 10 <> 0), "
    "twin AS (SELECT tenant, 'vendor_casing' AS rule_id, product_id, detail FROM vc JOIN i ON i.id = vc.product_id WHERE pos % 10 <> 0), "
    "gone AS (SELECT tenant, rule_id, concat('x', product_id) AS product_id, detail FROM old WHERE rule_id = 'few_images'), "
    "stored AS (SELECT * FROM old UNION ALL SELECT * FROM twin UNION ALL SELECT * FROM gone), "
    "covered AS (SELECT tenant, id FROM i WHERE pos % 10 <> 0 UNION ALL SELECT tenant, product_id FROM gone), "
    "asked0 AS (SELECT tenant, id FROM i WHERE p_brand = 'Brand#7' OR pos % 41 = 0), "
    "asked AS (SELECT * FROM asked0 UNION ALL SELECT tenant, concat('x', id) FROM asked0)"
)
O["recheck_merge"] = (
    f"WITH {STORED} SELECT product_id, rule_id, detail FROM stored WHERE product_id NOT IN (SELECT id FROM asked) OR (rule_id = 'vendor_casing' AND NOT starts_with(product_id, 'x')) "
    "UNION ALL SELECT product_id, rule_id, detail FROM f WHERE product_id IN (SELECT id FROM asked)"
)
PTS = ", ".join(f"('{r}', { {'high': 6, 'medium': 3, 'low': 1}[META[r]['severity']]})" for r in RULE_IDS)
AFTER = (
    f"{STORED}, after AS (SELECT tenant, product_id, rule_id FROM stored WHERE product_id NOT IN (SELECT id FROM asked) OR (rule_id = 'vendor_casing' AND NOT starts_with(product_id, 'x')) "
    "UNION ALL SELECT tenant, product_id, rule_id FROM f WHERE product_id IN (SELECT id FROM asked)), "
    "now AS (SELECT tenant, id FROM covered WHERE NOT (starts_with(id, 'x') AND id IN (SELECT id FROM asked)) "
    "UNION SELECT tenant, id FROM asked WHERE NOT starts_with(id, 'x'))"
)
O["recheck_summary"] = (
    f"WITH {AFTER}, w(rule_id, pts) AS (VALUES {PTS}), p AS (SELECT tenant, product_id, least(20, sum(pts)) AS lost, count(*) AS n FROM after JOIN w USING (rule_id) GROUP BY ALL), "
    "t AS (SELECT tenant, count(*) AS total FROM now GROUP BY tenant), a AS (SELECT tenant, sum(lost) AS lost, count(*) AS dirty, sum(n) AS open FROM p GROUP BY tenant) "
    "SELECT tenant, total, cast(greatest(0, floor(100 - lost * 5.0 / total + 0.5)) as bigint) AS score, total - dirty AS clean, cast(open as bigint) AS open FROM t JOIN a USING (tenant)"
)
COUNTS = (
    "x AS (SELECT tenant, rule_id, count(*) AS n FROM stored GROUP BY ALL), y AS (SELECT tenant, rule_id, count(*) AS n FROM after GROUP BY ALL) "
    "SELECT tenant, rule_id, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after FROM x FULL JOIN y USING (tenant, rule_id)"
)
O["recheck_rule_counts"] = f"WITH {AFTER}, {COUNTS}"
O["refresh_check_counts"] = (
    "WITH " + AFTER.replace(STORED, STORED + ", listed AS (SELECT tenant, product_id AS id FROM stored WHERE rule_id = 'few_images')").replace("FROM asked", "FROM listed") + f", {COUNTS}"
    + " WHERE rule_id = 'few_images'"
)
O["added_deleted"] = (
    f"WITH {STORED} SELECT tenant, id AS product_id, CASE WHEN starts_with(id, 'x') THEN 'deleted' ELSE 'added' END AS change FROM asked "
    "WHERE (starts_with(id, 'x') AND id IN (SELECT id FROM covered)) OR (NOT starts_with(id, 'x') AND id NOT IN (SELECT id FROM covered))"
)
O["scan_new_merge"] = (
    f"WITH {STORED}, {ITEM}, nw AS (SELECT item.id FROM item WHERE created_at >= timestamp '2001-03-01' AND id NOT IN (SELECT id FROM covered)) "
    "SELECT product_id, rule_id, detail FROM stored WHERE product_id NOT IN (SELECT id FROM nw) UNION ALL SELECT product_id, rule_id, detail FROM f WHERE product_id IN (SELECT id FROM nw)"
)
O["drop_disabled"] = (
    f"WITH a AS ({O['check_metafield_required']}), p AS ({O['check_metafield_pattern']}), i AS (SELECT cast(p_partkey as string) AS id, {b.tenant_of('p_partkey')} AS tenant FROM part) "
    "SELECT product_id, 'metafield_required' AS rule_id, field FROM a UNION ALL SELECT product_id, 'metafield_pattern', field FROM p JOIN i ON i.id = p.product_id WHERE tenant = 'south'"
)
O["mark_saved"] = f"WITH {BASE} SELECT tenant, rule_id, count(CASE WHEN {IGNORED} THEN 1 END) AS marked, count(*) AS n FROM f GROUP BY ALL"
O["ignore_and_unignore"] = (
    f"SELECT {b.tenant_of('p_partkey')} AS tenant, cast(p_partkey as string) AS product_id, CASE WHEN p_partkey % 3 = 0 THEN 'recheck' ELSE 'hidden' END AS state FROM part WHERE p_brand = 'Brand#7'"
)
O["attribute_rule_upsert"] = (
    f"WITH p AS (SELECT {b.tenant_of('p_partkey')} AS tenant, p_brand, p_type FROM part), r AS (SELECT DISTINCT tenant, p_brand AS key FROM p), "
    "c AS (SELECT DISTINCT tenant, CASE WHEN p_type = 'PROMO' THEN 'Brand#3' ELSE p_type END AS key, p_type AS name FROM p WHERE tenant = 'south') "
    "SELECT coalesce(r.tenant, c.tenant) AS tenant, 'brand' AS namespace, coalesce(r.key, c.key) AS key, coalesce(c.name, r.key) AS name, c.key IS NULL AS required, "
    "CASE WHEN c.key IS NULL THEN '' ELSE '^a$' END AS pattern FROM r FULL OUTER JOIN c ON r.tenant = c.tenant AND r.key = c.key"
)

# ---- events ----
CHANGES = (
    f"ev AS (SELECT {b.tenant_of('user_id')} AS tenant, cast(user_id as string) AS product_id, event_type = 'purchase' AS created, ts FROM events), "
    "qu AS (SELECT tenant, product_id, bool_or(created) AS created, min(ts) AS mt FROM ev GROUP BY ALL)"
)
O["stream_pending_queue"] = f"WITH {CHANGES} SELECT tenant, product_id, created, strftime(mt, '%Y-%m-%d %H:%M:%S') AS \"at\" FROM qu"
O["pending_count"] = f"WITH {CHANGES} SELECT tenant, count(*) AS pending FROM qu GROUP BY tenant"
O["drain_pending"] = (
    f"WITH {CHANGES}, k AS (SELECT *, cast(product_id as bigint) % 2 = 0 AND cast(product_id as bigint) IN (SELECT p_partkey FROM part) AS known, "
    "row_number() OVER (PARTITION BY tenant ORDER BY mt, product_id) AS rank FROM qu), h AS (SELECT *, count(CASE WHEN NOT known THEN 1 END) OVER "
    "(PARTITION BY tenant ORDER BY rank ROWS UNBOUNDED PRECEDING) AS nth FROM k) SELECT tenant, product_id, created, known, "
    "CASE WHEN known OR nth <= CASE tenant WHEN 'north' THEN 3 ELSE 20 END THEN 'scan' ELSE 'hold' END AS action FROM h"
)
O["stream_recheck"] = (
    f"WITH {STORED}, {CHANGES}, tq AS (SELECT product_id AS id FROM qu), dead AS (SELECT tq.id FROM tq WHERE id NOT IN (SELECT id FROM i)) "
    "SELECT product_id, rule_id, detail FROM stored WHERE product_id NOT IN (SELECT id FROM tq) OR (rule_id = 'vendor_casing' AND product_id NOT IN (SELECT id FROM dead)) "
    "UNION ALL SELECT product_id, rule_id, detail FROM f WHERE product_id IN (SELECT id FROM tq)"
)
SCANS = (
    "scans AS (SELECT concat('t', cast(user_id % 5 as string)) AS tenant, event_id AS scan_id, 100 + event_id % 7 AS total, cast(round(value * 10) as bigint) AS open, "
    "CASE WHEN event_type = 'error' THEN event_id % 3 ELSE 0 END AS high, event_id % 4 = 0 AS is_full, 101 + event_id % 5 AS catalog_total, ts FROM events), "
    "snap AS (SELECT tenant, cast(ts as date) AS date, arg_min(open, ts) AS open, arg_min(high, ts) AS high, min(ts) AS at FROM scans GROUP BY ALL)"
)
LOG = (
    "lg AS (SELECT concat('t', cast(user_id % 5 as string)) AS tenant, concat('b', cast(event_id // 20 as string)) AS batch_id, "
    "CASE WHEN event_id % 40 < 20 THEN 'vendor_casing' ELSE 'compare_at_not_higher' END AS rule_id, CASE WHEN event_id % 2 = 0 THEN 'vendor' ELSE 'compareAt' END AS field, "
    "event_id, cast(event_id as string) AS target_id, cast(user_id as string) AS product_id, concat('Item ', cast(user_id as string)) AS title, event_type = 'error' AS undone, ts FROM events)"
)
O["daily_snapshot"] = (
    f"WITH {SCANS}, {LOG} SELECT snap.tenant, cast(snap.date as string) AS date, open, high, (SELECT count(*) FROM lg WHERE lg.tenant = snap.tenant AND NOT undone AND lg.ts <= snap.at) AS fixed FROM snap"
)
O["clean_streak"] = (
    f"WITH {SCANS}, d AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY date DESC) AS rn, max(date) OVER (PARTITION BY tenant) AS mx FROM snap), "
    "x AS (SELECT tenant, min(CASE WHEN high <> 0 OR date_diff('day', date, mx) + 1 <> rn THEN rn END) AS stop, count(*) AS n FROM d GROUP BY tenant) "
    "SELECT tenant, coalesce(stop - 1, n) AS days FROM x"
)
O["snapshot_as_of"] = (
    f"WITH {SCANS} SELECT tenant, cast(max(date) as string) AS date, arg_max(open, date) AS open, arg_max(high, date) AS high, cast(0 as bigint) AS fixed FROM snap WHERE date <= date '2024-01-13' GROUP BY tenant"
)
O["weekly_change"] = (
    f"WITH {SCANS}, n AS (SELECT tenant, arg_max(open, ts) AS open FROM scans GROUP BY tenant), w AS (SELECT tenant, arg_max(open, date) AS week_ago FROM snap WHERE date <= date '2024-01-23' GROUP BY tenant) "
    "SELECT tenant, open, week_ago, open - week_ago AS change FROM n LEFT JOIN w USING (tenant)"
)
O["weekly_digest"] = (
    f"WITH {BASE}, {SCANS}, sn AS (SELECT CASE WHEN tenant = 't0' THEN 'north' ELSE 'south' END AS tenant, date, max(open) AS open FROM snap GROUP BY ALL), "
    "w AS (SELECT tenant, arg_max(open, date) AS week_ago FROM sn WHERE date <= date '2024-01-23' GROUP BY tenant), "
    f"{TOP.format('')}, tp AS (SELECT tenant, string_agg(rule_id, ',' ORDER BY rank) AS top FROM r WHERE rank <= 5 GROUP BY tenant), n AS (SELECT tenant, count(*) AS open FROM f GROUP BY tenant) "
    "SELECT tenant, open, week_ago, open - week_ago AS change, top FROM n JOIN w USING (tenant) JOIN tp USING (tenant)"
)
O["scan_trend"] = (
    f"WITH {SCANS}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, scan_id DESC) AS rn FROM scans WHERE is_full) "
    "SELECT tenant, scan_id, total, open, open - lag(open) OVER (PARTITION BY tenant ORDER BY ts, scan_id) AS delta FROM (SELECT tenant, scan_id, total, open, ts, rn FROM r WHERE rn <= 12)"
)
O["scan_trend"] = O["scan_trend"].replace("SELECT *, row_number()", "SELECT tenant, scan_id, total, open + 5 AS open, ts, row_number()")
O["latest_result"] = (
    f"WITH {SCANS} SELECT tenant, arg_max(scan_id, ts) AS scan_id, arg_max(total, ts) AS total, arg_max(open, ts) AS open, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM scans GROUP BY tenant"
)
O["latest_summary"] = (
    f"WITH {SCANS}, l AS (SELECT tenant, arg_max(scan_id, ts) AS scan_id, arg_max(total, ts) AS total, arg_max(open, ts) AS open, arg_max(catalog_total, ts) AS ct FROM scans GROUP BY tenant) "
    "SELECT tenant, scan_id, open, open AS high, ct > total AS truncated FROM l"
)
O["saved_since"] = (
    f"WITH {SCANS}, r AS (SELECT tenant, max(scan_id) AS ref FROM scans WHERE is_full GROUP BY tenant) SELECT tenant, count(CASE WHEN scan_id > ref THEN 1 END) AS saved FROM scans JOIN r USING (tenant) GROUP BY tenant"
)
O["retention"] = (
    f"WITH {SCANS}, a AS (SELECT tenant, scan_id, row_number() OVER (PARTITION BY tenant ORDER BY scan_id DESC) AS rn FROM scans), "
    "b AS (SELECT tenant, scan_id, row_number() OVER (PARTITION BY tenant ORDER BY scan_id DESC) AS rn FROM scans WHERE is_full) "
    "SELECT tenant, scan_id FROM a WHERE rn <= 20 UNION SELECT tenant, scan_id FROM b WHERE rn <= 12"
)
O["tenant_erase"] = f"WITH {SCANS} SELECT tenant, count(*) AS n FROM scans WHERE tenant <> 't3' GROUP BY tenant"
O["store_stats"] = (
    f"WITH {SCANS}, {LOG} SELECT (SELECT count(DISTINCT tenant) FROM scans) AS tenants, (SELECT count(*) FROM scans) AS scans, "
    "(SELECT count(*) FROM lg WHERE NOT undone) AS fixes_in_place, (SELECT count(*) FROM lg WHERE undone) AS fixes_undone"
)
O["restore_check"] = (
    f"WITH {BASE} SELECT tenant, rule_id, count(*) AS n FROM f WHERE rule_id <> 'no_tags' OR tenant = 'north' GROUP BY ALL"
)
O["items_of_check"] = f"WITH {BASE} SELECT tenant, product_id FROM f WHERE rule_id = 'no_tags'"

# ---- fixes ----
LIVE = (
    "live AS (SELECT tenant, id, pos, CASE WHEN pos % 5 = 0 THEN 'Else' WHEN pos % 7 = 0 THEN concat(upper(substr(vendor, 1, 1)), lower(substr(vendor, 2))) ELSE vendor END AS vendor, vendor AS scanned FROM item)"
)
PLAN = (
    f"{ITEM}, {LIVE}, vc AS ({O['check_vendor_casing']}), pl AS (SELECT tenant, id AS product_id, pos, trim(vendor) AS before, suggested AS after, "
    "CASE WHEN trim(vendor) = suggested THEN 'unchanged' WHEN trim(vendor) <> trim(scanned) THEN 'skipped' ELSE 'fixed' END AS act "
    "FROM live JOIN vc ON vc.product_id = live.id)"
)
O["fix_dominant_spelling"] = (
    f"WITH {PLAN} SELECT tenant, product_id, before, after, act AS action FROM pl"
)
O["fix_budget"] = (
    f"WITH {PLAN} SELECT tenant, count(CASE WHEN act = 'fixed' THEN 1 END) AS fixed, count(CASE WHEN act = 'skipped' THEN 1 END) AS skipped, "
    "count(CASE WHEN act = 'unchanged' THEN 1 END) AS unchanged FROM pl GROUP BY tenant"
)
O["fix_clear_compare_at"] = (
    f"WITH {VARIANT} SELECT tenant, product_id, id AS target_id, {m('cc')} AS before, 'fixed' AS action FROM v0 WHERE cc <= pc"
)
O["apply_fixes"] = (
    f"WITH {PLAN} SELECT live.tenant, live.id AS product_id, CASE WHEN pl.act = 'fixed' THEN CASE WHEN live.pos % 3 = 0 THEN pl.after ELSE concat('New ', pl.after) END "
    "ELSE live.vendor END AS vendor FROM live LEFT JOIN pl ON pl.product_id = live.id"
)
O["undo_batch"] = (
    f"WITH {LOG} SELECT tenant, target_id, field, CASE WHEN event_id % 11 <> 0 AND event_id % 5 <> 0 THEN 'undone' ELSE 'stale' END AS outcome FROM lg WHERE NOT undone AND tenant = 't1'"
)
O["undo_closes_entries"] = f"WITH {LOG} SELECT tenant, field, undone OR field = 'vendor' AS undone, count(*) AS n FROM lg GROUP BY ALL"
O["recent_fixes"] = (
    f"WITH {LOG}, g AS (SELECT tenant, batch_id, rule_id, count(*) AS count, max(ts) AS mt, count(DISTINCT product_id) AS pc, max(title) AS title FROM lg WHERE NOT undone GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY mt DESC, batch_id, rule_id) AS rank FROM g) "
    "SELECT tenant, rank, batch_id, rule_id, count, pc AS product_count, CASE WHEN pc = 1 THEN title END AS product_title, strftime(mt, '%Y-%m-%d %H:%M:%S') AS \"at\" FROM r WHERE rank <= 5"
)
O["fix_batch_detail"] = (
    f"WITH {LOG} SELECT tenant, product_id, min(title) AS title, count(*) AS changes, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM lg WHERE NOT undone AND tenant = 't2' GROUP BY ALL"
).replace("GROUP BY ALL", "GROUP BY tenant, product_id")
O["fixed_in_window"] = f"WITH {LOG} SELECT tenant, count(*) AS fixed FROM lg WHERE NOT undone AND ts >= timestamp '2024-01-23' GROUP BY tenant"

# ---- validation ----
MONEY_BAD = "NOT regexp_matches(trim(value), '^[0-9]{1,10}(\\.[0-9]{1,2})?$')"
O["validate_values"] = (
    f"WITH e AS (SELECT o_orderkey AS edit_id, {q.EDIT_KIND} AS kind, {q.EDIT_FIELD} AS field, {q.EDIT_VALUE} AS value FROM orders) SELECT edit_id, "
    "CASE kind WHEN 'product' THEN CASE field WHEN 'title' THEN trim(value) = '' OR length(value) > 255 ELSE value NOT IN ('ACTIVE', 'DRAFT', 'ARCHIVED') END "
    f"WHEN 'variant' THEN CASE field WHEN 'price' THEN {MONEY_BAD} ELSE trim(value) <> '' AND {MONEY_BAD} END "
    "WHEN 'weight' THEN coalesce(NOT try_cast(nullif(trim(value), '') as double) >= 0, true) "
    f"WHEN 'cost' THEN trim(value) <> '' AND {MONEY_BAD} WHEN 'inventory' THEN NOT regexp_matches(trim(value), '^-?[0-9]+$') "
    "WHEN 'option' THEN trim(value) = '' OR length(value) > 255 WHEN 'word' THEN trim(value) = '' OR length(value) > 100 ELSE true END AS refused FROM e"
)
O["validate_attribute_types"] = (
    f"WITH e AS (SELECT event_id, {q.ATTR_TYPE} AS type, {q.ATTR_VALUE} AS value FROM events) SELECT event_id, CASE type "
    "WHEN 'number_integer' THEN NOT regexp_matches(value, '^-?[0-9]+$') WHEN 'number_decimal' THEN NOT regexp_matches(value, '^-?[0-9]+(\\.[0-9]+)?$') "
    "WHEN 'boolean' THEN lower(value) NOT IN ('true', 'false') WHEN 'url' THEN NOT starts_with(value, 'https://') WHEN 'date' THEN NOT regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') "
    "WHEN 'json' THEN value NOT LIKE '{%' AND NOT regexp_matches(value, '^-?[0-9.]+$') ELSE false END AS refused FROM e"
)
O["validate_finding_keys"] = (
    "SELECT CASE WHEN l_returnflag = 'A' THEN 'missing_sku' ELSE 'spelling' END AS rule_id, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber NOT IN (1, 2, 4) GROUP BY ALL"
)
O["lint_attribute_rules"] = "SELECT p_partkey, p_partkey % 14 IN (1, 2, 3, 6, 7, 10, 11) AS refused FROM part"

# ---- whole scan ----
O["full_scan_summary"] = score_sql(
    f"NOT {IGNORED}", findings_sql([*q.BASE_RULES, "vendor_casing", "duplicate_title", "tag_casing"])
)
O["description_quality"] = (
    f"WITH {DOC}, f AS (SELECT 'short_description' AS rule_id, tenant FROM doc WHERE words > 0 AND words < 20 UNION ALL "
    "SELECT 'description_too_long', tenant FROM doc WHERE words > 2000 UNION ALL SELECT 'duplicate_description', tenant FROM "
    "(SELECT tenant, count(*) OVER (PARTITION BY tenant, low) AS n FROM doc WHERE length(low) >= 40) WHERE n >= 3) "
    "SELECT rule_id, 'low' AS severity, count(*) AS findings, count(DISTINCT tenant) AS tenants FROM f GROUP BY rule_id"
)

# ---- parametric checks on plain tables ----
O["contains_any_of"] = (
    "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower({c}), '{w}')" for c in ("text", "source") for w in ("license", "copyright", "src1"))
)
O["pattern_violations"] = (
    "SELECT p_partkey, trim(p_brand) <> '' AND NOT regexp_matches(p_brand, '^Brand#[0-4]') AS brand_off, "
    "trim(p_name) <> '' AND regexp_matches(p_name, '(?i)ring') AS name_hit FROM part"
)
O["any_long_line"] = "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 400)) > 0"
O["learned_word_list"] = (
    "WITH w AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z'']+'))) AS word FROM benchmark) "
    "SELECT DISTINCT 'all' AS tenant, word FROM w WHERE word NOT IN (SELECT word FROM w WHERE item_id % 2 = 0)"
)
O["result_by_id"] = f"WITH {SCANS} SELECT tenant, scan_id, total, open FROM scans WHERE tenant = 't1' AND scan_id = (SELECT max(scan_id) FROM scans WHERE tenant = 't1')"
SAVED = findings_sql(["no_tags", "few_images"])
O["save_and_prune"] = (
    f"WITH {SAVED}, old AS (SELECT CASE WHEN user_id % 5 IN (0, 1) THEN 'north' ELSE 'south' END AS tenant, event_id AS scan_id, cast(round(value * 10) as bigint) AS open, event_id % 4 = 0 AS \"full\" FROM events), "
    "n AS (SELECT tenant, 1099511627776 AS scan_id, count(*) AS open, true AS \"full\" FROM f GROUP BY tenant), every AS (SELECT * FROM old UNION ALL SELECT * FROM n), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY scan_id DESC) AS k, row_number() OVER (PARTITION BY tenant, \"full\" ORDER BY scan_id DESC) AS kf FROM every) "
    "SELECT tenant, scan_id, open, \"full\", open AS counted, CASE WHEN scan_id = 1099511627776 THEN open END AS snapshot_open FROM r WHERE k <= 20 OR (\"full\" AND kf <= 12)"
)
