"""Schemas, as DDL, of the nested item record, the findings table and the small side tables."""

from __future__ import annotations

MONEY = "decimal(18,2)"

VARIANT_FIELDS = """
    id string, title string, sku string, barcode string, price string, compare_at_price string,
    cost string, inventory_policy string, inventory_quantity int, updated_at timestamp, locations int,
    tracked boolean, requires_shipping boolean, inventory_item_id string, weight double,
    weight_unit string
"""
VARIANT_STRUCT = "struct<" + ", ".join(
    f.strip().replace(" ", ": ", 1) for f in VARIANT_FIELDS.replace("\n", " ").split(",")
) + ">"

# The nested record as it arrives: money is text, absent values are null.
RECORD = (
    "tenant string, pos bigint, id string, title string, handle string, status string, "
    "created_at timestamp, updated_at timestamp, published_at timestamp, total_inventory int, "
    "variants_count int, collection_count int, collection_ids array<string>, vendor string, "
    "product_type string, tags array<string>, description_html string, seo_title string, "
    "seo_description string, "
    "category struct<id: string, name: string, full_name: string, is_leaf: boolean, level: int>, "
    "publications int, publications_ok int, "
    "channel_issues array<struct<app: string, messages: array<string>>>, "
    "options array<struct<id: string, name: string, values: array<string>, value_ids: array<string>>>, "
    "metafields array<struct<key: string, name: string, type: string, value: string>>, "
    "media_count int, images array<struct<id: string, alt: string, width: int, height: int>>, "
    f"variants array<{VARIANT_STRUCT}>"
)

CHOICE = "struct<label: string, kind: string, field: string, value: string>"
NAMED_VALUE = "struct<id: string, name: string>"
EDIT_FIELDS = [
    ("kind", "string"), ("field", "string"), ("target_id", "string"), ("current", "string"),
    ("suggested", "string"), ("raw", "string"), ("apply", "boolean"), ("apply_value", "string"),
    ("apply_label", "string"), ("choices", f"array<{CHOICE}>"), ("unit", "string"),
    ("value_type", "string"), ("values", f"array<{NAMED_VALUE}>"), ("no_input", "boolean"),
    ("multiline", "boolean"),
]
EDIT = "struct<" + ", ".join(f"{n}: {t}" for n, t in EDIT_FIELDS) + ">"

# What one check adds to the identity of the row it is about.
PAYLOAD_FIELDS = [
    ("rule_id", "string"), ("area", "string"), ("severity", "string"), ("word", "string"),
    ("field", "string"), ("detail", "string"), ("current", "string"), ("edit", EDIT),
]

SAVED = "struct<batch_id: string, value: string, at: timestamp, quick: boolean>"
FINDING_FIELDS = [
    ("tenant", "string"), ("rule_id", "string"), ("area", "string"), ("severity", "string"),
    ("product_id", "string"), ("product_title", "string"), ("pos", "bigint"),
    ("variant_id", "string"), ("variant_title", "string"), ("variant_pos", "bigint"), ("sku", "string"),
    ("variant_count", "int"), ("word", "string"), ("field", "string"), ("detail", "string"),
    ("current", "string"), ("edit", EDIT), ("meta", "map<string,string>"), ("saved", SAVED),
    ("finding_key", "string"),
]
FINDING_COLUMNS = [n for n, _ in FINDING_FIELDS]
FINDING = ", ".join(f"{n} {t}" for n, t in FINDING_FIELDS)

ATTRIBUTE_RULE = (
    "tenant string, namespace string, key string, name string, type string, required boolean, "
    "pattern string, product_type string"
)
EXPORT_LINE = (
    "tenant string, id string, __parentId string, __typename string, title string, handle string, "
    "status string, createdAt timestamp, updatedAt timestamp, publishedAt timestamp, "
    "totalInventory int, vendor string, productType string, tags array<string>, "
    "descriptionHtml string, variantsCount struct<count: int>, "
    "seo struct<title: string, description: string>, "
    "options array<struct<id: string, name: string, optionValues: array<struct<id: string, name: string>>>>, "
    "category struct<id: string, name: string, fullName: string, isLeaf: boolean, level: int>, "
    "feedback struct<details: array<struct<app: struct<title: string>, "
    "messages: array<struct<message: string>>, state: string>>>, "
    "resourcePublicationsCount struct<count: int>, availablePublicationsCount struct<count: int>, "
    "mediaContentType string, alt string, image struct<width: int, height: int>, "
    "sku string, barcode string, price string, compareAtPrice string, inventoryPolicy string, "
    "inventoryQuantity int, "
    "inventoryItem struct<id: string, tracked: boolean, requiresShipping: boolean, "
    "locationsCount: struct<count: int>, unitCost: struct<amount: string>, "
    "measurement: struct<weight: struct<value: double, unit: string>>>"
)
