"""Validation of proposed edits, attribute rules and finding references, as columns with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.constants import MAX_PATTERN_LENGTH
from wareproof.functions import patterns
from wareproof.functions.text import blank_if_null, js_trim
from wareproof.operators.registry import RULE_IDS

# ---- fixed values: accepted shapes ---------------------------------------------------------------
MONEY = r"^[0-9]{1,10}(\.[0-9]{1,2})?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ID = r"^gid://[a-z]+/[A-Za-z]+/[0-9]+$"
STATUSES = ["ACTIVE", "DRAFT", "ARCHIVED"]
POLICIES = ["DENY", "CONTINUE"]
# A repeated group, class or escape that is itself repeated; and references to earlier groups.
NESTED_REPEAT = r"(\([^)]*[+*][^)]*\)|\[[^\]]*\][+*]|\\[dwsDWS][+*]|\.[+*])\s*[+*{]"
BACKREFERENCE = r"\\[1-9]"

LINE_BREAK = r"[\r\n]"


def _money_error(v: Column, empty_allowed: bool) -> Column:
    t = js_trim(v)
    blank = F.lit(None) if empty_allowed else F.lit("value is required")
    return F.when(t == "", blank).when(~t.rlike(MONEY), F.lit("not an amount with up to two decimals"))


def _longer(v: Column, n: int) -> Column:
    return F.when(F.length(v) > n, F.lit(f"longer than {n} characters"))


def attribute_error(kind: Column, value: Column) -> Column:
    """Why a value does not fit its attribute type, or null."""
    v = blank_if_null(value)
    t = js_trim(v)
    return (
        F.when(kind == "number_integer", F.when(~t.rlike(r"^-?[0-9]+$"), F.lit("not a whole number")))
        .when(kind == "number_decimal", F.when(~t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.lit("not a number")))
        .when(kind == "boolean", F.when(~t.rlike("(?i)^(true|false)$"), F.lit("not true or false")))
        .when(kind == "url", F.when(~t.rlike(r"(?i)^https?://\S+$"), F.lit("not a web address")))
        .when(kind == "date", F.when(~t.rlike(DATE), F.lit("not a date")))
        .when(kind == "date_time", F.when(F.try_to_timestamp(t).isNull(), F.lit("not a date and time")))
        .when(kind == "json", F.when(F.try_parse_json(v).isNull(), F.lit("not valid JSON")))
        .when(
            kind == "single_line_text_field",
            F.when(v.rlike(LINE_BREAK), F.lit("has line breaks")).otherwise(_longer(v, 5000)),
        )
        .otherwise(_longer(v, 65535))
    )


def value_error(kind: Column, field: Column, value_type: Column, value: Column) -> Column:
    """Why a value cannot be written for an edit, or null."""
    v = blank_if_null(value)
    t = js_trim(v)
    blank = F.lit("value is required")
    policy = F.when(~v.isin(POLICIES), F.lit("not a stock policy"))
    product = (
        F.when(field == "title", F.when(t == "", blank).otherwise(_longer(v, 255)))
        .when(field == "status", F.when(~v.isin(STATUSES), F.lit("not a status")))
        .when(field == "descriptionHtml", _longer(v, 65535))
        .when(field == "seoDescription", _longer(v, 1000))
        .otherwise(_longer(v, 255))
    )
    variant = (
        F.when(field == "price", _money_error(v, False))
        .when(field == "compareAt", _money_error(v, True))
        .when(field == "inventoryPolicy", policy)
        .otherwise(_longer(v, 255))
    )
    weight = t.try_cast("double")
    finite = weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) != float("inf"))
    return (
        F.when(kind == "product", product)
        .when(
            kind == "word",
            F.when(t == "", blank).when(v.rlike(LINE_BREAK) | (F.length(v) > 100), F.lit("not a word or short phrase")),
        )
        .when(kind == "variant", variant)
        .when(kind == "policy", policy)
        .when(kind == "weight", F.when(~(F.coalesce(finite & (weight >= 0), F.lit(False))), F.lit("not a weight of zero or more")))
        .when(kind == "cost", _money_error(v, True))
        .when(kind == "inventory", F.when(~t.rlike(r"^-?[0-9]+$"), F.lit("not a whole number")))
        .when(kind == "option", F.when((t == "") | (F.length(v) > 255), F.lit("not an option value")))
        .when(kind == "metafield", attribute_error(value_type, v))
        .when(kind == "publish", F.lit(None).cast("string"))
        .otherwise(F.lit("cannot be edited"))
    )


def validate_edits(edits: DataFrame) -> DataFrame:
    """``error`` for every proposed edit (kind, field, value_type, value); null where it may be written."""
    return edits.withColumn(
        "error", value_error(F.col("kind"), F.col("field"), F.col("value_type"), F.col("value"))
    )


def validate_finding_refs(refs: DataFrame, id_pattern: str = ID) -> DataFrame:
    """References to findings that name a known check, well-formed ids and bounded parts."""

    def bounded(c: str) -> Column:
        return F.col(c).isNull() | (F.length(c) <= 100)

    variant = F.coalesce(F.col("variant_id"), F.lit(""))
    return refs.filter(
        F.col("rule_id").isin(RULE_IDS)
        & F.coalesce(F.col("product_id").rlike(id_pattern), F.lit(False))
        & ((variant == "") | variant.rlike(id_pattern))
        & bounded("word") & bounded("field")
    ).withColumns({c: blank_if_null(F.col(c)) for c in ("variant_id", "word", "field")})


def pattern_error(c: Column) -> Column:
    """Why a pattern is not accepted, or null. Blank patterns mean no pattern."""
    p = js_trim(blank_if_null(c))
    return (
        F.when(p == "", F.lit(None).cast("string"))
        .when(F.length(p) > MAX_PATTERN_LENGTH, F.lit("too long"))
        .when(p.rlike(NESTED_REPEAT), F.lit("repeats a repeated group"))
        .when(p.rlike(BACKREFERENCE), F.lit("uses a backreference"))
        .otherwise(patterns.problem(p))
    )


def lint_attribute_rules(rules: DataFrame) -> DataFrame:
    """Every attribute rule with ``error``: the reason its pattern is refused, else null."""
    return rules.withColumn("error", pattern_error(F.col("pattern")))
