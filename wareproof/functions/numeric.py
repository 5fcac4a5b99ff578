"""Money, units and check digits as Column expressions, in integers wherever a boundary matters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wareproof.constants import KILOGRAMS_PER_UNIT
from wareproof.functions.text import WS, blank_if_null, is_blank


def parse_money(c: Column) -> Column:
    """Text to decimal(18,2). Null and blank count as zero, junk becomes null.

    The cast strips spaces itself, so only what it refuses is looked at again.
    """
    zero = F.when(is_blank(c.cast("string")), F.lit(0).cast("decimal(18,2)"))
    return F.coalesce(c.try_cast("decimal(18,2)"), zero)


def parse_optional_money(c: Column) -> Column:
    """Like ``parse_money`` but an absent value stays null."""
    return F.when(c.isNotNull(), parse_money(c))


def cents(c: Column) -> Column:
    """Decimal money to whole cents."""
    return (c * 100).cast("bigint")


def money_text(c: Column) -> Column:
    """Plain two-decimal text; null reads as zero."""
    return F.coalesce(c.cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).cast("string")


def cents_text(c: Column) -> Column:
    """Cents (whole or fractional) to plain two-decimal text."""
    return (F.round(c.cast("decimal(20,1)"), 0) / 100).cast("decimal(18,2)").cast("string")


def int_div(a: Column, b: Column) -> Column:
    """Exact integer quotient of two non-negative bigints."""
    return F.call_function("div", a - F.pmod(a, b), b)


def as_one_number(a: Column, b: Column) -> Column:
    """A decimal in the order of two bigints, a null first; ``b`` stays below 5e18 either side of zero. The least one of a group is
    kept in a hash map, where Spark would sort all rows for the least pair."""
    high = F.coalesce(a, F.lit(-(2**63))).cast("decimal(19,0)") * F.lit(str(10**19)).cast("decimal(20,0)")
    return high + F.coalesce(b, F.lit(-(2**62))).cast("decimal(19,0)")


def least_as_one_number(a: Column, b: Column) -> Column:
    """The least of ``as_one_number`` in a group. Numbers below 2**31 and 2**32 are compared as one bigint, which takes a fraction of the time."""
    short = F.coalesce(a.between(0, 2**31 - 1) & b.between(0, 2**32 - 1), F.lit(False))
    packed = F.min(F.when(short, F.shiftleft(a.cast("bigint"), 32).bitwiseOR(b.cast("bigint"))))
    unpacked = as_one_number(F.shiftright(packed, 32), packed.bitwiseAND(F.lit(2**32 - 1)))
    return F.least(F.when(packed.isNotNull(), unpacked), F.min(F.when(~short, as_one_number(a, b))))


def percent_of(part: Column, whole: Column) -> Column:
    """Rounded (half up) integer percentage of two non-negative bigints; null when the whole is 0."""
    return F.when(whole > 0, int_div(part * 200 + whole, whole * 2))


def with_ending(cost_cents: Column, ending: Column, margin_keep=(9, 10)) -> Column:
    """The smallest price, as text, with the given cents that leaves the margin over the cost."""
    num, den = margin_keep
    micro = int_div(cost_cents * (10000 * den * 2) + num, F.lit(num * 2).cast("bigint"))
    target = int_div(micro + 9999, F.lit(10000).cast("bigint"))
    ends = F.coalesce(ending.try_cast("bigint"), F.lit(0).cast("bigint"))
    base = target - F.pmod(target, F.lit(100).cast("bigint")) + ends
    return cents_text(F.when(base < target, base + 100).otherwise(base))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.try_element_at(F.transform(F.array(value), f), F.lit(1))


def gtin_valid(code: Column) -> Column:
    """Check digit of 12, 13 or 14 digit codes; null (no opinion) for every other shape."""

    def agrees(padded: Column) -> Column:
        total = sum(
            ((F.ascii(F.substring(padded, i + 1, 1)) - 48) * (3 if i % 2 == 0 else 1) for i in range(13)),
            F.lit(0),
        )
        return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == F.ascii(F.substring(padded, 14, 1)) - 48

    def judged(digits: Column) -> Column:
        return F.when(digits.rlike("^[0-9]{12,14}$"), _with(F.lpad(digits, 14, "0"), agrees))

    # Codes of digits alone, as most are, are judged as one number.
    number = code.try_cast("bigint")
    total = sum((F.pmod(F.call_function("div", number, F.lit(10**i)), F.lit(10)) * (3 if i % 2 else 1) for i in range(14)), F.lit(0))
    plain = F.when(code.rlike(r"^[0-9]{12,14}\z"), F.pmod(total, F.lit(10)) == 0)
    return F.coalesce(plain, _with(F.regexp_replace(blank_if_null(code), f"{WS}|-", ""), judged))


def kg_factor(unit: Column) -> Column:
    """Kilograms per unit; unknown units count as kilograms."""
    expr = F.lit(1.0)
    for name, factor in KILOGRAMS_PER_UNIT.items():
        expr = F.when(unit == name, F.lit(factor)).otherwise(expr)
    return expr


def number_text(c: Column) -> Column:
    """A double as people write it: whole numbers without a fraction."""
    whole = c == F.floor(c)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def array_median(values: Column) -> Column:
    """Median of a numeric array (mean of the middle two for even sizes); null when empty."""
    s = F.array_sort(values)
    n = F.size(values)
    mid = F.floor(n / 2).cast("int")
    even = (F.try_element_at(s, mid) + F.try_element_at(s, mid + 1)) / 2
    return F.when(n > 0, F.when(n % 2 == 1, F.try_element_at(s, mid + 1).cast("double")).otherwise(even.cast("double")))
