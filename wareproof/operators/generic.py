"""The parametric checks: Column predicates for one row, DataFrame operators for whole tables.

Row predicates return a boolean Column and compose with ``&``, ``|`` and ``~``. Table operators take
and return DataFrames and work on any table; the catalog suite is built from them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareproof.constants import ENGLISH_STOPWORDS
from wareproof.functions import text as tx
from wareproof.functions.numeric import gtin_valid, kg_factor, least_as_one_number
from wareproof.operators.rows import exploded_rows, median_of_bounds, with_key, with_median_bounds
from wareproof.operators.skew import SLICE_WIDTH, attach_groups


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- one row -------------------------------------------------------------------------------------

def required(c: Column | str, when: Column | None = None) -> Column:
    """The text is null, empty or white space."""
    bad = tx.is_blank(_col(c))
    return bad if when is None else when & bad


def length_outside(c: Column | str, unit: str, lo: int | None = None, hi: int | None = None) -> Column:
    """Words or characters below ``lo`` or above ``hi``; empty text is left to ``required``."""
    size = tx.word_count(_col(c)) if unit == "words" else F.length(_col(c))
    below = (size > 0) & (size < lo) if lo is not None else F.lit(False)
    above = size > hi if hi is not None else F.lit(False)
    return below | above


def contains_any(cols: Sequence[Column | str], phrases: Sequence[str]) -> Column:
    """Any of the (lower-case) phrases occurs in any of the columns."""
    hits = [F.contains(F.lower(_col(c)), F.lit(p)) for c in cols for p in phrases]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def pattern_violation(c: Column | str, regex: str, negate: bool = False) -> Column:
    """The pattern occurs (or, negated, does not occur) in the non-blank text."""
    hit = _col(c).rlike(regex)
    return ~tx.is_blank(_col(c)) & (~hit if negate else hit)


def text_case(c: Column | str, mode: str = "all_caps") -> Column:
    """All capitals, not in Title Case, or in Title Case."""
    if mode == "all_caps":
        return tx.is_all_caps(_col(c))
    titled = tx.is_title_case(_col(c))
    return titled if mode == "title" else ~titled


def fields_repeat(a: Column | str, b: Column | str, mode: str = "equal", min_chars: int = 1) -> Column:
    """Normalized text ``a`` equals ``b``, is a prefix of it, or occurs in it twice."""
    na, nb = tx.norm(_col(a)), tx.norm(_col(b))
    long_enough = F.length(na) >= min_chars
    if mode == "equal":
        return long_enough & (na == nb)
    if mode == "prefix":
        return long_enough & (nb != "") & F.startswith(nb, F.regexp_replace(na, r"\.{3}$", ""))
    # The cheap count of plain occurrences spares most rows the pattern below.
    spared = F.length(nb) - F.length(F.replace(nb, na, F.lit(""))) >= F.length(na) * 2
    word = F.replace(tx.quote_regex(na), F.lit(" "), F.lit(rf"\E{tx.WS}+\Q"))
    pattern = F.concat(F.lit(r"(?i)(^|[^a-z0-9])("), word, F.lit(r")(?=[^a-z0-9]|$)"))
    return long_enough & spared & (F.regexp_count(_col(b), pattern) >= 2)


def language_share(
    c: Column | str,
    stopwords: Sequence[str] = ENGLISH_STOPWORDS,
    max_share: tuple[int, int] = (4, 100),
    min_words: int = 30,
) -> Column:
    """Too small a share of stopwords among enough words; the share is a fraction of integers."""
    low = F.lower(_col(c))
    n = tx.ascii_word_count(low)
    hits = tx.stopword_count(low, list(stopwords))
    return (n >= min_words) & (hits * max_share[1] < n * max_share[0])


def compare_columns(a: Column | str, op: str, b: Column | str, guard: Column | None = None) -> Column:
    """A comparison of two columns behind a guard; null on either side never fires."""
    x, y = _col(a), _col(b)
    hit = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y, "!=": x != y}[op]
    return F.coalesce(hit if guard is None else guard & hit, F.lit(False))


def stale(ts: Column | str, days: int, as_of: Column, when: Column | None = None) -> Column:
    """More than ``days`` days before ``as_of``; null never fires."""
    old = _col(ts) < as_of - F.make_dt_interval(F.lit(days))
    return F.coalesce(old if when is None else when & old, F.lit(False))


def count_outside(c: Column | str, lo: int | None = None, hi: int | None = None) -> Column:
    """A count (or the size of an array is) below ``lo`` or above ``hi``."""
    n = _col(c)
    below = n < lo if lo is not None else F.lit(False)
    above = n > hi if hi is not None else F.lit(False)
    return F.coalesce(below | above, F.lit(False))


def any_item(array: Column | str, predicate: Callable[[Column], Column]) -> Column:
    """Some element satisfies the predicate."""
    return F.coalesce(F.exists(_col(array), predicate), F.lit(False))


def range_violation(
    c: Column | str, lo=None, hi=None, when: Column | None = None
) -> Column:
    """A value below ``lo`` or above ``hi``."""
    out = count_outside(c, lo, hi)
    return out if when is None else F.coalesce(when, F.lit(False)) & out


def checksum_invalid(c: Column | str) -> Column:
    """A 12, 13 or 14 digit code with a wrong check digit."""
    return F.coalesce(~gtin_valid(_col(c)), F.lit(False))


def state_rule(condition: Column) -> Column:
    """Any boolean condition; unknown counts as not violated."""
    return F.coalesce(condition, F.lit(False))


# ---- whole tables --------------------------------------------------------------------------------

def peer_outlier(
    df: DataFrame,
    value: str,
    group: Sequence[str],
    spread: Sequence[str],
    ratio: int = 5,
    min_peers: int = 3,
) -> DataFrame:
    """Rows whose positive value is over ``ratio`` times, or under 1/``ratio`` of, the group median."""
    group = list(group)
    positive = df.filter(F.col(value) > 0)
    # Counting equal values first shrinks what the exact median has to hold.
    counted = positive.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    peers = (
        with_median_bounds(counted, group, value, "_c")
        .groupBy(*group)
        .agg(F.sum("_c").alias("peers"), median_of_bounds().alias("median"))
    )
    joined = attach_groups(
        positive, peers, group, "peers", spread, keep=F.col("peers") >= min_peers
    )
    v, m = F.col(value), F.col("median")
    return joined.filter((v > m * ratio) | (v * ratio < m))


def duplicate_key(
    df: DataFrame,
    key: Column,
    spread: Sequence[str],
    tenant: str = "tenant",
    min_group: int = 2,
    min_len: int = 1,
    long_key: bool = False,
) -> DataFrame:
    """Rows that share a key, each with ``group_key`` and ``group_size``.

    A long key (a whole description) travels as two independent 64-bit hashes and its length.
    """
    rows = with_key(df, key, min_len, "_key")
    if long_key:
        digest = F.concat_ws(
            ":",
            F.xxhash64(F.lit(1), "_key").cast("string"),
            F.xxhash64(F.lit(2), F.reverse("_key")).cast("string"),
            F.length("_key").cast("string"),
        )
        rows = rows.withColumn("_key", digest)
    sizes = rows.groupBy(tenant, F.col("_key")).agg(F.count(F.lit(1)).alias("group_size"))
    joined = attach_groups(
        rows, sizes, [tenant, "_key"], "group_size", spread, keep=F.col("group_size") >= min_group
    )
    return joined.withColumnRenamed("_key", "group_key")


def numbered_duplicates(
    df: DataFrame,
    key: Column,
    order: Sequence[str],
    tenant: str = "tenant",
    min_group: int = 2,
    min_len: int = 1,
    slice_width: int | None = None,
) -> DataFrame:
    """Rows that share a key with ``group_key``, ``group_size`` and ``member``, their number by position.

    Counts per key and slice of positions give the size of a group and where each slice starts in it.
    Rows meet those counts slice by slice, so a huge group is spread over its slices, and the same
    partitioning serves the numbering. ``order[0]`` is a bigint position as in ``ranked``.
    """
    width = slice_width or SLICE_WIDTH
    rows = with_key(df, key, min_len, "group_key").withColumn("_slice", F.floor(F.col(order[0]) / F.lit(width)))
    place = [tenant, "group_key", "_slice"]
    group = Window.partitionBy(tenant, "group_key")
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"group_size": F.sum("_n").over(group), "_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0))})
        .filter(F.col("group_size") >= min_group)
        .drop("_n")
    )
    inside = Window.partitionBy(*place).orderBy(*order)
    return (
        rows.join(slices, place)
        .withColumn("member", F.col("_before") + F.row_number().over(inside))
        .drop("_slice", "_before")
    )


def spelling_groups(
    df: DataFrame, value: str, pos: Sequence[str], tenant: str = "tenant"
) -> DataFrame:
    """Per spelling of every mixed group: the one to keep and all of them, in first-seen order.

    The most used spelling wins and ties go to the one seen first. Columns: tenant, value, n, keep,
    spellings. Spellings that are already the one to keep are listed too.
    """
    spelled = df.groupBy(tenant, F.col(value)).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*pos)).alias("first_pos")
    ).withColumn("_norm", tx.norm(F.col(value)))
    earliest = [-F.col(f"first_pos.{p}") for p in pos]
    # One row per distinct spelling from here on.
    groups = (
        spelled.groupBy(tenant, "_norm")
        .agg(
            F.max_by(F.col(value), F.struct(F.col("n"), *earliest)).alias("keep"),
            F.array_sort(F.collect_list(F.struct("first_pos", F.col(value).alias("spelling")))).alias("_all"),
        )
        .withColumn("mixed", F.size("_all") > 1)
        .withColumn("spellings", F.col("_all.spelling"))
        .drop("_all")
    )
    return spelled.join(groups, [tenant, "_norm"]).drop("_norm", "first_pos")


def inconsistent_spelling(
    df: DataFrame, value: str, pos: Sequence[str], spread: Sequence[str], tenant: str = "tenant"
) -> DataFrame:
    """Rows whose spelling is not the most used one of its group, with ``keep`` and ``spellings``."""
    rows = df.filter(F.col(value) != "")
    groups = spelling_groups(rows, value, pos, tenant)
    return attach_groups(
        rows, groups, [tenant, value], "n", spread, keep=F.col("mixed") & (F.col("keep") != F.col(value))
    ).drop("mixed", "n")


def majority_style(
    df: DataFrame,
    style: Column,
    spread: Sequence[str],
    tenant: str = "tenant",
    min_rows: int = 10,
    share: int = 75,
) -> DataFrame:
    """Rows off the clear majority of a boolean style; ``majority`` tells which side it is."""
    rows = exploded_rows(df, ["*"], F.array(style), "_style")
    totals = rows.groupBy(tenant).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_style")).alias("_yes")
    )
    totals = totals.withColumn(
        "majority",
        F.when(F.col("_yes") * 100 >= F.col("_n") * share, F.lit(True)).when(
            F.col("_yes") * 100 <= F.col("_n") * (100 - share), F.lit(False)
        ),
    )
    joined = attach_groups(
        rows, totals, [tenant], "_n", spread,
        keep=(F.col("_n") >= min_rows) & F.col("majority").isNotNull(),
    )
    return joined.filter(F.col("_style") != F.col("majority")).drop("_style", "_n", "_yes")


def _earliest(pos: Sequence[str]) -> Column:
    """The least position of a group: of two bigints as one number, for which no rows are sorted."""
    return least_as_one_number(*map(F.col, pos)) if len(pos) == 2 else F.min(F.struct(*pos))


def mixed_unit(
    df: DataFrame,
    unit: str,
    value: str,
    pos: Sequence[str],
    spread: Sequence[str],
    tenant: str = "tenant",
    min_rows: int = 10,
    share: int = 80,
) -> DataFrame:
    """Rows with a positive value in another unit than the clear majority.

    Adds ``majority_unit`` and ``converted``, the value in that unit.
    """
    rows = df.filter(F.col(value) > 0)
    earliest = [-F.col("_first")] if len(pos) == 2 else [-F.col(f"_first.{p}") for p in pos]
    totals = (
        rows.groupBy(tenant, F.col(unit))
        .agg(F.count(F.lit(1)).alias("_c"), _earliest(pos).alias("_first"))
        .groupBy(tenant)
        .agg(
            F.max_by(F.col(unit), F.struct(F.col("_c"), *earliest)).alias("majority_unit"),
            F.max("_c").alias("_top"),
            F.sum("_c").alias("_n"),
            F.count(F.lit(1)).alias("_units"),
        )
    )
    joined = attach_groups(
        rows, totals, [tenant], "_n", spread,
        keep=(F.col("_units") >= 2) & (F.col("_n") >= min_rows) & (F.col("_top") * 100 >= F.col("_n") * share),
    )
    off = joined.filter(F.col(unit) != F.col("majority_unit"))
    converted = F.col(value) * kg_factor(F.col(unit)) / kg_factor(F.col("majority_unit"))
    return off.withColumn("converted", converted).drop("_top", "_n", "_units")
