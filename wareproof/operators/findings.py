"""Building finding rows: typed payload structs and the one projection that turns them into rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.operators.registry import META
from wareproof.operators.rows import exploded_rows
from wareproof.schema import EDIT_FIELDS, FINDING_FIELDS, PAYLOAD_FIELDS


_literals: dict[tuple, Column] = {}


def _typed(value, kind: str, name: str) -> Column:
    """A named, typed part. Literals are shared: the suite needs the same few hundreds of times."""
    if isinstance(value, Column):
        return value.cast(kind).alias(name)
    key = (id(SparkContext._active_spark_context), value, type(value), kind, name)
    if key not in _literals:
        _literals[key] = F.lit(value).cast(kind).alias(name)
    return _literals[key]


def _struct(values: dict, fields: Sequence[tuple[str, str]]) -> Column:
    return F.struct(*[_typed(values.get(n), t, n) for n, t in fields])


def edit(kind: str, **parts) -> Column:
    """A suggestion. One that only repeats the stored value is not kept."""
    values = {"kind": kind, **parts}
    if "suggested" in values and "raw" in values:
        suggested, raw = values["suggested"], values["raw"]
        if suggested is raw:
            values["suggested"] = None
        else:
            text = suggested if isinstance(suggested, Column) else F.lit(suggested)
            stored = (raw if isinstance(raw, Column) else F.lit(raw)).cast("string")
            values["suggested"] = F.when(~text.eqNullSafe(stored), text)
    return _struct(values, EDIT_FIELDS)


def said(rule_id: str, **parts) -> dict[str, Column]:
    """What a check says about the row it is about, part by part."""
    meta = META.get(rule_id, {"area": "custom", "severity": "medium"})
    values = {"rule_id": rule_id, "area": meta["area"], "severity": meta["severity"], **parts}
    return {n: _typed(values.get(n), t, n) for n, t in PAYLOAD_FIELDS}


def payload(rule_id: str, **parts) -> Column:
    """What a check says about the row it is about, as one struct."""
    return F.struct(*said(rule_id, **parts).values())


class Fired(NamedTuple):
    """A check: when it fires and what it then says."""

    when: Column
    parts: dict[str, Column]


def finding_key() -> Column:
    """Identity of a finding: check, item, variant, word and, when present, the field."""
    blank = [F.coalesce(F.col(c), F.lit("")) for c in ("rule_id", "product_id", "variant_id", "word")]
    field = F.when(F.coalesce(F.col("field"), F.lit("")) != "", F.concat(F.lit("|"), F.col("field"))).otherwise("")
    return F.concat(F.concat_ws("|", *blank), field)


def to_findings(df: DataFrame) -> DataFrame:
    """The fixed finding columns; what the input lacks becomes a typed null."""
    have = set(df.columns)
    cols = [
        finding_key().alias(n) if n == "finding_key"
        else (F.col(n) if n in have else F.lit(None)).cast(t).alias(n)
        for n, t in FINDING_FIELDS
    ]
    lacking = {c: F.lit(None).cast("string") for c in ("variant_id", "word", "field") if c not in have}
    return (df.withColumns(lacking) if lacking else df).select(*cols)


def emit(
    df: DataFrame, keys: Sequence[Column], singles: Sequence[Column], lists: Sequence[Column] = ()
) -> DataFrame:
    """One finding per payload that fired: a single projection over the rows, no shuffle.

    ``singles`` are payload structs that are null where the check passes, ``lists`` arrays of them.
    """
    kind = "array<struct<" + ", ".join(f"{n}: {t}" for n, t in PAYLOAD_FIELDS) + ">>"
    # Checks that pass leave nulls behind, which go after the explode: dropping them inside the array
    # would take the whole array out of generated code.
    arrays = [F.array(*singles)] if singles else []
    arrays += [F.coalesce(a, F.array().cast(kind)) for a in lists]
    found = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    exploded = exploded_rows(df.withColumn("_found", found), keys, "_found", "_f")
    return to_findings(exploded.select("*", "_f.*").drop("_f"))


def emit_fired(df: DataFrame, keys: Sequence[Column], checks: Sequence[Fired]) -> DataFrame:
    """One finding per check that fired, without a shuffle. Rows are repeated by the numbers of these checks and texts are made
    behind that, part by part: who only counts findings has no text made."""
    numbers = F.array(*[F.when(c.when, F.lit(i)).otherwise(F.lit(-1)) for i, c in enumerate(checks)])
    # The numbers as a column first: a generator too large for generated code would be interpreted, check by check.
    found = exploded_rows(df.withColumn("_numbers", F.array_remove(numbers, F.lit(-1))), df.columns, "_numbers", "_check")

    def part(name: str) -> Column:
        out = F
        for i, c in enumerate(checks):
            out = out.when(F.col("_check") == i, c.parts[name])
        return out.alias(name)

    return to_findings(found.select(*keys, *[part(n) for n, _ in PAYLOAD_FIELDS]))
