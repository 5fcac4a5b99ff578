"""Users' regular expressions, written for JavaScript, as expressions of the engine: a translation and a screen.

A pattern is cut into tokens. What is literal there and special here is escaped (a brace that starts no
repetition, an opening bracket or ampersand inside a class, letters with a needless backslash); what still cannot be
compiled is refused with a reason. Both are columns, so one bad pattern never ends a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = (
    r"\(\?(?:[:=!]|<[=!]|<[A-Za-z][A-Za-z0-9]*>)|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\c[A-Za-z]|\\k<[A-Za-z]\w*>|\\[\s\S]"
    r"|\[\^?(?:\\[\s\S]|[^\]\\])*\]|\{\d+(?:,\d*)?\}|[\s\S]"
)
CLASS_TOKEN = r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\c[A-Za-z]|\\[\s\S]|[\s\S]"
SHORTHAND = r"\\[dDwWsS]"


def _tokens(pattern: Column, token: str = TOKEN) -> Column:
    return F.regexp_extract_all(pattern, F.lit(token), F.lit(0))


def _escape(t: Column, letters: str, more: dict[str, str]) -> Column:
    """An escape of one character: letters that mean nothing lose their backslash, control letters are capitals."""
    out = F.when(t.rlike(r"^\\c[A-Za-z]$"), F.concat(F.lit(r"\c"), F.upper(F.substring(t, 3, 1)))).when(t.rlike(rf"^\\[A-Za-z&&[^{letters}]]$"), F.substring(t, 2, 1))
    for before, after in more.items():
        out = out.when(t == before, F.lit(after))
    return out.otherwise(t)


def _class(t: Column) -> Column:
    """A character class."""
    negated = F.startswith(t, F.lit("[^"))
    inner = F.when(negated, F.substring(t, F.lit(3), F.length(t) - 3)).otherwise(F.substring(t, F.lit(2), F.length(t) - 2))
    inner = F.regexp_replace(F.regexp_replace(inner, rf"({SHORTHAND})-", r"$1\\-"), rf"-(?={SHORTHAND})", r"\\-")

    def one(c: Column) -> Column:
        literal = F.when(c == "[", F.lit(r"\[")).when(c == "&", F.lit(r"\&"))
        return literal.otherwise(_escape(c, "dDwWsStnrf", {r"\b": r"\x08", r"\v": r"\x0B", r"\0": r"\x00"}))

    translated = F.array_join(F.transform(_tokens(inner, CLASS_TOKEN), one), "")
    return F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), translated, F.lit("]"))


def to_engine(pattern: Column) -> Column:
    """The pattern in the engine's syntax."""
    def one(t: Column) -> Column:
        is_class = t.rlike(r"^\[[\s\S]*\]$")
        own = F.when(is_class, _class(t)).when(t == "{", F.lit(r"\{"))
        return own.otherwise(_escape(t, "dDwWsSbBtnrf", {r"\v": r"\x0B", r"\0": r"\x00"}))

    return F.array_join(F.transform(_tokens(pattern), one), "")


def _bad_range(t: Column) -> Column:
    """A class with a range that runs backwards, or whose ends are escapes that would have to be compared."""
    chars = F.filter(_tokens(F.regexp_replace(t, rf"{SHORTHAND}-|-{SHORTHAND}", "a"), CLASS_TOKEN), lambda c: c != "")
    places = F.sequence(F.lit(2), F.greatest(F.size(chars) - 3, F.lit(2)))

    def at(i: Column) -> Column:
        left, dash, right = F.get(chars, i - 1), F.get(chars, i), F.get(chars, i + 1)
        escaped = left.rlike(r"^\\[A-Za-z0-9]") | right.rlike(r"^\\[A-Za-z0-9]")
        last = [F.ascii(F.substring(c, -1, 1)) for c in (left, right)]
        ends_range = (i > 3) & (F.get(chars, i - 2) == "-")  # then the dash is a letter like any other
        inside = ~ends_range & (i + 1 < F.size(chars) - 1) & ~((i == 2) & (left == "^") & (F.get(chars, F.lit(1)) == "^"))
        return F.coalesce((dash == "-") & inside & (escaped | (last[0] > last[1])), F.lit(False))

    return F.exists(places, at)


def problem(pattern: Column) -> Column:
    """Why the translated pattern cannot be used, or null."""
    def kind(t: Column) -> Column:
        low, high = (F.regexp_extract(t, r"^\{(\d{1,9}),(\d{1,9})\}$", k) for k in (1, 2))
        backwards = (low != "") & (F.try_to_number(low, F.lit("999999999")) > F.try_to_number(high, F.lit("999999999")))
        is_class = t.rlike(r"^\[[\s\S]*\]$")
        return (
            F.when(t.isin("[", "\\", "[]", "[^]"), F.lit("x"))
            .when(is_class, F.when(_bad_range(t), F.lit("x")).otherwise(F.lit("a")))
            .when(t.rlike(r"^\{\d{10,}|^\{\d+,\d{10,}") | F.coalesce(backwards, F.lit(False)), F.lit("x"))
            .when(t.rlike(r"^\\k<"), F.lit("r"))
            .when(t.rlike(r"^\(\?<[=!]"), F.lit("L")).when(F.startswith(t, F.lit("(")), F.lit("("))
            .when(t.isin(")", "|", "?"), t).when(t.isin("^", "$"), F.lit("n"))
            .when(t == "+", F.lit("u")).when(t == "*", F.lit("u")).when(t.rlike(r"^\{\d+,\}$"), F.lit("u"))
            .when(t.rlike(r"^\{\d"), F.lit("q")).otherwise(F.lit("a"))
        )

    kinds = F.transform(_tokens(pattern), kind)
    shape = F.array_join(kinds, "")
    depth = F.aggregate(
        kinds, F.lit(0),
        lambda d, k: F.when(d < 0, d).when(k.isin("(", "L"), d + 1).when(k == ")", d - 1).otherwise(d),
    )
    # Where the open lookbehind began (0: in none), and whether a repeat without a bound stands in one, or a repeated group, whose
    # length the engine does not work out.
    look = F.aggregate(
        kinds, F.struct(F.lit(0).alias("d"), F.lit(0).alias("at"), F.lit(False).alias("bad"), F.lit("").alias("last")),
        lambda s, k: F.struct(
            (s["d"] + F.when(k.isin("(", "L"), 1).when(k == ")", -1).otherwise(0)).alias("d"),
            F.when((k == "L") & (s["at"] == 0), s["d"] + 1).when((k == ")") & (s["at"] == s["d"]), 0).otherwise(s["at"]).alias("at"),
            (s["bad"] | ((s["at"] > 0) & ((k == "u") | ((k == "q") & (s["last"] == ")"))))).alias("bad"), k.alias("last")),
        lambda s: s["bad"],
    )
    return (
        F.when(shape.contains("x"), F.lit("has an open or empty class, a backward range or a loose backslash"))
        .when(depth != 0, F.lit("has unmatched parentheses"))
        .when(shape.rlike(r"(^|[(L|n])[qu?]|[qu?][qu]|[qu?]\?[qu?]"), F.lit("repeats nothing"))
        .when(shape.contains("r"), F.lit("refers back to a group"))
        .when(look, F.lit("looks behind without a bound"))
    )
