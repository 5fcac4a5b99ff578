"""Text helpers as Column expressions (no UDFs).

``WS`` is the full Unicode white-space class; Spark's own ``trim`` strips only U+0020 and Java's
``\\s`` misses the no-break space, so every helper below uses the class explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.constants import ENGLISH_STOPWORDS, FOREIGN_WORDS, PICTOGRAPH_RANGES

# White space as a regex class body (usable inside and outside brackets).
_WS_BODY = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{_WS_BODY}]"
_WS_NOT_SPACE = "[" + _WS_BODY.replace(" ", "") + "]"
NOT_WS_HYPHEN = f"[^{_WS_BODY}-]"
# The same white space, character by character.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
APOSTROPHES = "'\u2019\u02bc"
ELLIPSIS = "\u2026"
PICTOGRAPH = "[" + "".join(
    f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in PICTOGRAPH_RANGES
) + "]"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# The column of stored features that holds the plain description.
PLAIN_TEXT = "plain_text"


def js_trim(c: Column) -> Column:
    """Strip every kind of white space from both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def starts_printable(c: Column) -> Column:
    """The first character is printable ASCII and no space: two comparisons of bytes."""
    return (c >= F.lit("!")) & (c < F.lit("\x7f"))


def trimmed(c: Column) -> Column:
    """``js_trim`` of a stored value, which is looked at more than once: a pattern is only tried if an end is not printable ASCII."""
    return F.when(starts_printable(c) & starts_printable(F.substring(c, -1, 1)), c).otherwise(js_trim(c))


def without_spaces_and_hyphens(c: Column) -> Column:
    """The text without any white space and hyphens."""
    return F.translate(c, WS_CHARS + "-", "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space; single spaces stay where they are."""
    return F.regexp_replace(c, f"{WS}{{2,}}|{_WS_NOT_SPACE}", " ")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text: no character that is not white space."""
    text = blank_if_null(c)
    return ~(starts_printable(text) | text.rlike(f"[^{_WS_BODY}]"))


def strip_html(html: Column) -> Column:
    """Tags and no-break-space entities to spaces, white space collapsed, ends trimmed."""
    h = blank_if_null(html)
    no_tags = F.when(F.contains(h, F.lit("<")), F.regexp_replace(h, "<[^>]*>", " ")).otherwise(h)
    return F.trim(collapse(F.replace(no_tags, F.lit("&nbsp;"), F.lit(" "))))


def plain_text(items: DataFrame) -> Column:
    """The plain description: stored with the features, or made from the markup."""
    return F.col(PLAIN_TEXT) if PLAIN_TEXT in items.columns else strip_html(F.col("description_html"))


def word_count(plain: Column) -> Column:
    """Words of collapsed, trimmed text: one more than its single spaces."""
    spaces = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.when(plain == "", F.lit(0)).otherwise(spaces + 1)


def norm(c: Column) -> Column:
    """Comparison form: trimmed, lower case, white space collapsed."""
    return collapse(F.lower(trimmed(blank_if_null(c))))


def any_of_words(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The first phrase, in list order, that occurs in the (already lower-case) text."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases])


def first_chars(c: Column, n: int) -> Column:
    """The first n characters with an ellipsis when there are more."""
    t = js_trim(blank_if_null(c))
    return F.when(
        F.length(t) > n, F.concat(js_trim(F.substring(t, 1, n)), F.lit(ELLIPSIS))
    ).otherwise(t)


def around(text: Column, word: Column, span: int = 20) -> Column:
    """The first occurrence of ``word`` with up to ``span`` characters on either side."""
    t = blank_if_null(text)
    at = F.position(F.lower(word), F.lower(t))
    start = F.greatest(F.lit(1), at - span)
    stop = F.least(F.length(t), at + F.length(word) + span - 1)
    cut = F.substring(t, start, stop - start + 1)
    return F.when(at == 0, first_chars(t, 2 * span + 20)).otherwise(
        F.concat(
            F.when(start > 1, F.lit(ELLIPSIS)).otherwise(""),
            cut,
            F.when(stop < F.length(t), F.lit(ELLIPSIS)).otherwise(""),
        )
    )


def cut_at_word(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word boundary when one lies beyond 60% of it."""
    t = js_trim(blank_if_null(c))
    cut = F.substring(t, 1, limit + 1)
    from_end = F.instr(F.reverse(cut), " ")
    boundary = F.when(from_end > 0, F.length(cut) - from_end).otherwise(F.lit(-1))
    kept = F.when(boundary * 10 > limit * 6, F.substring(cut, F.lit(1), boundary)).otherwise(
        F.substring(cut, 1, limit)
    )
    return F.when(F.length(t) <= limit, t).otherwise(
        F.regexp_replace(kept, f"[{_WS_BODY},;:.\\-\u2013]+$", "")
    )


def quote_regex(c: Column) -> Column:
    """A column value as a literal inside a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


# ---- casing --------------------------------------------------------------------------------------

def _pieces(c: Column) -> Column:
    """Alternating separators and tokens; joined they are the text again."""
    return F.regexp_extract_all(c, F.lit(f"[{_WS_BODY}-]+|{NOT_WS_HYPHEN}+"), F.lit(0))


def title_case_from_caps(c: Column) -> Column:
    """Lower case with a capital ASCII letter after the start, white space and hyphens."""

    def cap(p: Column) -> Column:
        return F.when(
            p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))
        ).otherwise(p)

    return F.array_join(F.transform(_pieces(F.lower(c)), cap), "")


def _split_core(p: Column) -> tuple[Column, Column, Column]:
    """A token as what precedes its first word, the word, and the rest."""
    core = F.regexp_extract(p, f"\\p{{L}}[\\p{{L}}{APOSTROPHES}]*", 0)
    before = F.regexp_extract(p, r"^\P{L}*", 0)
    after = F.substring(p, F.length(before) + F.length(core) + 1, F.length(p))
    return before, core, after


def _capitalize(core: Column) -> Column:
    return F.concat(F.upper(F.substring(core, 1, 1)), F.substring(core, F.lit(2), F.length(core)))


_LOWER_WORD = f"^\\p{{Ll}}[\\p{{Ll}}{APOSTROPHES}]*$"
_CAPITALIZED_WORD = f"^\\p{{Lu}}[\\p{{Ll}}{APOSTROPHES}]*$"


def to_title_case(c: Column) -> Column:
    """Lower-case words get a capital; acronyms, brands, codes and punctuation stay."""

    def recase(p: Column) -> Column:
        before, core, after = _split_core(p)
        return F.when(core.rlike(_LOWER_WORD), F.concat(before, _capitalize(core), after)).otherwise(p)

    return F.array_join(F.transform(_pieces(c), recase), "")


def to_sentence_case(c: Column) -> Column:
    """The first word gets a capital, later capitalized words lose theirs."""
    pieces = _pieces(c)
    first_word = F.array_position(F.transform(pieces, lambda p: p.rlike(r"\p{L}")), True)

    def recase(p: Column, i: Column) -> Column:
        before, core, after = _split_core(p)
        is_first = (i + 1) == first_word
        return (
            F.when(is_first & core.rlike(_LOWER_WORD), F.concat(before, _capitalize(core), after))
            .when(~is_first & core.rlike(_CAPITALIZED_WORD), F.concat(before, F.lower(core), after))
            .otherwise(p)
        )

    return F.array_join(F.transform(pieces, recase), "")


def is_title_case(c: Column) -> Column:
    """At least 80% of the words with letters start with a capital; null with fewer than two words."""
    words = F.regexp_count(c, F.lit(f"{NOT_WS_HYPHEN}*\\p{{L}}{NOT_WS_HYPHEN}*"))
    caps = F.regexp_count(
        c, F.lit(f"(?<!{NOT_WS_HYPHEN})[^\\p{{L}}{_WS_BODY}-]*\\p{{Lu}}{NOT_WS_HYPHEN}*")
    )
    return F.when(words >= 2, caps * 5 >= words * 4)


def is_all_caps(c: Column, min_letters: int = 6) -> Column:
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return (F.length(letters) >= min_letters) & (letters == F.upper(letters))


# ---- language ------------------------------------------------------------------------------------

def ascii_word_count(lower_text: Column) -> Column:
    return F.regexp_count(lower_text, F.lit("[a-z']+"))


def stopword_count(lower_text: Column, words: list[str] = ENGLISH_STOPWORDS) -> Column:
    return F.regexp_count(lower_text, F.lit(f"(?<![a-z']){any_of_words(words)}(?![a-z'])"))


def looks_foreign(text: Column) -> Column:
    """A letter outside A-Z, or at least two common words of other languages."""
    letters = F.lower(F.regexp_replace(text, f"[^\\p{{L}}{_WS_BODY}]", ""))
    hits = F.regexp_count(
        letters, F.lit(f"(?<![^{_WS_BODY}]){any_of_words(FOREIGN_WORDS)}(?![^{_WS_BODY}])")
    )
    return text.rlike(r"[\p{L}&&[^A-Za-z]]") | (hits >= 2)


# ---- links ---------------------------------------------------------------------------------------

def link_tags(html: Column) -> Column:
    """Anchor tags that are links: with an href, or with neither name nor id."""
    h = blank_if_null(html)
    tags = F.when(
        h.rlike("(?i)<a\\b"), F.regexp_extract_all(h, F.lit(r"(?i)<a\b[^>]*>"), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))
    return F.filter(tags, lambda t: t.rlike(r"(?i)\bhref\s*=") | ~t.rlike(r"(?i)\b(name|id)\s*="))


def link_target(tag: Column) -> Column:
    href = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    return js_trim(F.concat(*[F.regexp_extract(tag, href, i) for i in (1, 2, 3)]))


def is_dead_target(target: Column) -> Column:
    return (target == "") | target.rlike("(?i)^(#|javascript:)")


def code_part(c: Column) -> Column:
    """Upper-case letters and digits joined by single hyphens."""
    return F.regexp_replace(
        F.regexp_replace(F.upper(blank_if_null(c)), "[^A-Z0-9]+", "-"), "^-+|-+$", ""
    )
