"""Unknown words: tokens against a dictionary table, suggestions by delete neighbourhood.

The dictionary is an input: ``word`` and, for ranking, ``freq``. Each step works on as little as
possible: a row contributes each of its words once, known words leave before any shuffle while the
dictionary is small enough to be sent around, and suggestions are looked up once per distinct word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareproof.functions import text as tx
from wareproof.operators.findings import edit, payload, to_findings
from wareproof.operators.item_checks import item_keys
from wareproof.operators.rows import exploded_column, exploded_rows
from wareproof.operators.skew import attach_groups
from wareproof.sources.records import Catalog

WORD = "[A-Za-z][A-Za-z']+"
LINKS = r"(?i)\b(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.[\w.-]+"
MIN_WORD = 4
MAX_EDITS = 2

FIELD = "struct<field: string, key: string, text: string, title_like: boolean>"


def prose(c: Column) -> Column:
    """Text without links and addresses."""
    t = tx.blank_if_null(c)
    return F.when(t.rlike(r"(?i)https?://|www\.|@"), F.regexp_replace(t, LINKS, " ")).otherwise(t)


def text_fields(items: DataFrame) -> Column:
    """Every human-written field of the items as label, key, text and whether it capitalizes words."""

    def one(label, key, text: Column, title_like: bool = False) -> Column:
        return F.struct(
            F.lit(label).alias("field"), F.lit(key).cast("string").alias("key"),
            tx.blank_if_null(text).alias("text"), F.lit(title_like).alias("title_like"),
        )

    fixed = F.array(
        one("Title", "title", prose(F.col("title")), True),
        one("Description", "descriptionHtml", prose(tx.plain_text(items))),
        one("SEO title", "seoTitle", prose(F.col("seo_title")), True),
        one("SEO description", "seoDescription", prose(F.col("seo_description"))),
        one("Vendor", "vendor", F.col("vendor")),
        one("Product type", "productType", F.col("product_type")),
        one("Tags", "tags", F.array_join("tags", " ")),
    )
    options = F.transform(
        "options",
        lambda o: F.struct(
            F.concat(F.lit("Option "), o["name"]).alias("field"), F.lit(None).cast("string").alias("key"),
            F.concat_ws(" ", o["name"], F.array_join(o["values"], " ")).alias("text"),
            F.lit(False).alias("title_like"),
        ),
    )
    return F.concat(fixed, options)


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(tx.blank_if_null(c), F.lit(WORD), F.lit(0))


def long_words_of(c: Column) -> Column:
    """Those of ``words_of`` with MIN_WORD letters: a shorter one holds no longer one, so the pattern can ask for the length."""
    return F.regexp_extract_all(tx.blank_if_null(c), F.lit(f"[A-Za-z][A-Za-z']{{{MIN_WORD - 1},}}"), F.lit(0))


def vendor_words(items: DataFrame) -> DataFrame:
    """(tenant, word): lower-case words of vendor names, which are trusted."""
    vendors = items.select("tenant", "vendor").distinct()
    return exploded_rows(vendors, ["tenant"], words_of(F.lower("vendor")), "word").distinct()


def seed_words(items: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """(tenant, word): the words a tenant taught plus its vendor words, in lower case."""
    out = vendor_words(items)
    if learned is not None:
        out = out.unionByName(learned.select("tenant", F.lower("word").alias("word"))).distinct()
    return out


def trusted_names(items: DataFrame, dictionary: DataFrame, min_items: int = 2) -> DataFrame:
    """(tenant, word): vendor words and capitalized title words, unknown to the dictionary, that at
    least ``min_items`` items share."""
    mine = F.array_distinct(
        F.transform(
            F.filter(
                F.concat(words_of(F.col("title")), words_of(F.col("seo_title"))),
                lambda w: w.rlike("^[A-Z][a-z']+$") & (F.length(w) >= MIN_WORD),
            ),
            F.lower,
        )
    )
    shared = (
        exploded_rows(items, ["tenant"], mine, "word")
        .groupBy("tenant", "word").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= min_items)
        .select("tenant", "word")
    )
    return without_known(shared, dictionary, "word").unionByName(vendor_words(items)).distinct()


def without_known(words: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """Rows whose word is in the dictionary neither as it is nor in lower case.

    ``column`` holds the lower-case word, ``word`` the word as written when that differs. The join
    type follows the size of the dictionary: Spark sends it to all tasks only while it is small.
    """
    known = dictionary.select(F.lower("word").alias("_known"), F.col("word").alias("_exact")).distinct()
    lower_known = known.filter(F.col("_exact") == F.col("_known")).select("_known").distinct()
    left = words.join(lower_known, F.col(column) == F.col("_known"), "left_anti")
    if column == "word" or "word" not in words.columns:
        capitalized = known.filter(F.col("_exact") != F.col("_known")).select("_exact")
        as_name = F.concat(F.upper(F.substring(column, 1, 1)), F.substring(F.col(column), F.lit(2), F.length(column)))
        return left.withColumn("_as", as_name).join(
            capitalized, F.col("_as") == F.col("_exact"), "left_anti"
        ).drop("_as")
    exact = known.filter(F.col("_exact") != F.col("_known")).select("_exact")
    return left.join(exact, F.col("word") == F.col("_exact"), "left_anti")


def candidate_words(items: DataFrame) -> DataFrame:
    """Words of an item worth checking: (tenant, id, field_pos, word_pos, word, lower, field, key, title_like).

    At least four letters, no capitals after the first letter, and capitalized only where a title
    capitalizes everything.
    """
    fields = exploded_column(items, ["tenant", "id"], text_fields(items), "_f", "field_pos")
    # Each spelling once per field, at its first place.
    words = F.array_distinct(long_words_of(F.col("_f.text")))
    kept = ["tenant", "id", "field_pos", *[F.col(f"_f.{c}").alias(c) for c in ("field", "key", "title_like")]]
    exploded = exploded_column(fields, kept, words, "word", "word_pos")
    capitalized = F.col("word").rlike("^[A-Z]")
    return exploded.filter(
        ~F.col("word").rlike("^.+[A-Z]") & (~capitalized | F.col("title_like"))
    ).withColumn("lower", F.lower("word"))


def deletes(word: Column, edits: int = MAX_EDITS) -> Column:
    """The word and everything it becomes by deleting up to ``edits`` letters."""

    def drop_one(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(w)),
            lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
        )

    found = F.array(word)
    ring = found
    for _ in range(edits):
        ring = F.array_distinct(F.flatten(F.transform(ring, drop_one)))
        found = F.concat(found, ring)
    return F.array_distinct(found)


# Cells of the distance table in memory at a time.
TABLE_CELLS = 4_000_000


def _osa(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances with swaps of neighbours as one edit, of pairs of words side by side."""
    width_a, width_b = max(map(len, a)), max(map(len, b))
    codes_a = np.array([[ord(c) for c in w.ljust(width_a, "\0")] for w in a], dtype=np.int32).reshape(len(a), width_a)
    codes_b = np.array([[ord(c) for c in w.ljust(width_b, "\1")] for w in b], dtype=np.int32).reshape(len(b), width_b)
    table = np.zeros((width_a + 1, width_b + 1, len(a)), dtype=np.int32)
    table[:, 0, :] = np.arange(width_a + 1)[:, None]
    table[0, :, :] = np.arange(width_b + 1)[:, None]
    for i in range(1, width_a + 1):
        for j in range(1, width_b + 1):
            differs = codes_a[:, i - 1] != codes_b[:, j - 1]
            best = np.minimum(table[i - 1, j], table[i, j - 1]) + 1
            best = np.minimum(best, table[i - 1, j - 1] + differs)
            if i > 1 and j > 1:
                swap = (codes_a[:, i - 1] == codes_b[:, j - 2]) & (codes_a[:, i - 2] == codes_b[:, j - 1])
                best = np.where(swap, np.minimum(best, table[i - 2, j - 2] + 1), best)
            table[i, j] = best
    return table[[len(w) for w in a], [len(w) for w in b], np.arange(len(a))]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance with swaps of neighbours as one edit. Pairs go by length, so that a long word takes the space of
    few pairs, not of a batch."""
    out = np.zeros(len(a), dtype=np.int32)
    a, b = a.tolist(), b.tolist()
    order = sorted(range(len(a)), key=lambda i: max(len(a[i]), len(b[i])), reverse=True)
    start = 0
    while start < len(order):
        widest = 1 + max(len(a[order[start]]), len(b[order[start]]))
        part = order[start:start + max(1, TABLE_CELLS // widest**2)]
        out[part] = _osa([a[i] for i in part], [b[i] for i in part])
        start += len(part)
    return pd.Series(out, dtype="int32")


def suggestions(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(lower, suggestion) for distinct unknown words within two edits of a dictionary word.

    Words meet on shared delete variants, so only near pairs are ever built. Ranked by distance,
    then frequency, then alphabet.
    """
    have_freq = "freq" in dictionary.columns
    entries = dictionary.select(
        F.col("word").alias("_entry"), F.lower("word").alias("_entry_lower"),
        (F.col("freq") if have_freq else F.lit(0)).cast("bigint").alias("_freq"),
    )
    # A word more than the edits longer than every dictionary word has no candidate: it makes no variants.
    longest = (dictionary.agg(F.max(F.length("word"))).first()[0] or 0) + MAX_EDITS
    asked = unknown.select("lower").distinct().filter(F.length("lower") <= longest)
    left = exploded_rows(asked, ["lower"], deletes(F.col("lower")), "_variant")
    right = exploded_rows(entries, ["*"], deletes(F.col("_entry_lower")), "_variant")
    near = F.abs(F.length("lower") - F.length("_entry_lower")) <= MAX_EDITS
    # Spark sizes exploded rows like the words they come from and would send all variants to every task: they are shuffled.
    pairs = (
        left.hint("merge").join(right.hint("merge"), "_variant")
        .filter(near)
        .select("lower", "_entry", "_entry_lower", "_freq")
        .distinct()
        .filter(F.levenshtein(F.col("lower"), F.col("_entry_lower"), 2 * MAX_EDITS) >= 0)
    )
    scored = pairs.withColumn("_d", osa_distance("lower", "_entry_lower")).filter(F.col("_d") <= MAX_EDITS)
    return scored.groupBy("lower").agg(
        F.min_by("_entry", F.struct("_d", -F.col("_freq"), "_entry")).alias("suggestion")
    )


def unknown_words(
    items: DataFrame,
    dictionary: DataFrame,
    trusted: DataFrame | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Candidate words no dictionary knows, once per item at their first place."""
    tokens = candidate_words(items)
    unknown = without_known(tokens, dictionary, "lower")
    for extra, only_capitalized in ((trusted, False), (names, True)):
        if extra is None:
            continue
        listed = extra.select("tenant", F.col("word").alias("lower")).distinct()
        if only_capitalized:
            listed = listed.withColumn("_cap", F.lit(True))
            unknown = unknown.withColumn("_cap", F.col("word").rlike("^[A-Z]"))
            unknown = unknown.join(listed, ["tenant", "lower", "_cap"], "left_anti").drop("_cap")
        else:
            unknown = unknown.join(listed, ["tenant", "lower"], "left_anti")
    return unknown


def misspellings(
    items: DataFrame,
    dictionary: DataFrame,
    trusted: DataFrame | None = None,
    names: DataFrame | None = None,
    with_suggestions: bool = True,
) -> DataFrame:
    """The unknown words of each item, each once at its first place, with a suggestion.

    A capitalized word is reported only when a dictionary word is within two edits.
    """
    unknown = unknown_words(items, dictionary, trusted, names)
    if with_suggestions:
        counted = unknown.groupBy("lower").agg(F.count(F.lit(1)).alias("_uses"))
        known_near = suggestions(counted, dictionary)
        facts = counted.join(known_near, "lower", "left")
        found = attach_groups(unknown, facts, ["lower"], "_uses", ["tenant", "id"]).drop("_uses")
        found = found.filter(~F.col("word").rlike("^[A-Z]") | F.col("suggestion").isNotNull())
    else:
        found = unknown.filter(~F.col("word").rlike("^[A-Z]")).withColumn("suggestion", F.lit(None).cast("string"))
    # A group is the unknown words of one item: never more than its own text holds.
    once = Window.partitionBy("tenant", "id", "lower").orderBy("field_pos", "word_pos")
    return found.withColumn("_seen", F.row_number().over(once)).filter("_seen = 1").drop("_seen")


def spelling(
    catalog: Catalog,
    dictionary: DataFrame,
    trusted: DataFrame | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Findings of unknown words."""
    found = misspellings(catalog.items, dictionary, trusted, names)
    slim = catalog.items.select(
        "tenant", "id", "title", "pos", "only_sku", "n_variants", "meta", text_fields(catalog.items).alias("_fields")
    )
    rows = found.join(slim, ["tenant", "id"])
    quoted = F.concat(F.lit('"'), F.col("word"), F.lit('" in '), F.col("field"))
    hint = F.concat(F.lit(' (maybe "'), F.col("suggestion"), F.lit('")'))
    text = F.element_at(F.col("_fields"), F.col("field_pos") + 1)["text"]
    made = payload(
        "spelling", detail=F.concat(quoted, F.coalesce(hint, F.lit(""))),
        edit=F.when(
            F.col("key").isNotNull(),
            edit(
                "word", field=F.col("key"), current=tx.around(text, F.col("word")), raw=F.col("word"),
                suggested=F.coalesce("suggestion", F.lit("")), apply=F.col("suggestion").isNotNull(),
            ),
        ),
    )
    keyed = rows.select(*item_keys(), "word", made.alias("_f"))
    return to_findings(keyed.select(*keyed.columns[:-1], *[f"_f.{c}" for c in ("rule_id", "area", "severity", "field", "detail", "current", "edit")]))
