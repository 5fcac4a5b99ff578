"""Operator 6: quality rules with thresholds that follow each language and source.

Every document gets counts (words, symbols, repeated lines and windows) and from them four whole-number
measures. Their distributions per language and source are kept as quantile sketches: logarithmic buckets with
counts (the idea of HDR histograms and DDSketch), 1/64 wide relative to their value, which merge by adding.
Sketches of a language and of everything are merges of those of its sources. From the quartiles of the
finest level with at least ``MIN_DOCS`` documents come the bounds (outer fences), which are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.llm.common import parts, sums_of, written

BATCH_BYTES = 6_000_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 20, 30  # fixed values of the base rule; the second in percent
MIN_DOCS = 50
FENCE = 3
# measure -> (numerator times, denominator, narrowest spread between the quartiles). Documents without words have none.
MEASURES = {
    "word_length": ("100 * word_chars", "n_words", 50),
    "symbol_rate": ("1000 * n_symbols", "n_words", 30),
    "line_repeats": ("1000 * n_dup_lines", "n_lines", 150),
    "word_repeats": ("1000 * n_repeat_words", "n_words", 60),
}
LOW_BOUNDED = ("word_length",)
SIGNALS = (
    "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
)

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[b for b in range(256) if b & 0xC0 != 0x80 and b != 0x20 and not 0x09 <= b <= 0x0D]] = True


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for every pair, equal for equal pairs."""
    width = int(right.max()) + 1 if len(right) else 1
    return pd.factorize(left.astype(np.int64) * width + right)[0]


def repeated_words(words: np.ndarray, per_doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each document inside windows of ``window`` words (a power of two) that it holds twice or more."""
    ids = words
    step = 1
    while step < window:
        ids = _pairs(ids[:-step], ids[step:]) if len(ids) > step else ids[:0]
        step *= 2
    of = np.repeat(np.arange(len(per_doc)), per_doc)
    starts = np.flatnonzero(of[: len(ids)] == of[window - 1:]) if len(ids) else np.zeros(0, dtype=np.int64)
    same = _pairs(of[starts], ids[starts]) if len(starts) else starts
    hit = starts[np.bincount(same)[same] > 1] if len(starts) else starts
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + window, -1)
    return sums_of((np.cumsum(change)[:-1] > 0).astype(np.int64), per_doc)


def counts(texts: list[bytes | None]) -> list[np.ndarray]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows, and lines with a word."""
    texts = [t or b"" for t in texts]
    split = [t.split() for t in texts]
    per_doc = np.array([len(w) for w in split], dtype=np.int64)
    ids = pd.factorize(np.array([w for one in split for w in one] or [b""], dtype=object))[0][: int(per_doc.sum())]
    marks = _WORD_BYTE[np.frombuffer(b"".join(texts), dtype=np.uint8)].astype(np.int64)
    chars = sums_of(marks, np.array([len(t) for t in texts], dtype=np.int64))
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], dtype=np.int64)
    lines = [[line for line in t.split(b"\n") if line.strip()] for t in texts]
    n_lines = np.array([len(one) for one in lines], dtype=np.int64)
    repeats = n_lines - np.array([len(set(one)) for one in lines], dtype=np.int64)
    return [per_doc, chars, symbols, repeats, repeated_words(ids, per_doc), n_lines]


def signals(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """The counts of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", BATCH_BYTES):
            found = counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(x) for x in found],
                [c.split()[0] for c in SIGNALS.split(", ")],
            )

    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"), F.col(text).cast("binary").alias("text"),
    ).mapInArrow(run, SIGNALS)


# ---- sketches ------------------------------------------------------------------------------------

def bucket(value: Column) -> Column:
    """The lower end of a whole number's bucket: itself below 128, else its leading seven bits."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one sketch per language, source and measure."""
    values = F.array(*(
        F.struct(F.lit(name).alias("measure"), F.expr(f"CASE WHEN {below} > 0 THEN ({above}) DIV {below} END").alias("value"))
        for name, (above, below, _) in MEASURES.items()
    ))
    return (
        counted.select("lang", "source", F.explode(values).alias("m")).filter(F.col("m.value").isNotNull())
        .groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket(F.col("m.value")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, docs, q1, q3) of the sketches merged over everything but ``keys``. The quartile is the
    bucket in which the share of documents is reached."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = merged.select(*keys, "measure", "bucket", upto.alias("upto"), F.sum("n").over(group).alias("docs"))
    return placed.groupBy(*keys, "measure").agg(
        F.max("docs").alias("docs"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs") * 3, F.col("bucket"))).alias("q3"),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high) per language and source, from the finest level with
    enough documents; the level of everything counts whatever its size."""
    sketch = written(sketch, "sketches")
    fine = quartiles(sketch, ["lang", "source"]).alias("f")
    by_lang = quartiles(sketch, ["lang"]).alias("l")
    overall = quartiles(sketch, []).alias("o")
    joined = (
        fine.join(by_lang, F.col("f.lang").eqNullSafe(F.col("l.lang")) & (F.col("f.measure") == F.col("l.measure")))
        .join(overall, F.col("f.measure") == F.col("o.measure"))
    )
    def level(name: str) -> Column:
        pick = F.when(F.col("f.docs") >= MIN_DOCS, F.col(f"f.{name}"))
        return pick.when(F.col("l.docs") >= MIN_DOCS, F.col(f"l.{name}")).otherwise(F.col(f"o.{name}"))

    bounds = joined.select(
        F.col("f.lang").alias("lang"), F.col("f.source").alias("source"), F.col("f.measure").alias("measure"),
        level("q1").alias("q1"), level("q3").alias("q3"),
    )
    least = F.create_map(*(F.lit(x) for name, (_, _, narrow) in MEASURES.items() for x in (name, narrow)))
    spread = F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")].cast("bigint")) * FENCE
    bounds = bounds.select("lang", "source", "measure", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    return bounds.groupBy("lang", "source").agg(*(
        F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{name}_{side}")
        for name in MEASURES for side in ("low", "high") if side == "high" or name in LOW_BOUNDED
    ))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    ``base_failed`` is the fixed base rule. ``kept`` is false for those, and for documents with a measure beyond
    the bounds of their language and source; null languages and sources are groups of their own. A null text
    has no words. Rows that share an id each give a row and count in the sketches; other columns are ignored;
    an empty table gives no rows. Hot groups cost nothing extra: sketches are built before the shuffle, and the
    bounds, a row per group, are joined with skew handling.
    """
    counted = written(signals(docs, doc_id, text, lang, source), "signals")
    bounds = thresholds(sketches(counted)).withColumnsRenamed({"lang": "b_lang", "source": "b_source"})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    beyond = F.lit(False)
    for name, (above, below, _) in MEASURES.items():
        value = F.expr(f"CASE WHEN {below} > 0 THEN ({above}) DIV {below} END")
        beyond = beyond | F.coalesce(value > F.col(f"{name}_high"), F.lit(False))
        if name in LOW_BOUNDED:
            beyond = beyond | F.coalesce(value < F.col(f"{name}_low"), F.lit(False))
    on = F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source"))
    return counted.join(bounds, on, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~beyond).alias("kept"),
    )


# ---- the same in SQL -----------------------------------------------------------------------------

def _sql() -> str:
    value = {n: f"CASE WHEN {below} > 0 THEN ({above}) // {below} END" for n, (above, below, _) in MEASURES.items()}
    shift = "greatest(length(bin(value)) - 7, 0)"

    def level(keys: str) -> str:
        group = f"PARTITION BY {keys}measure"
        return f"""
          SELECT {keys}measure, max(docs) AS docs, min(bucket) FILTER (upto * 4 >= docs) AS q1,
                 min(bucket) FILTER (upto * 4 >= docs * 3) AS q3
          FROM (SELECT *, sum(n) OVER ({group} ORDER BY bucket) AS upto, sum(n) OVER ({group}) AS docs
                FROM (SELECT {keys}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL"""

    pick = "CASE WHEN f.docs >= {m} THEN f.{q} WHEN l.docs >= {m} THEN l.{q} ELSE o.{q} END AS {q}"
    spread = f"{FENCE} * greatest(q3 - q1, CASE measure " + " ".join(f"WHEN '{n}' THEN {x[2]}" for n, x in MEASURES.items()) + " END)"
    beyond = " OR ".join(
        [f"coalesce({v} > max(high) FILTER (b.measure = '{n}'), false)" for n, v in value.items()]
        + [f"coalesce({value[n]} < max(low) FILTER (b.measure = '{n}'), false)" for n in LOW_BOUNDED]
    )
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    return f"""
    WITH base AS (
      SELECT doc_id, lang, source, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    windows AS (
      SELECT doc_id, i, w[i:i + {WINDOW - 1}] AS part
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM base)),
    repeats AS (
      SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p
            FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, part) AS c FROM windows) WHERE c > 1) GROUP BY 1),
    lines AS (
      SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
    counted AS (
      SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
      FROM base LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)),
    sketch AS (
      SELECT lang, source, measure, (value >> {shift}) << {shift} AS bucket, count(*) AS n
      FROM ({" UNION ALL ".join(f"SELECT lang, source, '{n}' AS measure, {v} AS value FROM counted" for n, v in value.items())})
      WHERE value IS NOT NULL GROUP BY ALL),
    bounds AS (
      SELECT lang, source, measure, q1 - {spread} AS low, q3 + {spread} AS high
      FROM (SELECT f.lang, f.source, f.measure, {pick.format(m=MIN_DOCS, q="q1")}, {pick.format(m=MIN_DOCS, q="q3")}
            FROM ({level("lang, source, ")}) f
            JOIN ({level("lang, ")}) l ON f.lang IS NOT DISTINCT FROM l.lang AND f.measure = l.measure
            JOIN ({level("")}) o ON f.measure = o.measure)),
    judged AS (
      SELECT {columns}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
             {beyond} AS beyond
      FROM counted c LEFT JOIN bounds b ON c.lang IS NOT DISTINCT FROM b.lang AND c.source IS NOT DISTINCT FROM b.source
      GROUP BY {columns}, n_lines)
    SELECT {columns}, base_failed, NOT base_failed AND NOT beyond AS kept FROM judged"""


SQL = _sql()
