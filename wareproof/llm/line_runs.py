"""Operator 8: repeated runs of lines, found in a suffix array over line ids; later copies are deleted.

Equal lines get equal ids. Prefix doubling ranks the suffixes of all documents' line sequences by their first 1, 2,
4, ... lines: the rank by 2^(k+1) lines is the number, in sort order, of the pair of ranks by 2^k lines at the place
and 2^k lines further on. Places whose rank is theirs alone can share nothing longer and leave, so each round is
smaller than the one before; a hot line or run is counted before it is shuffled.

A run is deleted if it holds ``min_words`` words and stands somewhere before. The suffixes that share their
first m lines are an interval of the suffix array whose common prefixes are at least m long. With 2^k the largest power up
to m, the ranks by 2^k lines of the run's first and of its last 2^k lines name that interval, and its
first place is the copy that stays. Any run of enough words is a union of shortest such runs, those that lose
their words without their first or without their last line, so it is enough to look these up: one begins and one
ends at every line. What they cover, merged, are the maximal repeated runs.

Everything is made of DataFrame operations; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareproof.llm.common import written
from wareproof.llm.order import numbered

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
# A document: whether it has an id, the id, the hash of its text; never null, and in the order of "before".
DOC = ["__has", "__doc", "__key"]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    kind = docs.schema[doc_id].dataType
    is_number = isinstance(kind, T.NumericType)
    own = F.col(doc_id) if is_number else F.col(doc_id).cast("string")
    nothing = F.lit(0).cast(kind) if is_number else F.lit("")
    return docs.withColumns({
        "__has": own.isNotNull(), "__doc": F.coalesce(own, nothing), "__key": F.xxhash64(text), "__lines": F.split(text, "\n", -1),
    })


def line_table(keyed: DataFrame, text: str) -> DataFrame:
    """(DOC, i, a, b, words): every line, as two hashes, with its number of words."""
    lines = keyed.select(*DOC, F.posexplode("__lines").alias("i", "line"))
    return lines.select(
        *DOC, "i", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"),
        F.regexp_count("line", F.lit(WORD)).alias("words"),
    )


def _ranked(places: DataFrame, pair: list[str]) -> DataFrame:
    """Places whose ``pair`` occurs more than once, with its number ``r`` in sort order."""
    repeated = places.groupBy(*pair).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    return places.join(numbered(repeated, pair, "r"), pair).drop(*pair)


def shortest_runs(places: DataFrame, min_words: int) -> DataFrame:
    """(DOC, s, m): for every repeated line the shortest run of repeated lines with enough words that begins
    with it, and the one that ends with it.

    Over a stretch of repeated lines words add up; the end of a run is the first line whose sum reaches a
    bound. Bounds and sums are sorted together, and a running minimum (maximum) finds it in one pass.
    """
    inside = Window.partitionBy(*DOC).orderBy("i")
    stretch = places.withColumn("g", F.col("i") - F.row_number().over(inside))
    group = Window.partitionBy(*DOC, "g")
    upto = stretch.withColumns({
        "upto": F.sum("words").over(group.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)),
        "all": F.sum("words").over(group),
    }).filter(F.col("all") >= min_words)

    def event(value: Column, is_bound: bool) -> Column:
        return F.struct(value.cast("bigint").alias("v"), F.lit(is_bound).alias("is_bound"))

    before = F.col("upto") - F.col("words")

    def found(line: Column, bound: Column, falling: bool) -> DataFrame:
        # At equal values lines come before bounds.
        events = upto.select(*DOC, "g", "i", F.explode(F.array(event(line, False), event(bound, True))).alias("x"))
        value = F.col("x.v").desc() if falling else F.col("x.v").asc()
        passed = group.orderBy(value, F.col("x.is_bound").asc()).rowsBetween(Window.unboundedPreceding, 0)
        own = F.when(~F.col("x.is_bound"), F.col("i"))
        other = (F.min(own) if falling else F.max(own)).over(passed)
        return events.withColumn("other", other).filter("x.is_bound AND other IS NOT NULL")

    begins = found(F.col("upto"), before + min_words, True)
    ends = found(before, F.col("upto") - min_words, False)
    return (
        begins.select(*DOC, F.col("i").alias("s"), (F.col("other") - F.col("i") + 1).alias("m"))
        .union(ends.select(*DOC, F.col("other").alias("s"), (F.col("i") - F.col("other") + 1).alias("m")))
        .distinct()
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(DOC, s, e): the merged runs of lines s to e - 1 that stand somewhere before."""
    lines = written(line_table(_keyed(docs.select(doc_id, text), doc_id, text), text), "lines")
    places = written(_ranked(lines, ["a", "b"]), "places").dropDuplicates([*DOC, "i"])
    runs = written(shortest_runs(places, min_words), "runs")
    longest = runs.agg(F.max("m")).first()[0] or 0
    k, level, levels = 0, places.select(*DOC, "i", "r"), None
    while 1 << k <= longest:
        if k:
            ahead = Window.partitionBy(*DOC).orderBy("i").rangeBetween(1 << (k - 1), 1 << (k - 1))
            paired = level.withColumn("p", F.max("r").over(ahead)).filter("p IS NOT NULL").withColumnRenamed("r", "q")
            level = written(_ranked(written(paired, "pairs"), ["q", "p"]), "ranks")
            if level.isEmpty():
                break
        own = level.withColumn("k", F.lit(k))
        levels = own if levels is None else levels.unionByName(own)
        k += 1
    if levels is None:
        return runs.select(*DOC, "s", F.col("m").alias("e")).limit(0)
    power = F.floor(F.log2(F.col("m").cast("double") + 0.5)).cast("int")
    sized = runs.withColumn("k", power).withColumn("last", F.col("s") + F.col("m") - F.call_function("shiftleft", F.lit(1), F.col("k")))
    head = levels.select(*DOC, "k", F.col("i").alias("s"), F.col("r").alias("head"))
    tail = levels.select(*DOC, "k", F.col("i").alias("last"), F.col("r").alias("tail"))
    named = written(sized.join(head, [*DOC, "k", "s"]).join(tail, [*DOC, "k", "last"]), "named")
    interval = ["m", "head", "tail"]
    place = F.struct(*DOC, "s")
    firsts = named.groupBy(*interval).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    firsts = written(firsts, "firsts")  # else the join happens where they are counted, and a hot run cannot be split
    later = named.join(firsts, interval).filter(place > F.col("first")).select(*DOC, "s", (F.col("s") + F.col("m")).alias("e"))
    by_start = Window.partitionBy(*DOC).orderBy("s", "e")
    reached = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = later.withColumn("opens", F.when(F.col("s") <= reached, 0).otherwise(1))
    merged = opens.withColumn("run", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy(*DOC, "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def without_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text",
    names: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with the text freed of later copies of runs of lines, and the numbers of its lines and of those removed.

    Lines end at line feeds. "Before" means in a row of smaller ``doc_id`` (a null one is smallest; on ties the row
    whose text has the smaller hash), or further up in the same text. Rows with equal id and equal text are
    one document written twice: neither is a copy of the other, and both lose the same lines. A null text stays null and
    has no lines; an empty text has one line without words and stays; an empty table stays empty. A
    text all of whose lines go becomes empty. Columns called as ``names`` says are replaced.
    """
    runs = repeated_runs(docs, min_words, doc_id, text)
    gone = F.flatten(F.collect_list(F.sequence(F.col("s"), F.col("e") - 1)))
    removed = runs.groupBy(*DOC).agg(gone.alias("__gone"))
    joined = _keyed(docs, doc_id, text).join(removed, DOC, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.col("__lines")[i]), "\n")
    return joined.withColumns({
        text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(rest),
        names[0]: F.greatest(F.size("__lines"), F.lit(0)).cast("bigint"),
        names[1]: F.greatest(F.size("__gone"), F.lit(0)).cast("bigint"),
    }).select(*(c for c in docs.columns if c not in names), *names)


# The same by the contents of runs, for documents with distinct ids.
SQL = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS i, l[i] AS line, len(regexp_extract_all(l[i], '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
sums AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM lines),
starts AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM sums a JOIN sums b
  ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= {MIN_WORDS} GROUP BY 1, 2),
ends AS (
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM sums a JOIN sums b
  ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= {MIN_WORDS} GROUP BY 1, 3),
runs AS (
  SELECT r.doc_id, r.s, r.e, string_split(d.text, chr(10))[s + 1:e + 1] AS content
  FROM (SELECT * FROM starts UNION SELECT * FROM ends) r JOIN documents d USING (doc_id)),
later AS (
  SELECT *, min((doc_id, s)) OVER (PARTITION BY content) AS first FROM runs),
removed AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM later WHERE (doc_id, s) > first),
rest AS (
  SELECT l.doc_id, count(*) AS n_lines, count(r.i) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (r.i IS NULL), '') AS text
  FROM lines l LEFT JOIN removed r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY 1)
SELECT d.doc_id, r.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN rest r USING (doc_id)
"""
