"""Operator 9: mixing sources to target weights.

The documents of a source, in the order of a hash, are one long row of words, packed into blocks of ``BLOCK``
words. A source's target is a number of draws (slots): whole passes over its blocks and a part of one more. First every output shard draws
how many slots each source gets in it: independent Poisson counts with the sources' shares as means, which given a shard's
size are a multinomial draw over the sources. The counts of a source are then brought to its number of slots, in proportion and in whole numbers,
so that targets are met. A shard's slots come from these counts, one range of slots per shard and source. In every pass
a pseudorandom permutation of the source's block numbers says which block a slot takes, so no block is
taken more often than passes begin, and block numbers join slots to the documents in them. The last slot of a source
takes only as many words as are missing.

The permutation is swap-or-not (Hoang, Morris and Rogaway, 2012): a round maps x to K - x or leaves it, as a hash of
the larger of the two says. It works for any length, undoes itself round by round and needs no sorting.

Everything is made of DataFrame operations. Prefix sums over a source go over hash buckets first, so no task holds a
whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareproof.llm.common import written
from wareproof.llm.order import numbered

# Fixed values of the mix: weights of the sources in order, and all targets as a share of all sizes.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2

BLOCK = 64
BUCKET_DOCS = 4096
CHUNK = 16_384
MAX_TASKS = 10_000
ROUNDS = 8
SHARDS = 64
SMALL_MEAN = 12
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(row, doc_id, source, h, size) of every row. ``h`` is a hash of id and text and orders a source's documents."""
    return written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.xxhash64(doc_id, text).alias("h"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    ), "sizes")


def fill_level(sources: DataFrame, total: float) -> float:
    """The words per weight at which targets, stopped at their caps, add up to ``total``. Each step gives what
    the stopped sources leave to the others; it only adds up a table of sources."""
    level, stopped = 0.0, -1
    while True:
        is_stopped = F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(
            F.sum(is_stopped.cast("int")).alias("n"), F.sum(F.when(is_stopped, F.col("cap"))).alias("cap"),
            F.sum(F.when(~is_stopped, F.col("weight"))).alias("weight"),
        ).first()
        if (row["n"] or 0) == stopped or not row["weight"]:
            return level
        stopped = row["n"] or 0
        level = (total - (row["cap"] or 0)) / row["weight"]


def source_table(sized: DataFrame) -> DataFrame:
    """(source, number, n, source_size, weight, target, words, blocks): ``words`` is the target in whole words."""
    grouped = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = numbered(grouped.withColumn("is_null", F.col("source").isNull()), ["is_null", "source"], "number").drop("is_null")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    sources = written(ranked.withColumns({"weight": weight, "cap": F.col("source_size") * MOST}), "sources")
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * SHARE
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(fill_level(sources, total)))
    return sources.withColumn("target", target).withColumns({
        "words": F.least(F.floor(F.col("target") + 0.5).cast("bigint"), F.col("cap")),
        "blocks": F.floor((F.col("source_size") + BLOCK - 1) / BLOCK).cast("bigint"),
    }).drop("cap")


def permuted(df: DataFrame, place: Column, name: str, seed: int, inverse: bool = False) -> DataFrame:
    """``df`` with ``name``: the image of ``place`` under the permutation of 0 .. blocks - 1 of the row's source."""
    n = F.greatest(F.col("blocks"), F.lit(1))

    def swap_or_not(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, "number"), n) - x, n)
        bit = F.xxhash64(F.lit(seed), r, "number", F.greatest(x, other)).bitwiseAND(1)
        return F.when(bit == 1, other).otherwise(x)

    rounds = range(ROUNDS)
    return df.withColumn(name, F.aggregate(F.array(*map(F.lit, reversed(rounds) if inverse else rounds)), place, swap_or_not))


def uniform(seed: int, salt: int, *columns: str) -> Column:
    """A number in (0, 1) hashed from the columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *columns), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def poisson(mean: Column, seed: int, *columns: str) -> Column:
    """A Poisson count hashed from the columns: by inversion for small means, from a normal number for large ones."""
    u, v = uniform(seed, -2, *columns), uniform(seed, -3, *columns)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(8 * SMALL_MEAN)),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).cast("bigint").alias("n")),
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"), (a["sum"] + a["p"] * mean / k).alias("sum"), F.when(a["sum"] < u, k.cast("bigint")).otherwise(a["n"]).alias("n")),
        lambda a: a["n"],
    )
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    return F.when(mean < SMALL_MEAN, terms).otherwise(F.greatest(F.lit(0), F.floor(mean + F.sqrt(mean) * z + 0.5)).cast("bigint"))


def shard_counts(quota: DataFrame, seed: int, n_shards: int) -> DataFrame:
    """``quota`` with a row per shard that gets slots of a source: ``shard``, ``first`` and ``count``, its range of the source's ``draws`` slots."""
    every = quota.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    every = every.withColumn("drawn", poisson(F.col("draws") / float(n_shards), seed, "number", "shard"))
    of = Window.partitionBy("number")  # a row per shard
    upto = of.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    sums = every.withColumns({"all": F.sum("drawn").over(of), "sofar": F.sum("drawn").over(upto)})
    # Nothing drawn for a small source: its slots go to one shard.
    alone = F.pmod(F.xxhash64(F.lit(seed), F.lit(-4), "number"), F.lit(n_shards))
    none = F.when(F.col("shard") >= alone, F.col("draws")).otherwise(0)
    end = F.when(F.col("all") > 0, F.floor(F.col("sofar") / F.col("all") * F.col("draws") + 0.5).cast("bigint")).otherwise(none)
    ends = sums.withColumn("end", F.least(end, F.col("draws")))
    first = F.coalesce(F.lag("end").over(of.orderBy("shard")), F.lit(0).cast("bigint"))
    counted = ends.withColumn("first", first).withColumn("count", F.col("end") - F.col("first"))
    return counted.filter("count > 0").drop("drawn", "all", "sofar", "end")


def slots(sources: DataFrame, seed: int = 0, n_shards: int = SHARDS) -> DataFrame:
    """(number, slot, block, take, shard): what every slot takes; ``take`` counts words from the block's start.

    The last block of a source may be short. If a slot before the end of the last pass takes it, what it lacks is made
    up by the slots after it.
    """
    short = F.col("blocks") * BLOCK - F.col("source_size")
    passes = F.when(F.col("source_size") > 0, F.expr("words DIV source_size")).otherwise(F.lit(0))
    quota = sources.withColumns({"passes": passes}).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    quota = permuted(quota, F.greatest(F.col("blocks") - 1, F.lit(0)), "short_at", seed, inverse=True)
    past_short = F.col("rest") > (F.col("short_at") + 1) * BLOCK - short
    rest = F.when(past_short, F.col("rest") + short).otherwise(F.col("rest"))
    quota = quota.withColumn("reach", rest)
    draws = F.col("passes") * F.col("blocks") + F.expr(f"(reach + {BLOCK - 1}) DIV {BLOCK}")
    quota = quota.withColumn("draws", draws).filter("draws > 0").select("number", "blocks", "source_size", "passes", "reach", "draws")
    counts = shard_counts(quota, seed, n_shards)
    chunks = counts.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(count - 1) DIV {CHUNK}"))))
    start = F.col("first") + F.col("chunk") * CHUNK
    last = F.col("first") + F.least((F.col("chunk") + 1) * CHUNK, F.col("count")) - 1
    # Few short rows become many: the number of tasks follows the slots, not the size of the rows.
    n_slots = (sources.agg(F.sum("words")).first()[0] or 0) // BLOCK
    n_tasks = min(MAX_TASKS, n_slots // (4 * CHUNK) + 1)
    rows = chunks.repartition(n_tasks, "number", "shard", "chunk").withColumn("slot", F.explode(F.sequence(start, last)))
    rows = permuted(rows, F.col("slot") % F.col("blocks"), "block", seed)
    in_block = F.least(F.lit(BLOCK).cast("bigint"), F.col("source_size") - F.col("block") * BLOCK)
    left = F.col("reach") - (F.col("slot") - F.col("passes") * F.col("blocks")) * BLOCK
    take = F.when(F.col("slot") < F.col("passes") * F.col("blocks"), in_block).otherwise(F.least(in_block, left))
    return rows.select("number", "slot", "block", take.alias("take"), (take < in_block).alias("partial"), "shard")


def members(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(number, block, row, first, begin, end): the words ``begin`` to ``end`` of a block are those from
    ``first`` on of a document."""
    numbers = sources.select(F.col("source").alias("s"), "number", F.floor((F.col("n") - 1) / BUCKET_DOCS + 1).alias("buckets"))
    placed = sized.filter("size > 0").join(numbers, F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("number", F.pmod("h", "buckets").alias("bucket"), "h", "row", "size")
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("number", "bucket").agg(F.sum("size").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    inside = Window.partitionBy("number", "bucket").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(inside) - F.col("size")
    docs = placed.join(firsts.drop("all"), ["number", "bucket"]).select("number", "row", "size", start.alias("start"))
    block = F.sequence(F.expr(f"start DIV {BLOCK}"), F.expr(f"(start + size - 1) DIV {BLOCK}"))
    cut = docs.withColumn("block", F.explode(block))
    begin = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK))
    return cut.select("number", "block", "row", (F.col("block") * BLOCK + begin - F.col("start")).alias("first"), begin.alias("begin"), end.alias("end"))


def taken(sized: DataFrame, sources: DataFrame, seed: int = 0) -> DataFrame:
    """(row, taken) of the documents of which words are taken."""
    drawn = slots(sources, seed).groupBy("number", "block").agg(
        F.sum((~F.col("partial")).cast("int")).alias("whole"), F.max(F.when(F.col("partial"), F.col("take"))).alias("part"),
    )
    length = F.col("end") - F.col("begin")
    part = F.greatest(F.least(F.col("end"), F.coalesce("part", F.lit(0))) - F.col("begin"), F.lit(0))
    # Spark takes exploded slots for as small as the sources they come from; they grow with the corpus: no broadcast.
    words = members(sized, sources).join(drawn.hint("merge"), ["number", "block"]).select("row", (F.col("whole") * length + part).alias("words"))
    return words.groupBy("row").agg(F.sum("words").alias("taken"))


def mix(docs: DataFrame, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, doc_id, h, size, source_size, target, taken) of every row.

    A null or wordless text has size 0 and gives nothing; a null source is a source of its own, after all others; rows
    that share an id are documents of their own; a table without words has targets of 0. Other columns
    are ignored. ``row`` numbers rows of one run; everything else depends on the rows and ``seed`` alone.
    """
    sized = sizes(docs, doc_id, text, source)
    sources = written(source_table(sized), "targets")
    of = sources.select(F.col("source").alias("s"), "source_size", "target")
    joined = sized.join(of, F.col("source").eqNullSafe(F.col("s"))).join(taken(sized, sources, seed), "row", "left")
    return joined.select("row", "doc_id", "h", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_blocks(docs: DataFrame, seed: int = 0, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(shard, number, slot, text): the mix itself, a row per slot, with the words of its block joined by spaces.
    ``number`` is the place of the source in order. Sort a shard by a hash to shuffle it."""
    sized = sizes(docs, doc_id, text, source)
    sources = written(source_table(sized), "targets")
    cut = written(members(sized, sources).join(sized.select("row", "doc_id", "h"), "row"), "members")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    texts = docs.select(F.col(doc_id).alias("d"), F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("text")).dropDuplicates(["d", "h"])
    pieces = cut.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (cut["h"] == texts["h"])).select(
        "number", "block", F.struct("begin", F.slice(words, (F.col("first") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")).alias("w")).alias("piece"),
    )
    blocks = pieces.groupBy("number", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["w"])).alias("w"))
    drawn = slots(sources, seed, n_shards).hint("merge").join(blocks, ["number", "block"])
    return drawn.select("shard", "number", "slot", F.array_join(F.slice("w", 1, F.col("take").cast("int")), " ").alias("text"))
