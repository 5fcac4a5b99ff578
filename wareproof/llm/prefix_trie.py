"""Operator 11: the prefix trie of conversations, as a z-fast trie (Belazzougui, Boldi, Pagh and Vigna, 2009).

A conversation is a sequence of turns and each of its prefixes has a hash, an exclusive or over its turns' hashes with
their places, 128 bits wide. Equal conversations are one class. The trie is compacted: a node stands for the
prefixes from below its parent's extent to its own, and is found by its handle, the prefix whose length is the two-fattest
number in that interval. A batch of classes locates its exit nodes by fat binary search, a join with
the handles per step, log2 of the longest conversation many. Where classes leave an edge it is split; what is new below is
grouped by prefix, and prefixes that branch or end become nodes. Batches grow, so that few are needed.

In the finished trie sums over subtrees are taken by doubling: in each round a node hands its sums to the ancestor twice as far away
as in the last, so that rounds count the logarithm of the height. What sharing saves below a node follows from sums that need no order: bytes of
whole conversations that end there, and bytes of its edges. Edges are expanded to a row per depth last.
No step holds a conversation, or all that share a prefix, in one place; only the digest of the ends of a node, which is a hash of
one text, reads its sorted ids one after the other in one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareproof.llm.common import written
from wareproof.llm.order import numbered

#: Shares of the classes in the batches that are inserted one after the other.
BATCHES = (1, 8)
#: Depths that a window over one conversation takes at a time; totals of such slices carry on.
SLICE = 4096
#: Steps of the search between two written tables.
STEPS = 3
EMPTY = hashlib.sha256(b"").hexdigest()


# ---- conversations as prefix hashes --------------------------------------------------------------

def running(rows: DataFrame, key: str, place: str, folds: dict, longest: int, before: bool = False) -> DataFrame:
    """``rows`` with the running ``folds`` (name: (function, column)) of each key by ``place``, up to the row or, with ``before``, to the
    one before. A key is cut into slices of places; the folds of the slices before are joined in, if there are places beyond the first slice."""
    last = -1 if before else 0
    if longest < SLICE:
        whole = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, last)
        return rows.select("*", *(fold(c).over(whole).alias(n) for n, (fold, c) in folds.items()))
    sliced = rows.withColumn("__slice", F.floor(F.col(place) / SLICE))
    totals = sliced.groupBy(key, "__slice").agg(*(fold(c).alias(f"__{n}") for n, (fold, c) in folds.items()))
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "__slice", *(fold(F.col(f"__{n}")).over(earlier).alias(f"__{n}") for n, (fold, _) in folds.items()))
    inside = Window.partitionBy(key, "__slice").orderBy(place).rowsBetween(Window.unboundedPreceding, last)
    own = sliced.select("*", *(fold(c).over(inside).alias(f"__o_{n}") for n, (fold, c) in folds.items()))
    joined = own.join(totals, [key, "__slice"])
    both = {n: MERGES[fold](F.col(f"__{n}"), F.col(f"__o_{n}")) for n, (fold, _) in folds.items()}
    return joined.select(*rows.columns, *(c.alias(n) for n, c in both.items()))


def _either(a: Column, b: Column, both: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


MERGES = {
    F.bit_xor: lambda a, b: _either(a, b, a.bitwiseXOR(b)),
    F.sum: lambda a, b: _either(a, b, a + b),
    F.max: lambda a, b: F.greatest(a, b),
}


def turns_of(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, role, digest, t): the turns in order, from place 0. Turns of one number go by role and the SHA-256 of their text;
    ``digest`` stands for the text, ``t`` is its length in bytes."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = table.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.sha2(own.cast("binary"), 256).alias("digest"), F.octet_length(own).cast("bigint").alias("t"))
    placed = written(numbered(rows, ["conv", "turn", "role", "digest"], "number"), "numbered")
    firsts = placed.groupBy("conv").agg(F.min("number").alias("first"))
    return written(placed.join(firsts, "conv").select("conv", (F.col("number") - F.col("first")).alias("pos"), "role", "digest", "t"), "turns")


def rebuilt(turns: DataFrame, step: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like others: (conv, m) with their lengths, and their turns (conv, d, role, digest, t) with d from 1.

    Conversation c takes the first h turns of conversation c - c % ``step``, then its own after its first h; h is the crc32 of
    its decimal id modulo ``heads``."""
    own_h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": own_h, "base": F.col("conv") - F.col("conv") % step})
    sizes = written(sizes, "sizes")
    of_base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = sizes.join(of_base, "base", "left").select("conv", "base", "h", head.alias("k"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m"))
    convs = written(convs, "convs")
    own = turns.join(convs, "conv").filter("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("d"), "role", "digest", "t")
    first = turns.filter(F.col("pos") < heads).withColumnRenamed("conv", "base").join(convs, "base").filter("pos < k")
    return convs.select("conv", "m"), own.unionByName(first.select("conv", (F.col("pos") + 1).alias("d"), "role", "digest", "t"))


CLASS = "m bigint, x bigint, y bigint, bytes bigint, cls bigint, copies bigint, sha string"


def classes_of(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Distinct conversations (``CLASS``) with length, hash, bytes, smallest id, number of copies and digest of their ids; their
    prefixes (cls, d, x, y, ox, oy, b, t): hash, hash of the prefix before, bytes so far and of the last turn; and the longest length."""
    hashed = turns.select("conv", "d", "t", *(F.xxhash64(F.lit(s), "d", "role", "digest").alias(n) for n, s in (("ex", 1), ("ey", 2))))
    hashed = written(hashed, "hashed")
    ends = hashed.groupBy("conv").agg(F.bit_xor("ex").alias("x"), F.bit_xor("ey").alias("y"), F.sum("t").alias("bytes"))
    zero = F.lit(0).cast("bigint")
    ends = convs.join(ends, "conv", "left").select("conv", "m", *(F.coalesce(c, zero).alias(c) for c in ("x", "y", "bytes")))
    key = ["m", "x", "y"]
    dealt = ends.repartition(*key).sortWithinPartitions(*key, "conv").select(*key, "bytes", "conv")
    classes = written(dealt.mapInArrow(_classes, CLASS), "classes")
    longest = classes.agg(F.max("m")).first()[0] or 0
    own = hashed.join(classes.select(F.col("cls").alias("conv")), "conv").withColumnRenamed("conv", "cls")
    folds = {"x": (F.bit_xor, F.col("ex")), "y": (F.bit_xor, F.col("ey")), "b": (F.sum, F.col("t"))}
    prefixes = running(own, "cls", "d", folds, longest)
    before = (F.col("x").bitwiseXOR(F.col("ex")).alias("ox"), F.col("y").bitwiseXOR(F.col("ey")).alias("oy"))
    return classes, written(prefixes.select("cls", "d", "x", "y", *before, "b", "t"), "prefixes"), longest


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per class; conversations come sorted by class and id. Ids are digested as they come: SHA-256 of the decimal ones, comma-joined."""
    key, head, copies, digest = None, None, 0, None
    names = ["m", "x", "y", "bytes", "cls", "copies", "sha"]
    kinds = [pa.int64()] * 6 + [pa.string()]
    for batch in batches:
        rows = []
        for m, x, y, size, conv in zip(*(batch.column(c).to_pylist() for c in ("m", "x", "y", "bytes", "conv")), strict=True):
            if (m, x, y) != key:
                if digest is not None:
                    rows.append((*head, copies, digest.hexdigest()))
                key, head, copies, digest = (m, x, y), (m, x, y, size, conv), 1, hashlib.sha256(b"%d" % conv)
            else:
                copies += 1
                digest.update(b",%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)
    if digest is not None:
        last = (*head, copies, digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(last, kinds, strict=True)], names)


# ---- the z-fast trie -----------------------------------------------------------------------------
# Nodes: e, x, y (length and hash of the extent), p, px, py (those of the parent), rep (a class that has the extent),
# f, fx, fy (the handle), cx, cy (hash of the first prefix below the parent), b, pb (bytes of the extent and of the parent's). The root
# has no row here: length 0, hash 0.

NODE = ["e", "x", "y", "p", "px", "py", "rep", "f", "fx", "fy", "cx", "cy", "b", "pb"]
CARRIED = ["e", "x", "y", "rep", "p", "px", "py", "b"]


def two_fattest(a: str, b: str) -> Column:
    """The number in (a, b] that the largest power of two divides."""
    bits = f"length(bin({a} ^ {b})) - 1"
    return F.expr(f"CASE WHEN {a} < {b} THEN shiftleft(shiftright({b}, {bits}), {bits}) END")


def _prefix(prefixes: DataFrame, cls: str, d: str, x: str, y: str) -> DataFrame:
    return prefixes.select(F.col("cls").alias(cls), F.col("d").alias(d), F.col("x").alias(x), F.col("y").alias(y))


def located(batch: DataFrame, prefixes: DataFrame, nodes: DataFrame, longest: int, every: DataFrame) -> DataFrame:
    """Where the classes of a batch (cls, m) leave the trie: (cls, m, l, lx, ly, lb) with the length, hash and bytes of the prefix
    they share with it, and the node (``CARRIED``) on whose edge that ends, or nulls if it ends at a node. ``prefixes`` are
    those of the batch, ``every`` those of all classes."""
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    start = {c: zero if c in ("e", "x", "y", "b") else none for c in CARRIED}
    state = batch.select("cls", "m", zero.alias("low"), F.col("m").alias("high"), *(v.alias(c) for c, v in start.items()))
    handles = nodes.select("f", F.col("fx").alias("hx"), F.col("fy").alias("hy"), *(F.col(c).alias(f"n_{c}") for c in CARRIED))
    of = _prefix(prefixes, "cls", "f", "hx", "hy")
    for step in range(longest.bit_length()):
        asked = state.withColumn("f", two_fattest("low", "high")).join(of, ["cls", "f"], "left")
        found = asked.join(handles, ["f", "hx", "hy"], "left")
        hit = F.col("n_e").isNotNull()
        state = found.select(
            "cls", "m", F.when(hit, F.col("n_e")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("f").isNull() | hit, F.col("high")).otherwise(F.col("f") - 1).alias("high"),
            *(F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in CARRIED))
        if step % STEPS == STEPS - 1:
            state = written(state, "search")
    # The last node found: does the class have all of its extent, and does it go on below it?
    at = state.join(_prefix(prefixes, "cls", "e", "hx", "hy"), ["cls", "e"], "left").withColumn(
        "whole", (F.col("e") == 0) | F.coalesce((F.col("hx") == F.col("x")) & (F.col("hy") == F.col("y")), F.lit(False))).drop("hx", "hy")
    at = at.withColumn("d1", F.when(F.col("whole"), F.col("e") + 1)).join(_prefix(prefixes, "cls", "d1", "cx", "cy"), ["cls", "d1"], "left")
    children = nodes.select(F.col("p").alias("e"), "cx", "cy", *(F.col(c).alias(f"n_{c}") for c in CARRIED))
    at = written(at.join(children, ["e", "cx", "cy"], "left"), "exits")
    through = F.col("whole") & F.col("n_e").isNull()
    exits = at.select("cls", "m", through.alias("through"), F.col("e").alias("l"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("b").alias("lb"),
                      *(F.when(through, none).when(F.col("whole"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in CARRIED))
    # On an edge: the longest prefix that the class shares with the node's extent.
    edges = exits.filter("NOT through").select("cls", "rep", F.explode(F.sequence(F.col("p") + 1, F.least("m", "e"))).alias("d"))
    own = prefixes.select("cls", "d", F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("b").alias("hb"))
    shared = edges.join(own, ["cls", "d"]).join(_prefix(every, "rep", "d", "hx", "hy"), ["rep", "d", "hx", "hy"])
    shared = shared.groupBy("cls").agg(F.max(F.struct("d", "hx", "hy", "hb")).alias("s"))
    ends = {"l": "d", "lx": "hx", "ly": "hy", "lb": "hb"}
    return exits.join(shared, "cls", "left").select(
        "cls", "m", *(F.when(F.col("s").isNull(), F.col(c)).otherwise(F.col(f"s.{s}")).alias(c) for c, s in ends.items()), *CARRIED)


def inserted(batch: DataFrame, prefixes: DataFrame, nodes: DataFrame | None, longest: int, every: DataFrame) -> DataFrame:
    """The nodes after a batch of classes (cls, m); ``nodes`` is None while there is none but the root."""
    key = ["e", "x", "y"]
    if nodes is None:
        zero = F.lit(0).cast("bigint")
        exits = batch.select("cls", "m", *(zero.alias(c) for c in ("l", "lx", "ly", "lb")))
    else:
        exits = written(located(batch, prefixes, nodes, longest, every), "located")
    # What is new: prefixes longer than the shared ones. They are nodes where they end or branch.
    fresh = written(prefixes.join(exits.select("cls", "m", "l", "lx", "ly"), "cls").filter("d > l"), "fresh")
    groups = fresh.groupBy("d", "x", "y", "ox", "oy").agg(F.min("cls").alias("rep"), F.max(F.col("d") == F.col("m")).alias("ends"), F.min("b").alias("b"))
    groups = written(groups, "groups")
    children = groups.groupBy((F.col("d") - 1).alias("d"), F.col("ox").alias("x"), F.col("oy").alias("y")).agg(F.count("*").alias("children"))
    made = written(groups.join(children, ["d", "x", "y"], "left").filter("ends OR children > 1").select("d", "x", "y", "rep", "b"), "made")
    # The parent of a new node is the last node before it on the way of its class.
    marks = made.select("d", "x", "y", F.lit(True).alias("is_node"))
    way = fresh.join(made.select(F.col("rep").alias("cls")), "cls", "left_semi").join(marks, ["d", "x", "y"], "left")
    last = F.when(F.col("is_node"), F.struct(F.col("d").alias("p"), F.col("x").alias("px"), F.col("y").alias("py")))
    way = running(way, "cls", "d", {"above": (F.max, last)}, longest, before=True)
    start = F.struct(F.col("l").alias("p"), F.col("lx").alias("px"), F.col("ly").alias("py"))
    way = way.filter("is_node").select("d", "x", "y", F.col("cls").alias("rep"), F.coalesce("above", start).alias("above"))
    below = made.join(way, ["d", "x", "y", "rep"]).select(F.col("d").alias("e"), "x", "y", "above.*", "rep", "b")
    if nodes is not None:
        # Edges that classes leave: split where they do.
        on_edge = exits.filter("e IS NOT NULL")
        points = on_edge.select(*CARRIED, "l", "lx", "ly", "lb")
        itself = on_edge.select(*CARRIED, F.col("e").alias("l"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("b").alias("lb"))
        along = Window.partitionBy(*key).orderBy("l")
        above = F.lag(F.struct(F.col("l").alias("p"), F.col("lx").alias("px"), F.col("ly").alias("py"))).over(along)
        split = points.union(itself).distinct().withColumn("above", F.coalesce(above, F.struct("p", "px", "py")))
        below = below.unionByName(split.select(F.col("l").alias("e"), F.col("lx").alias("x"), F.col("ly").alias("y"), "above.*", "rep", F.col("lb").alias("b")))
        nodes = nodes.join(on_edge.select(*key), key, "left_anti")
    changed = written(below, "changed").withColumns({"f": two_fattest("p", "e"), "d1": F.col("p") + 1})
    first = every.select(F.col("cls").alias("rep"), F.col("d").alias("d1"), F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("b") - F.col("t")).alias("pb"))
    changed = changed.join(_prefix(every, "rep", "f", "fx", "fy"), ["rep", "f"]).join(first, ["rep", "d1"]).select(*NODE)
    return written(changed if nodes is None else nodes.unionByName(changed), "nodes")


def build(classes: DataFrame, prefixes: DataFrame, longest: int, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """The nodes of the trie of all classes, without the root."""
    nodes = None
    draw = F.pmod(F.xxhash64(F.lit("batch"), "cls"), F.lit(sum(batches)))
    low = 0
    for share in batches:
        mine = (draw >= low) & (draw < low + share)
        low += share
        nodes = inserted(classes.filter(mine).select("cls", "m"), prefixes.filter(mine), nodes, longest, prefixes)
    return nodes


# ---- what the nodes hold -------------------------------------------------------------------------

def subtree_sums(nodes: DataFrame, folds: dict) -> DataFrame:
    """``folds`` (column: function) over every node's subtree, itself included. ``nodes`` have ``v``, ``up`` (their parent's, null at the root) and
    the columns."""
    nodes = nodes.select("v", "up", *folds)
    while not nodes.filter("up IS NOT NULL").isEmpty():
        handed = nodes.filter("up IS NOT NULL").groupBy(F.col("up").alias("v")).agg(*(f(c).alias(f"__{c}") for c, f in folds.items()))
        further = nodes.filter("up IS NOT NULL").select(F.col("v").alias("up"), F.col("up").alias("next"))
        joined = nodes.join(handed, "v", "left").join(further, "up", "left")
        nodes = written(joined.select("v", F.col("next").alias("up"), *(MERGED[f](F.col(c), F.col(f"__{c}")).alias(c) for c, f in folds.items())), "sums")
    return nodes.drop("up")


MERGED = {F.sum: lambda a, b: a + F.coalesce(b, F.lit(0)), F.min: lambda a, b: F.least(a, b)}


def node_rows(classes: DataFrame, prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    v, up = F.struct("e", "x", "y").alias("v"), F.struct(F.col("p").alias("e"), F.col("px").alias("x"), F.col("py").alias("y")).alias("up")
    root = classes.limit(1).select(  # without a class there is no root
        F.struct(zero.alias("e"), zero.alias("x"), zero.alias("y")).alias("v"), F.lit(None).cast("struct<e:bigint,x:bigint,y:bigint>").alias("up"),
        none.alias("rep"), zero.alias("b"), zero.alias("pb"))
    tree = nodes.select(v, up, "rep", "b", "pb").unionByName(root)
    children = nodes.groupBy(up.alias("v")).agg(F.count("*").alias("n_children"))
    ends = classes.select(F.struct(F.col("m").alias("e"), "x", "y").alias("v"), "cls", "copies", "sha", "bytes")
    facts = tree.join(children, "v", "left").join(ends, "v", "left").select(
        "v", "up", "rep", "pb", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("sha", F.lit(EMPTY)).alias("sha"),
        F.coalesce("copies", zero).alias("n_convs"), F.col("cls").alias("conv_id"), F.col("n_children").isNull().cast("bigint").alias("n_leaves"),
        F.coalesce(F.col("copies") * F.col("bytes"), zero).alias("whole"), (F.col("b") - F.col("pb")).alias("edges"))
    facts = written(facts, "facts")
    sums = subtree_sums(facts, {"n_convs": F.sum, "conv_id": F.min, "n_leaves": F.sum, "whole": F.sum, "edges": F.sum})
    parents = sums.select(F.col("v").alias("up"), F.col("conv_id").alias("up_conv"))
    full = facts.select("v", "up", "rep", "pb", "n_children", "sha").join(sums, "v").join(parents, "up", "left")
    # Edges, a row per depth.
    top = F.coalesce("up.e", F.lit(-1).cast("bigint")) + 1
    rows = full.withColumn("d", F.explode(F.sequence(top, F.col("v.e"))))
    own = prefixes.select(F.col("cls").alias("rep"), "d", (F.col("b") - F.col("t")).alias("before"))
    rows = rows.join(own, ["rep", "d"], "left").withColumn("before", F.coalesce("before", zero))
    at_end, at_top = F.col("d") == F.col("v.e"), F.col("d") == top
    # All bytes of the conversations from here on, less those that are stored once.
    saved = F.col("whole") - F.col("n_convs") * F.col("before") - F.col("edges") + F.col("before") - F.col("pb")
    return rows.select(
        "conv_id", F.col("d").alias("depth"), F.when(at_top, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("n_children")).otherwise(F.lit(1).cast("bigint")).alias("n_children"), "n_leaves",
        saved.alias("saved_tokens"), F.when(at_end, F.col("sha")).otherwise(F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """The nodes, of every depth, of the prefix trie of the rebuilt conversations (``node_rows``).

    A null turn comes first; turns of one number go by role and the SHA-256 of their text, and equal ones stay as often as they are there. A null role or
    text counts as empty. Rows without a conversation's id take no part. Texts and conversations may be of any length: texts are only hashed, turns are rows.
    Equal conversations are members of the same nodes. Other columns are ignored; an empty table gives no rows, not even a root.
    """
    convs, turns = rebuilt(turns_of(table, conv_id, turn, role, text))
    classes, prefixes, longest = classes_of(convs, turns)
    return node_rows(classes, prefixes, build(classes, prefixes, longest, batches))


# The same from all prefixes of all conversations, told apart by the digests of their turns in order.
SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
         FROM (SELECT unnest(range(256))::BIGINT AS n)),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits),
sizes AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
             lambda c, s: xor(c >> 8, t[xor(c, s) % 256 + 1])), 4294967295::BIGINT) % 9 AS h
  FROM turns, crc GROUP BY conv_id, t),
convs AS (
  SELECT s.conv_id, s.base, s.h, least(s.h, coalesce(b.n, 0)) AS k, least(s.h, coalesce(b.n, 0)) + greatest(s.n - s.h, 0) AS m
  FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (
  SELECT c.conv_id, c.m, pos - h + k + 1 AS d, role, text FROM turns JOIN convs c USING (conv_id) WHERE pos >= h
  UNION ALL SELECT c.conv_id, c.m, pos + 1, role, text FROM turns t JOIN convs c ON t.conv_id = c.base WHERE pos < k),
prefixes AS (
  SELECT conv_id, m, d, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS x, strlen(text) AS t FROM rebuilt
  UNION ALL SELECT conv_id, m, 0, '', 0 FROM convs),
nodes AS (
  SELECT x, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(t) AS t,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (m = d), '')) AS ends_sha256
  FROM prefixes GROUP BY x, d),
links AS (SELECT c.x, c.d, p.x AS px FROM nodes c JOIN prefixes p ON p.conv_id = c.conv_id AND p.d = c.d - 1),
children AS (SELECT px AS x, count(*) AS n FROM links GROUP BY 1),
sums AS (
  SELECT p.x, sum((n.n_convs - 1) * n.t) AS saved, count(*) FILTER (k.n IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children k ON k.x = n.x JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves,
       s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.x = n.x LEFT JOIN children k ON k.x = n.x LEFT JOIN links l ON l.x = n.x LEFT JOIN nodes p ON p.x = l.px
"""
