"""Operator 7: near-duplicate documents by a chosen-path set similarity join.

A document is the set of its five-word shingles. Equal sets are one class, found by a digest of the set, and only classes
go on. Every class has a sketch of minwise tokens. A tree of the join (Christiani and Pagh, 2017; Christiani,
Pagh and Sivertsen, 2018) sends a class from a node to children by one or two tokens that the node chooses, 1 / 0.75
on average, so that similar classes meet in a child and others part. ``TREES`` independent trees bring the recall of a
pair at the threshold near one: 1 - 0.25^10 where one token parts strangers, above 0.9997 where two do.

A node of at most ``LIMIT`` classes is a leaf and compares all its sketches. In a larger one all are compared with one
pivot, the class whose sketch agrees best with the node's most common tokens: the original of a group of near copies,
which they resemble more than each other. Of those surely above the threshold seven in eight leave with their link to it, the
rest branch on. That takes time in proportion to a group, not to its square.

Links are confirmed on the full sets in two rounds, so that a group never lists all its pairs. First come, for
every class, its best candidate in any leaf and its best among the pivots and the most central classes of its leaves. Then
leaves are compared once more, and pairs with pivots looked through, for candidates between classes that are not connected
yet; the others cannot change a component. Classes of leaves that have some go to a task of their leaf with their full
sets, which confirms all of these candidates and returns a forest of the links. Sets too large to meet are compared in ranges of shingles.

A class that left a large node took its other links of that tree with it. So the large nodes at the roots grow again, nobody
leaving, as long as they hold more than one component: only candidates between components are missing then. A node whose classes are
all of one component but for ``LIMIT`` / 2 needs no children: every slice of that component meets all the others in a leaf.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.llm.common import parts, written
from wareproof.llm.components import components

SHINGLE = 5
PERCENT = 75
TOKENS = 64
TREES = 10
LIMIT = 1000
#: One in so many of those that could leave a large node stays, for others to meet.
STAY = 8
#: Pairs whose sketches agree in fewer tokens are no candidates: a pair at the threshold does so once in 300,000.
CANDIDATE = TOKENS // 2
#: Sketches that agree in more tokens leave a large node: a pair below the threshold does so once in 60.
SURE = TOKENS * 84 // 100
BATCH_BYTES = 4_000_000
#: Tokens of a place that a summary counts, and parts in the first round that merges summaries.
COUNTERS = 8
MERGED_PARTS = 64
#: Full sets of a leaf are compared together up to so many bytes; those of a larger one are cut into ranges of shingles.
TILE_BYTES = 32_000_000
CACHE = 32_768
STRIP = 4096

_random = random.Random(20170619)
_FACTORS = np.array([_random.getrandbits(64) | 1 for _ in range(SHINGLE)], dtype=np.uint64)
_FLIPS = np.array([_random.getrandbits(64) for _ in range(TOKENS)], dtype=np.uint64)
_ODDS = np.array([_random.getrandbits(64) | 1 for _ in range(TOKENS)], dtype=np.uint64)

SIGNED = "doc_id bigint, h bigint, n_shingles bigint, cls bigint, sketch array<int>, bits binary"
SETS = "cls bigint, shingles binary"


# ---- sets and sketches ---------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of every text."""
    import xxhash

    split = [(t or b"").lower().split() for t in texts]
    at, distinct = pd.factorize(np.array([w for one in split for w in one] or [b""], dtype=object))
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))[at]
    with np.errstate(over="ignore"):
        n = len(own) - SHINGLE + 1
        runs = sum(own[k:k + n] * _FACTORS[k] for k in range(SHINGLE)) if n > 0 else own[:0]
        runs, out, start = _mix(runs), [], 0
        for words in split:
            m = len(words)
            if m >= SHINGLE:
                out.append(np.unique(runs[start:start + m - SHINGLE + 1]))
            elif m:
                whole = (own[start:start + m] * _FACTORS[:m]).sum() + np.uint64(m)
                out.append(_mix(np.array([whole], dtype=np.uint64)))
            else:
                out.append(own[:0])
            start += m
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of sets that are not empty, a row per set."""
    out = np.empty((len(sets), TOKENS), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    start = 0
    while start < len(sets):
        stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), CACHE, side="right")) + start)
        flat = np.concatenate(sets[start:stop])
        begins = np.cumsum(sizes[start:stop]) - sizes[start:stop]
        with np.errstate(over="ignore"):
            for j in range(TOKENS):
                out[start:stop, j] = np.minimum.reduceat((flat ^ _FLIPS[j]) * _ODDS[j], begins)
        start = stop
    return (_mix(out) >> np.uint64(32)).astype(np.uint32)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """A number for each set, equal for equal sets."""
    with np.errstate(over="ignore"):
        sums = [np.add.reduce(_mix(s + np.uint64(1))) + np.uint64(len(s)) for s in sets]
    return _mix(np.array(sums, dtype=np.uint64)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text", BATCH_BYTES):
        sets = shingle_sets(batch.column("text").to_pylist())
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        filled = np.flatnonzero(sizes)
        tokens = np.zeros((len(sets), TOKENS), dtype=np.uint32)
        tokens[filled] = sketches([sets[i] for i in filled])
        offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TOKENS)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("h"), pa.array(sizes), pa.array(_digests(sets)),
            pa.ListArray.from_arrays(offsets, pa.array(tokens.reshape(-1).view(np.int32))),
            pa.array([row.tobytes() for row in tokens.astype(np.uint8)], pa.binary()),
        ], ["doc_id", "h", "n_shingles", "cls", "sketch", "bits"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text", BATCH_BYTES):
        sets = shingle_sets(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(_digests(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "shingles"]
        )


# ---- the trees -----------------------------------------------------------------------------------

PAIRS = "a bigint, b bigint"
FIRST = "cls bigint, other bigint, agree int, central boolean"


def _size_fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _agreement(bits: np.ndarray) -> np.ndarray:
    """In how many tokens the rows of ``bits`` agree, all with all."""
    agree = np.zeros((len(bits), len(bits)), dtype=np.uint8)
    for column in np.ascontiguousarray(bits.T):
        agree += column[:, None] == column[None, :]
    return agree


def _central_row(bits: np.ndarray) -> int:
    """The row that agrees best with the most common tokens."""
    most = [np.bincount(column).argmax() for column in bits.T]
    return int((bits == np.array(most, dtype=np.uint8)).sum(axis=1).argmax())


def _members(batch: pa.RecordBatch, blob: str) -> Iterator[tuple]:
    """The leaves of a batch: node, classes, sizes, labels and ``blob`` of their members."""
    offsets = batch.column("members").offsets.to_numpy()
    members = batch.column("members").values
    cls, n, label = (members.field(c).to_numpy() for c in ("cls", "n_shingles", "label"))
    blobs = members.field(blob)
    for node, start, stop in zip(batch.column("node").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield node, cls[start:stop], n[start:stop], label[start:stop], blobs.slice(start, stop - start)


def _candidates(n: np.ndarray, blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, agreement and which pairs are candidates."""
    bits = np.frombuffer(b"".join(blobs.to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)
    agree = _agreement(bits)
    near = (agree >= CANDIDATE) & _size_fits(n[:, None], n[None, :])
    np.fill_diagonal(near, False)
    return bits, agree, near


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In every leaf the best candidate of every class, and the most central class for those it is a candidate of."""
    for batch in batches:
        found = [np.zeros((0, 4), dtype=np.int64)]
        for _, cls, n, _, blobs in _members(batch, "bits"):
            bits, agree, near = _candidates(n, blobs)
            some = np.flatnonzero(near.any(axis=1))
            if len(some):
                best = np.where(near[some], agree[some], 0).argmax(axis=1)
                center = some[_central_row(bits[some])]
                around = np.flatnonzero(near[center])
                found.append(np.stack([cls[some], cls[best], agree[some, best], np.zeros(len(some), dtype=np.int64)], axis=1))
                found.append(np.stack([cls[around], np.full(len(around), cls[center]), agree[around, center], np.ones(len(around), dtype=np.int64)], axis=1))
        rows = np.concatenate(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3] == 1)], ["cls", "other", "agree", "central"]
        )


def _open_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of leaves with a candidate that is not connected with them; ``size``: the shingles of all of a leaf."""
    for batch in batches:
        found = [np.zeros((5, 0), dtype=np.int64)]
        for node, cls, n, label, blobs in _members(batch, "bits"):
            apart = _candidates(n, blobs)[2] & (label[:, None] != label[None, :])
            some = np.flatnonzero(apart.any(axis=1))
            found.append(np.stack([np.full(len(some), node), cls[some], n[some], label[some], np.full(len(some), n[some].sum())]))
        yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(found, axis=1))), ["node", "cls", "n_shingles", "label", "size"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections. Shingles of two members or more are the columns of a matrix, a strip at a time."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[at] > 1
    of, at = of[shared], np.unique(at[shared], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(at.max(initial=-1)) + 1, STRIP):
        lo, hi = np.searchsorted(at, [first, first + STRIP])
        strip = np.zeros((len(sets), STRIP), dtype=np.float32)
        strip[of[lo:hi], at[lo:hi] - first] = 1
        out += strip @ strip.T
    return out.astype(np.int64)


def _forest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> list[int]:
    """Places of links that connect the labels which all links (i, j) connect."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    keep = []
    for k, (a, b) in enumerate(zip(label[i].tolist(), label[j].tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            keep.append(k)
    return keep


def _confirmed_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the links of every leaf between labels, confirmed on the full sets."""
    for batch in batches:
        found = [np.zeros((0, 2), dtype=np.int64)]
        for _, cls, n, label, blobs in _members(batch, "shingles"):
            common = _common([np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in blobs])
            linked = 100 * common >= PERCENT * (n[:, None] + n[None, :] - common)
            i, j = np.nonzero(np.triu(linked & (label[:, None] != label[None, :])))
            keep = _forest(i, j, label)
            found.append(np.stack([label[i[keep]], label[j[keep]]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of every member cut into ``tiles`` ranges of shingles, a row each."""
    for batch in parts(batches, "shingles", BATCH_BYTES):
        for row in batch.to_pylist():
            shingles = np.frombuffer(row["shingles"], dtype=np.uint64)
            edges = [(k << 64) // row["tiles"] for k in range(1, row["tiles"])]
            cuts = np.split(shingles, np.searchsorted(shingles, np.array(edges, dtype=np.uint64)))
            same = {c: [row[c]] * len(cuts) for c in ("node", "cls", "n_shingles", "label")}
            yield pa.RecordBatch.from_pydict({
                **{c: pa.array(v, pa.int64()) for c, v in same.items()}, "tile": pa.array(range(len(cuts)), pa.int64()),
                "shingles": pa.array([c.tobytes() for c in cuts], pa.binary())})


def _tile_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a tile its members share, as a matrix in the order of classes."""
    for batch in batches:
        for node, cls, n, label, blobs in _members(batch, "shingles"):
            order = np.argsort(cls)
            common = _common([np.frombuffer(blobs[i].as_buffer(), dtype=np.uint64) for i in order.tolist()])
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([node], pa.int64()), **{c: pa.array([v[order]], pa.list_(pa.int64())) for c, v in (("n", n), ("label", label))},
                "common": pa.array([common.astype("<i4").tobytes()], pa.binary())})


def _summed_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the links of every node between labels, from the sum of its tiles, which come one after the other."""
    last, total, facts = None, None, None

    def links() -> pa.RecordBatch:
        n, label = (np.array(f, dtype=np.int64) for f in facts)
        i, j = np.nonzero(np.triu((100 * total >= PERCENT * (n[:, None] + n[None, :] - total)) & (label[:, None] != label[None, :])))
        keep = _forest(i, j, label)
        pairs = np.sort(np.stack([label[i[keep]], label[j[keep]]], axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        for k in range(batch.num_rows):
            node, common = batch.column("node")[k].as_py(), np.frombuffer(batch.column("common")[k].as_buffer(), dtype="<i4").astype(np.int64)
            if node != last:
                if total is not None:
                    yield links()
                last, facts = node, [batch.column(c)[k].as_py() for c in ("n", "label")]
                total = np.zeros((len(facts[0]),) * 2, dtype=np.int64)
            total += common.reshape(total.shape)
    if total is not None:
        yield links()


def _with_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, TOKENS) for c in ("bits", "p_bits"))
        fits = _size_fits(batch.column("n_shingles").to_numpy(), batch.column("p_n").to_numpy())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("node", "cls", "pivot", "sketch")] + [pa.array(((own == pivot).sum(axis=1) * fits).astype(np.int32))],
            ["node", "cls", "pivot", "sketch", "agree"],
        )


def _roots(seed: int) -> Column:
    """The nodes that a class reaches from the roots of all trees."""
    nodes = []
    for tree in range(TREES):
        draw = random.Random(seed * 1000 + tree)
        for j in draw.sample(range(TOKENS), 1 + (draw.random() < 100 / PERCENT - 1)):
            nodes.append(F.xxhash64(F.lit(tree), F.lit(j), F.col("sketch")[j]))
    return F.array(*nodes)


def _children() -> Column:
    """The nodes that a class reaches from ``node``: one, or two in a third of the nodes."""
    def child(which: int) -> Column:
        j = F.pmod(F.xxhash64(F.lit(which), "node"), F.lit(TOKENS)).cast("int")
        return F.xxhash64("node", j, F.get("sketch", j))

    has_two = F.pmod(F.xxhash64(F.lit(-1), "node"), F.lit(PERCENT)) < 100 - PERCENT
    return F.when(has_two, F.array_distinct(F.array(child(0), child(1)))).otherwise(F.array(child(0)))


def _reduced(of: np.ndarray, place: np.ndarray, token: np.ndarray, n: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group and place the ``COUNTERS`` most common tokens and their counts, less the count of the next: the summary of Misra and
    Gries. Summaries merge by adding and reducing again; counts are too low by a ninth of the rows at most, so a token of more than that share stays."""
    keys, at = np.unique((of * TOKENS + place) * 256 + token, return_inverse=True)
    sums = np.bincount(at, weights=n).astype(np.int64)
    cell = keys // 256
    order = np.lexsort((-sums, cell))
    cell, sums, keys = cell[order], sums[order], keys[order]
    rank = np.arange(len(cell)) - np.searchsorted(cell, cell)
    tokens = np.zeros((groups * TOKENS, COUNTERS), dtype=np.uint8)
    counts = np.zeros((groups * TOKENS, COUNTERS), dtype=np.int64)
    over = np.zeros(groups * TOKENS, dtype=np.int64)
    over[cell[rank == COUNTERS]] = sums[rank == COUNTERS]
    kept = rank < COUNTERS
    tokens[cell[kept], rank[kept]] = keys[kept] % 256
    counts[cell[kept], rank[kept]] = sums[kept] - over[cell[kept]]
    return tokens.reshape(groups, TOKENS, COUNTERS), counts.reshape(groups, TOKENS, COUNTERS)


def _summarized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A summary of the common tokens for every node of a batch: one row each."""
    part = TaskContext.get().partitionId()
    for batch in batches:
        nodes, of = np.unique(batch.column("node").to_numpy(), return_inverse=True)
        bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)
        place = np.tile(np.arange(TOKENS), len(bits))
        tokens, counts = _reduced(np.repeat(of, TOKENS), place, bits.reshape(-1).astype(np.int64), np.ones(bits.size), len(nodes))
        yield pa.RecordBatch.from_arrays([
            pa.array(nodes), pa.array(np.full(len(nodes), part, dtype=np.int32)), pa.array([t.tobytes() for t in tokens], pa.binary()),
            pa.array([c.tobytes() for c in counts], pa.binary())], ["node", "part", "tokens", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary of those of a row."""
    for batch in batches:
        tokens, counts = [], []
        for found in batch.column("all").to_pylist():
            own = np.frombuffer(b"".join(f["tokens"] for f in found), dtype=np.uint8).reshape(-1, TOKENS, COUNTERS)
            n = np.frombuffer(b"".join(f["counts"] for f in found), dtype=np.int64).reshape(own.shape)
            at = np.nonzero(n)
            t, c = _reduced(np.zeros(len(at[0]), dtype=np.int64), at[1], own[at].astype(np.int64), n[at], 1)
            tokens.append(t.tobytes())
            counts.append(c.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("part"), pa.array(tokens, pa.binary()), pa.array(counts, pa.binary())], ["node", "part", "tokens", "counts"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many places a class has its node's most common token."""
    for batch in batches:
        bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)
        common = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), dtype=np.uint8).reshape(-1, TOKENS, COUNTERS)[:, :, 0]
        same = pa.array((bits == common).sum(axis=1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "cls", "n_shingles", "bits")), same], ["node", "cls", "n_shingles", "bits", "agree"])


SUMMARY = "node bigint, part int, tokens binary, counts binary"


def _central(big: DataFrame) -> DataFrame:
    """(node, pivot, p_n, p_bits): of each node the class with the most common tokens; on ties a hash decides.

    Tokens are summarized per batch. Where these are many, summaries are merged in two rounds, so that no task reads those of all batches of a
    large node at their full number."""
    slim = big.select("node", "cls", "n_shingles", "bits")
    common = written(slim.select("node", "bits").mapInArrow(_summarized, SUMMARY), "summaries")
    many = common.count() > MERGED_PARTS * MERGED_PARTS
    for part in ([F.col("part") % MERGED_PARTS] if many else []) + [F.lit(0)]:
        lists = common.groupBy("node", part.cast("int").alias("part")).agg(F.collect_list(F.struct("tokens", "counts")).alias("all"))
        common = lists.mapInArrow(_merged, SUMMARY)
    schema = "node bigint, cls bigint, n_shingles bigint, bits binary, agree bigint"
    scored = slim.join(written(common.select("node", "tokens"), "common"), "node").mapInArrow(_scored, schema)
    best = scored.groupBy("node").agg(F.max(F.struct("agree", F.xxhash64("node", "cls"), "cls", "n_shingles", "bits")).alias("p"))
    return best.select("node", F.col("p.cls").alias("pivot"), F.col("p.n_shingles").alias("p_n"), F.col("p.bits").alias("p_bits"))


def grow(classes: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The leaves of all trees (node, cls), the candidates among the pivots of larger nodes (``FIRST``), and the members
    (node, cls, sketch) of larger nodes at the roots, if any."""
    leaves, stars, roots = [], [], None
    level = classes.select("cls", F.explode(_roots(seed)).alias("node"))
    while True:
        level = written(level, "level")
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        members = written(level.join(written(sizes, "sizes"), "node"), "members")
        leaves.append(members.filter(F.col("size") <= LIMIT).select("node", "cls"))
        big = members.filter(F.col("size") > LIMIT)
        if big.isEmpty():
            break
        big = written(big.join(classes, "cls"), "big")
        roots = big.select("node", "cls", "sketch") if roots is None else roots
        pivots = written(_central(big), "pivots")
        schema = "node bigint, cls bigint, pivot bigint, sketch array<int>, agree int"
        compared = written(big.join(pivots, "node").filter("cls != pivot").mapInArrow(_with_pivot, schema), "compared")
        stars.append(compared.filter(F.col("agree") >= CANDIDATE).select("cls", F.col("pivot").alias("other"), "agree", F.lit(True).alias("central")))
        stays = (F.col("agree") < SURE) | (F.pmod(F.xxhash64("cls", "node"), F.lit(STAY)) == 0)
        level = compared.filter(stays).select("cls", F.explode(_children()).alias("node"))
    none = classes.sparkSession.createDataFrame([], FIRST)
    return reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, stars, none), roots


def regrow(roots: DataFrame, labels: DataFrame) -> DataFrame:
    """Leaves (node, cls) below ``roots`` in which classes of different labels (cls, label) meet; nobody leaves a node."""
    leaves = []
    level = roots.join(labels.select("cls", "label"), "cls")
    while True:
        placed = written(level.withColumn("h", F.xxhash64("sketch")), "level")
        counts = placed.groupBy("node", "label").agg(F.count("*").alias("n"), F.min("h").alias("x"), F.max("h").alias("y"))
        sizes = counts.groupBy("node").agg(
            F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most"), (F.min("x") < F.max("y")).alias("parts"))
        mixed = sizes.filter("size > most.n").select("node", "size", "parts", F.col("most.label").alias("of"), (F.col("size") - F.col("most.n")).alias("rest"))
        members = written(placed.join(written(mixed, "mixed"), "node"), "members")
        small, few = F.col("size") <= LIMIT, F.col("rest") <= LIMIT // 2
        leaves.append(members.filter(small).select("node", "cls"))
        # The component with most classes is dealt into slices; the others go to all of them.
        n = F.ceil((F.col("size") - F.col("rest")) / (F.lit(LIMIT) - F.col("rest")))
        own = F.pmod(F.xxhash64("cls", "node"), n)
        slices = F.when(F.col("label") == F.col("of"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("bigint"), n - 1))
        leaves.append(members.filter(~small & few).select(F.explode(slices).alias("k"), "node", "cls").select(F.xxhash64("node", "k").alias("node"), "cls"))
        # Classes of one sketch never part: every two slices of them meet.
        n = F.ceil(2 * F.col("size") / LIMIT)
        own = F.pmod(F.xxhash64("cls", "node"), n)
        pairs = members.filter(~small & ~few & ~F.col("parts")).select("node", "cls", own.alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("k"))
        leaves.append(pairs.select(F.xxhash64("node", F.least("i", "k"), F.greatest("i", "k")).alias("node"), "cls"))
        large = members.filter(~small & ~few & F.col("parts"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        level = large.select("cls", "label", "sketch", F.explode(_children()).alias("node"))


def _grouped(leaves: DataFrame, facts: DataFrame, blob: str) -> DataFrame:
    """(node, members) of the leaves that hold more than one label; leaves and facts have cls, n_shingles, label and ``blob`` together."""
    grouped = leaves.join(facts, "cls").groupBy("node").agg(
        F.collect_list(F.struct("cls", "n_shingles", "label", blob)).alias("members"), F.min("label").alias("x"), F.max("label").alias("y"))
    return grouped.filter("x != y").select("node", "members")


# ---- confirmed links -----------------------------------------------------------------------------

def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
            both = len(x) + len(y)
            common = both - len(np.unique(np.concatenate([x, y])))
            keep.append(100 * common >= PERCENT * (both - common))
        keep = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays([batch.column("x").take(pa.array(keep)), batch.column("y").take(pa.array(keep))], ["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The labels (x, y) of those pairs (a, b, x, y) whose full sets reach the threshold, as (a, b)."""
    with_a = pairs.select("a", "b", "x", "y").join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.mapInArrow(_confirmed, "a bigint, b bigint")


def _sets_of(needed: DataFrame, rows: DataFrame) -> DataFrame:
    """(cls, shingles) of the classes ``needed``, made of the text of their first row."""
    # The documents needed grow with the corpus, so their texts are fetched by a shuffled join whatever their number.
    texts = rows.join(needed.select(F.col("rep").alias("doc_id"), F.col("rep_h").alias("h")).hint("merge"), ["doc_id", "h"])
    # Rows of one id and text meet in this join.
    return written(texts.dropDuplicates(["doc_id", "h"]).select("text").mapInArrow(_with_sets, SETS), "sets")


def _labelled(of: DataFrame, label: DataFrame) -> DataFrame:
    """The classes ``of`` with ``label``: their component (v, label), or themselves."""
    found = of.join(label.withColumnRenamed("v", "cls"), "cls", "left")
    return written(found.withColumn("label", F.coalesce("label", "cls")), "labels")


def _joined(labels: DataFrame, linked: DataFrame) -> DataFrame:
    """``labels`` (cls, label) after the links (a, b) between them."""
    if linked.isEmpty():
        return labels
    after = components(linked).select(F.col("v").alias("label"), F.col("label").alias("after"))
    return labels.join(after, "label", "left").withColumn("label", F.coalesce("after", "label")).drop("after")


def _open(leaves: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, cls, n_shingles, label, size): the members of leaves with a candidate of another label."""
    grouped = _grouped(leaves, labels, "bits")
    return written(grouped.mapInArrow(_open_members, "node bigint, cls bigint, n_shingles bigint, label bigint, size bigint"), "open")


def _links_of_leaves(open_members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): a forest, per leaf, of the links between labels of open members.

    The sets of a leaf meet in one row while they are ``TILE_BYTES`` together. Sets of a larger leaf are cut into ranges of shingles; what members share
    is counted per range and the counts are added, a leaf after the other, so that no row holds more than a tile or a matrix of counts."""
    tiled = open_members.withColumn("tiles", F.ceil(8 * F.col("size") / TILE_BYTES))
    small = _grouped(tiled.filter("tiles <= 1"), sets, "shingles").mapInArrow(_confirmed_leaves, PAIRS)
    large = tiled.filter("tiles > 1")
    if large.isEmpty():
        return written(small, "links")
    schema = "node bigint, cls bigint, n_shingles bigint, label bigint, tile bigint, shingles binary"
    cut = large.join(sets, "cls").select("node", "tiles", "cls", "n_shingles", "label", "shingles").mapInArrow(_tiles, schema)
    tiles = cut.groupBy("node", "tile").agg(F.collect_list(F.struct("cls", "n_shingles", "label", "shingles")).alias("members"))
    schema = "node bigint, n array<bigint>, label array<bigint>, common binary"
    counts = tiles.select("node", "members").mapInArrow(_tile_counts, schema)
    summed = counts.repartition("node").sortWithinPartitions("node").mapInArrow(_summed_tiles, PAIRS)
    return written(small.union(summed), "links")


def labels_of(rows: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """(cls, label) of all classes that may have a link: ``label`` is equal in a component by the confirmed links.

    Links found later join labels, not classes, so components are sought only between those that are known."""
    leaves, stars, roots = grow(classes, seed)
    slim = classes.select("cls", "n_shingles", "bits")
    alone = _grouped(leaves, slim.withColumn("label", F.col("cls")), "bits")
    # Over all trees, a class keeps its best candidate and its best among pivots and central classes: two pairs at most.
    kept = alone.mapInArrow(_first_pairs, FIRST).union(stars).groupBy("cls", "central").agg(F.max(F.struct("agree", "other")).alias("m"))
    first = kept.select(F.least("cls", "m.other").alias("a"), F.greatest("cls", "m.other").alias("b"))
    first = written(first.distinct(), "first")
    # Whoever has a candidate has its best one among the first.
    ends = first.select(F.col("a").alias("cls")).union(first.select("b")).union(stars.select("other")).distinct()
    needed = written(classes.select("cls", "n_shingles", "bits", "rep", "rep_h").join(ends, "cls"), "needed")
    sets = _sets_of(needed, rows)
    linked = written(confirmed(first.withColumns({"x": F.col("a"), "y": F.col("b")}), sets), "links")
    labels = _labelled(needed.select("cls", "n_shingles", "bits"), components(linked))
    in_leaves = _links_of_leaves(_open(leaves, labels), sets)
    # What is open between classes and pivots of larger nodes: at most a pair for every class in such a node.
    own, of = labels.select("cls", "label"), labels.select(F.col("cls").alias("other"), F.col("label").alias("of"))
    apart = stars.select("cls", "other").join(own, "cls").join(of, "other").filter("label != of")
    open_stars = apart.select(
        F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b"),
        F.expr("if(cls < other, label, of)").alias("x"), F.expr("if(cls < other, of, label)").alias("y")).dropDuplicates(["a", "b"])
    with_pivots = written(confirmed(open_stars.join(first, ["a", "b"], "left_anti"), sets), "links")
    found = _joined(own, in_leaves.union(with_pivots))
    if roots is None:
        return found
    # What left large nodes, between the components found so far.
    labels = _labelled(slim, found)
    open_members = _open(regrow(roots, labels), labels)
    more = open_members.select("cls").distinct().join(needed.select("cls"), "cls", "left_anti")
    more = written(classes.select("cls", "rep", "rep_h").join(more, "cls"), "needed")
    sets = sets.union(_sets_of(more, rows))
    return _joined(labels.select("cls", "label"), _links_of_leaves(open_members, sets))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked when their sets' intersection is at least 75 % of the union; ``component_id`` is the
    smallest id a document is connected with, itself included, and ``kept`` says that it is its own. Null, empty and wordless
    texts have no shingles and are linked with nothing; a text of fewer than five words is one shingle. Rows that share
    an id are linked by their own texts. A row without an id is linked with nothing, has no component and is kept. Other columns are ignored; an
    empty table gives no rows.
    """
    return judged_rows(docs, doc_id, text, seed).drop("h")


def judged_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """``near_duplicates`` with a hash ``h`` of id and text, which tells rows that share an id apart."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(doc_id, text).alias("h"))
    signed = written(rows.mapInArrow(_signed, SIGNED), "signed")
    taking_part = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(taking_part.groupBy("cls", "n_shingles").agg(
        F.min(F.struct("doc_id", "h")).alias("rep"), F.any_value("sketch").alias("sketch"), F.any_value("bits").alias("bits"),
    ).select("cls", "n_shingles", F.col("rep.doc_id").alias("rep"), F.col("rep.h").alias("rep_h"), "sketch", "bits"), "classes")
    # Most classes are their own label: only the others are joined.
    labels = written(labels_of(rows, classes, seed).filter("label != cls"), "labels")
    group = classes.select("cls", "rep").join(labels, "cls", "left").select(
        "cls", "rep", F.coalesce("label", "cls").alias("label"))
    smallest = group.groupBy("label").agg(F.min("rep").alias("smallest"))
    of_class = group.join(smallest, "label").select("cls", "smallest")
    placed = signed.drop("sketch", "bits").join(of_class, "cls", "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.col("smallest")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "h", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


# The same over all pairs of documents that share a shingle, for documents with distinct ids.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, w[i:i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, w FROM words WHERE len(w) BETWEEN 1 AND 4)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s)
    WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * c >= 75 * (m.n + n.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN parts USING (doc_id)
"""
