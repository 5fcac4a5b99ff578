"""Operator 11 against a trie of plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from llm_rows import rows_of
from wareproof.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", digest(text or ""), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = tuple(turns.get(base, [])[:h] + own[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for node, own in members.items():
        d = len(node)
        below = [n for n in members if n[:d] == node]
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = sorted(c for c in own if len(convs[c]) == d)
        out.append((min(own), d, min(members[node[:-1]]) if d else None, len(own), sum(1 for m in members if len(m) == d + 1 and m[:-1] == node),
                    len(leaves), saved, digest(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    table = spark.createDataFrame(rows, SCHEMA)
    return rows_of(prefix_trie.prefix_trie(table, **more).select(*COLUMNS))


def test_edges(spark):
    rows = [
        (0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"),
        (1, 0, "user", "x"), (1, 1, "user", "y"),
        (2, None, None, None), (2, 0, "user", ""), (2, 0, "user", ""), (2, 0, "assistant", "z"),
        (3, 5, "user", "é" * 50_000),
        (4, 0, "user", "a"), (4, 0, "user", "a"),
        (-7, 0, "user", "a"), (-7, 1, "assistant", "b"), (-5, 0, "user", "a"),
        (None, 0, "user", "lost"), (None, None, None, None),
        (11, 0, "user", "q"), (17, 3, "s", "a"), (17, 1, "s", "b"),
    ]
    assert found(spark, rows) == brute(rows)


def test_empty_and_alone(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "a")]) == []
    one = [(5, 0, "user", "abc"), (5, 1, "assistant", "de")]
    assert found(spark, one) == brute(one)


def test_a_conversation_may_lose_all_turns(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert found(spark, [(c, 0, "user", "a")]) == [(c, 0, None, 1, 0, 1, 0, digest(str(c)))]


def test_extra_columns(spark):
    rows = [(0, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", "b")]
    names = ("conv", "pos", "d", "x", "y", "cls", "m", "v", "up", "rep", "depth", "number", "digest")
    clash = spark.createDataFrame([(*r, *names) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    assert rows_of(prefix_trie.prefix_trie(clash).select(*COLUMNS)) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 3)  # long conversations in many slices
    draw = random.Random(seed)
    starts = [[draw.choice("ab") for _ in range(draw.randrange(1, 40))] for _ in range(4)]
    rows = []
    for c in range(60):
        start = draw.choice(starts)
        texts = start[:draw.randrange(len(start) + 1)] + [draw.choice("ab") for _ in range(draw.randrange(1, 4))]
        rows += [(c, i, "user", t) for i, t in enumerate(texts)]
    draw.shuffle(rows)
    assert found(spark, rows, batches=(1, 2, 3)) == brute(rows)


def test_two_fattest(spark):
    from pyspark.sql import functions as F

    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("f", prefix_trie.two_fattest("a", "b"))
    for a, b, f in df.collect():
        assert f == max(range(a + 1, b + 1), key=lambda n: n & -n)
    assert spark.range(1).select(F.lit(3).alias("a"), F.lit(3).alias("b")).select(prefix_trie.two_fattest("a", "b")).first()[0] is None


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(prefix_trie.prefix_trie(table).select(*COLUMNS)) == brute(rows)
