"""Operators 5, 7, 8 and 9: top-k, near duplicates, line runs, mixing."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import rows_of, words
from pyspark.sql import functions as F

from wareproof.llm import chosen_path, line_runs, mixing, mtree
from wareproof.llm.components import components
from wareproof.llm.order import numbered

# ---- 5 -------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_top(rows, every=100, k=10):
    whole = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[vec_id] = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
    out = []
    for q in whole:
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,page", [(4096, 64), (60, 4)])
def test_top_k_is_exact(spark, monkeypatch, shard, page):
    monkeypatch.setattr(mtree, "SHARD", shard)
    monkeypatch.setattr(mtree, "BLOCK", 2)
    monkeypatch.setattr(mtree.build, "__defaults__", (page, 4))
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + 0.1 * draw.normal(size=8)).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]  # equal vectors: ties, pages that do not part
    rows += [(2000, None), (2100, [1.0, None] + [0.0] * 6), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(2400, [1.0, 2.0]), (2401, [3.0, 4.0]), (2500, []), (2501, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("score", F.lit(1)).repartition(5)
    assert rows_of(mtree.top_k(df)) == plain_top(rows)


def test_search_leaves_nodes_out():
    draw = np.random.default_rng(1)
    centers = 1000 * draw.normal(size=(20, 16))
    vecs = np.floor(np.repeat(centers, 100, axis=0) + 30 * draw.normal(size=(2000, 16))).astype(np.int64)
    order, nodes, entry = mtree.build(vecs)
    x = vecs[order].astype(float)
    tree = (order.astype(np.int64), vecs[order], x, (x**2).sum(axis=1), entry, nodes)
    asked = np.array([7, 450, 1999])
    best, computed = mtree.search(tree, asked, vecs[asked], 10, np.full(3, -np.inf))
    for place, q in enumerate(asked.tolist()):
        scores = vecs @ vecs[q]
        want = sorted((i for i in range(2000) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert best.ids[place].tolist() == want
    assert computed < 3000
    for node in nodes:  # radii cover
        inside = np.linalg.norm(x[node["first"]:node["last"]] - x[node["center"]], axis=1)
        assert inside.max() <= node["radius"] + 1e-9


def test_wide_components_do_not_wrap():
    wide = np.array([[1 << 40, 1], [3, 4]], dtype=np.int64)
    assert mtree.products(wide, wide[:1]).tolist() == [[2**63 - 1, 3 * 2**40 + 4]]


def test_no_vectors(spark):
    assert mtree.top_k(spark.createDataFrame([], VECTORS)).collect() == []


# ---- 7 -------------------------------------------------------------------------------------------

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is not None:
            for x in s:
                holders[x].append(i)
    for i, j in {p for own in holders.values() for p in itertools.combinations(own, 2)}:
        common = len(sets[i][1] & sets[j][1])
        if 100 * common >= 75 * (len(sets[i][1]) + len(sets[j][1]) - common):
            parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            smallest[root(i)] = min(d, smallest.get(root(i), d))
    return Counter((d, len(s), None if d is None else smallest[root(i)], d is None or d == smallest[root(i)]) for i, (d, s) in enumerate(sets))


def near_group(n, start, seed):
    """Copies of one text with a few words changed each."""
    draw, base = np.random.default_rng(seed), words(120, seed, "g").split()
    out = []
    for i in range(n):
        own = list(base)
        for k in draw.choice(120, size=draw.integers(0, 4), replace=False):
            own[k] = f"neu{draw.integers(1000)}"
        out.append((start + i, " ".join(own)))
    return out


@pytest.mark.parametrize("limit", [100, 5])
def test_components_are_those_of_all_pairs(spark, documents, edges, monkeypatch, limit):
    monkeypatch.setattr(chosen_path, "LIMIT", limit)
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    rows += [(10_000 + r.doc_id, r.text) for r in documents.collect()]
    rows += near_group(60, 20_000, 3) + near_group(30, 30_000, 4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = Counter(tuple(r) for r in chosen_path.near_duplicates(df).collect())
    assert got == plain_components(rows)


def edited(rest, words, n, name):
    """``words`` with ``n`` of them new, at places taken from ``rest``."""
    own = list(words)
    for _ in range(n):
        k = rest.pop()
        own[k] = f"{name}x{k}"
    return own


@pytest.mark.parametrize("limit", [200, 50])
def test_chains_that_hang_from_one_member_of_a_large_group(spark, monkeypatch, limit):
    monkeypatch.setattr(chosen_path, "LIMIT", limit)
    draw, base = np.random.default_rng(8), words(200, 3, "kern").split()
    texts = [base]
    for i in range(2000):
        rest = draw.permutation(200).tolist()
        texts.append(edited(rest, base, 2, f"m{i}"))  # 0.90 of the base
        if i < 40:
            texts.append(edited(rest, texts[-1], 5, f"y{i}"))  # 0.77 of its member, about 0.70 of the base
            texts.append(edited(rest, texts[-1], 5, f"z{i}"))  # 0.77 of the one before
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(6)
    got = chosen_path.near_duplicates(df)
    assert [r.doc_id for r in got.filter("component_id != 0").collect()] == []


def test_links_found_later_are_sought_between_components_only(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LIMIT", 5)
    seen, found = [], chosen_path.components
    monkeypatch.setattr(chosen_path, "components", lambda links: seen.append(links.distinct().count()) or found(links))
    rows = near_group(60, 0, 3) + near_group(30, 1000, 4)
    got = Counter(tuple(r) for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == plain_components(rows)
    assert len(seen) == 1 or max(seen[1:]) < seen[0] / 2


def test_sets_that_are_too_large_to_meet_are_compared_in_tiles(spark, monkeypatch):
    """Long texts that are candidates of each other and mostly no links: all stay open up to the full sets."""
    draw, base = np.random.default_rng(2), words(3000, 5, "lang").split()
    rows = []
    for i in range(80):
        rest = draw.permutation(3000).tolist()
        rows.append((i, " ".join(edited(rest, base, 60 if i % 8 == 0 else 170, f"m{i}"))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = plain_components(rows)
    assert Counter(tuple(r) for r in chosen_path.near_duplicates(df).collect()) == want
    sizes, grouped = [], chosen_path._tile_counts

    def watched(batches):
        for batch in batches:
            for _, _, _, _, blobs in chosen_path._members(batch, "shingles"):
                assert sum(len(b.as_py()) for b in blobs) < 3 * 200_000
            yield from grouped(iter([batch]))

    monkeypatch.setattr(chosen_path, "TILE_BYTES", 200_000)
    monkeypatch.setattr(chosen_path, "_tile_counts", watched)
    split = chosen_path._links_of_leaves
    monkeypatch.setattr(chosen_path, "_links_of_leaves", lambda *a: sizes.append(1) or split(*a))
    assert Counter(tuple(r) for r in chosen_path.near_duplicates(df).collect()) == want
    assert sizes


def test_tiles_add_up_to_whole_sets():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2)) for n in (0, 1, 40, 300)]
    sets = [np.unique(np.concatenate([s, sets[3][::3]])) for s in sets]
    rows = pa.RecordBatch.from_pydict({
        "node": pa.array([1] * 4, pa.int64()), "tiles": pa.array([5] * 4, pa.int64()), "cls": pa.array(range(4), pa.int64()),
        "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "label": pa.array(range(4), pa.int64()),
        "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    cut = pa.Table.from_batches(list(chosen_path._tiles(iter([rows])))).to_pylist()
    for c, s in enumerate(sets):
        own = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in cut if r["cls"] == c]
        assert len(own) == 5 and np.concatenate(own).tolist() == s.tolist()


def test_summaries_keep_the_most_common_tokens():
    draw = np.random.default_rng(6)
    bits = draw.integers(0, 256, size=(900, chosen_path.TOKENS))
    bits[:300] = bits[0]  # a third are copies
    place = np.tile(np.arange(chosen_path.TOKENS), 100)
    tokens, counts = [], []
    for k in range(9):  # merged from nine batches
        own = draw.permutation(900)[:100] if k < 0 else np.arange(k, 900, 9)
        t, c = chosen_path._reduced(np.zeros(6400, dtype=np.int64), place, bits[own].reshape(-1), np.ones(6400), 1)
        tokens.append(t[0])
        counts.append(c[0])
    t, n = np.stack(tokens), np.stack(counts)
    at = np.nonzero(n)
    merged, left = chosen_path._reduced(np.zeros(len(at[0]), dtype=np.int64), at[1], t[at].astype(np.int64), n[at], 1)
    assert merged[0, :, 0].tolist() == bits[0].tolist()
    assert (left[0, :, 0] <= 310).all() and (left[0, :, 0] >= 300 - 900 // 9).all()


def test_near_duplicate_edges(edges, clashing, no_rows):
    got = rows_of(chosen_path.near_duplicates(edges))
    by_id = {r[0]: r for r in got}
    assert by_id[2] == (2, 0, 2, True) and by_id[4][1:] == (0, 4, True) and by_id[None][2:] == (None, True)
    assert by_id[7][2] == 6 and by_id[15][2] == by_id[16][2] == by_id[17][2] == 14
    assert rows_of(chosen_path.near_duplicates(clashing)) == got
    assert chosen_path.near_duplicates(no_rows).collect() == []


def test_sketches_estimate_the_similarity():
    draw = np.random.default_rng(2)
    sets = draw.integers(0, 2**63, size=(300, 200), dtype=np.uint64)
    agree = []
    for s in sets:
        other = np.unique(np.concatenate([s[:180], draw.integers(0, 2**63, 20, dtype=np.uint64)]))
        t = chosen_path.sketches([np.unique(s), other])
        agree.append((t[0] == t[1]).mean())
    assert abs(np.mean(agree) - 180 / 220) < 0.02


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 300)]
    hub = [(1000 + i, 999) for i in range(1, 200)]
    got = {r.v: r.label for r in components(spark.createDataFrame(path + hub, "a bigint, b bigint")).collect()}
    assert all(got[v] == 100 for v in range(100, 301)) and all(got[v] == 999 for v in [999, *range(1001, 1200)])


# ---- 8 -------------------------------------------------------------------------------------------

def plain_without_repeats(rows, min_words):
    """Every run of lines by its content, first place first."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0]))
    lines = {r: r[1].split("\n") for r in rows if r[1] is not None}
    count = {x: len(re.findall(r"[^\x20\x09-\x0D]+", x)) for own in lines.values() for x in own}
    first, out = {}, {}
    for r in rows:
        for s in range(len(lines.get(r, ()))):
            for e in range(s + 1, len(lines[r]) + 1):
                first.setdefault(tuple(lines[r][s:e]), (r, s))
    for r in rows:
        own, gone = lines.get(r), set()
        if own is None:
            out[r] = (None, 0, 0)
            continue
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                run = tuple(own[s:e])
                if sum(map(count.get, run)) >= min_words and first[run] != (r, s):
                    gone |= set(range(s, e))
        out[r] = ("\n".join(x for i, x in enumerate(own) if i not in gone), len(own), len(gone))
    return out


@pytest.mark.parametrize("min_words", [50, 12, 3, 1])
def test_repeated_runs_go(spark, min_words):
    draw = np.random.default_rng(min_words)
    pool = [" ".join(f"w{draw.integers(50)}" for _ in range(draw.integers(0, 9))) for _ in range(12)]
    rows = [(i, "\n".join(draw.choice(pool) if draw.random() < 0.8 else f"eigen {i} {k}" for k in range(draw.integers(1, 25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(["gleich drei worte"] * 40)), (104, rows[3][1]), (None, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_runs.without_repeats(df, min_words).collect()}
    assert got == {(r[0], n, gone, text) for r, (text, n, gone) in plain_without_repeats(rows, min_words).items()}


def test_line_run_edges(edges, clashing, no_rows):
    got = {r.doc_id: r for r in line_runs.without_repeats(edges).collect()}
    assert got[2].text is None and got[3].text == "" and got[11].text == "davor\ndanach" and got[13].text == "kopf\nfuß"
    assert got[10].n_removed == 0 and got[21].n_removed == 0 and got[23].n_removed > 0
    theirs = line_runs.without_repeats(clashing)
    assert set(clashing.columns) == set(theirs.columns)
    assert rows_of(theirs.select("doc_id", "text", "n_lines", "n_removed")) == rows_of(line_runs.without_repeats(edges).select("doc_id", "text", "n_lines", "n_removed"))
    assert line_runs.without_repeats(no_rows).collect() == []


def test_numbers_follow_the_order(spark):
    rows = [(None, 1), ("b", 2), ("a", 3), ("ä", 4), ("", 5), ("Z", 6)]
    got = numbered(spark.createDataFrame(rows, "k string, v int").repartition(4), ["k"], "n").orderBy("n").collect()
    assert [(r.k, r.n) for r in got] == [(None, 0), ("", 1), ("Z", 2), ("a", 3), ("b", 4), ("ä", 5)]


# ---- 9 -------------------------------------------------------------------------------------------

def plain_targets(sizes):
    """sizes: source -> size. Targets by resharing until none is above its stop."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not above:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return target


def check_mix(docs, block=None):
    rows = docs.collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = plain_targets(size)
    joined = mixing.mix(docs).join(docs.select(F.col("doc_id").alias("d"), "source", F.xxhash64("doc_id", "text").alias("hh")).distinct(),
                                   F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh"))).collect()
    assert len(joined) == len(rows)
    taken = defaultdict(int)
    for r in joined:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, words_taken in taken.items():
        assert abs(words_taken - target[s]) <= 1


def test_sources_reach_their_targets(edges, documents, spark):
    check_mix(edges)
    check_mix(documents)
    skewed = [(i, words(1 + i % 90, i), "groß" if i % 3 else f"s{i % 40:02}") for i in range(900)]
    check_mix(spark.createDataFrame(skewed, "doc_id bigint, text string, source string"))


def test_the_mix_does_not_depend_on_partitions(documents, clashing, edges, no_rows):
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    one = rows_of(mixing.mix(documents).select(*columns))
    assert rows_of(mixing.mix(documents.repartition(9)).select(*columns)) == one
    assert rows_of(mixing.mix(documents, seed=1).select(*columns)) != one
    assert rows_of(mixing.mix(clashing).select(*columns)) == rows_of(mixing.mix(edges).select(*columns))
    assert mixing.mix(no_rows).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutations_are_whole(spark, n):
    rows = spark.range(n).select(F.lit(3).cast("bigint").alias("number"), F.lit(n).cast("bigint").alias("blocks"), "id")
    there = mixing.permuted(rows, F.col("id"), "p", 5)
    got = mixing.permuted(there, F.col("p"), "back", 5, inverse=True).collect()
    assert sorted(r.p for r in got) == list(range(n)) and all(r.back == r.id for r in got)
    assert n < 64 or sum(r.p == r.id for r in got) < n / 4


def test_blocks_of_the_mix_are_the_words_taken(documents):
    blocks = mixing.mixed_blocks(documents, n_shards=4).collect()
    assert {r.shard for r in blocks} == {0, 1, 2, 3}
    n_words = sum(len(r.text.split(" ")) for r in blocks)
    assert n_words == mixing.mix(documents).agg(F.sum("taken")).first()[0]
    assert max(len(r.text.split(" ")) for r in blocks) == mixing.BLOCK


def test_words_taken_are_those_of_the_slots(documents, edges):
    """A replay in plain Python: the words of every slot's block, counted by document."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = documents.select(*columns).unionByName(edges.select(*columns))
    sized = mixing.sizes(docs, "doc_id", "text", "source")
    sources = mixing.written(mixing.source_table(sized), "targets")
    of_source = defaultdict(list)
    for r in sorted(sized.collect(), key=lambda r: (r.h, r.row)):
        of_source[r.source] += [r.row] * r.size
    number = {r.number: r.source for r in sources.collect()}
    want = Counter()
    for r in mixing.slots(sources).collect():
        words_of_block = of_source[number[r.number]][r.block * mixing.BLOCK:(r.block + 1) * mixing.BLOCK]
        assert 0 < r["take"] <= len(words_of_block)
        want.update(words_of_block[:r["take"]])
    assert {r.row: r.taken for r in mixing.taken(sized, sources).collect() if r.taken} == dict(want)


def test_slots_come_from_the_counts_of_shards(spark, documents):
    sources = mixing.written(mixing.source_table(mixing.sizes(documents, "doc_id", "text", "source")), "targets")
    got = mixing.slots(sources, seed=3, n_shards=8).collect()
    by_source = defaultdict(list)
    for r in got:
        by_source[r.number].append((r.slot, r.shard))
    counts = defaultdict(Counter)
    for number, own in by_source.items():
        assert sorted(s for s, _ in own) == list(range(len(own)))  # every slot in one shard
        assert [k for _, k in sorted(own)] == sorted(k for _, k in own)  # a range of slots each
        counts[number].update(k for _, k in own)
    n = sum(len(own) for own in by_source.values())
    chi = sum((c[k] - sum(c.values()) / 8) ** 2 / (sum(c.values()) / 8) for c in counts.values() for k in range(8))
    freedom = 7 * len(counts)
    assert n > 500 and abs(chi - freedom) < 5 * (2 * freedom) ** 0.5  # neither equal nor wilder than multinomial
    other = mixing.slots(sources, seed=4, n_shards=8).collect()
    assert Counter((r.number, r.shard) for r in other) != Counter((r.number, r.shard) for r in got)


@pytest.mark.parametrize("mean", [0.3, 4.0, 11.5, 40.0, 2500.0])
def test_poisson_counts(spark, mean):
    rows = spark.range(20_000).select(mixing.poisson(F.lit(mean), 5, "id").alias("n"))
    r = rows.agg(F.avg("n").alias("mean"), F.var_samp("n").alias("var"), F.min("n").alias("least")).first()
    assert abs(r["mean"] - mean) < 5 * (mean / 20_000) ** 0.5 + 1e-3 and abs(r["var"] / mean - 1) < 0.06 and r["least"] >= 0
