"""Operator 13 against NumPy."""

import math

import numpy as np
import pytest
from wareproof.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(vectors, k=whitening.COMPONENTS):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    c = (n * x - total) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    return deviation, c @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA)


def test_as_numpy_has_it(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)  # many blocks and splits
    monkeypatch.setattr(whitening, "SPLIT_BLOCKS", 2)
    draw = np.random.default_rng(5)
    vectors = (draw.normal(size=(120, 6)) * [8, 5, 3, 2, 1, 0.7] + 3).tolist()
    got = sorted(whitening.whitened_components(table(spark, vectors)).collect())
    deviation, scores, explained = brute(vectors)
    assert len(got) == 120 * 6
    w = np.array([r.whitened for r in got]).reshape(120, 6)
    signs = np.sign((w * scores).sum(axis=0))
    assert np.abs(w - signs * scores).max() < 1e-9
    assert [r.deviation for r in got[::6]] == deviation.tolist()
    assert np.allclose([r.explained for r in got[:6]], explained, rtol=1e-10)
    assert {r.n for r in got} == {120} and got[0].identity_error < 1e-9


def test_edges(spark):
    good = [[1.0, 2.0], [1.0, 2.0], [-3.0, 0.5], [4.0, 9.0], [0.0, -1e-9]]
    bad = [None, [None, 1.0], [math.nan, 1.0], [math.inf, 0.0], [-math.inf, 0.0], [], [1.0, 2.0, 3.0]]
    ids = [7, 7, None, 9, -1, *range(20, 20 + len(bad))]
    rows = table(spark, good + bad, ids).selectExpr("*", "'theirs' AS row", "'theirs' AS n", "'theirs' AS deviation", "'theirs' AS w", "'theirs' AS d")
    got = whitening.whitened_components(rows).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got) == sorted([(i is None, i) for i in ids[:5] for _ in (1, 2)])
    deviation, scores, _ = brute(good)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation.tolist())
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == 2), sorted(abs(scores[:, 1])))


def test_directions_without_variance_are_left_out(spark):
    flat = whitening.whitened_components(table(spark, [[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]])).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1.0)
    same = whitening.whitened(table(spark, [[1.0, 5.0]] * 3))
    assert [(r.whitened, r.deviation) for r in same[0].collect()] == [([], 0)] * 3
    assert whitening.whitened_components(table(spark, [[1.0, 5.0]])).collect() == []


def test_no_rows(spark):
    assert whitening.whitened_components(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whitened_components(table(spark, [None, [math.nan]])).collect() == []


def test_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found, model = whitening.whitened(rows)
    w = np.array([r.whitened for r in found.collect()])
    centred = w - w.mean(axis=0)
    assert np.abs(centred.T @ centred / len(w) - np.eye(32)).max() < 1e-8
    assert model["identity_error"] < 1e-8 and model["n"] == rows.count()
