"""Nearest vectors against brute force: recall, hot cells, dirt and equal vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corvane.llm.nearest_vectors as nv
from corvane.llm.queries import chunk_vectors


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<float>")


def clusters(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n // 15, dim))[rng.integers(0, n // 15, n)] + 0.25 * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def recall(got, x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return np.mean([len(set(t) & {n.id for n in got[i]}) / k for i, t in enumerate(truth)])


@pytest.mark.parametrize("block", [4096, 60])
def test_recall_and_exact_scores(spark, monkeypatch, block):
    monkeypatch.setattr(nv, "BLOCK", block)
    x = clusters(3000)
    got = {r.id: r.near for r in nv.nearest_vectors(frame(spark, x).repartition(4), "id", "v", dim=16, k=5).collect()}
    assert len(got) == 3000 and recall(got, x, 5) >= 0.95
    for i in (0, 17, 2999):
        assert [n.cosine for n in got[i]] == sorted((n.cosine for n in got[i]), reverse=True)
        assert [n.cosine for n in got[i]] == pytest.approx([float(x[i] @ x[n.id]) for n in got[i]], abs=1e-5)
        assert i not in {n.id for n in got[i]}


def test_routing_over_two_codebooks(spark, monkeypatch):
    monkeypatch.setattr(nv, "ROUTES", 4)
    monkeypatch.setattr(nv, "CELL", 60)
    x = clusters(1500, seed=1)
    got = {r.id: r.near for r in nv.nearest_vectors(frame(spark, x), "id", "v", dim=16, k=5, beam=8).collect()}
    assert recall(got, x, 5) >= 0.9


def test_two_routing_codebooks_with_the_production_beam(spark, monkeypatch):
    monkeypatch.setattr(nv, "ROUTES", 16)
    monkeypatch.setattr(nv, "CELL", 15)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))[rng.integers(0, 400, 6000)] + 0.5 * rng.normal(size=(6000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got = {r.id: r.near for r in nv.nearest_vectors(frame(spark, x), "id", "v", dim=64, k=5).collect()}
    print(f"p4 two codebooks {recall(got, x, 5):.4f}")
    assert recall(got, x, 5) >= 0.9


def test_dirty_and_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, [1.0, None]), (None, [1.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumn("near", F.lit(1))
    got = {r.id: [(round(n.cosine, 6), n.id) for n in r.near] for r in nv.nearest_vectors(df, "id", "v", dim=2, k=5).collect()}
    assert got == {0: [(1.0, 1), (0.0, 2)], 1: [(1.0, 0), (0.0, 2)], 2: [(0.0, 0), (0.0, 1)]}
    assert nv.nearest_vectors(df.limit(0), "id", "v", dim=2).count() == 0
    assert nv.nearest_vectors(df.where("id = 0"), "id", "v", dim=2).first().near == []


def test_equal_vectors_are_neighbours(spark):
    x = np.tile(np.array([[0.6, 0.8]], np.float32), (50, 1))
    got = {r.id: r.near for r in nv.nearest_vectors(frame(spark, x), "id", "v", dim=2, k=3).collect()}
    assert all(len(n) == 3 and all(abs(m.cosine - 1) < 1e-6 for m in n) for n in got.values()) and len(got) == 50


def test_a_third_of_all_vectors_are_copies(spark):
    x = clusters(900, seed=2)
    x[::3] = x[0]
    x[1], x[4] = x[7], x[7]
    got = {r.id: [n.id for n in r.near] for r in nv.nearest_vectors(frame(spark, x), "id", "v", dim=16, k=5).collect()}
    assert got[0] == [3, 6, 9, 12, 15] and got[6] == [0, 3, 9, 12, 15] and got[897] == [0, 3, 6, 9, 12]
    assert got[4][:2] == [1, 7] and len(got) == 900
    s = x @ x.T
    np.fill_diagonal(s, -2)
    worst = [np.sort(s[i])[-5] - min(s[i][j] for j in got[i]) for i in got]
    assert all(len(n) == 5 for n in got.values()) and np.mean(np.array(worst) < 1e-5) >= 0.9


def test_a_third_of_all_vectors_are_near_copies(spark, monkeypatch):
    """A dense group of different vectors over dozens of cells."""
    monkeypatch.setattr(nv, "CELL", 30)
    rng = np.random.default_rng(6)
    x = clusters(4500, seed=5, dim=32)
    x[::3] = x[0] + 0.05 * rng.normal(size=(1500, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got = {r.id: r.near for r in nv.nearest_vectors(frame(spark, x), "id", "v", dim=32, k=5).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1, kind="stable")[:, :5]
    hits = np.array([len(set(truth[i]) & {n.id for n in got[i]}) / 5 for i in range(len(x))])
    print(f"p4 near copies {hits[::3].mean():.4f}, all {hits.mean():.4f}")
    assert hits[::3].mean() >= 0.9 and hits.mean() >= 0.9


def test_additive_codes_get_closer_with_more_codebooks():
    x = clusters(2000, seed=4)
    errors = []
    for books in (1, 3, 6):
        q = nv.fit(x, len(x), codebooks=books, beam=4, seed=0)
        codes, norm, _ = q.encode(x)
        decoded = sum(q.all[codes[:, j]] for j in range(codes.shape[1]))
        assert np.linalg.norm(decoded, axis=1) == pytest.approx(norm, abs=1e-4)
        errors.append(float(((x - decoded) ** 2).sum(1).mean()))
    assert errors[0] > errors[1] > errors[2]


def test_vectors_of_chunks(spark):
    chunks = spark.createDataFrame([(0, "a", [1.0, 2.0]), (1, "b", None), (2, "c", None), (3, "d", None)], "ordinal long, chunk_id string, embedding array<float>")
    raw = lambda *v: bytearray(np.array(v, "<f4").tobytes())
    cache = spark.createDataFrame(
        [("b", "m", 2, raw(1, 1), 1), ("b", "m", 2, raw(3, 4), 2), ("b", "m", 2, raw(3, 4), 2), ("b", "x", 2, raw(9, 9), 3), ("c", "m", 2, raw(1, 1)[:5], 1), ("a", "m", 2, raw(7, 7), 1)],
        "chunk_id string, model string, dim int, data binary, cached_at long",
    )
    got = {r.ordinal: r.v for r in chunk_vectors(chunks, cache, model="m", dim=2).collect()}
    assert got == {0: [1.0, 2.0], 1: [3.0, 4.0], 2: None}
