"""Search verbs against NumPy: exact scores, the rerank contract, orders and refusals."""

import math
import os

import numpy as np
import pytest

from corvane.errors import QueryError
from corvane.operators import ann
from corvane.operators import search as searching
from corvane.operators.ann import Probes, ann_search, codebooks, ivf_build, ivf_probes
from corvane.operators.graph import bounded_bfs, build_graph, check_graph, next_chunk_edges
from corvane.operators.lexical import bm25_build, bm25_search, invalid_postings, rrf_union
from corvane.operators.search import check_query, exact_search, graph_search, hybrid_search, neighbor_context, rerank, split_queries, top_k
from corvane.queries import QUERIES


def vectors_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "ordinal long, embedding array<float>")


def queries_of(spark, q):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "qid long, query array<double>")


def rows(df):
    return [tuple(r) for r in df.orderBy("qid", "rank").collect()]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 400)] + 0.2 * rng.normal(size=(400, 16))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_axis_vectors(spark):
    v = vectors_of(spark, np.eye(4)[:3])
    got = rows(exact_search(v, queries_of(spark, [[1, 0, 0, 0], [1, 1, 0, 0]]), 5))
    assert [(q, r, o) for q, r, o, _ in got] == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert got[0][3] == pytest.approx(1) and got[3][3] == pytest.approx(math.sqrt(0.5)) and got[5][3] == 0


def test_exact_matches_numpy_whatever_the_partitions(spark, clustered):
    q = clustered[:7] + 0.01
    truth = np.argsort(-(q / np.linalg.norm(q, axis=1, keepdims=True)) @ clustered.T, axis=1, kind="stable")[:, :6]
    for parts in (1, 5):
        got = rows(exact_search(vectors_of(spark, clustered).repartition(parts), queries_of(spark, q), 6))
        assert [[o for a, _, o, _ in got if a == i] for i in range(7)] == truth.tolist()


def test_every_verb_returns_exact_scores(spark, clustered):
    v, q = vectors_of(spark, clustered), queries_of(spark, clustered[[3, 50]])
    chunks = spark.createDataFrame([(i, f"doc {i} alpha shared{i % 7}") for i in range(len(clustered))], "ordinal long, canonical_text string")
    texts = spark.createDataFrame([(0, "alpha shared3 shared3"), (1, "")], "qid long, text string")
    all_scores = clustered[[3, 50]].astype(float) @ clustered.T.astype(float)
    edges = build_graph(v.select("ordinal"), None)
    found = {
        "ann": ann_search(v, ivf_build(v, cells=8), q, 5),
        "graph": graph_search(v, edges, q, 5, ef=8),
        "hybrid": hybrid_search(v, q, texts, bm25_build(chunks), 5, candidates=12),
        "no index": hybrid_search(v, q, texts, None, 5, candidates=3),
    }
    for name, df in found.items():
        got = rows(df)
        assert len(got) == (6 if name == "no index" else 10), name
        for qid, rank, o, score in got:
            assert score == pytest.approx(all_scores[qid, o], abs=1e-6), name
        assert got[0][2] == 3, name


def share_found(found, truth):
    return found.join(truth, ["qid", "ordinal"]).count() / truth.count()


def test_many_queries_meet_the_vectors_in_groups(spark, clustered, monkeypatch):
    v, q = vectors_of(spark, clustered), queries_of(spark, clustered[:30] + 0.01)
    few = rows(exact_search(v, q, 6))
    monkeypatch.setattr(searching, "QUERY_BLOCK", 5)
    monkeypatch.setattr(searching, "VECTOR_GROUP", 40)
    many = rows(exact_search(v, q, 6))
    assert [r[:3] for r in many] == [r[:3] for r in few] and [r[3] for r in many] == pytest.approx([r[3] for r in few])


@pytest.mark.parametrize("routes,block", [(1024, 8192), (4, 8192), (1024, 7)])
def test_cells_reach_the_recall(spark, clustered, monkeypatch, routes, block):
    """One codebook, two of them, and cells that are cut into blocks."""
    monkeypatch.setattr(ann, "ROUTES", routes)
    monkeypatch.setattr(ann, "BLOCK", block)
    v, q = vectors_of(spark, clustered).persist(), queries_of(spark, clustered[:20])
    index = ivf_build(v, cells=12)
    books = codebooks(index[0])
    assert len(books.books) == (1 if routes > 4 else 2) and books.cells >= 12
    assert index[1].count() == len(clustered) and index[1].select("ordinal").distinct().count() == len(clustered)
    p = ivf_probes(v, index, q, 10)
    assert p.cells < books.cells
    assert share_found(ann_search(v, index, q, 10, probes=p), exact_search(v, q, 10)) >= 0.9
    every = ann_search(v, index, q, 10, probes=Probes(books.cells, books.cells))
    assert rows(every) == rows(exact_search(v, q, 10))


def test_index_of_dirty_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 2.0])], "ordinal long, embedding array<float>")
    index = ivf_build(v)
    assert {r.ordinal for r in index[1].collect()} == {0, 4}
    got = rows(ann_search(v, index, queries_of(spark, [[0.0, 1.0]]), 5))
    assert [r[2] for r in got] == [4, 0]
    none = ivf_build(v.limit(0))
    assert ann_search(v.limit(0), none, queries_of(spark, [[0.0, 1.0]]), 5).count() == 0


def test_beam_follows_the_measured_recall(spark):
    """Vectors without clusters, on the driver's table at sf0.1."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("the test tables are not here")
    t = spark.read.parquet(path)
    v = t.selectExpr("vec_id ordinal", "embedding")
    q = t.where("vec_id % 50 = 0").selectExpr("vec_id qid", "embedding query")
    truth = exact_search(v, q, 10)
    found = QUERIES["ann_topk"](spark, "/root/testdata/sf0.1")
    assert found.count() == truth.count()
    recall = found.join(truth, ["qid", "ordinal"]).count() / truth.count()
    print(f"ann_topk recall@10 {recall:.4f}")
    assert recall >= 0.9


def test_nan_sorts_last_and_ties_by_ordinal(spark):
    s = spark.createDataFrame([(0, 0, 0.5), (0, 1, math.nan), (0, 2, 0.9), (0, 3, math.nan), (0, 4, -1.0), (0, 6, 0.5)], "qid long, ordinal long, score double")
    assert [r[2] for r in rows(top_k(s, 10))] == [2, 0, 6, 4, 1, 3]
    assert rows(rerank(vectors_of(spark, [[1, 0], [0, 1]]), queries_of(spark, [[2, 0]]), spark.createDataFrame([(0, 1), (0, 1), (0, 0)], "qid long, ordinal long"), 9)) == [(0, 1, 0, 1.0), (0, 2, 1, 0.0)]


def test_refused_queries(spark):
    for vector, k in (([1.0], 0), ([], 1), ([1.0, 2.0], 1), ([math.nan], 1), ([math.inf], 1), ([0.0], 1)):
        with pytest.raises(QueryError):
            check_query(vector, k, 1)
    assert check_query([3.0], 1, 1) == [1.0]
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, []), (2, [1.0]), (3, [math.nan, 1.0]), (4, [0.0, 0.0]), (5, None)], "qid long, query array<double>")
    good, bad = split_queries(q, 2)
    assert [r.qid for r in good.collect()] == [0]
    assert {r.qid: r.reason for r in bad.collect()} == {1: "empty", 2: "dimension", 3: "not finite", 4: "zero", 5: "empty"}
    empty = spark.createDataFrame([], "qid long, query array<double>")
    assert exact_search(vectors_of(spark, [[1, 0]]), empty, 3).count() == 0
    assert exact_search(spark.createDataFrame([], "ordinal long, embedding array<float>"), queries_of(spark, [[1, 0]]), 3).count() == 0


PORTUGUESE = ["vacina contra covid em adultos", "vacina da gripe", "covid longa e sintomas", "dor de cabeça"]


def bm25_model(texts, query, k1=1.5, b=0.75):
    import re

    tok = lambda s: [t for t in re.findall(r"[^\W_]+", s.lower()) if len(t) > 1]
    docs = [tok(t or "") for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for t in tok(query):
        df = sum(t in d for d in docs)
        for i, d in enumerate(docs):
            tf = d.count(t)
            if tf:
                out[i] = out.get(i, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / max(avg, 1)))
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_against_a_model(spark):
    texts = PORTUGUESE + [None, "", "covid covid vacina a b c"]
    index = bm25_build(spark.createDataFrame(list(enumerate(texts)), "ordinal long, canonical_text string"))
    asked = ["vacina covid", "covid covid", "", "nada", None]
    got = rows(bm25_search(index, spark.createDataFrame(list(enumerate(asked)), "qid long, text string"), 3))
    for i, q in enumerate(asked):
        model = bm25_model(texts, q or "")[:3]
        mine = [(o, s) for a, _, o, s in got if a == i]
        assert [o for o, _ in mine] == [o for o, _ in model] and [s for _, s in mine] == pytest.approx([s for _, s in model])
    assert invalid_postings(index).count() == 0
    broken = dict(index, terms=index["terms"].selectExpr("term", "df + 1 df"))
    assert invalid_postings(broken).count() == 1


def test_rank_fusion(spark):
    a = spark.createDataFrame([(0, r + 1, o) for r, o in enumerate([10, 20, 30])], "qid long, rank int, ordinal long")
    b = spark.createDataFrame([(0, r + 1, o) for r, o in enumerate([20, 40, 50])], "qid long, rank int, ordinal long")
    got = rows(rrf_union(a, b))
    assert got[0][2] == 20 and got[0][3] == pytest.approx(1 / 62 + 1 / 61) and len(got) == 5 and [o for _, _, o, _ in got[1:3]] == [10, 40]


def bfs_model(edges, seeds, hops, cap):
    seen = list(dict.fromkeys(seeds))[:cap]
    frontier = seen
    for _ in range(hops):
        fresh = []
        for s in frontier:
            for _, _, d in sorted(e for e in edges if e[0] == s):
                if d not in seen and d not in fresh and len(seen) + len(fresh) < cap:
                    fresh.append(d)
        seen, frontier = seen + fresh, fresh
    return seen


@pytest.mark.parametrize("n,seeds,hops,cap", [(10, [5], 1, 99), (20, [10], 2, 99), (50, [25], 10, 5), (10, [3, 3, 4], 1, 99), (10, [3], 0, 9), (30, [7, 2, 19], 3, 8)])
def test_bounded_walk(spark, n, seeds, hops, cap):
    rng = np.random.default_rng(n + hops)
    edges = [(i, 0, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n] + [(int(a), 1, int(b)) for a, b in rng.integers(0, n, (n // 3, 2)) if a != b]
    edges = sorted(set(edges))
    e = spark.createDataFrame(edges, "src long, edge_type byte, dst long")
    s = spark.createDataFrame([(0, x, i) for i, x in enumerate([*seeds, 999])], "qid long, node long, arrival int")
    got = bounded_bfs(e, s, hops=hops, max_frontier=cap, n_chunks=n).orderBy("arrival").collect()
    assert [r.node for r in got] == bfs_model(edges, seeds, hops, cap) and [r.arrival for r in got] == list(range(len(got)))


def test_graph_edges_and_checks(spark):
    from corvane.errors import ValidationError

    n = spark.range(4).withColumnRenamed("id", "ordinal")
    assert sorted((r.src, r.dst) for r in next_chunk_edges(n).collect()) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)]
    assert next_chunk_edges(n.limit(1)).count() == 0
    check_graph(next_chunk_edges(n), 4)
    with pytest.raises(ValidationError):
        check_graph(next_chunk_edges(n), 3)


def test_neighbor_context(spark):
    c = spark.createDataFrame([(0, "a"), (1, None), (2, "c"), (3, "d")], "ordinal long, canonical_text string")
    got = {r.ordinal: r.context for r in neighbor_context(c, 1, "|").collect()}
    assert got == {0: "a|", 1: "a||c", 2: "|c|d", 3: "c|d"}
