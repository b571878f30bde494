"""Command line, sinks and workloads."""

import json

import pytest

from corvane import cli
from corvane.functions.embed import LexicalEmbedder, model_hash
from corvane.operators.search import exact_search
from corvane.operators.workloads import StepCache, clustered_rows, latency_summary, measure, perturbed_queries, pick_queries
from corvane.plans.corpus import build_corpus
from corvane.sources.sinks import read_sidecar, sidecar_manifest, write_answers


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    e = LexicalEmbedder(64)
    texts = [f"doc {i} alpha term{i}" for i in range(30)]
    rows = spark.createDataFrame([(i, t, f"item://{i}", 0, len(t), [float(x) for x in v]) for i, (t, v) in enumerate(zip(texts, e.embed(texts), strict=True))], "ordinal long, canonical_text string, source_uri string, byte_start long, byte_end long, embedding array<float>")
    return build_corpus(rows, str(tmp_path_factory.mktemp("c") / "c"), embedding_model=e.model, embedding_dim=64, model_hash=model_hash(e), chunker_version="v1", preset="hybrid", with_graph=True, graph_top_m=2, spaces={"own": rows.select("ordinal", "embedding")}), e


def ask(capsys, *arguments):
    code = cli.main(list(arguments))
    out = capsys.readouterr()
    return code, json.loads(out.out) if code == 0 else out.err


def test_verbs(spark, corpus, capsys, tmp_path):
    c, e = corpus
    vector = json.dumps([float(x) for x in e.embed(["doc 4 alpha term4"])[0]])
    assert ask(capsys, "doctor")[1]["ok"]
    assert ask(capsys, "inspect", c.path)[1]["rows"]["chunks"] == 30 and ask(capsys, "validate", c.path)[1]["valid"]
    for verb in (["search"], ["search-ann"], ["search-graph"], ["search-space", "--space", "own"]):
        code, got = ask(capsys, verb[0], c.path, *verb[1:], "--vector", vector, "--k", "2")
        assert code == 0 and got["hits"][0]["ordinal"] == 4 and len(got["hits"]) == 2
    code, got = ask(capsys, "ask", c.path, "--text", "doc 9 alpha term9", "--dim", "64", "--k", "1")
    assert got["hits"][0]["text"] == "doc 9 alpha term9"
    assert ask(capsys, "cite", c.path, "--citation", got["hits"][0]["citation_id"])[1]["ordinal"] == 9
    assert ask(capsys, "benchmark", c.path, "--queries", "4", "--k", "3", "--repeats", "1")[1]["recall"] == 1.0
    for bad in (["search", c.path, "--vector", "[1]"], ["media", c.path], ["cite", c.path, "--citation", "x/y"], ["ask", c.path, "--text", "x", "--dim", "32"]):
        code, err = ask(capsys, *bad)
        assert code == 2 and err
    q = spark.createDataFrame([(0, json.loads(vector))], "qid long, query array<double>")
    write_answers(c.hits(c.search(q, 3), "exact"), str(tmp_path / "answers"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "answers")).collect()]
    assert [x["rank"] for x in lines] == [1, 2, 3] and lines[0]["ordinal"] == 4


def test_sidecar(spark, tmp_path):
    items = spark.createDataFrame([(0, "a", "/x/y/a.png"), (1, "b", "b.png")], "ordinal long, key string, uri string")
    for level, uri in (("standard", "y/a.png"), ("full", "/x/y/a.png"), ("minimal", None)):
        sidecar_manifest("/home/me/corpus", "sha256:0", items, str(tmp_path / level), level=level)
        head, rows = read_sidecar(spark, str(tmp_path / level))
        assert head["items"] == 2 and rows.count() == 2 and ("uri" in rows.columns) == (uri is not None)
        if uri:
            assert rows.where("ordinal = 0").first().uri == uri


def test_workloads(spark, tmp_path):
    v = clustered_rows(spark, 200, 16)
    assert sorted(map(tuple, v.repartition(7).collect())) == sorted(map(tuple, v.collect()))
    q = perturbed_queries(v, 10)
    found = exact_search(v, q, 1)
    assert found.where("qid = ordinal").count() == 10 and pick_queries(v, 5).count() == 5 and pick_queries(v, None).count() == 200
    assert latency_summary([1, 2, 3, 4]) == {"mean": 2.5, "p50": 3, "p95": 4, "p99": 4} and latency_summary([]) == {}
    assert set(measure(lambda: None, 3)) == {"mean", "p50", "p95", "p99"}
    s = StepCache(str(tmp_path / "steps"))
    k = s.key("encode", {"a": 1})
    assert not s.hit(k)
    s.mark(k)
    assert s.hit(k) and not s.hit(s.key("encode", {"a": 2}))
