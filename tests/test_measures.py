"""Batteries, embedders, specifications, image corpora, disclosure, and what must stay in proportion to its input."""

import hashlib
import json
import os
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.errors import ManifestError, ModelMismatch, SpecError, ValidationError
from corvane.functions import identity
from corvane.functions.embed import CommandEmbedder, FakeEmbedder, LexicalEmbedder, TableEmbedder, create_embedder, embed_column, model_hash
from corvane.functions.text import chunk_windows
from corvane.operators import battery, media
from corvane.operators import evaluate as ev
from corvane.operators.search import exact_search
from corvane.operators.workloads import clustered_rows, perturbed_queries
from corvane.plans.corpus import Corpus, bad_slab, build_corpus, check_spaces
from corvane.plans.pipeline import build_from_spec
from corvane.sources.spec import check_spec, dry_run, space_names, spec_of
from corvane.tables import materialize, scratch, work_dir

HASH = "sha256:" + "3" * 64


def chunk_rows(spark, n=60, dim=64):
    v = clustered_rows(spark, n, dim, per_center=6)
    return v.select("ordinal", F.concat(F.lit("doc "), "ordinal", F.lit(" alpha shared"), F.col("ordinal") % 7).alias("canonical_text"), F.lit("u").alias("source_uri"), F.lit(0).cast("long").alias("byte_start"), F.lit(9).cast("long").alias("byte_end"), "embedding")


# batteries


def test_tiers_variants_and_gates(spark, tmp_path):
    rows = chunk_rows(spark).persist()
    v = rows.select("ordinal", "embedding")
    q = perturbed_queries(v, 8)
    half = v.select("ordinal", F.transform("embedding", lambda x: -x).alias("embedding"))
    tiers = {r.model: r for r in battery.model_tiers({"a": (v, q), "b": (half, q)}, q.select("qid", F.col("qid").alias("ordinal")), reference="a").collect()}
    assert tiers["a"].identity == tiers["a"].mrr == 1 and tiers["a"].drift_median is None
    assert tiers["b"].drift_median == pytest.approx(-1) and tiers["b"].mrr < 1
    labels = v.select("ordinal", (F.col("ordinal") % 3).cast("string").alias("label"))
    swept = {r.variant: r for r in battery.run_sweep(rows, str(tmp_path / "sweep"), ["tiny", "mrl32-int8"], q, 5, labels=labels, embedding_model="m", embedding_dim=64, model_hash=HASH, chunker_version="1").collect()}
    assert swept["exact"].recall == 1 and swept["exact"].size_ratio == 1 and swept["tiny"].recall > 0.9 and swept["exact"].delta == 0 and swept["exact"].p_value == 1
    gates = battery.gate_rows(spark.createDataFrame([("tiny", 0.2, 0.99), ("nano", 0.3, 0.9), ("other", 1.0, 0.1)], "variant string, size_ratio double, recall double"), p95_before=2.0, p95_now=3.1)
    assert {(r.variant, r.measure): r.passed for r in gates.collect()} == {("tiny", "size_ratio"): True, ("tiny", "recall"): True, ("nano", "size_ratio"): False, ("nano", "recall"): True, ("exact", "p95"): False}


# embedders


def test_lexical_embedder_has_its_own_stream():
    e = LexicalEmbedder(16)
    a, b, none, null = e.embed(["Hello, hello WORLD", "world hello hello!", " ..", None])
    assert np.array_equal(a, b) and none.tolist() == null.tolist() == [1.0] + [0.0] * 15
    raw = lambda w: np.frombuffer(hashlib.shake_256(f"corvane-lexical-v2/{w}".encode()).digest(32), "<i2").astype(float)
    want = 2 * raw("hello") + raw("world")
    assert a == pytest.approx(want / np.linalg.norm(want), abs=1e-6)


def test_table_embedder(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[UNK]": 0, "red": 1, "blue": 2}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "tokenizer.json"))
    table = np.array([[1, 0, 0], [0, 3, 0], [0, 0, 4]], np.float32)
    np.save(tmp_path / "vectors.npy", table)
    e = create_embedder("table", folder=str(tmp_path))
    got = e.embed(["red blue", "", "green"])
    assert got[0] == pytest.approx([0, 0.6, 0.8]) and got[1].tolist() == got[2].tolist() == [1, 0, 0] and e.dim == 3
    df = spark.createDataFrame([("red",), (None,)], "t string").repartition(2)
    assert sorted(tuple(r[0]) for r in df.select(embed_column("t", e)).collect()) == [(0, 1, 0), (1, 0, 0)]
    before = model_hash(e)
    np.save(tmp_path / "vectors.npy", table + 1)
    assert model_hash(TableEmbedder(str(tmp_path))) != before


def test_command_embedder(spark, tmp_path):
    program = tmp_path / "embed.py"
    program.write_text("import sys, json\nfor line in sys.stdin:\n    x = json.loads(line)\n    print(json.dumps({'dimensions': 2, 'kind': 'size'} if x is None else [[len(t), 1] for t in x]), flush=True)\n")
    e = CommandEmbedder([sys.executable, str(program)])
    assert e.dim == 2 and e.embed(["abc", ""])[0].tolist() == [3, 1] and model_hash(e).startswith("sha256:")
    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    assert sorted(tuple(r[0]) for r in df.select(embed_column("t", e)).collect()) == [(2, 1), (4, 1)]
    program.write_text("import sys\nsys.exit(3)\n")
    with pytest.raises(RuntimeError, match="ended"):
        CommandEmbedder([sys.executable, str(program)])


# specifications

BASE = {"name": "n", "chunker_version": "v", "source": {"kind": "image_dir", "input_dir": "d"}, "models": [{"embedder": "fake", "image": "space", "dims": [4, 8]}]}


@pytest.mark.parametrize(
    "change,key",
    [
        ({"name": "a b"}, "name"), ({"chunker_version": ""}, "chunker_version"), ({"models": []}, "models"), ({"source": {"kind": "csv", "path": "p"}, "models": [{}]}, "order_by"),
        ({"source": {"kind": "csv", "path": "p", "order_by": ["a", "a"]}}, "order_by"), ({"source": {"kind": "csv", "path": "p", "order_by": ["a"]}}, "models.image"), ({"source": {"kind": "jsonl", "path": "p", "order_by": ["a"], "query": "q"}, "models": [{}]}, "source.query"),
        ({"source": {"kind": "sql", "query": "q", "order_by": ["a"], "labels": "x"}, "models": [{}]}, "labels"), ({"source": {"kind": "sql", "query": "q", "order_by": ["a"], "joins": [{"query": "q", "on": "k"}]}}, "joins\\[0\\].order"),
        ({"source": {"kind": "csv", "path": "p", "order_by": ["a"], "joins": [{"query": "q", "on": "k", "order": "o"}]}, "models": [{}]}, "joins"),
        ({"models": [{"text": "space"}]}, "default"), ({"models": [{}, {"name": "x"}]}, "default"), ({"models": [{}, {"text": "space"}]}, "same name"), ({"models": [{}, {"name": "x", "text": "none"}]}, "both none"),
        ({"models": [{"dims": [0]}]}, "dims"), ({"models": [{"space_dtype": "int4", "dims": [65]}]}, "int4"), ({"models": [{"image": "both"}]}, "image"), ({"models": [{"embedder": "fake", "image": "space", "dims": list(range(1, 18))}]}, "at most 15"),
        ({"build": {"preset": "huge"}}, "preset"), ({"build": {"dtype": "int2"}}, "dtype"), ({"build": {"graph_top_m": -1}}, "graph_top_m"), ({"build": {"graph_space": "x"}}, "graph_space"), ({"build": {"dtype": "int4", "mrl_dim": 65}}, "mrl_dim"),
        ({"build": {"max_chars": 5, "overlap": 5}, "models": [{}]}, "overlap"), ({"build": {"max_chars": 5}}, "max_chars"), ({"build": {"preset": "exact", "keep_full_precision": True}}, "keep_full_precision"), ({"build": {"with_graph": 1}}, "bool"),
        ({"output": {"mode": "some"}}, "mode"), ({"output": {"provenance": "x"}}, "provenance"), ({"output": {"embed_media": True}}, "embed_media"), ({"output": {"dir": ""}}, "dir"),
        ({"media": {"order": "cluster"}}, "media.order"), ({"media": {"backend": "files", "order": "x"}}, "order"), ({"media": {"backend": "files", "order": "cluster"}, "models": [{}]}, "cluster_space"), ({"media": {"backend": "files", "cluster_space": "x"}}, "cluster_space"),
        ({"media": {"backend": "files", "level": "best"}}, "level"), ({"media": {"backend": "files", "level": "auto"}, "models": [{}]}, "gate_model"), ({"media": {"backend": "files", "gate_model": "x"}}, "gate_model"), ({"media": {"shard_size": 0}}, "shard_size"),
        ({"media": {"backend": "files", "utility_floor": 0.5}}, "utility_floor"), ({"media": {"utility_query": "x"}}, "utility_query"), ({"media": {"floor_p10": 2.0}}, "floor_p10"), ({"media": {"utility_tolerance": -0.1}}, "utility_tolerance"),
        ({"surprise": 1}, "unknown key"), ({"source": {"kind": "ftp"}}, "source.kind"), ({"source": []}, "a table is expected"), ({"models": {}}, "a list is expected"),
    ],
)
def test_specification_rules(change, key):
    spec_of(BASE)
    with pytest.raises(SpecError, match=key):
        spec_of(BASE | change)


def test_space_names():
    s = spec_of(BASE | {"models": [{"embedder": "fake", "image": "space", "dims": [4, 8]}, {"name": "t", "text": "space"}]})
    assert space_names(s) == ["fake@4", "fake@8", "t-text"] and "write space t-text" in dry_run(s)["steps"]
    check_spec(s)


# image corpora and spaces


def test_image_corpus(spark, tmp_path):
    folder = tmp_path / "img"
    folder.mkdir()
    for name, data in (("a.png", b"one"), ("b.png", b"two"), ("c.png", b"one")):
        (folder / name).write_bytes(data)
    spec = spec_of({"name": "pics", "chunker_version": "v", "source": {"kind": "image_dir", "input_dir": str(folder)}, "models": [{"embedder": "fake", "image": "space", "dims": [4, 8], "settings": {"dim": 8}}], "build": {"preset": "exact"}, "media": {"backend": "files"}, "output": {"dir": str(tmp_path / "out"), "embed_media": True}})
    c = build_from_spec(spark, spec)["pics"]
    assert c.space_names == ["fake@4", "fake@8"] and c.blobs.count() == 2 and {c.blob(i) for i in (0, 1)} == {b"one", b"two"}
    uris = {r.ordinal: (r.source_uri, r.byte_start, r.byte_end) for r in c.chunks.collect()}
    assert uris[0] == uris[2] == ("a.png", 0, 3) and uris[1] == ("b.png", 0, 3)
    e = FakeEmbedder(8)
    hits = c.search_images("fake@8", e, 2, images=[b"two", b"one"]).orderBy("qid", "rank").collect()
    assert [(h.qid, h.ordinal) for h in hits if h.score > 0.999] == [(0, 1), (1, 0), (1, 2)] and hits[0].index_type == "space"
    assert [h.ordinal for h in c.search_images("fake@4", e, 1, images=[b"two"]).collect()] == [1]
    with pytest.raises(ModelMismatch):
        c.search_images("fake@8", LexicalEmbedder(8), 1, texts=["x"])
    assert c.search_images("fake@8", LexicalEmbedder(8), 1, texts=["x"], check=False).count() == 1


# checks of a corpus


def test_contract_spaces_and_slabs(spark, tmp_path):
    c = build_corpus(chunk_rows(spark), str(tmp_path / "c"), embedding_model="m", embedding_dim=64, model_hash=HASH, chunker_version="1", preset="tiny")
    c.validate()
    contract = tmp_path / "c" / "_contract.json"
    text = contract.read_text()
    contract.write_text(json.dumps(json.loads(text) | {"metric": "l2"}))
    for x in tmp_path.joinpath("c").glob("._contract*"):
        x.unlink()
    with pytest.raises(ManifestError, match="metric"):
        Corpus.open(spark, c.path)
    bad = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [float("inf"), 0.0])], "ordinal long, embedding array<float>")
    assert {r.ordinal: r.problem for r in bad_slab(bad, "float32", 2).collect()} == {1: "dimension", 2: "null", 3: "not finite"}
    good = {"a": {"index": 1, "dim": 4, "dtype": "float32", "model_hash": HASH}}
    check_spaces(good, HASH)
    for change in ({"index": 0}, {"index": 16}, {"dtype": "x"}, {"model_hash": "x"}, {"dim": 0}):
        with pytest.raises(ValidationError, match="spaces"):
            check_spaces({"a": good["a"] | change}, HASH)
    for two in ({"a": good["a"], "b": good["a"]}, {"": good["a"]}):
        with pytest.raises(ValidationError, match="spaces"):
            check_spaces(two, HASH)


def test_disclosure_counts_candidates(spark, tmp_path):
    c = build_corpus(chunk_rows(spark), str(tmp_path / "c"), embedding_model="m", embedding_dim=64, model_hash=HASH, chunker_version="1", preset="hybrid", with_graph=True, graph_top_m=2)
    q = perturbed_queries(c.vectors, 3).withColumn("text", F.when(F.col("qid") % 2 == 0, "alpha").otherwise("  "))
    exact = c.explain(q, 2, "exact").collect()
    assert {(r.exact_candidates, r.recall_estimate, r.fusion_mode) for r in exact} == {(60, 1.0, "none")}
    for r in c.explain(q, 2, "hnsw").collect():
        assert 0 < r.ann_candidates <= 60 and r.recall_estimate != r.recall_estimate
    for r in c.explain(q, 2, "graph", hops=1, ef=4).collect():
        assert r.exact_candidates == 4 <= r.graph_candidates <= 32
    routed = {r.qid: r for r in c.explain(q, 2).collect()}
    assert {i: r.route for i, r in routed.items()} == {i: "hnsw" if i % 2 else "hybrid" for i in routed}
    assert all(r.bm25_candidates == (60 if r.route == "hybrid" else 0) for r in routed.values())
    hits = c.retrieve(q, 2).select("qid", "index_type").distinct().collect()
    assert {h.qid: h.index_type for h in hits} == {i: r.route for i, r in routed.items()}


# in proportion


def test_digests_are_trees(spark, monkeypatch):
    n = 40
    df = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition(5)
    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    whole = hashlib.sha256("".join(h).encode()).hexdigest()
    assert identity.ordered_digest(df, "id", "h") == "sha256:" + whole
    monkeypatch.setattr(identity, "LEAF_ROWS", 7)
    leaves = [hashlib.sha256("".join(h[i : i + 7]).encode()).hexdigest() for i in range(0, n, 7)]
    assert identity.ordered_digest(df, "id", "h") == "sha256:" + hashlib.sha256("".join(leaves).encode()).hexdigest()
    assert identity.ordered_digest(df.limit(0), "id", "h") == "sha256:" + hashlib.sha256().hexdigest()


def test_windows_of_a_long_text(spark):
    text = ("ação é 日本 " * 1_000_000)[:10_000_000]
    df = spark.createDataFrame([(1, text)], "id long, text string")
    began = time.perf_counter()
    got = chunk_windows(df, "text", max_chars=512, overlap=64).agg(F.count("*").alias("n"), F.max("byte_end").alias("end"), F.max(F.length("canonical_text")).alias("longest")).first()
    print(f"10 million characters: {time.perf_counter() - began:.1f} s")
    assert (got.n, got.end, got.longest) == (1 + -(-(len(text) - 512) // 448), len(text.encode()), 512)
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("size,overlap", [(5, 0), (5, 4), (7, 3), (1, 0), (100, 99)])
def test_windows_against_slices(spark, size, overlap):
    texts = ["", "a", "añ日😀b\n" * 9, "x" * size, "x" * (size + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, `a.text` string")
    got = {(r.chunk_id, r.chunk_no): (r.canonical_text, r.byte_start, r.byte_end) for r in chunk_windows(df, "a.text", max_chars=size, overlap=overlap, keep_text=True).collect()}
    want = {}
    for i, t in enumerate(texts):
        start = n = 0
        while t:
            piece = t[start : start + size]
            want[i, n] = (piece, len(t[:start].encode()), len(t[:start].encode()) + len(piece.encode()))
            if start + size >= len(t):
                break
            start, n = start + size - overlap, n + 1
    assert got == want


def test_bootstrap_blocks_are_one_stream(spark, monkeypatch):
    diff = np.random.default_rng(0).normal(size=3000)
    rng = np.random.default_rng(42)
    means = diff[rng.integers(0, 3000, (ev.RESAMPLES, 3000))].mean(1)
    assert ev._bootstrap(diff, 42) == pytest.approx((diff.mean(), *np.percentile(means, [2.5, 97.5])))


def test_stratified_pick_of_a_hot_bucket(spark, monkeypatch):
    import corvane.operators.dedup as dedup

    monkeypatch.setattr(dedup, "INDEX_ROWS", 50)
    df = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("b"), F.col("id") % 50)).alias("b"))
    rows, want = [(r.id, r.b) for r in df.collect()], set()
    for bucket in {b for _, b in rows}:
        ids = sorted(i for i, b in rows if b == bucket)
        step = max(1, len(ids) // 10)
        want |= {i for k, i in enumerate(ids) if k % step == 0 and k // step < 10}
    assert {r.id for r in ev.stratified_pick(df, "b", "id", 10).collect()} == want


def test_canvas_and_permutations(spark):
    sizes = lambda rows: spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(rows)], "ordinal long, width int, height int")
    # the median of the ratios of width to height, not of their inverses
    assert media.canvas_size(sizes([(100, 100), (300, 100)]), 1000) == (200, 100)
    assert media.canvas_size(sizes([(101, 50), (0, 9), (9, 0)]), 1000) == (100, 50)
    assert media.canvas_size(sizes([(64, 64)] * 4 + [(640, 64)] * 3), 1000, probes=4) == (64, 64)
    with pytest.raises(ValidationError):
        media.canvas_size(sizes([(0, 0)]), 10)
    order = lambda rows: spark.createDataFrame(rows, "position long, ordinal long")
    for rows in ([(0, 0), (0, 1), (9, 2)], [(0, 5), (1, 6)], [(0, 1), (1, 1)], [(1, 0), (2, 1)]):
        with pytest.raises(ValidationError):
            media.inverse_permutation(order(rows))
    assert media.inverse_permutation(order([])).count() == 0


def test_tables_are_freed_and_settings_left_alone(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    folder = work_dir(spark).removeprefix("file://")
    assert spark.conf.get("spark.checkpoint.dir", None) == before and work_dir(spark).removeprefix("file://") == folder
    kept = materialize(spark.range(3), "kept")
    with scratch(spark):
        inside = materialize(spark.range(4), "inside")
        assert inside.count() == 4 and any(x.startswith("inside") for x in os.listdir(folder))
    assert not any(x.startswith("inside") for x in os.listdir(folder)) and kept.count() == 3


def test_only_a_missing_subpackage_is_left_out(monkeypatch):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def broken(name, *a, **k):
        if name.startswith("corvane.") and name.endswith("m") and "lexical" not in name and "streaming" not in name:
            raise ModuleNotFoundError("x", name="regex")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        e.queries()


def test_exact_search_reads_a_bounded_number_of_queries(spark, monkeypatch):
    """Of more queries than are broadcast, the driver sees one more than that number."""
    import corvane.operators.search as searching

    monkeypatch.setattr(searching, "QUERY_BLOCK", 3)
    v = clustered_rows(spark, 50, 8)
    seen = []
    real = type(v).toArrow
    monkeypatch.setattr(type(v), "toArrow", lambda self: seen.append(real(self)) or seen[-1])
    found = exact_search(v, v.select(F.col("ordinal").alias("qid"), F.col("embedding").alias("query")), 1)
    assert [t.num_rows for t in seen] == [4] and found.where("qid = ordinal").count() == 50
