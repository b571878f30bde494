"""Sources, joins, corpora, pipelines and streams end to end on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.errors import CitationError, ManifestError, ModelMismatch, NotIndexed, SpecError, ValidationError
from corvane.functions.embed import LexicalEmbedder, model_hash
from corvane.functions.vectors import l2_norm
from corvane.operators import evaluate as ev
from corvane.operators import media
from corvane.operators.dedup import cluster_order, dedup_expand, dedup_pool, dense_index, frame_map, similarity_order
from corvane.operators.joins import check_bundle, check_total_order, interval_join, label_lookup, lookup_join
from corvane.plans import manifest as mf
from corvane.plans.corpus import Corpus, build_corpus, doctor
from corvane.plans.pipeline import build_from_spec, chunk_items, emit
from corvane.plans.presets import parse_variant
from corvane.sources.loaders import build_items, even_sample, read_csv, read_images, read_jsonl, read_labels, read_query, seeded_sample
from corvane.sources.spec import dry_run, load_spec
from corvane.streaming.ingest import embed_stream, stream_chunks, stream_distinct, windowed_counts

DOCS = [(f"d{i}", f"Title {i}", f"alpha beta term{i} shared{i % 7} " * 3) for i in range(12)]


# sources and joins


def test_csv_is_strings_and_jsonl_is_strict(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n01,"say ""hi""\nthere"\n2,\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("01", 'say "hi"\nthere'), ("2", "")]
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted(r.id for r in read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_jsonl(spark, str(tmp_path / "b.jsonl"), "id long").collect()
    assert read_query(spark, "select count(*) n from t", {"t": spark.range(3)}).first().n == 3


def test_images_and_labels(spark, tmp_path):
    for name in ("b.png", "a/c.JPG", "skip.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "labels.csv").write_text("image_id,label\nb,bee\na/c.JPG, sea \n")
    got = read_images(spark, str(tmp_path), read_labels(spark, str(tmp_path / "labels.csv"))).orderBy("ordinal").collect()
    assert [(r.ordinal, r.origin, r.label) for r in got] == [(0, "a/c.JPG", "sea"), (1, "b.png", "bee")]
    (tmp_path / "labels.json").write_text('{"b": "x"}')
    assert read_labels(spark, str(tmp_path / "labels.json")).first().label == "x"


def test_lookup_join_rules(spark):
    left = spark.createDataFrame([("a", None), (None, "keep"), ("z", "q")], "k string, v string")
    right = spark.createDataFrame([("a", "1", "old", 1), ("a", "2", "new", 2), (None, "3", "null", 1)], "k string, v string, w string, n long")
    got = {(r.k, r.v): r.w for r in lookup_join(left, right, "k", order="n").collect()}
    assert got == {("a", None): "new", (None, "keep"): "null", ("z", "q"): None}
    with pytest.raises(SpecError, match="no row matched"):
        lookup_join(left.where("k = 'z'"), right, "k", order="n")
    with pytest.raises(SpecError, match="never match"):
        lookup_join(left, spark.createDataFrame([(1, 2)], "k long, n long"), "k", order="n")


def test_items_order_and_fallbacks(spark):
    raw = spark.createDataFrame([(10, "x", None), (9, "", "item://own"), (100, None, "")], "id long, body string, source_uri string")
    got = build_items(raw, "c", order_by=["id"], text_template="{body}", null_text="").orderBy("ordinal").collect()
    assert [(r.key, r.canonical_text, r.source_uri) for r in got] == [("10", "x", "item://c/10"), ("100", "100", "item://c/100"), ("9", "9", "item://own")]
    with pytest.raises(SpecError, match="total order"):
        build_items(raw.union(raw), "c", order_by=["id"])
    with pytest.raises(SpecError):
        check_total_order(raw, [])


@pytest.mark.parametrize("n,size", [(10, 3), (7, 7), (100, 37), (5, 9), (1000, 999)])
def test_even_sample(spark, n, size):
    got = even_sample(spark.range(n).withColumnRenamed("id", "ordinal").withColumn("was", F.col("ordinal")), size).orderBy("ordinal").collect()
    want = [int(i * (n / size)) for i in range(size)] if size < n else list(range(n))
    assert [r.was for r in got] == want and [r.ordinal for r in got] == list(range(len(want)))
    assert seeded_sample(spark.range(n).withColumnRenamed("id", "ordinal"), 4).count() == min(4, n)


def test_interval_join_and_labels(spark):
    p = spark.range(30).withColumnRenamed("id", "f")
    s = spark.createDataFrame([("a", 0, 10), ("b", 10, 5), ("c", 20, 0), ("d", 21, 100)], "s string, start_frame long, n long")
    for bucket in (1, 7, 4096):
        got = {r.f: r.s for r in interval_join(p, s, point="f", start="start_frame", length="n", bucket=bucket).collect()}
        assert got == {f: "a" if f < 10 else "b" if f < 15 else "d" for f in range(30) if f < 15 or f > 20}
    items = spark.createDataFrame([("x/a.png",), ("b.png",), (".hidden",)], "origin string")
    labels = spark.createDataFrame([("x/a.png", ""), ("a", "stem"), ("b.png", "path"), ("b", "no")], "name string, label string")
    assert {r.origin: r.label for r in label_lookup(items, labels).collect()} == {"x/a.png": "stem", "b.png": "path", ".hidden": ""}


def test_bundle_references(spark):
    c = spark.createDataFrame([("c1",)], "chunk_id string")
    e = spark.createDataFrame([("e1",)], "entity_id string")
    good = {"chunks": c, "entities": e, "mentions": spark.createDataFrame([("e1", "c1")], "entity_id string, chunk_id string"), "edges": spark.createDataFrame([("e1", "e1")], "src string, dst string")}
    check_bundle(good)
    for broken in ({"chunks": c.union(c)}, {"mentions": spark.createDataFrame([("e1", "c9")], "entity_id string, chunk_id string")}, {"edges": spark.createDataFrame([("e1", "e9")], "src string, dst string")}):
        with pytest.raises(ValidationError):
            check_bundle(good | broken)


# deduplication and orders


def test_dedup_pool(spark):
    rows = [(i, x) for i, x in enumerate(["a", "b", "a", "c", "b", "a", None, None])]
    df = spark.createDataFrame(rows, "ordinal long, t string").repartition(3)
    pool, refs = dedup_pool(df, "t")
    assert [(r.pool_index, r.t) for r in pool.orderBy("pool_index").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, None)]
    assert [tuple(r) for r in dedup_expand(pool, refs, "t").orderBy("ordinal").collect()] == [r for r in rows if r[1] is not None] + [(6, None), (7, None)]
    images = spark.createDataFrame([(0, "h"), (1, None), (2, "h"), (3, None)], "ordinal long, image_sha256 string")
    assert [r.frame for r in frame_map(images)[1].orderBy("ordinal").collect()] == [0, 1, 0, 2]


def test_dense_index_over_ranges(spark, monkeypatch):
    import corvane.operators.dedup as dd

    monkeypatch.setattr(dd, "INDEX_ROWS", 50)
    df = spark.range(777).select((F.col("id") * 7919 % 777).alias("a"), F.concat(F.lit("k"), "id").alias("b"))
    assert [(r.i, r.a) for r in dense_index(df, ["a", "b"], "i").orderBy("i").collect()] == [(i, i) for i in range(777)]
    assert [r.i for r in dense_index(df, "b", "i").orderBy("b").collect()] == list(range(777))


def test_sequential_orders(spark):
    two = [[1, 0], [0, 1], [0.99, 0.05], [0.02, 1], [1, 0.01], [0, 0]]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(two)], "ordinal long, embedding array<float>")
    assert [r.ordinal for r in cluster_order(df, threshold=0.9).orderBy("position").collect()] == [0, 2, 4, 1, 3, 5]
    walk = [r.ordinal for r in similarity_order(df.where("ordinal < 5")).orderBy("position").collect()]
    assert walk == [0, 4, 2, 3, 1]


# manifests and corpora


def rows_of(spark, dim=64, n=40):
    e = LexicalEmbedder(dim)
    texts = [f"doc {i} alpha beta term{i} shared{i % 7}" for i in range(n)]
    return e, spark.createDataFrame([(i, t, f"item://{i}", 0, len(t), [float(x) for x in v]) for i, (t, v) in enumerate(zip(texts, e.embed(texts), strict=True))], "ordinal long, canonical_text string, source_uri string, byte_start long, byte_end long, embedding array<float>")


def queries_like(spark, rows):
    return rows.where("ordinal = 3").select(F.lit(0).cast("long").alias("qid"), F.col("embedding").alias("query"))


def about(e, **more):
    return {"embedding_model": e.model, "embedding_dim": e.dim, "model_hash": model_hash(e), "chunker_version": "v1"} | more


@pytest.mark.parametrize("preset", ["exact", "compressed", "tiny", "nano", "hybrid"])
def test_corpus_of_each_preset(spark, tmp_path, preset):
    e, rows = rows_of(spark)
    c = build_corpus(rows.repartition(5), str(tmp_path / "c"), preset=preset, with_graph=True, graph_top_m=2, **about(e))
    c.validate()
    q = spark.createDataFrame([(0, [float(x) for x in e.embed(["doc 7 alpha beta term7 shared0"])[0]], "term7 shared0")], "qid long, query array<double>, text string")
    for found in (c.search(q, 3), c.search_ann(q, 3), c.search_graph(q, 3, ef=5), c.search_hybrid(q, 3) if preset == "hybrid" else c.search(q, 3), c.search_routed(q, 3)):
        best = found.orderBy("rank").first()
        assert best.ordinal == 7 and best.score == pytest.approx(1, abs=0.02)
    hit = c.retrieve(q, 2, expected_model_hash=model_hash(e)).orderBy("rank").first()
    assert hit.text.startswith("doc 7 ") and c.cite(hit.citation_id)["canonical_text"] == hit.text
    assert c.route(True) == {"exact": "exact", "compressed": "exact", "tiny": "hnsw", "nano": "hnsw", "hybrid": "hybrid"}[preset]
    assert c.ask("doc 9 alpha beta term9 shared2", e, 1).first().ordinal == 9
    assert c.inspect()["rows"]["chunks"] == 40 and c.browse(10, 5).count() == 5 and c.context().count() == 40
    with pytest.raises(ModelMismatch):
        c.retrieve(q, 2, expected_model_hash="sha256:" + "1" * 64)
    with pytest.raises(CitationError):
        c.cite("corpus://sha256:00/x")
    with pytest.raises(CitationError):
        c.cite(f"corpus://{c.manifest.content_hash}/sha256:none")


def test_semantic_edges_and_hybrid_hits_of_vectors_without_clusters(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, f"text {i}", f"item://{i}", 0, 6, [float(v) for v in r]) for i, r in enumerate(x)], "ordinal long, canonical_text string, source_uri string, byte_start long, byte_end long, embedding array<float>")
    c = build_corpus(rows, str(tmp_path / "c"), with_graph=True, graph_top_m=4, embedding_model="m", embedding_dim=32, model_hash="sha256:" + "1" * 64, chunker_version="v1")
    s = x @ x.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1)
    edges = {}
    for r in c.edges.where("edge_type = 1").collect():
        edges.setdefault(r.src, set()).add(r.dst)
    recall = np.mean([len(edges[i] & set(truth[i, :4])) / 4 for i in range(1500)])
    asked = range(0, 1500, 30)
    q = spark.createDataFrame([(i, [float(v) for v in x[i]], "nothing") for i in asked], "qid long, query array<double>, text string")
    hits = {i: set() for i in asked}
    for r in c.search_hybrid(q, 10).collect():
        hits[r.qid].add(r.ordinal)
    hybrid = np.mean([len(hits[i] & {i, *truth[i, :9]}) / 10 for i in asked])
    print(f"semantic edges {recall:.4f}, hybrid recall@10 {hybrid:.4f}")
    assert recall >= 0.9 and hybrid >= 0.9


def test_content_hash_ignores_indexes_and_partitions_but_not_content(spark, tmp_path):
    e, rows = rows_of(spark, n=12)
    a = build_corpus(rows, str(tmp_path / "a"), preset="exact", **about(e))
    b = build_corpus(rows.orderBy(F.desc("ordinal")).repartition(3), str(tmp_path / "b"), preset="hybrid", with_graph=True, partitions=2, **about(e))
    m = build_corpus(rows, str(tmp_path / "m"), preset="exact", mrl_dim=32, **about(e))
    assert a.manifest.content_hash == b.manifest.content_hash != m.manifest.content_hash
    assert m.manifest.embedding_dim == 32 and m.vectors.select(l2_norm("embedding").alias("n")).agg(F.min("n")).first()[0] == pytest.approx(1, abs=1e-6)
    full = build_corpus(rows, str(tmp_path / "f"), preset="tiny", keep_full_precision=True, **about(e))
    assert full.manifest.content_hash == a.manifest.content_hash and full.rerank_source == "full_precision"
    with pytest.raises(ManifestError, match="exists"):
        build_corpus(rows, str(tmp_path / "a"), preset="exact", **about(e))


def test_bad_rows_are_refused(spark, tmp_path):
    e, rows = rows_of(spark, n=3)
    bad = {
        "dimension": rows.withColumn("embedding", F.slice("embedding", 1, 3)),
        "not finite": rows.withColumn("embedding", F.transform("embedding", lambda x: F.lit(math.nan).cast("float"))),
        "span": rows.withColumn("byte_end", F.lit(-1).cast("long")),
        "null text": rows.withColumn("canonical_text", F.lit(None).cast("string")),
        "0..n-1": rows.withColumn("ordinal", F.col("ordinal") + 1),
        "must be rows": rows.limit(0),
    }
    for message, df in bad.items():
        with pytest.raises(ValidationError, match=message):
            build_corpus(df, str(tmp_path / "x"), **about(e))
    with pytest.raises(ManifestError, match="placeholder"):
        build_corpus(rows, str(tmp_path / "x"), **about(e, model_hash=mf.PLACEHOLDER))


def test_spaces_blobs_and_tampering(spark, tmp_path):
    e, rows = rows_of(spark, n=6)
    data = b"12345678"
    blobs = spark.createDataFrame([(0, bytearray(data))], "blob_index long, data binary").select("blob_index", F.sha2("data", 256).alias("content_hash"), F.lit("media://a.bin").alias("original_uri"), F.length("data").cast("long").alias("byte_len"), F.lit(True).alias("inlined"), "data")
    spans = spark.createDataFrame([(2, 0, 1, 3), (3, None, 0, 0)], "ordinal long, blob_index long, byte_start long, byte_end long")
    space = rows.select("ordinal", F.array(F.col("ordinal").cast("float"), F.lit(1).cast("float")).alias("embedding"))
    c = build_corpus(rows, str(tmp_path / "c"), preset="exact", spaces={"image": space}, space_models={"image": "sha256:" + "a" * 64}, blobs=blobs, blob_spans=spans, **about(e))
    q = spark.createDataFrame([(0, [5.0, 1.0])], "qid long, query array<double>")
    assert c.search_space("image", q, 1).first().ordinal == 5
    with pytest.raises(ModelMismatch):
        c.search_space("image", q, 1, model_hash="x")
    with pytest.raises(NotIndexed):
        c.space("sound")
    with pytest.raises(NotIndexed):
        c.edges  # noqa: B018
    assert c.blob(0) == data and c.chunks.where("ordinal = 2").first().source_uri == "media://a.bin" and c.inspect()["blob_totals"]["bytes"] == 8
    with pytest.raises(NotIndexed):
        c.blob(4)
    assert media.blob_by_uri(c.blobs, "media://a.bin#frame=1") == data
    with pytest.raises(NotIndexed):
        media.blob_by_uri(c.blobs, "media://b.bin")
    assert c.search_by("exact", queries_like(spark, rows), 1).first().text == c.search_by("routed", queries_like(spark, rows), 1).first().text == "doc 3 alpha beta term3 shared3"
    assert c.search_by("space", q, 1, name="image").first().ordinal == 5
    with pytest.raises(NotIndexed):
        c.search_by("magic", q, 1)
    assert media.export_blobs(c.blobs, str(tmp_path / "out")) == 1 and (tmp_path / "out" / "000000-a.bin").read_bytes() == data
    with pytest.raises(ValidationError):
        media.export_blobs(blobs.withColumn("content_hash", F.lit("0")), str(tmp_path / "out2"))
    with pytest.raises(ValidationError):
        media.span_overlay(rows, spans, blobs.limit(0))
    text = (tmp_path / "c" / "_manifest.json").read_text()
    (tmp_path / "c" / "_manifest.json").write_text(text.replace(c.manifest.tables["chunks"], "sum128:0"))
    for f in (tmp_path / "c").glob("._manifest.json.crc"):
        f.unlink()
    with pytest.raises(ValidationError, match="chunks"):
        Corpus.open(spark, str(tmp_path / "c")).validate()


def test_manifest_rules():
    good = mf.Manifest("m", 64, "sha256:" + "a" * 64, "v1", 3)
    good.validate()
    again = mf.Manifest.from_json(good.to_json()[:-1] + ',"later":{"x":1}}')
    assert again.extra == {"later": {"x": 1}} and json.loads(again.to_json())["later"] == {"x": 1}
    for change in ({"format_version": 2}, {"schema_version": 2}, {"embedding_model": ""}, {"embedding_dim": 0}, {"n_chunks": 0}, {"chunker_version": ""}, {"model_hash": "x"}, {"dtype": "int2"}, {"metric": "l2"}, {"score_type": "x"}, {"normalize": "no"}, {"index_type": "hnsw"}, {"index_type": "hybrid", "rerank_policy": "exact"}, {"dtype": "int4", "embedding_dim": 96}, {"mrl_dim": 64}, {"mrl_dim": 64, "full_dim": 32}, {"mrl_dim": 32, "full_dim": 64}):
        with pytest.raises(ManifestError):
            mf.Manifest(**(vars(good) | change)).validate()
    assert mf.differences({"a": 1, "path": 1, "l": [1, 2]}, {"a": 2, "path": 2, "l": [1, 3], "b": 0}) == ["a: 1 and 2", "b: only in the second", "l[1]: 2 and 3"]
    with pytest.raises(ManifestError):
        mf.check_lock({"a": 1}, {"a": 2})
    assert [mf.redact("/home/u/x/y.txt", k) for k in ("minimal", "standard", "full")] == ["y.txt", "x/y.txt", "/home/u/x/y.txt"]
    with pytest.raises(ModelMismatch):
        mf.check_model(mf.Manifest("m", 64, mf.PLACEHOLDER, "v1", 3), "sha256:x")
    assert parse_variant("mrl96-int8").mrl_dim == 96 and parse_variant("micro").preset == "tiny"
    with pytest.raises(ValueError):
        parse_variant("mrl0-int8")


# pipelines


SPEC = """
name = "starter"
chunker_version = "v1"
[source]
kind = "jsonl"
path = "{path}"
order_by = ["id"]
text = "{{title}}\\n{{text}}"
[[models]]
embedder = "lexical"
text = "default"
[models.settings]
dim = 64
[[models]]
embedder = "fake"
text = "space"
[build]
preset = "hybrid"
[output]
dir = "{out}"
"""


def test_build_from_a_specification(spark, tmp_path, monkeypatch):
    (tmp_path / "docs.jsonl").write_text("\n".join(json.dumps({"id": a, "title": b, "text": c}) for a, b, c in DOCS))
    spec_path = tmp_path / "c.toml"
    spec_path.write_text(SPEC.format(path="${DOCS_DIR}/docs.jsonl", out=tmp_path / "out"))
    with pytest.raises(SpecError, match="DOCS_DIR"):
        load_spec(str(spec_path))
    monkeypatch.setenv("DOCS_DIR", str(tmp_path))
    spec = load_spec(str(spec_path))
    assert "build lexical index" in dry_run(spec)["steps"]
    cache = str(tmp_path / "cache")
    c = build_from_spec(spark, spec, cache=cache)["starter"]
    assert c.manifest.n_chunks == 12 and c.space_names == ["fake-text"] and (tmp_path / "out" / "starter.lock.json").exists()
    before = spark.read.parquet(cache).count()
    spec.output.dir = str(tmp_path / "out2")
    again = build_from_spec(spark, spec, cache=cache)["starter"]
    assert spark.read.parquet(cache).count() == before == 12 and again.manifest.content_hash == c.manifest.content_hash


@pytest.mark.parametrize("change,message", [("[sourced]\nx=1", "unknown key"), ("name = 3", "str"), ('[source]\nkind = "ftp"', "source.kind"), ('[source]\nkind = "csv"\norder_by=["id"]', "path"), ('[build]\npreset = "huge"', "preset")])
def test_specification_errors_name_the_key(tmp_path, change, message):
    base = '' if change.startswith("name") else 'name = "n"\n'
    base += 'chunker_version = "v"\n'
    if "[source]" not in change:
        change += '\n[source]\nkind = "csv"\npath = "p"\norder_by = ["id"]\n' if not change.startswith("[sourced") else ""
    (tmp_path / "s.toml").write_text(base + change if not change.startswith("name") else change.split("\n")[0] + "\n" + base + "\n".join(change.split("\n")[1:]))
    with pytest.raises(SpecError, match=message):
        load_spec(str(tmp_path / "s.toml"))


def test_emit_chunks_long_items(spark, tmp_path):
    items = spark.createDataFrame([(0, "abc " * 50, "u0"), (1, "x", "u1")], "ordinal long, canonical_text string, source_uri string")
    chunks = chunk_items(items, max_chars=64, overlap=8)
    c = emit(chunks, str(tmp_path / "c"), LexicalEmbedder(64), chunker_version="v1", preset="exact")
    assert c.manifest.n_chunks == chunks.count() == 5 and doctor(spark)["ok"]


# streams


def test_stream_gives_the_rows_of_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([(a, c) for a, _, c in DOCS], "source_uri string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    cache, e = str(tmp_path / "cache"), LexicalEmbedder(16)
    for run in ("one", "two"):  # a repeated stream adds nothing
        embed_stream(stream_chunks(stream, max_chars=40), cache, e, str(tmp_path / f"cp-{run}")).awaitTermination(120)
    batch = stream_chunks(docs, max_chars=40)
    assert spark.read.parquet(cache).count() == batch.select("chunk_id").distinct().count()


def test_windowed_counts_and_distinct(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    (tmp_path / "ev").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from wc").first()[0] == events.where("ts is not null").count()
    twice = stream.select(F.col("ts"), F.concat(F.lit("c"), F.col("user_id") % 5).alias("chunk_id"))
    d = stream_distinct(twice, time_col="ts", delay="10000 days").writeStream.format("memory").queryName("dd").trigger(availableNow=True).start()
    d.awaitTermination(120)
    assert spark.sql("select count(*) from dd").first()[0] == 5


# evaluation and media tables


def test_evaluation_against_numpy(spark):
    rng = np.random.default_rng(0)
    s, c, lab = rng.normal(0.3, 1, 60), rng.normal(0, 1, 60), [f"L{i % 3}" for i in range(60)]
    pairs = spark.createDataFrame([(i, float(a), float(b), x) for i, (a, b, x) in enumerate(zip(s, c, lab, strict=True))], "qid long, sample double, control double, label string")
    d = s - c
    means = d[np.random.default_rng(42).integers(0, 60, (5000, 60))].mean(1)
    r = ev.bootstrap_delta(pairs.repartition(3)).first()
    assert (r["mean"], r.low, r.high) == tuple(round(float(x), 4) for x in (d.mean(), *np.percentile(means, [2.5, 97.5])))
    per = ev.bootstrap_delta(pairs, by="label")
    assert per.count() == 3 and ev.class_floor_ok(per)
    t = ev.sign_test(pairs)
    assert t["pos"] == int((d > 0).sum()) and 0 < t["p_value"] <= 1
    assert ev.sign_test(pairs.where("false")) == {"pos": 0, "neg": 0, "p_value": 1.0}
    p = ev.linear_percentiles(pairs, "sample", [0.5, 0.95]).first()
    assert [p.p50, p.p95] == pytest.approx(np.percentile(s, [50, 95]).tolist())
    assert ev.nearest_rank(pairs, "sample", 0.5).first().value == sorted(s)[round(0.5 * 59)]


def test_rank_metrics(spark):
    ranked = lambda x: spark.createDataFrame([(q, r + 1, o) for q, os in x.items() for r, o in enumerate(os)], "qid long, rank int, ordinal long")
    a, b = ranked({0: [0, 1, 2, 3], 1: [1, 5, 6, 7]}), ranked({0: [1, 0, 3, 9], 1: [8, 9, 10, 11]})
    assert {r.qid: r.recall for r in ev.recall_at_k(b, a, 4).collect()} == {0: 0.75, 1: 0.0}
    got = {r.qid: (r.overlap, r.tau) for r in ev.ranking_agreement(a, b, 4).collect()}
    assert got[0] == (0.75, pytest.approx(1 / 3)) and got[1] == (0.0, None)
    assert ev.identity_recall(a, 1).first().recall == 1.0
    gold = spark.createDataFrame([(0, 1), (1, 99)], "qid long, ordinal long")
    m = ev.mean_reciprocal_rank(a, gold).first()
    assert (m.mrr, m.hit_at_1, m.hit_at_3) == (0.25, 0.0, 0.5)
    assert ev.leakage(a, spark.createDataFrame([(0, 3), (1, 3)], "qid long, ordinal long"), 4).first().leakage == 0.5
    labels = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, None)], "ordinal long, label string")
    assert [tuple(r) for r in ev.label_precision(a, labels, 2).orderBy("qid").collect()] == [(0, 0.5, 1), (1, 0.0, 0)]
    assert ev.random_label_precision(labels).first()[0] == pytest.approx(2 / 3 * 1 / 2)
    scores = spark.createDataFrame([(30, "a", 70.0), (30, "a", 66.0), (30, "b", 65.0), (50, "a", 40.0), (50, "b", 90.0)], "level int, bucket string, score double")
    assert tuple(ev.chosen_level(ev.quality_ladder(scores, floor_p10=60, floor_min=45)).first()) == (30, True)
    assert tuple(ev.chosen_level(ev.quality_ladder(scores, floor_p10=99, floor_min=45)).first()) == (30, False)


def test_media_tables(spark):
    frames = spark.range(10).withColumnRenamed("id", "position")
    seg = media.stream_segments(frames, 4).orderBy("segment")
    assert [tuple(r) for r in seg.collect()] == [(0, 0, 4), (1, 4, 4), (2, 8, 2)]
    items = spark.createDataFrame([(0, 5), (1, 9), (2, None)], "ordinal long, frame long")
    _, spans = media.blob_tables(items, seg.withColumn("uri", F.lit("s")))
    assert [tuple(r) for r in spans.orderBy("ordinal").collect()] == [(0, 1, 1, 2), (1, 2, 1, 2), (2, None, None, None)]
    files = spark.createDataFrame([(0, "a", 3), (1, "b", 4), (2, "a", 3)], "ordinal long, uri string, byte_len long")
    blobs, spans = media.blob_tables(files)
    assert blobs.count() == 2 and [r.blob_index for r in spans.orderBy("ordinal").collect()] == [0, 1, 0]
    sizes = spark.createDataFrame([(0, 400, 300), (1, 1001, 501), (2, 800, 600)], "ordinal long, width long, height long")
    assert media.canvas_size(sizes, 640) == (640, 480)
    with pytest.raises(NotIndexed):
        media.encode_media("av1", frames)
    images = spark.createDataFrame([("a.PNG", "", None, 400, 50.0, 0.2, True), ("b.jpg", "L", 0, 2000, 5000.0, 0.0, False)], "origin string, label string, page long, longest_side int, gradient_variance double, steep_share double, has_alpha boolean")
    assert [r[0] for r in images.select(media.image_text(page="page")).collect()] == ["a.PNG", "b.jpg page 1 [L]"]
    assert [r.stratum for r in media.quality_strata(images).collect()] == ["small/low/text/alpha/png", "large/high/plain/opaque/jpg"]
    probe = lambda q: spark.createDataFrame([("intra", 10, 80.0), ("inter", 7, q)], "arm string, bytes long, quality double")
    assert [media.keyframe_policy(probe(q)).first().decision for q in (79.0, 70.0, None)] == ["inter", "intra", "inter"]
    order = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "position long, ordinal long")
    assert {r.ordinal: r.position for r in media.inverse_permutation(order).collect()} == {2: 0, 0: 1, 1: 2}
    assert media.utility_threshold(0.5, 0.8, 0.1) == pytest.approx(0.7)
