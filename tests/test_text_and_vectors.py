"""Expressions against plain Python: chunks, tokens, templates, identity, quantisation."""

import hashlib
import struct

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.errors import SpecError
from corvane.functions.embed import FakeEmbedder, LexicalEmbedder, create_embedder, embed_column, embed_missing, model_hash
from corvane.functions.identity import CHUNK_DOMAIN, canonical_json, chunk_id, corpus_input_hash, item_input_hash, table_digest
from corvane.functions.sql import register_functions
from corvane.functions.text import chunk_windows, derive, lexical_tokens, media_uri, template
from corvane.functions.vectors import cosine, decode_float16, dequantize_int4, dequantize_int8, encode_float16, quantize_int4, quantize_int8, truncate_renormalize

TEXTS = ["", "short", "x" * 25, "acentuação e 😀 emoji, çok güzel " * 3, "日本語のテキスト" * 5]


def windows_model(text, size, overlap):
    out, start = [], 0
    while text:
        piece = text[start : start + size]
        a = len(text[:start].encode())
        out.append((piece, a, a + len(piece.encode())))
        if start + size >= len(text):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (7, 6), (512, 0), (25, 5)])
def test_chunk_windows(spark, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "id long, text string")
    got = chunk_windows(df, "text", max_chars=size, overlap=overlap).orderBy("id", "chunk_no").collect()
    for i, t in enumerate(TEXTS):
        assert [(r.canonical_text, r.byte_start, r.byte_end) for r in got if r.id == i] == windows_model(t, size, overlap)
    assert not [r for r in got if r.id == len(TEXTS)]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunk_windows(df, "text", max_chars=bad[0], overlap=bad[1])


def test_table_functions_agree_with_expressions(spark):
    register_functions(spark)
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string").createOrReplaceTempView("tt")
    got = spark.sql("select id, c.* from tt, lateral chunk_text(text, 10, 3) c").collect()
    for i, t in enumerate(TEXTS):
        assert [(r.chunk_text, r.byte_start, r.byte_end) for r in got if r.id == i] == windows_model(t, 10, 3)
    assert spark.sql("select vector_cosine(array(1D, 0D), array(1D, 1D)) c").first().c == pytest.approx(0.5**0.5)
    assert [r.token for r in spark.sql("select t.* from tokenize_text('Olá, a BC d2!') t").collect()] == ["olá", "bc", "d2"]


def test_tokens_keep_accents_and_drop_single_characters(spark):
    df = spark.createDataFrame([("Água é a VIDA_x1 ½½ naïve",)], "t string")
    assert df.select(lexical_tokens("t")).first()[0] == ["água", "vida", "x1", "½½", "naïve"]


def test_template_rules(spark):
    df = spark.createDataFrame([("Nome", "", None, True), ("", "x", "y", False)], "name string, kind string, note string, flag boolean")
    got = [r[0] for r in df.select(template(df, "{name} ({kind})\nkind: {kind}\n{note} — \n[{kind}, ] {name}  {flag}\n{missing}")).collect()]
    assert got == ["Nome\nNone\nNome True", "(x)\nkind: x\ny\n[x] False"]
    blank = df.select(template(df, "{note}", null_text="")).collect()
    assert [r[0] for r in blank] == ["", "y"]


def test_derived_columns(spark):
    df = spark.createDataFrame([("http://h/a/B.tar.gz?x=/q.r",), ("dir/",), (None,)], "u string")
    assert [r.s for r in derive(df, "s", "basename_stem(u)").collect()] == ["B.tar", "dir", ""]
    assert [r.s for r in derive(df, "s", "lower(nothing)").collect()] == [""] * 3
    for bad in ("upper(u)", "lower u", "lower(u"):
        with pytest.raises(SpecError):
            derive(df, "s", bad)


def test_media_uri(spark):
    df = spark.createDataFrame([("media://a/b.mp4#frame=12",), ("media://a.avif",), ("http://x",), ("media://a#t=1",)], "u string")
    assert [(r[0] and tuple(r[0])) for r in df.select(media_uri("u")).collect()] == [("a/b.mp4", 12), ("a.avif", None), None, None]


def chunk_id_model(text, uri, a, b, version):
    lp = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    return "sha256:" + hashlib.sha256(CHUNK_DOMAIN.encode() + lp(text) + lp(uri) + struct.pack("<QQ", a, b) + lp(version)).hexdigest()


def test_chunk_id_bytes(spark):
    rows = [("olá 😀", "item://x", 0, 300), ("", "", 2**40, 2**40 + 1)]
    df = spark.createDataFrame(rows, "t string, u string, a long, b long")
    assert [r[0] for r in df.select(chunk_id("t", "u", "a", "b", "v1")).collect()] == [chunk_id_model(*r, "v1") for r in rows]


def test_item_and_corpus_hash(spark):
    df = spark.createDataFrame([(0, "a", "ff", None), (1, "b", None, "L")], "ordinal long, t string, i string, l string")
    hashed = df.withColumn("item_input_hash", item_input_hash("t", "i", "l", "c"))
    got = [r.item_input_hash for r in hashed.orderBy("ordinal").collect()]
    model = lambda t, i, lab: "sha256:" + hashlib.sha256(b"text:" + hashlib.sha256(t.encode()).digest() + b"image:" + (i or "none").encode() + b"label:" + (lab or "").encode() + b"chunker:c").hexdigest()
    assert got == [model("a", "ff", None), model("b", None, "L")]
    assert corpus_input_hash(hashed.repartition(3)) == "sha256:" + hashlib.sha256("".join(got).encode()).hexdigest()


def test_table_digest_ignores_order_only(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x long, y string")
    assert table_digest(df) == table_digest(df.orderBy(F.desc("x")).repartition(3).select("y", "x"))
    assert table_digest(df) != table_digest(df.distinct()) and table_digest(df) != table_digest(df.fillna(""))
    assert canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


VECTOR = st.lists(st.floats(-10, 10, width=32), min_size=64, max_size=64)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(VECTOR, min_size=1, max_size=5))
def test_quantisers_against_models(spark, rows):
    rows = [*rows, [0.0] * 64]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, v array<float>")
    out = df.select("i", "v", quantize_int8("v").alias("a"), quantize_int4("v").alias("b"), decode_float16(encode_float16("v")).alias("h")).select("*", dequantize_int8("a").alias("x8"), dequantize_int4("b").alias("x4")).orderBy("i").collect()
    for r in out:
        v = np.array(r.v, np.float32)
        top = np.abs(v).max()
        scale = np.float32(top / np.float32(127)) if top > 0 else np.float32(1)
        q = v / scale
        codes = np.clip(np.trunc(q + np.copysign(np.float32(0.5), q)), -127, 127)
        assert r.a.scale == scale and np.abs(np.array(r.a.codes) - codes).max() <= 1  # one code where a quotient is a half in single precision
        assert np.abs(np.array(r.x8) - v).max() <= scale * 0.51 + 1e-6
        assert np.array(r.h, np.float32).tolist() == v.astype(np.float16).astype(np.float32).tolist()
        assert len(r.b.codes) == 32 and np.abs(np.array(r.x4) - v).max() <= max(r.b.scales[0] * 0.52, 1e-3) + top * 2e-3


def test_prefix_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0, 9.0],), ([0.0, 0.0, 1.0],)], "v array<double>")
    assert [r[0] for r in df.select(truncate_renormalize("v", 2)).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(cosine("v", "v")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        truncate_renormalize("v", 0)


def test_lexical_embedder_is_stable_and_cached(spark):
    e = LexicalEmbedder(32)
    a, b, empty = e.embed(["Vacina covid", "covid VACINA!", ""])
    assert np.allclose(a, b) and np.linalg.norm(empty) == pytest.approx(1, abs=1e-6)
    df = spark.createDataFrame([("c1", "Vacina covid"), ("c1", "Vacina covid"), ("c2", None)], "chunk_id string, canonical_text string")
    assert np.allclose(df.select(embed_column("canonical_text", e)).first()[0], a)
    none = spark.createDataFrame([], "chunk_id string, model_hash string, embedding array<float>")
    every, fresh = embed_missing(df, none, e)
    assert every.count() == fresh.count() == 2
    again, missed = embed_missing(df, spark.createDataFrame(every.collect(), none.schema), e)
    assert again.count() == 2 and missed.count() == 0
    assert model_hash(e) != model_hash(LexicalEmbedder(64)) and create_embedder("fake", dim=4).dim == 4 and len(FakeEmbedder(4).embed(["x"])[0]) == 4
    with pytest.raises(ValueError):
        create_embedder("nothing")
