"""A corpus: an immutable folder of Parquet tables with a manifest. Building, opening, checking and asking it."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CitationError, ManifestError, NotIndexed, ValidationError
from ..functions.identity import canonical_json, chunk_id, content_hash, table_digest
from ..functions.vectors import all_finite, decode_float16, dequantize_int4, dequantize_int8, encode_float16, quantize_int4, quantize_int8, truncate_renormalize
from ..operators.ann import Probes, ann_search, asked_cells, ivf_build, ivf_probes
from ..operators.graph import bounded_bfs, build_graph, check_graph
from ..operators.lexical import bm25_build, bm25_search, invalid_postings
from ..operators.media import blob_bytes, blob_totals, broken_blobs, span_overlay
from ..operators.search import check_query, exact_search, graph_search, hybrid_search, neighbor_context, rerank
from ..tables import materialize
from .manifest import PLACEHOLDER, Capabilities, Manifest, check_model
from .presets import PRESETS

SCHEME = "corpus://"
#: Named spaces of one corpus, at most.
MAX_SPACES = 15
#: Numbers of hits for which a build measures how many cells a query asks; for more, the queries of the call measure it.
PROBE_KS = (10, 100)


#: Columns of the chunk table, and how vectors of each type are stored.
CHUNK_COLUMNS = {"ordinal": "bigint", "chunk_id": "string", "canonical_text": "string", "source_uri": "string", "byte_start": "bigint", "byte_end": "bigint"}
SLAB_TYPES = {"float32": "array<float>", "float16": "binary", "int8": "struct<scale:float,codes:array<tinyint>>", "int4": "struct<scales:array<float>,codes:binary>"}


def bad_slab(vectors: DataFrame, dtype: str, dim: int) -> DataFrame:
    """Stored vectors, as they are stored, that are null, of another length, or have a number or a scale that is not finite; with `problem`."""
    v = F.col("embedding")
    if dtype in ("float32", "float16"):
        size, finite = (F.size(v), all_finite("embedding")) if dtype == "float32" else (F.length(v) / 2, all_finite(decode_float16("embedding")))
    elif dtype == "int8":
        scale = v["scale"]
        size, finite = F.size(v["codes"]), scale.isNotNull() & ~F.isnan(scale) & (F.abs(scale) != float("inf")) & ~F.exists(v["codes"], lambda c: c.isNull())
    else:
        size, finite = F.when(F.size(v["scales"]) * 64 == dim, F.length(v["codes"]) * 2), all_finite(v["scales"])
    problem = F.when(v.isNull(), "null").when(~(size.eqNullSafe(F.lit(dim))), "dimension").when(~F.coalesce(finite, F.lit(False)), "not finite")
    return vectors.withColumn("problem", problem).where("problem is not null")


def check_spaces(spaces: dict[str, dict], default_hash: str) -> None:
    """The table of named spaces: indexes 1..15 and names, each once; known types; model hashes."""
    indexes = [about.get("index") for about in spaces.values()]
    rules = [
        (all(isinstance(i, int) and 1 <= i <= MAX_SPACES for i in indexes), f"an index is outside 1..{MAX_SPACES}"),
        (len(set(indexes)) == len(indexes), "two spaces have the same index"),
        (all(re.fullmatch(r"[\w.@-]+", name) for name in spaces), "a name is empty or has other characters than letters, digits, dots, dashes, underscores and @"),
        (all(about.get("dtype") in SLAB_TYPES for about in spaces.values()), "an unknown type"),
        (all(re.fullmatch(r"sha256:[0-9a-f]{64}", about.get("model_hash", "")) for about in spaces.values()), "a model hash is not sha256: and 64 hex digits"),
        (all(isinstance(about.get("dim"), int) and about["dim"] > 0 for about in spaces.values()), "a dimension is not positive"),
    ]
    for ok, message in rules:
        if not ok:
            raise ValidationError(f"spaces: {message}")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)  # Spark's own readers skip files that start with an underscore
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def bad_chunks(rows: DataFrame, dim: int) -> DataFrame:
    """Rows that break a rule of the store, with `problem`."""
    problem = (
        F.when(F.col("canonical_text").isNull() | F.col("source_uri").isNull(), "null text or uri")
        .when(F.col("embedding").isNull() | (F.size("embedding") != dim), "dimension")
        .when(~all_finite("embedding"), "not finite")
        .when(F.col("byte_start").isNull() | F.col("byte_end").isNull() | (F.col("byte_start") < 0) | (F.col("byte_end") < F.col("byte_start")), "span")
    )
    return rows.withColumn("problem", problem).where("problem is not null")


def encoded(v: Column | str, dtype: str) -> Column:
    return {"float32": lambda c: F.col(c).cast("array<float>"), "float16": encode_float16, "int8": quantize_int8, "int4": quantize_int4}[dtype](v)


def decoded(v: Column | str, dtype: str) -> Column:
    return {"float32": F.col, "float16": decode_float16, "int8": dequantize_int8, "int4": dequantize_int4}[dtype](v)


def _index(spark: SparkSession, path: str, dtype: str) -> tuple[DataFrame, DataFrame]:
    cells = spark.read.parquet(f"{path}/ann_cells")
    return spark.read.parquet(f"{path}/ann_codebooks"), cells.select("cell", "ordinal", decoded("embedding", dtype).alias("embedding"))


def build_corpus(
    rows: DataFrame, path: str, *, embedding_model: str, embedding_dim: int, model_hash: str, chunker_version: str, preset: str = "hybrid", dtype: str = "",
    mrl_dim: int = 0, keep_full_precision: bool = False, with_graph: bool = False, graph_top_m: int = 8, spaces: dict[str, DataFrame] | None = None, space_models: dict[str, str] | None = None,
    blobs: DataFrame | None = None, blob_spans: DataFrame | None = None, provenance: dict | None = None, allow_placeholder: bool = False, partitions: int | None = None,
) -> "Corpus":
    """Write rows(ordinal, canonical_text, source_uri, byte_start, byte_end, embedding) as a corpus and open it.

    Everything goes to a temporary folder beside `path`, is read back and checked, and is renamed at the end, so a
    folder of that name is always whole. Ordinals must be 0..n-1. Rows are range-partitioned and sorted by ordinal, so
    that the tables' content doesn't depend on the input's partitions.
    """
    if preset not in PRESETS:
        raise ManifestError(f"unknown preset {preset!r}")
    if model_hash == PLACEHOLDER and not allow_placeholder:
        raise ManifestError("a placeholder model hash cannot be written")
    spark, p = rows.sparkSession, PRESETS[preset]
    dtype = dtype or p.dtype
    bad = bad_chunks(rows, embedding_dim).select("ordinal", "problem").limit(1).collect()
    if bad:
        raise ValidationError(f"chunk {bad[0][0]}: {bad[0][1]}")
    n, least, most, distinct = rows.agg(F.count("*"), F.min("ordinal"), F.max("ordinal"), F.countDistinct("ordinal")).first()
    if not n or (least, most, distinct) != (0, n - 1, n):
        raise ValidationError("ordinals must be 0..n-1 and there must be rows")
    temporary = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex[:8]}"

    def put(df: DataFrame, table: str) -> None:
        df.write.option("compression", p.codec).parquet(f"{temporary}/{table}")

    ordered = (rows.repartitionByRange(partitions, "ordinal") if partitions else rows.repartitionByRange("ordinal")).sortWithinPartitions("ordinal")
    if mrl_dim:
        if mrl_dim > embedding_dim:
            raise ManifestError("mrl_dim is larger than the dimension")
        ordered = ordered.withColumn("embedding", truncate_renormalize("embedding", mrl_dim))
    dim = mrl_dim or embedding_dim
    put(ordered.select("ordinal", chunk_id("canonical_text", "source_uri", "byte_start", "byte_end", chunker_version).alias("chunk_id"), "canonical_text", "source_uri", "byte_start", "byte_end"), "chunks")
    stored = ordered.select("ordinal", F.col("embedding").cast("array<float>").alias("embedding"))
    full = [F.col("embedding").alias("embedding_fp")] if keep_full_precision and dtype != "float32" else []
    put(stored.select("ordinal", encoded("embedding", dtype).alias("embedding"), *full), "vectors")
    m = Manifest(embedding_model, dim, model_hash, chunker_version, n, dtype=dtype, full_precision=bool(full), capabilities=Capabilities(ann=p.ann, bm25=p.bm25, graph=with_graph, blobs=blobs is not None, spaces=bool(spaces)), provenance=provenance or {})
    if mrl_dim:
        m = replace(m, mrl_dim=mrl_dim, full_dim=embedding_dim)
    if p.bm25 or p.ann:
        m = replace(m, index_type="hybrid" if p.bm25 else "hnsw", rerank_policy="exact")
    chunks = spark.read.parquet(f"{temporary}/chunks")
    vectors = spark.read.parquet(f"{temporary}/vectors").select("ordinal", decoded("embedding", dtype).alias("embedding"))
    everyone = vectors.select(F.col("ordinal").alias("qid"), F.col("embedding").alias("query"))
    index = None
    if p.ann:
        codes, cells = ivf_build(vectors)
        put(codes, "ann_codebooks")
        put(cells.select("cell", "ordinal", encoded("embedding", dtype).alias("embedding")).repartitionByRange("cell").sortWithinPartitions("cell", "ordinal"), "ann_cells")
        index = _index(spark, temporary, dtype)
        measured = [(k, *vars(ivf_probes(vectors, index, everyone, k, own=True)).values()) for k in PROBE_KS]
        put(spark.createDataFrame(measured, "k int, cells int, width int"), "ann_probes")
    if p.bm25:
        for name, t in bm25_build(chunks).items():
            put(t, f"bm25_{name}")
    if with_graph:
        neighbors = None
        if graph_top_m:  # all rows ask, so cells keep the work in proportion to the rows; presets without an index use one for this only
            index = index or tuple(materialize(t, "graph-cells") for t in ivf_build(vectors))
            neighbors = ann_search(vectors, index, everyone, graph_top_m + 1, probes=ivf_probes(vectors, index, everyone, graph_top_m, own=True))
        put(build_graph(chunks.select("ordinal"), neighbors, top_m=graph_top_m), "edges")
    for name, df in (spaces or {}).items():
        put(df.select("ordinal", F.col("embedding").cast("array<float>").alias("embedding")), f"space_vectors/space={name}")
    if blobs is not None:
        put(blobs, "blobs")
        if blob_spans is not None:
            put(blob_spans, "blob_spans")
    names = ["chunks", "vectors"] + ["ann_codebooks", "ann_cells", "ann_probes"] * p.ann + [f"bm25_{t}" for t in ("postings", "terms", "doc_stats", "corpus")] * p.bm25 + ["edges"] * with_graph
    tables = {t: table_digest(spark.read.parquet(f"{temporary}/{t}")) for t in ("chunks", "vectors")}
    exact = spark.read.parquet(f"{temporary}/vectors")
    content = exact.select("ordinal", F.col("embedding_fp").alias("embedding")) if full else vectors
    m = replace(m, tables=tables | {t: "" for t in names if t not in tables}, content_hash=content_hash(chunks, content, m.contract(), m.provenance))
    m = replace(m, file_hash="sha256:" + hashlib.sha256(json.dumps(sorted(m.tables.items())).encode()).hexdigest())
    m.extra["spaces"] = {s: {"index": i, "dim": d.select(F.size("embedding")).first()[0], "dtype": "float32", "n_vectors": n, "model_hash": (space_models or {}).get(s, model_hash)} for i, (s, d) in enumerate((spaces or {}).items(), 1)}
    m.validate()
    write_text(spark, f"{temporary}/_contract.json", canonical_json(m.search_contract()))
    write_text(spark, f"{temporary}/_manifest.json", m.to_json())
    Corpus.open(spark, temporary).validate()
    fs, old = _fs(spark, temporary)
    target = _fs(spark, path)[1]
    if fs.exists(target):
        fs.delete(old, True)
        raise ManifestError(f"{path} exists; a corpus is never overwritten")
    if not fs.rename(old, target):
        raise ManifestError(f"{path}: the finished corpus could not be renamed")
    return Corpus.open(spark, path)


class Corpus:
    """An open corpus; tables are lazy DataFrames, asking for what isn't there is a typed error."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Corpus":
        m = Manifest.from_json(read_text(spark, f"{path.rstrip('/')}/_manifest.json"))
        m.validate()
        out = cls(spark, path, m)
        out.check_contract()
        return out

    def check_contract(self) -> None:
        """The contract beside the manifest, as it was written, must say what the manifest says; and the tables must have their columns."""
        written, now = json.loads(read_text(self.spark, f"{self.path}/_contract.json")), self.manifest.search_contract()
        for key in sorted(set(written) | set(now)):
            if written.get(key) != now.get(key):
                raise ManifestError(f"contract: {key} is {written.get(key)!r}, the manifest says {now.get(key)!r}")
        for table, want in (("chunks", CHUNK_COLUMNS), ("vectors", {"ordinal": "bigint", "embedding": SLAB_TYPES[self.manifest.dtype]})):
            have = dict(self._table(table).dtypes)
            wrong = [c for c, kind in want.items() if have.get(c) != kind]
            if wrong:
                raise ValidationError(f"table {table}: {wrong[0]} must be {want[wrong[0]]}, not {have.get(wrong[0])}")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def raw_chunks(self) -> DataFrame:
        return self._table("chunks")

    @property
    def chunks(self) -> DataFrame:
        """With blob spans laid over the original ones."""
        if self.manifest.capabilities.blobs and self._has("blob_spans"):
            return span_overlay(self.raw_chunks, self._table("blob_spans"), self.blobs)
        return self.raw_chunks

    def _has(self, name: str) -> bool:
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        return fs.exists(p)

    @cached_property
    def vectors(self) -> DataFrame:
        """Decoded vectors; the full-precision ones where they are stored beside a smaller type."""
        t = self._table("vectors")
        v = F.col("embedding_fp") if self.manifest.full_precision else decoded("embedding", self.manifest.dtype)
        return t.select("ordinal", v.alias("embedding"))

    @property
    def rerank_source(self) -> str:
        return "full_precision" if self.manifest.full_precision else "stored_precision"

    @property
    def edges(self) -> DataFrame:
        if not self.manifest.capabilities.graph:
            raise NotIndexed("this corpus has no graph")
        return self._table("edges")

    @property
    def blobs(self) -> DataFrame:
        if not self.manifest.capabilities.blobs:
            raise NotIndexed("this corpus has no blobs")
        return self._table("blobs")

    def blob(self, index: int) -> bytes:
        return blob_bytes(self.blobs, index)

    @property
    def bm25(self) -> dict[str, DataFrame] | None:
        return {t: self._table(f"bm25_{t}") for t in ("postings", "terms", "doc_stats", "corpus")} if self.manifest.capabilities.bm25 else None

    @cached_property
    def ann(self) -> tuple[DataFrame, DataFrame] | None:
        return _index(self.spark, self.path, self.manifest.dtype) if self.manifest.capabilities.ann else None

    @cached_property
    def _measured(self) -> dict[int, Probes]:
        return {r.k: Probes(r.cells, r.width) for r in self._table("ann_probes").collect()}

    def _probes(self, queries: DataFrame, k: int) -> Probes:
        """What the build measured for at least k hits, else what these queries need."""
        enough = [k_ for k_ in sorted(self._measured) if k_ >= k]
        return self._measured[enough[0]] if enough else ivf_probes(self.vectors, self.ann, queries, k)

    @property
    def space_names(self) -> list[str]:
        return sorted(self.manifest.extra.get("spaces", {}))

    def space(self, name: str) -> DataFrame:
        """Vectors of one named space: only its folder is read."""
        if name not in self.space_names:
            raise NotIndexed(f"unknown space {name!r}; known: {self.space_names}")
        return self._table(f"space_vectors/space={name}")

    def chunk_ids(self) -> DataFrame:
        return self.raw_chunks.select("ordinal", "chunk_id").orderBy("ordinal")

    # searches: queries is (qid, query[, text])

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return exact_search(self.vectors, queries, k)

    def search_ann(self, queries: DataFrame, k: int, ef: int = 100) -> DataFrame:
        """Hits of the asked cells, scored again on the vectors that `vectors` gives where the index holds rounded ones."""
        if not self.ann:
            return self.search(queries, k)
        if not self.manifest.full_precision:
            return ann_search(self.vectors, self.ann, queries, k, ef=ef, probes=self._probes(queries, k))
        found = ann_search(self.vectors, self.ann, queries, max(k, ef), ef=ef, probes=self._probes(queries, max(k, ef)))
        return rerank(self.vectors, queries, found, k)

    def search_graph(self, queries: DataFrame, k: int, *, hops: int = 1, ef: int = 100) -> DataFrame:
        if not self.manifest.capabilities.graph:
            return self.search(queries, k)
        return graph_search(self.vectors, self.edges, queries, k, hops=hops, ef=ef)

    def search_hybrid(self, queries: DataFrame, k: int, candidates: int = 64) -> DataFrame:
        ann = (lambda q, width: ann_search(self.vectors, self.ann, q, width, ef=width, probes=self._probes(q, width))) if self.ann else None
        return hybrid_search(self.vectors, queries, queries.select("qid", "text"), self.bm25, k, candidates=candidates, ann=ann)

    def search_space(self, name: str, queries: DataFrame, k: int, *, model_hash: str | None = None) -> DataFrame:
        want = self.manifest.extra.get("spaces", {}).get(name, {}).get("model_hash")
        vectors = self.space(name)
        if model_hash is not None and model_hash != want:
            from ..errors import ModelMismatch

            raise ModelMismatch(f"space {name}: the query's model hash is {model_hash}, the space's {want}")
        return exact_search(vectors, queries, k)

    def route(self, has_text: bool) -> str:
        """By what the corpus can do: hybrid with a text, else cells, else exact. The graph is never chosen by itself."""
        c = self.manifest.capabilities
        return "hybrid" if c.bm25 and has_text else "hnsw" if c.ann else "exact"

    def search_routed(self, queries: DataFrame, k: int, candidates: int = 64) -> DataFrame:
        """Queries with a text that isn't blank may take another route than those without."""
        if "text" not in queries.columns:
            return self._run(self.route(False), queries, k, candidates)
        with_text = F.coalesce(F.trim(F.regexp_replace("text", r"\s", " ")) != "", F.lit(False))
        routes = (self.route(True), self.route(False))
        if routes[0] == routes[1]:
            return self._run(routes[0], queries, k, candidates)
        return self._run(routes[0], queries.where(with_text), k, candidates).unionByName(self._run(routes[1], queries.where(~with_text), k, candidates))

    def search_by(self, mode: str, queries: DataFrame, k: int, **settings) -> DataFrame:
        """Hits with texts in a named mode: exact, ann, graph, hybrid, routed or space (which needs name)."""
        verbs = {"exact": self.search, "ann": self.search_ann, "graph": self.search_graph, "hybrid": self.search_hybrid, "routed": self.search_routed}
        if mode == "space":
            return self.hits(self.search_space(settings.pop("name"), queries, k, **settings), "space", text=True)
        if mode not in verbs:
            raise NotIndexed(f"unknown mode {mode!r}; known: {sorted([*verbs, 'space'])}")
        route = self.route("text" in queries.columns) if mode == "routed" else {"ann": "hnsw"}.get(mode, mode)
        return self.hits(verbs[mode](queries, k, **settings), route, text=True)

    def _run(self, route: str, queries: DataFrame, k: int, candidates: int) -> DataFrame:
        found = self.search_hybrid(queries, k, candidates) if route == "hybrid" else self.search_ann(queries, k, candidates) if route == "hnsw" else self.search(queries, k)
        return found.withColumn("route", F.lit(route))

    def hits(self, found: DataFrame, route: str, *, text: bool = False) -> DataFrame:
        """Citable rows of (qid, rank, ordinal, score). A column `route` of found says how each query went; else all went by `route`."""
        m = self.manifest
        cite = F.concat(F.lit(f"{SCHEME}{m.content_hash}/"), F.col("chunk_id"))
        c = self.chunks.select("ordinal", "chunk_id", "source_uri", F.col("byte_start").alias("offset_start"), F.col("byte_end").alias("offset_end"), *["canonical_text"] * text)
        by = F.col("route") if "route" in found.columns else F.lit(route)
        j = found.withColumn("index_type", by).join(c, "ordinal").select("index_type", "qid", "rank", "ordinal", "chunk_id", F.col("score").cast("float").alias("score"), F.lit("cosine").alias("score_type"), "source_uri", "offset_start", "offset_end", *([F.col("canonical_text").alias("text")] if text else []))
        return j.withColumns({"embedding_model": F.lit(m.embedding_model), "index_type": F.col("index_type"), "reranked": ~F.col("index_type").isin("exact", "space"), "file_hash": F.lit(m.file_hash), "content_hash": F.lit(m.content_hash), "citation_id": cite, "rerank_source": F.lit(self.rerank_source)})

    def retrieve(self, queries: DataFrame, k: int, *, candidates: int | None = None, ef: int = 100, expected_model_hash: str | None = None) -> DataFrame:
        """Routed search with the texts: at least max(ef, candidates or max(4k, 64)) candidates."""
        if expected_model_hash is not None:
            check_model(self.manifest, expected_model_hash)
        width = max(ef, candidates or max(4 * k, 64))
        return self.hits(self.search_routed(queries, k, width), self.route("text" in queries.columns), text=True)

    def search_vector(self, vector: list[float], k: int) -> DataFrame:
        """One literal query, checked first."""
        v = check_query(vector, k, self.manifest.embedding_dim)
        return self.hits(self.search(self.spark.createDataFrame([(0, v)], "qid long, query array<double>"), k), "exact")

    def ask(self, text: str, embedder, k: int = 5) -> DataFrame:
        """Embed a text, check the model, and retrieve cited passages."""
        from ..functions.embed import model_hash

        check_model(self.manifest, model_hash(embedder), dim=embedder.dim if not self.manifest.mrl_dim else None)
        v = [float(x) for x in embedder.embed([text])[0]][: self.manifest.embedding_dim]
        return self.retrieve(self.spark.createDataFrame([(0, v, text)], "qid long, query array<double>, text string"), k)

    def explain(self, queries: DataFrame, k: int, route: str = "routed", *, candidates: int = 64, hops: int = 1, ef: int = 100) -> DataFrame:
        """(qid, route, exact_candidates, ann_candidates, bm25_candidates, graph_candidates, fusion_mode, rerank_source, recall_estimate), a row a query.

        Counts are those of the candidates that this query has: all vectors on the exact route, vectors of the asked cells, lexical
        hits, or nodes of the walk. Recall is 1 where all are scored, and NaN elsewhere: it is never claimed without being known.
        """
        n = self.manifest.n_chunks
        if route == "routed":
            with_text = F.coalesce(F.trim(F.regexp_replace("text", r"\s", " ")) != "", F.lit(False)) if "text" in queries.columns else F.lit(False)
            parts = [self.explain(queries.where(x), k, self.route(has), candidates=candidates, hops=hops, ef=ef) for x, has in ((with_text, True), (~with_text, False))]
            return parts[0].unionByName(parts[1])
        q, none = queries.select("qid"), F.lit(0).cast("long")
        counts = {"exact": none, "ann": none, "bm25": none, "graph": none}
        if route in ("exact", "space") or route == "hybrid" and not self.ann:
            counts["exact"] = F.lit(n).cast("long")
        if route == "graph":
            seeds = exact_search(self.vectors, queries, max(ef, k))
            walk = bounded_bfs(self.edges, seeds.select("qid", F.col("ordinal").alias("node"), F.col("rank").alias("arrival")), hops=hops, max_frontier=8 * max(ef, k))
            q = q.join(walk.groupBy("qid").agg(F.count("*").alias("_g")), "qid", "left")
            counts |= {"exact": F.lit(min(max(ef, k), n)).cast("long"), "graph": F.coalesce("_g", none)}
        if route == "hnsw" or route == "hybrid" and self.ann:
            width = max(candidates, k)
            asked = asked_cells(self.ann, queries, k if route == "hnsw" else width, ef=ef if route == "hnsw" else width, probes=self._probes(queries, k if route == "hnsw" else width))
            sizes = self.ann[1].groupBy("cell").agg(F.count("*").alias("_m"))
            q = q.join(asked.join(sizes, "cell").groupBy(F.col("id").alias("qid")).agg(F.sum("_m").alias("_a")), "qid", "left")
            counts["ann"] = F.least(F.coalesce("_a", none), F.lit(width).cast("long")) if route == "hybrid" else F.coalesce("_a", none)
        if route == "hybrid" and self.bm25:
            found = bm25_search(self.bm25, queries.select("qid", "text"), candidates).groupBy("qid").agg(F.count("*").alias("_b"))
            q = q.join(found, "qid", "left")
            counts["bm25"] = F.coalesce("_b", none)
        known = route in ("exact", "space")
        return q.select("qid", F.lit("exact" if known else route).alias("route"), *(c.alias(f"{name}_candidates") for name, c in counts.items()), F.lit("rrf" if route == "hybrid" else "none").alias("fusion_mode"), F.lit(self.rerank_source).alias("rerank_source"), F.lit(1.0 if known else float("nan")).cast("float").alias("recall_estimate"))

    def search_images(self, space: str, embedder, k: int, *, texts: list[str] = (), images: list[bytes] = (), check: bool = True) -> DataFrame:
        """Hits in a space of images for texts, then images, as qid counts them; the embedder must be the space's model unless `check` is off."""
        from ..functions.embed import model_hash

        vectors = [*embedder.embed(list(texts)), *(embedder.embed_images(list(images)) if images else [])]
        dim = self.manifest.extra.get("spaces", {}).get(space, {}).get("dim")
        q = self.spark.createDataFrame([(i, [float(x) for x in v[:dim]]) for i, v in enumerate(vectors)], "qid long, query array<double>")
        return self.hits(self.search_space(space, q, k, model_hash=model_hash(embedder) if check else None), "space", text=True)

    def cite(self, citation: str) -> dict:
        """The passage of a citation; it must name this content."""
        head, _, rest = citation.removeprefix(SCHEME).partition("/")
        wanted = rest.split("/")[0]
        head = "sha256:" + head.removeprefix("sha256:")
        if head != self.manifest.content_hash:
            raise CitationError(f"the citation names content {head}, this corpus is {self.manifest.content_hash}")
        row = self.chunks.where(F.col("chunk_id") == wanted).first()
        if row is None:
            raise CitationError(f"chunk {wanted} is not in this corpus")
        return row.asDict() | {"citation_id": citation, "content_hash": head, "file_hash": self.manifest.file_hash}

    def context(self, radius: int = 1, joiner: str = " ") -> DataFrame:
        return neighbor_context(self.raw_chunks, radius, joiner)

    def browse(self, offset: int, limit: int) -> DataFrame:
        return self.chunks.where((F.col("ordinal") >= offset) & (F.col("ordinal") < offset + limit)).orderBy("ordinal")

    def inspect(self) -> dict:
        """The manifest and the size of each table."""
        sizes = {t: self._table(t).count() for t in self.manifest.tables}
        out = json.loads(self.manifest.to_json()) | {"rows": sizes}
        if self.manifest.capabilities.blobs:
            out["blob_totals"] = blob_totals(self.blobs).first().asDict()
        return out

    def validate(self) -> None:
        """Check the tables against each other and the manifest; the first problem is raised."""
        m = self.manifest
        for t in ("chunks", "vectors"):
            if table_digest(self._table(t)) != m.tables[t]:
                raise ValidationError(f"table {t} is not the one that was built")
        self.check_contract()
        slab = bad_slab(self._table("vectors"), m.dtype, m.embedding_dim).select("ordinal", "problem").limit(1).collect()
        if slab:
            raise ValidationError(f"vector {slab[0][0]}: {slab[0][1]}")
        check_spaces(m.extra.get("spaces", {}), m.model_hash)
        rows = self.raw_chunks.join(self._table("vectors").select("ordinal", decoded("embedding", m.dtype).alias("embedding")), "ordinal", "left")
        bad = bad_chunks(rows, m.embedding_dim).select("ordinal", "problem").limit(1).collect()
        if bad:
            raise ValidationError(f"chunk {bad[0][0]}: {bad[0][1]}")
        if rows.count() != m.n_chunks:
            raise ValidationError("the number of chunks is not the manifest's")
        if m.capabilities.bm25:
            problem = invalid_postings(self.bm25).limit(1).collect()
            if problem:
                raise ValidationError(f"lexical index: {problem[0][0]}")
        if m.capabilities.graph:
            check_graph(self.edges, m.n_chunks)
        if m.capabilities.blobs and broken_blobs(self.blobs).limit(1).count():
            raise ValidationError("a blob doesn't have its recorded hash")
        for s, about in m.extra.get("spaces", {}).items():
            n, ids, low, high = self.space(s).agg(F.count("*"), F.countDistinct("ordinal"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
            if low != about["dim"] or high != about["dim"] or n != ids or n > m.n_chunks:
                raise ValidationError(f"space {s}: it needs one vector of {about['dim']} dimensions per chunk, at most")
            if self.space(s).where(~all_finite("embedding")).limit(1).count():
                raise ValidationError(f"space {s}: a vector is not finite")
            if self.space(s).join(self.raw_chunks, "ordinal", "left_anti").limit(1).count():
                raise ValidationError(f"space {s}: a vector of an unknown chunk")



def doctor(spark: SparkSession) -> dict:
    """Versions and settings that matter to this package."""
    import pyarrow

    ok = int(spark.version.split(".")[0]) >= 4
    return {"ok": ok, "spark": spark.version, "arrow": pyarrow.__version__, "adaptive": spark.conf.get("spark.sql.adaptive.enabled"), "time_zone": spark.conf.get("spark.sql.session.timeZone")}
