"""From a specification or a table of texts to a corpus: load, chunk, embed what the cache lacks, write."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import create_embedder, embed_column, embed_images_column, embed_missing, model_hash
from ..functions.identity import canonical_json, chunk_id, corpus_input_hash
from ..functions.text import chunk_windows
from ..functions.vectors import truncate_renormalize
from ..operators.dedup import cluster_order, dense_index, frame_map, similarity_order
from ..operators.media import encode_media, image_text
from ..sources import loaders
from ..sources.spec import plain
from ..tables import materialize
from .corpus import Corpus, build_corpus, write_text
from .manifest import build_lock


def load_items(spark: SparkSession, spec: SimpleNamespace, sample: int | None = None) -> DataFrame:
    """The items of a specification's source; with `sample`, evenly spaced ones."""
    s = spec.source
    if s.kind == "image_dir":
        labels = loaders.read_labels(spark, s.labels) if s.labels else None
        images = loaders.read_images(spark, s.input_dir, labels)
        items = loaders.build_items(images.withColumn("_text", image_text()).withColumnRenamed("ordinal", "_n"), spec.name, order_by=["origin"], text_template="{_text}", label_template="{label}", image_hash="image_sha256", chunker_version=spec.chunker_version)
    else:
        if s.kind == "sql":
            raw = loaders.read_query(spark, s.query, s.tables)
        else:
            raw = {"csv": loaders.read_csv, "jsonl": loaders.read_jsonl, "parquet": lambda sp, p: sp.read.parquet(p)}[s.kind](spark, s.path)
        joins = [(spark.sql(j.query), j.on, j.order) for j in s.joins]
        items = loaders.build_items(raw, spec.name, order_by=s.order_by, text_template=s.text, label_template=s.label, derived=s.derive, joins=joins, chunker_version=spec.chunker_version, null_text=s.null_text)
    return loaders.even_sample(items, sample) if sample else items


def frame_vectors(items: DataFrame, images: DataFrame, embedder) -> tuple[DataFrame, DataFrame]:
    """(frames(frame, ordinal, key, embedding), frame_of_row(ordinal, frame)): every different image embedded once.

    items is (ordinal, key, image_sha256), images (origin, data) with origin = key. Items without an image have no frame.
    """
    frames, rows = frame_map(items.where("image_sha256 is not null and image_sha256 != ''"))
    shown = frames.join(items.select("ordinal", "key"), "ordinal").join(images.select(F.col("origin").alias("key"), "data"), "key")
    return materialize(shown.select("frame", "ordinal", "key", embed_images_column("data", embedder).alias("embedding")), "frames"), rows


def sliced(vectors: DataFrame, name: str, dims: list[int]) -> dict[str, DataFrame]:
    """Space payloads by name: the vectors whole, or one space for each dimension, its vectors cut and scaled again."""
    if not dims:
        return {name: vectors}
    return {f"{name}@{d}": vectors.select("ordinal", truncate_renormalize("embedding", d).cast("array<float>").alias("embedding")) for d in dims}


def chunk_items(items: DataFrame, *, max_chars: int = 0, overlap: int = 0) -> DataFrame:
    """(ordinal, canonical_text, source_uri, byte_start, byte_end): items whole, or cut into windows and numbered anew."""
    if not max_chars:
        return items.select("ordinal", "canonical_text", "source_uri", F.lit(0).cast("long").alias("byte_start"), F.octet_length("canonical_text").cast("long").alias("byte_end"))
    windows = chunk_windows(items.select(F.col("ordinal").alias("_item"), F.col("canonical_text").alias("_whole"), "source_uri"), "_whole", max_chars=max_chars, overlap=overlap)
    return dense_index(windows, ["_item", "chunk_no"], "ordinal").select("ordinal", "canonical_text", "source_uri", "byte_start", "byte_end")


def emit(chunks: DataFrame, path: str, embedder, *, chunker_version: str, cache: str | None = None, **settings) -> Corpus:
    """Embed chunks and write a corpus. `cache` is a Parquet folder of (chunk_id, model_hash, embedding): only what it lacks is embedded, and appended."""
    spark = chunks.sparkSession
    keyed = chunks.withColumn("chunk_id", chunk_id("canonical_text", "source_uri", "byte_start", "byte_end", chunker_version))
    known = read_cache(spark, cache)
    every, fresh = embed_missing(keyed, known, embedder)
    if cache:
        fresh.write.mode("append").parquet(f"{cache.rstrip('/')}/batch=-1")
        every = read_cache(spark, cache).where(F.col("model_hash") == model_hash(embedder)).dropDuplicates(["chunk_id"])
    rows = keyed.join(every.select("chunk_id", "embedding"), "chunk_id").drop("chunk_id")
    return build_corpus(rows, path, embedding_model=embedder.model, embedding_dim=embedder.dim, model_hash=model_hash(embedder), chunker_version=chunker_version, **settings)


def read_cache(spark: SparkSession, path: str | None, *, but: int | None = None) -> DataFrame:
    """Cached embeddings below a folder: those of batch jobs, in `batch=-1` or beside it, and of the batches of streams, one folder each; `but` leaves out one batch."""
    schema = "chunk_id string, model_hash string, embedding array<float>"
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            parts = [x.getPath().toString() for x in fs.listStatus(p) if x.isDirectory() and x.getPath().getName().startswith("batch=")]
            parts = [x for x in parts if but is None or not x.endswith(f"/batch={but}")]
            return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return spark.createDataFrame([], schema)


def _media(frames: DataFrame, rows: DataFrame, images: DataFrame, media: SimpleNamespace, inlined: bool) -> tuple[DataFrame, DataFrame]:
    """(blobs, spans) of the frames as the backend encodes them, in the order asked for; a span is the whole of an item's blob."""
    order = {"similarity": similarity_order, "cluster": lambda f: cluster_order(f, threshold=media.cluster_threshold)}.get(media.order)
    placed = frames.join(order(frames.select(F.col("frame").alias("ordinal"), "embedding")).withColumnRenamed("ordinal", "frame"), "frame") if order else frames.withColumn("position", F.col("frame"))
    shown = placed.join(images.select(F.col("origin").alias("key"), "data"), "key").select("position", "frame", F.col("key").alias("uri"), "data")
    files = materialize(encode_media(media.backend, shown, shard_size=media.shard_size), "media-files")
    blobs = files.select(F.col("position").alias("blob_index"), F.sha2("data", 256).alias("content_hash"), F.col("uri").alias("original_uri"), F.length("data").cast("long").alias("byte_len"), F.lit(inlined).alias("inlined"), *([F.col("data")] if inlined else [F.lit(None).cast("binary").alias("data")]))
    spans = rows.join(files.select("frame", F.col("position").alias("blob_index"), F.length("data").cast("long").alias("byte_end")), "frame").select("ordinal", "blob_index", F.lit(0).cast("long").alias("byte_start"), "byte_end")
    return blobs, spans


def build_from_spec(spark: SparkSession, spec: SimpleNamespace, *, cache: str | None = None, sample: int | None = None) -> dict[str, Corpus]:
    """Corpora by name: one, or one per model, as output.mode says. A lock is written beside each."""
    items = materialize(load_items(spark, spec, sample), "items")
    chunks = chunk_items(items, max_chars=spec.build.max_chars, overlap=spec.build.overlap)
    default = next(m for m in spec.models if m.text == "default")
    images = loaders.read_images(spark, spec.source.input_dir, with_data=True) if spec.source.kind == "image_dir" else None
    provenance = {"corpus": spec.name, "version": spec.version, "inputs": corpus_input_hash(items)}
    spaces, models, media = {}, {}, {}
    for m in spec.models:
        if m.image != "space" and m.text != "space":
            continue
        embedder, name = create_embedder(m.embedder, **m.settings), m.name or m.embedder
        made = {}
        if m.image == "space":
            frames, rows = frame_vectors(items, images, embedder)
            made |= sliced(rows.join(frames.select("frame", "embedding"), "frame").select("ordinal", "embedding"), name, m.dims)
            if spec.media.backend and (not media or name == spec.media.cluster_space):
                blobs, spans = _media(frames, rows, images, spec.media, spec.output.embed_media)
                media = {"blobs": blobs, "blob_spans": spans}
        if m.text == "space":
            text = materialize(chunks.select("ordinal", embed_column("canonical_text", embedder).alias("embedding")), "text-space")
            made |= sliced(text, f"{name}-text", m.dims)
        spaces |= made
        models |= dict.fromkeys(made, model_hash(embedder))
    out, b = {}, spec.build
    for m in [default] + ([m for m in spec.models if m is not default and m.text != "none"] if spec.output.mode in ("per-model", "both") else []):
        embedder = create_embedder(m.embedder, **m.settings)
        name = spec.name if m is default else f"{spec.name}-{m.name or m.embedder}"
        extra = {"spaces": spaces, "space_models": models} if m is default and spec.output.mode != "per-model" else {}
        out[name] = emit(chunks, f"{spec.output.dir}/{name}", embedder, chunker_version=spec.chunker_version, cache=cache, preset=b.preset, dtype=b.dtype, mrl_dim=b.mrl_dim, keep_full_precision=b.keep_full_precision, with_graph=b.with_graph, graph_top_m=b.graph_top_m, provenance=provenance, **extra, **media)
        write_text(spark, f"{spec.output.dir}/{name}.lock.json", canonical_json(build_lock(out[name].manifest, plain(spec))))
    return out
