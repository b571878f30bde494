"""Tables of media: blobs and the spans that point into them, streams cut into segments, and their checks.

Encoding and decoding media needs external programs and is left to plug-ins; what they do to tables is here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotIndexed, ValidationError


def span_overlay(chunks: DataFrame, spans: DataFrame, blobs: DataFrame) -> DataFrame:
    """chunks with source_uri, byte_start and byte_end taken from the blob span where an ordinal has one with a blob.

    spans is (ordinal, blob_index, byte_start, byte_end), a null blob_index meaning none; a blob_index without a blob is an error.
    """
    lost = spans.where("blob_index is not null").join(blobs, "blob_index", "left_anti").limit(1).collect()
    if lost:
        raise ValidationError(f"span of ordinal {lost[0]['ordinal']} points to blob {lost[0]['blob_index']}, which doesn't exist")
    over = spans.where("blob_index is not null").join(blobs.select("blob_index", "original_uri"), "blob_index").select("ordinal", F.col("original_uri").alias("_u"), F.col("byte_start").alias("_s"), F.col("byte_end").alias("_e"))
    j = chunks.join(over, "ordinal", "left")
    return j.withColumns({"source_uri": F.coalesce("_u", "source_uri"), "byte_start": F.coalesce("_s", "byte_start"), "byte_end": F.coalesce("_e", "byte_end")}).drop("_u", "_s", "_e")


def broken_blobs(blobs: DataFrame) -> DataFrame:
    """Inlined blobs whose bytes don't have the recorded SHA-256."""
    return blobs.where(F.col("inlined") & (F.col("data").isNull() | (F.sha2("data", 256) != F.lower(F.regexp_replace("content_hash", "^sha256:", "")))))


def blob_totals(blobs: DataFrame) -> DataFrame:
    """(blobs, inlined, sidecar, bytes)."""
    return blobs.agg(F.count("*").alias("blobs"), F.coalesce(F.sum(F.col("inlined").cast("long")), F.lit(0)).alias("inlined"), F.coalesce(F.sum((~F.col("inlined")).cast("long")), F.lit(0)).alias("sidecar"), F.coalesce(F.sum("byte_len"), F.lit(0)).alias("bytes"))


def blob_bytes(blobs: DataFrame, index: int) -> bytes:
    """The stored bytes of one blob; the filter reaches the scan."""
    row = blobs.where(F.col("blob_index") == index).select("inlined", "data").first()
    if row is None:
        raise NotIndexed(f"there is no blob {index}")
    if not row.inlined or row.data is None:
        raise NotIndexed(f"the bytes of blob {index} are not stored here")
    return bytes(row.data)


def blob_by_uri(blobs: DataFrame, uri: str) -> bytes:
    """The stored bytes of the blob of a URI, the first one where several share it; a #frame fragment is ignored."""
    row = blobs.where(F.col("original_uri") == uri.split("#")[0]).agg(F.min("blob_index")).first()
    if row[0] is None:
        raise NotIndexed(f"there is no blob {uri}")
    return blob_bytes(blobs, row[0])


def export_blobs(blobs: DataFrame, folder: str) -> int:
    """Write inlined blobs to a folder of any file system, under safe names, after proving their hashes. Returns how many. An export is for a selection: blobs are written one by one."""
    bad = broken_blobs(blobs).limit(1).collect()
    if bad:
        raise ValidationError(f"blob {bad[0]['blob_index']} doesn't have its recorded hash; nothing was written")
    safe = F.regexp_replace(F.element_at(F.split(F.regexp_replace("original_uri", r"[\\]", "/"), "/"), -1), r"[^\w.-]|^\.+", "_")
    rows = blobs.where("inlined").select(F.concat(F.lpad(F.col("blob_index").cast("string"), 6, "0"), F.lit("-"), safe).alias("name"), "data")

    spark, written = blobs.sparkSession, 0
    fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in rows.toLocalIterator():  # a blob at a time through the driver's file system, which knows every scheme that Spark reads
        p = fs_of(f"{folder.rstrip('/')}/{r['name']}")
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(r["data"]))
        out.close()
        written += 1
    return written


def stream_segments(frames: DataFrame, shard_size: int, *, position: str = "position") -> DataFrame:
    """(segment, start_frame, n_frames) of a stream of frames cut every shard_size frames; positions are dense from 0."""
    s = frames.groupBy(F.floor(F.col(position) / shard_size).alias("segment")).agg(F.min(position).alias("start_frame"), F.count("*").alias("n_frames"))
    return s.select("segment", "start_frame", "n_frames")


def segment_offsets(segments: DataFrame) -> DataFrame:
    """Adds start_frame, the running sum of n_frames before each segment; segments are few."""
    w = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start_frame", F.coalesce(F.sum("n_frames").over(w), F.lit(0)))


def inverse_permutation(order: DataFrame) -> DataFrame:
    """(ordinal, position) of (position, ordinal) rows; both must be 0..n-1, each once, else it is no permutation."""
    n, *found = order.agg(F.count("*"), *(f(c) for c in ("position", "ordinal") for f in (F.min, F.max, F.countDistinct))).first()
    if n and found != [0, n - 1, n] * 2:
        raise ValidationError("positions and ordinals must both be 0..n-1, each once")
    return order.select("ordinal", "position")


def blob_tables(items: DataFrame, segments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(blobs(blob_index, uri), spans(ordinal, blob_index, byte_start, byte_end)).

    With segments(segment, uri, start_frame, n_frames) and items(ordinal, frame) a blob is a segment and a span is the frame inside it;
    without, items(ordinal, uri, byte_len) give one blob per distinct file and whole-file spans. Rows without a frame or file have no blob.
    """
    from .joins import interval_join

    if segments is not None:
        blobs = segments.select(F.col("segment").alias("blob_index"), "uri")
        hit = interval_join(items.where("frame is not null"), segments, point="frame", start="start_frame", length="n_frames")
        local = F.col("frame") - F.col("start_frame")
        found = hit.select("ordinal", F.col("segment").alias("blob_index"), local.alias("byte_start"), (local + 1).alias("byte_end"))
    else:
        from .dedup import dense_index

        firsts = items.where("uri is not null").groupBy("uri").agg(F.min("ordinal").alias("_first"))
        blobs = dense_index(firsts, "_first", "blob_index").select("blob_index", "uri")
        found = items.where("uri is not null").join(blobs, "uri").select("ordinal", "blob_index", F.lit(0).cast("long").alias("byte_start"), F.col("byte_len").alias("byte_end"))
    spans = items.select("ordinal").join(found, "ordinal", "left")
    return blobs, spans


def blob_match(items: DataFrame, blobs: DataFrame) -> DataFrame:
    """(ordinal, blob_index): by content hash, else by position."""
    by_hash = blobs.groupBy("content_hash").agg(F.min("blob_index").alias("_h"))
    by_place = blobs.select(F.col("blob_index").alias("_p"))
    j = items.join(by_hash, "content_hash", "left").join(by_place, F.col("ordinal") == F.col("_p"), "left")
    return j.select("ordinal", F.coalesce("_h", "_p").alias("blob_index"))


def canvas_size(sizes: DataFrame, width: int, *, probes: int = 128) -> tuple[int, int]:
    """Even canvas of (width, height) items: as wide as the median item, at most `width`, with the median ratio of width to height.

    At most `probes` items are looked at, evenly spaced by ordinal from the first on; those without a size are skipped.
    """
    step = max(1, sizes.count() // probes)
    picked = sizes.where((F.col("ordinal") % step == 0) & (F.col("ordinal") < step * probes) & (F.col("width") > 0) & (F.col("height") > 0))
    w, ratio = picked.agg(F.percentile("width", 0.5), F.percentile(F.col("width") / F.col("height"), 0.5)).first()
    if w is None:
        raise ValidationError("no sizes to choose a canvas from")
    w = min(int(w), width)
    return max(w // 2 * 2, 2), max(round(w / ratio) // 2 * 2, 2)


def changed_frames(frames: DataFrame, recorded: DataFrame) -> DataFrame:
    """Frames whose bytes don't have the recorded digest: frames(frame, data), recorded(frame, sha256)."""
    return recorded.join(frames.select("frame", F.sha2("data", 256).alias("_now")), "frame", "left").where("not (_now <=> sha256)").select("frame")


def image_text(origin: str = "origin", label: str = "label", page: str | None = None) -> F.Column:
    """What stands for an image as text: its origin, its page from 1 on, its label in brackets."""
    base = F.concat(F.col(origin), F.when(F.col(page).isNotNull(), F.concat(F.lit(" page "), F.col(page) + 1)).otherwise("")) if page else F.col(origin)
    return F.concat(base, F.coalesce(F.concat(F.lit(" ["), F.nullif(label, F.lit("")), F.lit("]")), F.lit("")))


def quality_strata(images: DataFrame) -> DataFrame:
    """Adds `stratum` from measures of each image: side, gradient variance, share of steep gradients, transparency, format.

    images has longest_side, gradient_variance, steep_share, has_alpha and origin; measuring pixels is a plug-in.
    """
    side = F.when(F.col("longest_side") < 512, "small").when(F.col("longest_side") < 1024, "medium").otherwise("large")
    detail = F.when(F.col("gradient_variance") < 100, "low").when(F.col("gradient_variance") < 1000, "mid").otherwise("high")
    text = F.when(F.col("steep_share") > 0.1, "text").otherwise("plain")
    kind = F.lower(F.regexp_extract("origin", r"\.([^./]+)$", 1))
    return images.withColumn("stratum", F.concat_ws("/", side, detail, text, F.when(F.col("has_alpha"), "alpha").otherwise("opaque"), kind))


def keyframe_policy(probe: DataFrame, *, tolerance: float = 2.0) -> DataFrame:
    """(decision, intra_bytes, inter_bytes): inter if it is smaller and its mean quality is at most `tolerance` lower; else intra.

    probe is (arm, bytes, quality) of sample items encoded both ways; without measured qualities the bytes decide.
    """
    of = lambda arm, c: F.when(F.col("arm") == arm, F.col(c))
    sums = probe.agg(F.sum(of("intra", "bytes")).alias("intra_bytes"), F.sum(of("inter", "bytes")).alias("inter_bytes"), (F.avg(of("intra", "quality")) - F.avg(of("inter", "quality"))).alias("_drop"))
    inter = (F.col("inter_bytes") < F.col("intra_bytes")) & (F.coalesce("_drop", F.lit(0.0)) <= tolerance)
    return sums.select(F.when(inter, "inter").otherwise("intra").alias("decision"), "intra_bytes", "inter_bytes")


def gate_labels(rows: DataFrame) -> DataFrame:
    """(ordinal, gate_label): the label, or the text where it is empty."""
    return rows.select("ordinal", F.coalesce(F.nullif("label", F.lit("")), F.col("canonical_text")).alias("gate_label"))


def utility_threshold(floor: float, source_hit: float, tolerance: float) -> float:
    """The hit rate that decoded media must reach."""
    return max(floor, source_hit - tolerance)


def store_files(frames: DataFrame, **_) -> DataFrame:
    """The backend `files`: images stay the files that they are, one blob a frame."""
    return frames


#: Media backends by name: callables (frames(position, frame, uri, data), settings) -> the same columns with encoded data.
BACKENDS: dict[str, Callable] = {"files": store_files}


def register_backend(name: str, run: Callable) -> None:
    BACKENDS[name] = run


def encode_media(name: str, frames: DataFrame, **settings) -> DataFrame:
    if name not in BACKENDS:
        raise NotIndexed(f"media backend {name!r} is not installed; known: {sorted(BACKENDS)}")
    return BACKENDS[name](frames, **settings)
