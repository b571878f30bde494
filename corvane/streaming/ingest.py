"""Incremental ingest with Structured Streaming: an extension beyond whole builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.embed import embed_column, model_hash
from ..functions.identity import chunk_id
from ..functions.text import chunk_windows
from ..plans.pipeline import read_cache


def stream_chunks(texts: DataFrame, *, text_col: str = "text", uri_col: str = "source_uri", max_chars: int = 512, overlap: int = 0, chunker_version: str = "1") -> DataFrame:
    """Chunks of a stream of texts: stateless, so the same rows as a batch gives."""
    windows = chunk_windows(texts.select(F.col(text_col).alias("_whole"), F.col(uri_col).alias("source_uri")), "_whole", max_chars=max_chars, overlap=overlap)
    return windows.withColumn("chunk_id", chunk_id("canonical_text", "source_uri", "byte_start", "byte_end", chunker_version))


def _timed(df: DataFrame, time_col: str) -> DataFrame:
    """Watermarks need timestamps with the session's zone."""
    return df.withColumn(time_col, F.col(time_col).cast("timestamp"))


def stream_distinct(chunks: DataFrame, *, time_col: str, delay: str) -> DataFrame:
    """Drop repeats of a chunk id that arrive within `delay` of each other; state is bounded by the watermark."""
    return _timed(chunks, time_col).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["chunk_id"])


def embed_stream(chunks: DataFrame, cache: str, embedder, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Write embeddings of new chunks to the cache folder, each batch into a part of its own that a repeated batch overwrites.

    A batch embeds only what earlier batches lack. Of the cache it reads the ids of this model, as many as the batch's chunks can meet:
    the batch's ids are joined to them, not the vectors.
    """
    key = model_hash(embedder)

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        mine = f"{cache.rstrip('/')}/batch={number}"
        known = read_cache(spark, cache, but=number).where(F.col("model_hash") == key).select("chunk_id")
        fresh = df.select("chunk_id", "canonical_text").dropDuplicates(["chunk_id"]).join(known, "chunk_id", "left_anti")
        rows = fresh.select("chunk_id", F.lit(key).alias("model_hash"), embed_column("canonical_text", embedder).alias("embedding"))
        rows.write.mode("overwrite").parquet(mine)

    w = chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed_counts(events: DataFrame, *, time_col: str = "ts", key: str = "event_type", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window_start, <key>, n): tumbling counts that close once the watermark passes; late rows beyond it are dropped by Spark."""
    w = F.window(time_col, window)
    return _timed(events, time_col).withWatermark(time_col, delay).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def read_stream(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
