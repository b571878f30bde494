"""Content addresses and digests. Row digests are native expressions; digests of ordered tables are trees of leaves of bounded size."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialize

#: Tag that starts every chunk id's input, so that ids of different schemes never meet.
CHUNK_DOMAIN = "corvane:chunk_id:v1\n"


def _little_endian(c: Column, size: int) -> Column:
    """The `size` low bytes of an integer, lowest first, as binary."""
    digits = F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(size))))


def _prefixed(c: Column) -> Column:
    raw = F.encode(c, "UTF-8")
    return F.concat(_little_endian(F.octet_length(raw), 4), raw)


def chunk_id(text: Column | str, uri: Column | str, start: Column | str, end: Column | str, chunker_version: str, *, domain: str = CHUNK_DOMAIN) -> Column:
    """`sha256:` + digest of the domain tag, text, uri, both span ends and the chunker version, each length-prefixed or of fixed width."""
    text, uri, start, end = (F.col(c) if isinstance(c, str) else c for c in (text, uri, start, end))
    whole = F.concat(F.encode(F.lit(domain), "UTF-8"), _prefixed(text), _prefixed(uri), _little_endian(start, 8), _little_endian(end, 8), _prefixed(F.lit(chunker_version)))
    return F.concat(F.lit("sha256:"), F.sha2(whole, 256))


def item_input_hash(text: Column | str, image_sha256: Column | str | None, label: Column | str | None, chunker_version: str) -> Column:
    """Digest of what a built item depends on; an absent image counts as `none`, an absent label as empty."""
    text, image, label = (F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c for c in (text, image_sha256, label))
    tag = lambda s: F.encode(F.lit(s), "UTF-8")
    whole = F.concat(
        tag("text:"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)),
        tag("image:"), F.encode(F.when(image.isNull() | (image == ""), "none").otherwise(image), "UTF-8"),
        tag("label:"), F.encode(F.coalesce(label, F.lit("")), "UTF-8"),
        tag("chunker:"), tag(chunker_version),
    )
    return F.concat(F.lit("sha256:"), F.sha2(whole, 256))


#: Consecutive rows of one leaf of an ordered digest.
LEAF_ROWS = 1 << 16


def ordered_digest(df: DataFrame, order: str, column: str) -> str:
    """SHA-256 of a string column's values, joined in the order of dense numbers from 0.

    Up to LEAF_ROWS rows that is the digest of the whole. Beyond, each leaf of LEAF_ROWS consecutive rows is digested where it is, and
    the same is done with the leaves' digests, so that no task and not the driver sees more than a leaf. Nothing depends on partitions.
    """
    rows = df.select(F.col(order).cast("long").alias("at"), F.col(column).alias("value"))
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "")
        leaves = rows.groupBy(F.floor(F.col("at") / LEAF_ROWS).alias("at")).agg(F.sha2(joined, 256).alias("value"))
        few = leaves.limit(2).collect()
        if len(few) < 2:
            return "sha256:" + (few[0].value if few else hashlib.sha256().hexdigest())
        rows = materialize(leaves, "leaf-digests")


def corpus_input_hash(df: DataFrame, order: str = "ordinal", column: str = "item_input_hash") -> str:
    return ordered_digest(df, order, column)


def table_digest(df: DataFrame) -> str:
    """Digest of a table's rows whatever their order, partitions or file layout: row digests are summed in parts.

    128 bits of each row's SHA-256 are added up as two decimals modulo 2^64, with the row count.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 16), 16, 10).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count("*"), part(1), part(17)).first()
    return "sum128:" + hashlib.sha256(f"{n}:{int(a or 0) % 2**64}:{int(b or 0) % 2**64}".encode()).hexdigest()


def canonical_json(value) -> str:
    """Sorted keys, no blanks: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint_hash(fingerprint: dict) -> str:
    """The model hash of an embedder's configuration."""
    return "sha256:" + hashlib.sha256(json.dumps(fingerprint, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def content_hash(chunks: DataFrame, vectors: DataFrame, contract: dict, provenance: dict) -> str:
    """Digest of the decoded canonical content in ordinal order: ids, texts, spans, vectors (single precision), contract, provenance.

    Indexes, graphs, blobs, spaces and encodings are not part of it, so adding or changing them never moves a citation.
    """
    def rows(df: DataFrame, *columns: str) -> str:
        row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        return ordered_digest(df.select("ordinal", row.alias("h")), "ordinal", "h")

    sections = {
        "chunks": rows(chunks, "chunk_id", "canonical_text", "source_uri", "byte_start", "byte_end"),
        "embeddings": rows(vectors.select("ordinal", F.col("embedding").cast("array<float>").alias("embedding")), "embedding"),
        "contract": fingerprint_hash(contract), "provenance": fingerprint_hash(provenance),
    }
    return fingerprint_hash(sections)
