"""Sources of a build, and the rules that turn their rows into items."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.identity import item_input_hash
from ..functions.text import derive, key_template, template
from ..operators.dedup import dense_index
from ..operators.joins import check_total_order, label_lookup, lookup_join


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header and strings: no types are guessed; quotes double inside quotes, and a quoted field may span lines."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", emptyValue="", nullValue=None).csv(path).na.fill("")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed line is an error."""
    reader = spark.read.options(mode="FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_query(spark: SparkSession, query: str, tables: dict[str, str | DataFrame] | None = None) -> DataFrame:
    """Any Spark SQL over registered tables: Parquet paths or DataFrames."""
    for name, t in (tables or {}).items():
        (t if isinstance(t, DataFrame) else spark.read.parquet(t)).createOrReplaceTempView(name)
    return spark.sql(query)


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """A SELECT that a JDBC database runs; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


# Extensions taken as images.
IMAGE_TYPES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "gif")


def read_images(spark: SparkSession, folder: str, labels: DataFrame | None = None, *, with_data: bool = False) -> DataFrame:
    """(ordinal, origin, path, byte_len, image_sha256, label[, data]) of the images below a folder, in path order.

    origin is the path relative to the folder; labels is (name, label), by relative path or stem.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_TYPES))
    origin = F.substring_index("path", folder.rstrip("/") + "/", -1)
    rows = files.select(origin.alias("origin"), "path", F.col("length").alias("byte_len"), F.sha2("content", 256).alias("image_sha256"), *([F.col("content").alias("data")] if with_data else []))
    rows = dense_index(rows, "origin", "ordinal")
    return label_lookup(rows, labels) if labels is not None else rows.withColumn("label", F.lit(""))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(name, label) from a JSON map or a two-column CSV with a header."""
    if path.lower().endswith(".csv"):
        rows = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
        a, b = rows.columns[:2]
        return rows.where(F.col(b).isNotNull()).select(F.trim(F.col(a)).alias("name"), F.trim(F.col(b)).alias("label"))
    text = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "label"))
    return text


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An ingest bundle in one JSON document: a table for each of its lists."""
    raw = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    out = {}
    for name in ("chunks", "embedding_requests", "entities", "edges", "blobs"):
        if raw.get(name):
            out[name] = spark.read.json(spark.createDataFrame([(json.dumps(x),) for x in raw[name]], "value string").rdd.map(lambda r: r[0]))
    if "entities" in out and "mentions" in out["entities"].columns:
        out["mentions"] = out["entities"].select("entity_id", F.explode("mentions").alias("m")).select("entity_id", "m.*")
    return out


def even_sample(df: DataFrame, size: int, order: str = "ordinal") -> DataFrame:
    """`size` evenly spaced rows of dense ordinals from 0, renumbered: row i is the one at floor(i * n / size)."""
    n = df.count()
    if size < 1 or size >= n:
        return df
    new = F.ceil(F.col(order) * F.lit(size) / F.lit(n)).cast("long")
    spot = lambda i: F.floor(i * (F.lit(n) / F.lit(size))).cast("long")
    # the only number that can map to this row is the ceiling, or its neighbour where division rounds
    pick = F.when(spot(new) == F.col(order), new).when(spot(new - 1) == F.col(order), new - 1).when(spot(new + 1) == F.col(order), new + 1)
    return df.withColumn("_new", pick).where((F.col("_new") >= 0) & (F.col("_new") < size)).withColumn(order, F.col("_new")).drop("_new")


def seeded_sample(df: DataFrame, size: int, seed: int = 42, order: str = "ordinal") -> DataFrame:
    """`size` rows with the lowest seeded hash, renumbered in their old order."""
    picked = df.orderBy(F.xxhash64(order, F.lit(seed)), order).limit(size).withColumnRenamed(order, "_old")
    return dense_index(picked, "_old", order).drop("_old")


def build_items(
    raw: DataFrame, name: str, *, order_by: list[str], text_template: str = "", label_template: str = "", derived: dict[str, str] | None = None,
    joins: list[tuple[DataFrame, str, str]] = (), image_hash: str | None = None, chunker_version: str = "1", null_text: str = "None",
) -> DataFrame:
    """(ordinal, key, canonical_text, source_uri, label, image_sha256, item_input_hash) of source rows.

    Lookup joins come first, then derived columns. Rows are ordered by the keys as strings ('10' before '9') and must
    be told apart by them. A blank text falls back to the label, then to the key; a missing source_uri to item://name/key.
    """
    for right, on, order in joins:
        raw = lookup_join(raw, right, on, order=order)
    for column, expression in (derived or {}).items():
        raw = derive(raw, column, expression)
    if not order_by:
        raise SpecError("source.order_by is required")
    check_total_order(raw, [c for c in order_by if c in raw.columns] or order_by)
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in raw.columns else F.lit("") for c in order_by]
    keyed = raw.withColumns({f"_k{i}": c for i, c in enumerate(shown)})
    keys = [f"_k{i}" for i in range(len(order_by))]
    rows = dense_index(keyed, keys, "ordinal").withColumn("key", F.concat_ws("|", *keys))
    label = F.nullif(key_template(raw, label_template), F.lit("")) if label_template else F.lit(None).cast("string")
    text = template(raw, text_template, null_text=null_text) if text_template else F.lit("")
    uri = F.nullif(F.col("source_uri").cast("string"), F.lit("")) if "source_uri" in raw.columns else F.lit(None).cast("string")
    image = F.col(image_hash) if image_hash else F.lit(None).cast("string")
    out = rows.select("ordinal", "key", text.alias("_text"), label.alias("label"), image.alias("image_sha256"), uri.alias("_uri"))
    out = out.withColumn("canonical_text", F.coalesce(F.nullif("_text", F.lit("")), F.col("label"), F.col("key")))
    out = out.withColumn("source_uri", F.coalesce("_uri", F.concat(F.lit(f"item://{name}/"), F.col("key"))))
    out = out.withColumn("item_input_hash", item_input_hash("canonical_text", "image_sha256", "label", chunker_version))
    return out.select("ordinal", "key", "canonical_text", "source_uri", "label", "image_sha256", "item_input_hash")
