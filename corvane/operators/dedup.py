"""Deduplication by equality, and orders that bring similar items together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items that a sequential order takes in one task; it costs their square.
SEQUENTIAL_ROWS = 50_000


def dedup_pool(df: DataFrame, key: str, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(pool(pool_index, <key>, first), references(<order>, pool_index)): distinct values numbered by first occurrence.

    Nulls are one value. The numbering sorts the distinct values by range, so no task sees them all at once.
    """
    firsts = df.groupBy(key).agg(F.min(order).alias("first"))
    pool = dense_index(firsts, "first", "pool_index")
    refs = df.select(order, key).join(pool.select(F.col(key).alias("_k"), "pool_index"), F.col(key).eqNullSafe(F.col("_k"))).select(order, "pool_index")
    return pool.select("pool_index", key, "first"), refs


def dedup_expand(pool: DataFrame, references: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """The inverse: (<order>, <key>) of every row."""
    return references.join(pool.select("pool_index", key), "pool_index").select(order, key)


#: Rows that one task numbers, about, and ranges at most.
INDEX_ROWS, INDEX_RANGES = 200_000, 1024


def dense_index(df: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """Number rows 0.. in a unique order, without one task that sorts everything.

    Ranges of the order are cut at boundaries drawn from a small sample, so a row's range depends on the row alone and
    recomputed tasks agree. Rows are numbered inside their range, and the ranges' sizes (INDEX_RANGES at most) are the offsets.
    """
    keys = [order] if isinstance(order, str) else order
    spark, n = df.sparkSession, df.count()
    ranges = min(max(1, -(-n // INDEX_ROWS)), INDEX_RANGES)
    if ranges == 1:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    drawn = df.select(*keys).sample(min(1.0, 40 * ranges / n), seed=1).orderBy(*keys).collect()
    cuts = [tuple(drawn[i * len(drawn) // ranges]) for i in range(1, ranges)] if drawn else []
    kinds = [df.schema[k].dataType for k in keys]
    bounds = [F.struct(*(F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, cut, kinds, strict=True))) for cut in cuts]
    whole = F.struct(*keys)
    placed = df.withColumn("_range", sum(((b <= whole).cast("int") for b in bounds), F.lit(0)))
    sizes = dict(placed.groupBy("_range").count().collect())
    offsets = {r: sum(c for q, c in sizes.items() if q < r) for r in sizes}
    start = spark.createDataFrame(list(offsets.items()) or [(0, 0)], "_range int, _start long")
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return placed.withColumn("_i", local).join(F.broadcast(start), "_range").withColumn(name, F.col("_start") + F.col("_i")).drop("_range", "_i", "_start")


def frame_map(df: DataFrame, image_hash: str = "image_sha256", order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(frames, frame_of_row(<order>, frame)): rows with the same image share a frame; rows without one never do."""
    keyed = df.withColumn("_key", F.coalesce(F.col(image_hash), F.concat(F.lit("row:"), F.col(order).cast("string"))))
    pool, refs = dedup_pool(keyed, "_key", order)
    return pool.select(F.col("pool_index").alias("frame"), F.col("first").alias(order)), refs.select(order, F.col("pool_index").alias("frame"))


def _sequential(df: DataFrame, walk, order: str, vec: str) -> DataFrame:
    if df.limit(SEQUENTIAL_ROWS + 1).count() > SEQUENTIAL_ROWS:
        raise ValueError(f"a sequential order takes at most {SEQUENTIAL_ROWS} items; split the items first")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.array(pdf[vec].tolist(), np.float32).reshape(len(pdf), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        at = walk(x / np.where(norm == 0, 1, norm))
        return pd.DataFrame({"position": np.arange(len(pdf)), order: pdf[order].to_numpy()[at]})

    return df.select(order, vec, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, f"position long, {order} long")


def similarity_order(df: DataFrame, order: str = "ordinal", vec: str = "embedding") -> DataFrame:
    """(position, ordinal): a walk from the first item to the most similar one not yet visited. Sequential by definition, so one task of bounded size."""

    def walk(x: np.ndarray) -> list[int]:
        left = np.ones(len(x), bool)
        at, out = 0, []
        while True:
            out.append(at)
            left[at] = False
            if not left.any():
                return out
            at = int(np.where(left, x @ x[at], -np.inf).argmax())

    return _sequential(df, walk, order, vec)


def cluster_order(df: DataFrame, *, threshold: float = 0.92, order: str = "ordinal", vec: str = "embedding") -> DataFrame:
    """(position, ordinal): items join the most similar centroid from `threshold` on, else open a cluster; larger clusters first, then the smaller first ordinal."""

    def walk(x: np.ndarray) -> list[int]:
        sums, centers, members = np.zeros((0, x.shape[1]), np.float32), np.zeros((0, x.shape[1]), np.float32), []
        for i, v in enumerate(x):
            best = int((centers @ v).argmax()) if members else -1
            if best >= 0 and centers[best] @ v >= threshold:
                members[best].append(i)
                sums[best] += v
                centers[best] = sums[best] / np.linalg.norm(sums[best])
            else:
                members.append([i])
                sums, centers = np.vstack([sums, v]), np.vstack([centers, v])
        return [i for m in sorted(members, key=lambda m: (-len(m), m[0])) for i in m]

    return _sequential(df, walk, order, vec)
