"""Workloads for measuring: synthetic rows, perturbed queries, seeded picks, and latency summaries."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from math import floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize


def _noise(*keys) -> F.Column:
    """A number of mean 0 and variance 1 that depends on its keys alone: a sum of three hashed uniforms."""
    part = lambda i: (F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(1 << 30)) / float(1 << 30)) * 2.0 - 1.0
    return part(0) + part(1) + part(2)


def clustered_rows(spark: SparkSession, n: int, dim: int, *, per_center: int = 50, noise: float = 0.35, seed: int = 7) -> DataFrame:
    """(ordinal, embedding): unit vectors around max(8, n / per_center) centers; the same for any partitioning."""
    centers = max(8, n // per_center)
    rows = spark.range(n).select(F.col("id").alias("ordinal"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(centers)).alias("_c"))
    axes = F.sequence(F.lit(0), F.lit(dim - 1))
    v = F.transform(axes, lambda i: _noise(F.col("_c"), i, F.lit(seed + 1)) + noise * _noise(F.col("ordinal"), i, F.lit(seed + 2)))
    return rows.select("ordinal", l2_normalize(v).cast("array<float>").alias("embedding"))


def perturbed_queries(vectors: DataFrame, n: int, *, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """(qid, query): the n vectors whose ids hash lowest, each moved a little; qid is the ordinal it came from."""
    picked = vectors.orderBy(F.xxhash64("ordinal", F.lit(seed)), "ordinal").limit(n)
    moved = F.transform("embedding", lambda x, i: x.cast("double") + noise * _noise(F.col("ordinal"), i, F.lit(seed)))
    return picked.select(F.col("ordinal").alias("qid"), l2_normalize(moved).alias("query"))


def pick_queries(items: DataFrame, n: int | None, seed: int = 42, order: str = "ordinal") -> DataFrame:
    """All items, or the n whose ids hash lowest."""
    return items if n is None else items.orderBy(F.xxhash64(order, F.lit(seed)), order).limit(n)


def latency_summary(milliseconds: list[float]) -> dict[str, float]:
    """mean, p50, p95 and p99 by nearest rank, halves away from zero."""
    x = sorted(milliseconds)
    if not x:
        return {}
    at = lambda p: x[min(len(x) - 1, floor(p * (len(x) - 1) + 0.5))]
    return {"mean": sum(x) / len(x), "p50": at(0.5), "p95": at(0.95), "p99": at(0.99)}


def measure(run: Callable[[], object], repeats: int) -> dict[str, float]:
    """Run something and summarise how long it took."""
    times = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        times.append((time.perf_counter() - began) * 1000)
    return latency_summary(times)


class StepCache:
    """Steps of a build that need not run again: a step is done if its inputs' digest was marked."""

    def __init__(self, folder: str):
        self.folder = folder

    def key(self, step: str, inputs: dict) -> str:
        return f"{step}-{hashlib.sha256(json.dumps(inputs, sort_keys=True).encode()).hexdigest()[:16]}"

    def hit(self, key: str) -> bool:
        return os.path.exists(os.path.join(self.folder, key))

    def mark(self, key: str) -> None:
        os.makedirs(self.folder, exist_ok=True)
        open(os.path.join(self.folder, key), "w").close()
