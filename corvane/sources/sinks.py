"""Sinks of results: answer packs as JSON or JSON lines, and the sidecar manifest of a media corpus."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ManifestError
from ..plans.manifest import redact


def answer_rows(hits: DataFrame) -> DataFrame:
    """(qid, rank, value): each hit as a JSON object."""
    return hits.select("qid", "rank", F.to_json(F.struct(*hits.columns)).alias("value"))


def write_answers(hits: DataFrame, path: str) -> None:
    """JSON lines, one hit a line, in order of query and rank."""
    answer_rows(hits).repartitionByRange("qid", "rank").sortWithinPartitions("qid", "rank").select("value").write.text(path)


def answer_pack(hits: DataFrame, query: str, qid: int = 0) -> str:
    """One query's hits (k rows) as a JSON document."""
    rows = [json.loads(r.value) for r in answer_rows(hits.where(F.col("qid") == qid)).orderBy("rank").collect()]
    return json.dumps({"query": query, "hits": rows}, ensure_ascii=False)


# What a sidecar manifest must have.
SIDECAR_FIELDS = ("schema_version", "corpus", "content_hash", "items")


def sidecar_manifest(corpus: str, content_hash: str, items: DataFrame, path: str, *, level: str = "standard") -> None:
    """Write items(ordinal, key, uri[, label]) as JSON lines below path/items, and path/manifest as its head.

    `minimal` keeps ordinals and keys only; uris are redacted to the level. Items stay distributed: they are never gathered.
    """
    if level not in ("minimal", "standard", "full"):
        raise ManifestError(f"unknown provenance level {level!r}")
    parts = 1 if level == "minimal" else 2
    last = F.array_join(F.slice(F.split("uri", "/"), -parts, parts), "/")
    uri = F.col("uri") if level == "full" else F.when(F.size(F.split("uri", "/")) > parts, last).otherwise(F.col("uri"))
    kept = items.select("ordinal", "key") if level == "minimal" else items.withColumn("uri", uri)
    kept.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.json(f"{path}/items")
    head = {"schema_version": 1, "corpus": redact(corpus, level), "content_hash": content_hash, "items": items.count(), "provenance": level}
    items.sparkSession.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read_sidecar(spark, path: str) -> tuple[dict, DataFrame]:
    head = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    missing = [f for f in SIDECAR_FIELDS if f not in head]
    if missing:
        raise ManifestError(f"the sidecar manifest lacks {missing}")
    return head, spark.read.json(f"{path}/items")
