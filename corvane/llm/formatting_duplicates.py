"""Problem 7: duplicates hidden by formatting, by progressive partition refinement.

The first partition groups records by invariants that no change of formatting touches: the number of letters
and digits, and fingerprints of the letter histograms of text and address. Only the members of classes with
several members get the costlier key, a digest of the normal form, and are split by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, checked_semi, column, materialize, mix64, sub_batches

_CUT = re.compile(r"[;|\n]")
_FIELD = re.compile(r"\s*[A-Za-z_]+\s*[:=]")


def text_form(text: str) -> str | None:
    """Letters and digits in lower case; the fields of a card in sorted order. None if there are none."""
    parts = [p for p in _CUT.split(text) if p.strip()]
    if len(parts) < 3 or not all(map(_FIELD.match, parts)):
        parts = [text]
    forms = sorted(f for f in ("".join(WORD.findall(p.lower())) for p in parts) if f)
    return "\x1f".join(forms) or None


def address_form(uri: str) -> str:
    """Lower case, no slashes at the end of the path, parameters in sorted order."""
    path, mark, query = uri.lower().partition("?")
    return path.rstrip("/") + mark + "&".join(sorted(query.split("&")))


def _histograms(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Length and order-free fingerprint (a sum of mixed code points) of each string."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix64(points + np.uint64(0x51ED2701)), out=sums[1:])
    ends = np.cumsum(n)
    return n, sums[ends] - sums[ends - n]


def _invariants(base: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches):
            letters = ["".join(WORD.findall(x.lower())) for x in b.column("text").to_pylist()]
            n, a = _histograms(letters)
            _, z = _histograms([x.lower().replace("/", "") for x in b.column("uri").to_pylist()])
            has = pa.array(np.flatnonzero(n))
            h = mix64(a * np.uint64(0x9E3779B97F4A7C15) + z).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").take(has), pa.array(n).take(has), pa.array(h).take(has)], ["id", "n", "h"])

    return base.mapInArrow(run, "id long, n long, h long")


def _digests(base: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches):
            keys = [blake2b(f"{address_form(u)}\x1e{text_form(x) or ''}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for x, u in zip(b.column("text").to_pylist(), b.column("uri").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary())], ["id", "key"])

    return base.mapInArrow(run, "id long, key binary")


def formatting_duplicates(df: DataFrame, id_col: str, text_col: str, uri_col: str) -> DataFrame:
    """(kept, copy, copies): every record of a group of two or more, with the group's smallest id and its size.

    The kept record's own row has copy = kept. Two records are copies if text and address are non-null and equal in
    normal form (text_form, address_form); texts without letters and digits, and null ids, take no part. Ids must be
    unique. Other columns are ignored. A group of any size is only ever aggregated in parts and joined by its key.
    """
    base = df.select(column(df, id_col).cast("long").alias("id"), column(df, text_col).alias("text"), column(df, uri_col).alias("uri"))
    base = base.where("id is not null and text is not null and uri is not null")
    first = materialize(_invariants(base), "invariants")
    several = first.groupBy("n", "h").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    open_ids = materialize(first.join(several, ["n", "h"], "left_semi").select("id"), "open-classes")
    keyed = materialize(_digests(checked_semi(base, open_ids, "id")), "normal-forms")
    groups = keyed.groupBy("key").agg(F.min("id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(groups, "key").select("kept", F.col("id").alias("copy"), "copies")
