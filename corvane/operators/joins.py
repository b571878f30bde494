"""Joins with the build pipeline's rules, and checks that are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError, ValidationError


def last_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in an order; nulls are a key too."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(key, *(F.col("_row")[c].alias(c) for c in rest))


def lookup_join(left: DataFrame, right: DataFrame, key: str, *, order: str, require_match: bool = True) -> DataFrame:
    """Left join in which the last right row of a key wins, null meets null, and left columns win where names clash.

    A left null under a clashing name stays null. Keys of different types are refused, not coerced. If both sides have rows
    and none match, that is an error. The order column only chooses the last row and is not added.
    """
    if key not in left.columns or key not in right.columns:
        raise SpecError(f"lookup join: both sides need a column {key!r}")
    if left.schema[key].dataType != right.schema[key].dataType:
        raise SpecError(f"lookup join on {key!r}: {left.schema[key].dataType.simpleString()} and {right.schema[key].dataType.simpleString()} never match")
    extra = [c for c in right.columns if c not in left.columns and c != order]
    one = last_of_key(right.select(key, *extra, *([order] if order not in (key, *extra) else [])), key, order)
    one = one.select(F.col(key).alias("_key"), *extra, F.lit(True).alias("_hit"))
    joined = left.join(one, left[key].eqNullSafe(one["_key"]), "left")
    if require_match and not joined.where("_hit").limit(1).count() and left.limit(1).count() and right.limit(1).count():
        raise SpecError(f"lookup join on {key!r}: no row matched; check the key's name and type on both sides")
    return joined.drop("_key", "_hit")


def check_total_order(df: DataFrame, keys: list[str]) -> None:
    """Refuse keys that don't tell all rows apart, naming one duplicate."""
    if not keys:
        raise SpecError("order_by is required")
    duplicate = df.groupBy(*(F.coalesce(F.col(k).cast("string"), F.lit("None")).alias(k) for k in keys)).count().where("count > 1").limit(1).collect()
    if duplicate:
        raise SpecError(f"order_by {keys} is not a total order: {tuple(duplicate[0])[:-1]} occurs {duplicate[0][-1]} times; add a unique column")


def interval_join(points: DataFrame, segments: DataFrame, *, point: str, start: str, length: str, bucket: int = 2048) -> DataFrame:
    """Each point with the segment that holds it: start <= point < start + length.

    Both sides meet on buckets of the point axis, so that the join is an equi-join of any size; a segment is repeated for each
    bucket that it touches.
    """
    p = points.withColumn("_b", F.floor(F.col(point) / bucket))
    last = F.floor((F.col(start) + F.col(length) - 1) / bucket)
    s = segments.where(F.col(length) > 0).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), last)))
    return p.join(s, "_b").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(length))).drop("_b")


def label_lookup(items: DataFrame, labels: DataFrame, *, path: str = "origin") -> DataFrame:
    """Add `label`: by the whole relative path, else by its stem, else empty; an empty label counts as none. labels is (name, label)."""
    one = labels.groupBy("name").agg(F.max("label").alias("label"))
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")
    by_path = one.select(F.col("name").alias("_n1"), F.col("label").alias("_l1"))
    by_stem = one.select(F.col("name").alias("_n2"), F.col("label").alias("_l2"))
    joined = items.withColumn("_stem", stem).join(by_path, F.col(path) == F.col("_n1"), "left").join(by_stem, F.col("_stem") == F.col("_n2"), "left")
    label = F.coalesce(F.nullif("_l1", F.lit("")), F.nullif("_l2", F.lit("")), F.lit(""))
    return joined.withColumn("label", label).drop("_stem", "_n1", "_l1", "_n2", "_l2")


def missing_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose non-null key has no parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def check_bundle(bundle: dict[str, DataFrame]) -> None:
    """Referential checks of an ingest bundle: chunks(chunk_id), embedding_requests(chunk_id), mentions(entity_id, chunk_id), entities(entity_id), edges(src, dst over entity_id)."""
    for table, key in (("chunks", "chunk_id"), ("entities", "entity_id")):
        if table in bundle and bundle[table].groupBy(key).count().where("count > 1").limit(1).count():
            raise ValidationError(f"{table}: a {key} occurs twice")
    for child, key, parent, parent_key in (("embedding_requests", "chunk_id", "chunks", "chunk_id"), ("mentions", "chunk_id", "chunks", "chunk_id"), ("mentions", "entity_id", "entities", "entity_id"), ("edges", "src", "entities", "entity_id"), ("edges", "dst", "entities", "entity_id")):
        if child in bundle and parent in bundle:
            lost = missing_references(bundle[child], bundle[parent], key, parent_key).limit(1).collect()
            if lost:
                raise ValidationError(f"{child}.{key}: {lost[0][key]!r} is not in {parent}")
