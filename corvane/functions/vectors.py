"""Vector expressions: dot products, norms, truncation, quantisation, and the order of scores.

Scores are computed in DOUBLE whatever the stored type. NaN sorts last everywhere, which is the opposite of Spark's
own descending order, so every ranking goes through score_order() or distance_order().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products; null if either is null or they differ in length."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression that stands inside a lambda is evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def l2_normalize(v: Column | str) -> Column:
    """v divided by its norm as doubles; a zero or non-finite norm leaves it unscaled."""

    def scaled(x: Column, n: Column) -> Column:
        usable = (n > 0) & ~F.isnan(n) & (n < float("inf"))
        return F.when(usable, F.transform(x, lambda y: y.cast("double") / n)).otherwise(F.transform(x, lambda y: y.cast("double")))

    return let(_col(v), lambda x: let(l2_norm(x), lambda n: scaled(x, n)))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def truncate_renormalize(v: Column | str, dim: int) -> Column:
    """The first `dim` members, scaled to length 1 again (Matryoshka prefix)."""
    if dim < 1:
        raise ValueError("dim must be at least 1")
    return l2_normalize(F.slice(_col(v), 1, dim))


def all_finite(v: Column | str) -> Column:
    return ~F.exists(_col(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def score_order(score: str = "score", tie: str = "ordinal") -> list[Column]:
    """Best score first, NaN last, ties by the smaller id."""
    return [F.isnan(score), F.desc(score), F.asc(tie)]


def distance_order(distance: str = "dist", tie: str = "ordinal") -> list[Column]:
    """Smallest distance first, NaN last, ties by the smaller id."""
    return [F.isnan(distance), F.asc(distance), F.asc(tie)]


def _f32(c: Column) -> Column:
    return c.cast("float")


def quantize_int8(v: Column | str) -> Column:
    """struct(scale FLOAT, codes ARRAY<TINYINT>): scale = absmax / 127 in single precision, codes rounded half away from zero and clamped to +-127; a zero vector gets scale 1."""
    one = lambda x, scale: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(_f32(x.cast("float") / scale)).cast("int"))).cast("tinyint")

    def quantized(x: Column) -> Column:
        top = F.array_max(F.transform(x, lambda y: F.abs(y.cast("float"))))
        scale = F.when(top > 0, _f32(top / F.lit(127.0).cast("float"))).otherwise(F.lit(1.0).cast("float"))
        return let(scale, lambda s: F.struct(s.alias("scale"), F.transform(x, lambda y: one(y, s)).alias("codes")))

    return let(_col(v), quantized)


def dequantize_int8(q: Column | str) -> Column:
    q = _col(q)
    return F.transform(q["codes"], lambda c: _f32(c.cast("float") * q["scale"]))


FLOATS = T.ArrayType(T.FloatType())
INT4 = T.StructType([T.StructField("scales", T.ArrayType(T.FloatType())), T.StructField("codes", T.BinaryType())])


@F.pandas_udf(INT4)
def quantize_int4(v: pd.Series) -> pd.DataFrame:
    """Blocks of 64: scale = half-precision(absmax / 7), 1 for a zero block; two codes in -7..7 per byte, low half first."""
    rows = []
    for x in v:
        if x is None:
            rows.append((None, None))
            continue
        x = np.asarray(x, np.float32)
        if len(x) % 64:
            raise ValueError("int4 needs a dimension that is a multiple of 64")
        blocks = x.reshape(-1, 64)
        scale = (np.abs(blocks).max(1) / np.float32(7)).astype(np.float16).astype(np.float32)
        scale[scale == 0] = 1
        r = blocks / scale[:, None]
        codes = np.clip(np.trunc(r + np.copysign(np.float32(0.5), r)), -7, 7).astype(np.int8).reshape(-1)
        half = codes.astype(np.uint8) & 15
        rows.append((scale.tolist(), (half[0::2] | half[1::2] << 4).astype(np.uint8).tobytes()))
    return pd.DataFrame(rows, columns=["scales", "codes"])


@F.pandas_udf(FLOATS)
def dequantize_int4(q: pd.DataFrame) -> pd.Series:
    out = []
    for scales, codes in zip(q["scales"], q["codes"], strict=True):
        if codes is None:
            out.append(None)
            continue
        raw = np.frombuffer(codes, np.uint8)
        both = np.stack([raw & 15, raw >> 4], 1).reshape(-1).astype(np.int8)
        both = np.where(both > 7, both - 16, both).astype(np.float32)
        out.append((both.reshape(-1, 64) * np.asarray(scales, np.float32)[:, None]).reshape(-1))
    return pd.Series(out)


@F.pandas_udf(T.BinaryType())
def encode_float16(v: pd.Series) -> pd.Series:
    """Little-endian half precision, rounded to nearest even."""
    return v.map(lambda x: None if x is None else np.asarray(x, np.float32).astype("<f2").tobytes())


@F.pandas_udf(FLOATS)
def decode_float16(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f2").astype(np.float32))


@F.pandas_udf(FLOATS)
def decode_float32(b: pd.Series) -> pd.Series:
    """Little-endian single precision; data cut off inside a number gives null."""
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))
