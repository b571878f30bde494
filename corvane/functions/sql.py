"""SQL functions and table functions, so that queries in SQL can use the package's operators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="chunk_no: int, chunk_text: string, byte_start: bigint, byte_end: bigint")
class ChunkText:
    """chunk_text(text, max_chars, overlap): the windows of one text."""

    def eval(self, text: str, max_chars: int, overlap: int):
        if not text:
            return
        start, byte, i = 0, 0, 0
        while True:
            piece = text[start : start + max_chars]
            yield i, piece, byte, byte + len(piece.encode())
            if start + max_chars >= len(text):
                return
            step = max_chars - overlap
            byte += len(text[start : start + step].encode())
            start, i = start + step, i + 1


@udtf(returnType="pos: int, token: string")
class TokenizeText:
    """tokenize_text(text): lexical tokens in order."""

    def eval(self, text: str):
        import regex

        for i, t in enumerate(regex.findall(r"[\p{Alphabetic}\p{N}]{2,}", (text or "").lower())):
            yield i, t


# SQL bodies: each is one native expression, inlined by the optimizer.
_FUNCTIONS = {
    "vector_dot": ("(a array<double>, b array<double>) returns double", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vector_norm": ("(a array<double>) returns double", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vector_cosine": ("(a array<double>, b array<double>) returns double", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))"),
    "vector_normalize": ("(a array<double>) returns array<double>", "transform(array(sqrt(aggregate(a, 0D, (s, y) -> s + y * y))), n -> transform(a, x -> x / n))[0]"),
    "lexical_tokens": ("(t string) returns array<string>", r"regexp_extract_all(lower(t), r'[\p{IsAlphabetic}\p{N}]{2,}', 0)"),
    "rrf_weight": ("(r int) returns double", "1D / (60 + r)"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions and table functions; returns their names."""
    for name, (signature, body) in _FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}{signature} return {body}")
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("tokenize_text", TokenizeText)
    return [*_FUNCTIONS, "chunk_text", "tokenize_text"]
