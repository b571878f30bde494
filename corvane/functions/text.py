"""Text expressions: tokens, chunk windows, templates and derived columns, all JVM-side."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError

WORD = r"[\p{IsAlphabetic}\p{N}]"


def lexical_tokens(text: Column | str) -> Column:
    """Lower-cased maximal runs of letters and digits, two characters or longer, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}"), F.lit(0))


def embedding_tokens(text: Column | str) -> Column:
    """Like lexical_tokens, but single characters count too."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "+"), F.lit(0))


def chunk_windows(df: DataFrame, text_col: str, *, max_chars: int = 512, overlap: int = 0, keep_text: bool = False) -> DataFrame:
    """One row per window of `max_chars` characters: every column of df but the text, then the text, chunk_no, canonical_text, byte_start, byte_end.

    Windows advance by max_chars - overlap and stop with the first that reaches the text's end. Bytes are UTF-8.
    Null and empty texts give no row. Narrow and native: no shuffle, no Python. The text is cut once into pieces of one step, of which
    windows are joined, so the work is in proportion to the text; keep_text = False leaves the text itself out of the windows' rows.
    """
    if max_chars < 1 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars > 0 and 0 <= overlap < max_chars are needed")
    step = max_chars - overlap
    kept = [F.col("`" + c + "`") for c in df.columns if keep_text or c != text_col]
    t = F.col("`" + text_col + "`")
    n, more = F.length(t), -(-max_chars // step)  # more: pieces that a window reaches into
    count = F.when(n <= max_chars, F.lit(1)).otherwise(F.lit(1) + F.ceil((n - max_chars) / step).cast("int"))

    def starts(pieces: Column) -> Column:
        """Where each piece starts, as one running sum over their sizes."""
        first = F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("long").alias("end"))
        sizes = F.transform(pieces, lambda p: F.octet_length(p).cast("long"))
        return F.aggregate(sizes, first, lambda s, x: F.struct(F.array_append(s["at"], s["end"]).alias("at"), (s["end"] + x).alias("end")), lambda s: s["at"])

    def windows(pieces: Column, at: Column) -> Column:
        # slice() walks the whole array, so the few pieces of a usual window are taken one by one
        joined = (lambda i: F.concat_ws("", *(F.get(pieces, i + j) for j in range(more)))) if more <= 16 else lambda i: F.array_join(F.slice(pieces, i + 1, more), "")
        window = lambda i: F.substring(joined(i), 1, max_chars)
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk_no"), window(i).alias("canonical_text"), F.get(at, i).alias("byte_start")))

    cut = _let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), lambda pieces: _let(starts(pieces), lambda at: windows(pieces, at)))
    out = df.where(n > 0).select(*kept, F.explode(cut).alias("_w")).select(*kept, "_w.*")
    return out.withColumn("byte_end", F.col("byte_start") + F.octet_length("canonical_text"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once; a column that is used once in the next projection would be put in its place, inside a loop too."""
    return F.get(F.transform(F.array(value), body), 0)


def basename_stem(path: Column | str) -> Column:
    """File name of a path or URL without query string and last extension; a trailing slash is ignored."""
    c = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(F.rtrim(F.element_at(F.split(F.coalesce(c, F.lit("")), r"\?"), 1), F.lit("/")), "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


#: Helpers that derived columns may use, each of one column; missing and null values count as the empty string.
DERIVED = {"lower": lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))), "basename_stem": basename_stem}


def derive(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a column from `helper(column)`."""
    helper, _, rest = expression.strip().partition("(")
    column = rest[:-1]
    if helper not in DERIVED or not rest.endswith(")") or not column.isidentifier():
        raise SpecError(f"derive: unsupported expression {expression!r}; use helper(column) with one of {sorted(DERIVED)}")
    return df.withColumn(name, DERIVED[helper](column) if column in df.columns else F.lit(""))


def _shown(df: DataFrame, name: str, null_text: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    c = F.col(name)
    if dict(df.dtypes)[name] == "boolean":
        return F.when(c, "True").when(~c, "False").otherwise(null_text)
    return F.coalesce(c.cast("string"), F.lit(null_text))


def template(df: DataFrame, pattern: str, *, null_text: str = "None") -> Column:
    """Render a text template with {column} placeholders, line by line.

    A line whose placeholders are all blank is dropped. What blanks leave behind is cleaned: empty parentheses and
    brackets, a comma before a closing bracket, a dash at either end, runs of white space. Empty lines
    go. Columns that don't exist are blank; a null shows as `null_text`.
    """
    lines = []
    for line in pattern.strip().splitlines():
        parts, blank = [], None
        for literal, field, _, _ in string.Formatter().parse(line):
            if literal:
                parts.append(F.lit(literal))
            if field:
                value = _shown(df, field.split(".")[0].split("[")[0], null_text)
                parts.append(value)
                empty = F.trim(F.regexp_replace(value, r"\s+", " ")) == ""
                blank = empty if blank is None else blank & empty
        c = F.concat(*parts) if parts else F.lit("")
        # fixed values: the clean-up patterns
        for find, put in ((r"\(\s*\)", ""), (r"\[\s*,?\s*\]", ""), (r"(^\s*—\s*)|(\s*—\s*$)", ""), (r",\s*\]", "]"), (r"\s{2,}", " "), (r"^\s+|\s+$", "")):
            c = F.regexp_replace(c, find, put)
        lines.append(F.when(blank, "").otherwise(c) if blank is not None else c)
    return F.array_join(F.filter(F.array(*lines), lambda x: x != ""), "\n") if lines else F.lit("")


def key_template(df: DataFrame, pattern: str) -> Column:
    """{column} placeholders without any clean-up, trimmed; missing columns and nulls are blank."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(pattern):
        parts += [F.lit(literal)] if literal else []
        parts += [_shown(df, field, "")] if field else []
    return F.trim(F.concat(*parts)) if parts else F.lit("")


def media_uri(uri: Column | str) -> Column:
    """struct(path, frame) of `media://path#frame=n`; frame is null without a fragment, both for other schemes."""
    c = F.col(uri) if isinstance(uri, str) else uri
    ok = c.rlike(r"^media://[^#]*(#frame=\d+)?$")
    path, frame = F.regexp_extract(c, r"^media://([^#]*)", 1), F.regexp_extract(c, r"#frame=(\d+)$", 1)
    return F.when(ok, F.struct(path.alias("path"), F.when(frame != "", frame.cast("long")).alias("frame")))
