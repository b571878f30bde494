"""Problem 5: splitting oversized texts at natural boundaries, by a recursive hierarchy of separators.

The levels are section, paragraph, sentence, word and character. Pieces are packed greedily: a piece takes all it can hold up to
the limit and ends at the last boundary of the coarsest level that has one in the piece's second part. Where a
level has none there, that part is one unbroken stretch of it, and the search goes on inside the stretch with the next finer
level, down to single characters. Each piece starts `overlap` characters before the end of the one before. Boundaries
are only looked for where a piece may end, so a text of any length takes time in proportion to it and constant memory beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, sub_batches

#: A boundary is the position directly after a match: a form feed, a third line feed, or the line feed before a heading; then paragraphs, sentences and words.
SECTION = r"(?<=\f)|(?<=\n\n\n)|(?<=\n)(?=#{1,6} )"
PARAGRAPH = r"(?<=\n\n)"
SENTENCE = r"(?<=[.!?][ \t\n])"
WORD_END = r"(?<=[ \t\n])"
#: Levels from coarse to fine; below the last one come single characters.
LEVELS = (SECTION, PARAGRAPH, SENTENCE, WORD_END)
#: Characters after a boundary that a level may look at.
AHEAD = 16


def boundary(text: str, low: int, high: int, levels: Sequence[re.Pattern]) -> int:
    """The last boundary in low..high of the coarsest level that has one there; `high` itself below the finest level."""
    if not levels:
        return high
    last = None
    for m in levels[0].finditer(text, low, min(high + AHEAD, len(text))):
        if m.start() > high:
            break
        last = m.start()
    return last if last is not None else boundary(text, low, high, levels[1:])


def spans(text: str, limit: int, least: int, overlap: int, levels: Sequence[re.Pattern]) -> list[tuple[int, int]]:
    """Character spans of the pieces of one text; one span if it fits, none if it is empty."""
    size, start, out = len(text), 0, []
    while size - start > limit:
        end = boundary(text, start + least, start + limit, levels)
        out.append((start, end))
        start = end - overlap
    if size:
        out.append((start, size))
    return out


def split_texts(df: DataFrame, id_col: str, text_col: str, *, limit: int = 1200, least: int = 600, overlap: int = 120, longer_than: int | None = None, levels: Sequence[str] = LEVELS, with_text: bool = False) -> DataFrame:
    """(<id_col>, piece, char_start, char_end, byte_start, byte_end[, piece_text]): the pieces of each row's text.

    Sizes count characters (code points); bytes are those of UTF-8. A piece has `limit` characters at most and, but for a text's
    last one, `least` or more. Only texts of more than `longer_than`
    characters give rows (default: all non-empty ones). Null and empty texts give none; repeated rows are split each for
    itself; null ids are kept; other columns are ignored. One narrow pass: no shuffle.
    """
    if not 0 <= overlap < least <= limit:
        raise ValueError("0 <= overlap < least <= limit is needed")
    least_size = 0 if longer_than is None else longer_than
    base = df.select(column(df, id_col).alias("id"), column(df, text_col).alias("text")).where(f"length(text) > {least_size}")
    kind = base.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(x) for x in levels]
        for b in sub_batches(batches, 500):
            rows, texts = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                at = where = 0  # a character position and its byte
                for k, (s, e) in enumerate(spans(text, limit, least, overlap, compiled)):
                    piece = text[s:e]
                    where += len(text[at:s].encode("utf-8", "surrogatepass"))
                    stop = where + len(piece.encode("utf-8", "surrogatepass"))
                    rows.append((i, k, s, e, where, stop))
                    if with_text:
                        texts.append(piece)
                    nxt = max(s, e - overlap)
                    where, at = where + len(text[s:nxt].encode("utf-8", "surrogatepass")), nxt
            a = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(a[:, 0])), pa.array(a[:, 1].astype(np.int32)), *(pa.array(a[:, j]) for j in range(2, 6)), *([pa.array(texts, pa.string())] if with_text else [])], names)

    names = ["id", "piece", "char_start", "char_end", "byte_start", "byte_end", *["piece_text"] * with_text]
    schema = f"id {kind}, piece int, char_start long, char_end long, byte_start long, byte_end long" + ", piece_text string" * with_text
    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)
