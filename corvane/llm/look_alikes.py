"""Problem 3: visually identical text with different characters.

In SQL, one translate() maps look-alike letters, width forms and blanks and deletes invisible characters, and ligatures are
replaced; what isn't ASCII then is composed (NFC). The mapped values are grouped under the accent- and case-sensitive Unicode
collation. Each class gets a canonical member, joined back to all its records.

The collation alone calls more equal than looks equal: at its strength the digits of all scripts are one, and so are bold and italic
mathematical letters. So an exact check follows, and a class holds the texts of one composed form. The first partition is by
the form without any mark, decomposed: a function of the composed form, so it never parts two texts of a class, in any script.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_semi, column, materialize

# Look-alike letters of Cyrillic and Greek, and the Latin letters they look like in usual fonts. Left out are letters that
# only resemble a Latin one of the other case or of another script's style, such as small Cyrillic er with tick or Greek eta.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
}
#: Latin ligatures and the letters they join.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Format characters show nothing, but for the signs that enclose the digits after them (fixed values); nor do variation selectors, fillers and joiners (fixed values).
_SHOWN = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_HIDDEN = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
INVISIBLE = "".join(sorted({chr(cp) for cp in range(0x110000) if unicodedata.category(chr(cp)) == "Cf" and cp not in _SHOWN} | set(map(chr, _HIDDEN))))
#: Blanks that stand for one space.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def _rules() -> dict[str, str]:
    """Single characters and their replacements; width forms follow by rule."""
    rules = dict(LOOK_ALIKES) | {c: " " for c in BLANKS}
    for cp in range(0xFF00, 0xFFF0):
        to = unicodedata.normalize("NFKC", chr(cp))
        if len(to) == 1 and to != chr(cp) and chr(cp) not in INVISIBLE:
            rules.setdefault(chr(cp), to)
    return rules


#: Every combining mark.
_MARKS = re.compile("[" + "".join(chr(cp) for cp in range(0x110000) if unicodedata.combining(chr(cp))) + "]+")


def visible_form(text: Column) -> Column:
    """The text with look-alikes, width forms, ligatures and blanks mapped and invisible characters gone; not yet composed."""
    for one, several in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(several))
    return F.translate(text, "".join(_rules()) + INVISIBLE, "".join(_rules().values()))


_LETTERS, _OTHER_SCRIPTS = str.maketrans(LOOK_ALIKES), re.compile("[\u0370-\u052f]")


def _apart(text: str) -> str:
    """Decomposed, so that a look-alike under an accent is mapped like one without."""
    text = unicodedata.normalize("NFD", text)
    return text.translate(_LETTERS) if _OTHER_SCRIPTS.search(text) else text


def _compose(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", _apart(x)) for x in text.to_pylist()], pa.string())


def _without_marks(text: pa.Array) -> pa.Array:
    """Decomposed and without combining marks, the same for all texts of one composed form."""
    return pa.array([None if x is None else _MARKS.sub("", _apart(x)) for x in text.to_pylist()], pa.string())


def _beyond_ascii(f, text: Column) -> Column:
    """f of a text that isn't ASCII, in Arrow batches; ASCII texts, most of them, have nothing to compose and stay in SQL."""
    return F.coalesce(F.arrow_udf(f, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def look_alike_classes(df: DataFrame, key_col: str, text_col: str, *, by: str | None = None) -> DataFrame:
    """([by,] key, text, canonical): every record whose text looks the same as another record's different text.

    canonical is the class's smallest text by its UTF-8 bytes, so the same for the same set of texts. Classes of one text, however
    often it occurs, are not part of the result. Null texts, and texts of nothing but blanks and invisible
    characters, take no part; null keys are kept. Letter case, accents, punctuation, the number of blanks, tabs and line
    breaks stay different. `by` names a column whose values part the records into collections that are looked at each for itself, in one
    pass. Other columns are ignored. Jobs run when it is called.
    """
    group = ["by"] if by is not None else []
    base = df.select(*([column(df, by).alias("by")] if group else []), column(df, key_col).alias("key"), column(df, text_col).alias("text")).where("text is not null")
    visible = base.withColumn("form", visible_form(F.col("text")))
    h = F.xxhash64(*group, _beyond_ascii(_without_marks, F.col("form")))
    # First partition, 16 bytes a record. Only classes of several different texts go on.
    digests = visible.where(F.col("form").rlike(r"\S")).select(h.alias("h"), F.xxhash64("text").alias("t"))
    several = digests.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi")
    several = materialize(several.select("h"), "look-alike-partitions")
    candidates = materialize(checked_semi(visible.withColumn("h", h), several, "h").select(*group, "key", "text"), "look-alike-candidates")
    texts = candidates.select(*group, "text").distinct().withColumn("form", _beyond_ascii(_compose, visible_form(F.col("text"))))
    mapped = texts.withColumn("class", F.collate("form", "UNICODE"))
    classes = mapped.groupBy(*group, "class", "form").agg(F.min("text").alias("canonical"), F.count("*").alias("texts")).where("texts > 1")
    members = mapped.drop("class").join(classes.select(*group, "form", "canonical"), [*group, "form"]).select(*group, "text", "canonical")
    return materialize(candidates.join(members, [*group, "text"]).select(*group, "key", "text", "canonical"), "look-alikes")


def look_alike_pairs(classes: DataFrame) -> DataFrame:
    """([by,] key_a, key_b), key_a < key_b: the pairs of records of one class whose texts differ.

    Texts are paired first and records joined to them, so records with equal texts never meet each other.
    """
    group = ["by"] if "by" in classes.columns else []
    texts = classes.select(*group, "canonical", "text").distinct()
    a, b = (texts.select(*group, "canonical", F.col("text").alias(f"text_{x}")) for x in "ab")
    pairs = a.join(b, [*group, "canonical"]).where("text_a < text_b").select(*group, "text_a", "text_b")
    for x in "ab":
        pairs = pairs.join(classes.select(*group, F.col("text").alias(f"text_{x}"), F.col("key").alias(f"k{x}")), [*group, f"text_{x}"])
    return pairs.where("ka != kb").select(*group, F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
