"""Problem 8: encoding of a whole corpus with a public byte-level BPE tokenizer, as a streaming transducer.

Byte-pair encoding is usually defined by repeated merging over a whole piece of text. Here the encoding is
built from left to right instead. A token sequence is the encoding of its bytes exactly if every adjacent
pair of its tokens is, so the last token of each prefix's encoding follows from the last tokens of shorter
prefixes, no further back than the longest token. Once all prefixes that a later token may still start from
share a common token end, the tokens up to it can never change. The merge list bounds how late that happens, see
sufficient_lookahead(): a token that ends so many bytes before the last byte read is stable. It is emitted, and its
state is dropped.

The split before the merges is the tokenizer's fixed pattern, and a stream too: see pieces(). So a text of any length
is encoded in constant memory beside it. Pieces that recur are encoded once per worker, in a table of bounded size.
"""

from __future__ import annotations

import codecs
import hashlib
import importlib.util
import json
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, list_array, sub_batches

#: The pattern that splits a text before the merges; a fixed value of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Recurring pieces of at most so many characters are remembered, at most so many of them.
_REMEMBER_CHARS, _REMEMBER = 64, 300_000


#: Characters of a text that are split at once, and from which on a piece that is still open is handed on in parts.
_PART, _OPEN = 65_536, 4096
#: The largest vocabulary file that is sent to the workers.
VOCABULARY_BYTES = 64 << 20


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.json on the driver: in $CORVANE_TOKENIZERS, else in the public_tokenizers package."""
    folder = os.environ.get("CORVANE_TOKENIZERS")
    if not folder:
        found = importlib.util.find_spec("public_tokenizers")
        if found is None or not found.submodule_search_locations:
            raise FileNotFoundError("no vocabulary: give its path, or set CORVANE_TOKENIZERS to the folder of byte_bpe_50k.json")
        folder = list(found.submodule_search_locations)[0]
    return os.path.join(folder, "byte_bpe_50k.json")


def _printable_bytes() -> dict[str, int]:
    """The vocabulary file writes each byte as one printable character; this is the inverse of that rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairTransducer:
    """Streaming encoder and decoder for one vocabulary; one instance per worker process."""

    def __init__(self, file: bytes):
        import regex

        model = json.loads(file)["model"]
        to_byte = _printable_bytes()
        vocabulary = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        self.ids = vocabulary
        self.bytes_of = {i: t for t, i in vocabulary.items()}
        self.merge: dict[tuple[int, int], int] = {}  # pair -> rank
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right
        for rank, m in enumerate(model["merges"]):
            a, b = (vocabulary[bytes(to_byte[c] for c in x)] for x in (m.split(" ") if isinstance(m, str) else m))
            self.merge[a, b] = rank
            self.made.setdefault(vocabulary[self.bytes_of[a] + self.bytes_of[b]], (rank, a, b))
        for special in [t for t, i in vocabulary.items() if len(t) > 1 and i not in self.made]:
            del vocabulary[special]  # no merge makes it: its text is ordinary text
        self.endings = {t[k:] for t in vocabulary for k in range(len(t))}
        self.longest = max(map(len, vocabulary))
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN)
        #: What a piece that is still open goes on with, by the class of its last character.
        self.classes = [regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*")]

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(token, rank at which it is merged away), from the outermost byte up to the token itself."""
        out = [(token, float("inf"))]
        while out[-1][0] in self.made:
            made = self.made[out[-1][0]]
            out.append((made[side], made[0]))
        return out[::-1]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their bytes: no merge across the border ever comes first."""
        ok = self.fits.get((a, b))
        if ok is None:
            left, right = self._spine(a, 2), self._spine(b, 1)
            i = j = 0
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.merge.get((x, y), float("inf"))
                if across < x_ends and across <= y_ends and across < float("inf"):
                    ok = False
                    break
                if x_ends == y_ends == float("inf"):
                    ok = True
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[a, b] = ok
        return ok

    def sufficient_lookahead(self) -> int:
        """Bytes after which no later byte can change a token, at most.

        Appending bytes can undo the merge at a piece's end; that frees the merge's left part, which may then
        be taken by a merge of higher rank to its left, and so on. Such a chain goes through merges whose
        right part is the former one's left part and whose rank is higher. Its longest length, over the
        merge list, times the longest token bounds the bytes that are still open.
        """
        by_right: dict[int, list[tuple[int, int]]] = {}
        for (a, b), rank in self.merge.items():
            by_right.setdefault(b, []).append((rank, a))
        longest: dict[tuple[int, int], int] = {}
        for (a, b), rank in sorted(self.merge.items(), key=lambda x: -x[1]):
            longest[a, b] = 1 + max((longest[c, a] for r, c in by_right.get(a, ()) if r > rank), default=0)
        return (max(longest.values(), default=0) + 1) * self.longest

    @cached_property
    def lookahead(self) -> int:
        return self.sufficient_lookahead()

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece that arrives in parts. Of the open bytes never more than 2 * lookahead and a little are held."""
        ids, endings, adjacent = self.ids, self.endings, self.adjacent
        data, last = b"", [(-1, -1)]  # of each open position: the token that ends there, and where that token starts
        for part in parts:
            for at in range(0, len(part), 4096):
                data += part[at : at + 4096]
                while (i := len(last)) <= len(data):
                    size = 1
                    while size <= i and (tail := data[i - size : i]) in endings:
                        token = ids.get(tail)
                        if token is not None:
                            before = last[i - size][0]
                            if before < 0 or adjacent(before, token):
                                last.append((token, i - size))
                                break
                        size += 1
                    else:
                        raise ValueError("the vocabulary lacks a byte")
                if len(data) > 8192 and len(data) >= 2 * self.lookahead:
                    stable = len(data)
                    while stable > len(data) - self.lookahead:
                        stable = last[stable][1]
                    yield from self._back(last, stable)
                    # position 0 of the open part keeps its token, for the test of adjacency
                    data, last = data[stable:], [(last[stable][0], 0), *((t, s - stable) for t, s in last[stable + 1 :])]
        yield from self._back(last, len(last) - 1)

    @staticmethod
    def _back(last: list, at: int) -> list[int]:
        out = []
        while at > 0:
            token, at = last[at]
            out.append(token)
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        return list(self.stream((piece,)))

    def pieces(self, parts: Iterable[str]) -> Iterator[tuple[str, bool]]:
        """(characters, whether a piece ends with them) of a text that arrives in parts.

        A match is final once three characters and another match follow it: no later character can change it, as the pattern
        looks at most two characters ahead of what it takes. Only one kind of piece has no bound, a run of one class; a
        long one is handed on in parts. A run of blanks keeps its last one back, which may belong to the word that follows.
        """
        text, run = "", None
        for part in parts:
            text += part
            if run is not None:
                end, blanks = run.match(text).end(), run is self.classes[3]
                whole = end == len(text)
                end -= blanks and end > 0
                yield text[:end], not whole
                text = text[end:]
                if whole:
                    continue
                run = None
            spans = [m.span() for m in self.split.finditer(text)]
            safe = 0
            while safe < len(spans) - 1 and spans[safe][1] + 3 <= len(text):
                yield text[slice(*spans[safe])], True
                safe += 1
            if safe < len(spans):
                at = spans[safe][0]
                text = text[at:]
                if safe == len(spans) - 1 and len(text) > max(_OPEN, 3):  # longer than the fixed endings of the pattern
                    run = next(c for c in self.classes if c.fullmatch(text[-1]))
                    end = len(text) - (run is self.classes[3])
                    yield text[:end], False
                    text = text[end:]
        if run is not None:
            yield text, True
        else:
            for piece in self.split.findall(text):
                yield piece, True

    def encode_parts(self, parts: Iterable[str]) -> Iterator[int]:
        """Token ids of a text that arrives in parts."""
        found = self.pieces(parts)

        def rest(first: str) -> Iterator[bytes]:
            yield first.encode("utf-8", "replace")
            for more, end in found:
                yield more.encode("utf-8", "replace")
                if end:
                    return

        for piece, end in found:
            yield from self._piece(piece) if end else self.stream(rest(piece))

    def _piece(self, piece: str) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "replace")
            one = self.ids.get(raw)
            ids = [one] if one is not None else self.encode_piece(raw)
            if len(piece) <= _REMEMBER_CHARS:
                if len(self.known) >= _REMEMBER:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; null and empty texts give the empty list."""
        out: list[int] = []
        if not text:
            return out
        if len(text) > _PART:
            return list(self.encode_parts(text[i : i + _PART] for i in range(0, len(text), _PART)))
        known, piece_ids = self.known, self._piece
        for piece in self.split.findall(text):
            out += known.get(piece) or piece_ids(piece)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, by an incremental UTF-8 state machine: a character may spread over several tokens."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        return "".join(machine.decode(self.bytes_of[i]) for i in ids) + machine.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> BytePairTransducer:
    with open(path, "rb") as f:
        return BytePairTransducer(f.read())


_LOADED: dict[str, BytePairTransducer] = {}  # of this worker, by the digest of the vocabulary


def shipped(spark: SparkSession, path: str) -> Callable[[], BytePairTransducer]:
    """The vocabulary is read on the driver and broadcast, so that executors need no such file; what is returned gives a worker its transducer."""
    size = os.path.getsize(path)
    if size > VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary of at most {VOCABULARY_BYTES} is sent to the workers")
    with open(path, "rb") as f:
        file = f.read()
    return partial(_load, hashlib.sha256(file).hexdigest(), spark.sparkContext.broadcast(zlib.compress(file, 1)))


def _load(name: str, shared) -> BytePairTransducer:
    # a function of the module, so that workers share its table; a nested one would be sent with a table of its own to every task
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = BytePairTransducer(zlib.decompress(shared.value))
    return _LOADED[name]


def encode_corpus(df: DataFrame, id_col: str, text_col: str, *, vocabulary: str | None = None) -> DataFrame:
    """(<id_col>, ids): one row per input row, ids an array of ints; null and empty texts get the empty list.

    Rows stay rows: repeated ids and rows are kept, null ids too, other columns are ignored. One narrow pass: no shuffle.
    """
    load = shipped(df.sparkSession, vocabulary or default_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load().encode
        for b in sub_batches(batches, 500):
            lists = [np.array(encode(x), np.int32) for x in b.column(1).to_pylist()]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(np.concatenate(lists) if lists else np.zeros(0, np.int32), lengths, pa.int32())], ["id", "ids"])

    base = df.select(column(df, id_col).alias("id"), column(df, text_col).alias("text"))
    return base.mapInArrow(run, f"id {base.schema[0].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, *, vocabulary: str | None = None) -> DataFrame:
    """(<id_col>, text): the inverse of encode_corpus; null and empty lists give the empty text, bytes that are no UTF-8 the replacement character."""
    load = shipped(df.sparkSession, vocabulary or default_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load().decode
        for b in sub_batches(batches, 500):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    base = df.select(column(df, id_col).alias("id"), column(df, ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(run, f"id {base.schema[0].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, keep: list[str], text_col: str, *, vocabulary: str | None = None) -> DataFrame:
    """The columns `keep` and tokens: the number of ids of each row's text, 0 for null and empty ones."""
    load = shipped(df.sparkSession, vocabulary or default_vocabulary())
    base = df.select(*(column(df, c).alias(f"c{i}") for i, c in enumerate(keep)), column(df, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load().encode
        for b in sub_batches(batches, 500):
            n = [len(encode(x)) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*(f"c{i}" for i in range(len(keep))), "tokens"])

    fields = ", ".join(f"c{i} {base.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    out = base.mapInArrow(run, f"{fields}, tokens long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "tokens")
