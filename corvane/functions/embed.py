"""Embedders: a protocol, the deterministic lexical one, a test double, and a registry.

An embedder is a picklable object with `dim`, `model`, `fingerprint()` and `embed(list of texts) -> list of vectors`;
embed_column() runs it over Arrow batches, one instance per Python worker.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import re
import subprocess
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import fingerprint_hash
from .vectors import FLOATS


class Embedder(Protocol):
    dim: int
    model: str

    def fingerprint(self) -> dict: ...

    def embed(self, texts: list[str]) -> list[np.ndarray]: ...


_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=100_000)
def _word_vector(word: str, dim: int, stream: str) -> np.ndarray:
    """A word's fixed direction: one SHAKE-256 output of the word under the stream's name, two bytes a member."""
    raw = hashlib.shake_256(f"{stream}/{word}".encode()).digest(2 * dim)
    return np.frombuffer(raw, "<i2").astype(np.float64)


class LexicalEmbedder:
    """The direction of the sum of fixed word vectors: no model files, the same on every machine. A text without words gets the first axis."""

    def __init__(self, dim: int = 256, seed: str = "corvane-lexical-v2"):
        self.dim, self.seed, self.model = dim, seed, f"lexical-{dim}/v2"

    def fingerprint(self) -> dict:
        return {"kind": "lexical", "revision": 2, "dimensions": self.dim, "stream": self.seed, "words": "runs of letters and digits, lower case", "combine": "sum of unit length"}

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in _WORD.findall((text or "").lower()):
                out[i] += _word_vector(word, self.dim, self.seed)
        norm = np.linalg.norm(out, axis=1)
        out[norm == 0, 0] = norm[norm == 0] = 1
        return list((out / norm[:, None]).astype(np.float32))


class TableEmbedder:
    """A static table of token vectors: the mean of a text's rows, of length 1.

    The folder holds tokenizer.json (of the `tokenizers` library) and vectors.npy (one row a token id); both are part of the
    fingerprint, so another table never passes for this one. Texts without a token get the row of `unknown`. Files are read where
    they are first needed, from a path that all workers can read.
    """

    def __init__(self, folder: str, *, unknown: str = "[UNK]", model: str = "table"):
        self.folder, self.unknown = folder, unknown
        self._loaded = None
        with open(os.path.join(folder, "vectors.npy"), "rb") as f:
            np.lib.format.read_magic(f)
            (self.rows, self.dim), _, _ = np.lib.format.read_array_header_1_0(f)
        self.model = f"{model}-{self.dim}"

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def fingerprint(self) -> dict:
        def digest(name: str) -> str:
            with open(os.path.join(self.folder, name), "rb") as f:
                return hashlib.file_digest(f, "sha256").hexdigest()

        return {"kind": "table", "revision": 1, "dimensions": self.dim, "vectors": digest("vectors.npy"), "tokenizer": digest("tokenizer.json"), "unknown": self.unknown, "combine": "mean of unit length"}

    def _open(self):
        if self._loaded is None:
            from tokenizers import Tokenizer

            tokens = Tokenizer.from_file(os.path.join(self.folder, "tokenizer.json"))
            unknown = tokens.token_to_id(self.unknown)
            self._loaded = tokens, np.load(os.path.join(self.folder, "vectors.npy"), mmap_mode="r"), 0 if unknown is None else unknown
        return self._loaded

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        tokens, table, unknown = self._open()
        ids = [e.ids or [unknown] for e in tokens.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        rows = np.asarray(table[np.concatenate([np.array(x, np.int64) for x in ids])], np.float64) if len(ids) else np.zeros((0, self.dim))
        means = np.add.reduceat(rows, np.cumsum(sizes) - sizes) / sizes[:, None] if len(ids) else rows
        norm = np.linalg.norm(means, axis=1, keepdims=True)
        return list((means / np.where(norm > 0, norm, 1)).astype(np.float32))


class CommandEmbedder:
    """An embedder that runs as another program, one process a worker: a JSON line of texts goes in, a JSON line of vectors comes out.

    For models whose libraries must not live in the worker. The program is asked for its fingerprint with the line `null`, and must
    answer with an object that has `dimensions`; it is part of the model hash.
    """

    def __init__(self, command: list[str], *, model: str = "command"):
        self.command, self._running = command, None
        self._about = self._ask(None)
        if not isinstance(self._about, dict) or not isinstance(self._about.get("dimensions"), int):
            raise ValueError(f"{command[0]}: the program must answer null with an object that has dimensions")
        self.dim, self.model = self._about["dimensions"], f"{model}-{self._about['dimensions']}"

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_running": None}

    def fingerprint(self) -> dict:
        return {"kind": "command", "revision": 1} | self._about

    def _ask(self, message):
        if self._running is None or self._running.poll() is not None:
            self._running = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
            atexit.register(self._running.kill)
        self._running.stdin.write(json.dumps(message) + "\n")
        self._running.stdin.flush()
        line = self._running.stdout.readline()
        if not line:
            raise RuntimeError(f"{self.command[0]}: the program ended with {self._running.wait()}")
        return json.loads(line)

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        found = [np.array(v, np.float32) for v in self._ask([x or "" for x in texts])]
        if len(found) != len(texts) or any(len(v) != self.dim for v in found):
            raise RuntimeError(f"{self.command[0]}: {len(texts)} vectors of {self.dim} were asked for")
        return found


class FakeEmbedder:
    """For tests: a vector of the text's digest."""

    def __init__(self, dim: int = 8):
        self.dim, self.model = dim, f"fake-{dim}"

    def fingerprint(self) -> dict:
        return {"kind": "fake", "dimensions": self.dim}

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return self.embed_images([(x or "").encode() for x in texts])

    def embed_images(self, images: list[bytes]) -> list[np.ndarray]:
        out = []
        for data in images:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(data).digest()[:8], "little")).normal(size=self.dim)
            out.append((v / np.linalg.norm(v)).astype(np.float32))
        return out


def embed_images_column(data: Column | str, embedder) -> Column:
    """array<float> of each image's bytes, by embed_images(list of bytes) of the embedder; null data gives null."""

    @F.pandas_udf(FLOATS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series([None] * len(s), dtype=object)
            there = [i for i, x in enumerate(s) if x is not None]
            for i, v in zip(there, embedder.embed_images([bytes(s.iloc[i]) for i in there]), strict=True):
                out.iloc[i] = v
            yield out

    return run(data)


_REGISTRY: dict[str, Callable[..., Embedder]] = {"lexical": LexicalEmbedder, "table": TableEmbedder, "command": CommandEmbedder, "fake": FakeEmbedder}


def register_embedder(name: str, factory: Callable[..., Embedder]) -> None:
    """Make a model-backed embedder available under a name."""
    _REGISTRY[name] = factory


def create_embedder(name: str, **settings) -> Embedder:
    if name not in _REGISTRY:
        raise ValueError(f"unknown embedder {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name](**settings)


def model_hash(embedder: Embedder) -> str:
    return fingerprint_hash(embedder.fingerprint())


def embed_column(text: Column | str, embedder: Embedder) -> Column:
    """array<float> of each text; null texts count as empty."""

    @F.pandas_udf(FLOATS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(embedder.embed([x or "" for x in s]))

    return run(text)


def embed_missing(chunks: DataFrame, cache: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(all embeddings, newly computed cache rows): only chunks whose (chunk_id, model hash) the cache lacks are embedded.

    cache has chunk_id, model_hash, embedding. Equal chunk ids are embedded once.
    """
    key = model_hash(embedder)
    mine = cache.where(F.col("model_hash") == key).select("chunk_id", "model_hash", "embedding").dropDuplicates(["chunk_id"])
    misses = chunks.select("chunk_id", "canonical_text").dropDuplicates(["chunk_id"]).join(mine, "chunk_id", "left_anti")
    fresh = misses.select("chunk_id", F.lit(key).alias("model_hash"), embed_column("canonical_text", embedder).alias("embedding"))
    return mine.unionByName(fresh), fresh
