"""The manifest of a corpus, its rules, the build lock, and sidecar manifests."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from ..errors import ManifestError, ModelMismatch
from ..functions.identity import canonical_json

FORMAT_VERSION = SCHEMA_VERSION = 1
# What a reader understands.
DTYPES = ("float32", "float16", "int8", "int4")
INDEX_TYPES = ("exact", "hnsw", "hybrid")
RERANK_POLICIES = ("none", "exact")
SCORE_TYPES = ("cosine", "hybrid_rrf")
#: A model hash that stands for an unknown model.
PLACEHOLDER = "sha256:" + "0" * 64
#: Keys that tell where a build happened, not what it made.
LOCATIONS = frozenset({"path", "dir", "output", "built_at", "host"})


@dataclass
class Capabilities:
    exact: bool = True
    ann: bool = False
    bm25: bool = False
    graph: bool = False
    blobs: bool = False
    spaces: bool = False
    reproducible: bool = True


@dataclass
class Manifest:
    embedding_model: str
    embedding_dim: int
    model_hash: str
    chunker_version: str
    n_chunks: int
    dtype: str = "float32"
    metric: str = "ip"
    score_type: str = "cosine"
    normalize: str = "l2"
    index_type: str = "exact"
    rerank_policy: str = "none"
    full_precision: bool = False
    mrl_dim: int | None = None
    full_dim: int | None = None
    content_hash: str = ""
    file_hash: str = ""
    created: str = "1970-01-01T00:00:00Z"
    format_version: int = FORMAT_VERSION
    schema_version: int = SCHEMA_VERSION
    capabilities: Capabilities = field(default_factory=Capabilities)
    tables: dict[str, str] = field(default_factory=dict)
    provenance: dict[str, Any] = field(default_factory=dict)
    extra: dict[str, Any] = field(default_factory=dict)

    def contract(self) -> dict:
        """The part of the contract that the content hash covers: indexes don't move citations."""
        return {"metric": self.metric, "score_type": self.score_type, "normalize": self.normalize, "index_type": "exact", "rerank_policy": "none"}

    def search_contract(self) -> dict:
        """What a reader must know to search, indexes included; written beside the manifest and compared with it."""
        return {"metric": self.metric, "score_type": self.score_type, "normalize": self.normalize, "index_type": self.index_type, "rerank_policy": self.rerank_policy}

    def to_json(self) -> str:
        data = asdict(self)
        return canonical_json(data.pop("extra") | data)

    @classmethod
    def from_json(cls, text: str) -> "Manifest":
        """Unknown keys survive in `extra`."""
        data = json.loads(text)
        known = {f.name for f in fields(cls)} - {"extra"}
        mine = {k: v for k, v in data.items() if k in known}
        mine["capabilities"] = Capabilities(**{k: v for k, v in mine.get("capabilities", {}).items() if k in {f.name for f in fields(Capabilities)}})
        return cls(**mine, extra={k: v for k, v in data.items() if k not in known})

    def validate(self) -> None:
        c, multiple = self.capabilities, self.dtype != "int4" or self.embedding_dim % 64 == 0
        rules = [
            (self.format_version <= FORMAT_VERSION, f"format version {self.format_version} is newer than {FORMAT_VERSION}"),
            (self.schema_version <= SCHEMA_VERSION, f"schema version {self.schema_version} is newer than {SCHEMA_VERSION}"),
            (self.embedding_model, "embedding_model is empty"),
            (self.embedding_dim > 0, "embedding_dim must be positive"),
            (self.n_chunks > 0, "n_chunks must be positive"),
            (self.chunker_version, "chunker_version is empty"),
            (re.fullmatch(r"sha256:[0-9a-f]{64}", self.model_hash), "model_hash must be sha256: and 64 hex digits"),
            (self.dtype in DTYPES, f"dtype {self.dtype!r} is not supported"),
            (self.metric == "ip", f"metric {self.metric!r} is not supported"),
            (self.score_type in SCORE_TYPES, f"score_type {self.score_type!r} is not supported"),
            (self.normalize == "l2", f"normalize {self.normalize!r} is not supported"),
            (self.index_type in INDEX_TYPES, f"index_type {self.index_type!r} is not supported"),
            (self.rerank_policy in RERANK_POLICIES, f"rerank_policy {self.rerank_policy!r} is not supported"),
            (self.index_type == "exact" or self.rerank_policy == "exact", f"index_type {self.index_type} needs rerank_policy exact"),
            (c.exact, "the exact path is required"),
            (c.reproducible, "a reproducible build is required"),
            (self.index_type != "hnsw" or c.ann, "index_type hnsw needs the ann capability"),
            (self.index_type != "hybrid" or c.bm25, "index_type hybrid needs the bm25 capability"),
            (multiple, "int4 needs a dimension that is a multiple of 64"),
            ((self.mrl_dim is None) == (self.full_dim is None), "mrl_dim and full_dim go together"),
        ]
        if self.mrl_dim is not None and self.full_dim is not None:
            rules += [
                (self.mrl_dim > 0, "mrl_dim must be positive"),
                (self.mrl_dim <= self.full_dim, "mrl_dim is larger than full_dim"),
                (self.mrl_dim == self.embedding_dim, "mrl_dim must be the stored dimension"),
            ]
        for ok, message in rules:
            if not ok:
                raise ManifestError(message)


def check_model(manifest: Manifest, model_hash: str, *, model: str | None = None, dim: int | None = None, allow_placeholder: bool = False) -> None:
    """Refuse a query of another model. The placeholder matches nothing unless that is allowed."""
    if model is not None and model != manifest.embedding_model:
        raise ModelMismatch(f"the query's model is {model}, the corpus's {manifest.embedding_model}")
    if dim is not None and dim != manifest.embedding_dim:
        raise ModelMismatch(f"the query has {dim} dimensions, the corpus {manifest.embedding_dim}")
    if manifest.model_hash == PLACEHOLDER:
        if not allow_placeholder:
            raise ModelMismatch("the corpus doesn't say which model made it")
        return
    if model_hash != manifest.model_hash:
        raise ModelMismatch(f"the query's model hash is {model_hash}, the corpus's {manifest.model_hash}")


def differences(a: Any, b: Any, where: str = "") -> list[str]:
    """Places where two manifests differ, apart from where they were built."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in sorted(set(a) | set(b)):
            if k not in LOCATIONS:
                at = f"{where}.{k}" if where else k
                out += differences(a[k], b[k], at) if k in a and k in b else [f"{at}: only in the {'first' if k in a else 'second'}"]
        return out
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [d for i, (x, y) in enumerate(zip(a, b, strict=True)) for d in differences(x, y, f"{where}[{i}]")]
    return [] if a == b else [f"{where}: {a!r} and {b!r}"]


def build_lock(manifest: Manifest, spec: dict) -> dict:
    return {"spec": spec, "model_hash": manifest.model_hash, "content_hash": manifest.content_hash, "n_chunks": manifest.n_chunks, "tables": manifest.tables}


def check_lock(lock: dict, now: dict) -> None:
    found = differences(lock, now)
    if found:
        raise ManifestError("the build differs from its lock: " + "; ".join(found[:5]))


def redact(path: str, level: str) -> str:
    """minimal: the name alone; standard: the last two parts; full: as it is."""
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    return path if level == "full" else "/".join(parts[-(1 if level == "minimal" else 2) :])
