"""Physical bundles of a corpus, and the grammar of benchmark variants."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Preset:
    codec: str
    dtype: str
    ann: bool = False
    bm25: bool = False


# Names and what they stand for.
PRESETS = {
    "exact": Preset("uncompressed", "float32"),
    "compressed": Preset("zstd", "float16"),
    "tiny": Preset("zstd", "int8", ann=True),
    "nano": Preset("zstd", "int4", ann=True),
    "hybrid": Preset("zstd", "float32", ann=True, bm25=True),
}


@dataclass(frozen=True)
class Variant:
    preset: str
    mrl_dim: int = 0


def parse_variant(name: str) -> Variant:
    """A preset's name, `micro`, or `mrl<dim>-int8` / `mrl<dim>-int4`."""
    if name in PRESETS:
        return Variant(name)
    if name == "micro":
        return Variant("tiny", 256)
    m = re.fullmatch(r"mrl([1-9]\d*)-(int8|int4)", name)
    if not m:
        raise ValueError(f"unknown variant {name!r}")
    return Variant("tiny" if m[2] == "int8" else "nano", int(m[1]))
