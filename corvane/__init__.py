"""Semantic retrieval and corpus analytics on PySpark."""

from .plans.corpus import Corpus, build_corpus, doctor
from .plans.pipeline import build_from_spec, emit
from .sources.spec import load_spec

__version__ = "0.2.0"
__all__ = ["Corpus", "build_corpus", "build_from_spec", "doctor", "emit", "load_spec"]
