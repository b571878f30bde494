"""Command line: python -m corvane.cli VERB CORPUS ... ; every verb prints JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import CorvaneError
from .functions.embed import create_embedder
from .operators.evaluate import recall_at_k
from .operators.media import blob_totals, export_blobs
from .operators.workloads import measure, perturbed_queries
from .plans.corpus import Corpus, doctor
from .plans.pipeline import build_from_spec
from .sources.sinks import answer_pack
from .sources.spec import dry_run, load_spec


def _spark() -> SparkSession:
    return SparkSession.builder.appName("corvane").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _one(c: Corpus, vector: str, text: str | None = None):
    v = [float(x) for x in json.loads(vector)]
    return c.spark.createDataFrame([(0, v, text)], "qid long, query array<double>, text string")


def _benchmark(c: Corpus, a) -> dict:
    q = perturbed_queries(c.vectors, a.queries).persist()
    exact, other = c.search(q, a.k).persist(), c.search_ann(q, a.k, a.ef)
    recall = recall_at_k(other, exact, a.k).agg(F.avg("recall")).first()[0]
    timed = {name: measure(lambda f=f: f(q, a.k).count(), a.repeats) for name, f in (("exact", c.search), ("ann", c.search_ann))}
    return {"queries": a.queries, "recall": recall, "milliseconds": timed}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, corpus: bool = True, **options):
        v = verbs.add_parser(name)
        if corpus:
            v.add_argument("corpus")
        for o, kind in options.items():
            flag = f"--{o.replace('_', '-')}"
            if isinstance(kind, bool):
                v.add_argument(flag, action="store_true")
            elif kind in (str, int):
                v.add_argument(flag, type=kind, required=True)
            else:
                v.add_argument(flag, type=type(kind), default=kind)
        return v

    for name in ("inspect", "validate", "stats"):
        verb(name)
    verb("media", export="")
    verb("search", vector=str, k=10)
    verb("search-ann", vector=str, k=10, ef=100)
    verb("search-graph", vector=str, k=10, ef=100, hops=1)
    verb("search-space", space=str, vector=str, k=10, model_hash="")
    for name in ("search-text", "ask", "retrieve"):
        verb(name, text=str, k=5, embedder="lexical", dim=256)
    verb("benchmark", queries=50, k=10, ef=100, repeats=3)
    verb("cite", citation=str)
    verb("doctor", corpus=False)
    verb("build", corpus=False, spec=str, cache="", dry_run=False)
    return p


def run(a: argparse.Namespace, spark: SparkSession) -> object:
    """What a verb answers, as a value that JSON can hold."""
    if a.verb == "doctor":
        return doctor(spark)
    if a.verb == "build":
        spec = load_spec(a.spec)
        return dry_run(spec) if a.dry_run else {n: json.loads(c.manifest.to_json()) for n, c in build_from_spec(spark, spec, cache=a.cache or None).items()}
    c = Corpus.open(spark, a.corpus)
    if a.verb in ("inspect", "stats"):
        return c.inspect()
    if a.verb == "validate":
        c.validate()
        return {"valid": True, "content_hash": c.manifest.content_hash}
    if a.verb == "media":
        return {"exported": export_blobs(c.blobs, a.export)} if a.export else blob_totals(c.blobs).first().asDict()
    if a.verb == "cite":
        return c.cite(a.citation)
    if a.verb == "benchmark":
        return _benchmark(c, a)
    if a.verb in ("search-text", "ask", "retrieve"):
        return json.loads(answer_pack(c.ask(a.text, create_embedder(a.embedder, dim=a.dim), a.k), a.text))
    q = _one(c, a.vector)
    found, route = {
        "search": lambda: (c.search_vector([float(x) for x in json.loads(a.vector)], a.k), None),
        "search-ann": lambda: (c.search_ann(q, a.k, a.ef), "hnsw"),
        "search-graph": lambda: (c.search_graph(q, a.k, hops=a.hops, ef=a.ef), "graph"),
        "search-space": lambda: (c.search_space(a.space, q, a.k, model_hash=a.model_hash or None), "space"),
    }[a.verb]()
    return json.loads(answer_pack(found if route is None else c.hits(found, route), a.vector))


def main(arguments: list[str] | None = None) -> int:
    a = _parser().parse_args(arguments)
    try:
        print(json.dumps(run(a, _spark()), ensure_ascii=False, default=str))
    except CorvaneError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
