"""Problem 9: mixing sources to target weights, by Poisson replication.

Every document has one hash-seeded uniform number; a source's Poisson distribution is inverted at it, cut at
the source's cap of repeats, and the document is exploded by the result. A source's mean repetition rate is
fitted so that the tokens its documents really give meet the source's share of the total: for a fixed number per document
the sum only rises with the rate, so a few passes over a grid of rates close in on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize
from .tokenize_corpus import count_tokens

#: Rates tried in a pass, and passes; the last interval is (largest rate) / 32^5 wide.
_GRID, _PASSES = 33, 5


def poisson_steps(rate: float, cap: int) -> list[float]:
    """CDF at 0 .. cap-1: a document with number u is taken once for each step below u, so at most `cap` times."""
    p = total = exp(-rate)
    out = []
    for k in range(1, cap + 1):
        out.append(min(total, 1.0))
        p *= rate / k
        total += p
    return out


def _largest_rate(cap: int) -> float:
    """A rate at which practically every document is taken `cap` times."""
    return cap + 12 * sqrt(cap) + 40 if cap else 0.0


def _reached(counted: DataFrame, rates: dict[str, list[float]], caps: dict[str, int]) -> dict[str, list[int]]:
    """Tokens that each source gives at each of its rates; one row a source and block is shuffled."""
    width = len(next(iter(rates.values())))
    steps = {s: np.array([poisson_steps(r, caps[s]) for r in rs]) for s, rs in rates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            source, tokens, u = np.array(b.column("source").to_pylist(), object), b.column("tokens").to_numpy(), b.column("u").to_numpy()
            for s in set(source.tolist()) & set(steps):
                mine = source == s
                order = np.argsort(u[mine])
                us, tail = u[mine][order], np.r_[np.cumsum(tokens[mine][order][::-1])[::-1], 0]
                # a step below u takes the document once: tokens above each step, summed over steps
                sums[s] = sums.get(s, 0) + tail[np.searchsorted(us, steps[s], side="right")].sum(1)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([int(sums[k][j]) for k in keys], pa.int64()) for j in range(width))], ["source", *(f"g{j}" for j in range(width))])

    rows = counted.mapInArrow(run, "source string, " + ", ".join(f"g{j} long" for j in range(width)))
    return {r[0]: list(r[1:]) for r in rows.groupBy("source").agg(*(F.sum(f"g{j}") for j in range(width))).collect()}


def mix_sources(documents: DataFrame, targets: DataFrame, *, id_col: str, text_col: str, source_col: str, seed: int = 17, total_tokens: int | None = None, vocabulary: str | None = None, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) for targets(source, weight, max_repeats), one row a source.

    mixture(<id_col>, copy, source, tokens, position[, carried columns]): copy counts from 1; position is a hash, by which
    the rows are globally ordered. report(source, weight, max_repeats, documents, available_tokens, target_tokens,
    tokens, share, mean_repeats) has every row of targets; share is of the tokens really taken.

    Without total_tokens the total is the largest that lets every source with tokens reach weight * total within its cap.
    With it, a source whose share is beyond its cap gives every document `max_repeats` times and falls short, as the report
    shows. Sources without tokens give nothing. Documents of other or null sources, and
    without tokens (null and empty texts), are not taken. Targets with a null or negative weight or cap count as 0; of repeated sources the
    largest row counts. The targets are read by the driver: one small row per source.
    """
    wanted = targets.groupBy("source").agg(F.max(F.struct("weight", "max_repeats")).alias("t")).where("source is not null").select("source", "t.weight", "t.max_repeats").collect()
    weight = {r.source: max(r.weight or 0.0, 0.0) for r in wanted}
    caps = {r.source: max(r.max_repeats or 0, 0) for r in wanted}
    spark = documents.sparkSession
    ids = column(documents, id_col)
    rows = documents.select(ids.alias("id"), column(documents, source_col).alias("source"), column(documents, text_col).alias("text"), *(column(documents, c).alias(f"carry{i}") for i, c in enumerate(carry)))
    rows = rows.where(F.col("source").isin(list(weight)) & (F.length("text") > 0))
    counted = count_tokens(rows, ["id", "source", *(f"carry{i}" for i in range(len(carry)))], "text", vocabulary=vocabulary).where("tokens > 0")
    u = (F.xxhash64("id", F.lit(seed)).bitwiseAND((1 << 53) - 1).cast("double") + 0.5) / float(1 << 53)
    counted = materialize(counted.withColumn("u", u), "token-counts")
    have = {r[0]: (r[1], r[2]) for r in counted.groupBy("source").agg(F.count("*"), F.sum("tokens")).collect()}
    able = {s: have[s][1] for s in have if weight[s] > 0 and caps[s] > 0}
    total = min((caps[s] * n / weight[s] for s, n in able.items()), default=0.0)
    total = float(total_tokens) if total_tokens is not None else total
    low, high = {s: 0.0 for s in able}, {s: _largest_rate(caps[s]) for s in able}
    rate: dict[str, float] = {}
    taken: dict[str, int] = {}
    for _ in range(_PASSES if able else 0):
        rates = {s: np.linspace(low[s], high[s], _GRID).tolist() for s in able}
        for s, got in _reached(counted.select("source", "tokens", "u"), rates, caps).items():
            goal = weight[s] * total
            j = int(np.argmin([abs(g - goal) for g in got]))
            rate[s], taken[s] = rates[s][j], got[j]
            over = int(np.searchsorted(got, goal))
            low[s], high[s] = rates[s][max(over - 1, 0)], rates[s][min(over, _GRID - 1)]
    steps = spark.createDataFrame([(s, poisson_steps(r, caps[s])) for s, r in rate.items()], "source string, steps array<double>")
    copies = F.size(F.filter("steps", lambda x: x < F.col("u")))
    mixed = counted.join(F.broadcast(steps), "source").withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    mixed = mixed.select(F.col("id").alias(id_col), "copy", "source", "tokens", F.xxhash64("id", "copy", F.lit(seed + 1)).alias("position"), *(F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)))
    everything = sum(taken.values()) or 1
    said = [(s, weight[s], caps[s], *have.get(s, (0, 0)), int(weight[s] * total) if s in able else 0, taken.get(s, 0), taken.get(s, 0) / everything, taken.get(s, 0) / have[s][1] if s in have and have[s][1] else 0.0) for s in sorted(weight)]
    report = spark.createDataFrame(said, "source string, weight double, max_repeats int, documents long, available_tokens long, target_tokens long, tokens long, share double, mean_repeats double")
    return mixed.orderBy("position"), report
