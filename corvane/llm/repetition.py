"""Problem 10: repetition inside a single document, judged by weak supervision.

Each text is measured: shares of repeated word windows, sentences, lines and paragraphs, and of its most
frequent window. Rules turn a measure into a vote (repetitive or not) or abstain where a text has too little of
it. Expectation-maximisation over the counts of vote patterns estimates how accurate each rule is, and every
document gets a posterior probability in place of a filter that all rules must pass.

A rule may be trusted: where it votes it is right by definition, so its accuracy is given and not estimated. The others' estimates
then rest on it instead of on their agreement with each other, and where it abstains they decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHasher, column, materialize, sub_batches, windows_of

_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")


@dataclass(frozen=True)
class Rule:
    """Votes on `repeats / total`: 1 from `bad` on, -1 up to `good`; abstains (0) in between or under `least` units. A trusted rule's votes are right."""

    name: str
    repeats: str
    total: str
    least: int
    bad: float
    good: float
    trusted: bool = False

    def vote(self) -> Column:
        share = F.col(self.repeats) / F.col(self.total)
        return F.when(F.col(self.total) < self.least, 0).when(share >= self.bad, 1).when(share <= self.good, -1).otherwise(0).cast("tinyint")


RULES = (
    Rule("windows", "window_repeats", "windows", 20, 0.3, 0.1, trusted=True),
    Rule("top_window", "top_window", "windows", 20, 0.05, 0.02),
    Rule("sentences", "sentence_repeats", "sentences", 4, 0.25, 0.05),
    Rule("lines", "line_repeats", "lines", 4, 0.25, 0.05),
    Rule("paragraphs", "paragraph_repeats", "paragraphs", 3, 0.25, 0.05),
)

#: Accuracy of a trusted rule, and the range in which the others' estimates and the prior are kept: the votes of up to five others never outweigh a trusted one.
TRUST, WORST, RAREST = 1 - 1e-13, 0.01, 1e-3

_MEASURES = ["windows", "window_repeats", "top_window", "sentences", "sentence_repeats", "lines", "line_repeats", "paragraphs", "paragraph_repeats"]


def _repeats(parts: list[str]) -> tuple[int, int]:
    kept = [p for p in map(str.strip, parts) if p]
    return len(kept), len(kept) - len(set(kept))


def repetition_measures(df: DataFrame, id_col: str, text_col: str, *, words: int = 5) -> DataFrame:
    """(id, windows, window_repeats, top_window, sentences, sentence_repeats, lines, line_repeats, paragraphs, paragraph_repeats).

    Repeats are total minus distinct; top_window counts the most frequent window's occurrences beyond its first. Null and
    empty texts get zeros; rows stay rows; other columns are ignored. One narrow pass: no shuffle.
    """
    base = df.select(column(df, id_col).alias("id"), column(df, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in sub_batches(batches, 1000):
            texts = [x or "" for x in b.column(1).to_pylist()]
            rows = len(texts)
            found = [WORD.findall(x.lower()) for x in texts]
            lengths = np.fromiter(map(len, found), np.int64, rows)
            owner, h = windows_of(hasher([w for ws in found for w in ws]), lengths, words)
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            total = np.bincount(owner, minlength=rows)
            distinct, top = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            if len(h):
                starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])])
                distinct = np.bincount(owner[starts], minlength=rows)
                np.maximum.at(top, owner[starts], np.diff(np.r_[starts, len(h)]) - 1)
            units = np.array([(*_repeats(_SENTENCE.split(x)), *_repeats(x.splitlines()), *_repeats(re.split(r"\n\s*\n", x))) for x in texts], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.asarray(v, np.int64)) for v in (total, total - distinct, top, *units.T))], ["id", *_MEASURES])

    return base.mapInArrow(run, f"id {base.schema[0].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in _MEASURES))


@dataclass(frozen=True)
class LabelModel:
    """What expectation-maximisation found: the share of repetitive documents and each rule's accuracies."""

    prior: float
    says_bad_if_bad: tuple[float, ...]
    says_bad_if_good: tuple[float, ...]


def fit_label_model(patterns: dict[tuple[int, ...], int], *, trusted: tuple[bool, ...] = (), rounds: int = 100) -> LabelModel:
    """EM over counts of vote patterns, at most 3^rules of them whatever the number of documents. Abstentions carry no weight.

    Starts from a majority vote; probabilities are kept off 0 and 1 by one pseudo-vote on either side and by WORST and RAREST.
    `trusted` marks rules whose accuracy is TRUST. Without any votes the
    prior is one half and every rule is worth a coin.
    """
    rules = len(next(iter(patterns), RULES))
    votes = np.array(list(patterns), np.int64).reshape(-1, rules)
    counts = np.array(list(patterns.values()), float)
    keep = votes.any(1)
    votes, counts = votes[keep], counts[keep]
    if not len(votes):
        return LabelModel(0.5, (0.5,) * rules, (0.5,) * rules)
    fixed = np.array(trusted or (False,) * rules)
    post = 1 / (1 + np.exp(-2.0 * votes.sum(1)))
    bad, some = votes == 1, votes != 0
    for _ in range(rounds):
        w1, w0 = counts * post, counts * (1 - post)
        prior = float(np.clip((w1.sum() + 1) / (counts.sum() + 2), RAREST, 1 - RAREST))
        p1 = np.where(fixed, TRUST, np.clip((w1 @ bad + 1) / (w1 @ some + 2), WORST, 1 - WORST))
        p0 = np.where(fixed, 1 - TRUST, np.clip((w0 @ bad + 1) / (w0 @ some + 2), WORST, 1 - WORST))
        log = np.log(prior / (1 - prior)) + (np.where(bad, np.log(p1 / p0), np.log((1 - p1) / (1 - p0))) * some).sum(1)
        new = 1 / (1 + np.exp(-np.clip(log, -500, 500)))
        if np.abs(new - post).max() < 1e-10:
            break
        post = new
    return LabelModel(float(prior), tuple(p1.tolist()), tuple(p0.tolist()))


def score_repetition(df: DataFrame, id_col: str, text_col: str, *, words: int = 5, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, LabelModel]:
    """(measures with vote_<rule> and p_repetitive per row, the fitted model).

    p_repetitive is the posterior probability, null where every rule abstains: such texts are too short to be judged. The vote of a
    trusted rule decides it. The measures are written and the model is fitted when it is called.
    """
    measured = repetition_measures(df, id_col, text_col, words=words)
    voted = materialize(measured.withColumns({f"vote_{r.name}": r.vote() for r in rules}), "repetition-votes")
    names = [f"vote_{r.name}" for r in rules]
    patterns: Counter = Counter({tuple(row[:-1]): row[-1] for row in voted.groupBy(*names).count().collect()})
    model = fit_label_model(patterns, trusted=tuple(r.trusted for r in rules))
    log = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for name, p1, p0 in zip(names, model.says_bad_if_bad, model.says_bad_if_good, strict=True):
        log = log + F.when(F.col(name) == 1, float(np.log(p1 / p0))).when(F.col(name) == -1, float(np.log((1 - p1) / (1 - p0)))).otherwise(0.0)
    any_vote = F.greatest(*(F.abs(F.col(n)) for n in names)) > 0
    return voted.withColumn("p_repetitive", F.when(any_vote, 1 / (1 + F.exp(-log)))), model
