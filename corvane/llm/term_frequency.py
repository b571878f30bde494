"""Problem 6: frequency of every distinct term.

A global dictionary gives every term an integer: a term's hash picks one of RANGES identifier ranges, its place among the
range's sorted terms is the number inside it. Texts are read once, in blocks: a block numbers its own terms, encodes its texts with
these numbers, and accumulates two count arrays indexed by them, occurrences and records that hold the term. The
dictionary is built from the blocks' terms; it turns their numbers into global identifiers, and the blocks' arrays are
summed range by range, in arrays indexed by the number inside the range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, column, list_array, materialize, sub_batches

#: Identifier ranges; each holds up to 2^40 terms.
RANGES = 4096
_BITS = 40
#: A block is closed when it has so many terms.
_BLOCK_TERMS = 200_000


def _blocks(base: DataFrame, least: int) -> DataFrame:
    """(texts, terms, occurrences, records): a row a block; the arrays run over the block's own numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        occurrences, records = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        texts = 0

        def close() -> pa.RecordBatch:
            terms = [t for t in number if len(t) >= least]
            at = np.fromiter((number[t] for t in terms), np.int64, len(terms))
            size = np.array([len(terms)])
            strings = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), pa.array(terms, pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([texts], pa.int64()), strings, *(list_array(x[at], size, pa.int64()) for x in (occurrences, records))], ["texts", "terms", "occurrences", "records"])

        for b in sub_batches(batches):
            found = [WORD.findall(x.lower()) for x in b.column(0).to_pylist()]
            texts += len(found)
            flat = [w for ws in found for w in ws]
            for w in set(flat).difference(number):
                number[w] = len(number)
            if len(number) > len(occurrences):
                room = np.zeros(len(number), np.int64)
                occurrences, records = np.concatenate([occurrences, room]), np.concatenate([records, room])
            codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
            owner = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
            size = max(len(number), 1)
            occurrences[:size] += np.bincount(codes, minlength=size)
            once = np.unique(owner * size + codes)  # a term counts once in a record
            records[:size] += np.bincount(once % size, minlength=size)
            if len(number) > _BLOCK_TERMS:
                yield close()
                number, texts = {}, 0
                occurrences[:] = records[:] = 0
        if texts:
            yield close()

    return base.mapInArrow(run, "texts long, terms array<string>, occurrences array<long>, records array<long>")


def _dictionary(terms: DataFrame) -> DataFrame:
    """(term_id, term) of distinct terms: numbered inside the range of their hash, in order; one task holds a batch, never a range."""
    ranged = terms.withColumn("range", F.pmod(F.xxhash64("term"), F.lit(RANGES)).cast("int")).repartition("range").sortWithinPartitions("range", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            r = b.column("range").to_numpy()
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            base = np.repeat(first, np.diff(np.r_[first, len(r)]))
            number = np.arange(len(r)) - base + np.where(r == last, used, 0)
            last, used = int(r[-1]), int(number[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array((r.astype(np.int64) << _BITS) | number), b.column("term")], ["term_id", "term"])

    return ranged.select("term", "range").mapInArrow(run, "term_id long, term string")


def _summed(encoded: DataFrame) -> DataFrame:
    """(term_id, occurrences, records): the arrays of all blocks added up, a range at a time."""
    ranged = encoded.withColumn("range", F.shiftright("term_id", _BITS).cast("int")).repartition("range").sortWithinPartitions("range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = -1
        sums = np.zeros((2, 0), np.int64)  # of the open range, indexed by number: the memory of a range's distinct terms, however many rows come

        def close() -> pa.RecordBatch:
            number = np.flatnonzero(sums[1])
            return pa.RecordBatch.from_arrays([pa.array((at << _BITS) | number), pa.array(sums[0, number]), pa.array(sums[1, number])], ["term_id", "occurrences", "records"])

        for b in batches:
            if not b.num_rows:
                continue
            r, ids, occurrences, records = (b.column(c).to_numpy() for c in ("range", "term_id", "occurrences", "records"))
            number = ids & ((1 << _BITS) - 1)
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(r)], strict=True):
                if r[lo] != at:
                    if at >= 0:
                        yield close()
                    at, sums = int(r[lo]), np.zeros((2, 0), np.int64)
                n = number[lo:hi]
                if n.max() >= sums.shape[1]:
                    sums = np.concatenate([sums, np.zeros((2, int(n.max()) + 1), np.int64)], 1)
                np.add.at(sums[0], n, occurrences[lo:hi])
                np.add.at(sums[1], n, records[lo:hi])
        if at >= 0:
            yield close()

    return ranged.select("term_id", "occurrences", "records", "range").mapInArrow(run, "term_id long, occurrences long, records long")


def term_frequencies(df: DataFrame, text_col: str, *, least_length: int = 2, rare_records: int = 2, common_share: float = 0.1) -> DataFrame:
    """(term_id, term, occurrences, records, band): every term of at least `least_length` characters.

    Terms are runs of letters and digits of the lower-cased text. band is `rare` for terms in at most `rare_records`
    records, `common` for terms in more than `common_share` of the records with a non-null text, else null; `rare` wins where both
    hold. Empty texts count as records; null texts don't; an empty table gives an empty result; other columns are ignored.
    Jobs run when it is called: the blocks and the dictionary are written.
    """
    base = df.select(column(df, text_col).alias("text")).where("text is not null")
    blocks = materialize(_blocks(base, least_length), "term-blocks")
    texts = blocks.agg(F.sum("texts")).first()[0] or 0
    dictionary = materialize(_dictionary(blocks.select(F.explode("terms").alias("term")).distinct()), "term-dictionary")
    local = blocks.select(F.explode(F.arrays_zip("terms", "occurrences", "records")).alias("x")).select(F.col("x.terms").alias("term"), "x.occurrences", "x.records")
    counts = _summed(local.join(dictionary, "term").select("term_id", "occurrences", "records"))
    band = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * texts, "common")
    return counts.join(dictionary, "term_id").select("term_id", "term", "occurrences", "records", band.alias("band"))

