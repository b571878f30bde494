"""Problem 1: near-duplicate records with small edits.

Every record becomes a set of word windows and a 256-bit parity sketch of that set: each window flips one
bit, so the Hamming distance of two sketches never exceeds the size of the sets' symmetric difference. A
Jaccard similarity of at least t allows a symmetric difference of at most (1-t)/(1+t) * (|A|+|B|), and that
is the Hamming error budget of a pair: the join below loses no pair.

A forest of binary tries is joined with itself, one trie per partition key. The keys are the windows of a
record's prefix in an order that puts windows common in the collection last; two records of similarity t
share a key of their prefixes. Inside a trie, pairs of nodes are walked together, level by level and for
many tries at once; differing bits add up and a pair is dropped as soon as they exceed the budget.
Surviving pairs are checked exactly on their windows.

Copies (records with equal window sets) take part once and are put back at the end. A trie larger than
`max_trie` is cut into blocks, and each pair of blocks is a group of its own, so that no task holds an
unbounded group. Keys that hold a share of all records are known before the shuffle and cut there; others that turn out
too large are cut after it.

How common a window is follows from tables of bounded size: whether it was seen again at all, whether it was seen again among
a 16th of the records, a 256th and so on, and exact counts of the windows that a share of all records hold. Any order
loses nothing; a good one keeps the tries small.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, WordHasher, checked_semi, column, list_array, materialize, mix64, sub_batches, windows_of

BITS = 256
#: Cells of the table that tells windows seen once from windows seen again: 2 bits each, 8 MB in all, at every corpus size.
CELL_BITS = 25
#: Levels of samples of the records, each a 16th of the one before, and the cells of their tables: 1 MB a level.
LEVELS, LEVEL_BITS = 4, 22
#: Bytes of a table that travel as one row.
_WIDTH = 1 << 16
#: A window is called heavy from this share of all records on: at most (mean set size) / HEAVY windows can be.
HEAVY = 1 / 2000
#: Pairs of leaves that one run of the trie walk may have to look at.
_PAIR_ROOM = 1_000_000
#: Rows that a batch of keys holds, about.
_ROOM = 50_000


def shingle_table(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, digest, windows): each record's distinct window hashes, sorted, and a digest of them.

    Null, empty and short texts have no window and give no row; null ids give none either.
    """
    base = df.select(column(df, id_col).cast("long").alias("id"), column(df, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in sub_batches(batches):
            found = [WORD.findall(x.lower()) for x in b.column(1).to_pylist()]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            owner, h = windows_of(hasher([w for ws in found for w in ws]), lengths, words)
            order = np.lexsort((h, owner))
            owner, h = owner[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
            owner, h = owner[new], h[new]
            n = np.bincount(owner, minlength=len(found))
            has, ends = np.flatnonzero(n), np.cumsum(n)
            digests = [blake2b(h[ends[i] - n[i] : ends[i]].tobytes(), digest_size=16).digest() for i in has]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), pa.array(digests, pa.binary()), list_array(h.view(np.int64), n[has], pa.int64())], ["id", "digest", "windows"])

    return base.where("id is not null and text is not null").mapInArrow(run, "id long, digest binary, windows array<long>")


def _arrays(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(record index, value) of a list column."""
    col = b.column(name)
    n = col.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), col.flatten().to_numpy().view(np.uint64)


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _sampled(ids: np.ndarray) -> np.ndarray:
    """The highest level at which each record is in the sample."""
    z = mix64(ids.view(np.uint64))
    return sum((z % np.uint64(16**level) == 0).astype(np.int64) for level in range(1, LEVELS + 1))


def window_statistics(records: DataFrame) -> tuple[list[np.ndarray], dict[int, int]]:
    """What the key order needs, over all records: for each level the bits of the cells in which two windows fell, and counts of heavy windows.

    All are of bounded size: 2^CELL_BITS bits, LEVELS times 2^LEVEL_BITS, and at most (mean set size) / HEAVY windows.
    """
    sizes = [1 << CELL_BITS, *[1 << LEVEL_BITS] * LEVELS]
    parts = [-(-n // 8 // _WIDTH) for n in sizes]  # rows of each table

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = ([np.zeros(n, bool) for n in sizes] for _ in range(2))
        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            seen += b.num_rows
            owner, every = _arrays(b, "windows")
            level_of = _sampled(b.column("id").to_numpy())
            for level, bits in enumerate([CELL_BITS, *[LEVEL_BITS] * LEVELS]):
                mine = every if not level else every[level_of[owner] >= level]
                if not len(mine):
                    break
                h, counts = np.unique(mine, return_counts=True)
                cells = _cells(h, bits)
                again[level][cells[counts > 1]] = True
                again[level][cells[once[level][cells]]] = True
                again[level][cells[1:][cells[1:] == cells[:-1]]] = True
                once[level][cells] = True
                if not level:
                    heavy = counts >= max(4, b.num_rows * HEAVY)
                    n = int(heavy.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), pa.array(h[heavy].view(np.int64)), pa.array(counts[heavy].astype(np.int64)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
        packed = [(np.packbits(x).tobytes(), np.packbits(y).tobytes()) for x, y in zip(once, again, strict=True)]
        cut = [(x[i * _WIDTH : (i + 1) * _WIDTH], y[i * _WIDTH : (i + 1) * _WIDTH]) for (x, y), n in zip(packed, parts, strict=True) for i in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([0] * len(cut), pa.int64()), pa.array([seen] + [0] * (len(cut) - 1), pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*cut, strict=True))], names)

    names = ["part", "h", "n", "once", "again"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # one entry a row of a table, whatever the number of records
        for b in batches:
            for part, once, again in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                a, z = np.frombuffer(once, np.uint8), np.frombuffer(again, np.uint8)
                if part in state:
                    c, y = state[part]
                    a, z = a | c, z | y | (a & c)
                state[part] = a, z
        yield pa.RecordBatch.from_arrays([pa.array(state, pa.int32()), pa.array([z.tobytes() for _, z in state.values()], pa.binary())], ["part", "again"])

    said = materialize(records.select("id", "windows").mapInArrow(scan, "part int, h long, n long, once binary, again binary"), "window-statistics")
    found = dict(said.where("part >= 0").select("part", "once", "again").repartition(sum(parts), "part").mapInArrow(merge, "part int, again binary").collect())
    tables, at = [], 0
    for n, size in zip(parts, sizes, strict=True):
        bits = b"".join(bytes(found.get(at + i, bytes(min(_WIDTH, size // 8)))) for i in range(n))
        tables.append(np.frombuffer(bits, np.uint8))
        at += n
    total = said.where("part >= 0").agg(F.sum("n")).first()[0] or 0
    heavy = said.where("part < 0").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= total * HEAVY).collect()
    return tables, {r[0]: r[1] for r in heavy}


def _bit(table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def sketch_keys(records: DataFrame, threshold: Fraction, max_trie: int) -> DataFrame:
    """(key, block, side, id, n, sketch): one row for each prefix window that another record may hold too.

    Keys that more than max_trie records are known to hold are cut into blocks here: a row for each pair of blocks that the record's block is in.
    """
    tables, heavy = window_statistics(records)
    hs = np.array(sorted(heavy), np.int64)
    shared = records.sparkSession.sparkContext.broadcast((tables, hs, np.array([heavy[h] for h in hs.tolist()], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (again, *levels), hs, hn = shared.value
        for b in sub_batches(batches):
            owner, h = _arrays(b, "windows")
            rows, n = b.num_rows, b.column("windows").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            weight, held = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            cell = _cells(h, LEVEL_BITS)
            for level, table in enumerate(levels, 1):
                weight[_bit(table, cell)] = level
            if len(hs):
                at = np.minimum(np.searchsorted(hs, h.view(np.int64)), len(hs) - 1)
                held = np.where(hs[at] == h.view(np.int64), hn[at], 0)
                weight = np.where(held > 0, LEVELS + held, weight)
            order = np.lexsort((h, weight, owner))
            owner, h, held = owner[order], h[order], held[order]
            start = np.cumsum(n) - n
            prefix = n - -(-n * threshold.numerator // threshold.denominator) + 1
            keep = np.arange(len(h)) - start[owner] < prefix[owner]
            keep &= _bit(again, _cells(h, CELL_BITS))
            flips = np.bincount(owner * BITS + (mix64(h) % np.uint64(BITS)).astype(np.int64), minlength=rows * BITS) & 1
            sketches = np.packbits(flips.reshape(rows, BITS).astype(bool), axis=1)
            owner, h = owner[keep], h[keep]
            blocks = np.where(held[keep] > max_trie, -(-held[keep] // max_trie), 1)
            ids = b.column("id").to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(blocks) // _ROOM)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(blocks)], strict=True):
                times = blocks[lo:hi]
                pick = np.repeat(np.arange(lo, hi), times)
                other = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
                mine = (mix64(ids[owner[pick]].view(np.uint64)) % blocks[pick].astype(np.uint64)).astype(np.int64)
                block = np.where(blocks[pick] > 1, np.minimum(mine, other) << 32 | np.maximum(mine, other), -1)
                who = owner[pick]
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(who), [None, pa.py_buffer(sketches[who].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h[pick].view(np.int64)), pa.array(block), pa.array(((blocks[pick] > 1) & (mine > other)).astype(np.int8)), pa.array(ids[who]), pa.array(n[who].astype(np.int32)), flat], ["key", "block", "side", "id", "n", "sketch"])

    return records.select("id", "windows").mapInArrow(run, "key long, block long, side tinyint, id long, n int, sketch binary")


def trie_join(group: np.ndarray, side: np.ndarray, n: np.ndarray, sketch: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one group whose sketches differ in at most factor * (n_a + n_b) bits.

    `sketch` is (rows, bytes); `side` is 0 everywhere for a self-join of each group's trie, or tells the two
    tries that a group joins with each other (0 with 1). The tries are implicit: rows sorted by (group, side, sketch), a
    node is a range of rows with a common prefix. Node pairs of all groups advance one bit at a time; a pair of
    ranges with few row pairs, or of equal sketches, is finished at once over its remaining bits.
    """
    words = np.ascontiguousarray(sketch).view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], side, group))
    group, side, n, words = group[order], side[order], n[order].astype(np.int64), words[order]
    rows, bits = len(order), words.shape[1] * 64
    if rows < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tries = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    ends = np.r_[tries[1:], rows]
    room = np.maximum.reduceat(n, tries)
    if side.any():
        g = group[tries]
        two = np.flatnonzero(g[1:] == g[:-1])
        alo, ahi, blo, bhi, most = tries[two], ends[two], tries[two + 1], ends[two + 1], room[two] + room[two + 1]
    else:
        alo, ahi, blo, bhi, most = tries, ends, tries, ends, 2 * room
    budget = np.floor(factor * most + 1e-9).astype(np.int64)
    err = np.zeros(len(alo), np.int64)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # no group may have both tries

    def finish(alo, ahi, blo, bhi):
        """Every row pair of these node pairs, over whole sketches."""
        na, nb = ahi - alo, bhi - blo
        size = na * nb
        at = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        a, b = alo[at] + k // nb[at], blo[at] + k % nb[at]
        once = (a < b) | (alo != blo)[at]
        a, b = a[once], b[once]
        differ = np.zeros(len(a), np.int64)
        for w in range(words.shape[1]):
            differ += np.bitwise_count(words[a, w] ^ words[b, w])
        ok = differ <= np.floor(factor * (n[a] + n[b]) + 1e-9)
        found_a.append(order[a[ok]])
        found_b.append(order[b[ok]])

    for depth in range(bits + 1):
        if not len(alo):
            break
        same = (words[alo] == words[ahi - 1]).all(1) & (words[blo] == words[bhi - 1]).all(1)
        done = same | ((ahi - alo) * (bhi - blo) <= 32) | (depth == bits)
        finish(alo[done], ahi[done], blo[done], bhi[done])
        alo, ahi, blo, bhi, err, budget = (x[~done] for x in (alo, ahi, blo, bhi, err, budget))
        if not len(alo):
            break
        ones = np.zeros(rows + 1, np.int64)
        np.cumsum(words[:, depth >> 6] >> np.uint64(63 - (depth & 63)) & np.uint64(1), out=ones[1:])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        cross = alo != blo
        children = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), (amid[cross], ahi[cross], blo[cross], bmid[cross], err[cross] + 1)]
        limits = [budget, budget, budget, budget[cross]]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*children, strict=True))
        budget = np.concatenate(limits)
        live = (ahi > alo) & (bhi > blo) & (err <= budget)
        alo, ahi, blo, bhi, err, budget = (x[live] for x in (alo, ahi, blo, bhi, err, budget))
    return np.concatenate(found_a), np.concatenate(found_b)


_OUT = ["hot", "a", "b", "n", "sketch"]


def _pairs(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    p = np.unique(np.c_[np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(p), bool)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.int32()), pa.nulls(len(p), pa.binary())], _OUT)


def _sketches(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1) if len(col) else np.zeros((0, BITS // 8), np.uint8)


def _joined(keys: DataFrame, factor: float, max_trie: int) -> DataFrame:
    """Walk the tries of (key, block, side, id, n, sketch). Block -1 is a whole trie; one of more than max_trie rows comes out
    with hot = true, its key in b, to be cut. Other blocks are pairs of blocks i << 32 | j."""
    rows = keys.repartition("key", "block").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # whole groups, then the group that is still open
        hot_key = None

        def hot(key, ids, n, sketch):
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(ids), bool)), pa.array(ids), pa.array(key), pa.array(n.astype(np.int32)), pa.array([x.tobytes() for x in sketch], pa.binary())], _OUT)

        def starts_of(key, block):
            return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])

        def walk(key, block, side, ids, n, sketch):
            starts = starts_of(key, block)
            size = np.diff(np.r_[starts, len(key)])
            crossed = (block[starts] >> 32) != (block[starts] & 0xFFFFFFFF)
            crossed &= block[starts] >= 0
            for two in (False, True):  # a trie with itself, or one with another
                keep = np.repeat((size > 1) & (crossed == two), size)
                if not keep.any():
                    continue
                part_size = size[(size > 1) & (crossed == two)]
                s_side, s_ids, s_n, s_sketch = side[keep] if two else np.zeros(int(keep.sum()), np.int8), ids[keep], n[keep], sketch[keep]
                cut = np.cumsum(part_size**2) // _PAIR_ROOM
                ends = np.cumsum(part_size)
                for lo, hi in zip(np.r_[0, np.flatnonzero(np.diff(cut)) + 1], np.r_[np.flatnonzero(np.diff(cut)) + 1, len(part_size)], strict=True):
                    s = slice(ends[lo] - part_size[lo], ends[hi - 1])
                    if two and not s_side[s].any():
                        continue  # no second trie
                    a, b = trie_join(np.repeat(np.arange(lo, hi), part_size[lo:hi]), s_side[s], s_n[s], s_sketch[s], factor)
                    if len(a):
                        yield _pairs(s_ids[s], a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, block, side, ids, n = (batch.column(c).to_numpy() for c in ("key", "block", "side", "id", "n"))
            part = (key, block, side, ids, n, _sketches(batch.column("sketch")))
            if hot_key is not None:
                more = (key == hot_key) & (block == -1)
                if more.any():
                    yield hot(key[more], ids[more], n[more], part[5][more])
                    part = tuple(x[~more] for x in part)
                if not len(part[0]):
                    continue
                hot_key = None
            held.append(part)
            part = tuple(np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else part
            held = []
            starts = starts_of(part[0], part[1])
            size = np.diff(np.r_[starts, len(part[0])])
            big = np.repeat((size > max_trie) & (part[1][starts] == -1), size)
            if big.any():
                yield hot(part[0][big], part[3][big], part[4][big], part[5][big])
                if big[-1]:
                    hot_key = part[0][-1]
                part = tuple(x[~big] for x in part)
            if len(part[0]):
                open_at = len(part[0]) if hot_key is not None else int(starts_of(part[0], part[1])[-1])
                if open_at >= 20_000 or hot_key is not None:
                    yield from walk(*(x[:open_at] for x in part))
                    part = tuple(x[open_at:] for x in part)
                if len(part[0]):
                    held = [part]
        if held:
            yield from walk(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.mapInArrow(run, "hot boolean, a long, b long, n int, sketch binary")


def _blocks(hot: DataFrame, block: int) -> DataFrame:
    """Keys of tries that were too large, cut into blocks of about `block` rows by a hash of the id: a row for each pair of blocks that a row's block is in."""
    sizes = hot.groupBy("b").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    mine = F.pmod(F.xxhash64("a"), F.col("blocks"))
    rows = hot.join(sizes, "b").withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    pair = F.shiftleft(F.least("mine", "other"), 32).bitwiseOR(F.greatest("mine", "other"))
    return rows.select(F.col("b").alias("key"), pair.alias("block"), (F.col("mine") > F.col("other")).cast("tinyint").alias("side"), F.col("a").alias("id"), "n", "sketch")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, *, words: int = 5, threshold: float | Fraction = Fraction(4, 5), max_trie: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of records whose sets of `words`-word windows have a Jaccard similarity of at least `threshold`.

    Records with equal window sets form a class, represented by its smallest id. members(rep, id) lists the classes of
    two records or more; pairs(a, b, shared, total) links representatives of different classes with a < b, similarity
    = shared / total compared exactly. expand_pairs() turns both into pairs of records.

    Ids must be unique. Null ids or texts, and texts of fewer than `words` words, have no windows and take no part; an
    empty table gives empty results; other columns are ignored, whatever their names. Jobs run when it is called: all but the exact check.
    """
    t = Fraction(threshold).limit_denominator(10_000)
    if not 0 < t <= 1 or words < 1:
        raise ValueError("0 < threshold <= 1 and words >= 1 are needed")
    factor = float((1 - t) / (1 + t))
    shingles = materialize(shingle_table(df, id_col, text_col, words), "shingles")
    keyed = shingles.select("digest", "id")
    classes = keyed.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    members = materialize(keyed.join(classes, "digest").select("rep", "id"), "window-set-copies")
    records = _without(shingles, members.where("id != rep").select("id"))
    walked = materialize(_joined(sketch_keys(records, t, max_trie), factor, max_trie), "trie-pairs")
    pairs = walked.where("not hot").select("a", "b")
    hot = walked.where("hot").select("a", "b", "n", "sketch")
    if hot.limit(1).count():
        pairs = pairs.unionByName(_joined(_blocks(hot, max_trie), factor, max_trie).select("a", "b"))
    pairs = materialize(pairs.distinct(), "candidates")
    # the exact check, on the windows of the records that have a candidate
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "candidate-ids")
    needed = checked_semi(shingles.select("id", "windows"), ids, "id")
    a, b = (needed.select(F.col("id").alias(x), F.col("windows").alias(f"w{x}")) for x in "ab")
    common = F.size(F.array_intersect("wa", "wb")).cast("long")
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("shared"), (F.size("wa") + F.size("wb") - common).alias("total"))
    scored = scored.where(F.col("shared") * t.denominator >= F.col("total") * t.numerator)
    return scored, members


def _without(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of other ids: the ids are broadcast if there are at most BROADCAST_ROWS, else the records are shuffled once and written."""
    n = ids.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return records
    if n <= BROADCAST_ROWS:
        return records.join(F.broadcast(ids), "id", "left_anti")
    return materialize(records.join(ids, "id", "left_anti"), "distinct-records")


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b, shared, total), id_a < id_b: every pair of records behind the pairs of representatives."""
    for x in "ab":
        m = members.select(F.col("rep").alias(x), F.col("id").alias(f"id_{x}"))
        pairs = pairs.join(m, x, "left").withColumn(f"id_{x}", F.coalesce(f"id_{x}", x))
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "shared", "total")
