"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing column names."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm.formatting_duplicates import address_form, formatting_duplicates, text_form
from corvane.llm.look_alikes import look_alike_classes, look_alike_pairs
from corvane.llm.mixing import mix_sources, poisson_steps
from corvane.llm.near_duplicates import expand_pairs, near_duplicates, trie_join
from corvane.llm.repetition import RULES, fit_label_model, repetition_measures, score_repetition
from corvane.llm.split_text import LEVELS, spans, split_texts
from corvane.llm.term_frequency import term_frequencies
from corvane.llm.term_weights import divergence, most_distinctive, most_distinctive_terms, saturated, weighted_terms
from corvane.llm.tokenize_corpus import count_tokens, decode_corpus, default_vocabulary, encode_corpus, transducer

WORD = re.compile(r"[^\W_]+")


# 1. near duplicates


def corpus(seed, n=60, words=40):
    rng = np.random.default_rng(seed)
    base = [[f"w{x}" for x in rng.integers(0, 5000, words)] for _ in range(6)]
    texts = []
    for i in range(n):
        t = list(base[i % 6])
        for _ in range(rng.integers(0, 12)):
            t[rng.integers(0, len(t))] = f"e{rng.integers(0, 9)}"
        if rng.random() < 0.3:
            t[5:5] = ["ins", f"x{i}"]
        texts.append("  ".join(t).upper() if rng.random() < 0.5 else " ".join(t) + ".")
    return texts + texts[:5] + [None, "", "one two", "Ünï cödé wörds äre fïne " * 3, "same " * 50, "same " * 70]


def jaccard_model(texts, words, t):
    sets = {}
    for i, x in enumerate(texts):
        w = WORD.findall((x or "").lower())
        s = frozenset(zip(*(w[j:] for j in range(words)), strict=False))
        if s:
            sets[i] = s
    out = {}
    for i in sets:
        for j in sets:
            if i < j and sets[i] != sets[j]:
                k, u = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                if k >= t * u - 1e-12:
                    out[i, j] = (k, u)
    return out


@pytest.mark.parametrize("words,threshold,max_trie", [(3, 0.5, 1024), (3, 0.5, 4), (5, 0.8, 1024), (2, 0.3, 7), (1, 0.5, 1024)])
def test_near_duplicates_lose_nothing(spark, words, threshold, max_trie):
    texts = corpus(words)
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc long, text string, id string, key int").repartition(3)
    pairs, members = near_duplicates(df, "doc", "text", words=words, threshold=threshold, max_trie=max_trie)
    got = {(r.id_a, r.id_b): (r.shared, r.total) for r in expand_pairs(pairs, members).collect()}
    assert got == jaccard_model(texts, words, threshold)
    assert pairs.count() <= len(got)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc long, text string")
    pairs, members = near_duplicates(empty, "doc", "text")
    assert expand_pairs(pairs, members).count() == 0
    few = spark.createDataFrame([(None, "a b c d e f"), (1, None), (2, "")], "doc long, text string")
    assert expand_pairs(*near_duplicates(few, "doc", "text")).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(empty, "doc", "text", threshold=0)


def test_many_copies_make_one_class(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.range(400).select("id", F.when(F.col("id") == 399, text.replace("w30 ", "x ")).otherwise(F.when(F.col("id") % 2 == 0, text).otherwise(text.upper() + "!")).alias("text"))
    pairs, members = near_duplicates(df, "id", "text", words=3, threshold=0.5)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 399)] and members.count() == 399
    assert expand_pairs(pairs, members).count() == 399


def test_heavy_windows_are_cut_before_the_shuffle(spark, monkeypatch):
    """Records that hold the same windows beyond their prefixes, more than a trie may have; and an order by levels alone."""
    import corvane.llm.near_duplicates as nd

    rng = np.random.default_rng(8)
    common = " ".join(f"c{i}" for i in range(30))
    texts = [common + " " + " ".join(f"w{x}" for x in rng.integers(0, 40, 12)) for _ in range(120)] + [" ".join(f"u{i}x{j}" for j in range(20)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3)
    want = jaccard_model(texts, 3, 0.5)
    assert len(want) > 5000
    cut = []
    for share in (1 / 2000, 2.0):  # known before the shuffle, or found after it
        monkeypatch.setattr(nd, "HEAVY", share)
        keys = nd.sketch_keys(nd.shingle_table(df, "doc", "text", 3), nd.Fraction(1, 2), 16)
        cut.append(keys.where("block >= 0").count())
        pairs, members = near_duplicates(df, "doc", "text", words=3, threshold=0.5, max_trie=16)
        assert {(r.id_a, r.id_b): (r.shared, r.total) for r in expand_pairs(pairs, members).collect()} == want
    assert cut[0] > 0 and cut[1] == 0


def test_a_trie_without_the_other(spark):
    """More records than a trie may have hold a window, but only two of one block have it in their prefixes: their pairs of blocks lack one side."""
    import corvane.llm.near_duplicates as nd

    some = np.zeros(2, np.int64)
    assert [len(x) for x in trie_join(some, some + 1, some + 5, np.zeros((2, 32), np.uint8), 0.5)] == [0, 0]
    blocks = -(-42 // 4)
    a, b = [i for i in range(1000) if nd.mix64(np.array([i], np.uint64))[0] % np.uint64(blocks) == blocks // 2][:2]
    rows = [(1000 + i, "c1 c2 c3 c4 " + " ".join(f"u{i}x{j}" for j in range(20))) for i in range(40)] + [(a, "c1 c2 c3 c4 x"), (b, "c1 c2 c3 c4 y")]
    df = spark.createDataFrame(rows, "doc long, text string").coalesce(1)
    keys = nd.sketch_keys(nd.shingle_table(df, "doc", "text", 3), nd.Fraction(1, 2), 4)
    assert {r.id for r in keys.where("block >= 0").collect()} == {a, b}
    pairs, members = near_duplicates(df, "doc", "text", words=3, threshold=0.5, max_trie=4)
    assert {(r.id_a, r.id_b): (r.shared, r.total) for r in expand_pairs(pairs, members).collect()} == {(a, b): (2, 4)}


def test_levels_follow_the_frequency(spark, monkeypatch):
    import corvane.llm.near_duplicates as nd

    monkeypatch.setattr(nd, "HEAVY", 2.0)
    df = spark.range(6000).select("id", F.concat_ws(" ", F.lit("often"), F.concat(F.lit("some"), F.col("id") % 200), F.concat(F.lit("once"), F.col("id"))).alias("text"))
    (again, *levels), heavy = nd.window_statistics(nd.shingle_table(df, "id", "text", 1))
    words = nd.WordHasher()(["often", *(f"some{i}" for i in range(200)), *(f"once{i}" for i in range(6000))])
    h = nd.mix64(words)
    level = sum(nd._bit(t, nd._cells(h, nd.LEVEL_BITS)).astype(int) for t in levels)
    assert not heavy and level[0] >= 2 and level[1:201].mean() > 0.3 and level[201:].max() == 0
    assert nd._bit(again, nd._cells(h, nd.CELL_BITS))[:201].all() and nd._bit(again, nd._cells(h, nd.CELL_BITS))[201:].mean() < 0.01


def test_one_window_in_a_third_of_all_records(spark):
    """33,000 of 100,000 records share windows with each other that aren't enough for a link, and thousands are copies."""
    shared = " ".join(f"s{i}" for i in range(12))
    own = F.concat_ws(" ", *(F.concat(F.lit(f"o{j}x"), F.floor(F.col("id") / 2)) for j in range(14)))
    text = F.when(F.col("id") % 9 == 0, F.lit(shared)).when(F.col("id") % 3 == 0, F.concat_ws(" ", F.lit(shared), own)).otherwise(own)
    df = spark.range(100_000).select("id", text.alias("text"))
    pairs, members = near_duplicates(df, "id", "text", words=3, threshold=0.8)
    # all records of a pair 2k, 2k + 1 hold the same own words; those of neither shared words are copies of each other
    assert members.where("rep = 0").count() == 11_112
    plain = [i for i in range(0, 100_000, 2) if i % 3 and (i + 1) % 3]
    assert members.where("rep != 0").count() == 2 * len(plain) and pairs.count() == 0


@pytest.mark.parametrize("two", [False, True])
def test_trie_walk_against_all_pairs(two):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (5, 64))
    bits = np.where(rng.random((80, 64)) < 0.12, 1 - base[rng.integers(0, 5, 80)], base[rng.integers(0, 5, 80)])
    sketch, n, group = np.packbits(bits.astype(bool), axis=1), rng.integers(5, 40, 80), rng.integers(0, 3, 80)
    side = rng.integers(0, 2, 80) if two else np.zeros(80, int)
    if two:
        group = np.zeros(80, int)
    a, b = trie_join(group, side, n, sketch, 0.25)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if group[i] == group[j] and (not two or side[i] != side[j]) and (bits[i] != bits[j]).sum() <= np.floor(0.25 * (n[i] + n[j]))}
    assert got == want and want


# 2. and 6. terms


def test_term_weights_against_a_model(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"t{x}", int(c)) for i in range(30) for x, c in Counter(rng.zipf(1.6, 25).tolist()).items() if x < 60]
    dirty = rows + rows[::3] + [(0, rows[0][1], None), (None, "t1", 2), (5, None, 1), (99, "t1", None)]
    df = spark.createDataFrame([(*r, "x") for r in dirty], "o long, term string, tf int, id string")
    tf = {(i, t): c for i, t, c in rows}
    n, df_of, cf, dl = len({i for i, _ in tf}), Counter(t for _, t in tf), Counter(), Counter()
    for (i, t), c in tf.items():
        cf[t] += c
        dl[i] += c
    total, avg = sum(dl.values()), sum(dl.values()) / n

    def sat(i, t):
        return np.log(1 + (n - df_of[t] + 0.5) / (df_of[t] + 0.5)) * tf[i, t] * 2.5 / (tf[i, t] + 1.5 * (0.25 + 0.75 * dl[i] / avg))

    def div(i, t):
        pc = cf[t] / total
        pd = (tf[i, t] + 50 * pc) / (dl[i] + 50)
        return pd * np.log(pd / pc)

    for weight, model, least in ((saturated(1.5, 0.75), sat, 1), (divergence(50.0), div, 3)):
        w = weighted_terms(df, "o", "term", "tf", weight, least_df=least)
        got = {(r.id, r.term): r.weight for r in w.collect()}
        want = {k: model(*k) for k in tf if df_of[k[1]] >= least}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)
        best = {r.id: r.term for r in most_distinctive(w).collect()}
        for i in {i for i, _ in want}:
            assert best[i] == min((t for j, t in want if j == i), key=lambda t: (-round(want[i, t], 9), t))
        for head in (0, 3, 10**6):  # no term, some or all of them have their statistics broadcast
            assert {r.id: r.term for r in most_distinctive_terms(df, "o", "term", "tf", weight, least_df=least, head_terms=head).collect()} == best
    assert {(r.id, r.term): r.weight for r in weighted_terms(df, "o", "term", "tf", weight, least_df=least, head_terms=3).collect()} == got
    assert weighted_terms(df.limit(0), "o", "term", "tf", saturated(1.5, 0.75)).count() == 0


def test_ties_take_the_smallest_term(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 1), (1, "ä", 1)], "o long, term string, tf int")
    assert most_distinctive(weighted_terms(df, "o", "term", "tf", saturated(1.5, 0.75))).first().term == "a"


def test_term_frequencies(spark):
    texts = ["A a b1 bb BB", "bb é é ccc", None, "", "_x_ bb " * 3, "ccc", "zz " * 5000] + ["bb ccc"] * 10
    df = spark.createDataFrame([(t, "q") for t in texts], "text string, term string").repartition(4)
    occurrences, records = Counter(), Counter()
    for t in texts:
        w = [x for x in WORD.findall((t or "").lower()) if len(x) > 1]
        occurrences.update(w)
        records.update(set(w))
    got = {r.term: r for r in term_frequencies(df, "text", common_share=0.5).collect()}
    assert {t: (r.occurrences, r.records) for t, r in got.items()} == {t: (occurrences[t], records[t]) for t in occurrences}
    assert {t: r.band for t, r in got.items()} == {t: "rare" if records[t] <= 2 else "common" if records[t] > 8 else None for t in records}
    assert len({r.term_id for r in got.values()}) == len(got)
    # identifiers run from 0 inside each range, in the order of the terms
    ranges = {}
    for t in sorted(got, key=lambda t: t.encode()):
        ranges.setdefault(got[t].term_id >> 40, []).append(got[t].term_id & (2**40 - 1))
    assert all(n == list(range(len(n))) for n in ranges.values())
    assert term_frequencies(df.limit(0), "text").count() == 0


def test_count_arrays_are_indexed_by_identifiers(spark, monkeypatch):
    """Blocks of few terms, and one range for all of them: every count meets its own in the arrays of the dictionary's numbers."""
    import corvane.llm.term_frequency as tf

    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.4, 60) % 3000) for _ in range(400)]
    records = Counter(t for x in texts for t in set(x.split()))
    occurrences = Counter(t for x in texts for t in x.split())
    monkeypatch.setattr(tf, "RANGES", 1)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    got = tf.term_frequencies(df, "text").collect()
    assert {r.term: (r.occurrences, r.records) for r in got} == {t: (occurrences[t], records[t]) for t in records}
    assert [r.term for r in sorted(got, key=lambda r: r.term_id)] == sorted(records) and {r.term_id for r in got} == set(range(len(records)))


# 3. look-alikes


def test_look_alikes(spark):
    same = ["Café A b fi", "Café А b ﬁ", "Ｃafé A b​ fi", "C­afé　Α b fi", "Café A b fi"]
    other = ["café A b fi", "Cafe A b fi", "Café A  b fi", "Café A\tb fi", "Café, A b fi", "Café A b fi\n", "Café A6 fi"]
    rows = [(f"k{i:02}", t) for i, t in enumerate(same + other + [None, "", " ", "​", "　", " ", "Café A b fi"])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, t string, h int").repartition(3)
    classes = look_alike_classes(df, "k", "t")
    got = classes.collect()
    assert {r.key for r in got} == {f"k{i:02}" for i in range(5)} | {"k18"} and {r.canonical for r in got} == {min(same, key=lambda s: s.encode())}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x in same and y in same and x != y}
    assert {(r.key_a, r.key_b) for r in look_alike_pairs(classes).collect()} == want
    assert look_alike_pairs(look_alike_classes(df.limit(0), "k", "t")).count() == 0


def test_canonical_forms_of_other_scripts_look_alike(spark):
    pairs = [("\uac01", "\u1100\u1161\u11a8"), ("\u0622", "\u0627\u0653"), ("\u0958", "\u0915\u093c"), ("\u212b", "A\u030a"), ("ｶﾞｲﾄﾞ", "ガイド"), ("ﾊﾟ", "ハ\u309a"), ("a\u0323\u0302", "a\u0302\u0323"), ("\u05e9\u05c1", "\ufb2a"), ("\u09cb", "\u09c7\u09be"), ("Ё", "E\u0308")]
    rows = [(f"{side}{i}", f"x {p[j]} y") for i, p in enumerate(pairs) for j, side in enumerate("ab")]
    got = {(r.key_a, r.key_b) for r in look_alike_pairs(look_alike_classes(spark.createDataFrame(rows, "k string, t string"), "k", "t")).collect()}
    print(f"p3 canonical pairs {len(got)} of {len(pairs)}")
    assert got == {(f"a{i}", f"b{i}") for i in range(len(pairs))}


def test_what_the_collation_confuses_stays_apart(spark):
    rows = list(enumerate(["5", "\u0665", "\u096b", "\U0001d7d3", "\U0001d400", "\U0001d434", "\u2776", "\u2460"]))
    assert look_alike_classes(spark.createDataFrame(rows, "k long, t string"), "k", "t").count() == 0


def test_equivalents_of_all_scripts_meet(spark):
    """Composed, decomposed, reordered and narrow forms of random strings over all assigned characters, in two collections."""
    import unicodedata

    rng = np.random.default_rng(11)
    pool = [chr(c) for c in range(0x21, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cc")]
    composed = [c for c in pool if unicodedata.normalize("NFD", c) != c]
    narrow = [chr(c) for c in range(0xFF61, 0xFF9F)]
    rows = []
    for i in range(600):
        text = "".join(rng.choice(pool, 3)) + "".join(rng.choice(composed, 3)) + "".join(rng.choice(narrow, 2)) + f" {i}"
        wide = "".join(unicodedata.normalize("NFKC", c) if c in narrow else c for c in text)
        forms = {text, unicodedata.normalize("NFC", text), unicodedata.normalize("NFD", text), unicodedata.normalize("NFD", wide), unicodedata.normalize("NFC", wide)}
        rows += [("xy"[i % 2], i, f"{i}-{j}", t) for j, t in enumerate(sorted(forms))]
    got = look_alike_classes(spark.createDataFrame(rows, "part string, i long, k string, t string"), "k", "t", by="part")
    assert {r.key for r in got.collect()} == {r[2] for r in rows} and got.select("by", "canonical").distinct().count() == 600


def test_accented_look_alikes(spark):
    rows = [("a", "Ёлка"), ("b", "Ëлкa"), ("c", "Ёлка"), ("d", "Елка")]
    got = {r.key for r in look_alike_classes(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert got == {"a", "b", "c"}


# 5. splitting


def rule(text):
    """The pieces by the rule's own words, character by character."""
    out, s = [], 0
    while len(text) - s > 1200:
        window = range(s + 1200, s + 599, -1)
        e = next((e for e in window if text[e - 2 : e] == "\n\n"), None) or next((e for e in window if text[e - 2] in ".!?" and text[e - 1] in " \t\n"), None) or next((e for e in window if text[e - 1] in " \t\n"), s + 1200)
        out.append((s, e))
        s = e - 120
    return out + [(s, len(text))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "é" * 40, "end. ", "\n\n", "日本" * 30, "x" * 700, "tab\t", "?\n", "😀"]), max_size=120), st.integers(0, 3))
def test_pieces_follow_the_rule(parts, repeat):
    text = "".join(parts) * (repeat + 1)
    got = spans(text, 1200, 600, 120, [re.compile(x) for x in LEVELS[1:]])
    assert got == (rule(text) if text else [])


def test_levels_from_section_to_character():
    compiled = [re.compile(x) for x in LEVELS]
    cut = lambda t: [t[s:e] for s, e in spans(t, 40, 10, 0, compiled)]
    assert cut("intro text. more\n\npara two.\n# Head\nbody goes on and on") == ["intro text. more\n\npara two.\n", "# Head\nbody goes on and on"]
    assert cut("page one, a. b\n\nxx\fpage two is longer than one. yes") == ["page one, a. b\n\nxx\f", "page two is longer than one. yes"]
    assert cut("one. two. three\n\nfour. five. six seven eight nine") == ["one. two. three\n\n", "four. five. six seven eight nine"]
    assert cut("one two three four. five six seven eight nine ten") == ["one two three four. ", "five six seven eight nine ten"]
    assert cut("one two three four five six seven eight nine ten") == ["one two three four five six seven eight ", "nine ten"]
    assert cut("x" * 90) == ["x" * 40, "x" * 40, "x" * 10]
    long = "word and more. " * 200_000
    assert [s for s, _ in spans(long, 40, 10, 0, compiled)][:3] == [0, 30, 60]


def test_split_texts(spark):
    long = "Ação é boa. " * 300 + "\n\n" + "日本語" * 700
    df = spark.createDataFrame([("a", long, 1), ("a", long, 1), ("b", "short", 2), ("c", None, 3), ("d", "", 4), ("e", "y" * 1200, 5), ("f", "y" * 1201, 6)], "id string, text string, piece int")
    got = split_texts(df, "id", "text", longer_than=1200, with_text=True, levels=LEVELS[1:]).collect()
    assert {r.id for r in got} == {"a", "f"}
    a = sorted({(r.char_start, r.char_end, r.byte_start, r.byte_end, r.piece_text) for r in got if r.id == "a"})
    assert [(x[0], x[1]) for x in a] == rule(long)
    for s, e, bs, be, piece in a:
        assert long[s:e] == piece and long.encode()[bs:be].decode() == piece
    assert split_texts(df, "id", "text").where("id = 'b'").count() == 1
    with pytest.raises(ValueError):
        split_texts(df, "id", "text", overlap=700)


# 7. formatting


def test_formatting_duplicates(spark):
    rows = [
        (1, "Hello, World", "item://a/b?x=1&y=2"), (2, "hello world!", "ITEM://a/b/?y=2&x=1"), (3, "HELLOWORLD", "item://a/b?x=1"),
        (4, "name: A; size: 3; kind: z", "u"), (5, "size=3 | kind : Z\n name: a", "u/"), (6, "name: A; size: 3", "u"), (7, "size: 3; name: A", "u"),
        (8, "...", "u"), (9, "!!!", "u"), (10, None, "u"), (11, "x", None), (12, "x", None), (13, "", "u"), (14, "dlrow olleh", "item://a/b?x=1&y=2"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "ordinal long, canonical_text string, source_uri string, id int")
    got = {(r.kept, r.copy, r.copies) for r in formatting_duplicates(df, "ordinal", "canonical_text", "source_uri").collect()}
    assert got == {(1, 1, 2), (1, 2, 2), (4, 4, 2), (4, 5, 2)}
    assert formatting_duplicates(df.limit(0), "ordinal", "canonical_text", "source_uri").count() == 0
    assert text_form("a: 1; b") == text_form("A1B") and text_form(" - ") is None and address_form("A//?") == "a?"


def test_a_third_of_all_rows_in_one_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Same"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")), F.lit("text"))).otherwise(F.concat(F.lit("t"), "id")).alias("t"), F.lit("u").alias("u"))
    got = formatting_duplicates(df, "id", "t", "u")
    assert got.count() == 1000 and got.where("kept = 0 and copies = 1000").count() == 1000


# 8. tokens

VOCABULARY = default_vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


HARD = ["a" * 5000, " " * 3000 + "x", "=" * 2000, "ab" * 3000, "\t\n " * 999, "日本語テスト" * 400, "<|endoftext|> don't I'll", "aaaa aaaaaaaaaaaaaaa", "\x1c\x1d a\x85b᠎ c​", "😀" * 700]


def test_encoding_equals_the_library(library):
    t = transducer(VOCABULARY)
    assert [t.encode(x) for x in HARD] == library(HARD)
    assert [t.decode(t.encode(x)) for x in HARD] == HARD
    assert t.encode("") == t.encode(None) == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(text):
    t = transducer(VOCABULARY)
    raw = text.encode("utf-8", "replace").decode()
    assert t.decode(t.encode(raw)) == raw


def test_stream_in_parts_with_constant_memory(library):
    t = transducer(VOCABULARY)
    piece = ("thequickbrownfox" * 4000).encode()
    whole = library([piece.decode()])[0]
    assert list(t.stream(piece[i : i + 97] for i in range(0, len(piece), 97))) == whole
    fed, emitted, lag, asked = 0, 0, 0, t.lookahead

    def parts():
        nonlocal fed
        for i in range(0, len(piece), 64):
            fed = i + 64
            yield piece[i : i + 64]

    for token in t.stream(parts()):
        emitted += len(t.bytes_of[token])
        lag = max(lag, fed - emitted)
    assert asked < lag <= 2 * asked + 4096 and emitted == len(piece)  # the bound decides when tokens come out


@pytest.mark.parametrize("letters", ["ab", "aeinst", "etaoinshrdlu", "=-", "0123456789", "áéñß", "漢字かな"])
def test_tokens_are_stable_after_the_bound(library, letters):
    """Long runs of one class, random and periodic: what the bound lets out is never taken back."""
    rng = np.random.default_rng(len(letters))
    t = transducer(VOCABULARY)
    texts = ["".join(rng.choice(list(letters), 60_000)), ("".join(rng.choice(list(letters), 7)) * 9000)[:60_000], "".join(x * int(n) for x, n in zip(rng.choice(list(letters), 3000), rng.zipf(1.5, 3000) % 90, strict=True))]
    for text in texts:
        assert list(t.encode_parts(text[i : i + 1000] for i in range(0, len(text), 1000))) == library([text])[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "'", "'s", "'ll", "'l", "l", "9", " 12", "!!", "\u3000", "é", "don't", " 'tis", "\t\t"]), max_size=40), st.integers(1, 7), st.integers(1, 12))
def test_the_split_is_a_stream(parts, size, room):
    import corvane.llm.tokenize_corpus as tc

    t, text = transducer(VOCABULARY), "".join(parts)
    old, tc._OPEN = tc._OPEN, room  # runs of a few characters count as long
    try:
        got, open_piece = [], ""
        for piece, end in t.pieces(text[i : i + size] for i in range(0, len(text), size)):
            open_piece += piece
            if end:
                got.append(open_piece)
                open_piece = ""
    finally:
        tc._OPEN = old
    assert got == t.split.findall(text) and not open_piece


def test_long_texts_go_through_the_stream(library):
    t = transducer(VOCABULARY)
    texts = ["Some words, it's 12 o'clock!  \n" * 9000, "a" * 200_000 + " b", " " * 150_000 + "x" + "\n" * 70_000, "!" * 65_535 + "'" + "s" + "don't " * 30_000]
    assert [t.encode(x) for x in texts] == library(texts)


def test_every_token_encodes_to_itself():
    t = transducer(VOCABULARY)
    assert all(t.encode_piece(raw) == [i] for raw, i in t.ids.items())


def test_encode_corpus(spark, library):
    df = spark.createDataFrame([(1, "Olá mundo", 5), (1, "Olá mundo", 5), (None, None, 6), (3, "", 7)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, library(["Olá mundo"])[0])] * 2 + [(None, []), (3, [])], key=str)
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    back = decode_corpus(encode_corpus(df, "doc_id", "text"), "doc_id", "ids").collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == [("1", "Olá mundo"), ("1", "Olá mundo"), ("3", ""), ("None", "")]
    assert sorted(r.tokens for r in count_tokens(df, ["doc_id"], "text").collect()) == [0, 0, len(got[0][1]) or len(got[1][1]), len(got[0][1]) or len(got[1][1])]


# 9. mixing


def test_poisson_steps():
    from math import exp, factorial

    assert poisson_steps(0.0, 3) == [1.0, 1.0, 1.0] and poisson_steps(2.0, 0) == []
    assert poisson_steps(1.7, 4) == pytest.approx([sum(exp(-1.7) * 1.7**j / factorial(j) for j in range(k + 1)) for k in range(4)])


def test_mixture_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(["word"] * int(rng.integers(5, 60))), ["big", "mid", "small", "other", None][min(int(rng.choice(5, p=[0.5, 0.3, 0.1, 0.05, 0.05])), 4)]) for i in range(3000)]
    docs += [(9001, None, "big"), (9002, "", "big")]
    d = spark.createDataFrame([(*x, 3) for x in docs], "doc_id long, text string, source string, copy int")
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.35, 6), ("gone", 0.05, 4), ("none", 0.0, 3)], "source string, weight double, max_repeats int")
    mixed, report = mix_sources(d, t, id_col="doc_id", text_col="text", source_col="source")
    rows, said = mixed.toPandas(), {r.source: r for r in report.collect()}
    sums = rows.groupby("source").tokens.sum()
    assert set(sums.index) == {"big", "mid", "small"} and set(said) == {"big", "mid", "small", "gone", "none"}
    for s, w in (("big", 0.3), ("mid", 0.3), ("small", 0.35)):
        assert said[s].tokens == sums[s] and said[s].share == pytest.approx(w / 0.95, rel=0.01)
        assert rows[rows.source == s].groupby("doc_id").copy.max().max() <= {"big": 1, "mid": 2, "small": 6}[s]
    assert not rows.duplicated(["doc_id", "copy"]).any() and rows.position.is_monotonic_increasing
    again = mix_sources(d.repartition(5), t, id_col="doc_id", text_col="text", source_col="source")[0].toPandas()
    assert again.equals(rows)
    capped, short = mix_sources(d, t, id_col="doc_id", text_col="text", source_col="source", total_tokens=10**9)
    assert {r.source: r.mean_repeats for r in short.collect()} == {"big": 1.0, "mid": 2.0, "small": 6.0, "gone": 0.0, "none": 0.0}
    assert mix_sources(d.limit(0), t, id_col="doc_id", text_col="text", source_col="source")[0].count() == 0
    with_text = mix_sources(d, t, id_col="doc_id", text_col="text", source_col="source", carry=("text",))[0]
    assert with_text.where("text is null").count() == 0


# 10. repetition


def repeats_model(text):
    w = WORD.findall((text or "").lower())
    x = list(zip(*(w[j:] for j in range(5)), strict=False))
    return len(x), len(x) - len(set(x))


def test_repetition_measures(spark):
    texts = ["a b c d e f g " * 20, "unique words only here " + " ".join(f"w{i}" for i in range(80)), None, "", "one. one. two. one.", "l\nl\nl\nm", "p\n\np\n\nq", "spam " * 5000]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc long, text string, windows int")
    got = {r.id: r for r in repetition_measures(df, "doc", "text").collect()}
    assert {i: (r.windows, r.window_repeats) for i, r in got.items()} == {i: repeats_model(t) for i, t in enumerate(texts)}
    assert (got[4].sentences, got[4].sentence_repeats) == (4, 2) and (got[5].lines, got[5].line_repeats) == (4, 2) and (got[6].paragraphs, got[6].paragraph_repeats) == (3, 1)
    scored, model = score_repetition(df, "doc", "text")
    p = {r.id: r.p_repetitive for r in scored.collect()}
    assert p[0] > 0.5 > p[1] and p[2] is None and p[3] is None and p[7] > 0.5
    assert {r.id for r in scored.where("vote_windows = 1").collect()} == {i for i, t in enumerate(texts) if (m := repeats_model(t))[0] >= 20 and m[1] / m[0] >= 0.3}
    assert score_repetition(df.limit(0), "doc", "text")[0].count() == 0


def test_a_trusted_rule_decides():
    others = [p for p in np.ndindex(3, 3, 3, 3)]
    patterns = {(v, *(x - 1 for x in p)): 50_000 if v < 0 else 1 for v in (-1, 1) for p in others} | {(1, -1, -1, -1, -1): 90_000}
    m = fit_label_model(patterns, trusted=(True, False, False, False, False))
    for votes in patterns:
        odds = np.log(m.prior / (1 - m.prior)) + sum(np.log(p1 / p0) if v > 0 else np.log((1 - p1) / (1 - p0)) if v < 0 else 0 for v, p1, p0 in zip(votes, m.says_bad_if_bad, m.says_bad_if_good, strict=True))
        assert (odds > 0) == (votes[0] > 0)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.2
    right = [0.95, 0.9, 0.75, 0.6, 0.85]
    votes = np.array([[0 if rng.random() < 0.3 else (1 if bool(t) == (rng.random() < a) else -1) for a in right] for t in truth])
    m = fit_label_model(Counter(map(tuple, votes.tolist())))
    assert m.prior == pytest.approx(0.2, abs=0.03)
    for a, bad, good in zip(right, m.says_bad_if_bad, m.says_bad_if_good, strict=True):
        assert bad == pytest.approx(a, abs=0.05) and good == pytest.approx(1 - a, abs=0.05)
    assert fit_label_model({}).prior == 0.5 and len(fit_label_model({}).says_bad_if_bad) == len(RULES)
