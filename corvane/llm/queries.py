"""The problems' queries over the tables of TESTDATA.md, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import decode_float32
from ..operators.search import exact_search
from .common import materialize
from .formatting_duplicates import formatting_duplicates
from .look_alikes import look_alike_classes, look_alike_pairs
from .mixing import mix_sources
from .near_duplicates import expand_pairs, near_duplicates
from .nearest_vectors import nearest_vectors, unit_vectors
from .repetition import repetition_measures, score_repetition
from .split_text import LEVELS, split_texts
from .term_frequency import term_frequencies
from .term_weights import divergence, most_distinctive_terms, saturated
from .tokenize_corpus import encode_corpus


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = near_duplicates(_read(spark, d, "chunks"), "ordinal", "canonical_text", words=3, threshold=Fraction(1, 2))
    return expand_pairs(pairs, members).select(F.col("id_a").alias("ordinal_a"), F.col("id_b").alias("ordinal_b"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The weight that TESTDATA.md fixes, in the operator of the divergence."""
    best = most_distinctive_terms(_read(spark, d, "postings"), "ordinal", "term", "tf", saturated(1.5, 0.75))
    return best.select(F.col("id").alias("ordinal"), "term")


def p2_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's term of largest divergence from the collection, of terms in at least 3 chunks."""
    best = most_distinctive_terms(_read(spark, d, "postings"), "ordinal", "term", "tf", divergence(200.0), least_df=3)
    return best.select(F.col("id").alias("ordinal"), "term", (F.floor(F.col("weight") * 1e6 + 0.5) / 1e6).alias("weight"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    titles = _read(spark, d, "docs").select(F.lit("title").alias("field"), F.col("id").alias("k"), F.col("title").alias("v")).distinct()
    texts = _read(spark, d, "chunks").select(F.lit("canonical_text").alias("field"), F.col("chunk_id").alias("k"), F.col("canonical_text").alias("v"))
    return look_alike_pairs(look_alike_classes(titles.unionByName(texts), "k", "v", by="field")).withColumnRenamed("by", "field")


def chunk_vectors(chunks: DataFrame, cache: DataFrame, *, model: str = "floor-64/v1", dim: int = 64) -> DataFrame:
    """(ordinal, v): a chunk's embedding or, where that is null, its latest cached one of the model and dim; undecodable data gives null."""
    missing = chunks.where("embedding is null").select("ordinal", "chunk_id")
    rows = cache.where((F.col("model") == model) & (F.col("dim") == dim)).select("chunk_id", "data", "cached_at")
    latest = missing.join(rows, "chunk_id").groupBy("ordinal").agg(F.max_by("data", F.struct(F.col("cached_at"), F.col("data"))).alias("data"))

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            raw = [np.frombuffer(x, "<f4").tolist() if x is not None and len(x) == 4 * dim else None for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.list_(pa.float32()))], ["ordinal", "v"])

    decoded = latest.mapInArrow(decode, "ordinal long, v array<float>")
    return chunks.where("embedding is not null").select("ordinal", F.col("embedding").alias("v")).unionByName(decoded)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = chunk_vectors(_read(spark, d, "chunks"), _read(spark, d, "embeddings_v2"))
    near = nearest_vectors(vectors, "ordinal", "v", dim=64, k=5).select(F.col("id").alias("o"), F.explode("near.id").alias("p"))
    return near.select(F.least("o", "p").alias("ordinal_a"), F.greatest("o", "p").alias("ordinal_b")).distinct()


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the five neighbours of the chunks whose ordinal is divisible by 50, asked of all chunks by brute force, are found with a recall of 0.9; and how many were asked."""
    vectors = chunk_vectors(_read(spark, d, "chunks"), _read(spark, d, "embeddings_v2"))
    near = nearest_vectors(vectors, "ordinal", "v", dim=64, k=5).where("id % 50 = 0").select(F.col("id").alias("qid"), F.explode("near.id").alias("ordinal"), F.lit(1).alias("hit"))
    valid = materialize(unit_vectors(vectors, "ordinal", "v", 64).select(F.col("id").alias("ordinal"), decode_float32("v").alias("embedding")), "valid-vectors")
    asked = valid.where("ordinal % 50 = 0").select(F.col("ordinal").alias("qid"), F.col("embedding").alias("query"))
    exact = exact_search(valid, asked, 6).where("ordinal != qid")
    truth = exact.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("r <= 5").select("qid", "ordinal")
    best = truth.join(near, ["qid", "ordinal"], "left").groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("of"))
    return best.agg((F.sum("hits") >= 0.9 * F.sum("of")).alias("reached"), F.count("*").alias("asked"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """TESTDATA.md has no sections: its levels are the hierarchy's from the paragraph down."""
    pieces = split_texts(_read(spark, d, "docs"), "id", "text", limit=1200, least=600, overlap=120, longer_than=1200, levels=LEVELS[1:])
    return pieces.select("id", "byte_start", "byte_end").distinct()  # rows delivered twice give their pieces once


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(_read(spark, d, "chunks"), "canonical_text").where("band is not null").select("term", "band")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(_read(spark, d, "chunks"), "canonical_text").select("term", "occurrences", "records", "band")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    groups = formatting_duplicates(_read(spark, d, "chunks"), "ordinal", "canonical_text", "source_uri")
    return groups.where("kept != copy").select(F.col("kept").alias("ordinal_kept"), F.col("copy").alias("ordinal_copy"))


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record for each group of copies, with the number of its copies."""
    groups = formatting_duplicates(_read(spark, d, "chunks"), "ordinal", "canonical_text", "source_uri")
    return groups.where("kept = copy").select("kept", "copies")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_read(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(_read(spark, d, "documents"), _read(spark, d, "mix_targets"), id_col="doc_id", text_col="text", source_col="source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_bounds(spark: SparkSession, d: str) -> DataFrame:
    """For each source with tokens: no document is used too often, and the tokens of the mixture itself miss the source's share by at most one document."""
    mixture, report = _mix(spark, d)
    took = mixture.groupBy("source").agg(F.sum("tokens").alias("took"), F.max("tokens").alias("longest"), F.max("copy").alias("most"))
    rows = report.where("weight > 0 and max_repeats > 0 and available_tokens > 0").join(took, "source", "left").na.fill(0, ["took", "most"])
    met = (F.abs(F.col("took") - F.col("target_tokens")) <= F.coalesce("longest", "available_tokens")) & (F.col("took") == F.col("tokens"))
    return rows.select("source", (F.col("most") <= F.col("max_repeats")).alias("within_cap"), met.alias("met"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the posterior calls repetitive, of which those are kept whose windows meet the exact condition.

    The posterior also finds documents that repeat sentences or lines but have fewer repeated windows; it misses none of
    the condition's, as the rule on windows is trusted.
    """
    scored, _ = score_repetition(_read(spark, d, "documents"), "doc_id", "text")
    exact = (F.col("windows") >= 20) & (F.col("window_repeats") >= 0.3 * F.col("windows"))
    return scored.where("p_repetitive >= 0.5").where(exact).select(F.col("id").alias("doc_id"))


def p10_measures(spark: SparkSession, d: str) -> DataFrame:
    """Windows, and those that repeat earlier ones, of every document; the share is their ratio."""
    measured = repetition_measures(_read(spark, d, "documents"), "doc_id", "text")
    return measured.select(F.col("id").alias("doc_id"), "windows", "window_repeats", "top_window", "lines", "line_repeats")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    scored, _ = score_repetition(_read(spark, d, "documents"), "doc_id", "text")
    return scored.select(F.col("id").alias("doc_id"), "windows", "window_repeats", F.round("p_repetitive", 6).alias("p_repetitive"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_divergence, p3_found, p4_found, p4_recall, p5_found, p6_found, p6_counts, p7_found, p7_collapsed, p8_ids, p9_mix, p9_bounds, p9_shares, p10_found, p10_measures, p10_scores)
}


def _words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


# The look of a text in SQL, written out for itself: it shares nothing with the operator's tables. Letters stand above those they look like.
_SEEN = "АВЕКМНОРСТУХІЈЅԚԜ" + "аеорсухіјѕһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "οναιρυϲϳ"
_LATIN = "ABEKMHOPCTYXIJSQW" + "aeopcyxijshdqw" + "ABEZHIKMNOPTYX" + "ovaipucj"
_HALF_KANA = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ｡｢｣､･"
_FULL_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン\u3099\u309a。「」、・"


#: Look-alikes under an accent, and the mark, as code point, that the letter below them carries.
_ACCENTED = [("ЁёЇїӒӓӦӧӰӱΪΫϊϋ", "ЕеІіАаОоУуΙΥιυ", 776), ("ЀѐЍ", "ЕеИ", 768), ("ӐӑӖӗЎў", "АаЕеУу", 774), ("Ӯӯ", "Уу", 772), ("Ӳӳ", "Уу", 779), ("ЌΆΈΉΊΌΎάίόύ", "КΑΕΗΙΟΥαιου", 769)]


def _form_sql(text: str) -> str:
    """Letters under accents are taken apart, all is mapped, and composed again; full-width ASCII is 65248 code points above ASCII."""
    for one, several in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st")):
        text = f"replace({text}, '{one}', '{several}')"
    for whole, bare, mark in _ACCENTED:
        text = f"regexp_replace({text}, '([{whole}])', '\\1' || chr({mark}), 'g')"
        text = f"translate({text}, '{whole}', '{bare}')"
    points = lambda head, *spans: f"(select string_agg(chr(i::int), '' order by i) from (select unnest([{head}]::bigint[]{''.join(f' || range({a}, {z})' for a, z in spans)}) i))"
    wide, narrow = points("", (65281, 65375)), points("", (33, 127))
    blanks = points("160, 5760, 8239, 8287, 12288", (8192, 8203))
    hidden = points("173, 847, 1564, 4447, 4448, 6068, 6069, 6158, 12644, 65279, 65440", (8203, 8208), (8234, 8239), (8288, 8293), (8294, 8304), (65024, 65040))
    letters = f"translate(translate({text}, '{_SEEN}', '{_LATIN}'), '{_HALF_KANA}', '{_FULL_KANA}')"
    return f"nfc_normalize(translate(translate(translate({letters}, {wide}, {narrow}), {blanks}, repeat(' ', 16)), {hidden}, ''))"


#: Every white space inside a line, for trim().
_BLANKS = "'" + "".join(map(chr, (9, 31, 32, 160, 5760, *range(8192, 8203), 8239, 8287, 12288))) + "'"
_POSTINGS = "p as (select ordinal, term, max(tf) tf from postings where tf >= 1 and term is not null and ordinal is not null group by 1, 2)"
_STATS = "d as (select ordinal, sum(tf)::double dl from p group by 1), g as (select count(*)::double n, avg(dl) avgdl, sum(dl) total from d), t as (select term, count(*)::double df, sum(tf)::double cf from p group by 1)"

_COPIES = rf"""
with piece as (
  select ordinal, lower(split_part(source_uri, '?', 1)) path, source_uri, canonical_text,
    list_filter(regexp_split_to_array(canonical_text, '[;|\n]'), lambda x: regexp_matches(x, '[^\s]')) parts
  from chunks where canonical_text is not null and source_uri is not null),
form as (
  select ordinal, rtrim(path, '/') || case when contains(source_uri, '?') then '?' || array_to_string(list_sort(string_split(lower(substr(source_uri, strpos(source_uri, '?') + 1)), '&')), '&') else '' end uri,
    case when len(parts) >= 3 and len(list_filter(parts, lambda x: not regexp_matches(x, '^\s*[A-Za-z_]+\s*[:=]'))) = 0
      then list_sort(list_filter(list_transform(parts, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', '', 'g')), lambda x: x != ''))
      else list_filter([regexp_replace(lower(canonical_text), '[^\p{{L}}\p{{N}}]+', '', 'g')], lambda x: x != '') end text
  from piece),
grouped as (select uri, text, min(ordinal) kept, count(*) copies from form where len(text) > 0 group by 1, 2 having count(*) > 1)
"""

_FREQUENCIES = rf"""
with w as (select ordinal, unnest({_words("canonical_text")}) term from chunks where canonical_text is not null),
c as (select term, count(*) occurrences, count(distinct ordinal) records from w where length(term) >= 2 group by 1),
f as (select term, occurrences, records, case when records <= 2 then 'rare' when records > 0.1 * (select count(canonical_text) from chunks) then 'common' end band from c)
"""

ORACLE: dict[str, str] = {
    "p1_found": rf"""
with t as (select ordinal, {_words("canonical_text")} w from chunks where canonical_text is not null),
s as (select distinct ordinal, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) x from t where len(w) >= 3),
n as (select ordinal, count(*) n from s group by 1),
c as (select a.ordinal a, b.ordinal b, count(*) k from s a join s b on a.x = b.x and a.ordinal < b.ordinal group by 1, 2)
select a ordinal_a, b ordinal_b from c join n x on x.ordinal = a join n y on y.ordinal = b where 2 * k >= x.n + y.n - k and k < x.n + y.n - k""",
    "p2_found": f"""
with {_POSTINGS}, {_STATS},
w as (select p.ordinal, p.term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 9) weight
  from p join d using (ordinal) join t using (term), g)
select ordinal, term from (select *, row_number() over (partition by ordinal order by weight desc, term) r from w) where r = 1""",
    "p2_divergence": f"""
with {_POSTINGS}, {_STATS},
q as (select p.ordinal, p.term, (tf + 200.0 * (cf / total)) / (dl + 200.0) pd, cf / total pc, df from p join d using (ordinal) join t using (term), g),
w as (select ordinal, term, round(pd * ln(pd / pc), 9) weight from q where df >= 3)
select ordinal, term, round(weight, 6) weight from (select *, row_number() over (partition by ordinal order by weight desc, term) r from w) where r = 1""",
    "p3_found": rf"""
with x as (select distinct 'title' field, id k, title v from docs union all select 'canonical_text', chunk_id, canonical_text from chunks),
y as (select *, {_form_sql("v")} form from x where v is not null),
z as (select * from y where regexp_matches(form, '[^\s]'))
select a.field, a.k key_a, b.k key_b from z a join z b on a.field = b.field and a.form = b.form and a.k < b.k where a.v != b.v""",
    "p5_found": r"""
with recursive t as (select distinct id, text, length(text)::bigint n from docs where length(text) > 1200),
s as (
  select id, text, n, 0::bigint a, null::bigint b from t
  union all
  select id, text, n, case when b is null then a else b - 120 end,
    case when b is not null then null
      when regexp_matches(substr(text, a + 599, 602), '(?s)\n\n') then a + 598 + length(regexp_extract(substr(text, a + 599, 602), '(?s)^.*\n\n'))
      when regexp_matches(substr(text, a + 599, 602), '(?s)[.!?][ \t\n]') then a + 598 + length(regexp_extract(substr(text, a + 599, 602), '(?s)^.*[.!?][ \t\n]'))
      when regexp_matches(substr(text, a + 600, 601), '(?s)[ \t\n]') then a + 599 + length(regexp_extract(substr(text, a + 600, 601), '(?s)^.*[ \t\n]'))
      else a + 1200 end
  from s where n - a > 1200)
select distinct id, strlen(substr(text, 1, a))::bigint byte_start, strlen(substr(text, 1, coalesce(b, n)))::bigint byte_end
from s where b is not null or n - a <= 1200""",
    "p6_found": _FREQUENCIES + "select term, band from f where band is not null",
    "p6_counts": _FREQUENCIES + "select term, occurrences, records, band from f",
    "p7_found": _COPIES + "select kept ordinal_kept, ordinal ordinal_copy from form join grouped using (uri, text) where ordinal != kept",
    "p7_collapsed": _COPIES + "select kept, copies from grouped",
    "p4_recall": r"""
with e as (select ordinal, case when embedding is not null then len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0 end own, chunk_id from chunks where ordinal % 50 = 0),
c as (select chunk_id, arg_max(data, {'t': coalesce(cached_at, timestamp '0001-01-01'), 'd': data}) data from embeddings_v2 where model = 'floor-64/v1' and dim = 64 group by 1)
select true reached, count(*) asked from e left join c using (chunk_id) where coalesce(own, octet_length(data) = 256)""",
    "p9_bounds": "select source, true within_cap, true met from mix_targets where weight > 0 and max_repeats > 0 and source in (select source from documents where length(text) > 0)",
    "p10_measures": rf"""
with t as (select doc_id, {_words("text")} w, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(x, {_BLANKS})), lambda x: x != '') l from documents),
s as (select doc_id, l, case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else [] end x from t),
m as (select doc_id, max(n) - 1 top from (select doc_id, count(*) n from (select doc_id, unnest(x) y from s) group by doc_id, y) group by 1)
select doc_id, len(x)::bigint windows, (len(x) - len(list_distinct(x)))::bigint window_repeats, coalesce(top, 0)::bigint top_window, len(l)::bigint lines, (len(l) - len(list_distinct(l)))::bigint line_repeats
from s left join m using (doc_id)""",
    "p10_found": rf"""
with t as (select doc_id, {_words("text")} w from documents where text is not null),
s as (select doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) x from t where len(w) >= 5)
select doc_id from s group by 1 having count(*) >= 20 and (count(*) - count(distinct x)) / count(*) >= 0.3""",
}
