"""One query per operator over the test tables, and the SQL that says the same, for the driver's comparison.

Every query reads whole tables. Where SQL can't say an operator or takes too long on whole tables, there is none, and tests
compare the operator with brute force on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.embed import LexicalEmbedder, embed_column
from .functions.identity import CHUNK_DOMAIN, chunk_id, corpus_input_hash, item_input_hash
from .functions.sql import register_functions
from .functions.text import chunk_windows, derive, lexical_tokens, media_uri, template
from .functions.vectors import all_finite, cosine, decode_float16, dequantize_int8, distance_order, dot, encode_float16, l2_norm, quantize_int4, quantize_int8, truncate_renormalize
from .operators import evaluate as ev
from .operators.ann import ann_search, ivf_build
from .operators.dedup import cluster_order, dedup_expand, dedup_pool, dense_index, similarity_order
from .operators.graph import bounded_bfs, build_graph
from .errors import SpecError
from .operators.joins import check_total_order, interval_join, label_lookup, lookup_join, missing_references
from .operators.lexical import bm25_build, bm25_scores, bm25_search, invalid_postings, rrf_union
from .operators.media import blob_tables, blob_totals, broken_blobs, inverse_permutation, segment_offsets, span_overlay, stream_segments
from .operators.search import exact_search, graph_search, hybrid_search, neighbor_context, split_queries, top_k
from .sources.loaders import build_items, even_sample
from .tables import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: every vector whose id is divisible by 50, against all vectors."""
    return _t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.col("text").alias("canonical_text"), "source", "lang")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Search texts: the titles of the documents whose id is divisible by 50."""
    return _t(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("title").alias("text"))


_DOT = "list_inner_product(q.e, v.e)"
_V = "v as (select vec_id, label, embedding::double[] e from embeddings), q as (select * from v where vec_id % 50 = 0)"
_TOP = f"{_V}, s as (select q.vec_id qid, v.vec_id ordinal, {_DOT} / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))) score from q, v), r as (select *, row_number() over (partition by qid order by score desc, ordinal) rank from s)"
_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]{{2,}}')"
_BM25 = f"""tok as (select doc_id, {_TOKENS.format("text")} w from documents),
p as (select term, doc_id, count(*) tf from (select doc_id, unnest(w) term from tok) group by 1, 2),
t as (select term, count(*) df from p group by 1), dl as (select doc_id, len(w) dl from tok), g as (select count(*) n, avg(dl) avgdl from dl),
qt as (select qid, term, count(*) times from (select doc_id qid, unnest({_TOKENS.format("title")}) term from documents where doc_id % 50 = 0) group by 1, 2),
b as (select qid, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1))) * times) score from qt join t using (term) join p using (term) join dl using (doc_id), g group by 1, 2),
br as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) rank from b)"""


# searches


@query(f"with {_TOP} select qid, rank::int rank, ordinal, round(score, 6) score from r where rank <= 10")
def exact_topk(spark, d):
    return exact_search(_vectors(spark, d), _queries(spark, d), 10).select("qid", "rank", "ordinal", F.round("score", 6).alias("score"))


@query(f"with {_V}, s as (select q.vec_id qid, v.vec_id ordinal, round({_DOT} / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 6) score, row_number() over (partition by q.vec_id order by {_DOT} / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))) desc, v.vec_id) rank from q, v where v.label < 5) select qid, rank::int rank, ordinal, score from s where rank <= 5")
def exact_topk_filtered(spark, d):
    """The filter on labels comes before scoring and reaches the scan."""
    kept = _t(spark, d, "embeddings").where("label < 5").select(F.col("vec_id").alias("ordinal"), "embedding")
    return exact_search(kept, _queries(spark, d), 5).select("qid", "rank", "ordinal", F.round("score", 6).alias("score"))


@query(f"with {_V} select q.vec_id a, v.vec_id b, round({_DOT} / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 6) score from q join v on q.label = v.label and q.vec_id != v.vec_id")
def cosine_pairs(spark, d):
    """Cosines of each query vector with the vectors of its label."""
    v = _t(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("q"))
    return q.join(v.select(F.col("vec_id").alias("b"), "label", "embedding"), "label").where("a != b").select("a", "b", F.round(cosine("q", "embedding"), 6).alias("score"))


@query("with q as (select vec_id qid, case when vec_id % 7 = 0 then [] when vec_id % 7 = 1 then embedding[1:3] when vec_id % 7 = 2 then list_transform(embedding, lambda x: 'nan'::float) when vec_id % 7 = 3 then list_transform(embedding, lambda x: 0::float) else embedding end query from embeddings) select qid, case when len(query) = 0 then 'empty' when len(query) != 64 then 'dimension' when isnan(query[1]) then 'not finite' else 'zero' end reason from q where qid % 7 < 4")
def query_validation(spark, d):
    bad = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<float>")).when(F.col("vec_id") % 7 == 1, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 7 == 2, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).when(F.col("vec_id") % 7 == 3, F.transform("embedding", lambda x: F.lit(0).cast("float"))).otherwise(F.col("embedding"))
    return split_queries(_t(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), bad.alias("query")), 64)[1]


@query("with x as (select vec_id, label::double / nullif(label % 5, 0) s from embeddings), y as (select vec_id % 10 qid, vec_id ordinal, case when s is null then 'nan'::double else s end score from x), r as (select *, row_number() over (partition by qid order by isnan(score), score desc, ordinal) rank from y) select qid, rank::int rank, ordinal, case when isnan(score) then -1 else round(score, 6) end score from r where rank <= 20")
def score_order_nan_last(spark, d):
    s = F.when(F.col("label") % 5 == 0, float("nan")).otherwise(F.col("label").cast("double") / (F.col("label") % 5))
    rows = _t(spark, d, "embeddings").select((F.col("vec_id") % 10).alias("qid"), F.col("vec_id").alias("ordinal"), s.alias("score"))
    return top_k(rows, 20).select("qid", "rank", "ordinal", F.when(F.isnan("score"), -1.0).otherwise(F.round("score", 6)).alias("score"))


def _index(spark, d):
    return tuple(materialize(t, "cells") for t in ivf_build(_vectors(spark, d)))


@query()
def ann_topk(spark, d):
    return ann_search(_vectors(spark, d), _index(spark, d), _queries(spark, d), 10).select("qid", "rank", "ordinal", F.round("score", 6).alias("score"))


@query("select true reached, count(*) asked, count(*) * 10 found from embeddings where vec_id % 50 = 0")
def ann_recall(spark, d):
    """Whether the cells' answer holds 0.9 of the exact one and as many rows; the number of cells is measured to hold 0.95 on these queries."""
    v, q = _vectors(spark, d), _queries(spark, d)
    found = ann_search(v, _index(spark, d), q, 10)
    r = ev.recall_at_k(found, exact_search(v, q, 10), 10).agg((F.avg("recall") >= 0.9).alias("reached"), F.count("*").alias("asked"))
    return r.crossJoin(found.agg(F.count("*").alias("found")))  # one row each


@query("select count(*) vectors, count(*) different, true in_range from embeddings")
def ann_cells(spark, d):
    """Every vector is in one cell of the codebooks."""
    books, stored = _index(spark, d)
    sizes = [r["count"] for r in books.groupBy("level").count().collect()]
    return stored.agg(F.count("*").alias("vectors"), F.countDistinct("ordinal").alias("different"), ((F.min("cell") >= 0) & (F.max("cell") < prod(sizes))).alias("in_range"))


def _edges(spark, d):
    v = _vectors(spark, d)
    near = exact_search(v, v.select(F.col("ordinal").alias("qid"), F.col("embedding").alias("query")), 5)
    return build_graph(v.select("ordinal"), near, top_m=4)


_EDGES = "all_s as (select a.vec_id src, b.vec_id dst, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from embeddings a, embeddings b where a.vec_id != b.vec_id), sem as (select src, dst from (select *, row_number() over (partition by src order by s desc, dst) r from all_s) where r <= 4), e as (select a.vec_id src, 0::tinyint edge_type, b.vec_id dst from embeddings a join embeddings b on abs(a.vec_id - b.vec_id) = 1 union all select src, 1::tinyint, dst from sem)"


@query(f"with {_EDGES} select src, edge_type, dst from e")
def graph_edges(spark, d):
    return _edges(spark, d)


@query("select true passed, true reached")
def graph_recall_gate(spark, d):
    from .operators.battery import graph_recall_gate as gate

    return gate(_vectors(spark, d), _edges(spark, d), _queries(spark, d)).select("passed", (F.col("recall") >= 0.9).alias("reached"))


@query(f"""with recursive {_EDGES}, s as (select vec_id node, row_number() over (order by vec_id) - 1 arrival from embeddings where vec_id % 50 = 0 and vec_id < 500),
one as (select e.dst node, min({{'p': arrival, 't': edge_type, 'd': e.dst}}) how from s join e on e.src = s.node where e.dst not in (select node from s) group by 1)
select node, arrival, 0 hop from s union all select * from (select node, (select count(*) from s) + row_number() over (order by how) - 1 arrival, 1 hop from one) where arrival < 25""")
def graph_bfs_bounded(spark, d):
    """Ten seeds of one query, a frontier of 25: the order of arrival decides who is in."""
    seeds = _t(spark, d, "embeddings").where("vec_id % 50 = 0 and vec_id < 500").select(F.lit(0).cast("long").alias("qid"), F.col("vec_id").alias("node"), F.col("vec_id").alias("arrival"))
    return bounded_bfs(_edges(spark, d), seeds, hops=1, max_frontier=25).select("node", F.col("arrival").cast("long").alias("arrival"), "hop")


@query(f"with {_EDGES}, s as (select vec_id qid from embeddings where vec_id % 50 = 0), h1 as (select distinct qid, dst node from s join e on e.src = qid where dst != qid), h2 as (select distinct qid, dst node from h1 join e on e.src = node where dst != qid) select qid, qid node, 0 hop from s union all select qid, node, 1 from h1 union all select qid, node, 2 from (select * from h2 except select * from h1)")
def graph_bfs_2hop(spark, d):
    seeds = _t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("node"), F.lit(0).alias("arrival"))
    return bounded_bfs(_edges(spark, d), seeds, hops=2, max_frontier=100_000).select("qid", "node", "hop")


@query(f"with {_TOP} select qid, rank::int rank, ordinal, round(score, 6) score from r where rank <= 10")
def graph_search_rerank(spark, d):
    """Seeds are the exact best 20, so the walk can only add what the rerank puts behind the best 10."""
    return graph_search(_vectors(spark, d), _edges(spark, d), _queries(spark, d), 10, hops=1, ef=20).select("qid", "rank", "ordinal", F.round("score", 6).alias("score"))


@query(f"with {_V}, s as (select q.vec_id qid, v.vec_id ordinal, {_DOT} score from q, v where v.label = 3), r as (select *, row_number() over (partition by qid order by score desc, ordinal) rank from s) select qid, rank::int rank, ordinal, round(score, 5) score from r where rank <= 5")
def space_search(spark, d):
    """Each label as a named space: only its vectors are searched."""
    space = _t(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("ordinal"), "embedding")
    return exact_search(space, _queries(spark, d), 5, normalized=True).select("qid", "rank", "ordinal", F.round("score", 5).alias("score"))


# lexical


@query(f"with {_BM25} select term, doc_id ordinal, tf from p")
def bm25_postings(spark, d):
    return bm25_build(_chunks(spark, d))["postings"].select("term", "ordinal", "tf")


@query(f"with {_BM25} select term, df from t")
def bm25_terms(spark, d):
    return bm25_build(_chunks(spark, d))["terms"].select("term", "df")


@query(f"with {_BM25} select n n_docs, round(avgdl, 6) avgdl from g")
def bm25_corpus(spark, d):
    return bm25_build(_chunks(spark, d))["corpus"].select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def _bm25_top(spark, d, k):
    return bm25_search(bm25_build(_chunks(spark, d)), _texts(spark, d), k)


@query(f"with {_BM25} select qid, doc_id ordinal, round(score, 6) score from b")
def bm25_score_all(spark, d):
    return bm25_scores(bm25_build(_chunks(spark, d)), _texts(spark, d)).select("qid", "ordinal", F.round("score", 6).alias("score"))


@query(f"with {_BM25} select qid, ordinal, round(score, 6) score, rank::int rank from (select qid, doc_id ordinal, score, row_number() over (partition by qid order by round(score, 9) desc, doc_id) rank from b) where rank <= 10")
def bm25_topk(spark, d):
    """Sums of the same parts in another order differ in their last digits, so scores are ranked as rounded to 9."""
    scores = bm25_scores(bm25_build(_chunks(spark, d)), _texts(spark, d))
    return top_k(scores.withColumn("score", F.round("score", 9)), 10).select("qid", "rank", "ordinal", F.round("score", 6).alias("score"))


@query(f"with {_TOP}, a as (select qid, ordinal, rank from r where rank <= 20), c as (select qid, ordinal, row_number() over (partition by qid order by ordinal) rank from a), f as (select qid, ordinal, sum(1.0::double / (60 + rank)) score from (select * from a union all select * from c) group by 1, 2) select qid, ordinal, round(score, 9) score, row_number() over (partition by qid order by score desc, ordinal)::int rank from f")
def rrf_fusion(spark, d):
    """The exact order fused with the order of ids."""
    a = exact_search(_vectors(spark, d), _queries(spark, d), 20)
    b = a.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("ordinal")))
    return rrf_union(a, b).select("qid", "rank", "ordinal", F.round("score", 9).alias("score"))


@query(f"with {_TOP} select qid, rank::int rank, ordinal, round(score, 6) score from r where rank <= 10")
def hybrid_rerank(spark, d):
    """The lexical index holds all documents; documents without a vector can't be scored and fall away. The vector candidates hold the best 10."""
    v, q = _vectors(spark, d), _queries(spark, d)
    return hybrid_search(v, q, _texts(spark, d).join(q.select("qid"), "qid", "left_semi"), bm25_build(_chunks(spark, d)), 10, candidates=32).select("qid", "rank", "ordinal", F.round("score", 6).alias("score"))


@query(f"""with {_BM25}, dirty as (select term, doc_id, case when doc_id % 97 = 0 then 0 else tf end tf from p where doc_id % 101 != 0 or length(term) > 3),
counts as (select term, count(*) n from dirty group by 1), lens as (select doc_id, sum(tf) n from dirty group by 1)
select 'tf below 1' problem, count(*) n from dirty where tf < 1 having count(*) > 0
union all select 'posting of an unknown document', count(*) from dirty where doc_id % 103 = 0 having count(*) > 0
union all select 'df differs from the postings', count(*) from t left join counts c using (term) where df is distinct from c.n having count(*) > 0
union all select 'length differs from the postings', count(*) from dl left join lens l using (doc_id) where doc_id % 103 != 0 and dl != coalesce(l.n, 0) having count(*) > 0
union all select 'number of documents', 1 from g where n != (select count(*) from dl where doc_id % 103 != 0)
union all select 'average length', 1 from g where abs(avgdl - (select avg(dl) from dl where doc_id % 103 != 0)) > 1e-9 * avgdl""")
def bm25_validation(spark, d):
    """An index that was damaged: frequencies set to 0, postings and documents taken away, the rest as it was built."""
    index = bm25_build(_chunks(spark, d))
    broken = index["postings"].where("ordinal % 101 != 0 or length(term) > 3").withColumn("tf", F.when(F.col("ordinal") % 97 == 0, 0).otherwise(F.col("tf")))
    return invalid_postings(index | {"postings": broken, "doc_stats": index["doc_stats"].where("ordinal % 103 != 0")})


@query("select 0::bigint n")
def bm25_sound(spark, d):
    return invalid_postings(bm25_build(_chunks(spark, d))).agg(F.count("*").alias("n"))


# text and identity


@query(f"with t as (select doc_id, unnest({_TOKENS.format('text')}) term from documents) select doc_id, term, count(*) tf from t group by 1, 2")
def tokenize_tf(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(lexical_tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""with x as (select doc_id, text, length(text) n from documents where length(text) > 0),
w as (select doc_id, text, unnest(range(0, case when n <= {size} then 1 else 1 + ceil((n - {size}) / {step}.0)::bigint end)) i from x)
select doc_id, i::int chunk_no, substr(text, i * {step} + 1, {size}) canonical_text, strlen(substr(text, 1, i * {step}))::bigint byte_start, strlen(substr(text, 1, i * {step} + {size}))::bigint byte_end from w"""


@query(_windows_sql(512, 0))
def chunk_windows_plain(spark, d):
    return chunk_windows(_t(spark, d, "documents").select("doc_id", "text"), "text")


@query(_windows_sql(300, 60))
def chunk_windows_overlap(spark, d):
    return chunk_windows(_t(spark, d, "documents").select("doc_id", "text"), "text", max_chars=300, overlap=60)


def _bytes_sql(n: str, size: int) -> str:
    digits = f"lpad(lower(to_hex({n}::bigint)), 16, '0')"
    return " || ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(size))


def _id_sql(text: str = "canonical_text", uri: str = "source_uri", start: str = "byte_start", end: str = "byte_end", version: str = "v1") -> str:
    sized = lambda c: f"{_bytes_sql(f'octet_length(encode({c}))', 4)} || hex(encode({c}))"
    whole = " || ".join([f"'{CHUNK_DOMAIN.encode().hex()}'", sized(text), sized(uri), _bytes_sql(start, 8), _bytes_sql(end, 8), sized(f"'{version}'")])
    return f"'sha256:' || sha256(unhex({whole}))"


@query(f"select ordinal, {_id_sql()} chunk_id from chunks where canonical_text is not null and source_uri is not null")
def chunk_ids(spark, d):
    c = _t(spark, d, "chunks").where("canonical_text is not null and source_uri is not null")
    return c.select("ordinal", chunk_id("canonical_text", "source_uri", "byte_start", "byte_end", "v1").alias("chunk_id"))


@query("select ordinal, 'sha256:' || sha256(encode('text:') || unhex(sha256(coalesce(canonical_text, ''))) || encode('image:none' || 'label:' || coalesce(source_uri, '') || 'chunker:1')) item_input_hash from chunks")
def item_hashes(spark, d):
    c = _t(spark, d, "chunks")
    return c.select("ordinal", item_input_hash(F.coalesce("canonical_text", F.lit("")), None, "source_uri", "1").alias("item_input_hash"))


@query("""with h as (select row_number() over (order by ordinal) - 1 i, sha256(coalesce(canonical_text, '')) h from chunks), l as (select i // 65536 leaf, sha256(string_agg(h, '' order by i)) h from h group by 1)
select 'sha256:' || case when count(*) = 1 then max(h) else sha256(string_agg(h, '' order by leaf)) end digest from l""")
def corpus_digest(spark, d):
    """Over all chunks, in the order of their ordinals."""
    rows = dense_index(_t(spark, d, "chunks").select(F.col("ordinal").alias("old"), F.sha2(F.coalesce("canonical_text", F.lit("")), 256).alias("item_input_hash")), "old", "ordinal")
    return spark.createDataFrame([(corpus_input_hash(rows),)], "digest string")


@query(r"select id, regexp_replace(regexp_extract(rtrim(split_part(coalesce(source_uri, ''), '?', 1), '/'), '([^/]*)$', 1), '\.[^.]*$', '') stem, lower(coalesce(title, '')) low from docs")
def derive_columns(spark, d):
    docs = _t(spark, d, "docs").select("id", "title", "source_uri")
    return derive(derive(docs, "stem", "basename_stem(source_uri)"), "low", "lower(title)").select("id", "stem", "low")


@query(r"""with l as (select p_partkey, trim(regexp_replace(regexp_replace(p_name || ' (' || case when p_size > 25 then p_brand else '' end || ')', '\(\s*\)', '', 'g'), '\s{2,}', ' ', 'g')) a, case when p_size > 40 then 'size ' || p_size end b from part)
select p_partkey, a || coalesce(chr(10) || b, '') text from l""")
def template_render(spark, d):
    p = _t(spark, d, "part").withColumn("brand", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("")).withColumn("big", F.when(F.col("p_size") > 40, F.col("p_size").cast("string")).otherwise(""))
    return p.select("p_partkey", template(p, "{p_name} ({brand})\nsize {big}").alias("text"))


@query("select c_custkey, 'seg-' || (c_custkey // 100) || '.mp4' path, c_custkey % 100 frame from customer")
def media_uri_parse(spark, d):
    c = _t(spark, d, "customer").withColumn("uri", F.format_string("media://seg-%d.mp4#frame=%d", F.floor(F.col("c_custkey") / 100), F.col("c_custkey") % 100))
    parsed = c.select("c_custkey", media_uri("uri").alias("m"))
    return parsed.select("c_custkey", "m.path", "m.frame")


@query("with x as (select row_number() over (order by c_mktsegment, c_custkey::varchar) - 1 ordinal, c_custkey::varchar || '' k, c_mktsegment s, c_name from customer) select ordinal, s || '|' || k \"key\", c_name canonical_text, 'item://customers/' || s || '|' || k source_uri from x")
def build_item_rows(spark, d):
    """Source rows to items: composite string order, text, uri."""
    items = build_items(_t(spark, d, "customer"), "customers", order_by=["c_mktsegment", "c_custkey"], text_template="{c_name}")
    return items.select("ordinal", "key", "canonical_text", "source_uri")


@query("with n as (select count(*) n, least(500, count(*)) k from part), i as (select unnest(range(0, 500)) i) select i ordinal, p_partkey from i, n join part on p_partkey = floor(i * (n / k::double))::bigint where i < k")
def even_sample_rows(spark, d):
    return even_sample(_t(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), "p_partkey"), 500)


@query("select ordinal, coalesce((select string_agg(coalesce(b.canonical_text, ''), ' ' order by b.ordinal) from chunks b where b.ordinal between a.ordinal - 1 and a.ordinal + 1), '') context from chunks a")
def neighbor_contexts(spark, d):
    return neighbor_context(_t(spark, d, "chunks"), 1, " ")


# deduplication


@query("with f as (select text, min(doc_id) first from documents group by 1), p as (select *, row_number() over (order by first) - 1 pool_index from f) select d.doc_id, p.pool_index from documents d join p on d.text is not distinct from p.text")
def text_dedup(spark, d):
    return dedup_pool(_t(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")[1]


@query("select doc_id, text from documents")
def dedup_roundtrip(spark, d):
    pool, refs = dedup_pool(_t(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return dedup_expand(pool, refs, "text", "doc_id")


@query("with k as (select o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), 'row:' || o_orderkey) k from orders), f as (select k, min(o_orderkey) m from k group by 1), p as (select k, row_number() over (order by m) - 1 frame from f) select o_orderkey, frame from k join p using (k)")
def frame_dedup(spark, d):
    """Rows with the same source share a frame; rows without one don't."""
    from .operators.dedup import frame_map

    rows = _t(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("image_sha256"))
    return frame_map(rows, order="o_orderkey")[1]


@query()
def similarity_walk(spark, d):
    return similarity_order(_vectors(spark, d))


@query()
def cluster_walk(spark, d):
    return cluster_order(_vectors(spark, d), threshold=0.5)


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 ordinal from orders")
def assign_ordinals(spark, d):
    return dense_index(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "ordinal").select("o_orderkey", "ordinal")


# quantisation


@query("with m as (select vec_id, embedding e, list_max(list_transform(embedding, lambda x: abs(x))) top from embeddings), s as (select vec_id, e, case when top > 0 then (top / 127::float)::float else 1::float end scale from m) select vec_id, round(scale::double, 9) scale, list_transform(e, lambda x: greatest(-127, least(127, round((x / scale)::float)))::tinyint) codes from s")
def int8_quantize(spark, d):
    q = _t(spark, d, "embeddings").select("vec_id", quantize_int8("embedding").alias("q"))
    return q.select("vec_id", F.round(F.col("q.scale").cast("double"), 9).alias("scale"), F.col("q.codes").alias("codes"))


_INT8 = "m8 as (select vec_id, embedding e, list_max(list_transform(embedding, lambda x: abs(x))) top from embeddings), s8 as (select vec_id, e, case when top > 0 then (top / 127::float)::float else 1::float end scale from m8), v8 as (select vec_id, list_transform(e, lambda x: ((greatest(-127, least(127, round((x / scale)::float)))::float) * scale)::float)::double[] e from s8)"


@query(f"with {_V}, {_INT8}, s as (select q.vec_id qid, v8.vec_id ordinal, list_inner_product(q.e, v8.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v8.e, v8.e))) score from q, v8), r as (select *, row_number() over (partition by qid order by score desc, ordinal) rank from s) select qid, rank::int rank, ordinal, round(score, 6) score from r where rank <= 10")
def int8_search(spark, d):
    v = _vectors(spark, d).select("ordinal", dequantize_int8(quantize_int8("embedding")).alias("embedding"))
    return exact_search(v, _queries(spark, d), 10).select("qid", "rank", "ordinal", F.round("score", 6).alias("score"))


@query("""with b as (select vec_id, embedding e, (list_max(list_transform(embedding, lambda x: abs(x))) / 7::float)::float s from embeddings),
h as (select vec_id, e, case when s > 0 then (round_even((s / pow(2, floor(log2(s)) - 10))::double, 0) * pow(2, floor(log2(s)) - 10))::float else 1::float end s from b),
c as (select vec_id, s, list_transform(e, lambda x: (greatest(-7, least(7, trunc(((x / s)::float + case when x < 0 then -0.5 else 0.5 end)::float)))::int + 16) % 16) n from h)
select vec_id, round(s::double, 9) scale, array_to_string(list_transform(range(1, 33), lambda i: substr('0123456789ABCDEF', n[2 * i] + 1, 1) || substr('0123456789ABCDEF', n[2 * i - 1] + 1, 1)), '') codes from c""")
def int4_quantize(spark, d):
    """One block of 64: its half-precision scale, and the codes' bytes, the first of two in the low half."""
    q = _t(spark, d, "embeddings").select("vec_id", quantize_int4("embedding").alias("q"))
    return q.select("vec_id", F.round(F.get("q.scales", 0).cast("double"), 9).alias("scale"), F.hex("q.codes").alias("codes"))


@query("select vec_id, list_transform(embedding, lambda x: round((case when x = 0 then 0 else round_even((x::double / pow(2, greatest(floor(log2(abs(x::double))), -14) - 10)), 0) * pow(2, greatest(floor(log2(abs(x::double))), -14) - 10) end)::double, 8)) v from embeddings")
def float16_roundtrip(spark, d):
    back = decode_float16(encode_float16("embedding"))
    return _t(spark, d, "embeddings").select("vec_id", F.transform(back, lambda x: F.round(x.cast("double"), 8)).alias("v"))


@query("with p as (select vec_id, embedding[1:16]::double[] e from embeddings), n as (select vec_id, e, sqrt(list_inner_product(e, e)) n from p) select vec_id, list_transform(e, lambda x: round(x / n, 6)) v from n")
def mrl_truncate(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.transform(truncate_renormalize("embedding", 16), lambda x: F.round(x, 6)).alias("v"))


@query("select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) norm, round(list_inner_product(embedding::double[], embedding::double[]), 6) square from embeddings")
def vector_norms(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(l2_norm("embedding"), 6).alias("norm"), F.round(dot("embedding", "embedding"), 6).alias("square"))


@query("select ordinal from chunks where embedding is null or len(embedding) != 64 or len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 or byte_end < byte_start or canonical_text is null or source_uri is null or byte_start is null or byte_end is null or byte_start < 0")
def chunk_validation(spark, d):
    from .plans.corpus import bad_chunks

    return bad_chunks(_t(spark, d, "chunks"), 64).select("ordinal")


@query("select count(*) n from chunks where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0")
def finite_vectors(spark, d):
    return _t(spark, d, "chunks").where(F.col("embedding").isNotNull() & all_finite("embedding")).agg(F.count("*").alias("n"))


# joins and checks


@query("with o as (select o_custkey c_custkey, arg_max({'p': o_orderpriority, 's': o_orderstatus}, o_orderkey) x from orders group by 1) select c.c_custkey, c.c_name, x.p o_orderpriority, x.s o_orderstatus from customer c left join o using (c_custkey)")
def lookup_join_last_wins(spark, d):
    right = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus", "o_orderkey")
    return lookup_join(_t(spark, d, "customer").select("c_custkey", "c_name"), right, "c_custkey", order="o_orderkey")


@query("select 'l_orderkey' k, exists (select 1 from lineitem group by l_orderkey having count(*) > 1) refused union all select 'l_orderkey, l_linenumber', exists (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all select 'ordinal', exists (select 1 from chunks group by ordinal having count(*) > 1)")
def total_order_checks(spark, d):
    """Which sets of keys the check refuses."""
    out = []
    for table, keys in (("lineitem", ["l_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("chunks", ["ordinal"])):
        try:
            check_total_order(_t(spark, d, table), keys)
            out.append((", ".join(keys), False))
        except SpecError:
            out.append((", ".join(keys), True))
    return spark.createDataFrame(out, "k string, refused boolean")


@query("with x as (select query_ordinal, id, dist, row_number() over (partition by query_ordinal order by coalesce(isnan(dist), false), dist nulls last, id) r from candidates where dist is not null) select query_ordinal, id, case when isnan(dist) then -1 else round(dist::double, 6) end dist, r::int r from x where r <= 3")
def distance_order_nan_last(spark, d):
    """The three nearest of each list, NaN last."""
    w = Window.partitionBy("query_ordinal").orderBy(*distance_order("dist", "id"))
    c = _t(spark, d, "candidates").where("dist is not null").select("query_ordinal", "id", "dist", F.row_number().over(w).alias("r")).where("r <= 3")
    return c.select("query_ordinal", "id", F.when(F.isnan("dist"), -1.0).otherwise(F.round(F.col("dist").cast("double"), 6)).alias("dist"), "r")


@query("select o_orderkey, s.segment from orders join (select i segment, i * 777 start_frame, 500 n from range(0, 400) t(i)) s on o_orderkey >= start_frame and o_orderkey < start_frame + n")
def segment_interval_join(spark, d):
    segments = spark.range(400).select(F.col("id").alias("segment"), (F.col("id") * 777).alias("start_frame"), F.lit(500).alias("n_frames"))
    return interval_join(_t(spark, d, "orders").select("o_orderkey"), segments, point="o_orderkey", start="start_frame", length="n_frames").select("o_orderkey", "segment")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def missing_reference(spark, d):
    return missing_references(_t(spark, d, "orders"), _t(spark, d, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


@query("select s_suppkey, case when s_suppkey % 3 = 0 then '' else 'N' || s_nationkey end label from supplier")
def label_by_path_or_stem(spark, d):
    """Labels of half the suppliers by path, of the others by stem; a third has none."""
    s = _t(spark, d, "supplier").withColumn("origin", F.concat(F.lit("img/"), F.regexp_replace("s_name", "#", "-"), F.lit(".png")))
    named = s.where("s_suppkey % 3 != 0").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("origin")).otherwise(F.regexp_replace("s_name", "#", "-")).alias("name"), F.concat(F.lit("N"), "s_nationkey").alias("label"))
    return label_lookup(s.select("s_suppkey", "origin"), named).select("s_suppkey", "label")


# media tables


@query("with b as (select p_partkey - 1 blob_index, 'part://' || p_partkey u from part), s as (select ordinal, case when ordinal % 3 = 0 then ordinal % (select count(*) from part) end blob_index from chunks) select c.ordinal, coalesce(b.u, c.source_uri) source_uri, case when b.u is not null then 5 else c.byte_start end byte_start from chunks c join s using (ordinal) left join b using (blob_index)")
def blob_span_overlay(spark, d):
    """A blob for every part; every third chunk has a span in one of them."""
    part = _t(spark, d, "part")
    blobs = part.select((F.col("p_partkey") - 1).alias("blob_index"), F.concat(F.lit("part://"), "p_partkey").alias("original_uri"))
    c = _t(spark, d, "chunks").select("ordinal", "source_uri", "byte_start", "byte_end")
    spans = c.select("ordinal", F.when(F.col("ordinal") % 3 == 0, F.col("ordinal") % part.count()).alias("blob_index"), F.lit(5).cast("long").alias("byte_start"), F.lit(9).cast("long").alias("byte_end"))
    return span_overlay(c, spans, blobs).select("ordinal", "source_uri", "byte_start")


def _blobs(spark, d):
    return _t(spark, d, "embeddings_v2").where("data is not null").select(F.xxhash64("chunk_id").alias("blob_index"), F.when(F.length("data") % 8 == 0, F.sha2("data", 256)).otherwise("bad").alias("content_hash"), F.length("data").cast("long").alias("byte_len"), F.col("cached_at").isNotNull().alias("inlined"), "data", "chunk_id")


@query("select chunk_id, count(*) n from embeddings_v2 where data is not null and cached_at is not null and octet_length(data) % 8 != 0 group by 1")
def blob_proof(spark, d):
    return broken_blobs(_blobs(spark, d)).groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("select count(*) blobs, count(*) filter (cached_at is not null) inlined, count(*) filter (cached_at is null) sidecar, sum(octet_length(data))::bigint bytes from embeddings_v2 where data is not null")
def blob_total(spark, d):
    return blob_totals(_blobs(spark, d))


@query("select p_partkey // 64 segment, min(p_partkey) start_frame, count(*) n_frames from part group by 1")
def media_segments(spark, d):
    return stream_segments(_t(spark, d, "part").select(F.col("p_partkey").alias("position")), 64)


@query("with n as (select o_orderkey segment, count(*) n_frames from orders join lineitem on l_orderkey = o_orderkey group by 1) select segment, n_frames, coalesce(sum(n_frames) over (order by segment rows between unbounded preceding and 1 preceding), 0)::bigint start_frame from n")
def segment_running_sum(spark, d):
    """Orders as segments, their lines as frames."""
    return segment_offsets(_t(spark, d, "lineitem").join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy(F.col("l_orderkey").alias("segment")).agg(F.count("*").alias("n_frames")))


@query("with f as (select s_nationkey, min(s_suppkey) m from supplier group by 1), b as (select s_nationkey, row_number() over (order by m) - 1 blob_index from f) select s_suppkey ordinal, blob_index from supplier join b using (s_nationkey)")
def blob_table_spans(spark, d):
    items = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.concat(F.lit("n"), "s_nationkey").alias("uri"), F.lit(7).cast("long").alias("byte_len"))
    return blob_tables(items)[1].select("ordinal", "blob_index")


# evaluation

_TWO = f"{_TOP}, a as (select qid, rank, ordinal, score from r where rank <= 10), b0 as (select q.vec_id qid, v.vec_id ordinal, list_inner_product(q.e[1:32], v.e[1:32]) / (sqrt(list_inner_product(q.e[1:32], q.e[1:32])) * sqrt(list_inner_product(v.e[1:32], v.e[1:32]))) score from q, v), b as (select qid, rank, ordinal, score from (select *, row_number() over (partition by qid order by score desc, ordinal) rank from b0) where rank <= 10)"


def _two(spark, d):
    """Rankings by whole vectors and by their first half."""
    half = lambda c: F.slice(c, 1, 32)
    v, q = _vectors(spark, d), _queries(spark, d)
    return exact_search(v, q, 10), exact_search(v.select("ordinal", half("embedding").alias("embedding")), q.select("qid", half("query").alias("query")), 10)


@query(f"with {_TWO} select a.qid, round(count(b.ordinal) / 10.0::double, 6) recall from a left join b using (qid, ordinal) group by 1")
def recall_at_k(spark, d):
    a, b = _two(spark, d)
    return ev.recall_at_k(b, a, 10).select("qid", F.round("recall", 6).alias("recall"))


@query(f"with {_TOP}, o as (select r.*, row_number() over (partition by qid order by rank) n from r where qid != ordinal and rank <= 11), j as (select o.qid, (x.label = y.label)::int same from o join embeddings x on x.vec_id = o.qid join embeddings y on y.vec_id = o.ordinal where n <= 10) select qid, round(avg(same), 6) \"precision\", max(same) hit from j group by 1")
def precision_at_k_label(spark, d):
    found = exact_search(_vectors(spark, d), _queries(spark, d), 11)
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("label").cast("string").alias("label"))
    return ev.label_precision(found, labels, 10).select("qid", F.round("precision", 6).alias("precision"), "hit")


@query("with c as (select label, count(*) n from embeddings group by 1), t as (select sum(n) t from c) select round(sum(n / t * (n - 1) / (t - 1))::double, 6) \"precision\" from c, t")
def random_label_precision(spark, d):
    return ev.random_label_precision(_t(spark, d, "embeddings").select(F.col("label").cast("string").alias("label"))).select(F.round("precision", 6).alias("precision"))


@query(f"with {_TWO}, g as (select a.qid, a.ordinal from a where rank = 2), m as (select g.qid, min(b.rank) rank from g left join b using (qid, ordinal) group by 1) select round(avg(coalesce(1.0::double / rank, 0)), 6) mrr, round(avg(coalesce((rank <= 1)::int, 0)), 6) hit_at_1, round(avg(coalesce((rank <= 3)::int, 0)), 6) hit_at_3 from m")
def mrr(spark, d):
    a, b = _two(spark, d)
    r = ev.mean_reciprocal_rank(b, a.where("rank = 2").select("qid", "ordinal"))
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query(f"with {_TWO}, both_s as (select a.qid, a.ordinal, a.rank ra, b.rank rb from a join b using (qid, ordinal)), p as (select x.qid, sign((x.ra - y.ra) * (x.rb - y.rb)) s from both_s x join both_s y on x.qid = y.qid and x.ordinal < y.ordinal), n as (select qid, count(*) n from both_s group by 1), t as (select qid, sum(s) / sum(abs(s)) tau from p group by 1) select q.qid, round(coalesce(n, 0) / 10.0::double, 6) overlap, round(tau::double, 6) tau from (select distinct qid from a) q left join n using (qid) left join t using (qid)")
def overlap_tau(spark, d):
    a, b = _two(spark, d)
    return ev.ranking_agreement(a, b, 10).select("qid", F.round("overlap", 6).alias("overlap"), F.round("tau", 6).alias("tau"))


@query("with c as (select list_cosine_similarity(a.embedding::double[], b.embedding::double[]) c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select round(min(c), 6) min, round(quantile_cont(c, 0.05), 6) p05, round(quantile_cont(c, 0.25), 6) p25, round(quantile_cont(c, 0.5), 6) median, round(quantile_cont(c, 0.75), 6) p75, round(quantile_cont(c, 0.95), 6) p95, round(max(c), 6) max from c")
def drift_percentiles(spark, d):
    v = _t(spark, d, "embeddings")
    pairs = v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    r = ev.drift(pairs)
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("select sum((l_discount > l_tax)::int)::bigint pos, sum((l_discount < l_tax)::int)::bigint neg from lineitem")
def sign_test_counts(spark, d):
    return ev.sign_counts(_t(spark, d, "lineitem"), "l_discount", "l_tax")


@query("with x as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 pos, greatest(1, floor(count(*) over (partition by o_orderpriority) / 12.0))::bigint step from orders) select o_orderkey, o_orderpriority from x where pos % step = 0 and pos / step < 12")
def stratified_sample(spark, d):
    return ev.stratified_pick(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 12)


@query("with b as (select l_linenumber lv, l_returnflag bu, quantile_cont(l_quantity, 0.1) p10, min(l_quantity) mn from lineitem group by 1, 2), l as (select lv, min(p10) worst, min(mn) least from b group by 1) select lv \"level\", round(worst, 6) worst_p10, least, worst >= 5 and least >= 1 passed from l")
def bucket_gate(spark, d):
    scores = _t(spark, d, "lineitem").select(F.col("l_linenumber").alias("level"), F.col("l_returnflag").alias("bucket"), F.col("l_quantity").alias("score"))
    return ev.quality_ladder(scores, floor_p10=5, floor_min=1).select("level", F.round("worst_p10", 6).alias("worst_p10"), "least", "passed")


@query("select o_custkey item, arg_min(o_orderkey, {'s': o_totalprice, 'i': o_orderkey}) candidate from orders group by 1")
def smallest_of_candidates(spark, d):
    return ev.smallest_candidate(_t(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("candidate"), F.col("o_totalprice").alias("size")))


@query("select round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99 from events")
def percentiles_linear(spark, d):
    r = ev.linear_percentiles(_t(spark, d, "events"), "value", [0.5, 0.95, 0.99])
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query()
def bootstrap_by_class(spark, d):
    pairs = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_nationkey").alias("cls"), F.col("s_acctbal").alias("sample"), F.lit(4000.0).alias("control"))
    return ev.bootstrap_delta(pairs, by="cls")


@query()
def lexical_embedding(spark, d):
    return _t(spark, d, "documents").select("doc_id", embed_column("title", LexicalEmbedder(64)).alias("embedding"))


# a corpus, built once a session and folder from the chunks that keep the store's rules, and its verbs

_BUILT: dict[tuple[str, str], object] = {}
_OWN = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0 and canonical_text is not null and source_uri is not null and byte_start >= 0 and byte_end >= byte_start"
_STORE = f"c as (select row_number() over (order by ordinal) - 1 ordinal, canonical_text, source_uri, byte_start, byte_end, embedding::double[] e from chunks where {_OWN}), ids as (select *, {_id_sql(version='q1')} chunk_id from c)"
_ASKED = "q as (select vec_id qid, embedding::double[] v from embeddings where vec_id % 50 = 0)"
_COSINE = "list_inner_product(q.v, c.e) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.e, c.e)))"
_FOUND = f"{_STORE}, {_ASKED}, s as (select qid, ordinal, round({_COSINE}, 9) score from q, c), r as (select *, row_number() over (partition by qid order by score desc, ordinal) rank from s)"


def _corpus(spark, d):
    from .functions.vectors import l2_norm
    from .plans.corpus import bad_chunks, build_corpus
    from .tables import work_dir

    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        c = _t(spark, d, "chunks")
        sound = c.join(bad_chunks(c, 64).select("ordinal"), "ordinal", "left_anti").where(l2_norm("embedding") > 0)
        rows = materialize(dense_index(sound.select(F.col("ordinal").alias("_old"), "canonical_text", "source_uri", "byte_start", "byte_end", "embedding"), "_old", "ordinal").drop("_old"), "store-rows")
        spaces = {"even": rows.where("ordinal % 2 = 0").select("ordinal", truncate_renormalize("embedding", 32).cast("array<float>").alias("embedding"))}
        path = f"{work_dir(spark)}/store-{abs(hash(key))}-{len(_BUILT)}"
        _BUILT[key] = build_corpus(rows, path, embedding_model="test", embedding_dim=64, model_hash="sha256:" + "1" * 64, chunker_version="q1", preset="hybrid", spaces=spaces)
    return _BUILT[key]


def _asked(spark, d):
    return _queries(spark, d)


@query(f"with {_STORE} select ordinal, chunk_id, byte_start, byte_end from ids")
def corpus_chunks(spark, d):
    """Build, rename, open, scan."""
    return _corpus(spark, d).chunks.select("ordinal", "chunk_id", "byte_start", "byte_end")


@query(f"with {_FOUND} select r.qid, r.rank::int rank, r.ordinal, round(r.score::float::double, 5) score, ids.chunk_id, ids.source_uri, ids.byte_start offset_start, ids.byte_end offset_end, 'exact' index_type, false reranked, true cited from r join ids using (ordinal) where rank <= 5")
def corpus_hits(spark, d):
    """Citable hits of the exact search; scores are ranked as rounded to 9 digits, as equal texts have vectors that differ in scale only."""
    c = _corpus(spark, d)
    scored = exact_search(c.vectors, _asked(spark, d), 60).withColumn("score", F.round("score", 9))
    h = c.hits(top_k(scored, 5), "exact")
    cited = F.col("citation_id") == F.concat(F.lit(f"corpus://{c.manifest.content_hash}/"), "chunk_id")
    return h.select("qid", "rank", "ordinal", F.round(F.col("score").cast("double"), 5).alias("score"), "chunk_id", "source_uri", "offset_start", "offset_end", "index_type", "reranked", cited.alias("cited"))


@query("select vec_id qid, case when vec_id % 100 = 0 then 'hnsw' else 'hybrid' end index_type, true reranked, 5::bigint n from embeddings where vec_id % 50 = 0")
def corpus_routes(spark, d):
    """Queries with a text go the hybrid way, those with a blank one the other; every row says which."""
    q = _asked(spark, d).withColumn("text", F.when(F.col("qid") % 100 == 0, " ").otherwise("alpha"))
    return _corpus(spark, d).retrieve(q, 5).groupBy("qid", "index_type", "reranked").agg(F.count("*").alias("n"))


@query(f"with {_STORE}, {_ASKED}, s as (select qid, 'exact' route, (select count(*) from c) exact_candidates from q) select qid, route, exact_candidates, 0::bigint graph_candidates, 'none' fusion_mode, 1.0::double recall from s")
def corpus_explain(spark, d):
    e = _corpus(spark, d).explain(_asked(spark, d), 5, "exact")
    return e.select("qid", "route", "exact_candidates", "graph_candidates", "fusion_mode", F.col("recall_estimate").cast("double").alias("recall"))


@query(f"with {_STORE}, {_ASKED} select q.qid, 'hybrid' route, true asked_some, true lexical, true unknown_recall from q")
def corpus_explain_hybrid(spark, d):
    q = _asked(spark, d).withColumn("text", F.lit("de la und the"))
    e = _corpus(spark, d).explain(q, 5, "hybrid")
    return e.select("qid", "route", (F.col("ann_candidates") > 0).alias("asked_some"), (F.col("bm25_candidates") <= 64).alias("lexical"), F.isnan("recall_estimate").alias("unknown_recall"))


@query(f"with {_STORE}, half as (select ordinal, e[1:32] e from c where ordinal % 2 = 0), q as (select vec_id qid, embedding[1:32]::double[] v from embeddings where vec_id % 50 = 0), s as (select qid, max(round({_COSINE.replace('c.e', 'half.e')}, 5)) best, count(*) n from q, half group by 1) select qid, best from s")
def corpus_space(spark, d):
    """The best score in a named space of half the chunks and half the dimensions."""
    q = _queries(spark, d).select("qid", F.slice("query", 1, 32).alias("query"))
    return _corpus(spark, d).search_space("even", q, 1).select("qid", F.round("score", 5).alias("best"))


@query(f"with {_STORE} select ordinal, canonical_text from c where ordinal >= 20 and ordinal < 50")
def corpus_browse(spark, d):
    return _corpus(spark, d).browse(20, 30).select("ordinal", "canonical_text")


@query(f"with {_STORE} select a.ordinal, (select string_agg(b.canonical_text, ' ' order by b.ordinal) from c b where b.ordinal between a.ordinal - 1 and a.ordinal + 1) context from c a")
def corpus_context(spark, d):
    return _corpus(spark, d).context(1, " ")


@query(f"""with {_STORE}, tok as (select ordinal, {_TOKENS.format("canonical_text")} w from c), p as (select ordinal, unnest(w) term from tok)
select 'chunks' "table", count(*) n from c union all select 'vectors', count(*) from c union all select 'ann_cells', count(*) from c union all select 'bm25_doc_stats', count(*) from c
union all select 'bm25_postings', count(distinct (ordinal, term)) from p union all select 'bm25_terms', count(distinct term) from p union all select 'bm25_corpus', 1""")
def corpus_tables(spark, d):
    """Rows of each table of the built corpus, by inspect()."""
    rows = _corpus(spark, d).inspect()["rows"]
    return spark.createDataFrame([(t, n) for t, n in rows.items() if t not in ("ann_codebooks", "ann_probes")], "`table` string, n long")


@query("select * from (values ('as it is', 'sound'), ('contract', 'ManifestError'), ('model', 'ModelMismatch'), ('space', 'NotIndexed'), ('citation', 'CitationError')) t(damage, said)")
def corpus_refusals(spark, d):
    """What the corpus says to damage and to wrong questions."""
    from .errors import CorvaneError
    from .plans.corpus import Corpus
    from .plans.manifest import Manifest, check_model

    c = _corpus(spark, d)
    other = Manifest.from_json(c.manifest.to_json())
    other.index_type, other.capabilities.bm25 = "hnsw", False
    asks = {
        "as it is": c.validate, "contract": Corpus(spark, c.path, other).check_contract, "model": lambda: check_model(c.manifest, "sha256:" + "2" * 64),
        "space": lambda: c.space("none"), "citation": lambda: c.cite(f"corpus://{c.manifest.content_hash}/sha256:none"),
    }
    said = []
    for name, ask in asks.items():
        try:
            ask()
            said.append((name, "sound"))
        except CorvaneError as e:
            said.append((name, type(e).__name__))
    return spark.createDataFrame(said, "damage string, said string")


@query("select vec_id, case when vec_id % 5 = 0 then 'not finite' when vec_id % 5 = 1 then 'dimension' when vec_id % 5 = 2 then 'null' end problem from embeddings where vec_id % 5 < 3")
def slab_validation(spark, d):
    """Stored int8 vectors with scales, lengths and rows damaged."""
    from .plans.corpus import bad_slab

    q = _t(spark, d, "embeddings").select(F.col("vec_id"), quantize_int8("embedding").alias("q"))
    scale = F.when(F.col("vec_id") % 5 == 0, float("nan")).otherwise(F.col("q.scale")).cast("float")
    codes = F.when(F.col("vec_id") % 5 == 1, F.slice("q.codes", 1, 63)).otherwise(F.col("q.codes"))
    stored = q.select("vec_id", F.when(F.col("vec_id") % 5 != 2, F.struct(scale.alias("scale"), codes.alias("codes"))).alias("embedding"))
    return bad_slab(stored, "int8", 64).select("vec_id", "problem")


@query("select position, ordinal from (select row_number() over (order by vec_id desc) - 1 position, vec_id ordinal from embeddings)")
def inverse_order(spark, d):
    """A permutation, inverted twice."""
    n = _t(spark, d, "embeddings").count()
    order = _t(spark, d, "embeddings").select((F.lit(n - 1) - F.col("vec_id")).alias("position"), F.col("vec_id").alias("ordinal"))
    once = inverse_permutation(order)
    return inverse_permutation(once.select(F.col("ordinal").alias("position"), F.col("position").alias("ordinal"))).select(F.col("ordinal").alias("position"), F.col("position").alias("ordinal"))


@query("with x as (select o_totalprice v, row_number() over (order by o_totalprice, o_orderkey) - 1 i, count(*) over () n from orders) select v value from x where i = round_even(0.95 * (n - 1), 0)")
def nearest_rank_value(spark, d):
    rows = _t(spark, d, "orders").select("o_totalprice")
    return ev.nearest_rank(rows, "o_totalprice", 0.95)


# source queries: Spark's SQL surface as a source of a build


def _sql_query(name: str, spark_sql: str, oracle: str | None = None) -> None:
    def run(spark, d):
        register_functions(spark)
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
            _t(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    run.__name__ = name
    query(oracle or spark_sql)(run)


_sql_query("q_join_agg", "select n_name, r_name, count(*) n, cast(round(sum(o_totalprice), 2) as double) total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name, r_name")
_sql_query("q_pricing", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus")
_sql_query("q_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
_sql_query("q_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
_sql_query("q_window_rank", "select * from (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as int) r from orders) x where r <= 3")
_sql_query("q_window_frame", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 1 preceding and 1 following), 2) s, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) p from orders")
_sql_query("q_rollup", "select o_orderstatus, o_orderpriority, count(*) n from orders group by rollup(o_orderstatus, o_orderpriority)")
_sql_query("q_cube", "select o_orderstatus, o_orderpriority, count(*) n from orders group by cube(o_orderstatus, o_orderpriority)")
_sql_query("q_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
_sql_query("q_union", "select c_nationkey k from customer union select s_nationkey from supplier")
_sql_query("q_union_all", "select c_nationkey k from customer union all select s_nationkey from supplier")
_sql_query("q_intersect", "select c_nationkey k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier where s_acctbal > 5000")
_sql_query("q_except", "select n_nationkey k from nation except select s_nationkey from supplier where s_acctbal > 9000")
_sql_query("q_full_outer", "select coalesce(a.k, b.k) k, a.n an, b.n bn from (select c_nationkey k, count(*) n from customer where c_acctbal > 9500 group by 1) a full outer join (select s_nationkey k, count(*) n from supplier where s_acctbal > 5000 group by 1) b on a.k = b.k")
_sql_query(
    "q_asof_like",
    """select o_orderkey, next_event from (select o_orderkey, min(ts) over (partition by k order by t desc range between unbounded preceding and current row) next_event
from (select o_orderkey, o_custkey k, o_orderdate t, cast(null as timestamp_ntz) ts from orders union all select null, user_id, ts, ts from events)) x where o_orderkey is not null and next_event is not null""",
    "select o.o_orderkey, min(e.ts) next_event from orders o join events e on e.user_id = o.o_custkey and e.ts >= o.o_orderdate group by o.o_orderkey",
)
_sql_query("q_json_props", "select event_id, get_json_object(props, '$.k') k from events where props is not null", "select event_id, json_extract_string(props, '$.k') k from events where props is not null")
_sql_query("q_tumbling_window", "select window(ts, '1 hour').start w, event_type, count(*) n from events group by window(ts, '1 hour'), event_type", "select time_bucket(interval '1 hour', ts) w, event_type, count(*) n from events group by 1, 2")
_sql_query("q_session_window", "select user_id, session_window(ts, '30 minutes').start s, count(*) n from events where ts is not null group by user_id, session_window(ts, '30 minutes')", "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end f from events where ts is not null), y as (select user_id, ts, sum(f) over (partition by user_id order by ts rows unbounded preceding) g from x) select user_id, min(ts) s, count(*) n from y group by user_id, g")
_sql_query("q_vector_functions", "select a.vec_id, round(vector_cosine(cast(a.embedding as array<double>), cast(b.embedding as array<double>)), 6) c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
_sql_query("q_chunk_udtf", "select doc_id, c.chunk_no, c.byte_start, c.byte_end from documents, lateral chunk_text(text, 512, 0) c", f"select doc_id, chunk_no, byte_start, byte_end from ({_windows_sql(512, 0)})")
