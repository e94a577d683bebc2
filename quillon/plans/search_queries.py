"""Queries on retrieval, fusion, reranking, context and metrics.

Searches take as queries every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import context, fusion, metrics, rerank, sparse, vector
from quillon.plans.registry import kept, query, table, words
from quillon.plans.text_queries import docs


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")


def asked_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).where("key % 20 = 0").select(F.col("key").alias("qid"), "vector", "label")


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


# ---------------------------------------------------------------- dense

_VECTORS = "v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT key AS qid, v AS qv, label AS qlabel FROM v WHERE key % 20 = 0)"
_COSINE = "round(list_dot_product(qv, v) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 6) + 0.0"


def _knn(score: str, order: str = "DESC", k: int = 10, where: str = "TRUE", name: str = "score") -> str:
    return f"WITH {_VECTORS}, s AS (SELECT qid, key, {score} AS {name} FROM q, v WHERE {where}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {name} {order}, key) AS INTEGER) AS rank FROM s) SELECT qid, key, {name}, rank FROM r WHERE rank <= {k}"


def _plus(df):
    """Without a negative zero."""
    return df.withColumn("score", F.col("score") + 0.0)


@query(_knn("round(list_dot_product(qv, v), 6) + 0.0"))
def knn_cosine_flat(spark, sf_dir):
    return _plus(vector.search(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 10, vector.inner))


@query(_knn(f"round(1.0 - ({_COSINE}), 6) + 0.0", "ASC", name="distance"))
def knn_cosine_distance(spark, sf_dir):
    found = vector.search(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 10)
    return found.select("qid", "key", (F.round(1.0 - F.col("score"), 6) + 0.0).alias("distance"), "rank")


@query(_knn("round(list_sum(list_transform(list_zip(qv, v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) + 0.0", "ASC", name="distance"))
def knn_l2(spark, sf_dir):
    found = vector.search(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 10, vector.minus_l2)
    return found.select("qid", "key", (0.0 - F.col("score")).alias("distance"), "rank")


@query(_knn(_COSINE, where="label IN (1, 3, 5)"))
def knn_filtered(spark, sf_dir):
    return _plus(vector.search(vectors(spark, sf_dir).where(F.col("label").isin(1, 3, 5)), asked_vectors(spark, sf_dir)))


_DISTANCE = "round(list_dot_product({v}, {v}) + list_dot_product(cv, cv) - 2 * list_dot_product({v}, cv), 9)"


@query(f"""WITH {_VECTORS}, c AS (SELECT key AS cell, v AS cv FROM v WHERE key < 16),
a AS (SELECT key, v, cell FROM (SELECT key, v, cell, row_number() OVER (PARTITION BY key ORDER BY {_DISTANCE.format(v='v')}, cell) AS nth FROM v, c) WHERE nth = 1),
p AS (SELECT qid, qv, cell FROM (SELECT qid, qv, cell, row_number() OVER (PARTITION BY qid ORDER BY {_DISTANCE.format(v='qv')}, cell) AS nth FROM q, c) WHERE nth <= 6),
s AS (SELECT qid, key, {_COSINE} AS score FROM p JOIN a USING (cell)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS INTEGER) AS rank FROM s) SELECT qid, key, score, rank FROM r WHERE rank <= 10""")
def knn_ivf(spark, sf_dir):
    """Six of sixteen cells probed, round fixed centres; recall with fitted ones is measured by the tests."""
    v = vectors(spark, sf_dir)

    def build(keep):
        centres = np.array([r[0] for r in v.where("key < 16").orderBy("key").select("vector").collect()], np.float64)
        return vector.IvfIndex.build(v, keep, centres=centres)

    return _plus(kept(spark, sf_dir, "ivf", build).search(asked_vectors(spark, sf_dir), 10, 6))


@query()
def knn_lsh(spark, sf_dir):
    index = kept(spark, sf_dir, "lsh", lambda keep: vector.LshIndex.build(vectors(spark, sf_dir), keep))
    return _plus(index.search(asked_vectors(spark, sf_dir), 10))


@query("SELECT vec_id, pos, round(x / n, 6) + 0.0 AS x FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)")
def l2_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vector.l2_normalize(F.col("embedding"))).alias("pos", "x"))
    return v.select("vec_id", "pos", (F.round("x", 6) + 0.0).alias("x"))


def _embedded(rows: str, key: str) -> str:
    return f"""SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM (SELECT {key}, CAST(('0x' || substr(md5(w), 1, 7))::BIGINT % 64 AS INTEGER) AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {key}, unnest({words('lower(text)')}) AS w FROM {rows}) GROUP BY ALL)"""


@query(f"SELECT doc_id, bucket, round(weight, 6) AS weight FROM ({_embedded('documents', 'doc_id')})")
def hash_embed(spark, sf_dir):
    return vector.hash_embed_rows(docs(spark, sf_dir), "doc_id", "content").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


# ---------------------------------------------------------------- sparse

_TOKENS = f"t AS (SELECT doc_id, {words('lower(text)')} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM u GROUP BY ALL)"


@query(f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {words('lower(text)')} AS w FROM documents)")
def tokenize_ws(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", sparse.tokens(F.col("content")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(f"WITH {_TOKENS} SELECT doc_id, term, tf FROM tf")
def term_freq(spark, sf_dir):
    return sparse.term_freq(docs(spark, sf_dir))


@query(f"WITH {_TOKENS} SELECT term, count(*) AS df FROM tf GROUP BY term")
def doc_freq(spark, sf_dir):
    return sparse.doc_freq(sparse.term_freq(docs(spark, sf_dir)))


@query(f"SELECT count(*) AS n, round(sum(len({words('lower(text)')})) / count(*), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf_dir):
    return sparse.corpus_stats(docs(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_TOKENS}, n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM d, n")
def bm25_idf(spark, sf_dir):
    d = docs(spark, sf_dir)
    n = d.agg(F.count("*").alias("n"))
    return sparse.doc_freq(sparse.term_freq(d)).crossJoin(F.broadcast(n)).select("term", F.round(sparse.idf(F.col("n"), F.col("df")), 6).alias("idf"))


_BM25 = f"""{_TOKENS}, l AS (SELECT doc_id, len(w) AS dl FROM t), c AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM l), d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({words('lower(text)')}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL),
bs AS (SELECT qid, doc_id AS key, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN tf USING (term) JOIN d USING (term) JOIN l USING (doc_id), c GROUP BY ALL),
bm AS (SELECT qid, key, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS INTEGER) AS rank FROM bs WHERE score > 0)"""


def bm25_index(spark, sf_dir):
    return kept(spark, sf_dir, "bm25", lambda keep: sparse.Bm25Index.build(docs(spark, sf_dir), keep))


def bm25(spark, sf_dir, k=20):
    return bm25_index(spark, sf_dir).search(asked(spark, sf_dir), k)


@query(f"WITH {_BM25} SELECT qid, key, score, rank FROM bm WHERE rank <= 20")
def bm25_search(spark, sf_dir):
    return bm25(spark, sf_dir)


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _features(rows: str, key: str, name: str) -> str:
    return rf"""{name}t AS (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT list_contains([{_STOP}], x)) AS w FROM {rows}),
{name}f AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}t) GROUP BY ALL)"""


_VOCAB = f"{_features('documents', 'doc_id', 'd')}, voc AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, sum(tf) AS cf, count(*) AS df FROM df GROUP BY term ORDER BY cf DESC, term LIMIT 10000), (SELECT count(*) AS n FROM documents)), dw AS (SELECT doc_id, term, tf * idf AS w FROM df JOIN voc USING (term)), dn AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM dw)"


@query(f"WITH {_VOCAB} SELECT doc_id, term, round(weight, 6) AS weight FROM dn")
def tfidf_weights(spark, sf_dir):
    return tfidf_index(spark, sf_dir).weights.select(F.col("key").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


def tfidf_index(spark, sf_dir):
    return kept(spark, sf_dir, "tfidf", lambda keep: sparse.TfidfIndex.build(docs(spark, sf_dir), keep))


@query(f"""WITH {_VOCAB}, {_features('(SELECT * FROM benchmark WHERE item_id % 20 = 0)', 'item_id', 'q')}, qw AS (SELECT item_id AS qid, term, tf * idf AS w FROM qf JOIN voc USING (term)), qn AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS qweight FROM qw),
s AS (SELECT qid, doc_id, round(sum(weight * qweight), 6) AS score FROM dn JOIN qn USING (term) GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0) SELECT qid, doc_id, score, rank FROM r WHERE rank <= 20""")
def tfidf_search(spark, sf_dir):
    return tfidf_index(spark, sf_dir).search(asked(spark, sf_dir), 20).withColumnRenamed("key", "doc_id")

# ---------------------------------------------------------------- fusion

_DENSE = f"""de AS ({_embedded('documents', 'doc_id')}), qe AS ({_embedded("(SELECT item_id AS qid, text FROM benchmark WHERE item_id % 20 = 0)", 'qid')}),
dsum AS (SELECT qid, doc_id AS key, round(sum(de.weight * qe.weight), 6) AS score FROM de JOIN qe USING (bucket) GROUP BY ALL), dm AS (SELECT qid, key, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS INTEGER) AS rank FROM dsum)"""
_FUSED = f"""{_BM25}, {_DENSE}, fu AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.key, b.key) AS key, a.rank AS dense_rank, b.rank AS sparse_rank, round(coalesce(1.0 / (60 + a.rank), 0.0) + coalesce(1.0 / (60 + b.rank), 0.0), 6) AS score
FROM (SELECT * FROM dm WHERE rank <= 20) a FULL OUTER JOIN (SELECT * FROM bm WHERE rank <= 20) b ON a.qid = b.qid AND a.key = b.key),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, key) AS INTEGER) AS rank FROM fu)"""


def dense(spark, sf_dir, k=20):
    d = kept(spark, sf_dir, "vectors", lambda keep: keep("rows", vector.encode(docs(spark, sf_dir), "doc_id", "content").withColumnRenamed("doc_id", "key")))
    return vector.search(d, vector.encode(asked(spark, sf_dir), "qid", "query"), k)


def fused(spark, sf_dir):
    return fusion.rrf_fuse(dense(spark, sf_dir), bm25(spark, sf_dir))


def hydrated(spark, sf_dir, k=10):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("doc_id"), "content", F.col("source").alias("source_path"), F.col("lang").alias("section"))
    return fusion.hydrate(fused(spark, sf_dir).where(F.col("rank") <= k), d)


_HYDRATED = f"{_FUSED}, hy AS (SELECT fr.qid, fr.key, fr.score, fr.rank, d.text AS content, d.source AS source_path, d.lang AS section FROM fr JOIN documents d ON d.doc_id = fr.key WHERE fr.rank <= 10)"


@query(f"WITH {_FUSED} SELECT qid, key, coalesce(dense_rank, 0) AS dense_rank, coalesce(sparse_rank, 0) AS sparse_rank, score, rank FROM fr")
def rrf_fuse(spark, sf_dir):
    """Rank 0: not found by that search."""
    return fused(spark, sf_dir).fillna(0, ["dense_rank", "sparse_rank"])


@query(f"WITH {_HYDRATED} SELECT qid, key, score, rank, md5(content) AS digest FROM hy WHERE section = 'en'")
def hybrid_retrieve(spark, sf_dir):
    found = hydrated(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("lang"), F.col("section")))
    return fusion.metadata_filter(found, {"lang": "en"}).select("qid", "key", "score", "rank", F.md5("content").alias("digest"))


@query(f"""WITH {_BM25}, {_DENSE}, al AS (SELECT 0 AS qid, qid AS query_no, 0 AS source, key, rank FROM dm WHERE rank <= 20 UNION ALL SELECT 0, qid, 1, key, rank FROM bm WHERE rank <= 20),
s AS (SELECT qid, key, round(sum(1.0 / (60 + rank)), 6) AS score, min(ROW(query_no, source, rank)) AS first FROM al GROUP BY ALL) SELECT qid, key, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, key) AS INTEGER) AS rank FROM s""")
def rrf_multi(spark, sf_dir):
    """All queries as expansions of one question."""
    one = lambda df, no: df.select(F.lit(0).alias("qid"), F.col("qid").alias("query_no"), F.lit(no).alias("source"), "key", "rank")
    return fusion.rrf_multi(one(dense(spark, sf_dir), 0).unionByName(one(bm25(spark, sf_dir), 1)))


@query(f"""WITH {_BM25}, {_DENSE}, a AS (SELECT qid, key, score / max(score) OVER (PARTITION BY qid) AS d FROM dm WHERE rank <= 20), b AS (SELECT qid, key, score / max(score) OVER (PARTITION BY qid) AS s FROM bm WHERE rank <= 20),
e AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.key, b.key) AS key, round(0.7 * coalesce(d, 0.0) + 0.3 * coalesce(s, 0.0), 6) AS score FROM a FULL OUTER JOIN b ON a.qid = b.qid AND a.key = b.key) SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS INTEGER) AS rank FROM e""")
def ensemble_fuse(spark, sf_dir):
    return fusion.ensemble_fuse(dense(spark, sf_dir), bm25(spark, sf_dir))


@query(f"WITH {_FUSED} SELECT qid, count(*) FILTER (WHERE sparse_rank IS NULL) AS dense_only, count(*) FILTER (WHERE dense_rank IS NULL) AS sparse_only, count(*) FILTER (WHERE dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) AS both, count(*) FILTER (WHERE rank <= 10 AND dense_rank IS NOT NULL) AS fused_dense, count(*) FILTER (WHERE rank <= 10 AND sparse_rank IS NOT NULL) AS fused_sparse FROM fr GROUP BY qid")
def retrieval_overlap_stats(spark, sf_dir):
    return fusion.overlap_stats(dense(spark, sf_dir), bm25(spark, sf_dir))


@query("SELECT d.doc_id, d.lang, CAST(l.toxic AS VARCHAR) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IN ('en', 'de') AND coalesce(l.toxic, 0) = 0")
def metadata_filter(spark, sf_dir):
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic")), "doc_id", "left")
    meta = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("toxic"), F.col("toxic")), lambda k, v: v.isNotNull())
    return fusion.metadata_filter(d.withColumn("metadata", meta), {"lang": ["en", "de"], "toxic": "0"}).select("doc_id", "lang", "toxic")


@query(f"WITH {_HYDRATED}, h AS (SELECT *, contains(content, 'License') AS hit FROM hy), a AS (SELECT *, bool_or(hit) OVER (PARTITION BY qid) AS any_hit FROM h) SELECT qid, key, rank FROM a WHERE hit OR NOT any_hit")
def content_keyword_filter(spark, sf_dir):
    return fusion.keyword_filter(hydrated(spark, sf_dir), ["License"]).select("qid", "key", "rank")


@query(f"WITH {_HYDRATED} SELECT qid, key, rank, md5(content) AS digest FROM hy")
def hydrate_content(spark, sf_dir):
    return hydrated(spark, sf_dir).select("qid", "key", "rank", F.md5("content").alias("digest"))


@query(f"WITH {_HYDRATED}, g AS (SELECT qid, source_path AS doc_id, max(score) AS max_score, count(*) AS chunks FROM hy GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY max_score DESC, doc_id) AS INTEGER) AS rank FROM g")
def search_documents(spark, sf_dir):
    """Documents rolled up by source, as chunks are by document."""
    return fusion.roll_up(hydrated(spark, sf_dir).withColumn("doc_id", F.col("source_path"))).drop("source_path")


# ---------------------------------------------------------------- rerank, diversity

_RERANKED = f"""{_HYDRATED}, sc AS (SELECT hy.*, round(len(list_intersect(list_distinct({words('lower(b.text)')}), {words('lower(hy.content)')})) / len(list_distinct({words('lower(b.text)')})), 6) AS new FROM hy JOIN benchmark b ON b.item_id = hy.qid),
rr AS (SELECT qid, key, rank AS old_rank, new AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY new DESC, rank) AS INTEGER) AS rank FROM sc)"""


def reranked(spark, sf_dir, top_k=5):
    return rerank.rerank(hydrated(spark, sf_dir).join(asked(spark, sf_dir), "qid"), top_k)


@query(f"WITH {_RERANKED} SELECT qid, key, old_rank, score, rank FROM rr WHERE rank <= 5")
def rerank_lexical(spark, sf_dir):
    return reranked(spark, sf_dir).select("qid", "key", "old_rank", "score", "rank")


@query(f"WITH {_RERANKED} SELECT qid, count(*) AS results, round(avg(old_rank - rank), 6) AS avg_change, max(old_rank - rank) AS max_change, min(old_rank - rank) AS min_change FROM rr WHERE rank <= 5 GROUP BY qid")
def rerank_stats(spark, sf_dir):
    return rerank.rerank_stats(reranked(spark, sf_dir))


@query(f"""WITH RECURSIVE {_VECTORS}, s AS (SELECT qid, key, v, {_COSINE} AS score FROM q, v), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS INTEGER) AS rank FROM s), c AS (SELECT * FROM r WHERE rank <= 30),
g AS (SELECT qid, list({{'key': key, 'score': score, 'v': v}} ORDER BY rank) AS l FROM c GROUP BY qid),
m AS (SELECT qid, l, 0 AS n, CAST([] AS BIGINT[]) AS sel FROM g UNION ALL
SELECT qid, l, n + 1, list_append(sel, list_sort(list_transform(list_filter(range(1, 31), lambda p: NOT list_contains(sel, p)), lambda p: {{'s': -round(0.6 * l[p].score - 0.4 * coalesce(list_max(list_transform(sel, lambda x: list_dot_product(l[x].v, l[p].v) / (sqrt(list_dot_product(l[x].v, l[x].v)) * sqrt(list_dot_product(l[p].v, l[p].v))))), 0.0), 6), 'p': p}}))[1].p) FROM m WHERE n < 10),
o AS (SELECT qid, l, unnest(sel) AS p, CAST(generate_subscripts(sel, 1) AS INTEGER) AS rank FROM m WHERE n = 10) SELECT qid, l[p].key AS key, l[p].score AS score, rank FROM o""")
def mmr_select(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = _plus(vector.search(v, asked_vectors(spark, sf_dir), 30))
    return rerank.mmr_select(found.join(v.select("key", "vector"), "key"))


# ---------------------------------------------------------------- context

def _shown(content: str, position: str = "position") -> str:
    return f"'[Chunk ' || {position} || '] (Source: ' || source_path || CASE WHEN section <> 'main' THEN ', Section: ' || left(section, 30) ELSE '' END || ')' || chr(10) || {content}"


_UNIQUE = f"""{_HYDRATED}, dd AS (SELECT *, row_number() OVER (PARTITION BY qid, regexp_replace(regexp_replace(regexp_replace(lower(content), '{{WS}}+', ' ', 'g'), '\\A{{WS}}+', ''), '{{WS}}+\\z', '') ORDER BY rank) AS nth FROM hy),
un AS (SELECT * EXCLUDE (nth), CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS position FROM dd WHERE nth = 1), st AS (SELECT * REPLACE (regexp_replace(regexp_replace(content, '\\A{{WS}}+', ''), '{{WS}}+\\z', '') AS content) FROM un)"""


def _built(shown: str, part: str) -> str:
    return f"""{_UNIQUE}, fo AS (SELECT *, {shown} AS full_text FROM st), su AS (SELECT *, sum(length(full_text)) OVER (PARTITION BY qid ORDER BY position) AS upto FROM fo),
ov AS (SELECT *, min(CASE WHEN upto > 16000 THEN position END) OVER (PARTITION BY qid) AS first_over, upto - length(full_text) AS used FROM su),
pa AS (SELECT qid, position, CASE WHEN first_over IS NULL OR position < first_over THEN full_text WHEN position = first_over AND 15900 - used > 200 THEN {part} END AS part FROM ov),
bc AS (SELECT qid, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY position), '') AS context, count(part) AS chunks FROM pa GROUP BY qid)"""


_CONTEXT = _built(_shown("content"), _shown("substr(content, 1, CAST(15900 - used AS BIGINT)) || '...'"))
_BARE = _built("'[Chunk ' || position || ']' || chr(10) || content", "'[Chunk ' || position || ']' || chr(10) || substr(content, 1, CAST(15900 - used AS BIGINT)) || '...'")


@query(f"WITH {_UNIQUE} SELECT qid, key, position FROM un")
def dedup_content(spark, sf_dir):
    return context.dedup_content(hydrated(spark, sf_dir)).select("qid", "key", "position")


@query(f"WITH {_UNIQUE} SELECT qid, key, md5({_shown('content')}) AS digest FROM un")
def format_chunk(spark, sf_dir):
    found = context.dedup_content(hydrated(spark, sf_dir))
    return found.select("qid", "key", F.md5(context.format_chunk(F.col("position"), F.col("content"), F.col("source_path"), F.col("section"))).alias("digest"))


@query(f"WITH {_CONTEXT} SELECT qid, md5(context) AS digest, length(context) AS n_chars, chunks FROM bc")
def build_context(spark, sf_dir):
    return context.build_context(hydrated(spark, sf_dir)).select("qid", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n_chars"), "chunks")


@query(f"WITH {_BARE}, nu AS (SELECT qid, count(*) AS unique_chunks FROM un GROUP BY qid), nt AS (SELECT qid, count(*) AS total_chunks FROM hy GROUP BY qid) SELECT qid, total_chunks, unique_chunks, total_chunks - unique_chunks AS duplicates_removed, length(context) AS total_chars, CAST(floor(length(context) * 0.25) AS BIGINT) AS estimated_tokens, floor(length(context) * 0.25) <= 4000 AS within_limit, chunks AS chunks_included FROM bc JOIN nu USING (qid) JOIN nt USING (qid)")
def context_stats(spark, sf_dir):
    return context.context_stats(hydrated(spark, sf_dir))


_q = lambda s: "'" + s.replace("'", "''") + "'"


@query(f"WITH {_CONTEXT} SELECT qid, md5({_q(context.SYSTEM_CITING)}) AS system_digest, md5('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || {_q(context.ASK_CITING)}) AS user_digest FROM bc JOIN benchmark b ON b.item_id = bc.qid")
def build_prompt(spark, sf_dir):
    built = context.build_context(hydrated(spark, sf_dir)).join(asked(spark, sf_dir), "qid")
    system, user = context.build_prompt(F.col("query"), F.col("context"))
    return built.select("qid", F.md5(system).alias("system_digest"), F.md5(user).alias("user_digest"))


# ---------------------------------------------------------------- metrics

_RANKED = f"{_VECTORS}, s AS (SELECT qid, key, label, {_COSINE} AS score FROM q, v WHERE key <> qid), r AS (SELECT qid, key AS doc, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS INTEGER) AS rank FROM s), k10 AS (SELECT * FROM r WHERE rank <= 10), rel AS (SELECT qid, key AS doc FROM q JOIN v ON label = qlabel AND key <> qid)"
_PER = f"""{_RANKED}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k), nr AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY qid), j AS (SELECT k10.*, CASE WHEN rel.doc IS NULL THEN 0 ELSE 1 END AS rel FROM k10 LEFT JOIN rel USING (qid, doc)),
a AS (SELECT nr.qid, k, n_rel, count(*) FILTER (WHERE rank <= k) AS n, coalesce(sum(rel) FILTER (WHERE rank <= k), 0) AS hits, coalesce(sum(rel / log2(rank + 1.0)) FILTER (WHERE rank <= k), 0.0) AS dcg FROM nr CROSS JOIN ks LEFT JOIN j USING (qid) GROUP BY ALL),
p AS (SELECT qid, k, CASE WHEN n > 0 THEN hits / n ELSE 0.0 END AS precision, hits / n_rel AS recall, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit, CASE WHEN least(n_rel, n) > 0 THEN dcg / (SELECT sum(1.0 / log2(i + 1.0)) FROM range(1, CAST(least(n_rel, n) AS BIGINT) + 1) t(i)) ELSE 0.0 END AS ndcg FROM a)"""


def ranked_vectors(spark, sf_dir):
    found = vector.search(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 11).where("key <> qid")
    return metrics.dedup_docs(found.select("qid", F.col("key").alias("doc"), "rank")).where("rank <= 10")


def relevant(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("key").alias("doc"), "label")
    return asked_vectors(spark, sf_dir).select("qid", "label").join(v, "label").where("doc <> qid").select("qid", "doc")


def _metric(name: str):
    def run(spark, sf_dir):
        return metrics.at_k(ranked_vectors(spark, sf_dir), relevant(spark, sf_dir), name)

    run.__name__ = {"hit": "hit_rate"}.get(name, name) + "_at_k"
    return query(f"WITH {_PER} SELECT CAST(k AS INTEGER) AS k, round(avg({name}), 6) AS value FROM p GROUP BY k")(run)


precision_at_k, recall_at_k, hit_rate_at_k, ndcg_at_k = map(_metric, ("precision", "recall", "hit", "ndcg"))


@query(f"WITH {_RANKED}, f AS (SELECT qid, min(rank) AS first FROM k10 JOIN rel USING (qid, doc) GROUP BY qid) SELECT round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM (SELECT DISTINCT qid FROM rel) LEFT JOIN f USING (qid)")
def mrr(spark, sf_dir):
    return metrics.mrr(ranked_vectors(spark, sf_dir), relevant(spark, sf_dir))


@query(f"WITH {_VECTORS}, s AS (SELECT qid, key, label, {_COSINE} AS score FROM q, v), r AS (SELECT qid, label AS doc, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM s), f AS (SELECT qid, doc, min(rank) AS first FROM r WHERE rank <= 50 GROUP BY ALL) SELECT qid, CAST(doc AS BIGINT) AS doc, CAST(row_number() OVER (PARTITION BY qid ORDER BY first, doc) AS INTEGER) AS rank FROM f")
def dedup_docs(spark, sf_dir):
    """Vectors as chunks, their labels as documents."""
    v = vectors(spark, sf_dir)
    found = vector.search(v, asked_vectors(spark, sf_dir), 50).join(v.select("key", "label"), "key")
    return metrics.dedup_docs(found.select("qid", F.col("label").cast("long").alias("doc"), "rank"))
