"""Queries on the relational layer: tables of documents, chunks and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import chunking
from quillon.plans.registry import query, table
from quillon.sources import store as S

_PARTS = "SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, CAST(i * 462 + 1 AS BIGINT), 512) AS content, source FROM documents, LATERAL (SELECT unnest(range(0, CAST(greatest(0, ceil((length(text) - 512) / 462.0)) AS BIGINT) + 1)) AS i) WHERE length(text) > 0"


def documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("source_path"), F.lit("txt").alias("doc_type"), F.md5("text").alias("content_hash"), "lang")


def chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    return chunking.split_by_size(d)


def stored(spark, sf_dir):
    """What a store holds before an update: documents that have a label, those of quality 0 with another content."""
    own = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = documents(spark, sf_dir).join(own, "doc_id")
    return d.withColumn("content_hash", F.when(F.col("quality") == 0, F.md5(F.concat("content_hash", F.lit("old")))).otherwise(F.col("content_hash"))).drop("quality")


_DOCS = "SELECT doc_id, source AS source_path, 'txt' AS doc_type, md5(text) AS content_hash, lang FROM documents"
_STORED = f"SELECT doc_id, source_path, doc_type, CASE WHEN quality = 0 THEN md5(content_hash || 'old') ELSE content_hash END AS content_hash, lang FROM ({_DOCS}) JOIN labels USING (doc_id)"


@query(f"SELECT d.doc_id, d.source_path, d.content_hash FROM ({_DOCS}) d WHERE NOT EXISTS (SELECT 1 FROM ({_STORED}) s WHERE s.doc_id = d.doc_id AND s.content_hash = d.content_hash)")
def incremental_skip(spark, sf_dir):
    return S.unchanged_removed(documents(spark, sf_dir), stored(spark, sf_dir)).select("doc_id", "source_path", "content_hash")


@query(f"SELECT count(*) FILTER (WHERE s.doc_id IS NULL) AS processed, count(*) FILTER (WHERE s.doc_id IS NOT NULL) AS skipped, (SELECT count(*) FROM ({_PARTS})) AS total_chunks FROM ({_DOCS}) d LEFT JOIN ({_STORED}) s ON s.doc_id = d.doc_id AND s.content_hash = d.content_hash")
def ingest_summary(spark, sf_dir):
    return S.ingest_summary(documents(spark, sf_dir), stored(spark, sf_dir), chunks(spark, sf_dir))


@query(f"SELECT doc_id, content_hash FROM ({_DOCS}) d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) UNION ALL SELECT doc_id, content_hash FROM ({_STORED}) JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def upsert_documents(spark, sf_dir):
    """All documents but the toxic ones into the store: some are new, some replace what is stored, and toxic ones stay."""
    new = S.delete(documents(spark, sf_dir), table(spark, sf_dir, "labels").where("toxic = 1"))
    return S.upsert(stored(spark, sf_dir), new, ["doc_id"]).select("doc_id", "content_hash")


@query(f"SELECT doc_id, chunk_index, md5(content) AS digest FROM ({_PARTS}) p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id) UNION ALL SELECT doc_id, chunk_index, md5('new ' || content) FROM ({_PARTS}) JOIN labels USING (doc_id) WHERE chunk_index = 0")
def upsert_chunks(spark, sf_dir):
    old = chunks(spark, sf_dir)
    labelled = old.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    new = labelled.where("chunk_index = 0").withColumn("content", F.concat(F.lit("new "), "content"))
    return S.replace_documents(old, new).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(f"SELECT doc_id, chunk_index FROM ({_PARTS}) c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.toxic = 1)")
def delete_document(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return S.delete(chunks(spark, sf_dir), gone).select("doc_id", "chunk_index")


@query(f"SELECT c.doc_id, c.chunk_index, md5(c.content) AS digest, d.source_path, d.doc_type FROM ({_PARTS}) c JOIN ({_DOCS}) d USING (doc_id)")
def chunks_with_documents(spark, sf_dir):
    return S.with_documents(chunks(spark, sf_dir), documents(spark, sf_dir)).select("doc_id", "chunk_index", F.md5("content").alias("digest"), "source_path", "doc_type")


@query(f"SELECT doc_id, chunk_index FROM ({_PARTS}) ORDER BY doc_id, chunk_index LIMIT 1000 OFFSET 1000")
def chunks_page(spark, sf_dir):
    return S.page(chunks(spark, sf_dir).select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], 1000, 1000)


@query(f"SELECT c.doc_id, c.chunk_index, md5(c.content) AS digest FROM ({_PARTS}) c JOIN labels l ON l.doc_id = c.doc_id AND l.quality = c.chunk_index")
def contents_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("chunk_index"))
    return S.lookup(chunks(spark, sf_dir), keys).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(f"SELECT doc_id, source_path, doc_type, content_hash FROM ({_DOCS}) WHERE doc_id = 7")
def document_lookup(spark, sf_dir):
    return documents(spark, sf_dir).where("doc_id = 7").drop("lang")


@query(f"SELECT doc_id, chunk_index, md5(content) AS digest FROM ({_PARTS}) WHERE doc_id = 7 ORDER BY chunk_index")
def chunks_of_document(spark, sf_dir):
    return chunks(spark, sf_dir).where("doc_id = 7").orderBy("chunk_index").select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(f"SELECT doc_id, source_path FROM ({_DOCS})")
def list_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "source_path")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'web' ELSE lang END AS lang, 'web' AS origin, source FROM documents")
def attach_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("metadata", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("origin"), F.lit("own")))
    even = S.attach_metadata(d.where("doc_id % 2 = 0"), "metadata", {"origin": "web", "lang": "web"})
    odd = S.attach_metadata(d.where("doc_id % 2 <> 0"), "metadata", {"origin": "web"})
    both = even.unionByName(odd)
    return both.select("doc_id", *(F.col("metadata")[k].alias(k) for k in ("lang", "origin", "source")))


def logs(spark, sf_dir):
    """Events as logs: value as time."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("query"), (F.col("user_id") % 10).alias("results_count"), F.col("value").alias("retrieval_time_ms"), (F.col("value") / 2).alias("rerank_time_ms"), (F.col("value") * 1.5).alias("total_time_ms"))


@query("""WITH r AS (SELECT user_id % 10 AS c, value AS v FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS)
SELECT count(*) AS total_queries, round(avg(c), 9) AS avg_results_count, round(avg(v), 9) AS avg_retrieval_time_ms, round(avg(v / 2), 9) AS avg_rerank_time_ms, round(avg(v * 1.5), 9) AS avg_total_time_ms, max(v * 1.5) AS max_total_time_ms, min(v * 1.5) AS min_total_time_ms, round(count(*) / 24.0, 9) AS queries_per_hour FROM r""")
def log_window_stats(spark, sf_dir):
    found = logs(spark, sf_dir)
    return S.log_stats(found, 24, str(found.agg(F.max("timestamp").cast("string")).first()[0]))


@query("SELECT event_id, event_type AS query FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_logs(spark, sf_dir):
    return S.last_logs(logs(spark, sf_dir), 100, "timestamp", "event_id").select("event_id", "query")


@query(f"SELECT 'documents' AS name, count(*) AS value FROM documents UNION ALL SELECT 'chunks', count(*) FROM ({_PARTS}) UNION ALL SELECT 'chunks_' || CASE WHEN chunk_index = 0 THEN 'text' ELSE 'more' END, count(*) FROM ({_PARTS}) GROUP BY 1")
def database_stats(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("chunk_type", F.when(F.col("chunk_index") == 0, "text").otherwise("more"))
    return S.database_stats(documents(spark, sf_dir), c)


@query(f"SELECT count(*) AS n FROM ({_PARTS})")
def chunk_count(spark, sf_dir):
    return chunks(spark, sf_dir).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id % 10 AS c, value AS v FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS)
SELECT 24 AS period_hours, count(*) AS total_queries, round(avg(v), 9) AS avg_retrieval_time_ms, round(avg(v / 2), 9) AS avg_rerank_time_ms, round(avg(v * 1.5), 9) AS avg_total_time_ms, round(avg(c), 9) AS avg_results_count, round(count(*) / 24.0, 9) AS queries_per_hour FROM r""")
def performance_summary(spark, sf_dir):
    found = logs(spark, sf_dir)
    return S.performance_summary(found, 24, str(found.agg(F.max("timestamp").cast("string")).first()[0]))
