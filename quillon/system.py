"""The facade: ingest files, build an index, answer queries with context and prompts, keep statistics."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import cache as K
from quillon.functions import text as T
from quillon.operators import chunking, context, fusion, rerank, sparse, vector
from quillon.sources import files
from quillon.sources import store as S

#: What an index can be built for; all share one store and one plan.
BACKENDS = {"flat": "exact search", "ivf": "cells, some of which are probed", "lsh": "hashing by random planes"}
#: What speaks for each.
COMPARED = (
    {"backend": "flat", "recall": "exact", "build": "none", "a query reads": "all vectors", "suits": "up to some 100 k chunks, or batches of queries"},
    {"backend": "ivf", "recall": "by the cells probed", "build": "k-means on a bounded sample, one pass", "a query reads": "the probed cells", "suits": "a million chunks and more"},
    {"backend": "lsh", "recall": "by tables and planes", "build": "one pass, nothing fitted", "a query reads": "buckets and vectors of all chunks, and scores those in its own", "suits": "chunks that change often"},
)


def available_backends() -> dict[str, str]:
    return dict(BACKENDS)


def compare_backends() -> list[dict[str, str]]:
    """A row for each backend: how exact it is, what building it takes, what a query reads, what it suits."""
    return [dict(row) for row in COMPARED]


class RetrievalSystem:
    """Hybrid retrieval over a store. encoder: see ``vector.encode``, and width that of its vectors; score: see
    ``rerank.rerank``, and second_score a reranker after it; expander: a function from a query to other wordings or
    keywords, each searched by itself; pdf: a function from a PDF's bytes to its text; log_every: queries whose logs are
    written together (those not yet written are when statistics are asked for, and at close)."""

    def __init__(self, spark: SparkSession, path: str, backend: str = "flat", sparse_kind: str = "bm25", encoder: Callable | None = None, score: Callable = rerank.lexical_score, second_score: Callable | None = None, expander: Callable[[str], list[str]] | None = None, pdf: Callable[[bytes], str] | None = None, width: int = 64, chunk_size: int = 512, overlap: int = 50, top_k: int = 5, rerank_top_k: int = 10, multiplier: int = 2, adaptive: bool = True, use_mmr: bool = False, mmr_balance: float = 0.6, max_tokens: int = context.MAX_TOKENS, log_every: int = 1, cache_size: int = 1000, cache_ttl: float = 3600):
        if backend not in BACKENDS or sparse_kind not in ("bm25", "tfidf"):
            raise ValueError(f"backend is one of {sorted(BACKENDS)}, sparse_kind bm25 or tfidf")
        self.spark, self.store, self.backend, self.sparse_kind = spark, S.Store(spark, path), backend, sparse_kind
        self.encoder, self.expander, self.pdf, self.width = encoder, expander, pdf, width
        self.scores = [score, *([second_score] if second_score else [])]
        self.chunk_size, self.overlap, self.top_k, self.rerank_top_k, self.multiplier, self.adaptive = chunk_size, overlap, top_k, rerank_top_k, multiplier, adaptive
        self.use_mmr, self.mmr_balance, self.max_tokens = use_mmr, mmr_balance, max_tokens
        self.log_every, self.unwritten = log_every, []
        self.cache, self.embeddings, self.loaded = K.Cache(cache_size, cache_ttl), K.Cache(cache_size, None), None

    # ------------------------------------------------------------ ingestion

    def ingest(self, path: str, metadata: dict[str, str] | None = None, preserve_newlines: bool = False, rebuild: bool = True) -> dict:
        """Read, chunk and store the files under a path, but for unchanged ones. Files that can't be read count as
        failed; ``files.failed`` tells why."""
        found = files.read_files(self.spark, path, preserve_newlines, **({"pdf": self.pdf} if self.pdf else {})).persist()
        failed = found.where("error IS NOT NULL").count()
        incoming = found.where("error IS NULL").drop("error").withColumn("content_hash", F.md5(F.col("content").cast("binary")))
        new = S.unchanged_removed(incoming, self.store.table("documents")).withColumn("metadata", F.create_map().cast("map<string,string>"))
        new = S.attach_metadata(new, "metadata", metadata or {}).persist()
        total, processed = incoming.count(), new.count()
        chunks = chunking.chunk_documents(new, self.chunk_size, self.overlap)
        if metadata:
            chunks = S.attach_metadata(chunks.withColumn("metadata", F.create_map().cast("map<string,string>")), "metadata", metadata)
        if processed:
            self.store.upsert_chunks(chunks)
            self.store.upsert_documents(new)
            if rebuild:
                self.build_index(new.select("doc_id"))
        found.unpersist(), new.unpersist()
        return {"processed": processed, "skipped": total - processed, "failed": failed, "total_chunks": self.store.table("chunks").count(), "index_rebuilt": bool(processed and rebuild)}

    def chunks(self) -> DataFrame:
        """Stored chunks with a numeric key made of doc_id and chunk_index."""
        return self.store.chunks().withColumn("key", F.xxhash64("doc_id", "chunk_index"))

    def build_index(self, changed: DataFrame | None = None) -> None:
        """Build and save the indexes; with changed (doc_id), bring saved ones up to date by encoding and tokenising the
        chunks of these documents only (cells of an inverted file keep their centres)."""
        chunks, old = self.chunks(), self._saved()
        if old is None or changed is None:
            changed, old = None, None
            if not chunks.limit(1).count():
                raise ValueError("nothing to index")
        gone = None if changed is None else old["keys"].join(changed.distinct(), "doc_id", "left_semi").select("key")
        some = chunks if changed is None else chunks.join(changed.distinct(), "doc_id", "left_semi")
        keys = some.select("doc_id", "key")
        vectors = vector.encode(some, "key", "content", encoder=self.encoder)
        if old is not None:
            keys = keys.unionByName(old["keys"].join(gone, "key", "left_anti"))
            vectors = vectors.unionByName(old["vectors"].join(gone, "key", "left_anti"))
        keys = self._keep("keys", keys)
        if keys.count() != keys.select("key").distinct().count():
            raise ValueError("two chunks have one key; give the documents other ids")
        vectors = self._keep("vectors", vectors)
        if self.backend == "ivf":
            index = vector.IvfIndex.build(vectors, self._keep, centres=old["dense"].centres if old is not None and len(old["dense"].centres) else None)
            width = len(index.centres[0]) if len(index.centres) else 0
            self._keep("centres", self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.centres)], "cell int, vector array<double>") if width else self.spark.createDataFrame([], "cell int, vector array<double>"))
        elif self.backend == "lsh":
            vector.LshIndex.build(vectors, lambda name, df: self._keep(f"lsh_{name}", df), width=self.width)
        kind = sparse.Bm25Index if self.sparse_kind == "bm25" else sparse.TfidfIndex
        kind.build(some, self._keep, "key", "content", old=None if old is None else old["sparse"], gone=gone)
        self.loaded = self._saved()
        self.cache.clear()

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        self.store.save_index(name, df)
        return self.store.load_index(name)

    def _saved(self) -> dict | None:
        """The saved indexes, or None if any isn't there."""
        kind = sparse.Bm25Index if self.sparse_kind == "bm25" else sparse.TfidfIndex
        tables = {n: self.store.load_index(n) for n in ("keys", "vectors", *kind.TABLES)}
        if any(t is None for t in tables.values()):
            return None
        found = {"keys": tables["keys"], "vectors": tables["vectors"], "sparse": kind(*(tables[n] for n in kind.TABLES)), "dense": None}
        if self.backend == "ivf":
            cells, centres = self.store.load_index("cells"), self.store.load_index("centres")
            if cells is None or centres is None:
                return None
            found["dense"] = vector.IvfIndex(np.array([r["vector"] for r in centres.orderBy("cell").collect()], np.float64), cells)
        elif self.backend == "lsh":
            rows = self.store.load_index("lsh_rows")
            if rows is None:
                return None
            built = vector.LshIndex.build(rows.limit(0), width=self.width)
            found["dense"] = vector.LshIndex(built.planes, rows)
        return found

    def load_index(self) -> bool:
        """Take up the saved indexes; false if there are none."""
        self.loaded = self._saved()
        return self.loaded is not None

    def index(self) -> dict:
        if self.loaded is None and not self.load_index():
            raise ValueError("build or load an index first")
        return self.loaded

    def delete_document(self, doc_id: str, rebuild: bool = True) -> None:
        ids = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        self.store.delete_documents(ids)
        self.cache.clear()
        if rebuild and self._saved() is not None:
            self.build_index(ids)

    # ------------------------------------------------------------ queries

    def embedded(self, queries: DataFrame) -> DataFrame:
        """(qid, vector) of queries (qid, query)."""
        asked = vector.encode(queries.withColumnRenamed("qid", "key"), "key", "query", encoder=self.encoder)
        return asked.withColumnRenamed("key", "qid")

    def remembered(self, texts: list[str]) -> DataFrame:
        """(qid, vector) of a few normalised texts by their number; each is encoded once and then known."""
        vectors = {t: self.embeddings.get(K.key(t)) for t in texts}
        new = [t for t, v in vectors.items() if v is None]
        if new:
            rows = self.embedded(self.spark.createDataFrame(list(enumerate(new)), "qid long, query string")).collect()
            for r in rows:
                vectors[new[r["qid"]]] = [float(x) for x in r["vector"]]
                self.embeddings.put(K.key(new[r["qid"]]), vectors[new[r["qid"]]])
        return self.spark.createDataFrame([(i, vectors[t]) for i, t in enumerate(texts)], "qid long, vector array<double>")

    def filtered(self, filters: dict | None, missing: str) -> DataFrame:
        chunks = self.chunks()
        if not filters:
            return chunks
        meta = F.from_json("metadata", "map<string,string>")
        whole = F.map_concat(F.coalesce(meta, F.create_map().cast("map<string,string>")), F.create_map(F.lit("source_path"), F.col("source_path"), F.lit("doc_type"), F.col("doc_type"), F.lit("section"), F.col("section"), F.lit("chunk_type"), F.col("chunk_type")))
        return chunks.where(fusion.metadata_condition(whole, filters, missing))

    def rankings(self, queries: DataFrame, k: int, vectors: DataFrame, keys: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Dense and sparse rankings (qid, key, rank, score) from the saved indexes. keys: what filters let pass, before
        the search; weights of terms stay those of all chunks."""
        index = self.index()
        if index["dense"] is not None:
            dense = index["dense"].search(vectors, k, keys=keys)
        else:
            rows = index["vectors"] if keys is None else index["vectors"].join(keys, "key", "left_semi")
            dense = vector.search(rows, vectors, k)
        return dense, index["sparse"].search(queries, k, keys=keys)

    def retrieve(self, queries: DataFrame, k: int, filters: dict | None = None, missing: str = "pass") -> DataFrame:
        """(qid, key, dense_rank, sparse_rank, score, rank, chunk columns, vector) of queries (qid, query). Chunks' texts
        are read for what is found only."""
        chunks = self.filtered(filters, missing)
        normal = queries.withColumn("query", T.normalize_query(F.col("query")))
        fused = fusion.rrf_fuse(*self.rankings(normal, k, self.embedded(normal), chunks.select("key") if filters else None))
        return fused.join(chunks, "key").join(self.index()["vectors"], "key", "left")

    def retrieve_multi(self, texts: list[str], k: int, filters: dict | None = None, missing: str = "pass") -> DataFrame:
        """As ``retrieve`` for one question (qid 0) in several wordings: each is searched by itself, and all rankings add
        to one score."""
        chunks = self.filtered(filters, missing)
        normal = self.spark.createDataFrame(list(enumerate(texts)), "qid long, query string").withColumn("query", T.normalize_query(F.col("query")))
        plain = [r["query"] for r in normal.orderBy("qid").collect()]
        found = self.rankings(normal, k, self.remembered(plain), chunks.select("key") if filters else None)
        if len(texts) == 1:
            fused = fusion.rrf_fuse(*found)
        else:
            one = lambda df, no: df.select(F.lit(0).cast("long").alias("qid"), F.col("qid").alias("query_no"), F.lit(no).alias("source"), "key", "rank")
            fused = fusion.rrf_multi(one(found[0], 0).unionByName(one(found[1], 1)))
        return fused.join(chunks, "key").join(self.index()["vectors"], "key", "left")

    def ranked(self, found: DataFrame, queries: DataFrame, top_k: int, keywords: list[str] | None) -> DataFrame:
        """What retrieval found, filtered, reranked and diversified."""
        found = found.where(F.col("rank") <= self.rerank_top_k)
        if keywords:
            found = fusion.keyword_filter(found, keywords)
        ranked = rerank.rerank_chain(found.join(queries, "qid"), None, self.scores)
        if self.use_mmr:
            chosen = rerank.mmr_select(ranked, top_k, self.mmr_balance).select("qid", "key", F.col("rank").alias("place"))
            ranked = ranked.join(chosen, ["qid", "key"]).withColumn("rank", F.col("place"))
        return ranked.where(F.col("rank") <= top_k).select("qid", "key", "doc_id", "chunk_index", "section", "source_path", "content", "score", "rank")

    def query_batch(self, queries: DataFrame, top_k: int | None = None, filters: dict | None = None, keywords: list[str] | None = None, multiplier: int | None = None) -> DataFrame:
        """(qid, key, doc_id, chunk_index, section, source_path, content, score, rank) of all queries at once."""
        return self.ranked(self.retrieve(queries, self.rerank_top_k * (multiplier or self.multiplier), filters), queries, top_k or self.top_k, keywords)

    def query(self, text: str, top_k: int | None = None, filters: dict | None = None, keywords: list[str] | None = None, include_metadata: bool = True, include_scores: bool = False) -> dict:
        """Answer one query: context, prompts, results and statistics. Equal calls are answered from memory."""
        k = K.key(text, top_k=top_k, filters=filters, keywords=keywords, metadata=include_metadata, scores=include_scores, adaptive=self.adaptive)
        if (known := self.cache.get(k)) is not None:
            return known | {"stats": known["stats"] | {"from_cache": True}}
        began = time.monotonic()
        expanded = [text, *(self.expander(text) if self.expander else [])]
        asked = self.spark.createDataFrame([(0, text)], "qid long, query string")
        words = len(text.split())
        multiplier = (2 if words < 5 else 3 if words < 10 else 4) if self.adaptive else self.multiplier
        found = self.ranked(self.retrieve_multi(expanded, self.rerank_top_k * multiplier, filters), asked, top_k or self.top_k, keywords).persist()
        built = context.build_context(found, self.max_tokens, include_metadata, include_scores).collect()
        whole = built[0]["context"] if built else ""
        results = [r.asDict() for r in found.orderBy("rank").drop("qid", "key").collect()]
        found.unpersist()
        ms = (time.monotonic() - began) * 1000
        out = {"query": text, "context": whole, "prompts": {"system": context.SYSTEM_CITING, "user": f"Context:\n{whole}\n\nQuestion: {text}\n\n{context.ASK_CITING}"}, "results": results, "stats": {"results_count": len(results), "total_time_ms": ms, "from_cache": False}}
        self.unwritten.append((datetime.now(timezone.utc), text, len(results), ms))
        if len(self.unwritten) >= self.log_every:
            self.write_logs()
        self.cache.put(k, out)
        return out

    def search_documents(self, text: str, doc_type: str | None = None, chunks: int = 20) -> DataFrame:
        """(doc_id, source_path, max_score, chunks, rank): the best chunks by document."""
        asked = self.spark.createDataFrame([(0, text)], "qid long, query string")
        found = self.retrieve(asked, chunks, {"doc_type": doc_type} if doc_type else None).where(F.col("rank") <= chunks)
        return fusion.roll_up(found).drop("qid")

    # ------------------------------------------------------------ statistics

    def write_logs(self) -> None:
        """Append the logs of queries answered since the last time, in one file."""
        if not self.unwritten:
            return
        rows = self.spark.createDataFrame(self.unwritten, "timestamp timestamp, query string, results_count int, ms double")
        self.store.append_log(rows.select("timestamp", "query", T.normalize_query(F.col("query")).alias("normalized_query"), "results_count", F.col("ms").alias("retrieval_time_ms"), F.lit(0.0).alias("rerank_time_ms"), F.col("ms").alias("total_time_ms"), F.lit(None).cast("string").alias("metadata")).coalesce(1))
        self.unwritten = []

    def stats(self, hours: int = 24) -> dict:
        self.write_logs()
        logs = S.log_stats(self.store.logs(), hours).collect()
        return {"database": self.store.stats(), "retrieval": logs[0].asDict() if logs else {}, "config": {"backend": self.backend, "sparse": self.sparse_kind, "chunk_size": self.chunk_size, "overlap": self.overlap, "top_k": self.top_k, "rerank_top_k": self.rerank_top_k}, "cache": self.cache.stats()}

    def evaluate(self, cases: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
        """Metrics of cases (qid, query, doc_id): a row for each relevant document."""
        from quillon.operators import metrics

        asked = cases.select("qid", "query").distinct()
        ranking = self.retrieve(asked, max(ks)).where(F.col("rank") <= max(ks)).select("qid", F.col("doc_id").alias("doc"), "rank")
        return metrics.evaluate(metrics.dedup_docs(ranking), cases.select("qid", F.col("doc_id").alias("doc")), ks)

    def latency(self, queries: list[str]) -> dict:
        """Mean, greatest and least milliseconds of queries, one after the other, and how many were answered from memory."""
        stats = [self.query(q)["stats"] for q in queries]
        ms = [x["total_time_ms"] for x in stats]
        return {"avg": sum(ms) / len(ms), "max": max(ms), "min": min(ms), "from_cache": sum(x["from_cache"] for x in stats)} if ms else {}

    def performance_summary(self, hours: int = 24) -> dict:
        """Means over the queries of the last hours; empty if there were none."""
        self.write_logs()
        found = S.performance_summary(self.store.logs(), hours).collect()
        return found[0].asDict() if found else {}

    def get_cache_stats(self) -> dict:
        return {"results": self.cache.stats(), "embeddings": self.embeddings.stats()}

    def clear_cache(self) -> None:
        """Forget results and vectors of queries, and what was counted of them."""
        for cache in (self.cache, self.embeddings):
            cache.clear()
            cache.reset_stats()

    def close(self) -> None:
        self.write_logs()
        self.cache.clear()
        self.embeddings.clear()


def create_system(spark: SparkSession, path: str, **options) -> RetrievalSystem:
    return RetrievalSystem(spark, path, **options)


