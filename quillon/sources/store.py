"""Parquet tables of documents, chunks and logs, with upserts, deletes and lookups."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id string, source_path string, doc_type string, content_hash string, created_at timestamp, updated_at timestamp, metadata string"
CHUNKS = "doc_id string, chunk_index int, section string, chunk_type string, content string, content_hash string, created_at timestamp, metadata string"
LOGS = "timestamp timestamp, query string, normalized_query string, results_count int, retrieval_time_ms double, rerank_time_ms double, total_time_ms double, metadata string"
SCHEMAS = {"documents": DOCUMENTS, "chunks": CHUNKS, "retrieval_logs": LOGS}


# ---------------------------------------------------------------- operators on tables

def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and of old those whose key new lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def replace_documents(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """As ``upsert`` by whole documents: old chunks of a document that new has go, also those of higher
    index."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def unchanged_removed(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming documents but for those stored with the same content_hash."""
    return incoming.join(existing.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with source_path and doc_type of their document."""
    return chunks.join(documents.select("doc_id", "source_path", "doc_type"), "doc_id")


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def lookup(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Chunks of (doc_id, chunk_index) pairs; pairs that aren't there give no row."""
    return chunks.join(keys.select("doc_id", "chunk_index").distinct(), ["doc_id", "chunk_index"], "left_semi")


def attach_metadata(df: DataFrame, own: str, shared: dict[str, str]) -> DataFrame:
    """The map column with shared entries added; a shared entry wins over an own one."""
    extra = F.create_map(*(F.lit(x) for kv in shared.items() for x in kv)) if shared else F.create_map().cast("map<string,string>")
    mine = F.coalesce(F.col(own), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(mine, lambda k, v: ~F.array_contains(F.map_keys(extra), k)) if shared else mine
    return df.withColumn(own, F.map_concat(kept, extra))


def ingest_summary(incoming: DataFrame, existing: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: processed, skipped, total_chunks."""
    state = incoming.join(existing.select("doc_id", "content_hash", F.lit(True).alias("same")), ["doc_id", "content_hash"], "left")
    counts = state.agg(F.count_if(F.col("same").isNull()).alias("processed"), F.count_if(F.col("same")).alias("skipped"))
    return counts.crossJoin(chunks.agg(F.count("*").alias("total_chunks")))  # one row each


def log_stats(logs: DataFrame, hours: int = 24, now: str | None = None) -> DataFrame:
    """One row over the last hours: queries, mean counts and times, extremes, and queries an hour; none if there
    are no logs. now: the end of the time, by default the present."""
    end = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    recent = logs.where(F.col("timestamp") > end - F.expr(f"INTERVAL {int(hours)} HOURS"))
    mean = lambda c: F.round(F.avg(c), 9).alias(f"avg_{c}")
    return recent.agg(F.count("*").alias("total_queries"), *map(mean, ("results_count", "retrieval_time_ms", "rerank_time_ms", "total_time_ms")), F.max("total_time_ms").alias("max_total_time_ms"), F.min("total_time_ms").alias("min_total_time_ms"), F.round(F.count("*") / hours, 9).alias("queries_per_hour")).where("total_queries > 0")


def database_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, value): documents, chunks, and chunks of each type."""
    n = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")
    by = chunks.groupBy("chunk_type").agg(F.count("*").alias("value")).select(F.concat(F.lit("chunks_"), "chunk_type").alias("name"), "value")
    return n(documents, "documents").unionByName(n(chunks, "chunks")).unionByName(by)


def performance_summary(logs: DataFrame, hours: int = 24, now: str | None = None) -> DataFrame:
    """One row over the last hours: period_hours, total_queries, four means and queries an hour; none if there are no
    logs."""
    stats = log_stats(logs, hours, now)
    return stats.select(F.lit(hours).alias("period_hours"), "total_queries", "avg_retrieval_time_ms", "avg_rerank_time_ms", "avg_total_time_ms", "avg_results_count", "queries_per_hour")


def parsed(df: DataFrame) -> DataFrame:
    """The metadata column as a map; what is no JSON object of strings is null."""
    return df.withColumn("metadata", F.from_json("metadata", "map<string,string>"))


def last_logs(logs: DataFrame, limit: int, *order: str) -> DataFrame:
    """The last logs by these columns, the latest first."""
    return logs.orderBy(*(F.desc(c) for c in order or ("timestamp",))).limit(limit)


# ---------------------------------------------------------------- tables in a folder

class Store:
    """Tables under a folder of any file system that Spark reads.

    A table is what its log says: a commit is one file, made only if it isn't there, that names the folder of new rows
    and the parts that these replace. Readers see the rows before a commit or after it, never a mixture, and of two
    writers that start from the same commit the second gets an error. Documents and chunks are dealt to ``parts`` by a
    hash of doc_id, and a change writes the parts it touches only. Folders of the commit before the last stay for those
    who still read them; older ones go."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # ------------------------------------------------------------ commits

    def _log(self, name: str) -> list[dict]:
        """Commits of a table in order: number, folder, parts (none: the whole table), and which of them have rows."""
        at = self._at(f"{name}/_log")
        if not self._fs.exists(at):
            return []
        files = sorted(s.getPath().toString() for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._read(f)) for f in files]

    def _read(self, path: str) -> str:
        stream = self._fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, name: str, number: int, folder: str, parts: list[int] | None) -> None:
        filled = [int(s.getPath().getName()[5:]) for s in self._fs.listStatus(self._at(f"{name}/{folder}")) if s.getPath().getName().startswith("part=")]
        entry = {"number": number, "folder": folder, "parts": parts, "filled": filled}
        out = self._fs.create(self._at(f"{name}/_log/{number:012d}.json"), False)  # fails if another writer was first
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        self._vacuum(name)

    def _current(self, log: list[dict]) -> list[str]:
        """Folders that hold the table's rows after these commits."""
        whole, of = [], {}
        for c in log:
            if c["parts"] is None:
                whole, of = [c["folder"]], {}
            else:
                of |= {p: f"{c['folder']}/part={p}" if p in c["filled"] else None for p in c["parts"]}
        return whole + [f for f in of.values() if f]

    def _vacuum(self, name: str) -> None:
        """Delete folders that neither the last commit nor the one before it needs."""
        log = self._log(name)
        needed = {f.split("/")[0] for f in self._current(log) + self._current(log[:-1])}
        for c in log:
            if c["folder"] not in needed and self._fs.exists(self._at(f"{name}/{c['folder']}")):
                self._fs.delete(self._at(f"{name}/{c['folder']}"), True)

    def exists(self, name: str) -> bool:
        return bool(self._log(name))

    def table(self, name: str) -> DataFrame:
        found = [f"{self.path}/{name}/{f}" for f in self._current(self._log(name))]
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return (self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read).parquet(*found)

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the table by df, which may read it."""
        self._write(name, df, None)

    def _write(self, name: str, df: DataFrame, parts: list[int] | None) -> None:
        log = self._log(name)
        number = log[-1]["number"] + 1 if log else 0
        folder = f"v{number}-{uuid.uuid4().hex[:8]}"
        out = df.write if parts is None else df.withColumn("part", self._part()).repartition("part").write.partitionBy("part")
        out.parquet(f"{self.path}/{name}/{folder}")
        self._commit(name, number, folder, parts)

    def _part(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")

    def _change(self, name: str, ids: DataFrame, change) -> None:
        """Replace the parts that hold these doc_ids by ``change`` of their rows."""
        touched = sorted(r[0] for r in ids.select(self._part()).distinct().collect())  # at most ``parts`` numbers
        if not touched:
            return
        whole = any(c["parts"] is None for c in self._log(name))  # not yet dealt to parts
        rows = self.table(name)
        self._write(name, change(rows if whole else rows.where(self._part().isin(touched))), list(range(self.parts)) if whole else touched)

    # ------------------------------------------------------------ documents and chunks

    def upsert_documents(self, documents: DataFrame) -> None:
        now = F.current_timestamp()
        rows = documents.select("doc_id", "source_path", "doc_type", F.md5(F.col("content").cast("binary")).alias("content_hash"), now.alias("created_at"), now.alias("updated_at"), F.to_json("metadata").alias("metadata") if "metadata" in documents.columns else F.lit(None).cast("string").alias("metadata"))
        self._change("documents", rows, lambda old: upsert(old, rows, ["doc_id"]))

    def upsert_chunks(self, chunks: DataFrame) -> None:
        rows = chunks.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "section", "chunk_type", "content", F.md5(F.col("content").cast("binary")).alias("content_hash"), F.current_timestamp().alias("created_at"), F.to_json("metadata").alias("metadata") if "metadata" in chunks.columns else F.lit(None).cast("string").alias("metadata"))
        self._change("chunks", rows, lambda old: replace_documents(old, rows))

    def delete_documents(self, ids: DataFrame) -> None:
        """Chunks first, then documents."""
        for name in ("chunks", "documents"):
            self._change(name, ids, lambda old: delete(old, ids))

    def chunks(self) -> DataFrame:
        return with_documents(self.table("chunks"), self.table("documents"))

    def document(self, doc_id: str) -> DataFrame:
        """The document's row, with its metadata as a map."""
        return parsed(self.table("documents").where(F.col("doc_id") == doc_id))

    def chunks_of(self, doc_id: str) -> DataFrame:
        """Its chunks in order, with metadata as a map."""
        return parsed(self.table("chunks").where(F.col("doc_id") == doc_id)).orderBy("chunk_index")

    def contents(self, keys: DataFrame) -> DataFrame:
        """Content of (doc_id, chunk_index) pairs."""
        return lookup(self.table("chunks"), keys).select("doc_id", "chunk_index", "content")

    # ------------------------------------------------------------ logs

    def append_log(self, logs: DataFrame) -> None:
        logs.write.mode("append").parquet(f"{self.path}/retrieval_logs")

    def logs(self) -> DataFrame:
        at = f"{self.path}/retrieval_logs"
        return self.spark.read.schema(LOGS).parquet(at) if self._fs.exists(self._at("retrieval_logs")) else self.spark.createDataFrame([], LOGS)

    def append_jsonl(self, logs: DataFrame, name: str = "retrieval_log") -> None:
        logs.write.mode("append").json(f"{self.path}/{name}.jsonl")

    def log_performance(self, **metrics) -> None:
        """A record of these figures with the time, in performance_logs.jsonl."""
        record = self.spark.createDataFrame([(json.dumps(metrics),)], "metrics string")
        self.append_jsonl(record.select(F.current_timestamp().alias("timestamp"), F.from_json("metrics", "map<string,string>").alias("metrics")), "performance_logs")

    def read_jsonl(self, name: str = "retrieval_log", schema: str = LOGS) -> DataFrame:
        return self.spark.read.schema(schema).json(f"{self.path}/{name}.jsonl")

    # ------------------------------------------------------------ indexes

    def save_index(self, name: str, df: DataFrame) -> None:
        self.write(f"index_{name}", df)

    def load_index(self, name: str) -> DataFrame | None:
        return self.table(f"index_{name}") if self.exists(f"index_{name}") else None

    def stats(self) -> dict:
        found = {r["name"]: r["value"] for r in database_stats(self.table("documents"), self.table("chunks")).collect()}
        return found | {"bytes": self._fs.getContentSummary(self._at("")).getLength() if self._fs.exists(self._at("")) else 0}
