"""Files to answers, through the store and the facade; and the same by stream."""

import pytest
from pyspark.sql import functions as F

from quillon.sources import files
from quillon.sources.store import Store
from quillon.streaming import ingest
from quillon.system import available_backends, create_system


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "cats.txt").write_text("Cats sleep all day. They hunt mice at night.")
    (d / "dogs.md").write_text("# Dogs\n\nDogs **guard** the [house](x).")
    (d / "birds.html").write_text("<html><body><p>Birds sing &amp; fly.</p><script>no</script></body></html>")
    (d / "other.xyz").write_text("ignored")
    return d


def test_read_documents(spark, folder):
    rows = {r["doc_type"]: r for r in files.read_documents(spark, str(folder)).collect()}
    assert rows["md"]["content"] == "Dogs Dogs guard the house." and rows["html"]["content"] == "Birds sing & fly."
    assert rows["txt"]["doc_id"].startswith("cats_") and len(rows["txt"]["doc_id"]) == 13
    assert files.unsupported(spark, str(folder)).count() == 1


@pytest.mark.parametrize("backend", sorted(available_backends()))
def test_round(spark, folder, tmp_path, backend):
    s = create_system(spark, str(tmp_path / "store"), backend=backend, use_mmr=backend == "flat", sparse_kind="tfidf" if backend == "ivf" else "bm25")
    assert s.ingest(str(folder), {"team": "zoo"}) == {"processed": 3, "skipped": 0, "failed": 1, "total_chunks": 3, "index_rebuilt": True}
    assert s.ingest(str(folder))["skipped"] == 3
    a = s.query("mice at night")
    assert a["results"][0]["source_path"].endswith("cats.txt") and "mice" in a["context"] and a["prompts"]["user"].startswith("Context:")
    assert s.query("mice at night ")["stats"]["from_cache"]
    assert s.query("mice", filters={"doc_type": ["html"]})["results"][0]["source_path"].endswith("birds.html")
    assert s.query("mice", filters={"team": "none"})["results"] == []
    assert s.search_documents("mice at night").first()["source_path"].endswith("cats.txt")
    doc = a["results"][0]["doc_id"]
    s.delete_document(doc)
    assert s.store.table("documents").where(F.col("doc_id") == doc).count() == 0 and s.stats()["database"]["documents"] == 2
    assert s.stats()["retrieval"]["total_queries"] == 3
    cases = s.store.table("documents").select(F.lit(1).alias("qid"), F.lit("dogs guard").alias("query"), "doc_id").where("doc_id LIKE 'dogs%'")
    assert s.evaluate(cases, (1,)).where("metric = 'recall'").first()["value"] == 1.0


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([("a", "p", "txt", "x"), ("b", "q", "txt", "y")], "doc_id string, source_path string, doc_type string, content string")
    s.upsert_documents(docs)
    s.upsert_documents(docs.where("doc_id = 'a'").withColumn("content", F.lit("z")))
    assert s.table("documents").count() == 2
    chunk = lambda rows: spark.createDataFrame(rows, "doc_id string, chunk_index int, section string, chunk_type string, content string")
    s.upsert_chunks(chunk([("a", 0, "main", "text", "one"), ("a", 1, "main", "text", "two"), ("b", 0, "main", "text", "three")]))
    s.upsert_chunks(chunk([("a", 0, "main", "text", "new")]))
    assert sorted(r["content"] for r in s.table("chunks").collect()) == ["new", "three"]
    logs = spark.createDataFrame([("q", 3)], "query string, results_count int")
    s.append_jsonl(logs), s.append_jsonl(logs)
    assert s.read_jsonl().count() == 2


def test_stream(spark, folder, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest.ingest_stream(ingest.text_stream(spark, str(folder)), s, str(tmp_path / "check")).awaitTermination()
    assert [r["doc_id"][:4] for r in s.table("documents").collect()] == ["cats"] and s.table("chunks").count() == 1


def test_log_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 2.0), ("2024-01-01 00:50:00", 4.0), ("2024-01-01 05:00:00", 1.0)], "t string, total_time_ms double").select(F.to_timestamp("t").alias("timestamp"), "total_time_ms")
    rows.write.parquet(str(tmp_path / "logs"))
    stream = ingest.log_windows(spark.readStream.schema("timestamp timestamp, total_time_ms double").parquet(str(tmp_path / "logs")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable(), q.stop()
    assert sorted((r["queries"], r["avg_total_time_ms"]) for r in spark.table("windows").collect()) == [(1, 1.0), (2, 3.0)]
