"""Kept indexes, the store's commits, and files that can't be read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import rerank, sparse, vector
from quillon.sources import files, scratch
from quillon.sources.store import Store
from quillon.system import compare_backends, create_system

TEXTS = [(1, "red fox jumps"), (2, "red red hen sits"), (3, "blue fish"), (4, ""), (5, None), (6, "hen and fox and hen")]


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, content string")


def asked(spark):
    return spark.createDataFrame([(0, "red hen"), (1, "fox"), (2, "nothing here")], "qid long, query string")


def keep(name, df):
    return scratch.save(df, name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", [sparse.Bm25Index, sparse.TfidfIndex])
def test_sparse_index(spark, kind):
    """As a search without an index; brought up to date as built anew; no text is read."""
    whole = texts(spark, TEXTS)
    index = kind.build(whole, keep)
    plain = sparse.bm25_search if kind is sparse.Bm25Index else sparse.tfidf_search
    found = index.search(asked(spark), 3)
    assert rows(found) == rows(plain(whole, asked(spark), 3))
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString()
    old = kind.build(texts(spark, [*TEXTS[:3], (6, "other words"), (7, "goes away")]), keep)
    new = kind.build(texts(spark, TEXTS[3:]), keep, old=old, gone=spark.createDataFrame([(7,)], "key long"))
    assert rows(new.search(asked(spark), 3)) == rows(found)
    only = index.search(asked(spark), 3, keys=spark.createDataFrame([(6,)], "key long"))
    assert {r["key"] for r in only.collect()} == {6}
    many = spark.createDataFrame([(0, "fox " + " ".join(f"w{i}" for i in range(sparse.PUSHED + 5)))], "qid long, query string")
    assert rows(index.search(many, 3)) == rows(plain(whole, many, 3))


def vectors(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    data = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(n, None)]
    return spark.createDataFrame(data, "key long, vector array<double>")


def test_dense_indexes(spark):
    """All cells are exact; nulls, empty tables and no queries do no harm; recall of the defaults."""
    v = vectors(spark)
    q = v.where("key % 20 = 0 AND key < 400").withColumnRenamed("key", "qid")
    exact = rows(vector.search(v, q, 5))
    ivf = vector.IvfIndex.build(v, keep)
    assert rows(ivf.search(q, 5, probes=1000)) == exact
    some = {(r[0], r[1]) for r in rows(ivf.search(q, 5, probes=12))}
    assert len(some & {(a, b) for a, b, *_ in exact}) >= 0.8 * len(exact)
    lsh = vector.LshIndex.build(v, keep)
    near = {(r[0], r[1]) for r in rows(lsh.search(q, 5))}
    assert len(near & {(a, b) for a, b, *_ in exact}) >= 0.9 * len(exact)
    with_null = q.unionByName(spark.createDataFrame([(999, None)], "qid long, vector array<double>"))
    none, no_rows = q.limit(0), v.limit(0)
    for search in (vector.search, vector.ivf_search, vector.lsh_search):
        assert {r[0] for r in rows(search(v, with_null, 3))} == {r["qid"] for r in q.collect()}
        assert search(v, none, 3).count() == 0 and search(no_rows, q, 3).count() == 0
    keys = spark.createDataFrame([(k,) for k in range(0, 400, 7)], "key long")
    assert rows(ivf.search(q, 5, probes=1000, keys=keys)) == rows(vector.search(v.join(keys, "key", "left_semi"), q, 5))


def test_commits(spark, tmp_path):
    """Readers keep what they began with; a change writes its parts only; of two writers one fails."""
    s = Store(spark, str(tmp_path / "s"), parts=4)
    docs = lambda ids, text: spark.createDataFrame([(str(i), "p", "txt", text) for i in ids], "doc_id string, source_path string, doc_type string, content string")
    s.upsert_documents(docs(range(20), "a"))
    before = s.table("documents")
    s.upsert_documents(docs([3, 50], "b"))
    assert before.count() == 20 and s.table("documents").count() == 21
    log = s._log("documents")
    assert len(log[1]["parts"]) <= 2 and len(s.table("documents").select("content_hash").distinct().collect()) == 2
    s.delete_documents(s.table("documents").select("doc_id"))
    assert s.table("documents").count() == 0
    s.upsert_documents(docs([1], "c"))
    assert s.table("documents").count() == 1 and s.document("1").first()["metadata"] is None
    number = s._log("documents")[-1]["number"]
    with pytest.raises(Exception, match="exist"):
        s._commit("documents", number, log[-1]["folder"], None)
    s.log_performance(p50_ms=3)
    assert s.read_jsonl("performance_logs", "timestamp timestamp, metrics map<string,string>").first()["metrics"] == {"p50_ms": "3"}
    chunk = spark.createDataFrame([("1", 0, "main", "text", "one"), ("1", 1, "main", "text", "two")], "doc_id string, chunk_index int, section string, chunk_type string, content string").withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    s.upsert_chunks(chunk)
    assert [(r["chunk_index"], r["metadata"]) for r in s.chunks_of("1").collect()] == [(0, {"k": "v"}), (1, {"k": "v"})]
    assert [r["content"] for r in s.contents(spark.createDataFrame([("1", 1), ("9", 0)], "doc_id string, chunk_index int")).collect()] == ["two"]


def test_bad_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "latin.txt").write_bytes("caf\xe9 au lait".encode("latin-1"))
    (d / "good.pdf").write_bytes(b"text of a page")
    (d / "bad.pdf").write_bytes(b"broken")
    (d / "odd.xyz").write_text("x")
    (d / "names.md").write_text("call snake_case_name or _this_ or __that__")

    def pdf(content):
        if content == b"broken":
            raise ValueError("no PDF")
        return content.decode()

    found = {r["source_path"].rsplit("/", 1)[1]: r["content"] for r in files.read_documents(spark, str(d), pdf=pdf).collect()}
    assert found == {"latin.txt": "caf� au lait", "good.pdf": "text of a page", "names.md": "call snake_case_name or this or that"}
    errors = {r["source_path"].rsplit("/", 1)[1]: r["error"] for r in files.failed(spark, str(d), pdf=pdf).collect()}
    assert errors == {"bad.pdf": "ValueError: no PDF", "odd.xyz": "unsupported type: xyz"}
    s = create_system(spark, str(tmp_path / "store"), pdf=pdf)
    assert {k: s.ingest(str(d), rebuild=False)[k] for k in ("processed", "failed")} == {"processed": 3, "failed": 2}


@pytest.mark.parametrize("html,expected", [("caf&eacute; &#8217;x&#x41; &mdash;", "café ’xA —"), ("&amp;lt; &amp;eacute; &unknown; &#0; &#xD800; a & b;", "&lt; &eacute; &unknown; &#0; &#xD800; a & b;"), ("&nbsp;&lt;b&gt;", " <b>"), (None, None), ("", "")])
def test_entities(spark, html, expected):
    df = spark.createDataFrame([(html,)], "c string")
    assert df.select(T.html_to_text(F.col("c"))).first()[0] == (expected.replace(" <b>", T.ENTITIES[5][1] + "<b>") if html == "&nbsp;&lt;b&gt;" else expected)


def test_chain_and_model(spark):
    r = spark.createDataFrame([(0, 1, 1, "red fox", "a hen"), (0, 2, 2, "red fox", "red"), (0, 3, 3, "red fox", "red fox")], "qid long, key long, rank int, query string, content string")
    second = rerank.llm_score(lambda prompt: "9 of 10" if "Passage: red\n" in prompt else "no idea")
    got = rerank.rerank_chain(r, 2, [rerank.lexical_score, second]).orderBy("rank").collect()
    assert [(x["key"], x["old_rank"], x["score"]) for x in got] == [(2, 2, 9.0), (3, 3, 0.0)]
    assert [x["key"] for x in rerank.rerank_chain(r, 2, [None]).orderBy("rank").collect()] == [1, 2]


def test_expansion_and_caches(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "cats.txt").write_text("Cats sleep all day. They hunt mice at night.")
    (d / "dogs.txt").write_text("Dogs guard the house.")
    s = create_system(spark, str(tmp_path / "store"), expander=lambda q: ["felines hunt", "cats"])
    with pytest.raises(ValueError, match="index"):
        s.query("x")
    s.ingest(str(d))
    assert s.query("mice")["results"][0]["source_path"].endswith("cats.txt")
    assert s.query("mice")["stats"]["from_cache"] and s.get_cache_stats()["embeddings"]["size"] == 4
    other = create_system(spark, str(tmp_path / "store"))
    assert other.load_index() and other.query("house guard")["results"][0]["source_path"].endswith("dogs.txt")
    (d / "birds.txt").write_text("Birds sing.")
    s.ingest(str(d))
    assert s.index()["keys"].count() == 3 and s.query("birds sing")["results"][0]["source_path"].endswith("birds.txt")
    assert s.performance_summary()["total_queries"] == 3 and s.latency(["mice"])["from_cache"] == 0
    s.clear_cache()
    assert s.get_cache_stats()["results"]["hits"] == 0
    assert {r["backend"] for r in compare_backends()} == {"flat", "ivf", "lsh"}
