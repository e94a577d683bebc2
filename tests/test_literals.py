"""Literal inputs with results worked out by hand, for branches that the tables never reach."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import cache
from quillon.functions import text as T
from quillon.operators import chunking, context, fusion, metrics, rerank, sparse, vector


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("f", "given", "expected"), [
    (T.normalize_text, " a\n\n b\t c ", "a b c"),
    (T.normalize_query, "  What IS  RAG?? v1...2 ", "what is rag v1.2"),
    (T.normalize_query, "a ? b", "a  b"),
    (T.normalize_query, "機械学習とは何ですか？", "機械学習とは何ですか"),
    (T.keywords, "The index of BM25 is on disk", ["index", "BM25", "disk"]),
    (T.adaptive_multiplier, "a b c d", 2), (T.adaptive_multiplier, "a b c d e", 3),
    (T.adaptive_multiplier, " ".join("abcdefghi"), 3), (T.adaptive_multiplier, " ".join("abcdefghij"), 4),
    (T.is_heading, "# T", True), (T.is_heading, "1. Intro", True), (T.is_heading, "Overview", True),
    (T.is_heading, "Overview.", False), (T.is_heading, "overview", False),
    (T.overlap_tail, " ".join(f"w{i}" for i in range(1, 61)), " ".join(f"w{i}" for i in range(11, 61)) + " "),
    (T.overlap_tail, "x" * 200 + "y" * 100, "y" * 100),
    (T.parse_expansion, "a, b，c\n\n d、e,f", ["a", "b", "c", "d", "e"]),
    (T.html_to_text, "<p>a &amp;lt; b</p><script>x</script><!-- c --><title>t</title>", "a &lt; bt"),
    (chunking.sentence_pack, "検索する。索引を作る。", ["検索する。索引を作る"]),
])
def test_columns(spark, f, given, expected):
    assert one(spark, given, f) == expected


def test_sentence_pack_of_twenty(spark):
    assert one(spark, "Aaaa bbbb. Cccc dddd. Eeee.", lambda c: chunking.sentence_pack(c, 20, 5)) == ["Aaaa bbbb. Cccc dddd", "Eeee"]


def test_split_by_size(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    parts = one(spark, text, T.parts_by_size)
    assert [len(p) for p in parts] == [512, 512, 76]
    assert parts == [text[0:512], text[462:974], text[924:1000]]
    assert one(spark, "", T.parts_by_size) == []
    with pytest.raises(ValueError, match="overlap"):
        T.parts_by_size(F.col("c"), 50, 50)


def test_blocks_come_fenced_first(spark):
    text = "a\n<pre>p</pre>\n```\ncode\n```\n| h | i |\n|---|---|\n| 1 | 2 |\nend"
    rows = chunking.extract_blocks(spark.createDataFrame([(1, text)], "doc_id long, content string")).orderBy("chunk_index").collect()
    assert [(r["section"], r["chunk_type"], r["content"].split("\n")[0]) for r in rows] == [("code_block", "code", "```"), ("code_block", "code", "<pre>p</pre>"), ("table", "table", "| h | i |")]


def test_structure(spark):
    text = "Intro text here.\n\n# One\n\nFirst paragraph.\n\nSecond paragraph.\n\n# Two\n\n" + "Word word. " * 60
    rows = chunking.chunk_documents(spark.createDataFrame([("d", text, "s")], "doc_id string, content string, source_path string"), 200, 20).orderBy("chunk_index").collect()
    assert rows[0]["section"] == "main" and rows[1]["section"] == "# One"
    assert rows[1]["content"] == "# One\n\nFirst paragraph.\n\nSecond paragraph."
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and all(r["content"] for r in rows)
    assert all(len(r["content"]) <= 200 for r in rows)


def test_packer_sizes():
    packer = chunking.Packer(20, 5, False)
    assert packer.sentences("Aaaa bbbb. Cccc dddd. Eeee.") == ["Aaaa bbbb. Cccc dddd", "Eeee"]
    long = "x" * 45
    assert packer.sentences(f"{long}. yy.")[0] == long  # an over-long sentence that isn't the last stays whole
    assert max(map(len, chunking.Packer(20, 5, True).sentences(f"{long}. yy."))) <= 20
    assert packer.chunks("") == []


def test_bm25_idf(spark):
    assert one(spark, 1, lambda c: sparse.idf(F.lit(3), c), "int") == pytest.approx(0.980829, abs=1e-6)


def ranking(spark, rows):
    return spark.createDataFrame(rows, "qid long, key long, rank int, score double")


def test_rrf(spark):
    a, b, c = 1, 2, 3
    got = fusion.rrf_fuse(ranking(spark, [(0, a, 1, 1.0), (0, b, 2, 0.5)]), ranking(spark, [(0, b, 1, 1.0), (0, c, 2, 0.5)])).orderBy("rank").collect()
    assert [r["key"] for r in got] == [b, a, c]
    assert got[0]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)
    tie = fusion.rrf_fuse(ranking(spark, [(0, 9, 1, 1.0)]), ranking(spark, [(0, 5, 1, 1.0)])).orderBy("rank").collect()
    assert [r["key"] for r in tie] == [9, 5]


def test_ensemble(spark):
    got = fusion.ensemble_fuse(ranking(spark, [(0, 1, 1, 0.8), (0, 2, 2, 0.4)]), ranking(spark, [(0, 2, 1, 2.0)])).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in got] == [(1, 0.7), (2, 0.65)]


def test_metadata_filter(spark):
    df = spark.createDataFrame([(1, {"lang": "en"}), (2, {"lang": "ja"}), (3, {})], "key long, metadata map<string,string>")
    keys = lambda **k: sorted(r["key"] for r in fusion.metadata_filter(df, {"lang": "en"}, **k).collect())
    assert keys() == [1, 3] and keys(missing="drop") == [1]
    assert sorted(r["key"] for r in fusion.metadata_filter(df, {"lang": ["en", "ja"]}).collect()) == [1, 2, 3]


def test_keyword_filter_falls_back(spark):
    df = spark.createDataFrame([(0, 1, "abc"), (0, 2, "xyz"), (1, 3, "q")], "qid long, key long, content string")
    assert sorted(r["key"] for r in fusion.keyword_filter(df, ["abc"]).collect()) == [1, 3]


def test_context_budget(spark):
    rows = [(0, 1, "a" * 300, "dir/f.txt", "main", 0.5), (0, 2, "A" * 300, "dir/f.txt", "main", 0.4), (0, 3, "b" * 500, "g.txt", "Sec", 0.25), (0, 4, "c", "g.txt", "main", 0.1)]
    df = spark.createDataFrame(rows, "qid long, rank int, content string, source_path string, section string, score double")
    whole = context.build_context(df, with_scores=True).first()
    assert whole["chunks"] == 3 and whole["context"].startswith("[Chunk 1] (Source: f.txt) [Score: 0.500]\naaa")
    assert "[Chunk 2] (Source: g.txt, Section: Sec) [Score: 0.250]\nbbb" in whole["context"]
    cut = context.build_context(df, 200).first()  # 800 characters: the second is cut
    assert cut["chunks"] == 2 and cut["context"].endswith("b...")
    none = context.build_context(df, 150).first()  # too little is left
    assert none["chunks"] == 1


def test_metrics(spark):
    rank = spark.createDataFrame([(0, "A", 1)], "qid long, doc string, rank int")
    rel = spark.createDataFrame([(0, "A"), (0, "B")], "qid long, doc string")
    get = lambda **k: metrics.per_query(rank, rel, (5,), **k).first()
    assert get()["ndcg"] == 1.0 and get()["precision"] == 1.0 and get()["recall"] == 0.5
    assert get(ideal_by_k=True)["ndcg"] == pytest.approx(0.613147, abs=1e-6)
    third = spark.createDataFrame([(0, "X", 1), (0, "Y", 2), (0, "A", 3)], "qid long, doc string, rank int")
    assert metrics.mrr(third, rel).first()["mrr"] == pytest.approx(1 / 3, abs=1e-6)
    assert metrics.mrr(third.where("doc <> 'A'"), rel).first()["mrr"] == 0
    two = spark.createDataFrame([(0, "A", 1), (0, "X", 2)], "qid long, doc string, rank int")
    assert metrics.per_query(two, rel, (5,)).first()["precision"] == 0.5


def test_mmr(spark):
    rows = [(0, k, k + 1, 1.0 - k / 10, [math.cos(k), math.sin(k)]) for k in range(4)]
    df = spark.createDataFrame(rows, "qid long, key long, rank int, score double, vector array<double>")
    assert [r["key"] for r in rerank.mmr_select(df, 10).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert [r["key"] for r in rerank.mmr_select(df, 2, 1.0).orderBy("rank").collect()] == [0, 1]
    assert [r["key"] for r in rerank.mmr_select(df, 2, 0.1).orderBy("rank").collect()] == [0, 3]


def test_search_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    q = v.where("key % 20 = 0").withColumnRenamed("key", "qid")
    exact = {(r["qid"], r["key"]) for r in vector.search(v, q).collect()}
    assert exact == {(r["qid"], r["key"]) for r in vector.ivf_search(v, q, 10, 8, 8).collect()}
    assert len(exact & {(r["qid"], r["key"]) for r in vector.ivf_search(v, q, 10, 16, 10).collect()}) >= 0.9 * len(exact)
    assert len(exact & {(r["qid"], r["key"]) for r in vector.lsh_search(v, q).collect()}) >= 0.9 * len(exact)


def test_encoders_agree(spark):
    df = spark.createDataFrame([(1, "one two Two three"), (2, "")], "key long, content string")
    by_model = {r["key"]: r["vector"] for r in vector.encode(df, "key", "content").collect()}
    by_column = {r["key"]: r["v"] for r in df.select("key", vector.hash_embed(F.col("content")).alias("v")).collect()}
    assert by_model[1] == pytest.approx(by_column[1]) and by_model[2] == pytest.approx(by_column[2])


def test_cache():
    now = [0.0]
    c = cache.Cache(2, 10, lambda: now[0])
    assert c.get("a") is None
    c.put("a", 1), c.put("b", 2), c.put("b", 3)
    assert (c.get("a"), c.evictions) == (1, 0)
    c.put("c", 4)
    assert c.get("b") is None and c.stats()["evictions"] == 1
    now[0] = 20
    assert c.get("a") is None and c.stats()["expired"] == 1
    assert cache.key(" Q ", keywords=["b", "a"]) == cache.key("q", keywords=["a", "b"]) != cache.key("q")
