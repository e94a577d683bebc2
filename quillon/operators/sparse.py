"""Sparse retrieval: BM25 and TF-IDF over (key columns, content) rows.

Postings are long tables (term, key, tf) that an index keeps sorted by term, so a search reads the row groups of its
queries' terms and no text. A search without an index filters tokens by the terms of its queries before anything is
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

K1, B = 1.5, 0.75
#: Most terms that go to a scan as a filter.
PUSHED = 1000


def tokens(c: Column) -> Column:
    """Lower case, cut at white space; punctuation stays."""
    return T.words(F.lower(c))


def term_freq(df: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    return df.select(key, F.explode(tokens(F.col(content))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def doc_freq(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(df: DataFrame, content: str = "content") -> DataFrame:
    """One row: n rows, empty ones included, and their mean length in tokens."""
    return df.agg(F.count("*").alias("n"), (F.sum(F.size(tokens(F.col(content)))) / F.count("*")).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best rows of each qid with their rank; ties go to the smaller key."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """(qid, term, qtf): terms of each query and how often they stand there."""
    return queries.select("qid", F.explode(tokens(F.col(query))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


@dataclass
class Bm25Index:
    """postings (term, key, tf, dl), terms (term, df), lengths (key, dl) and corpus (n, avgdl; one row)."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    corpus: DataFrame

    TABLES = ("postings", "terms", "lengths", "corpus")

    @classmethod
    def build(cls, df: DataFrame, keep: Callable[[str, DataFrame], DataFrame], key: str = "doc_id", content: str = "content", old: Bm25Index | None = None, gone: DataFrame | None = None) -> Bm25Index:
        """Index rows (key, content). keep: writes a table under a name and reads it back. With old, its rows but for the
        keys of df and of gone (key) are taken over, so only df is tokenised."""
        words = df.select(F.col(key).alias("key"), tokens(F.col(content)).alias("w")).select("key", F.size("w").alias("dl"), "w")
        lengths = words.select("key", "dl")
        postings = words.select("key", "dl", F.explode("w").alias("term")).groupBy("term", "key", "dl").agg(F.count("*").alias("tf")).select("term", "key", "tf", "dl")
        if old is not None:
            away = lengths.select("key") if gone is None else lengths.select("key").unionByName(gone.select("key"))
            lengths = lengths.unionByName(old.lengths.join(away.distinct(), "key", "left_anti"))
            postings = postings.unionByName(old.postings.join(away.distinct(), "key", "left_anti"))
        lengths = keep("lengths", lengths)
        postings = keep("postings", postings.repartitionByRange("term").sortWithinPartitions("term", "key"))
        terms = keep("terms", doc_freq(postings).repartitionByRange("term").sortWithinPartitions("term"))
        corpus = keep("corpus", lengths.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl")))
        return cls(postings, terms, lengths, corpus)

    def search(self, queries: DataFrame, k: int = 10, query: str = "query", keys: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """(qid, key, score, rank) of the k best rows for each query (qid, query); scores above 0 only, rounded to six
        places and ranked so. keys: search among these (key) only. No text is read, but that of queries."""
        asked = query_terms(queries, query)
        found = pushed(self.postings, asked)
        if keys is not None:
            found = found.join(keys.select("key"), "key", "left_semi")
        weights = pushed(self.terms, asked).crossJoin(F.broadcast(self.corpus)).select("term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))  # corpus is one row
        share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        scored = found.join(weights.join(asked, "term"), "term").groupBy("qid", "key").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * share), 6).alias("score"))
        return top(scored.where("score > 0"), k, "key").select("qid", "key", "score", "rank")


def pushed(df: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the queries' terms. Up to ``PUSHED`` terms go to the scan as a filter, which skips row groups, as tables
    are sorted by term."""
    terms = asked.select("term").distinct()
    few = [r[0] for r in terms.limit(PUSHED + 1).collect()]
    return df.where(F.col("term").isin(few)) if len(few) <= PUSHED else df.join(terms, "term", "left_semi")


def bm25_search(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", content: str = "content", query: str = "query", k1: float = K1, b: float = B) -> DataFrame:
    """(qid, key, score, rank) as ``Bm25Index.search`` gives it, from texts that are indexed for this search alone. Only
    the queries' terms leave the scan; an index that is kept saves reading the texts."""
    asked = query_terms(queries, query)
    terms = asked.select("term").distinct()
    lengths = df.select(key, tokens(F.col(content)).alias("t")).select(key, F.size("t").alias("dl"), "t")
    found = lengths.select(key, "dl", F.explode("t").alias("term")).join(terms, "term", "left_semi").groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    stats = corpus_stats(df, content)
    weights = found.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))  # stats is one row
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = found.join(weights, "term").join(asked, "term").groupBy("qid", key).agg(F.round(F.sum(F.col("qtf") * F.col("idf") * share), 6).alias("score"))
    return top(scored.where("score > 0"), k, key).select("qid", key, "score", "rank")


# ---------------------------------------------------------------- TF-IDF

def features(df: DataFrame, key: str, content: str, stop_words=T.STOP_WORDS) -> DataFrame:
    """(key, term): words and pairs of neighbouring words, after stop words are gone. The words are a column of
    their own, so they are made once for each row."""
    found = F.regexp_extract_all(F.lower(F.col(content)), F.lit(T.WORD + "+"), F.lit(0))
    rows = df.select(key, F.filter(found, lambda x: ~x.isin(*stop_words)).alias("__w"))
    w = F.col("__w")
    joined = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return rows.select(key, F.explode(F.concat(w, F.filter(joined, lambda p: p.isNotNull()))).alias("term"))


def vocabulary(df: DataFrame, key: str = "doc_id", content: str = "content", most: int = 10_000, stop_words=T.STOP_WORDS) -> DataFrame:
    """(term, idf) of the ``most`` most frequent features (a model parameter), ties by term."""
    counted = features(df, key, content, stop_words).groupBy("term", key).agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    kept = counted.orderBy(F.desc("cf"), "term").limit(most)
    n = df.agg(F.count("*").alias("n"))
    return kept.crossJoin(F.broadcast(n)).select("term", smooth_idf(F.col("n"), F.col("df")).alias("idf"))  # n is one row


def tfidf_weights(df: DataFrame, vocab: DataFrame, key: str = "doc_id", content: str = "content", stop_words=T.STOP_WORDS) -> DataFrame:
    """(key, term, weight): raw counts times idf, of unit length for each key."""
    tf = features(df, key, content, stop_words).join(vocab.select("term"), "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"))
    return unit(tf.join(vocab, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w")), key)


@dataclass
class TfidfIndex:
    """counts (key, term, tf), weights (term, key, weight) of unit length for each key, and vocabulary (term, idf)."""

    counts: DataFrame
    weights: DataFrame
    vocabulary: DataFrame

    TABLES = ("counts", "weights", "vocabulary")

    @classmethod
    def build(cls, df: DataFrame, keep: Callable[[str, DataFrame], DataFrame], key: str = "doc_id", content: str = "content", most: int = 10_000, stop_words=T.STOP_WORDS, old: TfidfIndex | None = None, gone: DataFrame | None = None) -> TfidfIndex:
        """Index rows (key, content); see ``Bm25Index.build``. Features are made once and counted; vocabulary and
        weights come from the counts. A row without features is counted by a null term."""
        named = df.select(F.col(key).alias("key"), F.col(content).alias("content"))
        found = features(named, "key", "content", stop_words).groupBy("key", "term").agg(F.count("*").alias("tf"))
        counts = found.unionByName(named.select("key", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
        if old is not None:
            away = named.select("key") if gone is None else named.select("key").unionByName(gone.select("key"))
            counts = counts.unionByName(old.counts.join(away.distinct(), "key", "left_anti"))
        counts = keep("counts", counts)
        real = counts.where("term IS NOT NULL")
        kept = real.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).orderBy(F.desc("cf"), "term").limit(most)
        n = counts.where("term IS NULL").agg(F.count("*").alias("n"))
        vocab = keep("vocabulary", kept.crossJoin(F.broadcast(n)).select("term", smooth_idf(F.col("n"), F.col("df")).alias("idf")))  # n is one row
        weights = unit(real.join(vocab, "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("w")), "key")
        weights = keep("weights", weights.select("term", "key", "weight").repartitionByRange("term").sortWithinPartitions("term", "key"))
        return cls(counts, weights, vocab)

    def search(self, queries: DataFrame, k: int = 10, query: str = "query", keys: DataFrame | None = None, stop_words=T.STOP_WORDS) -> DataFrame:
        """(qid, key, score, rank) by cosine of TF-IDF vectors; scores above 0 only."""
        asked = tfidf_weights(queries, self.vocabulary, "qid", query, stop_words).select("qid", "term", F.col("weight").alias("qw"))
        found = pushed(self.weights, asked)
        if keys is not None:
            found = found.join(keys.select("key"), "key", "left_semi")
        scored = found.join(asked, "term").groupBy("qid", "key").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))
        return top(scored.where("score > 0"), k, "key").select("qid", "key", "score", "rank")


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def unit(raw: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) of (key, term, w), of unit length for each key."""
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / length).alias("weight"))


def tfidf_search(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", content: str = "content", query: str = "query", most: int = 10_000) -> DataFrame:
    """(qid, key, score, rank) by cosine of TF-IDF vectors; scores above 0 only."""
    vocab = vocabulary(df, key, content, most)
    asked = tfidf_weights(queries, vocab, "qid", query).select("qid", "term", F.col("weight").alias("qw"))
    scored = tfidf_weights(df, vocab, key, content).join(asked, "term").groupBy("qid", key).agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))
    return top(scored.where("score > 0"), k, key).select("qid", key, "score", "rank")
