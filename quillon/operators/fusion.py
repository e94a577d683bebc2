"""Fusion, filters and roll-ups of rankings (qid, key, rank, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, key, dense_rank, sparse_rank, score, rank): sum of 1 / (k + rank). Equal scores keep the dense
    order, then that of rows found by sparse search only."""
    joined = dense.select("qid", "key", F.col("rank").alias("dense_rank")).join(sparse.select("qid", "key", F.col("rank").alias("sparse_rank")), ["qid", "key"], "full_outer")
    share = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    scored = joined.withColumn("score", F.round(share("dense_rank") + share("sparse_rank"), 6))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "key")
    return scored.withColumn("rank", F.row_number().over(order))


def rrf_multi(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fusion over several queries of one question: rankings (qid, query_no, source, key, rank), source 0 for
    dense and 1 for sparse; every ranking of every query adds to one score."""
    scored = rankings.groupBy("qid", "key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), F.min(F.struct("query_no", "source", "rank")).alias("first"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "key")
    return scored.withColumn("rank", F.row_number().over(order)).drop("first")


def ensemble_fuse(dense: DataFrame, sparse: DataFrame, dense_weight: float = 0.7, sparse_weight: float = 0.3) -> DataFrame:
    """(qid, key, score, rank): weighted sum of scores, each divided by the greatest of its list."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        most = F.max("score").over(Window.partitionBy("qid"))
        return df.select("qid", "key", F.when(most > 0, F.col("score") / most).otherwise(0.0).alias(name))

    joined = scaled(dense, "d").join(scaled(sparse, "s"), ["qid", "key"], "full_outer")
    scored = joined.select("qid", "key", F.round(dense_weight * F.coalesce("d", F.lit(0.0)) + sparse_weight * F.coalesce("s", F.lit(0.0)), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key")))


def overlap_stats(dense: DataFrame, sparse: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, dense_only, sparse_only, both, fused_dense, fused_sparse): how the rankings and the first top_k
    of their fusion share rows."""
    f = rrf_fuse(dense, sparse)
    d, s, r = F.col("dense_rank").isNotNull(), F.col("sparse_rank").isNotNull(), F.col("rank") <= top_k
    return f.groupBy("qid").agg(F.count_if(d & ~s).alias("dense_only"), F.count_if(s & ~d).alias("sparse_only"), F.count_if(d & s).alias("both"), F.count_if(r & d).alias("fused_dense"), F.count_if(r & s).alias("fused_sparse"))


def metadata_condition(metadata: Column, filters: dict[str, str | list[str]], missing: str = "pass") -> Column:
    """All filters hold: equality, or membership in a list. A key that a row lacks passes, or with
    missing="drop" fails."""
    if missing not in ("pass", "drop"):
        raise ValueError("missing is pass or drop")

    def one(key: str, want: str | list[str]) -> Column:
        have = F.element_at(metadata, F.lit(key))
        return F.coalesce(have.isin(list(want)) if isinstance(want, (list, tuple, set)) else have == want, F.lit(missing == "pass"))

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in filters.items()), F.lit(True))


def metadata_filter(df: DataFrame, filters: dict[str, str | list[str]], missing: str = "pass", metadata: str = "metadata") -> DataFrame:
    return df.where(metadata_condition(F.col(metadata), filters, missing))


def keyword_filter(ranking: DataFrame, keywords: list[str], content: str = "content") -> DataFrame:
    """Rows that contain one of the keywords as it is; of a query none of whose rows does, all rows."""
    hit = F.coalesce(reduce(lambda a, b: a | b, (F.col(content).contains(k) for k in keywords), F.lit(False)), F.lit(False))
    any_hit = F.max("__hit").over(Window.partitionBy("qid"))
    return ranking.withColumn("__hit", hit).withColumn("__any", any_hit).where("__hit OR NOT __any").drop("__hit", "__any")


def hydrate(ranking: DataFrame, contents: DataFrame) -> DataFrame:
    """The ranking with content, from contents (key, content), after the top k are known; a key without
    content keeps its row."""
    return ranking.join(contents, "key", "left")


def roll_up(ranking: DataFrame) -> DataFrame:
    """(qid, doc_id, source_path, max_score, chunks, rank) of documents, from ranked chunks."""
    grouped = ranking.groupBy("qid", "doc_id").agg(F.max("score").alias("max_score"), F.count("*").alias("chunks"), F.min("source_path").alias("source_path"))
    return grouped.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("max_score"), "doc_id")))
