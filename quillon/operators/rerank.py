"""Reranking by a pluggable scorer, statistics of it, and diversification by maximal marginal relevance."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T


def lexical_score(query: Column, content: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct words that the content
    has."""
    q = F.array_distinct(T.words(F.lower(query)))
    c = T.words(F.lower(F.coalesce(content, F.lit(""))))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, c)) / F.size(q), 6)).otherwise(0.0)


def model_score(scorer: Callable[[list[str], list[str]], list[float]], batch: int = 32):
    """A column function (query, content) for a model: scorer gets lists of pairs, at most ``batch`` long."""

    @F.pandas_udf("double")
    def scored(query: pd.Series, content: pd.Series) -> pd.Series:
        q, c = query.tolist(), content.fillna("").tolist()
        return pd.Series([s for i in range(0, len(q), batch) for s in scorer(q[i : i + batch], c[i : i + batch])], dtype="float64")

    return scored


def rerank(ranking: DataFrame, top_k: int | None = 10, score: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """ranking (qid, key, rank, query, content) in order of new scores, with old_rank; equal scores keep their
    order. top_k None keeps all, for diversification to choose from."""
    scored = ranking.withColumn("score", score(F.col("query"), F.col("content"))).withColumnRenamed("rank", "old_rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "old_rank")))
    return ranked if top_k is None else ranked.where(F.col("rank") <= top_k)


def rerank_chain(ranking: DataFrame, top_k: int | None, scores: Sequence[Callable[[Column, Column], Column] | None]) -> DataFrame:
    """Rerankers one after the other: each orders what the one before kept; the first cuts to top_k. None stands for a
    stage that keeps the order (a language model that isn't there). old_rank is the rank before all of them."""
    out, first = ranking, True
    for score in scores:
        if score is None:
            out = out if top_k is None else out.where(F.col("rank") <= top_k)
            continue
        again = rerank(out if first else out.drop("old_rank"), top_k, score)
        out = again if first else again.drop("old_rank").join(out.select("qid", "key", "old_rank"), ["qid", "key"])
        first = False
    return out.withColumn("old_rank", F.col("rank")) if first else out


def model_prompt(query: str, content: str) -> str:
    """What a language model is asked for a score."""
    return f"How well does this passage answer the question? Answer with a number from 0 to 10.\n\nQuestion: {query}\n\nPassage: {content}\n\nScore:"


def llm_score(client: Callable[[str], str], batch: int = 32):
    """A column function (query, content) for a language model: client gets a prompt and gives an answer, of which the
    first number counts (0 if there is none)."""

    def scorer(queries: list[str], contents: list[str]) -> list[float]:
        answers = [client(model_prompt(q, c)) for q, c in zip(queries, contents, strict=True)]
        return [float(m[0]) if (m := re.search(r"\d+(?:\.\d+)?", a or "")) else 0.0 for a in answers]

    return model_score(scorer, batch)


def rerank_stats(reranked: DataFrame) -> DataFrame:
    """(qid, results, avg_change, max_change, min_change): of places gained."""
    change = F.col("old_rank") - F.col("rank")
    return reranked.groupBy("qid").agg(F.count("*").alias("results"), F.round(F.avg(change), 6).alias("avg_change"), F.max(change).alias("max_change"), F.min(change).alias("min_change"))


def mmr(relevance: np.ndarray, vectors: np.ndarray, top_k: int, balance: float) -> list[int]:
    """Indices in order of choice: the greatest balance * relevance - (1 - balance) * closeness to what is
    chosen; the first of equals."""
    if len(relevance) <= top_k:
        return list(range(len(relevance)))
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
    close, chosen = np.zeros(len(unit)), []
    gain = balance * relevance
    for n in range(top_k):
        value = np.round(gain - (1 - balance) * close, 6)
        value[chosen] = -np.inf
        i = int(value.argmax())
        chosen.append(i)
        near = unit @ unit[i]
        close = near if n == 0 else np.maximum(close, near)
    return chosen


def mmr_select(ranking: DataFrame, top_k: int = 10, balance: float = 0.6) -> DataFrame:
    """(qid, key, score, rank) by maximal marginal relevance from ranking (qid, key, rank, score, vector); the
    score stays the relevance. A query's candidates are the few that its search returned."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        width = max((len(v) for v in pdf["vector"] if v is not None), default=1)
        pdf["vector"] = [np.zeros(width) if v is None else v for v in pdf["vector"]]  # no vector: close to nothing
        order = mmr(pdf["score"].to_numpy(), np.stack(pdf["vector"].to_numpy()).astype(np.float64), top_k, balance)
        out = pdf.iloc[order][["qid", "key", "score"]].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out

    return ranking.select("qid", "key", "rank", "score", "vector").groupBy("qid").applyInPandas(choose, "qid long, key long, score double, rank int")
