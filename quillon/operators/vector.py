"""Dense retrieval: exact search by blocks, inverted-file search, hashing by random planes, encoders.

Query vectors are read in blocks of bounded size; blocks of up to ``PASS_BYTES`` go with the tasks of one pass over the
corpus, where a matrix product scores each against Arrow batches. A batch keeps its k best for each query, so no more
than k rows a query and batch are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Queries scored at once, bytes of query vectors that go with a task, and most cells of an inverted file.
BLOCK, PASS_BYTES, MOST_CELLS = 2048, 32 << 20, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The vector at unit length (a zero vector as it is)."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def matrix(col: pa.Array) -> np.ndarray:
    """A list column as rows of doubles."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


#: Scores of all rows (V) for all queries (Q); greater is nearer. Rounded, so that ties are ties.
def cosine(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.round(v @ q.T / np.maximum(np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1), 1e-300), 6)


def inner(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.round(v @ q.T, 6)


def minus_l2(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return -np.round(np.maximum((v * v).sum(1)[:, None] + (q * q).sum(1) - 2 * (v @ q.T), 0), 6)


SCORED = pa.schema([("qid", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])


def blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(qids, vectors) of at most ``size`` queries at a time."""
    held = []
    for r in queries.select("qid", "vector").where("vector IS NOT NULL").toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield np.array([r[0] for r in held]), np.array([r[1] for r in held], np.float64)
            held = []
    if held:
        yield np.array([r[0] for r in held]), np.array([r[1] for r in held], np.float64)


def filled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that have a vector."""
    return batch.filter(batch.column("vector").is_valid())


def nearest(batches, qids: np.ndarray, q: np.ndarray, k: int, measure: Callable, admitted: Callable | None = None):
    """Of each batch, one batch of the k best rows for each query. admitted: batch to flags (rows, queries) of the pairs
    that count."""
    for batch in batches:
        batch = filled(batch)
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        scores = measure(matrix(batch.column("vector")), q)
        if admitted is not None:
            scores = np.where(admitted(batch), scores, -np.inf)
        found = [_few(key, scores[:, j], k) for j in range(len(qids))]
        at, of = np.concatenate(found), np.repeat(np.arange(len(qids)), [len(x) for x in found])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(qids[of]), pa.array(key[at]), pa.array(scores[at, of])], schema=SCORED)


def _few(key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k best that count, ties by key."""
    some = np.flatnonzero(score > -np.inf)
    if len(some) > 4 * k:
        least = np.partition(score[some], len(some) - k)[len(some) - k]
        some = some[score[some] >= least]
    return some[np.lexsort((key[some], -score[some]))[:k]]


def best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(corpus: DataFrame, queries: DataFrame, k: int = 10, measure: Callable = cosine) -> DataFrame:
    """(qid, key, score, rank): the k rows of corpus (key, vector) nearest to each of queries (qid, vector).
    Exact. Filter the corpus before to search a part of it."""
    rows = corpus.select(F.col("key").cast("long").alias("key"), "vector")
    found = corpus.sparkSession.createDataFrame([], "qid long, key long, score double")
    for some in passes(queries):
        found = found.unionByName(rows.mapInArrow(lambda b, some=some: nearest_of_each(b, some, k, measure), "qid long, key long, score double"))
    return best(found, k)


def passes(queries: DataFrame) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Blocks of queries that go over the corpus together: as many as ``PASS_BYTES`` of vectors."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for block in blocks(queries):
        if held and sum(q.nbytes for _, q in held) + block[1].nbytes > PASS_BYTES:
            yield held
            held = []
        held.append(block)
    if held:
        yield held


def nearest_of_each(batches, some: list[tuple[np.ndarray, np.ndarray]], k: int, measure: Callable):
    for batch in batches:
        for qids, q in some:
            yield from nearest([batch], qids, q, k, measure)


# ---------------------------------------------------------------- inverted file

def squares(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres, rounded, so that ties are ties."""
    return np.round((v * v).sum(1)[:, None] + (centre * centre).sum(1) - 2 * v @ centre.T, 9)


def centroids(corpus: DataFrame, cells: int | None = None, seed: int = 3, per_cell: int = 64, rounds: int = 8) -> np.ndarray:
    """Centres of k-means cells, fitted on a bounded sample: about ``per_cell`` rows a cell, chosen by a hash of the key.
    cells: by default the root of the number of rows, at most ``MOST_CELLS``."""
    corpus = corpus.where(F.col("vector").isNotNull())
    n = corpus.count()
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    share = min(1.0, cells * per_cell / max(n, 1))
    rows = corpus.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).orderBy("key").select("vector").collect()
    x = np.array([r[0] for r in rows], np.float64)
    if not len(x):
        return x.reshape(0, 0)
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        cell = squares(x, centre).argmin(1)
        for c in range(len(centre)):
            if (cell == c).any():
                centre[c] = x[cell == c].mean(0)
    return centre


def with_cell(batches, centre: np.ndarray):
    for batch in batches:
        batch = filled(batch)
        if batch.num_rows:
            cell = squares(matrix(batch.column("vector")), centre).argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("key"), batch.column("vector")], names=["cell", "key", "vector"])


@dataclass
class IvfIndex:
    """centres (cells, width), and rows (cell, key, vector) sorted by cell."""

    centres: np.ndarray
    rows: DataFrame

    @classmethod
    def build(cls, corpus: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df, cells: int | None = None, centres: np.ndarray | None = None) -> IvfIndex:
        """Fit cells to rows (key, vector), unless centres are given, and put each row into the nearest. Rows without a
        vector stay out. keep: see ``sparse.Bm25Index.build``."""
        centres = centroids(corpus, cells) if centres is None else centres
        rows = corpus.select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
        dealt = rows.mapInArrow(lambda b: with_cell(b, centres) if len(centres) else iter(()), "cell int, key long, vector array<double>")
        return cls(centres, keep("cells", dealt.repartitionByRange("cell").sortWithinPartitions("cell", "key")))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 10, keys: DataFrame | None = None) -> DataFrame:
        """(qid, key, score, rank): the k rows nearest by cosine in the ``probes`` cells nearest to each query; all cells
        give the exact result. Cells that no query of a block probes are not read; of a batch, no more than the k best
        for each query leave the task. keys: search among these (key) only."""
        rows = self.rows if keys is None else self.rows.join(keys.select("key"), "key", "left_semi")
        found = rows.sparkSession.createDataFrame([], "qid long, key long, score double")
        if not len(self.centres):
            return best(found, k)
        for qids, q in blocks(queries):
            probed = np.zeros((len(self.centres), len(qids)), bool)
            near = np.argsort(squares(q, self.centres), axis=1, kind="stable")[:, :probes]
            probed[near.T, np.arange(len(qids))] = True
            wanted = np.flatnonzero(probed.any(axis=1)).tolist()
            some = rows.where(F.col("cell").isin(wanted)) if len(wanted) < len(self.centres) else rows
            admitted = lambda batch, probed=probed: probed[batch.column("cell").to_numpy()]
            found = found.unionByName(some.mapInArrow(lambda b, qids=qids, q=q, admitted=admitted: nearest(b, qids, q, k, cosine, admitted), "qid long, key long, score double"))
        return best(found, k)


def ivf_search(corpus: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None, probes: int = 10) -> DataFrame:
    """Approximate search with an index that is built for it alone; see ``IvfIndex``."""
    return IvfIndex.build(corpus, cells=cells).search(queries, k, probes)


# ---------------------------------------------------------------- random planes

@dataclass
class LshIndex:
    """Rows (key, sides, vector): of each vector, its bucket in each table, which is the sides of random planes on which it
    lies."""

    planes: np.ndarray
    rows: DataFrame

    @classmethod
    def build(cls, corpus: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df, tables: int = 24, bits: int = 8, width: int | None = None, seed: int = 5) -> LshIndex:
        rows = corpus.select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
        if width is None:
            first = rows.first()
            width = len(first["vector"]) if first else 0
        planes = np.random.default_rng(seed).normal(size=(tables, bits, width))
        signed = rows.mapInArrow(lambda b: with_sides(b, planes), "key long, sides array<int>, vector array<double>")
        spark = rows.sparkSession
        n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return cls(planes, keep("rows", signed.repartition(n, "key")))

    def search(self, queries: DataFrame, k: int = 10, radius: int = 1, keys: DataFrame | None = None) -> DataFrame:
        """(qid, key, score, rank): of rows that in some table lie on the query's side of all planes but ``radius`` (0 or 1),
        the k nearest by cosine. Buckets are sets of bits over the rows of a batch, so no pair of a query and a row leaves
        its task but the k best of each query and batch."""
        rows = self.rows if keys is None else self.rows.join(keys.select("key"), "key", "left_semi")
        found = rows.sparkSession.createDataFrame([], "qid long, key long, score double")
        planes = self.planes
        for some in passes(queries):
            found = found.unionByName(rows.mapInArrow(lambda b, some=some: nearest_in_buckets(b, some, k, planes, radius), "qid long, key long, score double"))
        return best(found, k)


def sides(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The bucket of each vector (row) in each table (column)."""
    return np.stack([(v @ p.T > 0) @ (1 << np.arange(planes.shape[1])) for p in planes], axis=1)


def with_sides(batches, planes: np.ndarray):
    for batch in map(filled, batches):
        if batch.num_rows:
            own = pa.array(list(sides(matrix(batch.column("vector")), planes).astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), own, batch.column("vector")], names=["key", "sides", "vector"])


def nearest_in_buckets(batches, some: list[tuple[np.ndarray, np.ndarray]], k: int, planes: np.ndarray, radius: int):
    """Of each batch, the k best rows for each query among those of its buckets, and with radius 1 of theirs next to them."""
    flips = np.concatenate(([0], 1 << np.arange(planes.shape[1]) if radius else np.empty(0, np.int64))).astype(np.int64)
    asked = []
    for batch in batches:
        if not batch.num_rows:
            continue
        asked = asked or [(qids, q, sides(q, planes)) for qids, q in some]
        key, v = batch.column("key").to_numpy(), matrix(batch.column("vector"))
        own = batch.column("sides").flatten().to_numpy().reshape(len(key), -1)
        v = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
        near = []  # of each table, the rows in and around each bucket that holds any
        for t in range(len(planes)):
            ids, at = np.unique(own[:, t], return_inverse=True)
            held = np.packbits(at[None, :] == np.arange(len(ids))[:, None], axis=1)
            near.append((ids, held))
        for qids, q, of_query in asked:
            q = q / np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]
            met = np.zeros((len(qids), (len(key) + 7) // 8), np.uint8)
            for (ids, held), bucket in zip(near, of_query.T, strict=True):
                around, at = np.unique(bucket, return_inverse=True)
                ball = np.zeros((len(around), held.shape[1]), np.uint8)
                for flip in flips:
                    i = np.minimum(np.searchsorted(ids, around ^ flip), len(ids) - 1)
                    there = ids[i] == around ^ flip
                    ball[there] |= held[i[there]]
                met |= ball[at]
            for i in range(0, len(qids), 256):
                scores = np.round(q[i : i + 256] @ v.T, 6)
                scores[np.unpackbits(met[i : i + 256], axis=1, count=len(key)) == 0] = -np.inf
                found = [_few(key, x, k) for x in scores]
                at, of = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(qids[i + of]), pa.array(key[at]), pa.array(scores[of, at])], schema=SCORED)


def lsh_search(corpus: DataFrame, queries: DataFrame, k: int = 10, **how) -> DataFrame:
    """Approximate search with buckets that are made for it alone; see ``LshIndex``."""
    return LshIndex.build(corpus, **how).search(queries, k)


# ---------------------------------------------------------------- encoders

def hash_embed(c: Column, width: int = 64) -> Column:
    """A deterministic stand-in for a model: counts of words by a digest's bucket, at unit length."""
    bucket = F.transform(T.words(F.lower(c)), lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(width)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(bucket, lambda b: b == i)).cast("double"))
    return l2_normalize(counts)


def hash_embed_rows(df: DataFrame, key: str, content: str, width: int = 64) -> DataFrame:
    """(key, bucket, weight) of the same encoder in long form: one count per word, no array arithmetic."""
    word = df.select(key, F.explode(T.words(F.lower(F.col(content)))).alias("w"))
    counted = word.select(key, F.pmod(F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(width)).cast("int").alias("bucket")).groupBy(key, "bucket").agg(F.count("*").cast("double").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counted.select(key, "bucket", (F.col("n") / length).alias("weight"))


def hash_encode(batches, key: str, width: int):
    import hashlib

    known: dict[str, int] = {}
    for batch in batches:
        out = np.zeros((batch.num_rows, width))
        for i, t in enumerate(batch.column("content").to_pylist()):
            for w in (t or "").lower().split():
                b = known.get(w)
                if b is None:
                    b = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % width
                out[i, b] += 1
            if len(known) > 500_000:
                known.clear()
        length = np.linalg.norm(out, axis=1)[:, None]
        out /= np.where(length > 0, length, 1)
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(list(out), pa.list_(pa.float64()))], names=[key, "vector"])


def encode(df: DataFrame, key: str, content: str, width: int = 64, encoder: Callable | None = None) -> DataFrame:
    """(key, vector) of texts. encoder: batches of (key, content) to batches of (key, vector); by default the
    hash encoder. A model is loaded once in each call, so once a task."""
    encoder = encoder or (lambda b: hash_encode(b, key, width))
    return df.select(F.col(key).cast("long").alias(key), F.col(content).alias("content")).mapInArrow(encoder, f"{key} long, vector array<double>")
