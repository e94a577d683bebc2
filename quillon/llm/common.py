"""Shared building blocks: Arrow chunking, vectorised word hashes, packed integer blobs, shared storage.

Text is handled in *chunks*: runs of rows holding a bounded number of bytes, so that a kernel's
memory does not depend on the size of a partition. Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.scratch import shared_dir

CHUNK_BYTES = 6 << 20
U64 = np.uint64
GOLD, MIX1, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


# ---------------------------------------------------------------- storage

def save(df: DataFrame, name: str, by: str | None = None, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back. ``by``: a column of
    row kinds, each written to a folder of its own so that readers of one kind skip the others. The table goes with the
    innermost ``Scratch`` that is open, or else stays; ``saved_at`` is its folder."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].paths.append(path)
    out = df.write.option("compression", codec)
    if by:
        out = out.partitionBy(by)
    out.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    found.saved_at = path
    return found


_open: list[Scratch] = []


class Scratch:
    """Tables that are saved while it is open are deleted when it closes, as the work they served is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Cut lineage, and let go of what led to the table."""
        found = save(df, name, codec=codec)
        del df
        free(self.spark)
        return found

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Save what is to stay (until an outer one closes)."""
        found = save(df, name)
        self.paths.remove(found.saved_at)
        if len(_open) > 1:
            _open[-2].paths.append(found.saved_at)
        return found

    def deal(self, df: DataFrame, by: str, name: str) -> DataFrame:
        """Write rows bucketed by a column, so that later joins on it leave them in place."""
        n, table = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
        self.paths.append(f"{shared_dir(self.spark)}/{table}")
        df.repartition(n, by).write.bucketBy(n, by).option("path", self.paths[-1]).option("compression", "none").saveAsTable(table)
        self.tables.append(table)
        del df
        free(self.spark)
        return self.spark.table(table)

    def __exit__(self, *_) -> None:
        _open.remove(self)
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in self.paths:
            drop(self.spark, path)
        free(self.spark)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def free(spark: SparkSession) -> None:
    """Let the driver collect its garbage, upon which Spark deletes the shuffles of plans that are gone. The first round
    lets go of what Python held of the JVM, the second of what that held in turn."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def parts(spark: SparkSession, factor: int = 4) -> int:
    """Number of hash parts that blobs are dealt to; follows the configured shuffle width."""
    return max(64, factor * int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- chunks of rows

def as_binary(col: pa.Array) -> pa.Array:
    """A string column as bytes, null as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if pa.types.is_null(col.type):
        col = col.cast(pa.binary())
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary()).cast(pa.binary())
    return pc.fill_null(col, b"")


#: What a worker remembers from task to task: the operator it belongs to, and how to forget it.
_memory: list = [None, None]


def remember(owner: str, forget) -> None:
    _memory[:] = owner, forget


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``size`` bytes of ``column``; a longer row stands alone.
    Small batches are joined, so that a partition gives as few chunks as its bytes need. What the worker
    remembers for another operator is dropped first; at the end, freed memory goes back to the system."""
    if _memory[0] not in (None, owner):
        _memory[1]()
        _memory[:] = None, None
    yield from _chunks(batches, column, size)
    give_back()


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no glibc
        pass


def tidy(table: pa.Table) -> pa.Table:
    """The table, after what a large group took has gone back to the system."""
    if table.nbytes > 1 << 18:
        give_back()
    return table


def _chunks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    have = 0

    def flush():
        nonlocal held, have
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            held, have = [], 0
            yield from table.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(length):
            if have + total + n > size and (have or total):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield from flush()
                start, total = i, 0
            total += int(n)
        held.append(batch.slice(start))
        have += total
    yield from flush()


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary array end to end, and the offsets of its rows."""
    col = as_binary(col)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(col) else np.empty(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)


# ---------------------------------------------------------------- hashes

def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> U64(30))) * MIX1
    h = (h ^ (h >> U64(27))) * MIX2
    return h ^ (h >> U64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair of hashes."""
    return mix(a * GOLD + (b ^ (b >> U64(29))) + MIX2)


def eights(data: np.ndarray) -> np.ndarray:
    """Of each byte, it and the seven after it as one number (zeros past the end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data), "<u8", padded, 0, (1,)).copy()


class Words:
    """Words of a run of rows: ``hashes`` of all words end to end (with wide, ``others`` too, together 128 bits),
    ``starts`` of each row among them."""

    def __init__(self, texts: pa.Array, lower: bool = False, wide: bool = False):
        col = as_binary(texts).cast(pa.string()) if not lower else pc.ascii_lower(as_binary(texts).cast(pa.string()))
        lists = pc.ascii_split_whitespace(col)
        flat = lists.values if lists.offset == 0 else lists.flatten()
        at = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
        at = at - at[0]
        real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        if wide:
            of_word, of_word2 = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), np.uint64).reshape(-1, 2).T
        else:
            of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
        codes = coded.indices.to_numpy(zero_copy_only=False)[real]
        self.codes, self.dictionary = codes, coded.dictionary
        self.hashes = of_word[codes] if len(codes) else np.empty(0, np.uint64)
        if wide:
            self.others = of_word2[codes] if len(codes) else self.hashes
        before = np.concatenate(([0], np.cumsum(real)))
        self.starts = before[at]
        self.counts = np.diff(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def ends(self) -> np.ndarray:
        """The end, among all words, of each word's row."""
        return np.repeat(self.starts[1:], self.counts)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` items, by doubling: a run is named by the names of its two halves
    (or of two overlapping runs). The result has the length of ``h``; the last ``k`` - 1 are meaningless."""
    names, size = h, 1
    pad = lambda x, s: np.concatenate((x[s:], np.zeros(min(s, len(x)), dtype=x.dtype)))
    while size < k:
        step = min(size, k - size)
        names = pair(names, pad(names, step))
        size += step
    return names


def sliding(x: np.ndarray, w: int, f, fill) -> np.ndarray:
    """f over x[i : i + w] for each i, by doubling; past the end ``fill`` is read."""
    out, size = x, 1
    while size < w:
        step = min(size, w - size)
        out = f(out, np.concatenate((out[step:], np.full(min(step, len(out)), fill, dtype=x.dtype))))
        size += step
    return out


# ---------------------------------------------------------------- packed integers

def pack(a: np.ndarray) -> bytes:
    """Non-negative or signed 64-bit integers as bytes: a base and the narrowest unsigned type for the rest."""
    a = np.asarray(a, dtype=np.int64)
    base = int(a.min()) if len(a) else 0
    top = (int(a.max()) - base) if len(a) else 0
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + base.to_bytes(8, "little", signed=True) + (a - base).astype(f"<u{size}").tobytes()


def unpack(b: bytes) -> np.ndarray:
    size, base = b[0], int.from_bytes(b[1:9], "little", signed=True)
    return np.frombuffer(b, dtype=f"<u{size}", offset=9).astype(np.int64) + base


def unpack_all(blobs) -> np.ndarray:
    found = [unpack(b) for b in blobs]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def spread(h: np.ndarray, n: int) -> np.ndarray:
    """The part, of ``n``, of each hash."""
    return ((h >> U64(33)) % U64(n)).astype(np.int64)


def by_part(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of each part that has any, in their order."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), order[cuts[p] : cuts[p + 1]]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys, and the start of each run of equal keys in it (with the end last)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return order, np.concatenate((cut, [len(k)]))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def record(schema: pa.Schema, **cols) -> pa.RecordBatch:
    """A batch of ``schema``; columns that aren't given are null."""
    n = max(len(v) for v in cols.values())
    of = lambda f, v: v if isinstance(v, pa.Array) and v.type == f.type else pa.array(v, type=f.type)
    return pa.RecordBatch.from_arrays([of(f, cols[f.name]) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and nothing else: extra columns, whatever their names (TEXT beside text), are of no concern."""
    names = df.columns
    return df.toDF(*(f"c{i}" for i in range(len(names)))).select(*(F.col(f"c{names.index(c)}").alias(c) for c in columns))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file where it is installed (never copied here)."""
    import public_tokenizers

    return public_tokenizers.path(name)
