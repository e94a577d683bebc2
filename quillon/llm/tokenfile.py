"""Token ids in binary shards, with document boundaries as Elias-Fano sequences.

A shard image is: magic, header, the ids of its documents end to end (16 bits each if the vocabulary
allows, else 32), the starts of the documents as an Elias-Fano sequence, and their doc_ids as another.
An Elias-Fano sequence keeps the low bits of each value in a packed array and the high parts in unary in
a bit vector, about 2 + log2(universe / n) bits a value; sampled positions of its ones give any value in
constant time. No table of 64-bit offsets is stored.

Documents are dealt to shards by range of doc_id and sorted, so shards in order hold ascending doc_ids.
Images are written by Spark's own writer, one row each, so that lost executors leave no broken shard and
any store that Spark writes to will do; ``export`` makes plain files of them, which ``Shard.open`` maps and seeks in.

Defined cases: a null or empty text has just the end id; documents without a doc_id come first; equal
doc_ids stay, ordered by text; a very long text is encoded by itself; an empty table gives no shard; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import mmap
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import common as C
from quillon.llm import tokens as T

MAGIC = b"QTOKENS1"
HEADER = struct.Struct("<8sQQQBxxxxxxx")  # magic, documents, of these without doc_id, ids, bytes of an id
SAMPLE = 256
SHARD_TOKENS = 4 << 20
#: Of each byte, its ones, and the place of each of them.
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)
NTH = np.argsort(1 - np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1, kind="stable")


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    HEAD = struct.Struct("<QQBxxxxxxx")  # values, universe, low bits

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.ones = n, universe, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 0
        k = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.empty(0, np.uint8)
        if k:
            bits = ((v[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.reshape(-1), bitorder="little")
        ones = (v >> np.uint64(k)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, universe, k, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u8" if n and ones[-1] >> 32 else "<u4"))

    def to_bytes(self) -> bytes:
        wide = self.ones.dtype.itemsize
        return self.HEAD.pack(self.n, self.universe, self.low_bits) + struct.pack("<QQQ", len(self.low), len(self.high), wide) + self.low.tobytes() + self.high.tobytes() + self.ones.tobytes()

    @classmethod
    def read(cls, b: bytes, at: int) -> tuple[EliasFano, int]:
        n, universe, k = cls.HEAD.unpack_from(b, at)
        n_low, n_high, wide = struct.unpack_from("<QQQ", b, at := at + cls.HEAD.size)
        low = np.frombuffer(b, np.uint8, n_low, at := at + 24)
        high = np.frombuffer(b, np.uint8, n_high, at := at + n_low)
        ones = np.frombuffer(b, f"<u{wide}", -(-n // SAMPLE), at := at + n_high)
        return cls(n, universe, k, low, high, ones), at + ones.nbytes

    def select(self, i: int) -> int:
        """Value i: from the nearest sampled one before it, at most SAMPLE ones further in the bit vector."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.ones[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (have := word.bit_count()) <= left:
            left -= have
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        if self.low_bits:
            first = i * self.low_bits
            some = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
            low = some >> (first % 8) & ((1 << self.low_bits) - 1)
        return (position - i) << self.low_bits | low

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """Values at these places, all found together: each starts at its sampled one and walks on by bytes."""
        if not len(i):
            return np.empty(0, np.int64)
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError(i)
        at = self.ones[i // SAMPLE].astype(np.int64)
        byte, word = at >> 3, self.high[at >> 3] >> (at & 7).astype(np.uint8) << (at & 7).astype(np.uint8)
        left, have = i % SAMPLE, ONES[word].astype(np.int64)
        on = np.flatnonzero(have <= left)
        while len(on):
            left[on] -= have[on]
            byte[on] += 1
            word[on] = self.high[byte[on]]
            have[on] = ONES[word[on]]
            on = on[have[on] <= left[on]]
        high = byte * 8 + NTH[word, left] - i
        if not self.low_bits:
            return high
        bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.int64)
        return high << self.low_bits | (bits << np.arange(self.low_bits)).sum(axis=1)

    def all(self) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return (high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)


def image(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard: documents in ascending doc_id order (those without one first); starts has the total last."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    wide = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    spans = (known.astype(np.uint64) - np.uint64(base % (1 << 64))) if len(known) else known.astype(np.uint64)
    return HEADER.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), len(ids), wide) + struct.pack("<q", base) + ids.astype(f"<u{wide}").tobytes() + EliasFano.of(starts).to_bytes() + EliasFano.of(spans).to_bytes()


class Shard:
    """A shard image: bytes, or a file's map in memory, of which only what is asked for is read."""

    def __init__(self, b):
        magic, self.n, self.nulls, total, wide = HEADER.unpack_from(b, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        (self.base,) = struct.unpack_from("<q", b, HEADER.size)
        self.ids = np.frombuffer(b, f"<u{wide}", total, HEADER.size + 8)
        self.starts, at = EliasFano.read(b, HEADER.size + 8 + self.ids.nbytes)
        self.spans, _ = EliasFano.read(b, at)

    @classmethod
    def open(cls, path: str) -> Shard:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @property
    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.base + int(x) for x in self.spans.all().astype(np.uint64)]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.starts.select(i) : self.starts.select(i + 1)]


SHARDS = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])


def shards(batches, tokenizer: str, end: int | None, most: int):
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 24
    docs: list = []
    counts: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def written():
        nonlocal docs, counts, ids, number
        starts = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        all_ids = np.concatenate(ids)
        out = C.record(SHARDS, shard=[number], n_docs=[len(docs)], n_tokens=[len(all_ids)], image=[image(docs, starts, all_ids)])
        docs, counts, ids, number = [], [], [], number + 1
        return out

    for batch in C.chunks(batches, size=T.CHUNK, owner="tokens"):
        some, starts = T.encode(batch.column("text"), tokenizer, end)
        docs += batch.column("doc_id").to_pylist()
        counts.append(np.diff(starts))
        ids.append(some)
        if sum(map(len, ids)) >= most:
            yield written()
    if docs:
        yield written()


def write(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int | None = T.END, most: int = SHARD_TOKENS) -> DataFrame:
    """Encode and write all documents; the table of shards (shard, n_docs, n_tokens, image), ordered by shard."""
    dealt = C.only(docs, "doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    images = dealt.mapInArrow(lambda b: shards(b, tokenizer, end, most), "shard long, n_docs long, n_tokens long, image binary")
    return C.save(images, "token-shards")


def export(table: DataFrame, folder: str) -> DataFrame:
    """Write each image of a table of shards to a binary file of its own in a folder that all executors reach by its URI;
    the table of files (shard, path, n_bytes). A file gets its name when it is whole, so a lost executor leaves no broken
    shard and a task that runs again replaces what it wrote."""

    def files(batches):
        store, base = FileSystem.from_uri(folder)
        for batch in batches:
            for number, image_ in zip(batch.column("shard").to_pylist(), batch.column("image").to_pylist(), strict=True):
                path = f"{base}/shard-{number:016x}.tokens"
                own = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(image_)
                store.move(own, path)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([path]), pa.array([len(image_)])], names=["shard", "path", "n_bytes"])

    return C.save(table.select("shard", "image").mapInArrow(files, "shard long, path string, n_bytes long"), "token-files")


ROWS = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("boundary_bits", pa.float64())])


def read_rows(batches):
    for batch in batches:
        for number, b in zip(batch.column("shard").to_pylist(), batch.column("image").to_pylist(), strict=True):
            s = Shard(b)
            starts = s.starts.select_many(np.arange(s.n + 1))
            wide = s.ids.astype("<u4")
            crc = [zlib.crc32(wide[a:e]) for a, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            bits = 8 * (len(s.starts.low) + len(s.starts.high) + s.starts.ones.nbytes) / max(s.n, 1)
            yield C.record(ROWS, shard=np.full(s.n, number), doc_id=s.doc_ids, local=starts[:-1], n_tokens=np.diff(starts), ids_crc32=crc, boundary_bits=np.full(s.n, bits))


def read(table: DataFrame) -> DataFrame:
    """Per document, from the shards: doc_id, start among all ids, n_tokens, ids_crc32, and the bits that
    its boundary takes. Starts of shards are sums over the tasks that wrote them, then over the shards of a task."""
    task = F.shiftright("shard", 24).alias("task")
    so_far = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = table.groupBy(task).agg(F.sum("n_tokens").alias("n_tokens")).select("task", so_far(Window.orderBy("task")).alias("first"))
    own = table.select("shard", task, "n_tokens").withColumn("own", so_far(Window.partitionBy("task").orderBy("shard")))
    bases = own.join(tasks, "task").select("shard", (F.col("first") + F.col("own")).alias("base"))
    rows = C.only(table, "shard", "image").mapInArrow(read_rows, "shard long, doc_id long, local long, n_tokens long, ids_crc32 long, boundary_bits double")
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "boundary_bits")
