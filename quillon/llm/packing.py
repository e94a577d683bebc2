"""Best-fit packing of token pieces into sequences, after Martello and Toth's dominance reduction.

Lengths are integers up to the size of a sequence, so the instance is a histogram with one count a length,
whatever the number of documents. The reduction fixes sets that provably dominate every other set holding
the same piece (a piece that nothing fits beside; a piece with its exact complement; a piece with the
largest that fits, where no two or three others use the room better), with their multiplicity; what is left
goes by best fit, longest first. The plan is a short list of slots: of length l, those ranked from r on go
to sequences from s on, at offset o. Pieces are ranked among those of their length by counts per chunk, so
no piece is gathered anywhere and a length that most pieces share is no hot key.

Defined cases: a null or empty text is one piece holding the end id; a text that fills whole sequences has
only full pieces; equal rows are packed each; a document without a doc_id keeps it null; a very long text is encoded
by itself; an empty table gives no row; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import common as C
from quillon.llm import tokens as T

SIZE = 1024


# ---------------------------------------------------------------- the plan

class Lengths:
    """A multiset of lengths, kept sorted."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.keys = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.keys.remove(length)

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest, one copy of ``without`` aside."""
        out: list[int] = []
        for k in self.keys:
            out += [k] * min(n - len(out), self.counts[k] - (k == without))
            if len(out) == n:
                break
        return out

    def largest(self, room: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest that fits in room, copies in ``without`` aside."""
        for i in range(bisect.bisect_right(self.keys, room) - 1, -1, -1):
            k = self.keys[i]
            if self.counts[k] > without.count(k):
                return k
        return None


def dominating(left: Lengths, x: int, size: int) -> tuple[int, ...] | None:
    """A set with x that dominates all feasible sets with x, if one is known to: each of those splits into
    groups that fit within members of this one, so some best packing has it."""
    room = size - x
    best = left.largest(room, (x,))
    if best is None:
        return (x,)
    if best == room:
        return (x, best)
    small = left.smallest(3, x)
    if len(small) < 2 or small[0] + small[1] > room:
        return (x, best)
    if len(small) == 3 and sum(small) <= room:
        return None
    pairs = []  # (a, the largest b that goes with it), a >= b
    for i in range(bisect.bisect_right(left.keys, room) - 1, -1, -1):
        a = left.keys[i]
        if left.counts[a] <= (a == x):
            continue
        b = left.largest(min(a, room - a), (x, a))
        if b is not None:
            pairs.append((a, b))
    if all(a + b <= best for a, b in pairs):
        return (x, best)
    other = left.largest(min(best, room - best), (x, best))
    if other is not None and all(b <= other or a + b <= best for a, b in pairs):
        return (x, best, other)
    return None


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Sets of lengths with how many sequences are filled so, and how many of these the reduction fixed."""
    left, sets, fixed = Lengths(counts), [], 0
    again = True
    while again:
        again = False
        for x in sorted(left.keys, reverse=True):
            while x in left.counts and (found := dominating(left, x, size)):
                # as pieces go, fewer sets stay feasible, so the proof holds until a length runs out
                n = min(left.counts[k] // found.count(k) for k in set(found))
                for k in found:
                    left.take(k, n)
                sets.append((found, n))
                fixed += n
                again = again or len(found) > 1
    open_: dict[int, list[list]] = defaultdict(list)  # by room left: [set, how many]
    rooms: list[int] = []

    def put(chosen: tuple[int, ...], n: int) -> None:
        room = size - sum(chosen)
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append([chosen, n])

    for x in sorted(left.keys, reverse=True):
        n = left.counts[x]
        while n:
            i = bisect.bisect_left(rooms, x)
            room = rooms[i] if i < len(rooms) else size
            group = open_[room][-1] if i < len(rooms) else [(), n]
            each = min(room // x, n)
            bins = min(group[1], n // each)
            if group[0]:
                group[1] -= bins
                if not group[1]:
                    open_[room].pop()
                    if not open_[room]:
                        rooms.pop(i)
            put((*group[0], *[x] * each), bins)
            n -= bins * each
    sets += [(chosen, n) for groups in open_.values() for chosen, n in groups]
    return sets, fixed


def slots(sets: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Columns of slots, sorted by length and first rank: length, rank, sequence, offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for chosen, n in sets:
        at = 0
        for x in chosen:
            rows.append((x, used[x], sequence, at))
            used[x] += n
            at += x
        sequence += n
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": cols[:, 0], "rank": cols[:, 1], "sequence": cols[:, 2], "offset": cols[:, 3]}


# ---------------------------------------------------------------- pieces

PIECES = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64())])


def nth_of_length(lengths: np.ndarray) -> np.ndarray:
    """Of each item, how many of its length come before it."""
    order, cut = C.grouped(lengths)
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - np.repeat(cut[:-1], np.diff(cut))
    return out


def cut(totals: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, piece, start and length of the pieces of texts of these lengths; a first piece may be shorter."""
    n = -(-totals // size)
    row = np.repeat(np.arange(len(totals)), n)
    piece = C.ragged(np.zeros(len(totals), np.int64), n)
    first = (totals - 1) % size + 1
    start = np.where(piece > 0, first[row] + (piece - 1) * size, 0)
    return row, piece, start, np.where(piece > 0, size, first[row])


def pieces(batches, tokenizer: str, end: int, size: int, remember: int = T.REMEMBERED):
    task = TaskContext.get()
    chunk = (task.partitionId() if task else 0) << 24
    for batch in C.chunks(batches, size=T.CHUNK, owner="tokens"):
        ids, starts = T.encode(batch.column("text"), tokenizer, end, remember)
        row, piece, start, length = cut(np.diff(starts), size)
        at = starts[row] + start
        wide = ids.astype("<u4")
        crc = [zlib.crc32(wide[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        yield C.record(PIECES, chunk=np.full(len(row), chunk), doc_id=batch.column("doc_id").take(pa.array(row)), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=crc, nth=nth_of_length(length))
        chunk += 1


PLACED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def place(batches, of: dict[str, np.ndarray], most: int):
    key = of["length"] * (most + 1) + of["rank"]
    for b in batches:
        length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
        i = np.searchsorted(key, length * (most + 1) + rank, side="right") - 1
        yield C.record(PLACED, sequence_id=of["sequence"][i] + rank - of["rank"][i], offset=of["offset"][i], **{c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")})


def running(by_chunk: DataFrame) -> DataFrame:
    """(length, chunk, before) of counts (length, chunk, n): the sum over smaller chunks. First over the tasks that made
    the chunks, then within each, so a length that all chunks have needs no task that sees them all."""
    task = F.shiftright("chunk", 24).alias("task")
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    tasks = by_chunk.groupBy("length", task).agg(F.sum("n").alias("n")).select("length", "task", so_far(upto("length", "task")).alias("base"))
    own = by_chunk.withColumn("task", task).select("length", "task", "chunk", so_far(upto("length", "task", "chunk")).alias("own"))
    return own.join(tasks.hint("shuffle_merge"), ["length", "task"]).select("length", "chunk", (F.col("base") + F.col("own")).alias("before"))


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = T.END, size: int = SIZE, remember: int = T.REMEMBERED) -> DataFrame:
    """Each piece of each document with its sequence and its place there. remember: most pieces of text whose
    encodings a worker keeps, which bounds its memory."""
    cut_up = C.only(docs, "doc_id", "text").mapInArrow(lambda b: pieces(b, tokenizer, end, size, remember), "chunk long, doc_id long, piece int, start long, length long, ids_crc32 long, nth long")
    cut_up = C.save(cut_up, "pieces")
    by_chunk = C.save(cut_up.groupBy("length", "chunk").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    of, most = slots(plan(counts, size)[0]), max(counts.values(), default=0)
    ranks = running(by_chunk)
    ranked = cut_up.join(ranks.hint("shuffle_merge"), ["chunk", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lambda b: place(b, of, most), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
