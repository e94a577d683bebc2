"""Removal of passages that repeat across a corpus, by doubling of names that Spark sorts.

A *window* is ``threshold`` consecutive units (words or bytes) of one text. All windows of equal content have to
meet, but only few places of a text have to travel. Of the runs of ``start`` units in a window the one of least
hash, the leftmost of equals, is its *anchor*; equal windows have equal anchors at equal places. Levels:

1. *Anchors.* Spark sorts (name of the anchor's run, chunk) and drops names of one chunk that stand there once.
2. *Stretches.* Consecutive windows with one anchor are a stretch. Of those whose anchor is left, Spark sorts the
   pair (name of the first window, name of the last) under the anchor's name: of equal stretches all but the first
   are removed. If all stretches of an anchor are equal, all its windows are decided.
3. *Halves.* Of the others, Spark sorts the anchor's run grown half way to a window, once to the left and once to the
   right: every window of the stretch holds one of these. What is unique goes.
4. *Windows.* Of what is left, Spark sorts the windows by themselves (two names, each of the whole window).

Each level sees only what was not unique at the one before, under a longer name. The names that decide (levels 2 and 4)
have 128 bits; the others only nominate. A chunk sends one row for a name however often it stands there, so a passage in
a third of all texts sends a row for each chunk.

Texts are dealt once: chunks of whole documents, compressed, in a table bucketed by chunk, with which each level's
verdicts are joined in place. Tables of a level go when the next one is written.

Two uses differ in what counts as earlier: ``across`` texts only (a smaller doc_id; bytes) or any earlier place
(smaller doc_id, or the same doc_id and an earlier start; words).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import common as C

U64 = np.uint64
LAST = np.iinfo(np.int64).max  # stands for a doc_id that is null: such documents come last
#: Seeds of the two names of a window, and an anchor that is none.
SEEDS, NONE = (C.MIX1, C.MIX2), np.iinfo(np.uint32).max


@dataclass(frozen=True)
class Rule:
    unit: str  # "word" or "byte"
    threshold: int
    start: int
    across: bool  # only repeats in texts of another doc_id count

    @property
    def places(self) -> int:
        """Runs of ``start`` units in a window."""
        return self.threshold - self.start + 1

    @property
    def chunk(self) -> int:
        return C.CHUNK_BYTES if self.unit == "word" else 3 << 19


def squeeze(a: np.ndarray) -> bytes:
    """Integers, in an order in which neighbours are close, in few bytes."""
    a = np.asarray(a, np.int64)
    if not len(a):
        return b""
    return zstandard.compress(C.pack(np.diff(a, prepend=a[:1])) + a[:1].tobytes(), 1)


def swell(blobs) -> list[np.ndarray]:
    out = []
    for b in filter(None, blobs):
        plain = zstandard.decompress(b)
        first = np.frombuffer(plain[-8:], np.int64)
        out.append(np.cumsum(C.unpack(plain[:-8])) + first)
    return out or [np.empty(0, np.int64)]


# ---------------------------------------------------------------- chunks

def packed(batches, rule: Rule):
    """Chunks of whole rows, each one compressed image."""
    task = TaskContext.get()
    chunk = (task.partitionId() if task else 0) << 32
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in C.chunks(batches, size=rule.chunk):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()])], names=["chunk", "image"])
        chunk += 1


def opened(batches, *columns: str) -> Iterator[tuple[int, pa.RecordBatch, object]]:
    """Chunk, its rows, and what the column (or columns) say of it."""
    for batch in batches:
        for i in range(batch.num_rows):
            with pa.ipc.open_stream(batch.column("image")[i].as_buffer()) as rows:
                said = [batch.column(c)[i] for c in columns]
                yield batch.column("chunk")[i].as_py(), rows.read_next_batch(), said[0] if len(said) == 1 else said
            C.give_back()


def listed(value, kind) -> np.ndarray:
    """A list of the join as an array; none of a null."""
    return value.values.to_numpy(zero_copy_only=False).astype(kind) if value.is_valid else np.empty(0, kind)


class Units:
    """Units of a chunk's texts, end to end."""

    def __init__(self, batch: pa.RecordBatch, rule: Rule):
        self.rule = rule
        if rule.unit == "word":
            words = C.Words(batch.column("text"), wide=True)
            self.starts, self.unit, self.step = words.starts, (words.hashes, words.others), 1
        else:
            data, self.starts = C.raw(batch.column("text"))
            eight = C.eights(data)
            self.unit, self.step = (eight, eight), 8
        self.n = int(self.starts[-1])
        self.docs = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)

    def offsets(self, size: int) -> list[int]:
        """Where units start that together cover a run."""
        own = list(range(0, size - self.step + 1, self.step))
        return own if own[-1] + self.step == size else [*own, size - self.step]

    def names(self, at: np.ndarray, size: int, which: int) -> np.ndarray:
        """Names of the runs of ``size`` units at these places."""
        seed, unit = SEEDS[which], self.unit[which]
        name = np.full(len(at), seed, np.uint64)
        for o in self.offsets(size):
            name = C.mix((name ^ unit[at + o]) * C.GOLD + seed)
        return name

    def anchors(self) -> np.ndarray:
        """Of each place where a window starts, the place of its anchor; NONE of others."""
        rule, n = self.rule, self.n
        mixed = self.unit[0] * C.MIX1
        mixed ^= mixed >> U64(32)
        order = mixed.copy()
        for i, o in enumerate(self.offsets(rule.start)[1:]):
            if o < n:  # all units together may be fewer than a run
                order[: n - o] += mixed[o:] * U64(2 * i + 3)
        order *= C.GOLD
        order &= U64(0xFFFFFFFF00000000)
        order |= np.arange(n, dtype=np.uint64)
        size = 1
        while size < rule.places and size < n:
            step = min(size, rule.places - size, n)
            order[: n - step] = np.minimum(order[: n - step], order[step:])
            size += step
        found = order.astype(np.uint32)
        counts = np.diff(self.starts)
        cut = np.minimum(counts, rule.threshold - 1)
        found[C.ragged(self.starts[1:] - cut, cut)] = NONE
        return found

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first place and windows of each stretch."""
        none = np.empty(0, np.int64)
        if not self.n:
            return none, none, none
        found = self.anchors()
        begin = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        n, anchor = np.diff(np.append(begin, self.n)), found[begin]
        real = anchor != NONE
        return anchor[real].astype(np.int64), begin[real], n[real]

    def rows(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


# ---------------------------------------------------------------- levels

def nominate(batches, rule: Rule):
    """Level 1: the names of a chunk's anchors."""
    for chunk, batch, _ in opened(batches):
        units = Units(batch, rule)
        yield names_of(chunk, units.names(units.stretches()[0], rule.start, 0))


def names_of(chunk: int, names: np.ndarray) -> pa.RecordBatch:
    name = np.unique(names).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.full(len(name), chunk))], names=["name", "chunk"])


def repeated(names: DataFrame) -> DataFrame:
    """By chunk, the names that stand in another chunk too."""
    near = Window.partitionBy("name").orderBy("chunk")
    twice = names.select("name", "chunk", F.lag("chunk").over(near).alias("before"), F.lead("chunk").over(near).alias("after")).where("before IS NOT NULL OR after IS NOT NULL")
    return twice.groupBy("chunk").agg(F.collect_list("name").alias("hits"))


def not_unique(units: Units, name: np.ndarray, place: np.ndarray, hits) -> np.ndarray:
    """Which of these names repeat: in other chunks (hits) or in this one."""
    order, cut = C.grouped(name)
    many = np.diff(cut) > 1
    if units.rule.across and len(order):
        doc = units.docs[units.rows(place)][order]
        many = np.minimum.reduceat(doc, cut[:-1]) != np.maximum.reduceat(doc, cut[:-1])
    left = np.empty(len(name), bool)
    left[order] = np.repeat(many, np.diff(cut))
    return left | np.isin(name, listed(hits, np.int64).view(np.uint64))


NAMES_DDL = "name long, chunk long"
SENT = pa.schema([("key", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("chunk", pa.int64()), ("run", pa.int64()), ("more", pa.binary())])
SENT_DDL = "key long, one long, two long, doc long, pos long, chunk long, run long, more binary"


def sent(units: Units, chunk: int, key: np.ndarray, one: np.ndarray, two: np.ndarray, place: np.ndarray, n: np.ndarray, offset: np.ndarray):
    """One row for each name in the chunk: its first place, as a run of n windows, with any others that are just as
    early in ``more``; and a row, of run -1, for all runs that repeat one of the chunk."""
    rule, row = units.rule, units.rows(place)
    doc, pos = units.docs[row], place - units.starts[row] if not rule.across else np.zeros(len(row), np.int64)  # across, only documents count
    run = as_run(place, n, offset)
    order = np.lexsort((run, pos, doc, two, one))
    one, two, key, doc, pos, run = (x[order] for x in (one, two, key, doc, pos, run))
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    head = np.flatnonzero(new)
    of = head[np.cumsum(new) - 1]
    gone = doc > doc[of] if rule.across else (doc > doc[of]) | (pos > pos[of])
    also = ~gone & ~new
    more: list[bytes | None] = [None] * len(head)
    if also.any():
        own = np.cumsum(new)[also] - 1
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        for g, some in zip(own[cut].tolist(), np.split(run[also], cut[1:]), strict=True):
            more[g] = squeeze(np.sort(some))
    if len(head):
        by = np.argsort(run[head], kind="stable")  # neighbours are alike, which compresses
        head, more = head[by], [more[i] for i in by.tolist()] if also.any() else more
        signed = lambda x: x[head].view(np.int64)
        yield C.record(SENT, key=signed(key), one=signed(one), two=signed(two), doc=doc[head], pos=pos[head], chunk=np.full(len(head), chunk), run=run[head], more=more)
    if gone.any():
        yield C.record(SENT, key=[chunk], one=[chunk], two=[-1], doc=[LAST], pos=[0], chunk=[chunk], run=[-1], more=[squeeze(np.sort(run[gone]))])


def as_run(place: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A run of windows, and where in the first of them the anchor stands, as one number (both are under 64)."""
    return place << 12 | n << 6 | offset


def of_run(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return run >> 12, run >> 6 & 63, run & 63


def stretch(batches, rule: Rule):
    """Level 2: stretches whose anchor stands in other chunks (hits), or in the chunk again."""
    for chunk, batch, hits in opened(batches, "hits"):
        units = Units(batch, rule)
        anchor, lo, n = units.stretches()
        key = units.names(anchor, rule.start, 0)
        left = not_unique(units, key, anchor, hits)
        anchor, lo, n, key = (x[left] for x in (anchor, lo, n, key))
        if len(lo):
            shape = (n + ((anchor - lo) << 32)).astype(np.uint64)
            one, two = (C.pair(C.pair(units.names(lo, rule.threshold, w), units.names(lo + n - 1, rule.threshold, w)), shape) for w in (0, 1))
            yield from sent(units, chunk, key, one, two, lo, n, anchor - lo)


def grown(units: Units, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs: for each half that a window of it holds, the run's index, whether it is the left one, its name and place."""
    rule = units.rule
    half = (rule.threshold - rule.start) // 2
    lo, n, offset = of_run(runs)
    anchor, left, right = lo + offset, np.flatnonzero(offset >= half), np.flatnonzero(offset - n + 1 <= half)
    size = rule.start + half, rule.threshold - half
    name = np.concatenate((units.names(anchor[left] - half, size[0], 0), units.names(anchor[right], size[1], 0) ^ U64(1)))
    return np.concatenate((left, right)), np.repeat([True, False], [len(left), len(right)]), name, np.concatenate((anchor[left], anchor[right]))


def halves(batches, rule: Rule):
    """Level 3: names of the halves of open stretches."""
    for chunk, batch, runs in opened(batches, "runs"):
        units = Units(batch, rule)
        yield names_of(chunk, grown(units, listed(runs, np.int64))[2])


def single(batches, rule: Rule):
    """Level 4: the windows of open stretches whose halves repeat."""
    half = (rule.threshold - rule.start) // 2
    for chunk, batch, (runs, hits) in opened(batches, "runs", "hits"):
        units, runs = Units(batch, rule), listed(runs, np.int64)
        index, is_left, name, place = grown(units, runs)
        again = not_unique(units, name, place, hits)
        ok = np.zeros((2, len(runs)), bool)
        ok[is_left.astype(np.int64), index] = again
        lo, n, offset = of_run(runs)
        at, of = C.ragged(lo, n), np.repeat(np.arange(len(runs)), n)
        into = (lo + offset)[of] - at  # from a window's start to its anchor
        at = at[((into < half) | ok[1, of]) & ((into > half) | ok[0, of])]
        one, two = (units.names(at, rule.threshold, w) for w in (0, 1))
        yield from sent(units, chunk, np.zeros(len(at), np.uint64), one, two, at, np.ones(len(at), np.int64), np.zeros(len(at), np.int64))


def judged(rows: DataFrame, rule: Rule, *by: str) -> DataFrame:
    """Sorted by name and place: the first row of each name, and whether a row repeats an earlier one."""
    same = Window.partitionBy(*by, "one", "two").orderBy("doc", "pos", "chunk")
    place = F.col("doc") if rule.across else F.struct("doc", "pos")
    ranked = rows.select(*by, "chunk", "run", "more", (F.row_number().over(same) == 1).alias("head"), F.first(place).over(same).alias("first"), place.alias("own"))
    return ranked.select(*by, "chunk", "run", "more", "head", ((F.col("run") < 0) | (F.col("own") > F.col("first"))).alias("gone"))


def runs_of(rows: DataFrame) -> DataFrame:
    """All runs of rows, by chunk."""
    listed_ = rows.groupBy("chunk").agg(F.collect_list(F.when(F.col("run") >= 0, F.col("run"))).alias("runs"), F.collect_list("more").alias("more"))
    return listed_.select("chunk", "runs", "more").mapInArrow(together, "chunk long, runs array<long>")


def together(batches):
    kind = pa.schema([("chunk", pa.int64()), ("runs", pa.list_(pa.int64()))])
    for batch in batches:
        for i in range(batch.num_rows):
            runs = np.concatenate((listed(batch.column("runs")[i], np.int64), *swell(batch.column("more")[i].as_py())))
            yield C.record(kind, chunk=[batch.column("chunk")[i].as_py()], runs=[runs])


# ---------------------------------------------------------------- result

RESULT = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha256", pa.string())])
RESULT_DDL = "doc_id long, n_units long, n_removed long, n_spans long, sha256 string"


def removed(batches, rule: Rule) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray]]]:
    """Rows of a chunk, their bytes, and flags of the units of each that go."""
    for _, batch, runs in opened(batches, "runs"):
        texts = C.as_binary(batch.column("text")).to_pylist()
        ends = np.cumsum([len(t.split()) if rule.unit == "word" else len(t) for t in texts])
        total = int(ends[-1])
        place, n, _ = of_run(listed(runs, np.int64))
        edge = np.bincount(place, minlength=total + 1) - np.bincount(place + n + rule.threshold - 1, minlength=total + 1)
        yield batch, texts, np.split(np.cumsum(edge[:-1]) > 0, ends[:-1])


def kept_digest(text: bytes, gone: np.ndarray, rule: Rule) -> str:
    if rule.unit == "byte":
        return hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text).hexdigest()
    words = text.split()
    return hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)).hexdigest()


def digests(batches, rule: Rule):
    for batch, texts, gone in removed(batches, rule):
        spans = [int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1)) for g in gone]
        yield C.record(RESULT, doc_id=batch.column("doc_id"), n_units=[len(g) for g in gone], n_removed=[int(g.sum()) for g in gone], n_spans=spans, sha256=[kept_digest(t, g, rule) for t, g in zip(texts, gone, strict=True)])


def cut_texts(batches, rule: Rule):
    for batch, texts, gone in removed(batches, rule):
        some = np.array([bool(g.any()) for g in gone])
        left = [without(t, g, rule) for t, g in zip(texts, gone, strict=True)]
        stay = pa.array([not s or bool(t) for s, t in zip(some.tolist(), left, strict=True)])
        i = batch.schema.get_field_index("text")
        text = pa.array([t.decode() for t in left], batch.schema.field(i).type)
        text = pa.compute.if_else(batch.column(i).is_valid(), text, batch.column(i))
        yield batch.set_column(i, batch.schema.field(i), text).filter(stay)


def without(text: bytes, gone: np.ndarray, rule: Rule) -> bytes:
    """The text without the units that go; of words, with the white space before each that stays."""
    if not gone.any():
        return text
    if rule.unit == "byte":
        return np.frombuffer(text, np.uint8)[~gone].tobytes()
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    data = np.frombuffer(text, np.uint8)
    blank = space[data]
    start = ~blank & np.concatenate(([True], blank[:-1]))
    owner = np.cumsum(start) - 1  # the word that a byte belongs to; white space goes with the next word
    owner[blank] += 1
    flag = np.concatenate((gone, [False]))
    return data[~flag[owner]].tobytes().lstrip(b" \t\n\x0b\x0c\r") if gone[0] else data[~flag[owner]].tobytes()


def remove(docs: DataFrame, rule: Rule, finish, schema) -> DataFrame:
    """All levels, then ``finish`` over each chunk and its runs of removed windows; the result is written, and
    what led to it deleted."""
    spark = docs.sparkSession
    with C.Scratch(spark) as own:
        texts = own.deal(docs.mapInArrow(lambda b: packed(b, rule), "chunk long, image binary"), "chunk", "chunks")
        with_ = lambda said, how="inner": texts.join(said.hint("shuffle_merge"), "chunk", how)
        hits = own.save(repeated(texts.mapInArrow(lambda b: nominate(b, rule), NAMES_DDL)), "hits")
        stretches = own.save(judged(with_(hits, "left").mapInArrow(lambda b: stretch(b, rule), SENT_DDL), rule, "key"), "stretches")
        # read anew, so that Spark can split the rows of a key that very many stretches share
        several = own.save(stretches.where("head AND run >= 0").groupBy("key").count().where("count > 1").select("key"), "several")
        open_ = own.save(runs_of(stretches.where("NOT gone").join(several.hint("shuffle_merge"), "key", "left_semi")), "open")
        again = own.save(repeated(with_(open_).mapInArrow(lambda b: halves(b, rule), NAMES_DDL)), "halves")
        both = with_(open_).join(again.hint("shuffle_merge"), "chunk", "left")
        windows = judged(both.mapInArrow(lambda b: single(b, rule), SENT_DDL), rule).where("gone").select("chunk", "run", "more")
        gone = own.save(runs_of(stretches.where("gone").select("chunk", "run", "more").unionByName(windows)), "gone")
        return own.result(with_(gone, "left").mapInArrow(finish, schema), "cut")


#: Words: 20 in a window, whose least run of 10 is its anchor. Bytes: 50, and 24.
WORDS = Rule("word", 20, 10, False)
BYTES = Rule("byte", 50, 24, True)


def substring_dedup(docs: DataFrame, rule: Rule = WORDS) -> DataFrame:
    """Level-wise doubling over words: doc_id, n_words, n_removed, n_spans, kept_sha256.

    Defined cases: a null or empty text has no words; a text shorter than a window stays whole; rows of one doc_id
    count as one document, as do all rows without a doc_id, which come last: a window is earlier if its doc_id is
    smaller or, these being equal, if it starts at an earlier word, so equal rows get the same result; a very long
    text is a chunk of its own; an empty table gives no row; extra columns, whatever their names, are ignored."""
    found = remove(C.only(docs, "doc_id", "text"), rule, lambda b: digests(b, rule), RESULT_DDL)
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "n_spans", F.col("sha256").alias("kept_sha256"))


def suffix_dedup(docs: DataFrame, rule: Rule = BYTES) -> DataFrame:
    """Prefix doubling over bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Defined cases: a null or empty text has no bytes; a text shorter than a window stays whole; only a smaller doc_id
    counts, so rows of one doc_id don't cut one another, nor do rows without a doc_id, which come last; a cut may fall
    inside a character, so what stays is bytes; a very long text is a chunk of its own; an empty table gives no row;
    extra columns, whatever their names, are ignored."""
    found = remove(C.only(docs, "doc_id", "text"), rule, lambda b: digests(b, rule), RESULT_DDL)
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.col("sha256").alias("kept_sha256"))


def cut_repeats(docs: DataFrame, rule: Rule = WORDS) -> DataFrame:
    """``docs`` without the words that repeat earlier ones; white space before a word goes with it. A document of
    which nothing is left goes. All columns of docs stay as they are; other cases as in ``substring_dedup``."""
    return remove(docs, rule, lambda b: cut_texts(b, rule), docs.schema)
