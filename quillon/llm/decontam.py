"""Benchmark decontamination by the q-gram lemma.

A segment of m bytes that occurs in a text with at most k edits shares at least m + 1 - q (k + 1) of its
q-grams with the place, all on diagonals (text place less segment place) at most k apart. Shared q-grams are
counted in diagonal bands that overlap by k, so that one band holds all of an occurrence; bands with enough
are aligned in full. Items are cut into segments side by side and, so that a part quoted from anywhere holds
a whole one, into windows of ``WINDOW`` bytes every ``STRIDE``: a part quoted word for word is sure to be found
from WINDOW + STRIDE - 1 levelled bytes (63) on. What is found is carried on to both sides as far as text and
item agree, so all of such a part is reported and cut; a segment that fits with edits may take a few bytes beside
the part along. Letters A-Z and runs of white space are levelled first; spans refer to the bytes of the text as it is.

Items are read in blocks of bounded size, each indexed and sent to the tasks; some blocks make one pass over the
documents, which are never shuffled. All blocks look at the text as it is: spans are cut once, at the end, so results
don't depend on where blocks end.

Defined cases: null or empty texts and items match nothing; items of fewer than ``SHORT`` levelled bytes must occur
exactly, and those of fewer than q as whole words; equal rows each get their matches; a document without a doc_id keeps
it null; a very long text is handled by itself; empty tables give no row; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillon.llm import align
from quillon.llm import common as C

U64 = np.uint64
Q, SEGMENT, RATE, BAND, SHORT = 8, 96, 0.08, 16, 32
WINDOW, STRIDE = 48, 16
#: Bytes that a match may be carried on by to each side, and what a byte that differs costs (one that agrees gives 1).
REACH, DIFFERS = 64, 4
#: Characters of items of a block, and blocks of a pass.
BLOCK, PASS = 1 << 18, 4
#: Bytes of text, and hits, handled at once.
CHUNK, HITS = 2 << 20, 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9:14] = 32


def level(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levelled bytes of rows end to end, the starts of rows, and where each byte was."""
    low = LOWER[data]
    space = low == 32
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[at[:-1][at[:-1] < len(data)]] = True
    keep = ~(space & before)
    upto = np.concatenate(([0], np.cumsum(keep)))
    return low[keep], upto[at], np.flatnonzero(keep)


@dataclass
class Index:
    """Segments of items and the places of their q-grams."""

    item: np.ndarray
    of_item: np.ndarray
    segments: np.ndarray
    #: Items end to end, levelled; where the item of each segment begins and ends in them, and the segment begins.
    whole: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    budget: np.ndarray
    grams: np.ndarray
    at: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    #: Items of fewer than q bytes: by length, their bytes as numbers in order, and the segment of each.
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]], rate: float = RATE) -> Index:
        pieces, item, whole, place, total = [], [], [], [], 0
        for no, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            low = level(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if not low:
                continue
            cuts = list(range(0, len(low), SEGMENT))
            if len(cuts) > 1 and len(low) - cuts[-1] < SEGMENT // 2:
                cuts.pop()
            spans = set(zip(cuts, [*cuts[1:], len(low)], strict=True))
            if len(low) > WINDOW:
                spans |= {(a, a + WINDOW) for a in [*range(0, len(low) - WINDOW, STRIDE), len(low) - WINDOW]}
            for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
                pieces.append(low[a:b])
                item.append(no)
                place.append((total, total + len(low), total + a))
            whole.append(np.frombuffer(low, np.uint8))
            total += len(low)
        head, tail, begin = np.array(place, np.int64).reshape(-1, 3).T
        whole = np.concatenate([*whole, np.zeros(0, np.uint8)])
        size = np.array([len(p) for p in pieces], np.int64)
        budget = np.where(size < SHORT, 0, np.floor(size * rate)).astype(np.int64)
        segments = np.zeros((len(pieces), int(size.max()) if len(pieces) else 0), np.uint8)
        for i, p in enumerate(pieces):
            segments[i, : len(p)] = np.frombuffer(p, np.uint8)
        gram, seg, place = [], [], []
        for i, p in enumerate(pieces):
            g = C.eights(np.frombuffer(p, np.uint8))[: max(0, len(p) - Q + 1)]
            gram.append(g), seg.append(np.full(len(g), i)), place.append(np.arange(len(g)))
        gram, seg, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (gram, seg, place))
        gram = gram.astype(np.uint64)
        order, cut = C.grouped(gram)
        seen = np.zeros(1 << 20, bool)
        seen[bucket(gram)] = True
        short = {}
        for n in set(size[size < Q].tolist()):
            own = np.flatnonzero(size == n)
            code = C.eights(segments[own, :n].reshape(-1))[::n] & low_bytes(n)
            by = np.argsort(code, kind="stable")
            short[n] = code[by], own[by]
        return cls(np.array(item, np.int64), np.array([i for i, _ in items], object), segments, whole, head, tail, begin, size, budget, gram[order[cut[:-1]]], cut, seg[order], place[order], seen, short)


def low_bytes(n: int) -> np.uint64:
    return U64((1 << 8 * n) - 1)


def words_found(index: Index, low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Occurrences of items of fewer than q bytes: whole words, letter for letter."""
    out = [np.empty((0, 5), np.int64)]
    inner = (low >= 128) | np.isin(low, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
    gram = C.eights(low) if index.short else None
    for n, (code, seg) in index.short.items():
        name = gram & low_bytes(n)
        at = np.flatnonzero(np.isin(name, code))
        row = np.searchsorted(starts, at, side="right") - 1
        ok = at + n <= starts[row + 1]
        ok &= (at == starts[row]) | ~inner[at - 1]
        ok &= (at + n == starts[row + 1]) | ~inner[np.minimum(at + n, len(low) - 1)]
        at, row = at[ok], row[ok]
        first, last = (np.searchsorted(code, name[at], side=s) for s in ("left", "right"))
        many = last - first
        of = seg[C.ragged(first, many)]
        at, row = np.repeat(at, many), np.repeat(row, many)
        out.append(np.stack((row, of, np.zeros(len(of), np.int64), at, at + n), axis=1))
    return np.concatenate(out)


def bucket(gram: np.ndarray) -> np.ndarray:
    return ((gram * C.GOLD) >> U64(44)).astype(np.int64)


def regions(index: Index, low: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, segment and first diagonal of each band with enough shared q-grams."""
    none = np.empty(0, np.int64)
    if not len(index.grams) or len(low) < Q:
        return none, none, none
    gram = C.eights(low)
    p = np.flatnonzero(index.seen[bucket(gram)])
    row = np.searchsorted(starts, p, side="right") - 1
    p, row = (x[p + Q <= starts[row + 1]] for x in (p, row))
    g = np.searchsorted(index.grams, gram[p])
    g[g == len(index.grams)] = 0
    real = index.grams[g] == gram[p]
    p, row, g = p[real], row[real], g[real]
    many = index.at[g + 1] - index.at[g]
    n = len(index.size)
    upto = np.cumsum(many)
    cuts = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(HITS, upto[-1] if len(upto) else 0, HITS)), [len(p)])))
    keys, rows, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # a bounded number of hits at a time
        at = C.ragged(index.at[g[a:b]], many[a:b])
        seg, diagonal = index.segment[at], np.repeat(p[a:b], many[a:b]) - index.place[at]
        of = np.repeat(row[a:b], many[a:b])
        band = diagonal // BAND
        also = diagonal - band * BAND < index.budget[seg]
        key = np.concatenate(((band + (1 << 20)) * n + seg, (band[also] - 1 + (1 << 20)) * n + seg[also]))
        key, first, count = np.unique(key, return_index=True, return_counts=True)
        keys.append(key), rows.append(np.concatenate((of, of[also]))[first]), counts.append(count)
    key, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    row, count = np.concatenate(rows), np.bincount(inverse, np.concatenate(counts), len(key))
    # a band may reach over the end of a row: the rows of its first and last place are tried too
    enough = count >= index.size[key % n] + 1 - Q * (index.budget[key % n] + 1)
    key, first = key[enough], first[enough]
    seg, band = key % n, key // n - (1 << 20)
    last = np.searchsorted(starts, np.minimum(band * BAND + BAND + index.size[seg], starts[-1] - 1), side="right") - 1
    head = np.searchsorted(starts, np.clip(band * BAND, 0, starts[-1] - 1), side="right") - 1
    row = np.concatenate((row[first], head, last))
    found = np.unique(np.stack((row, np.tile(seg, 3), np.tile(band, 3)), axis=1), axis=0)
    return found[:, 0], found[:, 1], found[:, 2] * BAND


def carried(index: Index, low: np.ndarray, at: np.ndarray, text_end: np.ndarray, place: np.ndarray, item_end: np.ndarray, way: int) -> np.ndarray:
    """How many bytes from these places on, rightward (way 1) or leftward (-1), text and item agree best."""
    if not len(at):
        return np.empty(0, np.int64)
    j = np.arange(REACH) * way
    t, i = at[:, None] + j, place[:, None] + j
    inside = (t - text_end[:, None]) * way < 0
    inside &= (i - item_end[:, None]) * way < 0
    same = low[np.clip(t, 0, len(low) - 1)] == index.whole[np.clip(i, 0, len(index.whole) - 1)]
    score = np.cumsum(np.where(inside, np.where(same, 1, -DIFFERS), -DIFFERS * REACH), axis=1)
    return np.where(score.max(axis=1) > 0, score.argmax(axis=1) + 1, 0)


def occurrences(index: Index, low: np.ndarray, starts: np.ndarray, step: int = 4096):
    """Verified occurrences: row, segment, edits, first and last levelled place (end excluded), carried on to both sides."""
    row, seg, diagonal = regions(index, low, starts)
    out = [words_found(index, low, starts)]
    if not len(row):
        return out[0]
    by_size = np.lexsort((index.size[seg], index.budget[seg]))
    row, seg, diagonal = row[by_size], seg[by_size], diagonal[by_size]
    change = np.flatnonzero(np.diff(index.budget[seg])) + 1  # the width of a band follows its own budget only
    cuts = np.union1d(np.arange(0, len(row), step), change).tolist()
    for i, j in zip(cuts, [*cuts[1:], len(row)], strict=True):
        r, s = row[i:j], seg[i:j]
        most = int(index.budget[s[0]])
        width, d = BAND + 3 * most + 1, diagonal[i:j] - most
        longest = int(index.size[s].max())
        at = d[:, None] + np.arange(longest + width)
        inside = (at >= starts[r][:, None]) & (at < starts[r + 1][:, None])
        text = np.where(inside, low[np.clip(at, 0, len(low) - 1)], 0)
        cost, first, last = align.edits(index.segments[s, :longest], index.size[s], text, width)
        good = cost <= index.budget[s]
        first, last = np.maximum(d + first, starts[r]), np.minimum(d + last, starts[r + 1])
        good &= last > first
        r, s, cost, first, last = (x[good] for x in (r, s, cost, first, last))
        first = first - carried(index, low, first - 1, starts[r] - 1, index.begin[s] - 1, index.head[s] - 1, -1)
        last = last + carried(index, low, last, starts[r + 1], index.begin[s] + index.size[s], index.tail[s], 1)
        out.append(np.stack((r, s, cost, first, last), axis=1))
    return np.concatenate(out)


def apart(index: Index, new: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Of segments in order of place, by item of a row (new where one begins), those that don't overlap one chosen before."""
    chosen, end = np.zeros(len(seg), bool), 0
    for i, (n, a, b) in enumerate(zip(new.tolist(), index.begin[seg].tolist(), (index.begin[seg] + index.size[seg]).tolist(), strict=True)):
        if n or a >= end:
            chosen[i], end = True, b
    return chosen


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_segments", pa.int64()), ("matched_segments", pa.int64()), ("edits", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])
OUT_DDL = "doc_id long, item_id long, n_segments long, matched_segments long, edits long, start_byte long, end_byte long"


def find(batches, indexes: list[Index]):
    for batch in C.chunks(batches, size=CHUNK):
        data, at = C.raw(batch.column("text"))
        low, starts, where = level(data, at)
        for index in indexes:
            hits = occurrences(index, low, starts)
            if len(hits):
                yield reported(batch, index, hits, where, at)


def reported(batch: pa.RecordBatch, index: Index, hits: np.ndarray, where: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """A row for each item in a text."""
    of_item = np.bincount(index.item, minlength=len(index.of_item))
    row, seg, cost = hits[:, 0], hits[:, 1], hits[:, 2]
    begin, end = where[hits[:, 3]] - at[row], where[hits[:, 4] - 1] + 1 - at[row]
    item = index.item[seg]
    order = np.lexsort((cost, seg, item, row))
    row, seg, cost, begin, end, item = (x[order] for x in (row, seg, cost, begin, end, item))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    once = new.copy()
    once[1:] |= seg[1:] != seg[:-1]
    cut = np.flatnonzero(new)
    return C.record(OUT, doc_id=batch.column("doc_id").take(pa.array(row[cut])), item_id=index.of_item[item[cut]].tolist(), n_segments=of_item[item[cut]], matched_segments=np.add.reduceat(once.astype(np.int64), cut), edits=np.add.reduceat(np.where(apart(index, new, seg), cost, 0), cut), start_byte=np.minimum.reduceat(begin, cut), end_byte=np.maximum.reduceat(end, cut))


def blocks(items: DataFrame, size: int = BLOCK) -> Iterator[Index]:
    held, have = [], 0
    for r in C.only(items, "item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        have += len(r["text"] or "")
        if have >= size:
            yield Index.of(held)
            held, have = [], 0
    if held:
        yield Index.of(held)


def passes(items: DataFrame, size: int, most: int = PASS) -> Iterator[list[Index]]:
    """Blocks that go over the documents together."""
    found = blocks(items, size)
    while some := list(islice(found, most)):
        yield some


def leaks(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id) of each item that occurs in a document, with how many of its segments and windows do, the
    edits in those of them that lie side by side, and the bytes from the first to the last."""
    docs = C.only(docs, "doc_id", "text")
    found = docs.sparkSession.createDataFrame([], OUT_DDL)
    for some in passes(items, block):
        found = found.unionByName(docs.mapInArrow(lambda b, some=some: find(b, some), OUT_DDL))
    return found


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these bytes, widened to whole characters."""
    out, at = [], 0
    for a, b in sorted(spans):
        while a > 0 and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        out.append(text[at : max(a, at)])
        at = max(at, b)
    return b"".join([*out, text[at:]])


def mark(batches, indexes: list[Index], last: bool):
    """Rows with the spans found so far in their last column; after the last pass, rows without these spans."""
    for batch in C.chunks(batches, size=CHUNK):
        data, at = C.raw(batch.column("text"))
        low, starts, where = level(data, at)
        own = batch.schema.get_field_index("text")
        spans = [list(map(tuple, np.frombuffer(b or b"", "<i8").reshape(-1, 2).tolist())) for b in batch.column(batch.num_columns - 1).to_pylist()]
        for index in indexes:
            for row, _, _, a, b in occurrences(index, low, starts).tolist():
                spans[row].append((int(where[a] - at[row]), int(where[b - 1] + 1 - at[row])))
        if not last:
            kept = pa.array([np.array(x, "<i8").tobytes() if x else None for x in spans], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], kept], schema=batch.schema)
            continue
        some = [i for i, x in enumerate(spans) if x]
        batch = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
        if some:
            texts = batch.column("text").to_pylist()
            for i in some:
                texts[i] = cut_spans(texts[i].encode(), spans[i]).decode()
            kept = pa.array([not x or bool(t.strip()) for x, t in zip(spans, texts, strict=True)])
            batch = batch.set_column(own, batch.schema.field(own), pa.array(texts, batch.schema.field(own).type)).filter(kept)
        yield batch


def decontaminate(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with all occurrences cut from their texts; a document of which nothing is left goes. Spans are sought in
    the texts as they are and cut once. All columns stay as they are."""
    schema, spans = docs.schema, StructType([*docs.schema, StructField(f"spans-{uuid.uuid4().hex}", BinaryType())])
    groups = list(passes(items, block))
    if not groups:
        return docs
    out = docs.select("*", F.lit(None).cast("binary").alias(spans[-1].name))
    for i, some in enumerate(groups):
        last = i == len(groups) - 1
        out = out.mapInArrow(lambda b, some=some, last=last: mark(b, some, last), schema if last else spans)
        if i % 2 and not last:  # workers of a pass go before the next ones come
            out = C.save(out, "marked")
    return out
