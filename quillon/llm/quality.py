"""Quality rules by compression bands.

Each text gets base counts and, if the base rules pass, a verdict from zstandard ratios: the
ratio of the whole text must lie in a band for its length, and so must the ratio of each fixed
chunk. Text above a band repeats itself or is strewn with marks; text below one is noise. One pass, no shuffle.

Defined cases: a null text has no words (all counts 0, base_failed); an empty text likewise; a
repeated row is judged again, with the same result; a very long text is handled by itself, chunk by chunk; a document
without a doc_id keeps it null; an empty table gives no row; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quillon.llm import common as C

#: Length in bytes up to which a band holds, and the least and greatest ratio of a whole text. The greatest are 0.05 above
#: those of texts labelled clean (sf0.1), the least some 0.25 below; none of these is over 32 KB, so the last band is wide
#: and chunks judge such texts.
BANDS = ((512, 1.15, 1.90), (1024, 1.22, 2.03), (2048, 1.45, 2.20), (4096, 1.65, 2.27), (8192, 1.85, 2.39), (32768, 1.95, 2.53), (1 << 62, 2.00, 3.80))
#: Bytes of a chunk, and the least a last chunk needs to stand by itself (a shorter one joins the one before).
CHUNK, LEAST = 4096, 1024
#: Bands of chunks, by length as above.
CHUNK_BANDS = ((2048, 1.45, 2.13), (4096, 1.65, 2.31), (1 << 62, 1.65, 2.31))
MIN_WORDS, REPEAT_SHARE, LEVEL = 50, 50, 3
SYMBOLS = frozenset(b"#*$%&|<>")

OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("chunk_min", pa.float64()), ("chunk_max", pa.float64()), ("reason", pa.string())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_min double, chunk_max double, reason string"


def band(n: int, bands=BANDS) -> tuple[float, float]:
    return next((lo, hi) for most, lo, hi in bands if n <= most)


def chunked(text: bytes, chunk: int = CHUNK, least: int = LEAST) -> list[bytes]:
    """All of the text in chunks; a last one that is too short joins the one before."""
    cuts = list(range(0, len(text), chunk))
    if len(cuts) > 1 and len(text) - cuts[-1] < least:
        cuts.pop()
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def ratios(text: bytes, compress) -> tuple[float, list[tuple[int, float]]]:
    """Ratio of the whole, and length and ratio of each chunk."""
    return len(text) / len(compress(text)), [(len(p), len(p) / len(compress(p))) for p in chunked(text)]


def verdict(size: int, whole: float, chunks: list[tuple[int, float]], bands=BANDS, chunk_bands=CHUNK_BANDS) -> str:
    """Why a text goes: its whole or one of its chunks is above its band (repetitive) or below (noise); empty if it stays."""
    low, high = band(size, bands)
    if not low <= whole <= high:
        return "whole above" if whole > high else "whole below"
    for n, ratio in chunks if len(chunks) > 1 else ():
        low, high = band(n, chunk_bands)
        if not low <= ratio <= high:
            return "chunk above" if ratio > high else "chunk below"
    return ""


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    if b"\n" not in text:
        return 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.split(None, 1):
            seen.add(line)
    return n


def repeated_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each row, the words that stand in a 3-word window found twice or more in the row."""
    n = len(codes)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ok = np.zeros(n, bool)
    ok[: max(0, n - 2)] = rows[: n - 2] == rows[2:] if n > 2 else False
    at = np.flatnonzero(ok)
    a = codes.astype(np.uint64)
    top = np.uint64(int(a.max()) + 1 if n else 1)
    # exact names: pairs of codes are renumbered, then joined with the third code and the row
    _, two = np.unique(a[at] * top + a[at + 1], return_inverse=True) if len(at) else (None, np.empty(0, np.int64))
    _, three = np.unique(two.astype(np.uint64) * top + a[at + 2], return_inverse=True) if len(at) else (None, np.empty(0, np.int64))
    _, key, count = np.unique(three.astype(np.uint64) * np.uint64(len(starts)) + rows[at].astype(np.uint64), return_inverse=True, return_counts=True) if len(at) else (None, np.empty(0, np.int64), np.empty(0, np.int64))
    hit = at[count[key] > 1] if len(at) else at
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[hit + j] = True
    return np.bincount(rows[covered], minlength=len(starts) - 1)


def score(batches, bands=BANDS, chunk_bands=CHUNK_BANDS, min_words=MIN_WORDS, repeat_share=REPEAT_SHARE):
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    compress = compressor.compress
    is_symbol, is_space, is_tail = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = is_space[[32, *range(9, 14)]] = is_tail[0x80:0xC0] = True
    skip = is_space | is_tail
    for batch in C.chunks(batches, size=4 << 20):
        words = C.Words(batch.column("text"))
        data, at = C.raw(batch.column("text"))
        sums = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag[data])))[at])
        chars, symbols = sums(~skip), sums(is_symbol)
        repeats = repeated_words(words.codes, words.starts)
        failed = (words.counts < min_words) | (100 * repeats > repeat_share * words.counts)
        dup, whole, low, high, why = [], [], [], [], []
        for text, few, bad in zip(C.as_binary(batch.column("text")).to_pylist(), (words.counts < min_words).tolist(), failed.tolist(), strict=True):
            dup.append(duplicate_lines(text))
            r, each = ratios(text, compress) if text else (0.0, [(0, 0.0)])
            why.append("few words" if few else "repeated words" if bad else verdict(len(text), r, each, bands, chunk_bands))
            whole.append(r), low.append(min(x for _, x in each)), high.append(max(x for _, x in each))
        yield C.record(OUT, doc_id=batch.column("doc_id"), n_words=words.counts, word_chars=chars, n_symbols=symbols, n_dup_lines=dup, n_repeat_words=repeats, base_failed=failed, kept=[not x for x in why], ratio=whole, chunk_min=low, chunk_max=high, reason=why)


def quality(docs: DataFrame, **limits) -> DataFrame:
    """Counts, ratios, verdict and its reason (empty if kept) of each document; ``limits`` replace the module's defaults."""
    return C.only(docs, "doc_id", "text").mapInArrow(lambda batches: score(batches, **limits), DDL)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose verdict is good, as they are. The verdict comes from each row's own text, in one pass.
    Null and empty texts go, as they have no words; an empty table stays empty; extra columns stay, whatever their names."""
    schema = docs.schema

    def rows(batches):
        for batch in C.chunks(batches, size=4 << 20):
            own = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text")], names=["doc_id", "text"])
            yield batch.filter(pa.concat_arrays([b.column("kept") for b in score([own])]))

    return docs.mapInArrow(rows, schema)
