"""Encoding of whole texts with a public byte-level BPE tokenizer, vectorised over chunks.

The tokenizer's first split never joins what stands on both sides of a lone space, so a text in which
no space touches another white-space character falls apart at its spaces into pieces that are encoded
alike wherever they stand. Each distinct piece of a chunk is encoded once, by the tokenizers library,
and its ids are copied to all its places; any other text, and one with the string of an added token, is
encoded as a whole.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402

from quillon.llm import common as C  # noqa: E402

END = 2
#: A space beside other white space (all that any of the libraries takes for it).
LOOSE = r" [\s\v\x1c-\x1f\x{85}\pZ]|[\s\v\x1c-\x1f\x{85}\pZ] "
#: Bytes of text encoded at once.
CHUNK = 6 << 20
_loaded: dict[str, object] = {}


def tokenizer(name: str):
    """The tokenizer as its file has it, loaded once in a worker: the string of an added token in a text is that token."""
    if name not in _loaded:
        from tokenizers import Tokenizer

        _loaded[name] = Tokenizer.from_file(C.vocabulary(name))
    return _loaded[name]


def added(tok) -> list[str]:
    """Strings of added tokens, which may join what stands beside a space."""
    return [t.content for t in tok.get_added_tokens_decoder().values()]


#: Places in a piece where the first split always cuts: round a lone line feed, and between a letter and what is no letter.
CUTS = re.compile(r"(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=[A-Za-z\u00df-\u00f6\u00f8-\u00ff])(?=[!-@\[-`{-~])")
#: Parts that may be encoded many at once, with a line feed (one id of its own) between them.
JOINED = re.compile(r" ?\S+").fullmatch
#: Most parts that a worker remembers, longest part in characters, and most ids; beyond, it starts anew. Bounds of
#: memory, without effect on results.
REMEMBERED, LONGEST, MOST_IDS = 1_150_000, 256, 1 << 23


class Memo:
    """Encodings of parts: ``index`` of each, and its ids in a growing table."""

    def __init__(self, tok):
        self.tok = tok
        (self.feed,) = tok.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table, self.at, self.size, self.used, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append encodings; the index of the first."""
        first, n = self.count, len(sizes)
        while self.used + len(ids) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        while first + n > len(self.at):
            self.at, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.size))
        self.table[self.used : self.used + len(ids)] = ids
        self.at[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.used += len(ids)
        self.count += n
        return first

    def learn(self, new: list[str]) -> None:
        easy, hard = [], []
        for p in new:
            (easy if p[1:].isalpha() and p[0] != "\n" or JOINED(p) else hard).append(p)
        ids, sizes = [], []
        for i in range(0, len(easy), 512):
            got = np.array(self.tok.encode_batch_fast(["\n".join(easy[i : i + 512]) + "\n"], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(got == self.feed)
            ids.append(got[got != self.feed])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        for i in range(0, len(hard), 4096):
            some = [e.ids for e in self.tok.encode_batch_fast(hard[i : i + 4096], add_special_tokens=False)]
            ids.append(np.array([x for e in some for x in e], np.uint32))
            sizes.append(np.array([len(e) for e in some], np.int64))
        if new:
            first = self.add(np.concatenate(ids), np.concatenate(sizes))
            self.index.update(zip(easy + hard, range(first, first + len(new)), strict=True))

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        get = self.index.get
        found = np.fromiter((get(t, -1) for t in texts), np.int64, len(texts))
        lost = np.flatnonzero(found < 0)
        cut = [(t,) if t[1:].isalpha() and t[0] != "\n" else CUTS.split(t) for t in map(texts.__getitem__, lost.tolist())]
        self.learn([p for p in dict.fromkeys(p for parts in cut for p in parts) if p not in self.index])
        counts = np.ones(len(texts), np.int64)
        counts[lost] = [len(parts) for parts in cut]
        parts = np.repeat(found, counts)
        begin = np.cumsum(counts) - counts
        parts[C.ragged(begin[lost], counts[lost])] = np.fromiter((self.index[p] for ps in cut for p in ps), np.int64)
        size = self.size[parts]
        ids = self.table[C.ragged(self.at[parts], size)]
        total = np.add.reduceat(size, begin) if len(texts) else size
        whole = {texts[i]: i for i, ps in zip(lost.tolist(), cut, strict=True) if len(ps) > 1 and "\n" not in texts[i] and len(texts[i]) <= LONGEST}
        at = np.fromiter(whole.values(), np.int64, len(whole))
        first = self.add(ids[C.ragged((np.cumsum(total) - total)[at], total[at])], total[at])
        self.index.update(zip(whole, range(first, first + len(whole)), strict=True))
        for p in (p for ps in cut for p in ps if len(p) > LONGEST):
            self.index.pop(p, None)
        return ids, total


_memos: dict[str, Memo] = {}


def memo(name: str, most: int = REMEMBERED) -> Memo:
    C.remember("tokens", _memos.clear)
    found = _memos[name] if name in _memos else _memos.setdefault(name, Memo(tokenizer(name)))
    if len(found.index) > most or found.used > MOST_IDS:
        found.forget()
    return found


def encode(texts: pa.Array, name: str, end: int | None = END, remember: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end (each followed by ``end``, if given), and the start of each text's ids
    with the total last. Null counts as empty."""
    tok, known = tokenizer(name), memo(name, remember)
    col = C.as_binary(texts).cast(pa.string())
    n = len(col)
    loose = pc.match_substring_regex(col, LOOSE).to_numpy(zero_copy_only=False)
    for own in added(tok):
        loose = loose | pc.match_substring(col, own).to_numpy(zero_copy_only=False)
    alone = [e.ids for e in tok.encode_batch_fast(col.filter(pa.array(loose)).to_pylist(), add_special_tokens=False)]
    whole, whole_n = np.array([x for e in alone for x in e], np.uint32), np.array([len(e) for e in alone], np.int64)
    plain = pc.if_else(pa.array(loose), "", col)
    lists = pc.split_pattern(plain, " ")
    at = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + n + 1].astype(np.int64)
    flat = lists.values.slice(at[0], at[-1] - at[0])
    at = at - at[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    later, later_n = known.encoded(pc.binary_join_element_wise(" ", coded.dictionary, "").to_pylist())
    first, first_n = known.encoded(flat.take(pa.array(at[:-1])).to_pylist())
    # one table of encodings: later pieces, first pieces by row, whole texts, the end id
    table = np.concatenate((later, first, whole, np.array([0 if end is None else end], np.uint32)))
    table_n = np.concatenate((later_n, first_n, whole_n, [0 if end is None else 1]))
    table_at = np.concatenate(([0], np.cumsum(table_n)[:-1])).astype(np.int32)
    table_n = table_n.astype(np.int32)
    n_later = len(later_n)
    codes[at[:-1]] = n_later + np.arange(n)
    codes[at[:-1][loose]] = n_later + n + np.arange(int(loose.sum()))
    ends = at[1:] + np.arange(n)
    pieces = np.empty(len(codes) + n, np.int32)
    is_end = np.zeros(len(pieces), bool)
    is_end[ends] = True
    pieces[is_end], pieces[~is_end] = len(table_n) - 1, codes
    counts = table_n[pieces]
    upto = np.cumsum(counts, dtype=np.int64)
    shift = (table_at[pieces] - (upto - counts)).astype(np.int32 if upto[-1:].sum() < 1 << 31 else np.int64)
    ids = table[np.arange(upto[-1] if n else 0, dtype=shift.dtype) + np.repeat(shift, counts)]
    starts = np.concatenate(([0], upto[ends]))
    return ids, starts
