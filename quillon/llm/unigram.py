"""Token counts of a unigram tokenizer, without the tokens.

Pieces and scores come from a public vocabulary file. White space becomes the mark U+2581 and one mark is put
before a text. No piece holds a mark after another character, nor a line feed, so the best segmentation of a
text is made of the best ones of its units: a run of marks and what follows it. Each distinct unit is segmented
once: an Aho-Corasick automaton yields all pieces that end at each character, and dynamic programming keeps
best score and number of pieces. Ties go as in the tokenizer: of equal scores the piece that starts first
stays. A character that is no piece has the least score less 10 and counts as its UTF-8 bytes.

Defined cases: null and empty texts have no tokens and score 0; equal rows get equal results; a very long unit is
segmented in one pass and not remembered; a document without a doc_id keeps it null; an empty table gives no row; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillon.llm import common as C

VOCABULARY = "piece_bpe_32k.model"
MARK, PENALTY = "▁", 10.0
#: Most units that a worker remembers, beyond which it starts anew, and the longest. Bounds of memory, without effect on
#: results.
REMEMBERED, LONGEST = 600_000, 256
NO_MATCH = -1, None
NORMAL, USER_DEFINED = 1, 4
_counters: dict[str, Counter] = {}


def pieces(name: str) -> list[tuple[str, float]]:
    """Pieces that text can match, with their scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(C.vocabulary(name), "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score) for p in model.pieces if p.type in (NORMAL, USER_DEFINED)]


class Counter:
    """Best score and number of tokens of units."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        if any(MARK in p.lstrip(MARK) or "\n" in p for p, _ in vocabulary):
            raise ValueError("a piece joins units; texts can't be cut at marks")
        self.automaton = ahocorasick.Automaton()
        for p, score in vocabulary:
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.score: list[float] = []
        self.count: list[int] = []

    def segment(self, unit: str) -> tuple[float, int]:
        """In one pass; of the table only the last places, as many as the longest piece, are kept."""
        ring = self.longest + 1
        best, count = [0.0] * ring, [0] * ring
        # matches come by end, the longest first: of equal scores the first to come stays
        matches = self.automaton.iter(unit)
        end, match = next(matches, NO_MATCH)
        for i, char in enumerate(unit):
            top, many = None, 0
            while end == i:
                length, score = match
                at = (i + 1 - length) % ring
                start = best[at] + score
                if top is None or start > top:
                    top, many = start, count[at] + 1
                end, match = next(matches, NO_MATCH)
            if char not in self.single:
                start = best[i % ring] + self.unknown
                if top is None or start > top:
                    top, many = start, count[i % ring] + len(char.encode())
            best[(i + 1) % ring], count[(i + 1) % ring] = top, many
        return best[len(unit) % ring], count[len(unit) % ring]

    def of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.score) > REMEMBERED:
            self.forget()
        get = self.index.get
        at = np.empty(len(units), np.int64)
        for i, u in enumerate(units):
            k = get(u)
            if k is None:
                score, count = self.segment(u)
                k = len(self.score)
                if len(u) <= LONGEST:
                    self.index[u] = k
                self.score.append(score)
                self.count.append(count)
            at[i] = k
        return np.array(self.score)[at], np.array(self.count)[at]


def counter(name: str) -> Counter:
    C.remember("unigram", _counters.clear)
    if name not in _counters:
        _counters[name] = Counter(pieces(name))
    return _counters[name]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
OUT_DDL = "doc_id long, n_tokens long, score double"


def counts(batches, name: str):
    for batch in C.chunks(batches, owner="unigram"):
        known = counter(name)
        text = C.as_binary(batch.column("text")).cast(pa.string())
        # cut before each mark that follows another character, and round line feeds
        marked = pc.replace_substring(pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise(" ", text, "")), " ", MARK)
        cut = pc.replace_substring_regex(marked, rf"([^{MARK}\n])({MARK})", r"\1" + "\x00" + r"\2")
        cut = pc.replace_substring_regex(cut, r"\n", "\x00\n\x00")
        # a NUL of the text itself cuts too: it is no piece, so it is counted apart
        lists = pc.split_pattern(cut, "\x00")
        nul = pc.count_substring(text, "\x00").to_numpy(zero_copy_only=False)
        at = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        score, count = known.of(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[codes])))[at - at[0]])
        yield C.record(OUT, doc_id=batch.column("doc_id"), n_tokens=sums(count) + nul, score=sums(score) + nul * known.unknown)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each document and the score of its best segmentation."""
    return C.only(docs, "doc_id", "text").mapInArrow(lambda b: counts(b, vocabulary), OUT_DDL)
