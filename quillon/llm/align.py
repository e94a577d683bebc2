"""Banded sequence alignment of many pairs at once.

A pair is a pattern and a stretch of text; cell (i, d) of its table stands after i pattern items on diagonal
d, so the text place is i + d. Tables are filled row by row over all pairs together.
"""

from __future__ import annotations

import numpy as np


def along(better, score: np.ndarray, gap: int, *carried: np.ndarray) -> None:
    """Let text items be inserted: cells take over from the one before until nothing gets better."""
    while True:
        step = score[:, :-1] + gap
        take = better(step, score[:, 1:])
        if not take.any():
            return
        for x in carried:
            x[:, 1:] = np.where(take, x[:, :-1], x[:, 1:])
        score[:, 1:] = np.where(take, step, score[:, 1:])


def edits(pattern: np.ndarray, size: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least edits that turn each whole pattern into some part of its text, and that part's first and
    last place (end excluded). pattern: (pairs, longest), size: of each, text: (pairs, longest + width)."""
    n, longest = pattern.shape
    score = np.zeros((n, width), np.int32)
    begin = np.broadcast_to(np.arange(width, dtype=np.int32), (n, width)).copy()
    best, first, last = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    column = np.arange(width, dtype=np.int32)
    for i in range(1, longest + 1):
        same = score + (pattern[:, i - 1 : i] != text[:, i - 1 : i - 1 + width])
        skip = np.full((n, width), 1 << 20, np.int32)
        skip[:, :-1] = score[:, 1:] + 1
        from_skip = np.zeros((n, width), np.int32)
        from_skip[:, :-1] = begin[:, 1:]
        take = skip < same
        score, begin = np.where(take, skip, same), np.where(take, from_skip, begin)
        # text items inserted, in one sweep: of the cells before, the last of those that cost least from here
        least = np.minimum.accumulate((score - column) * width + (width - 1 - column), axis=1)
        score, begin = least // width + column, np.take_along_axis(begin, width - 1 - least % width, axis=1)
        done = np.flatnonzero(size == i)
        if len(done):
            d = score[done].argmin(axis=1)
            best[done], first[done], last[done] = score[done, d], begin[done, d], i + d
    return best, first, last


def local(pattern: np.ndarray, size: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best local alignment of each pair (2 for a match, -1 for anything else, so that a lone change near an end
    doesn't cut it short): matched items, first and last place in the text (end excluded)."""
    n, longest = pattern.shape
    score, matched = np.zeros((n, width), np.int32), np.zeros((n, width), np.int32)
    begin = np.broadcast_to(np.arange(width, dtype=np.int32), (n, width)).copy()
    best, most, first, last = (np.zeros(n, np.int32) for _ in range(4))
    rows = np.arange(n)
    for i in range(1, longest + 1):
        hit = (pattern[:, i - 1 : i] == text[:, i - 1 : i - 1 + width]) & (size >= i)[:, None]
        same, same_matched = score + np.where(hit, 2, -1), matched + hit
        skip, skip_matched, skip_begin = (np.zeros((n, width), np.int32) for _ in range(3))
        skip[:, :-1], skip_matched[:, :-1], skip_begin[:, :-1] = score[:, 1:] - 1, matched[:, 1:], begin[:, 1:]
        take = skip > same
        score, matched, begin = np.where(take, skip, same), np.where(take, skip_matched, same_matched), np.where(take, skip_begin, begin)
        along(np.greater, score, -1, matched, begin)
        none = score <= 0
        score[none], matched[none] = 0, 0
        begin = np.where(none, i + np.arange(width), begin)
        d = score.argmax(axis=1)
        better = score[rows, d] > best
        best = np.where(better, score[rows, d], best)
        most, first, last = np.where(better, matched[rows, d], most), np.where(better, begin[rows, d], first), np.where(better, i + d, last)
    return most, first, last
