"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(hit), len(w) < 50 or 100 * sum(hit) > 50 * len(w)


def good(text, bands, chunk_bands):
    """Base rules and bands, written plainly."""
    if counts(text)[-1]:
        return False
    compress = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress
    inside = lambda p, table: next(low <= len(p) / len(compress(p)) <= high for n, low, high in table if len(p) <= n)
    t = text.encode()
    parts = []
    while t and len(t) > 4096:
        cut = 4096 if len(t) - 4096 >= 1024 else len(t)
        parts.append(t[:cut])
        t = t[cut:]
    if t:
        parts.append(t)
    return inside(text.encode(), bands) and (len(parts) < 2 or all(inside(p, chunk_bands) for p in parts))


def local(pattern, text):
    """The best score of a local alignment: 2 for a match, -1 for anything else."""
    before, best = [0] * (len(text) + 1), 0
    for a in pattern:
        now = [0]
        for j, b in enumerate(text, 1):
            now.append(max(0, before[j - 1] + (2 if a == b else -1), before[j] - 1, now[-1] - 1))
        best, before = max(best, *now), now
    return best


def without_words(rows, size):
    """doc_id: n_words, n_removed, digest. rows: (doc_id, text), ids without repeats."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        out[doc] = len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()
    return out


def without_bytes(rows, size):
    """doc_id: n_bytes, n_removed, n_spans, digest."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if first.setdefault(b[i : i + size], doc) != doc:
                gone[i : i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


def shingles(text, n=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(rows):
    """doc_id: size of its set, least doc_id of its component."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for g in s for e in where[g]).items():
            if e < d and 100 * n >= 80 * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def edits(pattern, text):
    """Least edits that turn the pattern into some part of the text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)
