"""Language identification with a byte convolutional network, trained and applied in numpy.

Bytes of a fixed-length window are embedded, filters of several widths slide over them, the greatest
response of each filter is kept, and a softmax layer names the language. A text is cut into consecutive
windows, all of it; its language has the greatest probability summed over windows, weighted by their bytes.

The network is fitted on a bounded sample: at most ``PER_LANG`` windows of each language, chosen by a hash of
doc_id and text among the labelled documents that a caller admits. Neither lang, source nor doc_id is an input.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without labelled documents all
are; equal rows get equal results; a very long text is read window by window; a document without a doc_id is not held
out; an empty table gives no row; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common as C

#: Most training windows of a language and of all, bytes of a window, and the network's and training's sizes.
PER_LANG, IN_ALL, WINDOW = 800, 100_000, 192
EMBED, WIDTHS, FILTERS, EPOCHS, BATCH, RATE = 6, (2, 3, 4), 16, 8, 64, 0.01
LEAST = 12
NO_LETTER = "und"


class Network:
    """Weights of the network; ``labels`` are its classes in order."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.w = {"embed": rng.normal(0, 0.5, (257, EMBED)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), "bias": np.zeros(len(labels))}
        self.w |= {f"conv{k}": rng.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, FILTERS)) for k in WIDTHS}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def patches(self, x: np.ndarray, k: int) -> np.ndarray:
        """(window, place, k * EMBED) views of embedded windows, copied."""
        e = self.w["embed"][x]
        n, length, _ = e.shape
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, length - k + 1, k * EMBED), (s[0], s[1], s[2]))

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([(self.patches(x, k) @ self.w[f"conv{k}"]).max(axis=1) for k in WIDTHS], axis=1), 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.features(x) @ self.w["out"] + self.w["bias"])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        found, best, hidden = {}, {}, []
        for k in WIDTHS:
            r = self.patches(x, k) @ self.w[f"conv{k}"]
            best[k] = r.argmax(axis=1)
            hidden.append(np.take_along_axis(r, best[k][:, None, :], axis=1)[:, 0])
        h = np.concatenate(hidden, axis=1)
        on = np.maximum(h, 0)
        d = softmax(on @ self.w["out"] + self.w["bias"])
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        found["out"], found["bias"] = on.T @ d, d.sum(axis=0)
        dh = (d @ self.w["out"].T) * (h > 0)
        embed = np.zeros_like(self.w["embed"])
        for i, k in enumerate(WIDTHS):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS]
            p = self.patches(x, k)[np.arange(len(y))[:, None], best[k]]
            found[f"conv{k}"] = np.einsum("bf,bfk->kf", g, p)
            back = (g[:, :, None] * self.w[f"conv{k}"].T[None]).reshape(*g.shape, k, EMBED)
            for j in range(k):
                np.add.at(embed, x[np.arange(len(y))[:, None], best[k] + j], back[:, :, j])
        found["embed"] = embed
        return found


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def padded(pieces: list[bytes], length: int = WINDOW) -> np.ndarray:
    """Windows as rows of bytes; 256 fills what is missing."""
    out = np.full((len(pieces), length), 256, np.int16)
    for i, b in enumerate(pieces):
        b = b[:length]
        out[i, : len(b)] = np.frombuffer(b, np.uint8)
    return out


def fit(texts: list[bytes], langs: list[str], seed: int = 7) -> Network:
    """Train by Adam. Windows are cut shorter at random, so that short texts are no surprise."""
    labels = sorted(set(langs))
    net = Network(labels, seed)
    rng = np.random.default_rng(seed)
    y = np.array([labels.index(x) for x in langs])
    x = padded(texts)
    m, v, t = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2)), None, 0
    m, v = m
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            some = order[i : i + BATCH]
            short = np.where(rng.random(len(some)) < 0.4, rng.integers(LEAST, WINDOW, len(some)), WINDOW)
            xs = np.where(np.arange(WINDOW) < short[:, None], x[some], 256)
            t += 1
            for k, g in net.gradients(xs, y[some]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.w[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, admitted: Column, per_lang: int = PER_LANG, seed: int = 11) -> tuple[list[bytes], list[str]]:
    """Windows of admitted documents with their languages: about ``per_lang`` of each at most (fewer, if there are so many
    languages that this gives more than ``IN_ALL``), by a hash of doc_id and text, each from a place in the text that
    the hash picks; repeated rows count once."""
    rows = docs.where(admitted & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    per_lang = max(1, min(per_lang, IN_ALL // len(counts)))
    h = F.xxhash64("doc_id", "text", F.lit(seed))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n)))), F.col("lang"))
    size = F.length("text")
    at = F.pmod(F.shiftright(h, 20), F.greatest(size - WINDOW, F.lit(0)) + 1).cast("int") + 1
    taken = rows.where(F.pmod(h, F.lit(1 << 20)) < share * (1 << 20)).select("doc_id", "lang", F.substring("text", at, F.lit(WINDOW)).alias("t")).distinct().collect()
    taken.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["t"]))
    taken = [r for r in taken if any(c.isalpha() for c in r["t"])]
    return [r["t"].encode() for r in taken], [r["lang"] for r in taken]


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
OUT_DDL = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(batches, net: Network | None, step: int = 1024):
    for batch in C.chunks(batches, size=4 << 20):
        data, at = C.raw(batch.column("text"))
        size = np.diff(at)
        letters = pc.match_substring_regex(pc.fill_null(batch.column("text"), ""), r"\pL").to_numpy(zero_copy_only=False)
        total = np.zeros((len(size), len(net.labels) if net else 1))
        if net:
            n = np.where(letters, -(-size // WINDOW), 0)
            row = np.repeat(np.arange(len(size)), n)
            start = at[row] + C.ragged(np.zeros(len(size), np.int64), n) * WINDOW
            have = np.minimum(at[row + 1] - start, WINDOW)
            full = np.concatenate((data, np.zeros(WINDOW, np.uint8)))
            for i in range(0, len(row), step):
                s, e = start[i : i + step], have[i : i + step]
                x = full[s[:, None] + np.arange(WINDOW)].astype(np.int16)
                x[np.arange(WINDOW) >= e[:, None]] = 256
                np.add.at(total, row[i : i + step], net.probabilities(x) * e[:, None])
        best = total.argmax(axis=1)
        named = letters & (net is not None)
        pred = [net.labels[b] if ok else NO_LETTER for b, ok in zip(best.tolist(), named.tolist(), strict=True)]
        score = np.where(named, total[np.arange(len(size)), best] / np.maximum(size, 1), 0.0).clip(0, 1)
        yield C.record(OUT, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=pred, score=score)


def identify(docs: DataFrame, held_out: Column | None = None, per_lang: int = PER_LANG) -> DataFrame:
    """Fit on documents that are not held out, predict all. By default those are held out whose
    crc32(doc_id as text) leaves 2 when divided by 4."""
    if held_out is None:
        held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    docs = C.only(docs, "doc_id", "text", "lang")
    texts, langs = sample(docs, ~held_out, per_lang)
    net = fit(texts, langs) if texts else None
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(lambda b: predict(b, net), OUT_DDL)
