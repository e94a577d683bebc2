"""Cases of a review of the first round, each of which failed before."""

import random
import re

import corpus_pipeline as P
import pytest

from quillon.llm import common as C
from quillon.llm import decontam, quality, repeats

from . import brute
from .test_operators import frame

SF = "/root/testdata/sf0.001"


def good_by_bands(text):
    return brute.good(text, quality.BANDS, quality.CHUNK_BANDS)


@pytest.mark.parametrize("sf,least", [("sf0.001", 3), ("sf0.01", 16)])
def test_bands_reject_junk_and_keep_clean(spark, sf, least):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()}
    passed = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect() if not r["base_failed"]}
    assert all(kept for d, kept in passed.items() if label.get(d) == 1)
    assert sum(not kept for d, kept in passed.items() if label.get(d) == 0) >= least


def test_stages_after_bands(spark):
    """The stages, where the first rejects by bands too."""
    docs = C.documents(spark, SF)
    stages = dict(P.STAGES)
    kept = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name in list(stages)[:-1]:
        docs = C.save(stages[name](spark, docs, SF), f"advice-{name}")
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    before, good, one, cut, clean = kept
    assert set(good) == {d for d, t in before.items() if good_by_bands(t)} < {d for d, t in before.items() if not brute.counts(t)[-1]}
    assert set(one) == {d for d, (_, c) in brute.linked(list(good.items())).items() if c == d}
    expected = brute.without_words(list(one.items()), 20)
    assert {d: len(brute.words(t)) for d, t in cut.items()} == {d: n - gone for d, (n, gone, _) in expected.items() if n > gone}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [t for t in clean.values() for i in items if re.sub(r"\s+", " ", i) in re.sub(r"\s+", " ", t)]
    assert {r["doc_id"] for r in stages["packing"](spark, docs, SF).collect()} == set(clean)


def test_partial_quotes_are_found_and_cut(spark):
    """Any part of 63 bytes of an item, wherever it begins, and all of it goes."""
    rng = random.Random(7)
    item = "".join(rng.choice("abcdefghijklm") for _ in range(230))
    n = 63
    rows = [(a, f"<{item[a : a + n].upper()}>") for a in range(len(item) - n + 1)]
    rows += [(1000 + k, f"<{item[10 : 10 + k]}>") for k in range(n, 200, 7)]
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontam.leaks(frame(spark, rows), table).collect()}
    assert set(found) == {d for d, _ in rows}
    assert all(found[d]["start_byte"] <= 1 and found[d]["end_byte"] >= len(t) - 1 for d, t in rows)
    assert {r["text"] for r in decontam.decontaminate(frame(spark, rows), table).collect()} <= {"<>", "<", ">"}


@pytest.mark.parametrize("parts", [1, 3])
def test_equal_rows_keep_their_text(spark, parts):
    """In one chunk or in several, equal rows get the same result, and a repeat within them goes from both."""
    words = [f"p{i}" for i in range(30)]
    twice = " ".join([*words, "and", *words])
    rows = [(4, twice), (4, twice), (None, "q " + " ".join(f"n{i}" for i in range(40))), (None, "q " + " ".join(f"n{i}" for i in range(40))), (9, " ".join(words))]
    got = repeats.cut_repeats(frame(spark, rows, parts)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("4", " ".join([*words, "and"]))] * 2 + [("None", rows[2][1])] * 2)
    found = repeats.substring_dedup(frame(spark, rows, parts)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in found) == [("4", 30), ("4", 30), ("9", 30), ("None", 0), ("None", 0)]
