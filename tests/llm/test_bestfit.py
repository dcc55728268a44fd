"""Operator 13 against brute force, on awkward rows and on histograms."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bestfit, queries

SF = "/root/testdata/sf0.001"


def encoded(text, end=0):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def check(got, texts, size):
    """Every piece is its document's ids there, and sequences are gapless and within size."""
    seqs, seen = {}, Counter()
    for r in got:
        ids = texts[r["doc_id"]]
        cut = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * size and len(cut) == r["length"] == min(size, len(ids) - r["start"])
        assert zlib.crc32(cut.tobytes()) == r["ids_crc32"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen[r["doc_id"], r["piece"]] += 1
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return seqs, seen


def test_query_against_the_tokenizer(spark):
    texts = {r["doc_id"]: encoded(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op13_bin_completion"](spark, SF).collect()
    seqs, seen = check(got, texts, 2048)
    assert seen == Counter((i, k) for i, ids in texts.items() for k in range(-(-len(ids) // 2048)))
    tails = Counter(len(ids) % 2048 for ids in texts.values() if len(ids) % 2048)
    full = sum(len(ids) // 2048 for ids in texts.values())
    assert len(seqs) <= full + sum(n for _, n in bestfit.best_fit_decreasing(tails, 2048))
    assert len(seqs) - full - bestfit.lower_bound(tails, 2048) <= 1


def test_awkward_and_empty_tables(spark):
    """Nulls, empty texts, exact multiples of the size, repeats, clashing columns; each row is its own pieces."""
    word = "a " * 15
    rows = [(1, word), (1, word), (2, None), (3, ""), (None, "a b"), (4, "a " * 31), (5, "a " * 7), (6, "b " * 100), (6, "b " * 100)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, part int, rank string, length int").repartition(3)
    got = bestfit.pack(bestfit.encode_pieces(docs, size=16, with_ids=True), size=16).collect()
    texts = {i: encoded(t) for i, t in rows}
    _, seen = check(got, texts, 16)
    assert seen == Counter((i, k) for i, t in rows for k in range(-(-len(texts[i]) // 16)))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert bestfit.pack(bestfit.encode_pieces(docs.limit(0), size=16), size=16).count() == 0


def fewest(items, size):
    """Fewest bins by trying all placements."""
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= items[k]:
                go(k + 1, rooms[:i] + [rooms[i] - items[k]] + rooms[i + 1 :])
        go(k + 1, [*rooms, size - items[k]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=11))
def test_search_finds_the_fewest(items):
    counts = Counter(items)
    found = bestfit.complete_bins(counts, 30)
    placed = Counter(itertools.chain.from_iterable(p * n for p, n in found))
    assert placed == counts and all(sum(p) <= 30 for p, _ in found)
    assert sum(n for _, n in found) == fewest(sorted(items, reverse=True), 30)
    assert sum(n for _, n in found) >= bestfit.lower_bound(counts, 30)


def test_search_beats_best_fit_decreasing():
    """Thirds of a sequence: best fit decreasing wastes a tenth, completion nearly nothing."""
    counts = Counter(np.random.default_rng(0).integers(600, 760, 3000).tolist())
    plain = sum(n for _, n in bestfit.best_fit_decreasing(counts, 2048))
    found = sum(n for _, n in bestfit.complete_bins(counts, 2048))
    assert found < 0.93 * plain and found <= 1.01 * bestfit.lower_bound(counts, 2048)


def test_steps_do_not_grow_with_counts():
    counts = Counter(np.random.default_rng(1).integers(1, 2048, 4000).tolist())
    many = bestfit.complete_bins({k: n * 1_000_000 for k, n in counts.items()}, 2048)
    assert len(many) < 10_000
    with pytest.raises(ValueError):
        bestfit.complete_bins({0: 1}, 8)
    assert bestfit.complete_bins({}, 8) == []
