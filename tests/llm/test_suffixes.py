"""Suffix arrays and the dedup by them, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

from codescan.llm import suffixes
from codescan.llm.induced import common_prefixes, suffix_array


def in_order(data):
    return sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("letters", [1, 2, 4, 26, 256])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for n in [0, 1, 2, 3, *(rng.randrange(400) for _ in range(60))]:
        data = bytes(rng.randrange(letters) for _ in range(n)) * rng.choice([1, 1, 2, 3])
        assert suffix_array(np.frombuffer(data, dtype=np.uint8)).tolist() == in_order(data)


def test_many_names():
    """A reduced string with more symbols than a byte, written as digits."""
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 123) for _ in range(20_000))
    data += data[5_000:12_000]
    assert suffix_array(np.frombuffer(data, dtype=np.uint8)).tolist() == in_order(data)


def test_common_prefixes_end_with_their_piece():
    rng = random.Random(2)
    for _ in range(150):
        pieces = [bytes(rng.randrange(97, 100) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 6))]
        pieces += pieces[:rng.randrange(3)]
        data = b"".join(p + b"\xff" for p in pieces)
        order = suffix_array(np.frombuffer(data, dtype=np.uint8))
        previous, length = common_prefixes(np.frombuffer(data, dtype=np.uint8), order, np.cumsum([len(p) + 1 for p in pieces]))
        for before, i in zip(order.tolist(), order.tolist()[1:]):
            n = 0
            while max(i, before) + n < len(data) and data[i + n] == data[before + n] != 255:
                n += 1
            assert (previous[i], length[i]) == (before, n)


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=str)


@pytest.mark.parametrize("length,anchor", [(400, 100), (60, 15)])
def test_same_as_plain(docs, rows, length, anchor):
    """Nulls, empty and long texts, repeated rows, repeated and missing ids, clashing columns, letters of two bytes."""
    assert result(suffixes.remove_repeats(docs, length=length, anchor=anchor)) == plain(rows, length)


def overlapping(n):
    rng = random.Random(n)
    passage = "".join(rng.choice("abcdefgé ") for _ in range(150))
    out = [(i, "".join(rng.choice("ab cdeß") for _ in range(rng.randrange(60))) + passage[rng.randrange(30):] + rng.choice("xyz") * 3)
           for i in range(n)]
    return [*out, (n, "a" * 300), (n + 1, "xyz" * 90), (n + 2, passage[:70]), (None, passage)]


def test_crowded_anchors_are_split(spark, monkeypatch):
    """One passage in all documents, with other bytes around it: the kinds of its anchors are cut again and again."""
    rows = overlapping(60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    calls = []
    halves = suffixes._halves
    monkeypatch.setattr(suffixes, "CROWDED", 200)
    monkeypatch.setattr(suffixes, "_halves", lambda *a: calls.append(1) or halves(*a))
    assert result(suffixes.remove_repeats(df, length=40, anchor=10)) == plain(rows, 40)
    assert len(calls) > 2


def test_long_texts_in_pieces(spark, monkeypatch):
    """Texts longer than what is hashed at once, and strips longer than a shard takes whole."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcd ") for _ in range(4000))
    rows = [(1, long), (2, "x" + long), (3, long[1500:] + "y" + long[:900]), (4, "q" * 1000)]
    monkeypatch.setattr(suffixes, "CHUNK", 512)
    monkeypatch.setattr(suffixes, "STRIP", 300)
    monkeypatch.setattr(suffixes, "SHARD", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(suffixes.remove_repeats(df, length=50, anchor=12)) == plain(rows, 50)


def test_empty(empty):
    assert suffixes.remove_repeats(empty).collect() == []
