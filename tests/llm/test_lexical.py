"""Ranked search against a plain version that scores every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from codescan.llm import lexical

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall((text or "").encode().lower()))


def plain(docs, items):
    counted = [(d, terms(t)) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // n_words
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                        for w, k in terms(text).items() if w in c)
            if score:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:10])]
    return sorted(out, key=str)


def result(docs, items):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, items).collect()), key=str)


def questions(rows):
    rng = random.Random(2)
    out = [(i, " ".join(t.split()[3:3 + rng.randint(1, 30)])) for i, (_, t) in enumerate(rows) if t]
    return [*out, (900, None), (901, ""), (902, "-- "), (903, "nowhere"), (out[0][0], out[0][1]), (904, out[1][1] + " " + out[2][1]), (None, out[3][1])]


@pytest.fixture(scope="module")
def items(rows):
    return questions(rows)


def as_items(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int")


def test_same_as_plain(spark, docs, rows, items):
    """Nulls, empty and long texts, ties of copies, repeated rows, documents and items, clashing columns."""
    assert result(docs, as_items(spark, items)) == plain(rows, items)


def test_blocks_of_items_and_small_chunks(spark, docs, rows, items, monkeypatch):
    """The same answers from many item blocks, chunks and posting blocks."""
    for name, value in {"VOCABULARY": 60, "CHUNK": 7, "BLOCK": 2, "CENTRES": 4, "SEEDS": 10}.items():
        monkeypatch.setattr(lexical, name, value)
    few = items[::5]
    assert len(list(lexical.question_blocks(as_items(spark, few)))) > 1
    assert result(docs, as_items(spark, few)) == plain(rows, few)


def test_skipped_blocks(spark):
    """The search itself: blocks whose bound stays below the floor give no documents, the others all that reach it."""
    import numpy as np

    rows = spark.createDataFrame([(0, i, i, [0, 1], [5, 9] if i < 3 else [2, 1], 0, 0) for i in range(9)],
                                 "chunk int, doc_id long, key long, terms array<int>, value array<int>, cluster int, code long")
    asked = lexical.Questions([1], [np.array([0, 1])], [np.array([1, 2])], np.arange(2, dtype=np.uint64), np.arange(2, dtype=np.uint64))
    weight = np.array([10, 10])
    index = lexical._index(rows, asked, [np.array([1])])
    found = lexical._search(rows, index, asked, [np.array([1])], [100], weight).collect()
    assert {(r.doc_id, r.score) for r in found} == {(0, 230), (1, 230), (2, 230)}
    low = index.withColumn("most", index["most"].cast("array<int>")).selectExpr("chunk", "term", "keys", "terms", "transform(most, m -> 0) AS most")
    assert lexical._search(rows, low, asked, [np.array([1])], [100], weight).collect() == []


def test_empty(spark, empty, docs, items):
    assert lexical.search(empty, as_items(spark, items)).collect() == []
    assert lexical.search(docs, as_items(spark, []).limit(0)).collect() == []
