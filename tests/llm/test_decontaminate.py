"""Benchmark decontamination against a plain version."""

import re

import pytest

from codescan.llm import decontaminate as dc

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, size):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[i:i + n]), set()).add(item or "")
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for gram, own in grams.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i:i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found |= own
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(texts):
    some = [" ".join(words(t)[3:25]) for t in texts if len(words(t)) > 40][:6]
    return [("i1", some[0]), ("i1", some[0]), ("i2", some[1].upper() + "!"), ("i10", some[2]), ("i3", "One two"), ("i4", ""),
            ("i5", None), (None, some[3]), ("i6", some[0][:60])]


@pytest.fixture(scope="module")
def bench(spark, items):
    return spark.createDataFrame(items, "item_id string, text string")


@pytest.mark.parametrize("limit", [dc.BLOCK_WINDOWS, 9])
def test_same_as_plain(docs, rows, items, bench, limit):
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in dc.hit_report(docs, bench, size=6, limit=limit).collect()]
    assert sorted(got, key=str) == plain(rows, items, 6)


def test_documents_go(docs, rows, items, bench):
    kept = dc.decontaminate(docs, bench, size=6)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect() if r["text"]) == sorted(
        (d, t) for (d, t) in rows if t and d is not None
        and not next(x for x in plain([(d, t)], items, 6))[2])


def test_spans_go(spark, bench):
    docs = spark.createDataFrame([(1, "Keep this, One  TWO! and that. one two"), (2, None), (3, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, size=6, remove="spans").collect()}
    assert got == {1: "Keep this, ! and that. ", 2: None, 3: "nothing here"}


def test_short_items_can_be_left_out(spark, bench):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert dc.hit_report(docs, bench, least=3).first().n_hit == 0


def test_empty(docs, empty, bench, spark):
    assert dc.hit_report(empty, bench).collect() == []
    none = spark.createDataFrame([], "item_id string, text string")
    assert dc.decontaminate(docs, none).count() == docs.count()
