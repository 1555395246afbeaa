"""Substring dedup against a plain version."""

import hashlib
import random
import re

import pytest

from codescan.llm import substring
from codescan.llm.queries import op1_substring


def plain(rows, window=50):
    first, split = {}, []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        split.append((doc_id, words))
        for i in range(len(words) - window + 1) if doc_id is not None else ():
            key = tuple(words[i:i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, words in split:
        keep = [True] * len(words)
        for i in range(len(words) - window + 1) if doc_id is not None else ():
            if first[tuple(words[i:i + window])] < doc_id:
                keep[i:i + window] = [False] * window
        kept = [w for w, k in zip(words, keep) if k]
        out.append((doc_id, len(words), len(words) - len(kept), " ".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("window,anchor", [(50, 15), (7, 3)])
def test_same_as_plain(docs, rows, window, anchor):
    assert result(substring.remove_repeats(docs, window=window, anchor=anchor)) == plain(rows, window)


def test_paths_branch_inside_repeats(spark):
    """Windows repeat in part only: passages that meet, part and end in each other."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 25))] for _ in range(8)]
    rows = [(i, " ".join(w for _ in range(rng.randint(1, 6)) for w in rng.choice(passages))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substring.remove_repeats(df, window=12, anchor=4)) == plain(rows, 12)


def test_repeated_rows_are_read_once(spark):
    """A row repeated k times has its runs once, not k * k times."""
    rng = random.Random(4)
    shared = [f"w{rng.randrange(50)}" for _ in range(40)]
    rows = [(i, " ".join([f"a{i}", *shared[i:], f"b{i}", *shared[:20 + i]])) for i in range(5)]
    rows += [rows[3]] * 15
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = substring.repeated_spans(df, window=12, anchor=4).collect()
    assert spans and all(len(set(zip(r.starts, r.sizes))) == len(r.starts) for r in spans)
    assert result(substring.remove_repeats(df, window=12, anchor=4)) == plain(rows, 12)


def test_empty(empty):
    assert substring.remove_repeats(empty).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring(spark, sf).collect()), key=str)
    assert got == sorted(((*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for x in plain(rows)), key=str)
