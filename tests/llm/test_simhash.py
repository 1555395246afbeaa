"""SimHash near duplicates against a plain version."""

import random
import re

import numpy as np
import pytest
import xxhash

from codescan.llm import simhash
from codescan.llm.components import components
from codescan.llm.queries import op5_simhash


def fingerprint(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, distance=2):
    """Least index reachable."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def plain(rows):
    fps = [fingerprint(t) for _, t in rows]
    group = classes(fps)
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted([(d, f, least.get(g)) for (d, _), f, g in zip(rows, fps, group)], key=str)


def test_same_as_plain(docs, rows):
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_keep_first(docs, rows):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    group = classes([fingerprint(t) for _, t in rows])
    least = {}
    for (doc_id, _), g in zip(rows, group):
        least[g] = min(least.get(g, (True, 0)), (doc_id is None, doc_id or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(least.values())


def test_no_text_is_lost(spark):
    """Rows of one doc_id and two texts are judged by their texts; rows without doc_id too."""
    a, b, c = ("one two three four five six", "red green blue black white grey", "up down left right in out")
    rows = [(6, a, 1), (6, b, 2), (7, b, 3), (7, b, 4), (None, c, 5), (None, c, 6), (None, a, 7), (8, None, 8), (9, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_first(docs).collect()), key=str)
    assert got == sorted([(6, a), (6, b), (None, c), (8, None)], key=str)


def close_fingerprints():
    rng = random.Random(2)
    fps = {0, 1, 3, 2**64 - 1, 2**63}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):  # chains that wander off, and dense groups
            fps.add(x)
            x ^= 1 << rng.randrange(64) ^ rng.choice([0, 1 << rng.randrange(64)])
    fps |= {7 ^ 1 << i ^ 1 << j for i in range(20) for j in range(20)}
    return sorted(fps)


@pytest.mark.parametrize("limit", [simhash.NODE_LIMIT, 10])
def test_links_connect_what_is_close(spark, limit):
    """Also where a node is factored again and again."""
    fps = close_fingerprints()
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.node_links(df, 2, limit).collect()]
    assert all((a ^ b).bit_count() <= 128 for a, b in links)
    place = {x: i for i, x in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(place[a]), find(place[b])))
        root[b] = a
    assert [find(i) for i in range(len(fps))] == classes(fps)


def test_tree_finds_every_pair():
    fps = np.array(close_fingerprints(), dtype=np.uint64)
    a, b = simhash.near_pairs(fps, 2)
    got = {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    random.Random(4).shuffle(chain)
    star = [(7, x) for x in range(20, 60)]
    links = spark.createDataFrame([*chain, *star, (-5, 59), (300, 300), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 100 for i in range(100, 181)} | {x: -5 for x in [-5, 7, *range(20, 60)]}


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op5_simhash(spark, sf).collect()]
    assert sorted(got, key=str) == plain(rows)
