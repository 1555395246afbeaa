"""Near duplicates by SimHash: fingerprints, and links found in a Gray-order hierarchical index.

Fingerprints that differ in at most ``d`` bits agree in at least one of ``d + 1`` blocks
of bits.  The upper nodes of the index are these masked bit patterns: a fingerprint goes to
one node for each block.  A node with very many fingerprints is factored again, by blocks of
the bits that its pattern leaves open.  Inside a node, fingerprints are sorted by
Gray rank, so that neighbours share bits; a tree of groups keeps the bits on which a whole
group agrees, and two groups are compared further only while the differences of their shared
bits do not exceed ``d``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescan.llm.components import components
from codescan.llm.words import U64, Words, blocks, signed
from codescan.session import cut_lineage

NODE_LIMIT = 20_000  # fingerprints of a node before it is factored again
FANOUT = 8           # children of a group in the tree
SEED = 42


def fingerprint_texts(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if it is set in over half of the shingles' hashes."""
    words = Words(texts, lower=True)
    data, start, end = words.joined()
    text = data.tobytes()
    # A text's shingles begin at its words but the last; shorter texts are one shingle.
    n = np.where(words.count == 0, 0, np.maximum(words.count - shingle + 1, 1))
    last_word = words.first[1:] - 1
    doc = np.repeat(np.arange(words.n_docs), n)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = words.first[:-1][doc] + within
    to = np.minimum(at + shingle - 1, last_word[doc])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(start[at].tolist(), end[to].tolist())),
                         dtype=U64, count=len(at))
    out = np.zeros(words.n_docs, dtype=U64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        firsts = (np.cumsum(n) - n)[full]
        ones = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > n[full, None], axis=1, bitorder="little").view(U64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp): one fingerprint for each row, zero for a text without words; ``key`` is a hash of the text.

    A doc_id must be a whole number, or text that is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fp = fingerprint_texts(block.column(2), shingle)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), signed(fp)], ["doc_id", "key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def _key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the order of the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U64(shift))
    return x


def near_pairs(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the fingerprints within ``distance`` bits, by the tree over their Gray order."""
    order = np.argsort(gray_rank(fps), kind="stable")
    # Bottom up: (bits all members agree on, their values) for each group of each level.
    levels = [(np.full(len(fps), U64(0xFFFFFFFFFFFFFFFF)), fps[order])]
    while len(levels[-1][0]) > 1:
        mask, value = levels[-1]
        firsts = np.arange(0, len(mask), FANOUT)
        every = np.bitwise_and.reduceat(value, firsts)
        some = np.bitwise_or.reduceat(value, firsts)
        shared = np.bitwise_and.reduceat(mask, firsts) & ~(every ^ some)
        levels.append((shared, every & shared))
    a = b = np.zeros(1, dtype=np.int64)
    found = []
    stack = [(len(levels) - 1, a, b)]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            found.append((a[a < b], b[a < b]))
            continue
        if len(a) > 50_000:  # keeps what one step holds small
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        mask, value = levels[level - 1]
        kids = np.arange(FANOUT)
        x = (a[:, None, None] * FANOUT + kids[None, :, None]) + np.zeros((1, 1, FANOUT), dtype=np.int64)
        y = (b[:, None, None] * FANOUT + kids[None, None, :]) + np.zeros((1, FANOUT, 1), dtype=np.int64)
        x, y = x.ravel(), y.ravel()
        there = (x <= y) & (y < len(mask))
        x, y = x[there], y[there]
        near = np.bitwise_count((value[x] ^ value[y]) & mask[x] & mask[y]) <= distance
        if near.any():
            stack.append((level - 1, x[near], y[near]))
    a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
    b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
    return order[a], order[b]


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n items reaches over the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _link_sorted(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is connected inside each key; the rows are sorted by key."""
    firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[firsts, len(keys)])
    pairs_a, pairs_b = [], []
    small = np.repeat(sizes <= 4 * FANOUT, sizes)  # a leaf: its members are compared directly
    for step in range(1, int(sizes[sizes <= 4 * FANOUT].max(initial=1))):
        i = np.flatnonzero(small[:-step] & (keys[step:] == keys[:-step]))
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= distance]
        pairs_a.append(i)
        pairs_b.append(i + step)
    for first, size in zip(firsts[sizes > 4 * FANOUT], sizes[sizes > 4 * FANOUT]):
        a, b = near_pairs(fps[first:first + size], distance)
        pairs_a.append(a + first)
        pairs_b.append(b + first)
    if not pairs_a:
        return fps[:0], fps[:0]
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    root = _spanning(len(fps), a, b)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _split_bits(open_bits: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(open_bits), parts)]


def _pattern(bits: list[int]):
    """The fingerprint's bits in the mask, others zero."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def node_links(fps: DataFrame, distance: int = 2, limit: int = NODE_LIMIT) -> DataFrame:
    """(a, b): links that connect all fingerprints (``fp``, distinct) within ``distance`` bits.

    Not every close pair is listed, but the links of a node span what is connected in it, so
    components over the links are those over all close pairs.
    """
    # Nodes still to place: the mask's open bits, by the path of blocks that led there.
    levels = [("", list(range(64)), fps.select("fp", F.lit("").alias("path"), F.lit(0).cast("long").alias("key")))]
    placed = []
    while levels:
        path, open_bits, rows = levels.pop()
        for i, block in enumerate(_split_bits(open_bits, distance + 1)):
            rest = [b for b in open_bits if b not in block]
            child, own = f"{path}{i}", [b for b in range(64) if b not in rest]
            node = rows.select("fp", F.lit(child).alias("path"), _pattern(own).alias("key"))
            sizes = node.groupBy("key").count()
            most = sizes.agg(F.max("count")).first()[0] or 0
            if most <= limit or len(rest) <= distance:
                placed.append(node)
                continue
            large = cut_lineage(sizes.where(F.col("count") > limit).select("key"))
            placed.append(node.join(large, "key", "left_anti").select("fp", "path", "key"))
            levels.append((child, rest, cut_lineage(node.join(large, "key", "left_semi").select("fp", "path", "key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, U64)
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.asarray(batch.column(0)).view(U64)
            code = np.asarray(batch.column(1))
            keys, fp = np.concatenate([held_k, code]), np.concatenate([held_f, fp])
            tail = int(np.searchsorted(keys, keys[-1]))  # the last node may go on in the next batch
            held_k, held_f = keys[tail:], fp[tail:]
            if tail:
                a, b = _link_sorted(keys[:tail], fp[:tail], distance)
                yield pa.RecordBatch.from_arrays([signed(a), signed(b)], ["a", "b"])
        if len(held_k):
            a, b = _link_sorted(held_k, held_f, distance)
            yield pa.RecordBatch.from_arrays([signed(a), signed(b)], ["a", "b"])

    rows = placed[0]
    for more in placed[1:]:
        rows = rows.union(more)
    # One number names the node: its path and its pattern.
    rows = rows.select("fp", F.xxhash64("path", "key").alias("node"))
    rows = rows.repartition("node").sortWithinPartitions("node", "fp")
    return rows.mapInArrow(run, "a long, b long")


def _roots(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, first, root): each fingerprint with its least doc_id and the root of its component."""
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = cut_lineage(components(node_links(nodes.select("fp"), distance)))
    return cut_lineage(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the least doc_id reachable over close fingerprints.

    Equal fingerprints are one node, so copies cost a row each and no pairs.  A null or empty
    text has fingerprint zero.  A row without doc_id gets the component of its fingerprint
    (null if no member has a doc_id).  Repeated rows are returned as often as they come.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    linked = _roots(rows, distance)
    least = cut_lineage(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = cut_lineage(linked.join(least, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of docs for each group of near copies: the one with the least doc_id, then the least hash of its text.

    Rows without doc_id come last, so they stay only where their group has no other.  Rows that share a doc_id
    but not their text are judged each by its own text.  Of rows that share both, the one with the
    least hash of all columns stays.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    members = rows.join(_roots(rows, distance).select("fp", "root"), "fp")
    # Combined on the map side: a group of any size costs a row for each task.
    stays = cut_lineage(members.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("s")).select("s.doc_id", "s.key"))
    own = F.struct(*docs.columns)
    marked = docs.select(F.col(id_col).cast("long").alias("_doc"), _key(text_col).alias("_key"), own.alias("_all"))
    chosen = marked.join(stays, marked["_doc"].eqNullSafe(stays["doc_id"]) & (marked["_key"] == stays["key"]), "left_semi")
    one = chosen.groupBy("_doc", "_key").agg(F.min_by("_all", F.xxhash64(F.to_json("_all"))).alias("_all"))
    return one.select("_all.*")
