"""Substring dedup over a compacted De Bruijn graph of token k-mers.

An edge of the graph is a k-mer of ``window`` words.  Each edge belongs to one sampled
anchor, the least hash among its runs of ``anchor`` words, so equal edges have equal anchors.
Consecutive edges of a text with one anchor are a path, compacted where it is read and named
by two independent hashes of all its words; there is about one path for 18 words.

1. Anchors found in one document only are no repeats and go.
2. Equal paths meet in a join.  An anchor whose paths are all equal does not branch there: the
   path stays whole, and its first document is its source.
3. At a branching anchor only one occurrence of each different path, at its source coordinates,
   is read again and split into edges; the first document of an edge decides it.
4. Every occurrence of a path takes over what is known of its edges.  Both hashes of the words
   at the source's coordinates and at the occurrence's own must agree.

A span of any length is the union of its edges, so nothing is lost where paths branch, where
documents begin or where more than two documents overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescan.llm.words import Spans, Words, blocks, signed, sliding_min_at
from codescan.session import cut_lineage

WINDOW, ANCHOR = 50, 15
# Seeds of the hashes: anchors, and two independent ones for paths and for edges.
_ANCHOR, _FIRST, _SECOND = 2, 3, 4


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that can be compared.  The text's hash tells rows with one doc_id apart."""
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.col(text_col).alias("text"))


def paths(base: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(anchor, p1, p2, doc_id, key, a, n): runs of n edges from word a that share their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column(2))
            if len(words) < window:
                continue
            one, two = words.hashes(0), words.hashes(1)
            grams = np.arange(len(words) - anchor + 1)
            code = Spans(one, _ANCHOR)(grams, grams + anchor)
            at = sliding_min_at(code, window - anchor + 1)
            begin = np.flatnonzero(words.windows(window))
            if not len(begin):
                continue
            at, doc = at[begin], words.doc()[begin]
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
            n = np.diff(np.r_[new, len(begin)])
            a, doc = begin[new], doc[new]
            to = a + n - 1 + window
            yield pa.RecordBatch.from_arrays(
                [signed(code[at[new]]), signed(Spans(one, _FIRST)(a, to)), signed(Spans(two, _SECOND)(a, to)),
                 block.column(0).take(pa.array(doc)), block.column(1).take(pa.array(doc)),
                 pa.array((a - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["anchor", "p1", "p2", "doc_id", "key", "a", "n"])

    return base.mapInArrow(run, "anchor long, p1 long, p2 long, doc_id long, key long, a int, n int")


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many for each row) of a column of lists; null is none."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(
        zero_copy_only=False)


def _edges(reads: DataFrame, window: int) -> DataFrame:
    """The single edges of paths, read at their source coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column(1))
            one, two = words.hashes(0), words.hashes(1)
            a, counts = _ints(block.column(2))
            n, p1, p2 = (_ints(block.column(i))[0] for i in (3, 4, 5))
            row = np.repeat(np.arange(words.n_docs), counts)
            path = np.repeat(np.arange(len(a)), n)
            off = np.arange(len(path)) - np.repeat(np.cumsum(n) - n, n)
            at = (words.first[row] + a)[path] + off
            yield pa.RecordBatch.from_arrays(
                [signed(Spans(one, _FIRST)(at, at + window)), signed(Spans(two, _SECOND)(at, at + window)),
                 block.column(0).take(pa.array(row[path])), pa.array(p1[path]), pa.array(p2[path]),
                 pa.array(off.astype(np.int32))], ["e1", "e2", "doc_id", "p1", "p2", "off"])

    return reads.mapInArrow(run, "e1 long, e2 long, doc_id long, p1 long, p2 long, off int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, key, starts, sizes): runs of edges of a row that an earlier document has too.

    A run covers ``size + window - 1`` words from word ``start``.  ``key`` is the hash of the text.
    """
    base = _base(docs, id_col, text_col)
    all_paths = cut_lineage(paths(base, window, anchor))
    # What a join looks up is written first: joined in the stage that aggregates it, a popular key could not be split.
    repeated = cut_lineage(all_paths.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where(
        "lo < hi").select("anchor"))
    found = cut_lineage(all_paths.join(repeated, "anchor", "left_semi"))
    kinds = cut_lineage(found.groupBy("anchor", "p1", "p2", "n").agg(F.min(F.struct("doc_id", "key", "a")).alias("source")))
    branching = cut_lineage(kinds.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("branches")))
    kinds = cut_lineage(kinds.join(branching, "anchor").select(
        "p1", "p2", "n", "branches", "source.doc_id", "source.key", "source.a"))
    reads = kinds.where("branches").groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("a", "n", "p1", "p2")).alias("p"))
    # Repeated rows are one text here: its edges are known once, and its runs are kept once.
    reads = base.dropDuplicates(["doc_id", "key"]).join(reads.hint("shuffle_hash"), ["doc_id", "key"]).select(
        "doc_id", "text", "p.a", "p.n", "p.p1", "p.p2")
    edges = cut_lineage(_edges(reads, window))
    first = cut_lineage(edges.groupBy("e1", "e2").agg(F.min("doc_id").alias("lo")))
    split = edges.join(first, ["e1", "e2"]).groupBy("p1", "p2").agg(
        F.collect_list(F.struct("off", F.lit(1).alias("size"), "lo")).alias("known"))
    whole = kinds.where("not branches").select(
        "p1", "p2", F.array(F.struct(F.lit(0).alias("off"), F.col("n").alias("size"), F.col("doc_id").alias("lo"))).alias("known"))
    # Paths whose edges are all in their own first document decide nothing for it.
    claims = found.join(cut_lineage(whole.union(split)), ["p1", "p2"]).select(
        "doc_id", "key", F.expr("filter(transform(known, k -> struct(a + k.off AS start, k.size AS size, k.lo AS lo)), "
                                "k -> k.lo < doc_id)").alias("runs")).where("size(runs) > 0")
    return claims.groupBy("doc_id", "key").agg(F.flatten(F.collect_set("runs")).alias("r")).select(
        "doc_id", "key", F.col("r.start").alias("starts"), F.col("r.size").alias("sizes"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words of spans an earlier document has.

    Earlier is a smaller doc_id; rows with one doc_id do not remove from each other, and rows
    without one neither remove nor lose words.  ``kept`` holds the words that stay, joined by one
    blank.  A null or empty text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column(1))
            start, counts = _ints(block.column(2))
            size, _ = _ints(block.column(3))
            edge = np.zeros(len(words) + 1, dtype=np.int32)
            at = np.repeat(words.first[:-1], counts) + start
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size + window - 1, -1)
            stays = np.cumsum(edge[:-1]) == 0
            out, begin, end = words.joined(stays)
            text = out.tobytes()
            before = np.r_[0, np.cumsum(stays)]
            lo, hi = before[words.first[:-1]], before[words.first[1:]]
            kept = [text[begin[i]:end[j - 1]] if j > i else b"" for i, j in zip(lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(words.count.astype(np.int64)), pa.array(words.count - (hi - lo)),
                 pa.array(kept, type=pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    base = _base(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col, window, anchor)
    rows = base.join(spans.hint("shuffle_hash"), ["doc_id", "key"], "left").select("doc_id", "text", "starts", "sizes")
    unnamed = docs.where(F.col(id_col).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("sizes"))
    return rows.union(unnamed).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
