"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over whole texts.

The windows of the test items are hashed; each task holds the sorted hashes and finds the
document windows that are among them, then compares the words themselves.  Only a set of a
checked size is broadcast: a larger one is cut into blocks by hash, and the documents pass
through one scan after the other, which adds to what is known of a row without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescan.llm.words import ALNUM, Spans, Words, blocks, signed
from codescan.session import cut_lineage

SIZE = 10
BLOCK_WINDOWS = 200_000  # windows of one broadcast set; an item's words are some 100 bytes a window
BLOCK_BYTES = 64 << 20  # of their words
SEEN = "struct<at:array<int>,upto:array<int>,items:array<string>>"


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE,
                 least: int = 1) -> DataFrame:
    """(hash, size, gram, items): each different window and the items it is in.

    An item of fewer than ``size`` words is one window; one of fewer than ``least`` words has
    none, nor has a null text.  An item without an id is the item ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column(1), ALNUM, lower=True)
            long = np.repeat(words.count >= least, words.count)
            start = np.flatnonzero(words.windows(size) & long)
            short = words.first[:-1][(words.count > 0) & (words.count < size) & (words.count >= least)]
            doc = words.doc()
            end = np.r_[start + size, words.first[1:][doc[short]]]
            start = np.r_[start, short]
            data, begin, hole = words.joined()
            text = data.tobytes()
            grams = [text[i:j] for i, j in zip(begin[start], hole[end - 1])] if len(start) else []
            yield pa.RecordBatch.from_arrays(
                [signed(Spans(words.hashes())(start, end)), pa.array((end - start).astype(np.int32)),
                 pa.array(grams, type=pa.binary()), block.column(0).take(pa.array(doc[start]))],
                ["hash", "size", "gram", "item"])

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                             F.col(text_col).alias("text"))
    grams = items.mapInArrow(run, "hash long, size int, gram binary, item string")
    return grams.groupBy("hash", "size", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


class HashSet:
    """A block of windows as sorted hashes by window size."""

    def __init__(self, table: pa.Table):
        code = table.column("hash").to_numpy().view(np.uint64)
        size = table.column("size").to_numpy()
        self.grams = table.column("gram").to_pylist()
        self.items = table.column("items").to_pylist()
        self.sizes = {}
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            rows = rows[np.argsort(code[rows], kind="stable")]
            self.sizes[int(n)] = code[rows], rows

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, int, list[str]]]:
        """(text, first word, word after the last, items) of every window that occurs."""
        words = Words(texts, ALNUM, lower=True)
        if not len(words):
            return
        data, begin, hole = words.joined()
        spans, doc = Spans(words.hashes()), words.doc()
        for n, (codes, rows) in self.sizes.items():
            start = np.flatnonzero(words.windows(n))
            code = spans(start, start + n)
            at = np.searchsorted(codes, code)
            found = np.flatnonzero(codes[np.minimum(at, len(codes) - 1)] == code)
            for i, k in zip(start[found].tolist(), at[found].tolist()):
                text, own = data[begin[i]:hole[i + n - 1]].tobytes(), codes[k]
                while k < len(codes) and codes[k] == own:
                    if self.grams[rows[k]] == text:
                        first = int(words.first[doc[i]])
                        yield int(doc[i]), i - first, i - first + n, self.items[rows[k]]
                    k += 1


def _sets(windows: DataFrame, limit: int) -> Iterator[HashSet]:
    """The windows in blocks of about ``limit`` windows and ``BLOCK_BYTES``, each brought to the driver to be broadcast."""
    windows = cut_lineage(windows)
    n, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("gram")), F.lit(0))).first()
    parts = max(1, -(-n // limit), -(-size // BLOCK_BYTES))
    for part in range(parts):
        block = windows.where(F.pmod("hash", F.lit(parts)) == part) if parts > 1 else windows
        table = block.toArrow()
        if table.num_rows:
            yield HashSet(table)


def _scan(rows: DataFrame, found: HashSet, text_col: str, seen: str) -> DataFrame:
    """Adds to the column ``seen`` of each row what this block of windows hits."""
    at_text, at_seen = rows.columns.index(text_col), rows.columns.index(seen)
    kind = pa.struct([("at", pa.list_(pa.int32())), ("upto", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            known = block.column(at_seen).to_pylist()
            for doc, at, upto, items in found.hits(block.column(at_text)):
                mine = known[doc] = known[doc] or {"at": [], "upto": [], "items": []}
                if mine["upto"] and mine["at"][-1] <= at <= mine["upto"][-1] <= upto:
                    mine["upto"][-1] = upto  # goes on with the last run
                else:
                    mine["at"].append(at)
                    mine["upto"].append(upto)
                mine["items"] = sorted({*mine["items"], *items})
            yield block.set_column(at_seen, seen, pa.array(known, type=kind))

    return rows.mapInArrow(run, rows.schema)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", seen: str = "hits", size: int = SIZE,
         least: int = 1, limit: int = BLOCK_WINDOWS, bench_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """docs with a column ``seen``: runs of hit words [at, upto) and the items hit; null if there are none."""
    rows = docs.withColumn(seen, F.lit(None).cast(SEEN))
    for i, found in enumerate(_sets(item_windows(benchmark, bench_id, bench_text, size, least), limit)):
        # Rows are written between blocks, so driver and tasks hold one block at a time.
        rows = _scan(cut_lineage(rows) if i else rows, found, text_col, seen)
    return rows


def hit_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each row: words, words inside occurring windows, items that occur.

    A null text has no words; repeated rows are reported as often as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column(1), ALNUM, lower=True)
            n_hit, items = np.zeros(words.n_docs, dtype=np.int64), [[]] * words.n_docs
            for i, mine in enumerate(block.column(2).to_pylist()):
                if mine:
                    n_hit[i] = covered(mine, int(words.count[i])).sum()
                    items[i] = mine["items"]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(words.count.astype(np.int64)), pa.array(n_hit),
                 pa.array(items, type=pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return scan(rows, benchmark, **options).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_hit long, items array<string>")


def covered(seen: dict, n_words: int) -> np.ndarray:
    """Which words of a text lie in its hit runs."""
    edge = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(edge, seen["at"], 1)
    np.add.at(edge, seen["upto"], -1)
    return np.cumsum(edge[:-1]) > 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents",
                  **options) -> DataFrame:
    """docs without test passages, with the columns they had; no row is shuffled.

    ``remove="documents"`` drops a row with any hit.  ``remove="spans"`` keeps all rows and cuts
    the bytes from the first to the last word of each hit run out of the text.
    """
    seen = "hits"
    while seen in docs.columns:
        seen += "_"
    rows = scan(docs, benchmark, text_col, seen, **options)
    if remove == "documents":
        return rows.where(F.col(seen).isNull()).drop(seen)
    at_text, at_seen = rows.columns.index(text_col), rows.columns.index(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            texts, hits = block.column(at_text), block.column(at_seen).to_pylist()
            words, values = Words(texts, ALNUM, lower=True), texts.to_pylist()
            for i, mine in enumerate(hits):
                if mine:
                    own = covered(mine, int(words.count[i]))
                    turn = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                    base, data, last, kept = words.offsets[i], values[i].encode(), 0, []
                    for a, b in zip(turn[::2], turn[1::2]):
                        kept.append(data[last:words.start[words.first[i] + a] - base])
                        last = words.end[words.first[i] + b - 1] - base
                    values[i] = b"".join([*kept, data[last:]]).decode()
            yield block.set_column(at_text, text_col, pa.array(values, type=texts.type))

    return rows.mapInArrow(run, rows.schema).drop(seen)
