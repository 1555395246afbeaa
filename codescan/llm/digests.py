"""Document fingerprints: a quartile bucket digest.

Byte triplets of a sliding window of five bytes are hashed to 256 buckets and counted.  The digest is
the length on a log scale, the ratios of the quartiles of the counts, and two bits for each
bucket: which quartile its count is in.  Equal texts have equal digests, similar texts similar ones.
The likeness of two digests is 1 less their bounded difference score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codescan.llm.words import blocks, text_bytes
from codescan.session import cut_lineage

BUCKETS = 256
# Places of the three bytes in the window of five.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
MOST = 416  # difference of the buckets of two unrelated digests: 1.625 each on average
LENGTH_STEP = np.log(1.1)


def digest_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 3 + 256 small numbers for each text: length, two quartile ratios, and the buckets' quartiles."""
    n = len(offsets) - 1
    counts = np.zeros(n * BUCKETS, dtype=np.int64)
    doc = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offsets))
    wide = data.astype(np.uint32)
    for salt, (a, b, c) in enumerate(TRIPLETS, 1):
        if len(data) <= c:
            continue
        m = len(data) - c
        code = (wide[a:a + m] << np.uint32(16)) | (wide[b:b + m] << np.uint32(8)) | wide[c:c + m]
        code = (code + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
        bucket = doc[:m] + (code >> np.uint32(24))
        counts += np.bincount(bucket[doc[:m] == doc[c:]], minlength=len(counts))
    counts = counts.reshape(n, BUCKETS)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, i, None] for i in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    size = np.diff(offsets)
    length = np.minimum(np.floor(np.log1p(size) / LENGTH_STEP), 255).astype(np.uint8)
    top = np.maximum(q3[:, 0], 1)
    ratios = np.stack([q1[:, 0] * 100 // top % 16, q2[:, 0] * 100 // top % 16], axis=1).astype(np.uint8)
    return np.concatenate([length[:, None], ratios, codes.astype(np.uint8)], axis=1)


def encode(digests: np.ndarray) -> list[str]:
    """Digests as hex: length, ratios, four buckets a byte."""
    codes = digests[:, 3:].reshape(len(digests), -1, 4)
    packed = codes[:, :, 0] | codes[:, :, 1] << 2 | codes[:, :, 2] << 4 | codes[:, :, 3] << 6
    head = np.stack([digests[:, 0], digests[:, 1] << 4 | digests[:, 2]], axis=1)
    return [row.tobytes().hex() for row in np.concatenate([head, packed.astype(np.uint8)], axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for digests that differ as unrelated ones do, or more."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    gap = np.abs(a - b)
    buckets = gap[:, 3:]
    score = (buckets + 3 * (buckets == 3)).sum(axis=1)  # from the lowest to the highest quartile counts 6
    score += np.where(gap[:, 0] <= 1, gap[:, 0], 12 * gap[:, 0])
    around = np.minimum(gap[:, 1:3], 16 - gap[:, 1:3])
    score += np.where(around <= 1, around, 12 * (around - 1)).sum(axis=1)
    return np.maximum(0.0, 1.0 - score / MOST)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row's whole text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(encode(digest_bytes(*text_bytes(block.column(1)))))], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _cuts_up_to(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are not above the value, by binary search; none for null."""
    if not cuts:
        return F.lit(0)
    table = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(cuts)) & (F.get(table, at + step - 1) <= value), at + step).otherwise(at))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(part, tail, doc_id, key, text), dealt by part and sorted in it: each document is followed by the next one.

    Order is by doc_id, then by the text's hash; rows without doc_id come first.  The first rows of a
    part also stand at the end of the part before (``tail`` 1), those of the first at the end of the last.
    Texts are shuffled once; parts are ranges of doc_id with about equally many rows.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * tasks  # several parts a task, so that tasks are alike
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    cuts = sorted({int(c) for c in docs.select(F.col(id_col).cast("double").alias("v")).approxQuantile(
        "v", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    rows = rows.withColumn("part", _cuts_up_to(F.col("doc_id"), cuts))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    ids = ids.withColumn("part", _cuts_up_to(F.col("doc_id"), cuts))
    # A row for each part, so one task may hold them all.
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    firsts = ids.groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    firsts = firsts.withColumn("before", F.coalesce(F.lag("part").over(order), F.max("part").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    firsts = cut_lineage(firsts.select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"), "before"))
    heads = rows.join(F.broadcast(firsts), rows["doc_id"].eqNullSafe(firsts["_id"]) & (rows["key"] == firsts["_key"]), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("part"), F.lit(0).alias("tail")))).otherwise(
        F.array(F.struct(F.col("part"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("part"), F.lit(1).alias("tail"))))
    heads = heads.select(F.explode(places).alias("p"), "doc_id", "key", "text")
    rows = heads.select("p.part", "p.tail", "doc_id", "key", "text")
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "tail", "doc_id", "key")


def edit_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has its last quarter of code points (rounded down) replaced by the first as
    many of the next document, or by all it has; the document after the last is the first.  A null
    text is empty; a single document is its own next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for block in blocks(batches):
            if held is not None:
                block = pa.Table.from_batches([held, block]).combine_chunks().to_batches()[0]
            held = block.slice(block.num_rows - 1)
            if block.num_rows < 2:
                continue
            own = digest_bytes(*text_bytes(block.column(4)))
            part, tail = block.column(0).to_numpy(), block.column(1).to_numpy()
            # The last row of a part is a tail; tails beyond the first are equal rows.
            at = np.flatnonzero((tail[:-1] == 0) & (part[1:] == part[:-1]))
            texts = [t or "" for t in block.column(4).to_pylist()]
            edited = []
            for i in at:
                text = texts[i]
                n = len(text) // 4
                edited.append(text[:len(text) - n] + texts[i + 1][:n])
            if not len(at):
                continue
            after = pa.array(edited)
            other = digest_bytes(*text_bytes(after))
            yield pa.RecordBatch.from_arrays(
                [block.column(2).take(pa.array(at)), pa.array([len(texts[i]) for i in at], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(encode(own[at])),
                 pa.array(encode(other)), pa.array(likeness(own[at], other)), pa.array(likeness(own[at], own[at + 1]))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return beside_next(docs, id_col, text_col, parts).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
