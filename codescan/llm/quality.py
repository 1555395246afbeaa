"""Quality by importance resampling.

Texts are bags of words and word pairs, with their capitals and punctuation, hashed to buckets.
One generative model is counted over the target texts, one over all raw texts; a text's log
weight is the log of the ratio of its probabilities under them.  Adding Gumbel noise and keeping the largest sums samples without
replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codescan.llm.words import U64, Words, blocks, mix
from codescan.session import cut_lineage

BUCKETS = 1 << 14
BLOCK_IDS = 1 << 20   # ids of target texts that are broadcast at once; more take one more scan each
FRACTION = 0.5        # share of the rows that is kept
PRIOR = 1000.0        # features of raw text that smooth the target model
SEED = 17


def _features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and every pair of neighbouring words."""
    doc, one = words.doc(), words.hashes()
    pair = np.flatnonzero(words.windows(2))
    both = mix(one[pair] * U64(3) + one[pair + 1]) if len(pair) else one[:0]
    code = np.concatenate([one, both])
    return np.concatenate([doc, doc[pair]]), (code % U64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every bucket over the target texts and over all texts: ``buckets`` rows, counted in Spark.

    Texts are not shuffled: the ids of target texts are broadcast, in blocks of a bounded size, and a scan counts the
    targets of a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for block in blocks(batches):
            wanted = block.column(1).to_numpy(zero_copy_only=False).astype(bool)
            doc, code = _features(Words(block.column(0)), buckets)
            raw += np.bincount(code, minlength=buckets)
            target += np.bincount(code[wanted[doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(target[at]), pa.array(raw[at])], ["bucket", "t", "r"])

    target, raw = np.zeros(buckets), np.zeros(buckets)
    parts = max(1, -(-target_ids.count() // BLOCK_IDS))
    for part in range(parts):
        ids = target_ids.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        ids = F.broadcast(ids.select(F.col("id").alias("_id"), F.lit(True).alias("_target")))  # bounded: a block of ids
        rows = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("text")).join(ids, F.col("_of") == F.col("_id"), "left")
        rows = rows.select("text", F.col("_target").isNotNull().alias("target"))
        table = rows.mapInArrow(run, "bucket long, t long, r long").groupBy("bucket").agg(
            F.sum("t").alias("t"), F.sum("r").alias("r")).toArrow()
        at = table.column("bucket").to_numpy()
        target[at] += table.column("t").to_numpy()
        raw[at] = table.column("r").to_numpy()
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the buckets' probabilities under the target over those under the raw model.

    ``PRIOR`` features of raw text count as target text too: what the target has not seen is
    unlikely under it, and without any target text all ratios are 1.
    """
    share = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + PRIOR * share) / (target.sum() + PRIOR)) - np.log(share)


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, gumbel_key) for each row; a text without words has weight 1.

    The noise comes from the doc_id and the text, so a recomputed task and equal rows agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            doc, code = _features(Words(block.column(1)), len(ratio))
            weight = np.bincount(doc, ratio[code], minlength=block.num_rows)
            noise = mix(block.column(2).to_numpy().view(U64) + U64(seed))
            uniform = ((noise >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(weight), pa.array(weight - np.log(-np.log(uniform)))],
                ["doc_id", "log_weight", "gumbel_key"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, log_weight double, gumbel_key double")


def kth_largest(rows: DataFrame, column: str, k: int, few: int = 10_000, bins: int = 4096) -> float:
    """The k-th largest value: histograms of ever narrower ranges, until ``few`` values are left."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        inside = rows.where(F.col(column).between(low, high))
        above, count = rows.agg(F.count_if(F.col(column) > high), F.count_if(F.col(column).between(low, high))).first()
        if low == high:
            return low
        if count <= few:
            values = np.sort(inside.select(column).toArrow().column(0).to_numpy())[::-1]
            return float(values[k - above - 1])
        step = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
        table = inside.groupBy(step.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for row in table:
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality: str = "quality",
             fraction: float = FRACTION, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) for each row; ``kept`` marks the sample.

    The target are all rows labelled with quality 1 (one good label suffices).  The sample holds the
    ``floor(fraction * rows)`` largest keys; rows that tie with the last of them are kept too.
    Without target rows all weights are about equal and the sample is plain.
    """
    good = cut_lineage(labels.where((F.col(quality) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct())
    ratio = log_ratio(*bucket_counts(docs, good, id_col, text_col, buckets))
    rows = cut_lineage(log_weights(docs, ratio, id_col, text_col, seed))
    k = int(rows.count() * fraction)
    last = kth_largest(rows, "gumbel_key", k) if k else float("inf")
    return rows.withColumn("kept", F.col("gumbel_key") >= last)
