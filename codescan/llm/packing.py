"""Packing into length buckets.

The global histogram of sequence lengths (at most ``max_len + 1`` rows) goes to the driver, where
dynamic programming chooses the bucket lengths that pad least.  Inside a bucket, batches hold as
many sequences as a token budget allows.  Batch numbers are global, yet no bucket is sorted in one
task: sequences are dealt to shards of bounded size and a shard's first number is the sum of
the shards before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codescan.llm.words import Words, blocks
from codescan.session import cut_lineage

MAX_LEN, BUCKETS, BUDGET = 2048, 8, 65_536
SHARD_ROWS = 50_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): words of each whole text; null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            n = Words(block.column(1)).count.astype(np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def sequences(lengths: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens): a longer text is cut into pieces of ``max_len``, none is dropped."""
    last = F.greatest(F.ceil(F.col("n_tokens") / max_len) - 1, F.lit(0)).cast("long")
    rows = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("piece") * max_len
    return rows.select("doc_id", "piece", first.alias("first_token"),
                       F.least(F.col("n_tokens") - first, F.lit(max_len)).cast("long").alias("n_tokens"))


def bucket_lengths(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` bucket lengths that pad least when every length goes to the next one up.

    Of equal choices the one with the shorter first buckets.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    n = len(lengths)
    if not n:
        return []
    rows, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    # best[j]: least padding of the j shortest lengths with the buckets so far; a bucket i..j pads to lengths[j - 1].
    best = np.r_[0.0, np.full(n, np.inf)]
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return sorted(set(out))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS,
         budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bucket, bucket_len, batch, slot): one row for each sequence.

    A batch of a bucket holds ``budget // bucket_len`` sequences (one at least), padded to
    ``bucket_len``; only the last batch of a bucket may hold fewer.  Texts without words are sequences of
    length 0 in the first bucket.  Sequences are numbered in the order of a hash, so a batch mixes
    sources; repeated rows are sequences of their own.
    """
    rows = cut_lineage(sequences(word_counts(docs, id_col, text_col), max_len))
    seen = rows.groupBy("n_tokens").count().toArrow()  # max_len + 1 rows at most
    lengths, counts = seen.column("n_tokens").to_numpy(), seen.column("count").to_numpy()
    chosen = bucket_lengths(lengths, counts, buckets) or [max_len]
    shards = max(1, -(-int(counts.sum()) // shard_rows))
    bucket = F.lit(len(chosen) - 1)
    for i in range(len(chosen) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= chosen[i], i).otherwise(bucket)
    size = F.element_at(F.array(*map(F.lit, chosen)), F.col("bucket") + 1).cast("long")
    # The text's length breaks ties of rows with one doc_id; equal rows are as good as each other.
    rows = rows.withColumn("bucket", bucket).withColumn("_hash", F.xxhash64("doc_id", "piece", "n_tokens"))
    rows = rows.withColumn("_shard", F.pmod("_hash", F.lit(shards)))
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("bucket", "_shard").count().withColumn(
        "_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("bucket", "_shard").orderBy("_hash", "doc_id", "piece", "n_tokens")
    rows = rows.withColumn("_own", F.row_number().over(own) - 1).join(starts, ["bucket", "_shard"])
    number, each = F.col("_start") + F.col("_own"), F.greatest(F.floor(F.lit(budget) / F.greatest(size, F.lit(1))), F.lit(1))
    return rows.select("doc_id", "piece", "first_token", "n_tokens", "bucket", size.alias("bucket_len"),
                       F.floor(number / each).alias("batch"), F.pmod(number, each).alias("slot"))
