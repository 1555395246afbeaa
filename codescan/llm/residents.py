"""Vector code compression: codebooks for the parts of vectors by member-resident Lloyd rounds.

A part of a vector is a member of the entry of its codebook that is nearest.  Members lie in a
table bucketed by (position, entry, salt), so the owner of an entry finds its members where they are:

1. It sums its resident members, without a shuffle; a row for each entry is all that is gathered.
2. It compares its members with the new entries.  Those that stay are written where they lie.
3. Only parts that change their entry are shuffled, into the buckets of the new one.

The salt is a hash of the row, with as many values as keep any owner's share bounded,
also where most parts are members of one entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescan.session import cut_lineage, work_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MEMBERS = 20_000  # of one owner, about
ROWS = 4096  # that are compared at once
OWNER = ["position", "entry", "salt"]


@dataclass
class Codebooks:
    """``entries[i]`` has the entries of part i, one row each."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.reshape(-1).tolist()).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of each part; of equal ones the first."""
    index, distance = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
    reach = int(np.abs(parts).max(initial=0)) + int(np.abs(entries).max(initial=0))
    exact = parts.shape[1] * reach**2 < 2**52  # whole numbers below 2**53 are exact as doubles
    if exact:
        e = entries.astype(np.float64)
        norms, e = (e**2).sum(axis=1), -2 * e.T
    step = ROWS if exact else max(1, ROWS * 64 // max(entries.size, 1))
    for at in range(0, len(parts), step):
        block = parts[at:at + step]
        if exact:
            block = block.astype(np.float64)
            all_of = block @ e + norms + (block**2).sum(axis=1)[:, None]
        else:
            all_of = ((block[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        index[at:at + step] = best = all_of.argmin(axis=1)
        distance[at:at + step] = all_of[np.arange(len(best)), best].astype(np.int64)
    return index, distance


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """((row, vec_id, label, v), length of v): finite vectors of the most frequent length, as whole numbers.

    A component x is floor(1024 * x).  Beyond what keeps squared distances in 64 bits (2**27 for 64
    components) it is set to that bound.
    """
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).where(
        F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    common = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = common["n"] if common else 0
    bound = float(2 ** min(30, (62 - max(length, 1).bit_length()) // 2 - 1))
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-bound)), F.lit(bound))).cast("int"))
    # The row number is stored, so it is the same for whatever reads it.
    return cut_lineage(kept.where(F.size("v") == length).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("v"))), length


def _deal(rows: DataFrame, table: str, buckets: int) -> None:
    rows.write.mode("append").partitionBy("moved").bucketBy(buckets, *OWNER).format("parquet").saveAsTable(table)


def _entries(members: DataFrame, old: Codebooks) -> Codebooks:
    """Each entry as the floor of its members' mean; one without members stays.  A row for each entry is gathered."""
    widths = [e.shape[1] for e in old.entries]
    names = [f"s{i}" for i in range(max(widths))]
    owned = members.groupBy(*OWNER).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("part", F.lit(i)).cast("long")).alias(s) for i, s in enumerate(names)])
    new = [e.copy() for e in old.entries]
    for r in owned.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect():
        p = r["position"]
        new[p][r["entry"]] = [r[s] // r["n"] for s in names[:widths[p]]]
    return Codebooks(new)


def fit(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(members in the buckets of the last round, codebooks) of the rows of ``whole_vectors``."""
    spark = rows.sparkSession
    cuts = [i * length // parts for i in range(parts + 1)]
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # bounded by the size of a codebook
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), length)
    books = Codebooks([start[:, a:b] for a, b in zip(cuts, cuts[1:])])
    salts = max(1, math.ceil(rows.count() / MEMBERS))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    widths = [b - a for a, b in zip(cuts, cuts[1:])]

    cut = F.array(*[F.slice("v", a + 1, b - a) for a, b in zip(cuts, cuts[1:])])
    members = rows.select("row", "vec_id", "label", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"),
                          F.posexplode(cut).alias("position", "part"))
    placed = _placed(members, books).drop("distance")
    name = work_table(spark, "residents")
    _deal(placed.withColumn("moved", F.lit(False)).repartition(buckets, *OWNER), name, buckets)
    schema = placed.schema
    for turn in range(rounds):
        members = spark.table(name).where("not moved")
        books = _entries(members, books)
        if turn == rounds - 1:
            break
        current = books.entries

        def compare(table: pa.Table) -> pa.Table:
            """The members of one owner with the entry they belong to now."""
            position = table.column("position")[0].as_py()
            index, _ = nearest(_matrix(table.column("part"), widths[position]), current[position])
            return table.append_column("goes_to", pa.array(index.astype(np.int32)))

        columns = [f.name for f in schema]
        dealt = members.select(*columns).groupBy(*OWNER).applyInArrow(
            compare, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", goes_to int")
        after = work_table(spark, "residents")
        _deal(dealt.withColumn("moved", F.expr("goes_to <> entry")), after, buckets)
        movers = spark.table(after).where("moved").select(
            *[F.col("goes_to").alias(c) if c == "entry" else F.col(c) for c in columns], "goes_to", F.lit(False).alias("moved"))
        _deal(movers.repartition(buckets, *OWNER), after, buckets)
        spark.sql(f"DROP TABLE {name}")
        name = after
    return spark.table(name).where("not moved").select(*[f.name for f in schema]), books


def _placed(members: DataFrame, books: Codebooks) -> DataFrame:
    """Members (…, position, part) with their nearest entry and its distance."""
    entries = books.entries
    names = [c for c in members.columns if c not in ("entry", "distance")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column(names.index("position")).to_numpy()
            part = batch.column(names.index("part"))
            index, distance = np.zeros(len(position), dtype=np.int64), np.zeros(len(position), dtype=np.int64)
            for p in np.unique(position).tolist():
                own = np.flatnonzero(position == p)
                index[own], distance[own] = nearest(_matrix(part.take(pa.array(own)), entries[p].shape[1]), entries[p])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(index.astype(np.int32)), pa.array(distance)], [*names, "entry", "distance"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.select(*names).schema)
    return members.select(*names).mapInArrow(run, f"{kinds}, entry int, distance long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error), codebooks): each vector as the indexes of its parts' nearest entries.

    Rows without a vector, or with a null, NaN or infinite component, are dropped, as are vectors whose length
    is not the most frequent one (of equally frequent ones the greater).  A vector is cut at i * length // parts.
    The codebooks start with the vectors of the least ids, nulls last and equal ids by their vectors; a
    table with fewer rows has fewer entries.  Rows without an id or with one that others have are rows like any other.
    An empty table has no codes and empty codebooks.  Other columns do not matter.
    """
    rows, length = whole_vectors(vectors, id_col, vec_col, label_col)
    members, books = fit(rows, length, parts, entries, rounds)
    final = _placed(members.select("row", "vec_id", "label", "position", "part"), books)
    at = lambda p: F.max(F.when(F.col("position") == p, F.col("entry")))
    coded = final.groupBy("row").agg(
        F.first("vec_id").alias("vec_id"), F.first("label").alias("label"),
        F.array(*[at(p) for p in range(parts)]).alias("code"), F.sum("distance").alias("error"))
    return cut_lineage(coded.drop("row")), books


def restore(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, vector): the vectors that codes stand for, as doubles of the scale they had."""
    spark: SparkSession = codes.sparkSession
    table = spark.createDataFrame(
        [(p, i, [v / SCALE for v in row]) for p, e in enumerate(books.entries) for i, row in enumerate(e.tolist())],
        "position int, entry int, part array<double>")
    rows = codes.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "vec_id", F.posexplode("code").alias("position", "entry"))
    # Bounded: a codebook's rows.
    return each.join(F.broadcast(table), ["position", "entry"]).groupBy("row").agg(
        F.first("vec_id").alias("vec_id"), F.array_sort(F.collect_list(F.struct("position", "part"))).alias("p")).select(
        "vec_id", F.flatten("p.part").alias("vector"))
