"""Ranked lexical search with exact results over posting lists cut into blocks of similar documents.

Documents are clustered around a bounded sample of them and dealt to chunks of similar documents.
In a chunk the posting list of a term is cut into blocks of neighbours, and each block stores a summary:
for every coordinate (term) the greatest value that any of its documents has.

A query is a block of items, and its vocabulary is what documents are read by:

1. The documents that hold the rarest terms of an item are scored; the tenth best is a floor
   below which no document can be among the first ten.
2. Terms whose greatest values together stay below the floor are not essential: a document with
   no other term cannot reach it.  Only lists of essential terms are indexed.
3. A block is skipped if the item's weights times its summary stay below the floor.  The documents of all other
   blocks are scored in full.

All scores are whole numbers, so bounds are exact and no document is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codescan.llm.words import ALNUM, LOWER, Words, blocks
from codescan.session import cut_lineage, work_table

BEST = 10  # documents of an item
VOCABULARY = 8192  # terms of a block of items, more only if one item has more
ITEMS = 2048  # of a block
CENTRES = 256  # documents that others are clustered around: a sample of fixed size
CHUNK = 4096  # documents that are indexed together, about
BLOCK = 32  # documents of a posting list with one summary
SEEDS = 100  # places in the rarest lists of an item that are scored first
PLANES = 32


def tokens(text: str | None) -> list[bytes]:
    """Terms of one text: runs of ASCII letters, digits and all that is not ASCII, A-Z lower-cased."""
    data = LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    return bytes(np.where(ALNUM[data], data, 0x20).astype(np.uint8)).split(b" ")


@dataclass
class Questions:
    """A block of items: their ids, and for each the numbers of its terms and how often it has them."""

    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    one: np.ndarray  # two hashes of every term of the vocabulary, sorted by the first
    two: np.ndarray


def _questions(batch: list[tuple[object, Counter]]) -> Questions:
    words = sorted(set().union(*(c for _, c in batch)))
    hashed = Words(pa.array([b"\n".join(words).decode(errors="surrogateescape")]), ALNUM) if words else None
    one, two = (hashed.hashes(s) for s in (0, 1)) if words else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    order = np.argsort(one, kind="stable")
    number = dict(zip([words[i] for i in order.tolist()], range(len(words))))
    terms = [np.array(sorted(number[w] for w in c), dtype=np.int64) for _, c in batch]
    by = [{number[w]: k for w, k in c.items()} for _, c in batch]
    return Questions([i for i, _ in batch], terms, [np.array([b[t] for t in ts.tolist()], dtype=np.int64) for b, ts in zip(by, terms)],
                     one[order], two[order])


def question_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Questions]:
    """The items, a block of bounded size at a time."""
    batch, words = [], set()
    for item, text in items.select(id_col, text_col).toLocalIterator():
        counted = Counter(w for w in tokens(text) if w)
        if batch and (len(batch) == ITEMS or len(words | counted.keys()) > VOCABULARY):
            yield _questions(batch)
            batch, words = [], set()
        batch.append((item, counted))
        words |= counted.keys()
    if batch:
        yield _questions(batch)


def term_vectors(docs: DataFrame, asked: Questions, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n, terms, tf): words of each document, and how often it has which terms of the vocabulary."""
    one, two = asked.one, asked.two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column(2), ALNUM, lower=True)
            first, second = words.hashes(0), words.hashes(1)
            at = np.minimum(np.searchsorted(one, first), max(len(one) - 1, 0))
            known = (one[at] == first) & (two[at] == second) if len(one) else np.zeros(len(first), dtype=bool)
            pair, tf = np.unique(words.doc()[known] * np.int64(max(len(one), 1)) + at[known], return_counts=True)
            doc, term = pair // max(len(one), 1), pair % max(len(one), 1)
            offsets = pa.array(np.searchsorted(doc, np.arange(words.n_docs + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(words.count.astype(np.int64)), *lists],
                                             ["doc_id", "key", "n", "terms", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, key long, n long, terms array<int>, tf array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(counts)].astype(np.int64)


def _segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0, dtype=values.dtype)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start up to its end, and where each range begins among them."""
    size = end - start
    offsets = np.r_[0, np.cumsum(size)]
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, size), offsets


def _values(tf: np.ndarray, n: np.ndarray, counts: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What a term is worth in a document, before its weight."""
    m = 100 - 75 + (75 * n * n_docs) // n_words
    return (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, counts))


def _placed(vectors: DataFrame, n_docs: int, n_words: int, weight: np.ndarray) -> DataFrame:
    """(doc_id, key, terms, value, cluster, code): the nearest centre of each document, and its side of random planes."""
    some = vectors.where("size(terms) > 0").orderBy(F.xxhash64("terms", "tf"), "key").limit(CENTRES).collect()  # a sample of fixed size
    axes = np.zeros((len(weight), CENTRES + PLANES), dtype=np.float32)
    for i, r in enumerate(some):
        tf = np.array(r["tf"], dtype=np.int64)
        v = (_values(tf, np.array([r["n"]]), np.array([len(tf)]), n_docs, n_words) * weight[r["terms"]]).astype(np.float32)
        axes[r["terms"], i] = v / max(float(np.linalg.norm(v)), 1.0)
    axes[:, CENTRES:] = np.random.default_rng(13).choice([-1.0, 1.0], (len(weight), PLANES))
    bits = (np.int64(1) << np.arange(PLANES - 1, -1, -1, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                terms, offsets = _lists(batch.column(3))
                tf, _ = _lists(batch.column(4))
                value = _values(tf, batch.column(2).to_numpy(), np.diff(offsets), n_docs, n_words)
                seen = (value * weight[terms]).astype(np.float32) / np.float32(1e9)
                size = np.diff(offsets)
                sides = np.zeros((batch.num_rows, axes.shape[1]), dtype=np.float32)
                for d in np.flatnonzero(size).tolist():
                    own = slice(offsets[d], offsets[d + 1])
                    sides[d] = seen[own] @ axes[terms[own]]
                cluster = sides[:, :CENTRES].argmax(axis=1).astype(np.int32)
                code = ((sides[:, CENTRES:] > 0) * bits).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(3),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(value.astype(np.int32))), pa.array(cluster), pa.array(code)],
                    ["doc_id", "key", "terms", "value", "cluster", "code"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"doc_id {kind}, key long, terms array<int>, value array<int>, cluster int, code long")


def _chunked(placed: DataFrame) -> DataFrame:
    """Adds chunk: clusters are cut, and small ones put together, so that a chunk has about ``CHUNK`` documents."""
    sizes = placed.groupBy("cluster").count().orderBy("cluster").collect()  # a row for each centre
    rows, number, room = [], 0, 0
    for r in sizes:
        if r["count"] > CHUNK:
            many = math.ceil(r["count"] / CHUNK)
            rows.append((r["cluster"], number + 1, many))
            number, room = number + many, 0
        else:
            if room < r["count"]:
                number, room = number + 1, CHUNK
            rows.append((r["cluster"], number, 1))
            room -= r["count"]
    table = placed.sparkSession.createDataFrame(rows, "cluster int, base int, many int")
    # Bounded: a row for each centre.
    return placed.join(F.broadcast(table), "cluster").withColumn(
        "chunk", (F.col("base") + F.pmod(F.xxhash64("key"), F.col("many"))).cast("int")).drop("base", "many")


def _best_of(rows: DataFrame) -> DataFrame:
    """The first ten (doc_id, score) of each item, with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


class _Scorer:
    """Scores of documents, given as rows of (terms, value), for one item after another."""

    def __init__(self, terms: np.ndarray, value: np.ndarray, offsets: np.ndarray, weight: np.ndarray):
        self.terms, self.worth, self.offsets, self.size = terms, value * weight[terms], offsets, len(weight)

    def __call__(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        factor = np.zeros(self.size, dtype=np.int64)
        factor[terms] = times
        at, offsets = _ranges(self.offsets[docs], self.offsets[docs + 1])
        return _segment_sums(self.worth[at] * factor[self.terms[at]], offsets)


def _first_best(score: np.ndarray, least: int) -> np.ndarray:
    """Places of scores of at least ``least`` that are among the ten best, ties included."""
    good = np.flatnonzero((score >= least) & (score > 0))
    if len(good) > BEST:
        good = good[score[good] >= np.partition(score[good], -BEST)[-BEST]]
    return good


def _floors(placed: DataFrame, asked: Questions, df: np.ndarray, weight: np.ndarray) -> list[int]:
    """For each item a score that ten documents reach; 0 if fewer are known."""
    holders: list[list[int]] = [[] for _ in weight]
    for i, terms in enumerate(asked.terms):
        places = 0
        for t in sorted((t for t in terms.tolist() if df[t] and weight[t]), key=lambda t: (df[t], t)):
            holders[t].append(i)
            places += df[t]
            if places >= SEEDS:
                break
    starts = np.r_[0, np.cumsum([len(h) for h in holders])]
    flat = np.array([i for h in holders for i in h], dtype=np.int64)
    all_terms, all_times = asked.terms, asked.times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, offsets = _lists(batch.column(1))
            value, _ = _lists(batch.column(2))
            scorer = _Scorer(terms, value, offsets, weight)
            at, parts = _ranges(starts[terms], starts[terms + 1])
            doc = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(offsets)), np.diff(parts))
            pairs = np.unique(flat[at] * np.int64(batch.num_rows) + doc)
            item, doc = pairs // batch.num_rows, pairs % batch.num_rows
            cuts = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True]) if len(item) else np.zeros(1, dtype=np.int64)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = doc[i:j]
                score = scorer(own, all_terms[item[i]], all_times[item[i]])
                good = _first_best(score, 0)[:10 * BEST]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(good), item[i], dtype=np.int32)), batch.column(0).take(pa.array(own[good])), pa.array(score[good])],
                    ["item", "key", "score"])

    # Ties beyond a hundred of one batch are left out here: any ten documents make a floor.
    scored = placed.select("key", "terms", "value").mapInArrow(run, "item int, key long, score long")
    best = _best_of(scored.withColumn("doc_id", F.col("key")))
    found = best.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= BEST).collect()
    floors = [0] * len(asked.ids)
    for r in found:  # a row for each item of the block
        floors[r["item"]] = r["least"]
    return floors


def _essential(asked: Questions, floors: list[int], most: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """For each item the terms one of which a document must hold to reach the floor."""
    out = []
    for terms, times, floor in zip(asked.terms, asked.times, floors):
        worth = times * weight[terms] * most[terms]
        order = np.argsort(worth, kind="stable")
        keep = (np.cumsum(worth[order]) >= floor) & (worth[order] > 0)
        out.append(np.sort(terms[order[keep]]))
    return out


def _index(members: DataFrame, asked: Questions, essential: list[np.ndarray]) -> DataFrame:
    """(chunk, term, keys, terms, most): blocks of the lists of essential terms, with their summaries.

    A summary holds the coordinates that an item with the term has.
    """
    size = len(asked.one)
    listed = np.zeros(size, dtype=bool)
    together = np.zeros((size, size), dtype=bool) if len(asked.ids) > 1 else None
    for terms, chosen in zip(asked.terms, essential):
        listed[chosen] = True
        if together is not None:
            together[np.ix_(chosen, terms)] = True
    packed = np.packbits(together, axis=1) if together is not None else None

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("code", "ascending"), ("key", "ascending")])
        terms, offsets = _lists(table.column("terms"))
        value, _ = _lists(table.column("value"))
        keys = table.column("key").to_numpy()
        held = np.unpackbits(packed, axis=1, count=size).astype(bool) if packed is not None else None
        doc = np.repeat(np.arange(len(keys)), np.diff(offsets))
        # Posting lists in the order of the documents, cut into blocks.
        at = np.flatnonzero(listed[terms])
        at = at[np.argsort(terms[at], kind="stable")]
        term, doc = terms[at], doc[at]
        new = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, dtype=bool)
        place = np.arange(len(term)) - np.maximum.accumulate(np.where(new, np.arange(len(term)), 0))
        cuts = np.flatnonzero(place % BLOCK == 0)
        ends = np.r_[cuts[1:], len(term)] if len(cuts) else cuts
        out = {"chunk": [], "term": [], "keys": [], "terms": [], "most": []}
        chunk = table.column("chunk")[0].as_py()
        for i in range(0, len(cuts), 256):  # so many blocks at a time
            start, end = cuts[i:i + 256], ends[i:i + 256]
            post = np.arange(start[0], end[-1])
            block = np.repeat(np.arange(len(start)), end - start)
            where, parts = _ranges(offsets[doc[post]], offsets[doc[post] + 1])
            of = np.repeat(np.arange(len(post)), np.diff(parts))
            if held is not None:
                use = held[term[post][of], terms[where]]
                where, of = where[use], of[use]
            key = block[of] * np.int64(size) + terms[where]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            most = np.maximum.reduceat(value[where[order]], first)
            coords = key[first]
            upto = np.searchsorted(coords // size, np.arange(len(start) + 1)).astype(np.int32)
            out["chunk"].append(pa.array(np.full(len(start), chunk, dtype=np.int32)))
            out["term"].append(pa.array(term[start].astype(np.int32)))
            out["keys"].append(pa.ListArray.from_arrays(pa.array(np.r_[start, end[-1]].astype(np.int32) - np.int32(start[0])), pa.array(keys[doc[post]])))
            out["terms"].append(pa.ListArray.from_arrays(pa.array(upto), pa.array((coords % size).astype(np.int32))))
            out["most"].append(pa.ListArray.from_arrays(pa.array(upto), pa.array(most.astype(np.int32))))
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.table([pa.chunked_array(v, type=k) for v, k in zip(out.values(), kinds)], list(out))

    return members.groupBy("chunk").applyInArrow(run, "chunk int, term int, keys array<long>, terms array<int>, most array<int>")


def _search(members: DataFrame, index: DataFrame, asked: Questions, essential: list[np.ndarray], floors: list[int], weight: np.ndarray) -> DataFrame:
    """(item, doc_id, key, score): in each chunk the best documents of the blocks that are not skipped."""
    terms_of, times_of = asked.terms, asked.times
    kind = members.schema["doc_id"].dataType.simpleString()

    def run(docs: pa.Table, stored: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int32()), docs.column("doc_id").slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.int64())],
                        ["item", "doc_id", "key", "score"])
        if not docs.num_rows or not stored.num_rows:
            return none
        docs, stored = docs.sort_by("key"), stored.sort_by("term")
        keys, ids = docs.column("key").to_numpy(), docs.column("doc_id")
        terms, offsets = _lists(docs.column("terms"))
        value, _ = _lists(docs.column("value"))
        scorer = _Scorer(terms, value, offsets, weight)
        of_term = stored.column("term").to_numpy()
        held, held_at = _lists(stored.column("keys"))
        held = np.searchsorted(keys, held)
        coords, coords_at = _lists(stored.column("terms"))
        worth = _lists(stored.column("most"))[0] * weight[coords]
        out = [none]
        for item, chosen in enumerate(essential):
            own, _ = _ranges(np.searchsorted(of_term, chosen), np.searchsorted(of_term, chosen, side="right"))
            if not len(own):
                continue
            factor = np.zeros(len(weight), dtype=np.int64)
            factor[terms_of[item]] = times_of[item]
            at, parts = _ranges(coords_at[own], coords_at[own + 1])
            bound = _segment_sums(worth[at] * factor[coords[at]], parts)
            own = own[bound >= max(floors[item], 1)]
            at, _ = _ranges(held_at[own], held_at[own + 1])
            doc = np.unique(held[at])
            score = scorer(doc, terms_of[item], times_of[item])
            good = _first_best(score, floors[item])
            if len(good) > BEST:  # of equal ones the least ids
                rows = sorted(((-int(score[g]), ids[int(doc[g])].as_py() is None, ids[int(doc[g])].as_py(), g) for g in good), key=lambda r: r[:2] + (
                    (r[2],) if not r[1] else ()))
                good = np.array([r[3] for r in rows[:BEST]])
            if len(good):
                own = pa.array(doc[good])
                out.append(pa.table([pa.array(np.full(len(good), item, dtype=np.int32)), ids.take(own), pa.array(keys[doc[good]]), pa.array(score[good])],
                                    ["item", "doc_id", "key", "score"]))
        return pa.concat_tables(out)

    return members.groupBy("chunk").cogroup(index.groupBy("chunk")).applyInArrow(run, f"item int, doc_id {kind}, key long, score long")


def _answer(docs: DataFrame, asked: Questions, id_col: str, text_col: str) -> DataFrame:
    """(item, rank, doc_id, score) of one block of items."""
    spark: SparkSession = docs.sparkSession
    vectors = cut_lineage(term_vectors(docs, asked, id_col, text_col))
    n_docs, n_words = vectors.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df, most = (np.zeros(len(asked.one), dtype=np.int64) for _ in range(2))
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    placed = cut_lineage(_placed(vectors.where("size(terms) > 0"), n_docs, max(n_words, 1), weight))
    for r in placed.select(F.explode(F.arrays_zip("terms", "value")).alias("p")).groupBy("p.terms").agg(F.max("p.value").alias("m")).collect():
        most[r["terms"]] = r["m"]
    floors = _floors(placed, asked, df, weight)
    essential = _essential(asked, floors, most, weight)
    # Documents and blocks of a chunk lie in one bucket: neither indexing nor searching shuffles them.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members, index = work_table(spark, "members"), work_table(spark, "blocks")
    _chunked(placed).repartition(buckets, "chunk").write.bucketBy(buckets, "chunk").saveAsTable(members)
    _index(spark.table(members), asked, essential).write.bucketBy(buckets, "chunk").saveAsTable(index)
    found = _search(spark.table(members), spark.table(index), asked, essential, floors, weight)
    names = spark.createDataFrame(list(enumerate(asked.ids)), f"item int, item_id {_kind_of(asked.ids)}")
    # Bounded: a row for each item of the block.
    return cut_lineage(_best_of(found).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))


def _kind_of(ids: list) -> str:
    return "string" if any(isinstance(i, str) for i in ids) else "long"


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ten best documents of each item, those with a score above 0.

    Equal scores rank by doc_id, null last.  Every row of documents is ranked, also one whose doc_id others
    have, and every row of items is answered, so a repeated item_id is answered once for each row.
    Null and empty texts have no terms: such documents are never found and such items have no rows, as without
    documents.  Terms are told apart by 128 bits of hashes.  Other columns do not matter.
    """
    kind = items.schema[item_col].dataType.simpleString()
    answers = None
    for asked in question_blocks(items, item_col, item_text):
        if len(asked.one):
            answer = _answer(docs, asked, id_col, text_col).withColumn("item_id", F.col("item_id").cast(kind))
            answers = answer if answers is None else answers.unionByName(answer)
    if answers is None:
        answers = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long")
    return answers
