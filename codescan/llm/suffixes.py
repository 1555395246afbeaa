"""Substring dedup by suffix arrays: bytes of strings that start anywhere else go.

Every window of ``length`` bytes belongs to an anchor, the least hash among its runs of
``anchor`` bytes, so equal windows meet at equal anchors.  Neighbouring windows of one anchor
are a piece of text, read once.

1. Anchors that stand at one place only hold no repeat and go.
2. Pieces that are equal are one kind with two places, its first and its last one: more would not
   tell the suffix array more.  Where an anchor has one kind only, neighbouring kinds with the
   same two places are read as one longer text.
3. An anchor with very many kinds is split: windows that reach far to the left of it by what stands
   there, the others by what stands to its right, again and again, until each part is small.
4. Anchors are dealt to shards of a bounded number of bytes.  A shard sorts its suffixes by
   induced sorting and computes permuted common prefixes (``induced``): a window repeats
   if its suffix shares ``length`` bytes with a neighbour in the order.
5. Every place of a kind takes over what its shard found.

Kinds are told apart by 128 bits of hashes; the shards compare the bytes of both places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescan.llm.induced import common_prefixes, suffix_array
from codescan.llm.words import Spans, blocks, signed, sliding_min_at, text_bytes
from codescan.session import cut_lineage

LENGTH, ANCHOR = 400, 100
SHARD = 1 << 20  # bytes of a shard, about
CROWDED = 1 << 20  # bytes of the kinds of one anchor that stay together
CHUNK = 1 << 20  # windows that are hashed at once
STRIP = 64 << 10  # windows of a longer text at most
CLOSE = b"\xff"  # no byte of UTF-8
# Seeds of the hashes of anchors and of pieces.
_ANCHOR, _PIECE = 7, 8
_LETTERS = {seed: np.random.default_rng(500 + seed).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (_ANCHOR, _PIECE)}
_KIND = "core long, h long, n int, o int"


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a row; repeated rows share them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text, F.col(id_col)).alias("k1"), F.xxhash64(F.col(id_col), text, F.lit("row")).alias("k2")]


def _hashes(data: np.ndarray, seed: int) -> Spans:
    return Spans(_LETTERS[seed][data], seed)


def pieces(base: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(core, h, n, o, k1, k2, a, reps): ``reps`` pieces of n windows, the first of which starts at byte a.

    ``core`` is the anchor's hash, ``h`` that of the piece, ``o`` the distance from a to the anchor.
    Equal pieces that follow each other, as in a text of one character, are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=CHUNK):
            data, first = text_bytes(block.column(2))
            found = []
            for row in np.flatnonzero(np.diff(first) >= length):
                for at in range(int(first[row]), int(first[row + 1]) - length + 1, CHUNK):
                    part = data[at:min(at + CHUNK + length - 1, int(first[row + 1]))]
                    places = np.arange(len(part) - anchor + 1)
                    code = _hashes(part, _ANCHOR)(places, places + anchor)
                    least = sliding_min_at(code, length - anchor + 1)
                    a = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                    n = np.diff(np.r_[a, len(least)])
                    o = least[a] - a
                    core = code[least[a]]
                    shape = (n * 1024 + o).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    h = _hashes(part, _PIECE)(a, a + n + length - 1) ^ shape
                    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (core[1:] != core[:-1])])
                    reps = np.diff(np.r_[new, len(a)])
                    found.append((np.full(len(new), row), core[new], h[new], n[new], o[new], a[new] + at - first[row], reps))
            if found:
                row, core, h, n, o, a, reps = (np.concatenate(x) for x in zip(*found))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [signed(core), signed(h), pa.array(n.astype(np.int32)), pa.array(o.astype(np.int32)),
                     block.column(0).take(row), block.column(1).take(row), pa.array(a.astype(np.int64)), pa.array(reps.astype(np.int32))],
                    ["core", "h", "n", "o", "k1", "k2", "a", "reps"])

    return base.mapInArrow(run, f"{_KIND}, k1 long, k2 long, a long, reps int")


def _read(base: DataFrame, spans: DataFrame, fields: str, make, schema: str, few: bool = False) -> DataFrame:
    """Apply ``make(bytes, spans)`` to each row that has spans (k1, k2, ...fields): lists of columns, one list for a row.

    A task that meets a repeated row again passes it by.  With ``few`` the rows are looked up by their keys
    first, which Spark can broadcast if they are as few as expected.
    """
    wanted = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct(*fields.split())).alias("s"))  # bounded by the text itself
    if few:
        wanted = cut_lineage(wanted)
        base = base.join(cut_lineage(wanted.select("k1", "k2")), ["k1", "k2"], "left_semi")
    rows = base.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "s")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for block in blocks(batches):
            data, first = text_bytes(block.column(2))
            lists = block.column(3)
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
            flat = lists.flatten()
            columns = {f: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(fields.split())}
            out, size = [], 0
            for row, key in enumerate(zip(block.column(0).to_pylist(), block.column(1).to_pylist())):
                if key == last:
                    continue
                last = key
                for made in make(data[first[row]:first[row + 1]], {f: c[ends[row]:ends[row + 1]] for f, c in columns.items()}):
                    out.append(made)
                    size += len(made[1]) if isinstance(made[1], bytes) else 64
                    if size > CHUNK:
                        yield _batch(out, names, schema)
                        out, size = [], 0
            if out:
                yield _batch(out, names, schema)

    return rows.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
          "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [_ARROW[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(col), type=kind) for col, kind in zip(zip(*rows), kinds)], names)


def _texts_of(base: DataFrame, crowd: DataFrame, length: int) -> DataFrame:
    """(r1, r2, data): the bytes of kinds, read where each is first."""

    def make(data: np.ndarray, s: dict[str, np.ndarray]) -> Iterator[tuple]:
        for r1, r2, a, n in zip(*(s[c].tolist() for c in ("r1", "r2", "a", "n"))):
            yield r1, data[a:a + n + length - 1].tobytes(), r2

    spans = crowd.select("r1", "r2", "n", "first.k1", "first.k2", "first.a")
    return _read(base, spans, "r1 r2 a n", make, "r1 long, data binary, r2 long", few=True)


def _halves(crowd: DataFrame, length: int) -> DataFrame:
    """Parts (core, h, n, o, lo, hi, …, data) in two: by the bytes that windows far to the left, or the others, all hold.

    All windows of a class have their anchor lo to hi bytes behind their start, so they share the bytes
    from ``lo`` before the anchor to ``hi`` before the anchor plus a window.
    """
    names, own = crowd.columns, ("core", "h", "n", "o", "lo", "hi", "off", "data")
    others = [c for c in names if c not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            for i, (n, o, lo, hi, off, data) in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in own[2:]))):
                data = np.frombuffer(data, dtype=np.uint8)
                middle = (lo + hi + 1) // 2
                upper = min(max(o - middle + 1, 0), n)
                for skip, many, low, high in ((0, upper, middle, hi), (upper, n - upper, lo, middle - 1)):
                    if not many:
                        continue
                    near, text = o - skip, data[skip:skip + many + length - 1]
                    begin = np.array([near - low])  # where the shared bytes begin in the text
                    shape = np.uint64((many * 1024 + near) * 0x9E3779B97F4A7C15 % 2**64)
                    kind = np.uint64((low * 1024 + high + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
                    core = _hashes(text, _ANCHOR)(begin, begin + low - high + length) ^ kind
                    h = _hashes(text, _PIECE)(np.array([0]), np.array([len(text)])) ^ shape
                    rows.append((int(core.view(np.int64)[0]), int(h.view(np.int64)[0]), many, near, low, high, off + skip, text.tobytes()))
                    source.append(i)
            if rows:
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(list(c), type=k) for c, k in zip(zip(*rows), kinds)),
                     *(batch.column(names.index(c)).take(pa.array(source)) for c in others)], [*own, *others])

    fields = {f.name: f.dataType.simpleString() for f in crowd.schema}
    return crowd.mapInArrow(run, ", ".join(f"{c} {fields[c]}" for c in (*own, *others)))


def _sums(parts: DataFrame, length: int) -> DataFrame:
    """(core, places, kinds, bytes) of the parts, repeated cores only."""
    kinds = parts.groupBy("core", "h", "n").agg(F.sum("places").alias("places"))
    return kinds.groupBy("core").agg(
        F.sum("places").alias("all_places"), F.count(F.lit(1)).alias("kinds"),
        F.sum((F.col("n") + length) * F.least("places", F.lit(2))).alias("bytes")).where("all_places > 1")


def _parts(base: DataFrame, found: DataFrame, length: int, anchor: int) -> DataFrame:
    """(core, h, n, o, r1, r2, off, kinds, places, first, last): kinds r1, r2, cut until no core is crowded.

    A part covers the windows from ``off`` of its kind.  Each round halves the classes, so at most
    nine are needed for 400 bytes, and only crowded cores take part.
    """
    place = F.struct("k1", "k2", "a")
    end = F.struct("k1", "k2", (F.col("a") + (F.col("reps") - 1) * F.col("n")).alias("a"))
    parts = found.groupBy("core", "h", "n", "o").agg(
        F.sum("reps").cast("long").alias("places"), F.min(place).alias("first"), F.max(end).alias("last")).select(
        "core", "h", "n", "o", F.lit(0).alias("lo"), F.lit(length - anchor).alias("hi"), F.lit(0).alias("off"),
        F.col("core").alias("r1"), F.col("h").alias("r2"), "places", "first", "last")
    parts, settled, at = cut_lineage(parts), None, 0
    moved = lambda c: F.struct(F.col(c)["k1"].alias("k1"), F.col(c)["k2"].alias("k2"), (F.col(c)["a"] + F.col("off")).alias("a")).alias(c)
    while True:
        # Sums are written before they are joined, so that a crowded core can be split in the join.
        sums = cut_lineage(_sums(parts, length))
        crowded = sums.where((F.col("bytes") > CROWDED) & (F.col("kinds") > 1))
        calm = parts.drop("data").join(sums.where((F.col("bytes") <= CROWDED) | (F.col("kinds") == 1)).select("core", "kinds"), "core")
        settled = calm if settled is None else settled.unionByName(calm)
        if crowded.isEmpty():
            return cut_lineage(settled.select(*calm.columns).withColumn("first", moved("first")).withColumn("last", moved("last")))
        crowd = parts.join(crowded.select("core"), "core", "left_semi")
        if not at:  # the bytes of crowded kinds are read once
            crowd = cut_lineage(crowd)
            crowd = crowd.join(cut_lineage(_texts_of(base, crowd, length)), ["r1", "r2"])
        parts, at = cut_lineage(_halves(crowd, length)), at + 1


def _strips(base: DataFrame, kinds: DataFrame, length: int, shards: int) -> DataFrame:
    """(shard, data, core, h, at, n, mine): texts for the shards, with the kinds they hold from ``at`` on."""

    def make(data: np.ndarray, s: dict[str, np.ndarray]) -> Iterator[tuple]:
        n, a, pair = s["n"].astype(np.int64), s["a"], s["pair"]
        alone = pair == 0
        # Kinds with one pair of places and no gap are one text.
        order = np.lexsort((a, s["mine"], pair))
        a_, n_, pair_, mine_ = a[order], n[order], pair[order], s["mine"][order]
        joins = (pair_[1:] == pair_[:-1]) & (mine_[1:] == mine_[:-1]) & (a_[1:] == a_[:-1] + n_[:-1]) & ~alone[order][1:]
        new = np.r_[True, ~joins]
        start = np.maximum.accumulate(np.where(new, np.arange(len(a_)), 0))
        total = np.cumsum(n_) - n_
        cut = (total - total[start]) // STRIP
        new[1:] |= cut[1:] != cut[:-1]
        ends = np.r_[np.flatnonzero(new)[1:], len(a_)]
        for i, j in zip(np.flatnonzero(new).tolist(), ends.tolist()):
            begin, end = int(a_[i]), int(a_[j - 1] + n_[j - 1] + length - 1)
            core = s["core"][order[i:j]]
            name = int(core[0]) if alone[order[i]] else int(core[0]) ^ int(pair_[i])
            yield (name % shards, data[begin:end].tobytes(), core, s["h"][order[i:j]], (a_[i:j] - begin), n_[i:j], bool(mine_[i]))

    # The two places of a kind whose core has no other are named by a hash of both rows and their distance.
    pair = F.when((F.col("kinds") == 1) & (F.col("places") > 1), F.xxhash64(
        "first.k1", "first.k2", "last.k1", "last.k2", F.col("last.a") - F.col("first.a"))).otherwise(F.lit(0))
    twice = F.when(F.col("places") > 1, F.array(
        F.struct(F.col("first").alias("p"), F.lit(1).alias("mine")), F.struct(F.col("last").alias("p"), F.lit(0).alias("mine")))).otherwise(
        F.array(F.struct(F.col("first").alias("p"), F.lit(1).alias("mine"))))
    spans = kinds.select("core", "h", "n", pair.alias("pair"), F.explode(twice).alias("t")).select(
        "core", "h", "n", "pair", "t.mine", "t.p.k1", "t.p.k2", "t.p.a")
    return _read(base, spans, "core h n pair mine a", make,
                 "shard int, data binary, core array<long>, h array<long>, at array<int>, n array<int>, mine boolean")


def _runs_of(marks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[list, list]:
    """For each slice of the marks: where runs of marked places start in it, and how long they are."""
    begins, lengths = [], []
    for at, n in zip(starts.tolist(), sizes.tolist()):
        edge = np.flatnonzero(np.diff(marks[at:at + n].astype(np.int8), prepend=0, append=0))
        begins.append(edge[::2])
        lengths.append(edge[1::2] - edge[::2])
    return begins, lengths


def _search(strips: DataFrame, length: int) -> DataFrame:
    """(core, h, starts, sizes): runs of windows of each kind that occur twice, by the suffix array of its shard."""

    def run(table: pa.Table) -> pa.Table:
        texts = table.column("data").to_pylist()
        data = np.frombuffer(CLOSE.join(texts) + CLOSE, dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        previous, shared = common_prefixes(data, suffix_array(data), ends)
        twice = shared >= length
        marks = twice.copy()
        marks[previous[twice]] = True
        out = {name: [] for name in ("core", "h", "starts", "sizes")}
        for row, begin in zip(table.select(["core", "h", "at", "n", "mine"]).to_pylist(), np.r_[0, ends[:-1]].tolist()):
            if row["mine"]:
                starts, sizes = _runs_of(marks, np.array(row["at"]) + begin, np.array(row["n"]))
                for core, h, s, z in zip(row["core"], row["h"], starts, sizes):
                    if len(s):
                        for name, value in zip(out, (core, h, s, z)):
                            out[name].append(value)
        return pa.table([pa.array(out["core"], pa.int64()), pa.array(out["h"], pa.int64()),
                         pa.array(out["starts"], pa.list_(pa.int32())), pa.array(out["sizes"], pa.list_(pa.int32()))], list(out))

    return strips.groupBy("shard").applyInArrow(run, "core long, h long, starts array<int>, sizes array<int>")


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_keys(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))


def repeated_windows(base: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, starts, sizes): runs of windows of the rows (k1, k2, text) whose bytes start anywhere else too."""
    base = base.select("k1", "k2", "text")
    rows = cut_lineage(pieces(base, length, anchor))
    repeated = cut_lineage(rows.groupBy("core").agg(F.sum("reps").alias("n")).where("n > 1").select("core"))
    found = cut_lineage(rows.join(repeated, "core", "left_semi"))
    parts = _parts(base, found, length, anchor)
    # Parts that are equal are read once.
    kinds = cut_lineage(parts.groupBy("core", "h", "n", "kinds").agg(
        F.sum("places").alias("places"), F.min("first").alias("first"), F.max("last").alias("last")))
    size = kinds.agg(F.sum((F.col("n") + length) * F.least("places", F.lit(2)))).first()[0] or 0
    strips = _strips(base, kinds, length, max(1, math.ceil(size / SHARD)))
    marked = cut_lineage(_search(strips, length))
    # From the parts back to the kinds they were cut from, and from these to all places.
    known = cut_lineage(parts.select("core", "h", "r1", "r2", "off").join(marked, ["core", "h"]).select(
        F.col("r1").alias("core"), F.col("r2").alias("h"),
        F.expr("zip_with(starts, sizes, (s, z) -> struct(s + off AS start, z AS size))").alias("runs")).groupBy("core", "h").agg(
        F.flatten(F.collect_list("runs")).alias("runs")))  # bounded by the windows of a kind
    # Pieces that follow each other are repeats as a whole.
    claims = found.join(known, ["core", "h"]).select("k1", "k2", F.when(F.col("reps") > 1, F.expr(
        "array(struct(a AS start, CAST(n AS bigint) * reps AS size))")).otherwise(
        F.expr("transform(runs, r -> struct(a + r.start AS start, CAST(r.size AS bigint) AS size))")).alias("runs"))
    return claims.groupBy("k1", "k2").agg(F.flatten(F.collect_set("runs")).alias("r")).select(
        "k1", "k2", F.col("r.start").alias("starts"), F.col("r.size").alias("sizes"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text without bytes of strings that start anywhere else.

    A string is ``length`` bytes of one text; elsewhere is any other place of any row, the same one
    included, so no copy of a repeat stays.  ``kept`` is binary: a cut may fall into a character.
    Every row is judged, also without doc_id and with a doc_id that other rows have; a repeated row
    repeats itself.  A null text is empty and texts shorter than ``length`` stay as they are.  Other
    columns do not matter.
    """
    base = _base(docs, id_col, text_col)
    spans = repeated_windows(base, length, anchor)
    rows = base.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "starts", "sizes")
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, first = text_bytes(block.column(1))
            lists = [block.column(i) for i in (2, 3)]
            counts = pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False)
            start, size = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            at = np.repeat(first[:-1], counts) + start
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size + length - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            # A run ends with its text.
            begins = gone & ~np.r_[False, gone[:-1]]
            begins[first[:-1][np.diff(first) > 0]] = gone[first[:-1][np.diff(first) > 0]]
            removed, spans_before = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begins)]
            kept = data[~gone].tobytes()
            upto = first - removed[first]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(np.diff(first)), pa.array(np.diff(removed[first])), pa.array(np.diff(spans_before[first])),
                 pa.array([kept[i:j] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist())], type=pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, f"doc_id {id_type.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
