"""Words of whole texts as numpy arrays, for functions that run on Arrow batches.

A batch is cut into blocks of a MB of text, so a task holds some hundred times a block
beside the batch, however large the table is.  A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64


def _table(separators) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


# Bytes of words: all but blanks, or ASCII letters and digits and all that is not ASCII.
NOT_BLANK = _table([0x20, *range(0x09, 0x0E)])
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words of a column of texts: byte spans and the first word of each text."""

    def __init__(self, texts: pa.Array, table: np.ndarray = NOT_BLANK, lower: bool = False):
        self.data, self.offsets = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        self.n_docs = len(self.offsets) - 1
        inside = table[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.offsets)  # first word of each text, and the number of all
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(self.n_docs), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        rng = np.random.default_rng(1000 + seed)
        letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        total = _prefix(letters[self.data], seed)
        raw = (total[self.end] - total[self.start]) * _powers(seed, len(self.data) + 1)[1][self.start]
        return mix(raw + (self.end - self.start).astype(U64))

    def windows(self, size: int) -> np.ndarray:
        """Which words start a window of ``size`` words inside their text."""
        left = np.repeat(self.first[1:], self.count) - np.arange(len(self))
        return left >= size

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends): the kept words joined by one blank, each text followed by one."""
        start, end = (self.start, self.end) if keep is None else (self.start[keep], self.end[keep])
        mask = np.zeros(len(self.data) + 2, dtype=np.int8)
        mask[start] += 1
        mask[end] -= 1
        inside = np.cumsum(mask[:-2]).astype(bool)
        size = end - start + 1
        at = np.cumsum(size) - size
        out = np.full(int(size.sum()), 0x20, dtype=np.uint8)
        holes = at + size - 1
        fill = np.ones(len(out), dtype=bool)
        fill[holes] = False
        out[fill] = self.data[inside]
        return out, at, holes


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and where each text starts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a block holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_bytes(batch.column(batch.schema.names.index(column)))[1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if seed not in _POWERS or len(_POWERS[seed][0]) < n:
        base = (0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01E * seed) | 1
        ones = np.full(max(n, 1 << 16), 1, dtype=U64)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = U64(base & (2**64 - 1)), U64(pow(base, -1, 2**64))
        _POWERS[seed] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[seed]


def _prefix(values: np.ndarray, seed: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * _powers(seed, len(values) + 1)[0][:len(values)], out=total[1:])
    return total


class Spans:
    """Hashes of any run of words, from the hashes of the words."""

    def __init__(self, hashes: np.ndarray, seed: int = 0):
        self.total, self.seed = _prefix(hashes, seed), seed

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.total[end] - self.total[start]) * _powers(self.seed, len(self.total))[1][start]
        return mix(raw + (end - start).astype(U64))


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as a column of bigint."""
    return pa.array(x.view(np.int64))


def sliding_min_at(values: np.ndarray, size: int) -> np.ndarray:
    """Where the least of each ``size`` values is; the first of equal ones.

    Values are compared by their upper 32 bits, so windows of equal content agree.
    """
    key = (values & U64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=U64)
    width = 1
    while width * 2 <= size:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = size - width
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    return (key & U64(0xFFFFFFFF)).astype(np.int64)
