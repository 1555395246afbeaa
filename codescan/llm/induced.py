"""Suffix arrays of one shard of bytes by induced sorting, and their permuted common prefixes.

A suffix is smaller (S) or larger (L) than the one after it.  The leftmost S suffixes of
each run are sorted by the recursion; all others follow from them in one pass up and one
down the buckets of first symbols.  Each bucket is moved as a whole with numpy: its members
arrive from earlier buckets or from the bucket itself, so a bucket needs one pass for every
repetition of its symbol and no comparison of suffixes at all.
"""

from __future__ import annotations

import numpy as np

WIDEST = 256  # symbols of a reduced string; more are written as two digits
SHORT = 1 << 18  # names of a reduced string that are ordered without a further recursion


class _Text:
    """Symbols with a closing 0, their classes and buckets."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.t = t = np.append(symbols, 0).astype(np.uint16)
        self.n_symbols = n_symbols
        changes = np.flatnonzero(t[:-1] != t[1:])
        small = np.ones(len(t), dtype=bool)
        small[:-1] = np.repeat(t[changes] < t[changes + 1], np.diff(changes, prepend=-1))
        self.leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        sizes = np.bincount(t, minlength=n_symbols)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.present = np.flatnonzero(sizes).tolist()

    def _deal(self, places: np.ndarray, symbols: np.ndarray, edge: np.ndarray, step: int, out: np.ndarray) -> None:
        """Put places, in order, at the edges of the buckets of their symbols and move the edges."""
        by = np.argsort(symbols, kind="stable")
        symbols = symbols[by]
        counts = np.bincount(symbols, minlength=self.n_symbols)
        rank = np.arange(len(by)) - (np.cumsum(counts) - counts)[symbols]
        out[edge[symbols] + (rank if step > 0 else -1 - rank)] = places[by]
        edge += step * counts

    def induce(self, order: np.ndarray) -> np.ndarray:
        """All suffixes, from the leftmost S suffixes in their order (by first symbol at least)."""
        t, out = self.t, np.empty(len(self.t), dtype=np.int32)
        counts = np.bincount(t[order], minlength=self.n_symbols)
        upto = np.cumsum(counts)
        head, tail = self.start.copy(), self.end.copy()
        for symbol in self.present:
            newest = out[self.start[symbol]:head[symbol]]
            while len(newest):
                newest = newest[t[newest - 1] == symbol] - 1
                out[head[symbol]:head[symbol] + len(newest)] = newest
                head[symbol] += len(newest)
            known = np.concatenate([out[self.start[symbol]:head[symbol]], order[upto[symbol] - counts[symbol]:upto[symbol]]])
            before = known[t[known - 1] > symbol] - 1  # the text's closing 0 stands before its first symbol
            if len(before):
                self._deal(before, t[before], head, 1, out)
        for symbol in reversed(self.present):
            newest = out[tail[symbol]:self.end[symbol]][::-1]
            while len(newest):
                newest = newest[(t[newest - 1] == symbol) & (newest > 0)] - 1
                out[tail[symbol] - len(newest):tail[symbol]] = newest[::-1]
                tail[symbol] -= len(newest)
            known = np.concatenate([out[tail[symbol]:self.end[symbol]][::-1], out[self.start[symbol]:head[symbol]][::-1]])
            before = known[(t[known - 1] < symbol) & (known > 0)] - 1
            if len(before):
                self._deal(before, t[before], tail, -1, out)
        out[0] = len(t) - 1
        return out

    def names(self, order: np.ndarray) -> np.ndarray:
        """Ranks of the substrings between leftmost S suffixes, given in sorted order; equal ones share one."""
        t, at = self.t, self.leftmost
        size = np.ones(len(t), dtype=np.int32)
        size[at[:-1]] = np.diff(at) + 1
        one, two = order[:-1], order[1:]
        differ = size[one] != size[two]
        same = np.flatnonzero(~differ)
        if len(same):
            length = size[one[same]]
            first = np.cumsum(length) - length
            step = np.arange(int(length.sum())) - np.repeat(first, length)
            unequal = t[np.repeat(one[same], length) + step] != t[np.repeat(two[same], length) + step]
            differ[same] = np.logical_or.reduceat(unequal, first)
        return np.concatenate([[0], np.cumsum(differ)])


def _sorted(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """Suffixes in order, the empty one first."""
    text = _Text(symbols, n_symbols)
    at, t = text.leftmost, text.t
    rough = text.induce(at[np.argsort(t[at], kind="stable")])
    is_leftmost = np.zeros(len(t), dtype=bool)
    is_leftmost[at] = True
    order = rough[is_leftmost[rough]]
    name = text.names(order)
    if name[-1] + 1 < len(at):
        # Substrings occur more than once: their order follows from the suffixes of the string of their names.
        of = np.empty(len(t), dtype=np.int64)
        of[order] = name
        reduced, many = of[at], int(name[-1]) + 1
        if len(reduced) <= SHORT:
            order = at[_doubled(reduced)]
        elif many < WIDEST:
            order = at[_sorted(reduced + 1, many + 1)[1:]]
        else:
            base = int(np.ceil(np.sqrt(many)))
            digits = np.stack([reduced // base, reduced % base], axis=1).reshape(-1) + 1
            found = _sorted(digits, base + 1)[1:]
            order = at[found[found % 2 == 0] // 2]
    return text.induce(order)


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffixes of a short string in order: where the recursion ends.

    Suffixes are ranked by twice as many names in each round, those that are alone with their rank no more.
    """
    n, step = len(names), 1
    order = np.argsort(names, kind="stable")
    new = np.diff(names[order], prepend=-1) != 0
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = order[~(new & np.append(new[1:], True))]
    while len(tied):
        key = rank[tied] * (n + 1) + rank[np.minimum(tied + step, n)] + 1
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        group = rank[tied]
        place = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, place, 0))
        new = np.diff(key, prepend=-1) != 0
        rank[tied] = np.maximum.accumulate(np.where(new, group + place - first, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of some bytes, in order; a suffix is smaller than those it begins."""
    if not len(data):
        return np.zeros(0, dtype=np.int32)
    return _sorted(data.astype(np.uint16) + np.uint16(1), 257)[1:]


def common_prefixes(data: np.ndarray, order: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, length): for each place the suffix before its own in order, and what both begin with.

    ``ends`` are the ends of the pieces of the data, ascending; a byte that stands nowhere else closes
    each.  Prefixes end with their piece.  Only where the bytes before the two places differ
    are bytes compared; at other places the prefix is one shorter than at the place before.
    """
    n = len(data)
    previous = np.full(n, -1, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n) - 1  # without the closing byte
    begins = np.zeros(n, dtype=bool)
    begins[0] = True
    begins[ends[:-1]] = True
    fresh = begins | (previous <= 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = data[inner - 1] != data[previous[inner] - 1]
    words = np.zeros(n + 16, dtype=np.uint64)
    words[:n] = data
    for width in (1, 2, 4):  # eight bytes from every place
        words[:-width] |= words[width:] << np.uint64(8 * width)
    at = np.flatnonzero(fresh & (previous >= 0))
    other = previous[at]
    most = np.minimum(left[at], left[other])
    length = np.zeros(len(at), dtype=np.int64)
    live = np.arange(len(at))
    while len(live):
        one, two = words[np.minimum(at[live] + length[live], n)], words[np.minimum(other[live] + length[live], n)]
        goes_on = (one == two) & (length[live] + 8 <= most[live])
        stop = live[~goes_on]
        unlike = one[~goes_on] ^ two[~goes_on]
        low = unlike & (~unlike + np.uint64(1))
        equal = np.where(unlike == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        length[stop] = np.minimum(length[stop] + equal, most[stop])
        live = live[goes_on]
        length[live] += 8
    value = np.zeros(n, dtype=np.int64)
    value[at] = length
    source = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return previous, np.maximum(value[source] - (np.arange(n) - source), 0)
