"""Vector code compression against a plain version in one process."""

import random

import numpy as np
import pytest

from codescan.llm import residents

SCHEMA = "vec_id long, embedding array<float>, label int, entry int, position int, row long, v string, moved boolean"


def plain(rows, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [np.floor(np.float64(np.float32(x)) * 1024) for x in r[1]]))
    v = np.array([[int(np.floor(np.float64(np.float32(x)) * 1024)) for x in r[1]] for r in kept], dtype=np.int64)
    cuts = [i * v.shape[1] // 4 for i in range(5)]
    books = [v[:entries, a:b].copy() for a, b in zip(cuts, cuts[1:])]

    def assigned():
        out = []
        for (a, b), e in zip(zip(cuts, cuts[1:]), books):
            d = ((v[:, None, a:b] - e[None]) ** 2).sum(axis=2)
            out.append((d.argmin(axis=1), d.min(axis=1)))
        return out

    for _ in range(rounds):
        for (a, b), e, (index, _) in zip(zip(cuts, cuts[1:]), books, assigned()):
            for i in range(len(e)):
                if (index == i).any():
                    e[i] = v[index == i, a:b].sum(axis=0) // (index == i).sum()
    final = assigned()
    codes = [(r[0], r[2], tuple(int(f[0][i]) for f in final), int(sum(f[1][i] for f in final))) for i, r in enumerate(kept)]
    return sorted(codes, key=str), residents.Codebooks(books).digest()


def result(df, **options):
    codes, books = residents.compress(df, **options)
    return sorted(((r.vec_id, r.label, tuple(r.code), r.error) for r in codes.collect()), key=str), books.digest()


def table(spark, rows):
    full = [(i, v, label, 3, 4, 5, "v", True) for i, v, label in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def vectors(n, length=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("members", [residents.MEMBERS, 7])
def test_same_as_plain(spark, monkeypatch, members):
    """Nulls, NaN, infinities, repeated rows and ids, ties, no id, other lengths; owners of any number of salts."""
    monkeypatch.setattr(residents, "MEMBERS", members)
    rows = vectors(400)
    same = rows[7][1]
    rows += [rows[3], rows[3], (5, rows[9][1], 1), (None, rows[2][1], 2), *[(1000 + i, same, 1) for i in range(150)]]
    odd = [(2000, None, 1), (2001, [float("nan")] * 8, 1), (2002, [None] + [0.0] * 7, 1), (2003, [float("inf")] + [0.0] * 7, 1),
           (-5, [1.0, 2.0], 1), (-6, [], 1)]
    assert result(table(spark, rows + odd), entries=16) == plain(rows, entries=16)


def test_fewer_rows_than_entries_and_uneven_parts(spark):
    rows = vectors(30, length=10)
    assert result(table(spark, rows)) == plain(rows)


def test_great_components(spark):
    """Products beyond what doubles hold exactly."""
    rows = [(i, [x * 60_000 for x in v], label) for i, v, label in vectors(60)]
    assert result(table(spark, rows), entries=8) == plain(rows, entries=8)


def test_only_parts_that_change_their_entry_move(spark):
    """Members are found in the bucket of their entry without an exchange."""
    rows, length = residents.whole_vectors(table(spark, vectors(200)))
    members, _ = residents.fit(rows, length, entries=16)
    plan = members.groupBy(*residents.OWNER).count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_restore(spark):
    codes, books = residents.compress(table(spark, vectors(20)), rounds=1)
    back = {r.vec_id: r.vector for r in residents.restore(codes, books).collect()}
    for i, v, _ in vectors(20):
        assert np.allclose(back[i], v, atol=2 / 1024)  # 20 vectors fit into 256 entries


def test_empty(spark):
    codes, books = residents.compress(table(spark, []).limit(0))
    assert codes.collect() == [] and codes.columns == ["vec_id", "label", "code", "error"]
    assert residents.compress(table(spark, [(1, None, 1)]))[0].collect() == []
