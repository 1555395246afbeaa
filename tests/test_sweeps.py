"""Ranges by numbered versions, reach over buckets, pages by range, block comments: against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from codescan.operators import dependencies as dp
from codescan.operators import lines as ln
from codescan.operators import report as rp
from codescan.operators import taint as tn
from tests.conftest import rows


def key(version):
    release, _, pre = version.partition("rc")
    numbers = [int(x) for x in release.split(".")]
    while numbers and not numbers[-1]:
        numbers.pop()
    return (numbers, 0 if pre else 1, int(pre or 0))


@pytest.mark.parametrize("cap", [None, 2])
def test_ranges_are_those_of_a_direct_search(spark, cap):
    rng = random.Random(5)

    def version():
        return ".".join(str(rng.randrange(12)) for _ in range(rng.randint(1, 3))) + (f"rc{rng.randrange(3)}" if rng.random() < 0.2 else "")

    deps = [("PyPI", f"p{rng.randrange(4)}", version()) for _ in range(300)]
    ranges = []
    for i in range(200):
        ends = [None, None]
        ends[rng.randrange(2)] = version() if rng.random() < 0.8 else None
        ranges.append(("PyPI", f"p{rng.randrange(5)}", "0" if rng.random() < 0.3 else version(), *ends, 0, f"A{i:03}", "s"))
    got = dp.resolve_ranges(spark.createDataFrame([(*d, "") for d in deps], "ecosystem string, name string, version string, file string"),
                            spark.createDataFrame(ranges, "ecosystem string, name string, introduced string, fixed string, last_affected string, "
                                                          "seq int, id string, summary string"), cap)
    want = {}
    for _, name, v in set(deps):
        hits = sorted(a for _, n, lo, fixed, last, _, a, _ in ranges if n == name and (lo == "0" or key(v) >= key(lo))
                      and (fixed is None or key(v) < key(fixed)) and (last is None or key(v) <= key(last)))
        want[name, v] = hits
    found = {}
    for r in got.collect():
        found.setdefault((r.name, r.version), []).append(r.id)
    for k, hits in want.items():
        mine = sorted(set(found.get(k, [])))
        assert mine == hits if cap is None else mine[:cap] == hits[:cap]
    if cap is None:
        assert all(len(v) == len(set(v)) for v in found.values())


def test_reach(spark):
    """Chains, cycles and labels; nothing leaves its file, and known nodes are not followed again."""
    edges = [("a", "f", f"n{i}", "f", f"n{i + 1}") for i in range(1500)] + [("a", "f", "n9", "f", "n3"), ("b", "f", "n1", "g", "x"),
                                                                            ("a", "f", "k", "f", "z")]
    edge = spark.createDataFrame(edges, "file string, scope string, name string, to_scope string, to_name string")
    seeds = spark.createDataFrame([("a", "f", "n5", "w"), ("b", "f", "n1", "w"), ("a", "f", "n1499", "p"), ("c", "f", "q", "w")],
                                  "file string, scope string, name string, label string")
    known = spark.createDataFrame([("a", "f", "k", "w")], seeds.schema)
    got = rows(tn.propagate(seeds, edge, known), "file", "scope", "name", "label")
    want = {("a", "f", f"n{i}", "w") for i in range(3, 1501)} | {("a", "f", "n1499", "p"), ("a", "f", "n1500", "p"), ("b", "f", "n1", "w"),
                                                                ("b", "g", "x", "w"), ("c", "f", "q", "w"), ("a", "f", "k", "w")}
    assert got == want


def test_a_round_does_not_shuffle_edges(spark):
    edge = spark.createDataFrame([("a", "f", "x", "f", "y")], "file string, scope string, name string, to_scope string, to_name string")
    reach = tn.Reach(edge)
    reach.add(spark.createDataFrame([("a", "f", "x", "w")], "file string, scope string, name string, label string"), 0)
    assert "Exchange" not in reach.following(0)._jdf.queryExecution().executedPlan().toString()


def test_pages_by_range(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([None, *range(7)]), rng.randrange(50)) for i in range(333)]
    df = spark.createDataFrame(data, "id int, day int, minute int")
    stamp = F.col("day") * 100 + F.col("minute")
    for descending in (False, True):
        order = [F.desc_nulls_last("at") if descending else F.asc_nulls_first("at"), "id"]
        whole = df.withColumn("at", stamp)
        every = [r.id for r in whole.orderBy(*order).collect()]
        for number in (1, 2, 9, 33, 34, 35):
            got = rp.page_by_range(whole, F.col("at"), F.col("day"), order, number, 10, descending)
            assert [r.id for r in got.collect()] == every[(number - 1) * 10:number * 10]


def test_block_comment_lines(spark):
    """Only files with an opening mark are put in order; the rows are those of a state machine."""
    rng = random.Random(3)
    data = [(f"f{f}", rng.choice(["java", "python", None]) if f % 3 else "java", n, rng.choice(["a", "b /* c", "*/ d", "/* e */", "x"]) if f % 4 else "plain")
            for f in range(24) for n in range(1, 15)]
    data = [(f, [d for d in data if d[0] == f][0][1], n, line) for f, _, n, line in data]
    df = spark.createDataFrame(data, "file string, language string, line_no int, line string")
    want, state = set(), {}
    for f, language, n, line in sorted(data, key=lambda d: (d[0], d[2])):
        inside = state.get(f, False)
        if language != "java" or not (inside or "/*" in line):
            want.add((f, n))
        state[f] = False if "*/" in line else True if "/*" in line else inside
    assert rows(ln.drop_block_comment_lines(df), "file", "line_no") == want


def test_long_comments_and_nulls(spark):
    """A comment hides whole blocks of numbers; null texts, languages and files are no marks and stay."""
    data = [("a", "go", 1, "x"), ("a", "go", 3, "/* from"), ("a", "go", 4, None), ("a", "go", 2500, "y"), ("a", "go", 7001, "to */"),
            ("a", "go", 7002, "z"), ("a", "go", 9000, "/* open"), ("a", "go", 12000, "w"), ("b", "go", 5, None), ("b", None, 6, "/* q"),
            (None, "go", 7, "r"), ("c", "go", 1, "*/"), ("c", "go", 2, "s"), ("d", "python", 1, "/*"), ("d", "python", 2, "t")]
    df = spark.createDataFrame(data, "file string, language string, line_no long, line string").repartition(3)
    want = {("a", 1), ("a", 7002), ("b", 5), ("b", 6), (None, 7), ("c", 1), ("c", 2), ("d", 1), ("d", 2)}
    for block in (1000, 1, 10_000_000):
        assert {(r.file, r.line_no) for r in ln.drop_block_comment_lines(df, block=block).collect()} == want
    assert ln.drop_block_comment_lines(df.limit(0)).count() == 0
