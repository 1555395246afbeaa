"""Line templates and URL filters: cases that the tables do not hold."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from codescan.llm import line_templates as lt
from codescan.llm import urls


def test_templates_with_variable_fields(spark):
    """A field may be a number or a word; lines that only share a leaf stay."""
    names = ["Anna", "Bert", "Cleo", "Dora", "Emil", "Finn"]
    rows = [(i, f"Posted by user {n} on day {i} of this year\nown text {n} number {'abcdef'[i]} stays here\n\nhi {n}") for i, n in enumerate(names)]
    other = ["w x y z", "q r s t", "i j k l", "e f g h", "a b c d", "m n o p"]
    rows += [(10 + i, f"the same start {o}") for i, o in enumerate(other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lt.drop_repeated_lines(docs, min_docs=4).collect()}
    assert got[0] == rows[0][1]  # the first document keeps its lines
    assert all(not got[i].startswith("Posted") and got[i].endswith(f"\n\nhi {names[i]}") for i in range(1, 6))
    assert all(got[10 + i] == rows[6 + i][1] for i in range(6))
    gone = {r.doc_id: r.text for r in lt.drop_repeated_lines(docs, min_docs=4, keep_first=False).collect()}
    assert not gone[0].startswith("Posted")


def test_lines_of_variables_alone_are_no_template(spark):
    rows = [(i, f"{i}a {i}b {i}c {i}d\n7 7 7 7\nx{i} y z u v w") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lt.drop_repeated_lines(docs).collect()}
    # What is the same throughout goes, whatever it consists of.
    assert got[0] == rows[0][1] and all(got[i] == f"{i}a {i}b {i}c {i}d" for i in range(1, 12))


def test_a_shared_beginning_is_no_template(spark):
    """Different sentences with three words in common stay, also where one document has many of them."""
    ends = "go eat sleep run read write sing dance swim climb rest wait".split()
    rows = [(i, f"I want to {e}\nI want to {e} with {ends[i - 1]}") for i, e in enumerate(ends)]
    rows += [(50, "\n".join(f"we saw the {a} {b}" for a in ends for b in ends))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lt.drop_repeated_lines(docs, min_docs=10).collect()}
    # "I want to X with Y" has one constant behind the beginning, of three words.
    assert got == dict(rows)


def test_constants_are_measured_by_their_leaf(spark):
    """A word that a tenth of the leaf's documents lack support for is variable, however large the table is."""
    rows = [(i, f"order of item {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]} now paid") for i in range(600)]
    rows += [(1000 + i, f"order of item x{i} {'late' if i % 50 == 0 else 'early'} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lt.drop_repeated_lines(docs, min_docs=10).collect()}
    assert got[0] and not any(got[i] for i in range(1, 600))
    assert all(got[1000 + i] for i in range(600))  # "early" alone is one word of three


def test_templates_change_the_query(spark, tmp_path):
    """Lines that never recur as they are go by their template, in the query as in its SQL."""
    import duckdb

    from codescan.llm.queries import OP8_SQL, op8_lines

    who = "ann bob cat dan eve fay gil hal ida jon kay leo".split()
    rows = [(i, f"mail was sent by {w} to all of us\nown words of {w}\n{w}") for i, w in enumerate(who)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op8_lines(spark, str(tmp_path)).collect())
    assert [r[2] for r in got] == [0] + [1] * 11
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(OP8_SQL).fetchall()) == got


def test_clashing_names_and_ids_of_text(spark):
    rows = [(f"d{i:02}", "the same line for all\nown " + "abcdefghijkl"[i], 1, 2, 3, 4, 5, 6) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _key int, _gone int, _lines int, _ends int, _id int, _of int")
    got = lt.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {r[0]: r[1] if r[0] == "d00" else r[1].split("\n")[1] for r in rows}


def test_odd_rows(spark, docs, empty):
    kept = lt.drop_repeated_lines(docs, min_docs=2, counts=("n_lines", "n_dropped"))
    assert kept.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = kept.collect()
    assert len(got) == docs.count()
    before = {(r.doc_id, r.text) for r in docs.collect()}
    for r in got:
        if r.doc_id is None or r.n_dropped == 0:
            assert (r.doc_id, r.text) in before
    assert lt.drop_repeated_lines(empty).collect() == []


def test_many_lines_and_long_ones(spark):
    line = "this line stands in all of them"
    docs = spark.createDataFrame([(i, "\n".join([line, "z " * 50_000, *[line] * 3, f"own {i}"])) for i in range(12)],
                                 "doc_id long, text string")
    got = {r.doc_id: r.text for r in lt.drop_repeated_lines(docs).collect()}
    assert got[0].count(line) == 4 and all(got[i] == f"own {i}" for i in range(1, 12))


def plain_lines(rows, min_docs, depth=3, share=0.6, support_share=0.1):
    """Texts without the lines of recurring templates, on distinct documents as in OP8_SQL."""
    def mask(line):
        return " ".join("<*>" if any(c in "0123456789" for c in t) else t for t in line.strip().split(" "))

    def fixed(m):
        return len(m.split(" ")) - m.split(" ").count("<*>") >= share * len(m.split(" "))

    holders, verbatim, leaves, support, groups, first = defaultdict(set), defaultdict(set), defaultdict(set), Counter(), defaultdict(list), {}
    for doc_id, text in rows:
        for line in text.split("\n"):
            if m := mask(line):
                holders[m].add(doc_id)
                if not fixed(m):
                    verbatim[line.strip()].add(doc_id)
                if len(m.split(" ")) > depth:
                    leaves[len(m.split(" ")), *m.split(" ")[:depth]].add(doc_id)
    leaf = {m: (len(m.split(" ")), *m.split(" ")[:depth]) for m in holders if len(m.split(" ")) > depth}
    for m in leaf:
        for place, token in enumerate(m.split(" ")[depth:]):
            support[leaf[m], place, token] += len(holders[m])
    for m in holders:
        if fixed(m) and len(holders[m]) >= min_docs:
            first[m] = min(holders[m])
    for m in leaf:
        least = max(min_docs, support_share * len(leaves[leaf[m]]))
        shape = tuple(t if t != "<*>" and support[leaf[m], i, t] >= least else None for i, t in enumerate(m.split(" ")[depth:]))
        known = sum(t is not None for t in shape)
        if len(leaves[leaf[m]]) >= min_docs and known and known >= share * len(shape):
            groups[leaf[m], shape].append(m)
    for members in groups.values():
        docs = set().union(*(holders[m] for m in members))
        if len(docs) >= min_docs:
            for m in members:
                first[m] = min(first.get(m, 1 << 60), min(docs))
    same = {p: min(ids) for p, ids in verbatim.items() if len(ids) >= min_docs}

    def stays(i, line):
        m = mask(line)
        return not m or not (first.get(m, 1 << 60) < i or (not fixed(m) and same.get(line.strip(), 1 << 60) < i))

    return sorted((i, "\n".join(x for x in t.split("\n") if stays(i, x))) for i, t in rows)


def test_repeated_rows_count_once(spark):
    """A row repeated many times is one document: its words are no constants, its template stays the others'."""
    rows = [(i, f"sold to the buyer {n} for cash at noon\nown {n}") for i, n in enumerate("abcdef")]
    rows += [(20 + i, f"go to the {a} {b} {c} now") for i, (a, b, c) in enumerate(zip("abcd", "efgh", "ijkl"))]
    rows += [rows[0]] * 12 + [rows[6]] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text) for r in lt.drop_repeated_lines(docs, min_docs=4).collect())
    assert got == plain_lines(rows, 4)
    assert all((i, f"own {n}") in got for i, n in enumerate("abcdef") if i)


def test_the_pipeline_drops_every_line_that_recurs(spark):
    """Short lines, and lines of digits that are the same throughout; blank ones and digits that differ stay."""
    rows = [(i, f"Les.\n\nAnd ornd.\n  Tel: 555-1234 / 555-9999\n7 7 7 7\n{i} {i}\nPage {i}\n \nown {'abcdefghijkl'[i]}") for i in range(12)]
    rows += [(20 + i, "rare one") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert got == {i: t if i == 0 or i >= 20 else f"\n{i} {i}\nPage {i}\n \nown {'abcdefghijkl'[i]}" for i, t in rows}
    both = {r.doc_id: r.text for r in lt.drop_repeated_lines(docs, keep_first=False).collect()}
    assert both[0] == "\n0 0\nPage 0\n \nown a"


@pytest.mark.parametrize("url,host,path,rule", [
    ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"),
    ("http://example.net/en", "example.net", "/en", "net/"),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/"),
    ("http://example.net", "example.net", "", None),
    ("http://net/", "net", "/", "net/"),
    ("https://x.org/fr/?a=://b", "x.org", "/fr/", "org/fr/"),
    ("https://example.com/de/1", "example.com", "/de/1", "example.com/de/"),
    ("https://example.com?x/de/", "example.com", "", None),
    ("ftp://h#a://b/c", "h", "", None),
    ("no scheme", "", "", None), ("", "", "", None), (None, "", "", None), ("://É.Net/É", "É.net", "/É", "net/"),
])
def test_host_path_and_rule(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url, "x", "y")], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.filter_urls(df, labels).collect()
    assert [(r.page_id, r.host, r.path, r.rule) for r in got] == [(1, host, path, rule)]
    assert got[0].verdict == (dict(urls.RULES)[rule] if rule else "allow")


def test_reputation_is_shrunk(spark):
    """Many bad pages block a host; one does not, unless its domain is known for them."""
    rows, labels = [], []

    def add(host, n, bad):
        for i in range(n):
            rows.append((len(rows), f"http://{host}/p"))
            labels.append((len(rows) - 1, 1, int(i < bad)))

    add("bad.example.com", 60, 57)
    add("good.example.com", 60, 2)
    add("one.example.com", 1, 1)
    for i in range(30):
        add(f"h{i}.spam.info", 8, 8)
        add(f"h{i}.fine.info", 8, 0)
    add("new.spam.info", 1, 1)
    rows.append((len(rows), "http://unknown.fine.info/"))
    labels += [(0, 1, 0), (None, 0, 1), (5, None, None), (10**6, 0, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    verdicts = {r.host: r.verdict for r in urls.filter_urls(pages, frame).collect()}
    assert verdicts["bad.example.com"] == verdicts["new.spam.info"] == verdicts["h3.spam.info"] == "block"
    assert {verdicts[h] for h in ("good.example.com", "one.example.com", "unknown.fine.info", "h3.fine.info")} == {"allow"}


def test_few_groups_settle_nothing(spark):
    """One suffix, two bad pages of three: hosts without a labelled page are not blocked; many bad pages do it."""
    def verdicts(bad, good):
        rows = [(i, "http://a.example.com/") for i in range(bad + good)] + [(900, "http://b.example.com/"), (901, "http://c.other.com/")]
        labels = [(i, 1, int(i < bad)) for i in range(bad + good)]
        pages = spark.createDataFrame(rows, "page_id long, url string")
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        return {r.host: r.verdict for r in urls.filter_urls(pages, frame).collect()}

    assert set(verdicts(2, 1).values()) == {"allow"}
    assert verdicts(80, 0)["a.example.com"] == "block"


def test_reputation_changes_the_query(spark, tmp_path):
    """Pages that no rule fits are blocked by their host's outcomes, in the query as in its SQL."""
    import duckdb

    from codescan.llm.queries import OP9_SQL, op9_urls

    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 6}.info/p{i}") for i in range(240)]
    labels = [(i, 1, i % 2) for i in range(0, 240) if i % 12 < 10]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op9_urls(spark, str(tmp_path))
    order = sorted(got.columns)
    got = sorted(tuple(r) for r in got.select(*order).collect())
    assert Counter(r[order.index("verdict")] for r in got) == {"block": 120, "allow": 120}
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(order)} FROM ({OP9_SQL})").fetchall()) == got


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.filter_urls(pages, labels).collect() == []
