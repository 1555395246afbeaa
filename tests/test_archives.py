"""Archives read in ranges: every member once, whatever the split."""

import zipfile

import pytest

from codescan.sources import archives


def fill(path, names, body=lambda n: n * 50):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.writestr(n, body(n))


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "zips"
    (top / "deep").mkdir(parents=True)
    fill(top / "large.zip", [f"src/f{i}.py" for i in range(500)])
    fill(top / "deep/small one.zip", ["a.py", "empty.py", "ünï.py"], lambda n: "" if n == "empty.py" else n)
    fill(top / "none.zip", [])
    fill(top / "climbs.zip", ["ok.py", "a/../../b.py"])
    fill(top / "backslash.zip", ["ok.py", "..\\b.py"])
    fill(top / "absolute.zip", ["ok.py", "/etc/b.py"])
    (top / "no.zip").write_bytes(b"no archive")
    (top / "void.zip").write_bytes(b"")
    (top / "_SUCCESS").write_bytes(b"")
    return top


def want():
    out = {("large.zip", f"src/f{i}.py", f"src/f{i}.py" * 50) for i in range(500)}
    return out | {("small one.zip", "a.py", "a.py"), ("small one.zip", "empty.py", ""), ("small one.zip", "ünï.py", "ünï.py")}


@pytest.mark.parametrize("size", [700, 5000, archives.SPLIT_BYTES])
def test_every_member_once(spark, folder, size):
    df = archives.read_archives(spark, str(folder), size)
    got = [(r.archive.rsplit("/", 1)[1], r.file, r.content) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want()
    if size == 700:
        assert df.rdd.getNumPartitions() > 50


def test_scheme_and_single_file(spark, folder):
    one = archives.read_archives(spark, f"file://{folder}/large.zip", 5000)
    assert one.count() == 500 and {r.archive for r in one.select("archive").collect()} == {f"file://{folder}/large.zip"}
    # A name of the folder can be given back to the reader.
    again = archives.read_archives(spark, str(folder)).where("archive like '%small one.zip'").first().archive
    assert archives.read_archives(spark, again).count() == 3


def test_empty_folder_and_missing_path(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert archives.read_archives(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        archives.read_archives(spark, str(tmp_path / "missing")).count()


def test_member_that_cannot_be_read(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("good.py", "good")
        z.writestr("bad.py", "payload")
    path.write_bytes(path.read_bytes().replace(b"payload", b"pAyload"))
    got = {r.file: r.content for r in archives.read_archives(spark, str(path)).collect()}
    assert got == {"good.py": "good", "bad.py": None}


def test_small_archives_share_a_task():
    splits = archives.pack([(f"a{i}", 10) for i in range(200)] + [("big", 200 << 20)], 64 << 20)
    ranges = [r for s in splits for r in s.ranges]
    assert len(ranges) == 204 and len(splits) < 12
    assert sum(e - s for p, s, e in ranges if p == "big") == 200 << 20


def test_many_small_ranges_share_tasks():
    """The number of tasks is bounded, however small the ranges; an archive is opened about once."""
    files = [(f"a{i}", 100 << 10) for i in range(30_000)]
    splits = archives.pack(files, 16 << 10)
    ranges = sorted(r for s in splits for r in s.ranges)
    assert len(splits) < 2 * archives.TASKS and len(ranges) < 1.2 * len(files)
    assert sum(e - b for _, b, e in ranges) == len(files) * (100 << 10)
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(ranges, ranges[1:]))
    assert len(archives.pack(files[:10], 16 << 10)) == 70
