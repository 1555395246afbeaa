"""Source files as a (file, content, language) table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescan.rules import languages as lang
from codescan.sources.archives import BATCH_BYTES, leaves_archive

BATCH_ROWS = 10_000


def read_corpus(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, content) of every file below a path, or of the one file it names.

    For large corpora compact the result to parquet once: listing many small files is
    the slow part, not scanning them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    return reader.load(path).select(
        name.alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def detect_language(path: Column, content: Column | None = None) -> Column:
    """Language by file name, then extension, then (YAML) by content; NULL when unknown."""
    name = F.lower(base_name(path))
    suffix = F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)
    lookup = lambda table, key: F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)
    out = F.coalesce(lookup(lang.LANGUAGE_BY_NAME, name), lookup(lang.LANGUAGE_BY_EXTENSION, suffix))
    if content is None:
        return out
    workflow = suffix.isin("yml", "yaml") & content.rlike(r"(?m)^on\s*:") & content.rlike(r"(?m)^jobs\s*:")
    return F.coalesce(out, F.when(workflow, "gha"))


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", detect_language(F.col("file"), F.col("content"))).where(
        F.col("language").isNotNull())


def in_excluded_dir(path: Column, names=lang.EXCLUDED_DIRS) -> Column:
    """Whether a path component equals a name, or a pattern with ``*`` or ``/`` matches."""
    plain = [n for n in names if "*" not in n and "/" not in n]
    globs = [n for n in names if n not in plain]
    out = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in plain])) if plain else F.lit(False)
    for g in globs:
        body = re.escape(g).replace(r"\*", "[^/]*")
        out = out | path.rlike(f"(^|/){body}(/|$)")
    return out


def is_third_party(path: Column) -> Column:
    name = F.lower(base_name(path))
    in_dir = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in lang.THIRD_PARTY_DIRS]))
    known = name.rlike("|".join(lang.THIRD_PARTY_NAMES))
    return name.isin(*lang.THIRD_PARTY_FILES) | name.rlike(r"\.min\.(js|css)$") | (in_dir & known)


def named_by_repo(files: DataFrame) -> DataFrame:
    """A file is named once: in a corpus of several repositories the ``repo`` column leads its path."""
    if "repo" not in files.columns:
        return files
    return files.withColumn("file", F.concat_ws("/", "repo", "file")).drop("repo")


def scannable(files: DataFrame, exclude=lang.EXCLUDED_DIRS) -> DataFrame:
    """Files to scan; path tests come first, so excluded contents are never decoded."""
    files = named_by_repo(files)
    kept = files.where(~in_excluded_dir(F.col("file"), exclude) & ~is_third_party(F.col("file")))
    return with_language(kept)


def changed_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Only files in the changed-path list; AQE broadcasts the list when it is small."""
    return files.join(changed.select("file").distinct(), "file", "left_semi")


def _is_unsafe(blob: bytes | None) -> bool:
    """Whether an archive is no zip or has a member that leaves it; only its list of members is read."""
    if not zipfile.is_zipfile(io.BytesIO(blob)):
        return True
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        return any(leaves_archive(info.filename) for info in z.infolist() if not info.is_dir())


def _unsafe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The paths of unsafe archives."""
    for batch in batches:
        yield pd.DataFrame({"path": [path for path, blob in zip(batch["path"], batch["content"]) if _is_unsafe(blob)]}, dtype=object)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per archive member, some megabytes at a time; a member that leaves the archive has no text."""
    rows: list[tuple] = []
    held = 0
    made = lambda: pd.DataFrame(rows, columns=["archive", "file", "content"])
    for batch in batches:
        for path, blob in zip(batch["path"], batch["content"]):
            if not zipfile.is_zipfile(io.BytesIO(blob)):
                rows.append((path, "", ""))
                continue
            with zipfile.ZipFile(io.BytesIO(blob)) as z:
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    body = "" if leaves_archive(info.filename) else z.read(info).decode("utf-8", errors="ignore")
                    rows.append((path, info.filename, body))
                    held += len(body)
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield made()
                        rows, held = [], 0
    if rows:
        yield made()


def expand_archives(archives: DataFrame) -> DataFrame:
    """(archive, file, content) of zip archives given as (path, content binary).

    An archive with an absolute or ``..`` entry, or one that is no zip, is rejected as a whole, before it is expanded.
    """
    given = archives.select("path", "content")
    bad = given.mapInPandas(_unsafe, "path string").distinct()
    return given.join(bad, "path", "left_anti").select("path", "content").mapInPandas(
        _entries, "archive string, file string, content string")


def validate_repo_url(url: Column) -> Column:
    """struct(clean_url, name); NULL unless https, an allowed host and owner/repo."""
    url = F.trim(url)
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")
    owner, repo = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    ok = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & host.isin(*lang.GIT_HOSTS) & (F.size(parts) >= 2)
    return F.when(ok, F.struct(
        F.concat(F.lit("https://"), host, F.lit("/"), owner, F.lit("/"), repo, F.lit(".git")).alias("clean_url"),
        F.concat(owner, F.lit("/"), repo).alias("name")))
