"""Queries: dependency manifests, advisories, commit history."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescan.operators import dependencies as dp
from codescan.operators import secrets
from codescan.plans.q_lines import LITERAL_RE2, entropy_sql, q
from codescan.plans.scan import scan
from codescan.plans.tables import derive, duck
from codescan.rules.languages import SECRET_PREFIXES
from codescan.session import work_folder
from codescan.sources import manifests, patches
from codescan.sources.advisories import read_osv_dump, read_osv_ranges

# --- lineitem × part: dependencies and advisories --------------------------------
# A package is a part number modulo 400; every fifth line leaves the version open.
DEPS_SQL = """
SELECT concat('m', CAST(l_orderkey AS STRING), '/requirements.txt') AS file, CAST(l_linenumber AS INT) AS line, 'PyPI' AS ecosystem,
       concat('pkg', CAST(l_partkey % 400 AS STRING)) AS name,
       CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat('1.', CAST(l_suppkey % 4 AS STRING)) END AS version
FROM {lineitem}
"""
ADVISORY_SQL = """
SELECT 'PyPI' AS ecosystem, concat('pkg', CAST(p_partkey % 500 AS STRING)) AS name,
       concat('1.', CAST(p_size % 4 AS STRING)) AS version, CAST(p_partkey AS INT) AS seq,
       concat('ADV-', CAST(p_partkey AS STRING)) AS id, concat(p_name, ' flaw') AS summary,
       CASE p_partkey % 6 WHEN 0 THEN 'CVSS:3.1/AV:N/AC:L' WHEN 1 THEN '9.8' WHEN 2 THEN 'score 5.0' WHEN 3 THEN '3.9'
            WHEN 4 THEN 'CVSS:3.1/AV:N/S:7.5' ELSE 'none' END AS score
FROM {part}
"""
DEPS, ADVISORIES = duck(DEPS_SQL, "lineitem"), duck(ADVISORY_SQL, "part")


def advisories(spark, sf):
    rows = derive(spark, sf, ADVISORY_SQL, "part")
    return rows.withColumn("severity", F.array(F.struct(F.lit("CVSS_V3").alias("type"), "score"))).drop("score")


def deps(spark, sf):
    return derive(spark, sf, DEPS_SQL, "lineitem")


def dependency_advisories(spark, sf):
    return dp.scan_dependencies(deps(spark, sf), advisories(spark, sf)).select(
        "file", "line", "severity", "message", "code_snippet")


DEPENDENCY = f"""
WITH a AS (SELECT *, CASE WHEN score = '9.8' OR score LIKE '%S:7.5' OR score IN ('none', 'CVSS:3.1/AV:N/AC:L') THEN 'HIGH'
                          WHEN score = 'score 5.0' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM ({ADVISORIES})),
pinned AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, name, version ORDER BY seq, id) AS rn FROM a),
loose AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY seq, id) AS rn FROM a),
hits AS (
  SELECT d.*, p.severity, p.id, p.summary FROM ({DEPS}) d JOIN pinned p USING (ecosystem, name, version) WHERE p.rn <= 3
  UNION ALL
  SELECT d.*, p.severity, p.id, p.summary FROM ({DEPS}) d JOIN loose p ON d.ecosystem = p.ecosystem AND d.name = p.name
  WHERE d.version = '' AND p.rn <= 3)
SELECT file, line, severity, substr('[SCA] ' || ecosystem || ' package ''' || name || '''' || CASE WHEN version <> '' THEN ' ' || version ELSE '' END
  || ' has known vulnerability ' || id || ': ' || summary, 1, 300) AS message,
  name || CASE WHEN version <> '' THEN ' ' || version ELSE '' END AS code_snippet FROM hits"""


def cap_advisories(spark, sf):
    rows = dp.first_advisories(advisories(spark, sf).drop("version"), ["ecosystem", "name"])
    return rows.select("name", F.explode("advisories").alias("a")).select("name", F.col("a._rn").alias("rank"), F.col("a.id").alias("id"))


CAP = f"""SELECT name, rn AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY seq, id) AS rn
FROM ({ADVISORIES})) WHERE rn <= 3"""

# --- advisories as a dump of records, with listed versions and with ranges ---------
OSV_SQL = """
SELECT concat('OSV-', lpad(CAST(p_partkey AS STRING), 9, '0')) AS id, concat(p_name, ' flaw') AS summary,
       array(named_struct('type', 'CVSS_V3', 'score', '9.8')) AS severity,
       array(named_struct('package', named_struct('ecosystem', 'PyPI', 'name', concat('pkg', CAST(p_partkey % 500 AS STRING))),
         'versions', CASE WHEN p_partkey % 3 <> 1 THEN array('1.2') END,
         'ranges', CASE WHEN p_partkey % 3 <> 0 THEN array(named_struct('type', 'ECOSYSTEM', 'events', array(
             named_struct('introduced', CASE p_size % 3 WHEN 0 THEN '0' ELSE concat('1.', CAST(p_size % 3 AS STRING), '.0') END, 'fixed', CAST(NULL AS STRING)),
             named_struct('introduced', CAST(NULL AS STRING), 'fixed', concat('v1.', CAST(p_size % 3 + 1 + p_size % 2 AS STRING)))))) END)) AS affected
FROM {part}
"""


def advisory_ranges(spark, sf):
    """Advisories written as a dump and read back; a version counts if it is listed or lies in a range."""
    path = work_folder(spark, "osv")
    derive(spark, sf, OSV_SQL, "part").write.json(path)
    found = dp.scan_dependencies(deps(spark, sf), read_osv_dump(spark, path), ranges=read_osv_ranges(spark, path))
    return found.select("file", "line", "severity", "code_snippet", F.regexp_extract("message", "vulnerability (\\S+):", 1).alias("id"))


RANGES = f"""
WITH a AS (SELECT 'OSV-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, 'pkg' || p_partkey % 500 AS name,
                  p_partkey % 3 <> 1 AS listed, p_partkey % 3 <> 0 AS ranged, p_size % 3 AS lo, p_size % 3 + 1 + p_size % 2 AS hi FROM part),
d AS (SELECT *, CASE WHEN version <> '' THEN CAST(substr(version, 3) AS INT) END AS v FROM ({DEPS})),
hits AS (SELECT d.*, a.id, row_number() OVER (PARTITION BY d.file, d.line, d.name, d.version, d.rid ORDER BY a.id) AS rn
         FROM (SELECT *, row_number() OVER () AS rid FROM d) d JOIN a USING (name)
         WHERE v IS NULL OR (listed AND v = 2) OR (ranged AND v >= lo AND v < hi))
SELECT file, line, 'HIGH' AS severity, name || CASE WHEN version <> '' THEN ' ' || version ELSE '' END AS code_snippet, id FROM hits WHERE rn <= 3"""

# --- the whole scan of repositories with manifests and ranges ------------------------
REPOS_SQL = """
SELECT concat('app', CAST(p_partkey AS STRING), '/requirements.txt') AS file,
       concat('pkg', CAST(p_partkey % 400 AS STRING), '==1.', CAST(p_size % 4 AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('.', CAST(p_partkey % 3 AS STRING)) END, chr(10),
              '# none', chr(10), 'pkg', CAST((p_partkey * 7) % 400 AS STRING), chr(10), 'pkg', CAST(p_partkey % 900 AS STRING), '==1.', CAST(p_size % 3 + 1 AS STRING), 'rc1') AS content
FROM {part}
UNION ALL
SELECT concat('app', CAST(p_partkey AS STRING), '/main.py'), concat('import os', chr(10), 'size = ', CAST(p_size AS STRING)) FROM {part}
"""


def scan_with_ranges(spark, sf):
    """The scan of a corpus with manifests: listed versions and ranges of a dump of advisories."""
    path = work_folder(spark, "osv")
    derive(spark, sf, OSV_SQL, "part").write.json(path)
    found, _ = scan(derive(spark, sf, REPOS_SQL, "part"), advisories=read_osv_dump(spark, path), ranges=read_osv_ranges(spark, path))
    return found.select("file", "line", "rule_id", "code_snippet", F.regexp_extract("message", "vulnerability (\\S+):", 1).alias("id"))


# A version is 1.v.w here; rc is one before its release.  Listed is 1.2 alone, and a range is [lo, hi) of v.
SCAN_RANGES = """
WITH a AS (SELECT 'OSV-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, 'pkg' || p_partkey % 500 AS name,
                  p_partkey % 3 <> 1 AS listed, p_partkey % 3 <> 0 AS ranged, p_size % 3 AS lo, p_size % 3 + 1 + p_size % 2 AS hi FROM part),
d AS (SELECT 'app' || p_partkey || '/requirements.txt' AS file, 1 AS line, 'pkg' || p_partkey % 400 AS name,
             '1.' || p_size % 4 || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || p_partkey % 3 END AS version, p_size % 4 * 2 AS pos FROM part
      UNION ALL SELECT 'app' || p_partkey || '/requirements.txt', 3, 'pkg' || (p_partkey * 7) % 400, '', NULL FROM part
      UNION ALL SELECT 'app' || p_partkey || '/requirements.txt', 4, 'pkg' || p_partkey % 900, '1.' || (p_size % 3 + 1) || 'rc1', (p_size % 3 + 1) * 2 - 1 FROM part),
hits AS (SELECT d.*, a.id, row_number() OVER (PARTITION BY d.file, d.line ORDER BY a.id) AS rn FROM d JOIN a USING (name)
         WHERE version = '' OR (listed AND version = '1.2') OR (ranged AND (lo = 0 OR pos >= lo * 2) AND pos < hi * 2))
SELECT file, line, 'SCA001' AS rule_id, name || CASE WHEN version <> '' THEN ' ' || version ELSE '' END AS code_snippet, id
FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY rn) AS first FROM hits) WHERE rn <= 3"""

# --- manifests written from part ------------------------------------------------
MANIFEST_SQL = """
SELECT concat('r', CAST(p_partkey AS STRING), CASE p_partkey % 7 WHEN 3 THEN '/node_modules/x/' WHEN 4 THEN '/distx/' ELSE '/' END, CASE p_partkey % 5 WHEN 0 THEN 'requirements-dev.txt' WHEN 1 THEN 'package.json'
              WHEN 2 THEN 'go.mod' WHEN 3 THEN 'pom.xml' ELSE 'notes.txt' END) AS file,
       CASE p_partkey % 5
         WHEN 0 THEN concat('# pins', chr(10), 'pkg-', CAST(p_size AS STRING), '[extra]==1.', CAST(p_partkey AS STRING), '; python_version > "3"',
                            chr(10), '-r other.txt', chr(10), chr(10), '  loose', chr(10), 'Other.Pkg >= 2.0, < 3')
         WHEN 1 THEN CASE WHEN p_partkey % 10 = 1 THEN 'not json' ELSE concat(chr(123), '"name": "x", "dependencies": ', chr(123), '"a', CAST(p_size AS STRING),
                            '": "^1.2.', CAST(p_partkey AS STRING), '"', chr(125), ', "devDependencies": ', chr(123), '"b": "~3.x"', chr(125), chr(125)) END
         WHEN 2 THEN concat('module m', chr(10), 'go 1.21', chr(10), 'require x.org/a v1.0.', CAST(p_partkey AS STRING), chr(10), 'require (', chr(10),
                            chr(9), 'x.org/b', CAST(p_size AS STRING), ' v2.3.4-rc.1 // indirect', chr(10), ')')
         ELSE concat('<project><dependencies><dependency>', chr(10), '<groupId>org.g</groupId><artifactId>a', CAST(p_size AS STRING),
                     '</artifactId><version>$', chr(123), 'v.', CAST(p_partkey AS STRING), chr(125), '</version></dependency>', chr(10),
                     '<dependency><artifactId>solo</artifactId></dependency></dependencies></project>') END AS content,
       p_partkey, p_size
FROM {part}
"""


def manifest_dependencies(spark, sf):
    return manifests.read_dependencies(derive(spark, sf, MANIFEST_SQL, "part"))


# What lies below an excluded folder is no dependency of the repository.
MANIFESTS = f"""WITH m AS (SELECT * FROM ({duck(MANIFEST_SQL, 'part')}) WHERE p_partkey % 7 <> 3)
SELECT file, 2 AS line, 'PyPI' AS ecosystem, 'pkg-' || p_size AS name, '1.' || p_partkey AS version FROM m WHERE p_partkey % 5 = 0
UNION ALL SELECT file, 5, 'PyPI', 'loose', '' FROM m WHERE p_partkey % 5 = 0
UNION ALL SELECT file, 6, 'PyPI', 'Other.Pkg', '2.0' FROM m WHERE p_partkey % 5 = 0
UNION ALL SELECT file, 1, 'npm', 'a' || p_size, '1.2.' || p_partkey FROM m WHERE p_partkey % 10 = 6
UNION ALL SELECT file, 1, 'npm', 'b', '3' FROM m WHERE p_partkey % 10 = 6
UNION ALL SELECT file, 3, 'Go', 'x.org/a', '1.0.' || p_partkey FROM m WHERE p_partkey % 5 = 2
UNION ALL SELECT file, 5, 'Go', 'x.org/b' || p_size, '2.3.4-rc.1' FROM m WHERE p_partkey % 5 = 2
UNION ALL SELECT file, 1, 'Maven', 'org.g:a' || p_size, 'v.' || p_partkey FROM m WHERE p_partkey % 5 = 3
UNION ALL SELECT file, 1, 'Maven', 'solo', '' FROM m WHERE p_partkey % 5 = 3"""


def manifest_kind(spark, sf):
    rows = derive(spark, sf, MANIFEST_SQL, "part")
    return rows.groupBy(manifests.manifest_kind(F.col("file")).alias("kind")).agg(F.count("*").alias("files"))


KINDS = f"""SELECT CASE p_partkey % 5 WHEN 0 THEN 'requirements' WHEN 1 THEN 'package_json' WHEN 2 THEN 'go_mod' WHEN 3 THEN 'pom' END AS kind,
  count(*) AS files FROM ({duck(MANIFEST_SQL, 'part')}) GROUP BY 1"""

# --- conversations as commit patches --------------------------------------------
# Each turn is a patch of two hunks in one file: the text, then a fixed line.
PATCH_SQL = """
SELECT concat('c', CAST(conv_id AS STRING), 't', CAST(turn AS STRING)) AS sha, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS commit_ts,
       concat('commit x', chr(10), 'diff --git a/f', CAST(conv_id AS STRING), '.txt b/f', CAST(conv_id AS STRING), '.txt', chr(10),
              '--- a/f', chr(10), '+++ b/f', chr(10), '@@ -0,0 +', CAST(turn * 10 + 1 AS STRING), ',9 @@', chr(10), '+',
              replace(text, chr(10), concat(chr(10), '+')), chr(10), '-gone', chr(10), '@@ -5 +', CAST(turn + 900 AS STRING), ' @@ def f', chr(10),
              '+key = "AKIA', upper(substr(md5(CAST(conv_id AS STRING)), 1, 16)), '"', chr(10), '+++double', chr(10)) AS patch
FROM {conversations}
"""


def patch_rows(spark, sf):
    return derive(spark, sf, PATCH_SQL, "conversations")


def patch_line_numbers(spark, sf):
    return patches.added_lines(patch_rows(spark, sf)).select("sha", "file", "line", "text")


_PATCH_LINES = """
SELECT 'c' || conv_id || 't' || turn AS sha, 'f' || conv_id || '.txt' AS file, turn * 10 + unnest(range(1, len(p) + 1)) AS line, unnest(p) AS text
FROM (SELECT *, string_split(text, chr(10)) AS p FROM conversations)
UNION ALL SELECT 'c' || conv_id || 't' || turn, 'f' || conv_id || '.txt', turn + 900,
  'key = "AKIA' || upper(substr(md5(CAST(conv_id AS VARCHAR)), 1, 16)) || '"' FROM conversations"""


def history_secrets(spark, sf):
    rows = secrets.scan_history(patches.added_lines(patch_rows(spark, sf)))
    return rows.select("sha", "file", "line", "code_snippet", F.col("message").startswith("High-entropy").alias("literal"))


_PREFIX = " OR ".join(f"contains(o.line, {q(p)})" for p in SECRET_PREFIXES)
HISTORY = f"""
WITH lines AS (SELECT sha || '|' || file AS file, 'none' AS language, line AS line_no, text AS line FROM ({_PATCH_LINES})),
ok AS (SELECT * FROM lines WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^(#|//)')),
lit AS (SELECT file, line, arg_min(v, ord) AS v FROM (
  SELECT f.file, f.line, f.ord, regexp_extract_all(o.line, {LITERAL_RE2})[f.ord + 1] AS raw,
         substr(raw, 2, length(raw) - 2) AS v
  FROM ({entropy_sql('ok')}) f JOIN ok o ON o.file = f.file AND o.line_no = f.line) GROUP BY 1, 2)
SELECT split_part(o.file, '|', 1) AS sha, split_part(o.file, '|', 2) AS file, o.line_no AS line,
       substr(coalesce(l.v, trim(o.line)), 1, 100) AS code_snippet, l.v IS NOT NULL AS literal
FROM ok o LEFT JOIN lit l ON o.file = l.file AND o.line_no = l.line WHERE l.v IS NOT NULL OR {_PREFIX}"""

def recent_commits(spark, sf):
    """Added lines of the last hundred commits; of one time the first by sha."""
    return patches.added_lines(patches.recent_commits(patch_rows(spark, sf), 100)).groupBy("sha").agg(F.count("*").alias("lines"))


RECENT = f"""SELECT sha, count(*) AS lines FROM ({_PATCH_LINES}) WHERE sha IN (
  SELECT 'c' || conv_id || 't' || turn FROM conversations ORDER BY 'c' || conv_id || 't' || turn LIMIT 100) GROUP BY sha"""

QUERIES = {
    "scan_with_ranges": (scan_with_ranges, SCAN_RANGES),
    "recent_commits": (recent_commits, RECENT),
    "dependency_advisories_top3": (dependency_advisories, DEPENDENCY),
    "advisory_ranges": (advisory_ranges, RANGES),
    "cap_advisories": (cap_advisories, CAP),
    "manifest_dependencies": (manifest_dependencies, MANIFESTS),
    "manifest_kind": (manifest_kind, KINDS),
    "patch_line_numbers": (patch_line_numbers, _PATCH_LINES),
    "history_secrets": (history_secrets, HISTORY),
}
