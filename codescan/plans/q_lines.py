"""Queries: file selection, line hygiene, rule matching, secrets."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescan.functions import text as tx
from codescan.operators import findings as fd
from codescan.operators import lines as ln
from codescan.operators import match, secrets
from codescan.plans import tables as tb
from codescan.plans.tables import derive, duck
from codescan.rules import languages as lang
from codescan.rules.metadata import metadata_rows
from codescan.rules.regex_packs import SKIP_LINES, line_rules
from codescan.sources import corpus

SLIM = ["file", "line", "rule_id", "severity", "language", "message", "code_snippet", "confidence", "cwe", "owasp"]


def slim(findings):
    return findings.select(*SLIM)


def q(text: str) -> str:
    """SQL literal of a text."""
    return "'" + text.replace("'", "''") + "'"


def q_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# --- shared pieces of checking SQL ----------------------------------------------
BLANKS = q(tx.BLANKS)
QUOTED_RE2 = q(tx.QUOTED.replace("*+", "*"))
LITERAL_RE2 = q(r'"[^"\\]{12,}(?:\\.[^"\\]*)*"|' r"'[^'\\]{12,}(?:\\.[^'\\]*)*'")


def lines_sql(files_sql: str, blank: bool = False) -> str:
    """CTEs ``files`` and ``lines`` of a files query."""
    keep = "" if blank else f"WHERE trim(line, {BLANKS}) <> ''"
    return f"""
files AS ({files_sql}),
pieces AS (SELECT file, language, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM (
  SELECT file, language, string_split_regex(content, {q(tx.LINE_BREAK)}) AS p FROM files)),
every AS (SELECT file, language, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM pieces),
lines AS (SELECT * FROM every {keep})"""


def comment_sql(line="line") -> str:
    s = f"trim({line}, {BLANKS})"
    return (f"((language IN {q_list(lang.HASH_COMMENT)} AND starts_with({s}, '#')) OR "
            f"(language IN {q_list(lang.SLASH_COMMENT)} AND starts_with({s}, '//')))")


def nosec_sql(line="line") -> str:
    return (f"((language IN {q_list(lang.NOSEC_HASH)} AND contains(lower({line}), '# nosec')) OR "
            f"(language IN {q_list(lang.NOSEC_SLASH)} AND contains(lower({line}), '// nosec')))")


def rules_sql(source: str, rules=None) -> str:
    """SELECT of all findings of the rules on rows (file, language, line_no, line) of ``source``."""
    selects = []
    for r in (line_rules() if rules is None else rules):
        if "\\1" in r.pattern or "(?!" in r.pattern:
            continue  # back-reference or look-ahead: the engine has none; no such language in these rows
        subject = f"regexp_replace(line, {q('(?i)' + r.erase)}, ' ', 'g')" if r.erase else "line"
        cond = [f"language = {q(r.language)}", f"regexp_matches({subject}, {q('(?i)' + r.pattern)})"]
        if r.language == "python":
            if r.rule_id in match.LITERAL_RULES:
                cond.append(f"NOT regexp_matches(trim(line, {BLANKS}), {q(chr(94) + '[' + chr(34) + chr(39) + ']')})")
            else:
                before = f"regexp_extract(line, {q('(?is)^(.*?)(?:' + r.pattern + ')')}, 1)"
                cond.append(f"NOT (regexp_matches(regexp_replace({before}, {QUOTED_RE2}, '', 'g'), '[\"''#]') "
                            f"OR substr(line, length({before}) + 1, 1) IN ('\"', ''''))")
        skip = SKIP_LINES.get((r.language, r.rule_id))
        if skip:
            cond.append(f"NOT regexp_matches(line, {q(skip)})")
        selects.append(
            f"SELECT file, line_no AS line, {q(r.rule_id)} AS rule_id, {q(r.severity)} AS severity, language, "
            f"{q(r.message)} AS message, substr(trim(line, {BLANKS}), 1, 120) AS code_snippet, 'LOW' AS confidence, "
            f"{q(r.cwe)} AS cwe, {q(r.owasp)} AS owasp, 1 AS engine_ord, {r.ord} AS ord FROM {source} WHERE "
            + " AND ".join(cond))
    return "\nUNION ALL\n".join(selects)


def entropy_sql(source: str) -> str:
    """SELECT of SEC001E findings on rows of ``source`` (comments and exempt lines are dropped here)."""
    prefixes = " OR ".join(f"starts_with(v, {q(p)})" for p in lang.SECRET_PREFIXES)
    return f"""
SELECT file, line_no AS line, 'SEC001E' AS rule_id, 'HIGH' AS severity, language,
       printf({q(secrets.ENTROPY_MESSAGE)}, ent)
         AS message,
       substr(trim(line, {BLANKS}), 1, 120) AS code_snippet, 'MEDIUM' AS confidence, 'CWE-798' AS cwe,
       'A07:2021' AS owasp, 2 AS engine_ord, pos AS ord
FROM (
  SELECT *, -list_sum(list_transform(list_distinct(chars), lambda c:
              (list_count(list_filter(chars, lambda d: d = c))::DOUBLE / len(chars))
              * log2(list_count(list_filter(chars, lambda d: d = c))::DOUBLE / len(chars)))) AS ent
  FROM (
    SELECT file, language, line_no, line, pos, v, string_split(v, '') AS chars
    FROM (SELECT file, language, line_no, line, unnest(range(0, len(lits))) AS pos,
                 unnest(list_transform(lits, lambda x: substr(x, 2, length(x) - 2))) AS v
          FROM (SELECT *, regexp_extract_all(line, {LITERAL_RE2}) AS lits FROM {source}
                WHERE NOT {comment_sql()} AND NOT {nosec_sql()}))
    WHERE length(v) >= 12 AND NOT regexp_matches(v, '^(https?://|//|/\\*|\\*/)') AND NOT regexp_matches(v, '[ ()]')
      AND length(v) - length(replace(v, '/', '')) <= 4))
WHERE ent >= CASE WHEN {prefixes} THEN 3.0 WHEN length(v) >= 20 AND regexp_matches(v, '^[0-9a-fA-F]+$') THEN 3.5
                  WHEN length(v) >= 20 AND regexp_matches(v, '^[A-Za-z0-9+/=_-]+$') THEN 4.0
                  WHEN length(v) >= 20 THEN 5.0 END"""


COLS = ", ".join(SLIM)
DOC_FILES = duck(tb.FILES_SQL, "documents")
WEB_FILES = duck(tb.WEB_SQL, "pages")
CODE_LINES = duck(tb.CODE_LINES_SQL, "lineitem")


def documents(spark, sf):
    return derive(spark, sf, tb.FILES_SQL, "documents")


def code_lines(spark, sf):
    rows = derive(spark, sf, tb.CODE_LINES_SQL, "lineitem")
    # The one-element array keeps later filters from repeating the text expression.
    return rows.select("file", "language", "line_no", F.explode(F.array("line")).alias("line"))


def secret_rules():
    return [r for r in line_rules() if r.rule_id == "SEC001"]


# --- secret scan: the flagship --------------------------------------------------
def secret_findings(spark, sf):
    return fd.dedupe_findings(secrets.scan_text(documents(spark, sf), secret_rules()))


def secret_scan(spark, sf):
    return (
        secret_findings(spark, sf).groupBy("language", "rule_id", "severity")
        .agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))
    )


SECRET_CTE = f"""{lines_sql(DOC_FILES)},
clean AS (SELECT * FROM lines WHERE NOT {comment_sql()} AND NOT {nosec_sql()}),
found AS ({rules_sql('clean', secret_rules())} UNION ALL {entropy_sql('lines')}),
secret_found AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY file, line, rule_id
  ORDER BY engine_ord, ord) AS rn FROM found) WHERE rn = 1)"""

# --- line filters ---------------------------------------------------------------
PATHS_SQL = """
SELECT concat(CASE p_partkey % 7 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'app/lib/'
                   WHEN 3 THEN 'pkg.egg-info/' WHEN 4 THEN 'a/build/' WHEN 5 THEN 'lib/python/x/' ELSE '' END,
              CASE p_partkey % 23 WHEN 0 THEN 'a.py' WHEN 1 THEN 'B.TSX' WHEN 2 THEN 'Makefile' WHEN 3 THEN 'x.cmake'
                   WHEN 4 THEN 'Dockerfile.dev' WHEN 5 THEN 'ci.yml' WHEN 6 THEN 'ci.yaml' WHEN 7 THEN 'x.yml'
                   WHEN 8 THEN 'jquery-3.js' WHEN 9 THEN 'app.min.js' WHEN 10 THEN 'markdown.php' WHEN 11 THEN 'x.go'
                   WHEN 12 THEN 'x.java' WHEN 13 THEN 'x.sh' WHEN 14 THEN 'x.h' WHEN 15 THEN 'noext'
                   WHEN 16 THEN '.py' WHEN 17 THEN 'x.tar.gz' WHEN 18 THEN 'style.min.css' WHEN 19 THEN 'CMakeLists.txt'
                   WHEN 20 THEN 'x.jsx' WHEN 21 THEN 'bootstrap.py' ELSE 'x.php' END) AS file,
       CASE p_partkey % 23 WHEN 5 THEN concat('name: x', chr(10), 'on: push', chr(10), 'jobs:', chr(10))
                           WHEN 6 THEN concat('jobs :', chr(10), 'on :', chr(10)) WHEN 7 THEN concat('on: x', chr(10))
                           ELSE 'text' END AS content, p_partkey
FROM {part}
"""
PATHS = duck(PATHS_SQL, "part")
_NAME = "lower(regexp_extract(file, '([^/]*)$', 1))"
_SUFFIX = f"regexp_extract({_NAME}, '[^.][.]([^.]+)$', 1)"


def paths(spark, sf):
    return derive(spark, sf, PATHS_SQL, "part")


def language_detect(spark, sf):
    return paths(spark, sf).select(
        "p_partkey", "file", corpus.detect_language(F.col("file"), F.col("content")).alias("language"))


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


LANGUAGE_DETECT = f"""
SELECT p_partkey, file, coalesce({_case(lang.LANGUAGE_BY_NAME, _NAME)}, {_case(lang.LANGUAGE_BY_EXTENSION, _SUFFIX)},
  CASE WHEN {_SUFFIX} IN ('yml', 'yaml') AND regexp_matches(content, '(?m)^on\\s*:')
            AND regexp_matches(content, '(?m)^jobs\\s*:') THEN 'gha' END) AS language
FROM ({PATHS})"""


def exclude_dirs(spark, sf):
    return paths(spark, sf).where(~corpus.in_excluded_dir(F.col("file"))).select("p_partkey", "file")


_PLAIN = [n for n in lang.EXCLUDED_DIRS if "*" not in n and "/" not in n]
EXCLUDE_DIRS = f"""
SELECT p_partkey, file FROM ({PATHS})
WHERE NOT list_has_any(string_split(file, '/'), [{', '.join(q(n) for n in _PLAIN)}])
  AND NOT regexp_matches(file, '(^|/)[^/]*[.]egg-info(/|$)') AND NOT regexp_matches(file, '(^|/)lib/python(/|$)')"""


def third_party_filter(spark, sf):
    return paths(spark, sf).where(~corpus.is_third_party(F.col("file"))).select("p_partkey", "file")


THIRD_PARTY = f"""
SELECT p_partkey, file FROM (SELECT *, {_NAME} AS name FROM ({PATHS}))
WHERE NOT (name IN {q_list(lang.THIRD_PARTY_FILES)} OR ends_with(name, '.min.js') OR ends_with(name, '.min.css')
  OR (list_has_any(string_split(file, '/'), [{', '.join(q(n) for n in lang.THIRD_PARTY_DIRS)}])
      AND ({' OR '.join(f"contains(name, {q(n)})" for n in lang.THIRD_PARTY_NAMES)})))"""


def changed_files(spark, sf):
    changed = derive(spark, sf, "SELECT concat(source, '/', CAST(doc_id AS STRING)) AS file "
                                "FROM {documents} JOIN {labels} USING (doc_id)", "documents", "labels")
    out = corpus.changed_files(documents(spark, sf), changed)
    return out.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


CHANGED_FILES = f"""
SELECT language, count(*) AS files, sum(length(content)) AS chars FROM ({DOC_FILES})
WHERE file IN (SELECT source || '/' || CAST(doc_id AS VARCHAR) FROM documents JOIN labels USING (doc_id)) GROUP BY language"""


def line_counts(spark, sf):
    return ln.explode_lines(documents(spark, sf)).groupBy("file", "language").agg(
        F.count("*").alias("lines"), F.max("line_no").alias("last_line"), F.sum(F.length("line")).alias("chars"))


LINE_COUNTS = f"""WITH {lines_sql(DOC_FILES)}
SELECT file, language, count(*) AS lines, max(line_no) AS last_line, sum(length(line)) AS chars FROM lines GROUP BY ALL"""


def comment_filter(spark, sf):
    return ln.drop_comment_lines(code_lines(spark, sf)).select("file", "line_no", "line")


def nosec_filter(spark, sf):
    return ln.drop_nosec(code_lines(spark, sf)).select("file", "line_no", "line")


def block_comment_state(spark, sf):
    return ln.drop_block_comment_lines(code_lines(spark, sf), block=tb.LINE_STEP).select("file", "language", "line_no")


def block_sql(source: str) -> str:
    """Lines of ``source`` outside block comments."""
    return f"""
SELECT file, language, line_no FROM (
  SELECT *, coalesce(last_value(CASE WHEN contains(line, '*/') THEN 'close' WHEN contains(line, '/*') THEN 'open' END
    IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'close') AS state
  FROM {source})
WHERE NOT (language IN {q_list(lang.BLOCK_COMMENT)} AND (state = 'open' OR contains(line, '/*')))"""


BLOCK_STATE = block_sql(f"({CODE_LINES})")

COMMENTED_SQL = """
SELECT concat('p', CAST(p_partkey AS STRING)) AS file,
       CASE WHEN p_partkey % 4 = 0 THEN 'python' ELSE 'java' END AS language,
       concat('a = 1;', chr(10), CASE p_partkey % 5 WHEN 0 THEN '/* one line */ b = 2;' WHEN 1 THEN '/* open'
              WHEN 2 THEN 'c = 3; // x' WHEN 3 THEN concat('/* a', chr(10), chr(10), 'b */ c') ELSE '*/ d /* e' END,
              chr(10), 'mid = ', p_name, chr(10), CASE WHEN p_partkey % 3 = 0 THEN 'end */ f' ELSE 'g' END,
              chr(10), 'last = 1;') AS content
FROM {part}
"""


def block_comment_blank(spark, sf):
    """The in-row form on whole texts keeps the same lines as the running state."""
    files = derive(spark, sf, COMMENTED_SQL, "part")
    return ln.explode_lines(ln.drop_block_comments(files)).select("file", "line_no", "line")


BLOCK_BLANK = f"""WITH {lines_sql(duck(COMMENTED_SQL, 'part'), blank=True)}
SELECT file, line_no, line FROM (
  SELECT *, coalesce(last_value(CASE WHEN contains(line, '*/') THEN 'close' WHEN contains(line, '/*') THEN 'open' END
    IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'close') AS state
  FROM lines)
WHERE NOT (language = 'java' AND (state = 'open' OR contains(line, '/*'))) AND trim(line) <> ''"""


def logical_lines(spark, sf):
    got = ln.logical_lines(ln.all_lines(documents(spark, sf)))
    return got.select("file", "language", "line_no", F.md5("line").alias("line_md5"))


def logical_sql(files_sql: str) -> str:
    """CTEs up to ``logical`` (file, language, line_no, line): the clamped depth as running sum plus running maximum."""
    return f"""{lines_sql(files_sql, blank=True)},
marks AS (
  SELECT file, language, line_no, rtrim(line, {BLANKS}) AS t,
    list_filter(string_split(line, ''), lambda c: contains('()[]{{}}', c) AND c <> '') AS br FROM lines),
nets AS (
  SELECT *, CASE WHEN language = 'python' THEN 0 ELSE list_sum(list_transform(br, lambda c: CASE WHEN contains('([{{', c) THEN 1 ELSE -1 END)) END AS net,
    CASE WHEN language = 'python' OR len(br) = 0 THEN 0 ELSE
      list_reduce(list_prepend(0, list_transform(br, lambda c: CASE WHEN contains('([{{', c) THEN 1 ELSE -1 END)),
                  lambda d, x: greatest(d + x, 0)) END AS fold FROM marks),
sums AS (SELECT *, sum(coalesce(net, 0)) OVER (PARTITION BY file ORDER BY line_no) AS s FROM nets),
depths AS (SELECT *, s + greatest(max(fold - s) OVER (PARTITION BY file ORDER BY line_no), 0) AS depth FROM sums),
flags AS (SELECT *, language <> 'python' AND (depth > 0 OR ends_with(t, '\\')) AS more FROM depths),
grp AS (SELECT *, coalesce(sum(CASE WHEN more THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM flags),
firsts AS (SELECT *, min(CASE WHEN t <> '' THEN line_no END) OVER (PARTITION BY file, g) AS f FROM grp),
logical AS (SELECT file, language, f AS line_no,
       string_agg(CASE WHEN line_no = f THEN t ELSE ' ' || trim(t, {BLANKS}) END, '' ORDER BY line_no) AS line
  FROM firsts WHERE line_no >= f GROUP BY file, language, g, f)"""


LOGICAL_LINES = f"WITH {logical_sql(DOC_FILES)} SELECT file, language, line_no, md5(line) AS line_md5 FROM logical"


# --- rules ----------------------------------------------------------------------
def rule_lines(lines):
    """Lines that the rules see: no comments, no block comments, no exempt lines."""
    return ln.drop_nosec(ln.drop_comment_lines(ln.drop_block_comment_lines(lines, block=tb.LINE_STEP)))


def regex_rule_match(spark, sf):
    return slim(match.match_rules(rule_lines(code_lines(spark, sf))))


RULE_LINES = f"""lines AS ({CODE_LINES}), outside AS ({BLOCK_STATE}),
clean AS (SELECT * FROM lines SEMI JOIN outside USING (file, line_no) WHERE NOT {comment_sql()} AND NOT {nosec_sql()})"""
REGEX_MATCH = f"WITH {RULE_LINES}, found AS ({rules_sql('clean')}) SELECT {COLS} FROM found"


def document_rule_match(spark, sf):
    return slim(match.scan_lines(documents(spark, sf)))


DOCUMENT_MATCH = f"""WITH {lines_sql(DOC_FILES)},
clean AS (SELECT * FROM lines WHERE NOT {comment_sql()} AND NOT {nosec_sql()}), found AS ({rules_sql('clean')})
SELECT {COLS} FROM found"""


def web_rule_match(spark, sf):
    return slim(match.scan_lines(derive(spark, sf, tb.WEB_SQL, "pages")))


WEB_MATCH = f"""WITH {lines_sql(WEB_FILES)}, outside AS ({block_sql('lines')}),
clean AS (SELECT * FROM lines SEMI JOIN outside USING (file, line_no) WHERE NOT {comment_sql()} AND NOT {nosec_sql()}),
found AS ({rules_sql('clean', [r for r in line_rules() if r.language == 'javascript'])}) SELECT {COLS} FROM found"""


def rule_meta_join(spark, sf):
    found = derive(spark, sf, tb.FINDINGS_SQL, "lineitem").drop("cwe", "owasp")
    return fd.attach_rule_meta(found).groupBy("rule_id", "cwe", "owasp").agg(F.count("*").alias("n"))


META_VALUES = ", ".join(f"({q(r)}, {q(c)}, {q(o)})" for r, c, o in metadata_rows())
META_JOIN = f"""
SELECT f.rule_id, coalesce(m.cwe, '') AS cwe, coalesce(m.owasp, '') AS owasp, count(*) AS n
FROM ({duck(tb.FINDINGS_SQL, 'lineitem')}) f LEFT JOIN (VALUES {META_VALUES}) m(rule_id, cwe, owasp) ON f.rule_id = m.rule_id
GROUP BY ALL"""


def more_lines(spark, sf):
    return derive(spark, sf, tb.MORE_LINES_SQL, "customer")


def other_language_rules(spark, sf):
    """Shell, C, Dockerfile, workflow and build lines."""
    return slim(match.match_rules(rule_lines(more_lines(spark, sf))))


MORE = duck(tb.MORE_LINES_SQL, "customer")
# The checking engine has no back references: a use after free is known by its line.
_REUSE = next(r for r in line_rules() if "\\1" in r.pattern and r.language == "c")


def more_sql(source: str) -> str:
    return f"""{rules_sql(source)} UNION ALL
SELECT file, line_no, {q(_REUSE.rule_id)}, {q(_REUSE.severity)}, language, {q(_REUSE.message)}, line, 'LOW', {q(_REUSE.cwe)}, {q(_REUSE.owasp)}, 1, {_REUSE.ord}
FROM {source} WHERE language = 'c' AND line = 'free(p); return p->next;'"""


OTHER_LANGUAGES = f"""WITH clean AS (SELECT * FROM ({MORE}) WHERE NOT {comment_sql()} AND NOT {nosec_sql()}), found AS ({more_sql('clean')})
SELECT {COLS} FROM found"""


def rule_catalogue(spark, sf):
    """Hits of each rule on every line of code, documents, pages and further languages, rules without a hit included."""
    rules = line_rules()
    dim = spark.createDataFrame([(r.ord, r.rule_id, r.language, r.severity) for r in rules],
                                "ord int, rule_id string, language string, severity string")
    found = match.match_rules(rule_lines(code_lines(spark, sf))).select("ord").unionByName(
        match.scan_lines(documents(spark, sf)).select("ord")).unionByName(
        match.scan_lines(derive(spark, sf, tb.WEB_SQL, "pages")).select("ord")).unionByName(
        match.match_rules(rule_lines(more_lines(spark, sf))).select("ord"))
    hits = found.groupBy("ord").agg(F.count("*").alias("hits"))
    return dim.join(hits, "ord", "left").select(
        "ord", "rule_id", "language", "severity", F.coalesce("hits", F.lit(0)).alias("hits"))


_DIM = ", ".join(f"({r.ord}, {q(r.rule_id)}, {q(r.language)}, {q(r.severity)})" for r in line_rules())
RULE_CATALOGUE = f"""WITH {RULE_LINES.replace('lines AS', 'code AS', 1).replace('FROM lines', 'FROM code').replace('clean AS', 'plain AS')},
{lines_sql(DOC_FILES + ' UNION ALL ' + WEB_FILES)}, bare AS ({block_sql('lines')}),
clean AS (SELECT file, language, line_no, line FROM plain UNION ALL
          SELECT file, language, line_no, line FROM lines SEMI JOIN bare USING (file, line_no) WHERE NOT {comment_sql()} AND NOT {nosec_sql()}
          UNION ALL SELECT file, language, line_no, line FROM ({MORE}) WHERE NOT {comment_sql()} AND NOT {nosec_sql()}),
found AS ({more_sql('clean')}),
hits AS (SELECT ord, count(*) AS hits FROM found GROUP BY ord)
SELECT d.ord, d.rule_id, d.language, d.severity, coalesce(h.hits, 0) AS hits
FROM (VALUES {_DIM}) d(ord, rule_id, language, severity) LEFT JOIN hits h ON d.ord = h.ord"""


def custom_rules(spark, sf):
    from codescan.sources.rule_files import load_rules

    extra, _, problems = load_rules(CUSTOM_PACK)
    assert len(problems) == 2
    lines = ln.explode_lines(documents(spark, sf))
    return match.match_rules(lines, extra).select("file", "line", "rule_id", "severity", "message", "cwe")


CUSTOM_PACK = r"""
rules:
  - id: CUSTOM1
    language: python
    severity: low
    pattern: '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b'
    message: "IP address in text"
    cwe: CWE-200
  - id: CUSTOM2
    language: java
    pattern: 'licen[cs]e'
  - id: BROKEN
    language: java
    pattern: '([a-z'
  - language: java
    pattern: 'x'
"""
CUSTOM_RULES = f"""WITH {lines_sql(DOC_FILES)}
SELECT file, line_no AS line, 'CUSTOM1' AS rule_id, 'LOW' AS severity, 'IP address in text' AS message, 'CWE-200' AS cwe
FROM lines WHERE language = 'python'
  AND regexp_matches(line, '\\b[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\b')
  AND NOT (regexp_matches(regexp_replace(regexp_extract(line,
      '(?s)^(.*?)(?:\\b[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\b)', 1), {QUOTED_RE2}, '', 'g'), '["''#]'))
UNION ALL
SELECT file, line_no, 'CUSTOM2', 'MEDIUM', 'Custom rule', '' FROM lines
WHERE language = 'java' AND regexp_matches(line, '(?i)licen[cs]e')"""


# --- secrets --------------------------------------------------------------------
def entropy_secrets(spark, sf):
    return slim(secrets.scan_entropy(ln.explode_lines(documents(spark, sf))))


def code_secrets(spark, sf):
    return slim(secrets.scan_entropy(code_lines(spark, sf)))


def assert_scan(spark, sf):
    return secrets.scan_assert(code_lines(spark, sf)).select("file", "line", "rule_id", "code_snippet")


ASSERT_SCAN = f"""SELECT file, line_no AS line, 'SEC003' AS rule_id, line AS code_snippet FROM ({CODE_LINES})
WHERE language = 'python' AND starts_with(line, 'assert ')"""


def dedupe_findings(spark, sf):
    lines = code_lines(spark, sf)
    return slim(fd.dedupe_findings(fd.union_engines(
        match.match_rules(rule_lines(lines)), secrets.scan_entropy(lines), secrets.scan_assert(lines))))


DEDUPE = f"""WITH {RULE_LINES}, found AS ({rules_sql('clean')} UNION ALL {entropy_sql('lines')} UNION ALL
SELECT file, line_no, 'SEC003', 'LOW', language, {q(secrets.ASSERT_MESSAGE)}, line,
       'LOW', 'CWE-617', 'A05:2021', 4, 0 FROM lines WHERE language = 'python' AND starts_with(line, 'assert '))
SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY file, line, rule_id ORDER BY engine_ord, ord, message) AS rn FROM found)
WHERE rn = 1"""

def scan_totals(spark, sf):
    """The flagship: all line rules, secret literals and asserts over code lines and documents, per rule."""
    lines = code_lines(spark, sf)
    # What is counted and what orders the findings of a key; snippets and tags would only be shuffled.
    counted = ["file", "line", "rule_id", "severity", "language", "message", "engine_ord", "ord"]
    code = fd.dedupe_findings(fd.union_engines(
        match.match_rules(rule_lines(lines)), secrets.scan_entropy(lines), secrets.scan_assert(lines)).select(counted))
    texts = fd.dedupe_findings(secrets.scan_text(documents(spark, sf)).select(counted))
    return (
        code.unionByName(texts).groupBy("language", "rule_id", "severity")
        .agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))
    )


DOC_SCAN = f"""WITH {lines_sql(DOC_FILES)},
clean AS (SELECT * FROM lines WHERE NOT {comment_sql()} AND NOT {nosec_sql()}),
found AS ({rules_sql('clean')} UNION ALL {entropy_sql('lines')} UNION ALL
SELECT file, line_no, 'SEC003', 'LOW', language, '', '', '', '', '', 4, 0 FROM lines
WHERE language = 'python' AND regexp_matches(line, '^\\s*assert\\b'))
SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY file, line, rule_id ORDER BY engine_ord, ord, message) AS rn FROM found)
WHERE rn = 1"""
SCAN_TOTALS = f"""SELECT language, rule_id, severity, count(*) AS findings, count(DISTINCT file) AS files
FROM (({DEDUPE}) UNION ALL ({DOC_SCAN})) GROUP BY ALL"""

URLS_SQL = """
SELECT page_id, CASE page_id % 6
  WHEN 0 THEN concat('https://github.com/o', CAST(page_id AS STRING), '/r.git') WHEN 1 THEN concat(' https://GitLab.com/a/b/tree/', CAST(page_id AS STRING))
  WHEN 2 THEN url WHEN 3 THEN concat('http://github.com/a/', CAST(page_id AS STRING)) WHEN 4 THEN 'https://codeberg.org/only'
  ELSE concat('https://bitbucket.org/x/y', CAST(page_id AS STRING), '/') END AS url FROM {pages}
"""


def repo_urls(spark, sf):
    rows = derive(spark, sf, URLS_SQL, "pages")
    return rows.withColumn("r", corpus.validate_repo_url(F.col("url"))).select(
        "page_id", F.col("r.clean_url").alias("clean_url"), F.col("r.name").alias("name"))


REPO_URLS = f"""
SELECT page_id, CASE WHEN ok THEN 'https://' || host || '/' || owner || '/' || repo || '.git' END AS clean_url,
       CASE WHEN ok THEN owner || '/' || repo END AS name
FROM (SELECT page_id, host, owner, regexp_replace(repo, '[.]git$', '') AS repo,
             host IN ('github.com', 'gitlab.com', 'bitbucket.org', 'codeberg.org') AND owner <> '' AND repo <> '' AS ok
      FROM (SELECT page_id, lower(regexp_extract(trim(url), '^https://([^/?#]+)', 1)) AS host,
                   regexp_extract(trim(url), '^https://[^/?#]+/([^/?#]+)', 1) AS owner,
                   regexp_extract(trim(url), '^https://[^/?#]+/[^/?#]+/([^/?#]+)', 1) AS repo
            FROM ({duck(URLS_SQL, 'pages')})))"""

QUERIES = {
    "scan_totals": (scan_totals, SCAN_TOTALS),
    "secret_scan": (secret_scan, f"WITH {SECRET_CTE} SELECT language, rule_id, severity, count(*) AS findings, "
                                 "count(DISTINCT file) AS files FROM secret_found GROUP BY ALL"),
    "language_detect": (language_detect, LANGUAGE_DETECT),
    "exclude_dirs": (exclude_dirs, EXCLUDE_DIRS),
    "third_party_filter": (third_party_filter, THIRD_PARTY),
    "changed_files": (changed_files, CHANGED_FILES),
    "explode_lines": (line_counts, LINE_COUNTS),
    "comment_filter": (comment_filter, f"SELECT file, line_no, line FROM ({CODE_LINES}) WHERE NOT {comment_sql()}"),
    "nosec_filter": (nosec_filter, f"SELECT file, line_no, line FROM ({CODE_LINES}) WHERE NOT {nosec_sql()}"),
    "block_comment_state": (block_comment_state, BLOCK_STATE),
    "block_comment_blank": (block_comment_blank, BLOCK_BLANK),
    "logical_lines": (logical_lines, LOGICAL_LINES),
    "regex_rule_match": (regex_rule_match, REGEX_MATCH),
    "document_rule_match": (document_rule_match, DOCUMENT_MATCH),
    "web_rule_match": (web_rule_match, WEB_MATCH),
    "other_language_rules": (other_language_rules, OTHER_LANGUAGES),
    "rule_meta_join": (rule_meta_join, META_JOIN),
    "rule_catalogue": (rule_catalogue, RULE_CATALOGUE),
    "custom_rules": (custom_rules, CUSTOM_RULES),
    "entropy_secrets": (entropy_secrets, f"WITH {lines_sql(DOC_FILES)}, found AS ({entropy_sql('lines')}) SELECT {COLS} FROM found"),
    "code_secrets": (code_secrets, f"WITH lines AS ({CODE_LINES}), found AS ({entropy_sql('lines')}) SELECT {COLS} FROM found"),
    "assert_scan": (assert_scan, ASSERT_SCAN),
    "dedupe_findings": (dedupe_findings, DEDUPE),
    "repo_url_validate": (repo_urls, REPO_URLS),
}
