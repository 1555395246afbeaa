"""Queries: findings, reports, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from codescan.functions import text as tx
from codescan.operators import evaluate as ev
from codescan.operators import findings as fd
from codescan.operators import report as rp
from codescan.plans import tables as tb
from codescan.plans.q_lines import SECRET_CTE, documents, q, secret_findings
from codescan.plans.tables import derive, duck
from codescan.rules.metadata import HELP_BY_CWE

FOUND = duck(tb.FINDINGS_SQL, "lineitem")
PRINT = "rule_id || ':' || file || ':' || substr(code_snippet, 1, 80)"
SEV = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 9 END"


def found(spark, sf):
    return derive(spark, sf, tb.FINDINGS_SQL, "lineitem")


def dedupe_reports(spark, sf):
    return fd.dedupe_findings(found(spark, sf)).select("file", "line", "rule_id", "engine_ord", "ord", "message")


DEDUPE = f"""SELECT file, line, rule_id, engine_ord, ord, message FROM (SELECT *, row_number() OVER (
  PARTITION BY file, line, rule_id ORDER BY engine_ord, ord, message) AS rn FROM ({FOUND})) WHERE rn = 1"""

TOTALS = ("count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, "
          "count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low")


def severity_totals(spark, sf):
    f = found(spark, sf)
    return rp.severity_totals(f).withColumn("language", F.lit("all")).unionByName(rp.severity_totals(f, "language"))


# Baseline: fingerprints of the MEDIUM findings; a HIGH one may share its fingerprint.
BASE = f"SELECT DISTINCT {PRINT} AS fingerprint FROM ({FOUND}) WHERE severity = 'MEDIUM'"


def baseline(spark, sf):
    return fd.fingerprints(found(spark, sf).where("severity = 'MEDIUM'"))


def baseline_suppress(spark, sf):
    out = fd.suppress_baseline(found(spark, sf), baseline(spark, sf))
    return out.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def suppressed_count(spark, sf):
    return fd.count_suppressed(found(spark, sf), baseline(spark, sf))


def finding_search(spark, sf):
    rows = fd.search_findings(found(spark, sf), severity="high", language="python", q="MESSAGE 7")
    return fd.order_findings(rows).select("file", "line", "rule_id", "severity", "message")


def order_findings(spark, sf):
    """The third page of the findings in display order."""
    order = [tx.severity_rank(F.col("severity")), "file", "line", "rule_id", "ord", "code_snippet"]
    return rp.page(found(spark, sf), order, number=3, limit=100).select(
        "severity", "file", "line", "rule_id", "ord", "code_snippet")


def triage_queue(spark, sf):
    out = fd.triage_queue(found(spark, sf))
    return out.select("file", "line", "rule_id", F.length("prompt").alias("n_chars"),
                      F.regexp_extract("prompt", "(?m)^Message: (.*)$", 1).alias("message"))


_FIXED = len(fd.TRIAGE_PROMPT.replace("%s", "").replace("%d", ""))
TRIAGE = f"""
SELECT file, line, rule_id, {_FIXED} + length(rule_id || m.s || m.c || m.o || file || line || m.a || m.b) AS n_chars, m.a AS message
FROM (SELECT file, line, rule_id, min({{'a': message, 'b': code_snippet, 's': severity, 'c': cwe, 'o': owasp}}) AS m
      FROM ({FOUND}) WHERE severity = 'HIGH' GROUP BY file, line, rule_id)"""


def apply_triage(spark, sf):
    """The answer of each distinct HIGH finding, written back to all rows with its key."""
    rows = found(spark, sf)
    answers = fd.triage_queue(rows).select("file", "line", "rule_id", F.concat(F.lit("seen "), "rule_id").alias("answer"))
    return fd.apply_triage(rows, answers).groupBy("severity", "ai_explanation").agg(F.count("*").alias("n"))


APPLY = f"""
SELECT severity, CASE WHEN h.rule_id IS NULL THEN '' ELSE 'seen ' || f.rule_id END AS ai_explanation, count(*) AS n
FROM ({FOUND}) f LEFT JOIN (SELECT DISTINCT file, line, rule_id FROM ({FOUND}) WHERE severity = 'HIGH') h
  ON f.file = h.file AND f.line = h.line AND f.rule_id = h.rule_id GROUP BY ALL"""


def conditional_suppress(spark, sf):
    out = fd.drop_unconfirmed(found(spark, sf))
    return out.groupBy("rule_id", "language").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


COND = f"""WITH f AS ({FOUND})
SELECT rule_id, language, count(*) AS n, count(DISTINCT file) AS files FROM f
WHERE NOT (rule_id = 'SEC011' AND language = 'php' AND file NOT IN (SELECT file FROM f WHERE language = 'php' AND rule_id LIKE '%TS'))
GROUP BY ALL"""


def sarif_rules(spark, sf):
    return rp.sarif_rules(found(spark, sf)).select("rule_id", "text", "cwe", "owasp", "help_uri")


SARIF_RULES = f"""
SELECT rule_id, arg_min(message, {{'a': file, 'b': line, 'c': message}}) AS text, min(cwe) AS cwe, min(owasp) AS owasp,
       CASE WHEN min(cwe) = '' THEN '' ELSE 'https://cwe.mitre.org/data/definitions/' || replace(min(cwe), 'CWE-', '') || '.html' END AS help_uri
FROM ({FOUND}) GROUP BY rule_id"""


def sarif_results(spark, sf):
    doc = rp.sarif_results(found(spark, sf))
    get = lambda path, name: F.get_json_object("json", path).alias(name)
    loc = "$.locations[0].physicalLocation"
    return doc.select(
        get("$.ruleId", "rule"), get("$.level", "level"), get("$.message.text", "text"),
        get(f"{loc}.artifactLocation.uri", "uri"), get(f"{loc}.region.startLine", "start"),
        get("$.properties.confidence", "confidence")
    ).groupBy("rule", "level", "uri", "start").agg(F.count("*").alias("n"), F.max("text").alias("text"))


SARIF_RESULTS = f"""
SELECT rule_id AS rule, CASE severity WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level,
       file AS uri, CAST(line AS VARCHAR) AS start, count(*) AS n, max(message) AS text FROM ({FOUND}) GROUP BY ALL"""


def sarif_document(spark, sf):
    """The elements of the log, read back from its text: one row per section, rule, level and file."""
    doc = rp.sarif_document(found(spark, sf)).where("section in (1, 3)")
    kind = ("array<struct<id:string,ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:"
            "struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>,properties:struct<confidence:string>>>")
    led = F.startswith("value", F.lit(",")).cast("int")
    each = doc.select("section", led.alias("led"), F.explode(F.from_json(
        F.concat(F.lit("["), F.ltrim("value", F.lit(",")), F.lit("]")), kind)).alias("e"))
    place = F.get(F.col("e.locations"), F.lit(0))["physicalLocation"]
    return each.groupBy("section", F.coalesce("e.id", "e.ruleId").alias("rule_id"), F.col("e.level").alias("level"),
                        place["artifactLocation"]["uri"].alias("file")).agg(
        F.count("*").alias("n"), F.sum(place["region"]["startLine"]).alias("lines"),
        F.sum(F.length("e.message.text")).alias("chars"), F.sum(F.length("e.properties.confidence")).alias("confidence"))


SARIF_DOC = f"""SELECT 1 AS section, rule_id, NULL AS level, NULL AS file, 1 AS n, NULL AS lines, NULL AS chars, NULL AS confidence
FROM ({FOUND}) GROUP BY rule_id
UNION ALL SELECT 3, rule_id, CASE severity WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END, file, count(*),
  sum(line), sum(length(message)), sum(length(confidence)) FROM ({FOUND}) GROUP BY ALL"""


def rule_drilldown(spark, sf):
    out = rp.rule_drilldown(found(spark, sf), "SEC004")
    return out.groupBy("title", "fix", "severity").agg(F.count("*").alias("n"), F.min("file").alias("first_file"))


DRILL = f"""SELECT {q(HELP_BY_CWE['CWE-89'][0])} AS title, {q(HELP_BY_CWE['CWE-89'][1])} AS fix, severity, count(*) AS n,
  min(file) AS first_file FROM ({FOUND}) WHERE rule_id = 'SEC004' GROUP BY severity"""

# --- report listings ------------------------------------------------------------
# An order is a report; the first order of a customer is the root, later ones are rescans.
REPORTS_SQL = """
SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS uploaded_at, CAST(floor(o_totalprice) AS BIGINT) AS high,
       CASE WHEN o_orderkey = first_key THEN NULL ELSE first_key END AS parent_id
FROM {orders} JOIN (SELECT o_custkey AS ck, min(o_orderkey) AS first_key FROM {orders} GROUP BY o_custkey) ON o_custkey = ck
"""
REPORTS = duck(REPORTS_SQL, "orders")


def reports(spark, sf):
    return derive(spark, sf, REPORTS_SQL, "orders")


def lineage(spark, sf):
    return rp.lineage_delta(reports(spark, sf)).select("root", "id", "high", "delta", "trend")


LINEAGE = f"""
SELECT root, id, high, coalesce(high - prev, 0) AS delta,
  CASE WHEN prev IS NULL THEN 'first' WHEN high > prev THEN 'worse' WHEN high < prev THEN 'better' ELSE 'same' END AS trend
FROM (SELECT *, lag(high) OVER (PARTITION BY root ORDER BY CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END, uploaded_at, id) AS prev
      FROM (SELECT *, coalesce(parent_id, id) AS root FROM ({REPORTS})))"""


def recent_reports(spark, sf):
    return rp.recent_reports(reports(spark, sf)).select("id", "high", F.date_format("uploaded_at", "yyyy-MM-dd").alias("day"))


def report_ages(spark, sf):
    rows = rp.with_age(reports(spark, sf), "uploaded_at", "2003-01-01 00:00:30")
    return rows.groupBy("age").agg(F.count("*").alias("n"))


def ingest_report(spark, sf):
    """Report JSON rows, as the scanner writes them, back to report and finding rows."""
    from codescan.sources.reports import ingest_reports

    raw = derive(spark, sf, REPORT_JSON_SQL, "lineitem")
    heads, rows = ingest_reports(raw)
    return heads.groupBy("by_language").agg(
        F.count("*").alias("reports"), F.sum("total").alias("total"), F.sum("high").alias("high"),
        F.sum("critical").alias("critical"), F.sum("low").alias("low"),
    ).unionByName(rows.groupBy(F.concat(F.lit("rows "), "confidence", F.lit(" "), "severity").alias("by_language")).agg(
        F.count("*").alias("reports"), F.sum("line").alias("total"), F.lit(0).cast("long").alias("high"),
        F.lit(0).cast("long").alias("critical"), F.lit(0).cast("long").alias("low")))


REPORT_JSON_SQL = """
SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id, 'r' AS name, 'upload' AS source,
       TIMESTAMP '2024-01-01 00:00:00' AS uploaded_at, CAST(NULL AS BIGINT) AS parent_id,
       concat('[[', CASE WHEN l_linenumber = 1 THEN '"by_language": [["go": 5]], ' ELSE '' END, '"findings": [',
              CASE WHEN l_linenumber > 2 THEN concat('[["file": "a", "line": ', CAST(l_linenumber AS STRING),
                   ', "severity": "high", "language": "python", "confidence": "HIGH"]]') ELSE '' END,
              CASE WHEN l_linenumber > 4 THEN ', [["file": "b", "severity": "Critical"]]' ELSE '' END, ']]]') AS json
FROM {lineitem}
""".replace("[[", "{{").replace("]]]", "]}}").replace("]]", "}}")

INGEST = """
WITH n AS (SELECT l_linenumber AS k, count(*) AS c FROM lineitem GROUP BY 1)
SELECT CASE WHEN k = 1 THEN '{"go":5}' WHEN k = 2 THEN '{}' WHEN k <= 4 THEN '{"python":1}' ELSE '{"python":1,"?":1}' END AS by_language,
       CAST(sum(c) AS BIGINT) AS reports, CAST(sum(c * (CASE WHEN k > 4 THEN 2 WHEN k > 2 THEN 1 ELSE 0 END)) AS BIGINT) AS total,
       CAST(sum(c * (CASE WHEN k > 2 THEN 1 ELSE 0 END)) AS BIGINT) AS high,
       CAST(sum(c * (CASE WHEN k > 4 THEN 1 ELSE 0 END)) AS BIGINT) AS critical, CAST(0 AS BIGINT) AS low
FROM n GROUP BY 1
UNION ALL SELECT 'rows HIGH HIGH', CAST(sum(c) AS BIGINT), CAST(sum(c * k) AS BIGINT), 0, 0, 0 FROM n WHERE k > 2
UNION ALL SELECT 'rows LOW CRITICAL', CAST(sum(c) AS BIGINT), 0, 0, 0, 0 FROM n WHERE k > 4"""

# --- evaluation -----------------------------------------------------------------
# A labelled document is a case; the secret scan is the tool.
CASES_SQL = """
SELECT CAST(doc_id AS STRING) AS id, concat('/tmp/corpus/', source, '/', CAST(doc_id AS STRING)) AS file,
       CASE lang WHEN 'en' THEN 'python' ELSE 'other' END AS language,
       CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS category, quality = 0 AS vulnerable
FROM {documents} JOIN {labels} USING (doc_id)
"""
CASES = duck(CASES_SQL, "documents", "labels")


def cases(spark, sf):
    return derive(spark, sf, CASES_SQL, "documents", "labels")


def tool_hits(spark, sf):
    """Findings of a tool that reports long documents, under another root."""
    return derive(spark, sf, "SELECT concat('/srv/corpus/', source, '/', CAST(doc_id AS STRING)) AS file, 1 AS line "
                             "FROM {documents} WHERE n_chars > 1500", "documents")


HITS = "SELECT source || '/' || doc_id AS tail, CAST(doc_id AS VARCHAR) AS name FROM documents WHERE n_chars > 1500"


def detected(spark, sf):
    return ev.detected_cases(cases(spark, sf), tool_hits(spark, sf))


DETECTED = f"""detected AS (SELECT *, (replace(file, '/tmp/corpus/', '') IN (SELECT tail FROM ({HITS}))
  OR id IN (SELECT name FROM ({HITS}))) AS found FROM ({CASES})),
judged AS (SELECT *, CASE WHEN vulnerable AND found THEN 'TP' WHEN vulnerable THEN 'FN' WHEN found THEN 'FP' ELSE 'TN' END AS result FROM detected)"""
COUNTS = ", ".join(f"count(*) FILTER (result = '{r}') AS {r}" for r in ("TP", "FP", "FN", "TN"))


def confusion(spark, sf):
    return ev.confusion(detected(spark, sf))


CONFUSION = f"""WITH {DETECTED}
SELECT 'all' AS scope, '' AS value, {COUNTS} FROM judged
UNION ALL SELECT 'category', category, {COUNTS} FROM judged GROUP BY category
UNION ALL SELECT 'language', language, {COUNTS} FROM judged GROUP BY language"""


def detection_metrics(spark, sf):
    return ev.metrics(confusion(spark, sf), digits=4).select("scope", "value", "precision", "recall", "f1", "fpr")


METRICS = f"""WITH c AS ({CONFUSION}),
r AS (SELECT *, CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0 END AS p, CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0 END AS rc FROM c)
SELECT scope, value, round(p, 4) AS precision, round(rc, 4) AS recall,
  round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 4) AS f1,
  round(CASE WHEN FP + TN > 0 THEN FP / (FP + TN) ELSE 0 END, 4) AS fpr FROM r"""


def secret_detection(spark, sf):
    """The secret scan scored against the labels, by exact path."""
    hits = secret_findings(spark, sf).withColumn("file", F.concat(F.lit("corpus/"), "file"))
    return ev.confusion(ev.detected_cases(cases(spark, sf), hits, exact_only=True))


SECRET_DETECTION = f"""WITH {SECRET_CTE},
judged AS (SELECT *, CASE WHEN vulnerable AND hit THEN 'TP' WHEN vulnerable THEN 'FN' WHEN hit THEN 'FP' ELSE 'TN' END AS result
  FROM (SELECT *, replace(file, '/tmp/corpus/', '') IN (SELECT file FROM secret_found) AS hit FROM ({CASES})))
SELECT 'all' AS scope, '' AS value, {COUNTS} FROM judged
UNION ALL SELECT 'category', category, {COUNTS} FROM judged GROUP BY category
UNION ALL SELECT 'language', language, {COUNTS} FROM judged GROUP BY language"""


def detail_rows(spark, sf):
    return ev.detail_rows(detected(spark, sf)).select("id", "result", "wrong")


def path_normalise(spark, sf):
    rows = derive(spark, sf, PATH_SQL, "pages")
    return rows.select("page_id", ev.normalise_path(F.col("path")).alias("path"))


PATH_SQL = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('/a/corpus/', CAST(page_id AS STRING), '/corpus/x.py')
  WHEN page_id % 3 = 1 THEN concat('a/b/', CAST(page_id AS STRING), '.py') ELSE url END AS path FROM {pages}"""
PATHS = f"""SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)corpus(/|$)') THEN regexp_extract(path, '^(?:.*?/)??(corpus(?:/.*)?)$', 1)
  ELSE regexp_extract(path, '([^/]*)$', 1) END AS path FROM ({duck(PATH_SQL, 'pages')})"""

TOOLS_SQL = """
SELECT CASE l_suppkey % 3 WHEN 0 THEN 'bandit' WHEN 1 THEN 'codescan' ELSE 'semgrep' END AS tool,
       concat('f', CAST(l_orderkey AS STRING)) AS file, CAST(l_linenumber AS INT) AS line,
       CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'Medium' ELSE CASE WHEN l_partkey % 9 = 0 THEN 'CRITICAL' ELSE 'LOW' END END AS severity
FROM {lineitem}
"""
TOOLS = duck(TOOLS_SQL, "lineitem")


def tools(spark, sf):
    return derive(spark, sf, TOOLS_SQL, "lineitem")


def tool_compare(spark, sf):
    """Scores of two tools side by side; a third was not run."""
    a = ev.confusion(detected(spark, sf)).where("scope = 'all'").withColumn("tool", F.lit("a"))
    b = ev.confusion(ev.detected_cases(cases(spark, sf), documents(spark, sf))).where("scope = 'all'").withColumn("tool", F.lit("b"))
    return ev.tool_compare(ev.metrics(a.unionByName(b), digits=4), ["a", "b", "c"])


COMPARE = f"""WITH {DETECTED}, c AS (SELECT 'a' AS tool, {COUNTS} FROM judged UNION ALL
  SELECT 'b', count(*) FILTER (vulnerable), count(*) FILTER (NOT vulnerable), 0, 0 FROM ({CASES})),
r AS (SELECT *, CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0 END AS p, CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0 END AS rc FROM c),
m AS (SELECT tool, unnest(['precision', 'recall', 'f1', 'fpr']) AS measure, unnest([p, rc, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END,
  CASE WHEN FP + TN > 0 THEN FP / (FP + TN) ELSE 0 END]) AS v FROM r)
SELECT measure, round(max(v) FILTER (tool = 'a'), 4) AS a, round(max(v) FILTER (tool = 'b'), 4) AS b, CAST(NULL AS DOUBLE) AS c
FROM m GROUP BY measure"""


def files_with_findings(spark, sf):
    return rp.files_with_findings(found(spark, sf))


def report_header(spark, sf):
    from codescan.sources.reports import report_header as header

    row = header(found(spark, sf), fd.count_suppressed(found(spark, sf), baseline(spark, sf)))
    return row.select("total", "critical", "high", "medium", "low", "suppressed", F.to_json("by_language").alias("by_language"))


HEADER = f"""SELECT {TOTALS}, (SELECT count(*) FROM ({FOUND}) WHERE {PRINT} IN ({BASE})) AS suppressed,
  (SELECT '{{' || string_agg('"' || language || '":' || n, ',' ORDER BY language) || '}}' FROM (
    SELECT language, count(*) AS n FROM ({FOUND}) GROUP BY language)) AS by_language FROM ({FOUND})"""


QUERIES = {
    "dedupe_reports": (dedupe_reports, DEDUPE),
    "severity_totals": (severity_totals, f"SELECT 'all' AS language, {TOTALS} FROM ({FOUND}) UNION ALL "
                                         f"SELECT language, {TOTALS} FROM ({FOUND}) GROUP BY language"),
    "by_language": (lambda s, d: rp.by_language(found(s, d)), f"SELECT language, count(*) AS n FROM ({FOUND}) GROUP BY language"),
    "summary_rows": (lambda s, d: rp.summary_rows(found(s, d)),
                     f"SELECT severity, language, count(*) AS n, count(DISTINCT rule_id) AS rules FROM ({FOUND}) GROUP BY ALL"),
    "severity_share": (lambda s, d: rp.severity_share(found(s, d)),
                       "SELECT count(*) AS total, " + ", ".join(
                           f"round(count(*) FILTER (severity = '{x.upper()}') / count(*), 6) AS {x}_share"
                           for x in ("high", "medium", "low")) + f" FROM ({FOUND})"),
    "top_rules": (lambda s, d: rp.top_rules(found(s, d), 4),
                  f"SELECT rule_id, count(*) AS n FROM ({FOUND}) GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 4"),
    "top_files": (lambda s, d: rp.top_files(found(s, d)),
                  f"SELECT file, count(*) AS n FROM ({FOUND}) GROUP BY 1 ORDER BY n DESC, file LIMIT 10"),
    "finding_lines": (lambda s, d: rp.finding_lines(found(s, d)), f"SELECT DISTINCT file, line FROM ({FOUND})"),
    "rule_head": (lambda s, d: rp.rule_head(found(s, d), "SEC004"), f"""
SELECT 'SEC004' AS rule_id, arg_min(severity, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END) AS severity,
  count(*) AS findings, count(DISTINCT file) AS files, {q(HELP_BY_CWE['CWE-89'][0])} AS title, {q(HELP_BY_CWE['CWE-89'][1])} AS fix
FROM ({FOUND}) WHERE rule_id = 'SEC004' HAVING count(*) > 0"""),
    "files_with_findings": (files_with_findings,
                            f"SELECT file, count(DISTINCT line) AS n_lines FROM ({FOUND}) GROUP BY file"),
    "baseline_write": (lambda s, d: fd.fingerprints(found(s, d)), f"SELECT DISTINCT {PRINT} AS fingerprint FROM ({FOUND})"),
    "baseline_suppress": (baseline_suppress, "SELECT rule_id, severity, count(*) AS n, count(DISTINCT file) AS files FROM "
                                             f"({FOUND}) WHERE {PRINT} NOT IN ({BASE}) GROUP BY ALL"),
    "suppressed_count": (suppressed_count, f"SELECT count(*) AS suppressed FROM ({FOUND}) WHERE {PRINT} IN ({BASE})"),
    "min_confidence": (lambda s, d: fd.min_confidence(found(s, d), "MEDIUM").groupBy("confidence").agg(F.count("*").alias("n")),
                       f"SELECT confidence, count(*) AS n FROM ({FOUND}) WHERE confidence IN ('MEDIUM', 'HIGH') GROUP BY 1"),
    "finding_search": (finding_search, f"SELECT file, line, rule_id, severity, message FROM ({FOUND}) WHERE severity = 'HIGH' "
                                       "AND language = 'python' AND contains(lower(message), 'message 7')"),
    "order_findings": (order_findings, "SELECT severity, file, line, rule_id, ord, code_snippet FROM "
                                       f"({FOUND}) ORDER BY {SEV}, file, line, rule_id, ord, code_snippet LIMIT 100 OFFSET 200"),
    "filter_options": (lambda s, d: fd.filter_options(found(s, d)),
                       f"SELECT 'language' AS kind, language AS value FROM ({FOUND}) UNION SELECT 'rule_id', rule_id FROM ({FOUND})"),
    "triage_queue": (triage_queue, TRIAGE),
    "apply_triage": (apply_triage, APPLY),
    "conditional_suppress": (conditional_suppress, COND),
    "sarif_rules": (sarif_rules, SARIF_RULES),
    "sarif_results": (sarif_results, SARIF_RESULTS),
    "sarif_document": (sarif_document, SARIF_DOC),
    "rule_drilldown": (rule_drilldown, DRILL),
    "report_header": (report_header, HEADER),
    "ingest_report": (ingest_report, INGEST),
    "report_lineage_delta": (lineage, LINEAGE),
    "recent_reports": (recent_reports, f"SELECT id, high, strftime(uploaded_at, '%Y-%m-%d') AS day FROM ({REPORTS}) "
                                       "ORDER BY uploaded_at DESC, id DESC LIMIT 10"),
    "report_ages": (report_ages, "SELECT CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' "
                                 "WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age, count(*) AS n "
                                 "FROM (SELECT date_diff('second', uploaded_at, TIMESTAMP '2003-01-01 00:00:30') AS s "
                                 f"FROM ({REPORTS})) GROUP BY 1"),
    "confusion_grouping_sets": (confusion, CONFUSION),
    "detection_metrics": (detection_metrics, METRICS),
    "secret_detection": (secret_detection, SECRET_DETECTION),
    "detail_rows": (detail_rows, f"WITH {DETECTED} SELECT id, result, result IN ('FN', 'FP') AS wrong FROM judged"),
    "corpus_profile": (lambda s, d: ev.corpus_profile(cases(s, d)),
                       "SELECT count(*) AS cases, count(*) FILTER (vulnerable) AS vulnerable, count(*) FILTER (NOT vulnerable) AS safe, "
                       f"count(DISTINCT language) AS languages, count(DISTINCT category) AS categories FROM ({CASES})"),
    "path_normalise": (path_normalise, PATHS),
    "tool_pivot": (lambda s, d: ev.tool_severity(tools(s, d)),
                   "SELECT tool, " + ", ".join(f"count(*) FILTER (upper(severity) = '{x}') AS {x.lower()}"
                                               for x in ("HIGH", "MEDIUM", "LOW")) + f" FROM ({TOOLS}) GROUP BY tool"),
    "tool_compare": (tool_compare, COMPARE),
    "scan_gate": (lambda s, d: ev.scan_gate(found(s, d)),
                  f"SELECT count(*) AS blocking, count(*) > 0 AS failed FROM ({FOUND}) WHERE severity IN ('CRITICAL', 'HIGH')"),
    "gate": (lambda s, d: ev.gate(tools(s, d), block_critical=True),
             "SELECT high, critical, dependencies, high > 0 OR dependencies > 0 OR critical > 0 AS failed FROM (SELECT "
             "count(*) FILTER (tool IN ('bandit', 'codescan') AND upper(severity) = 'HIGH') AS high, "
             "count(*) FILTER (tool IN ('bandit', 'codescan') AND upper(severity) = 'CRITICAL') AS critical, "
             f"count(*) FILTER (tool = 'safety') AS dependencies FROM ({TOOLS}))"),
}

