"""Queries: window taint, fixed point, scope taint, call shapes, function summaries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from codescan.operators import structural as st
from codescan.operators import taint as tn
from codescan.operators import taint_window as tw
from codescan.operators.match import scan_multiline
from codescan.plans import tables as tb
from codescan.plans.q_lines import (
    BLANKS, CODE_LINES, code_lines, comment_sql, entropy_sql, logical_sql, nosec_sql, q, rules_sql,
)
from codescan.plans.scan import scan_files
from codescan.plans.tables import derive, duck
from codescan.rules.regex_packs import multiline_rules
from codescan.rules.structural_packs import JAVASCRIPT as JAVASCRIPT_SHAPES
from codescan.rules.structural_packs import PYTHON as PYTHON_SHAPES
from codescan.rules.structural_packs import structural_rules
from codescan.rules.taint_tables import FLOW_SINKS, WINDOW_SINKS, WINDOW_SOURCES
from codescan.session import cut_lineage
from codescan.sources.rule_files import load_rules

# --- window taint on code lines -------------------------------------------------
WINDOW = 2 * tb.LINE_STEP
ALL = ("python", "javascript", "php", "java", "go")


def taint_window_join(spark, sf):
    out = tw.taint_window(code_lines(spark, sf), WINDOW, ALL)
    return out.select("file", "line", "rule_id", "severity", "message")


def _cases(table: dict[str, str]) -> str:
    return "CASE language " + " ".join(
        f"WHEN {q(k)} THEN regexp_matches(line, {q('(?i)' + p)})" for k, p in table.items()) + " ELSE false END"


_N = r"([A-Za-z_]\w*)"
_S = f"trim(line, {BLANKS})"
_LHS = f"""coalesce(
  CASE WHEN language = 'php' THEN nullif(regexp_extract({_S}, '^\\${_N}\\s*[.+]?=(?:[^=]|$)', 1), '') END,
  CASE WHEN language = 'java' THEN nullif(regexp_extract({_S}, '^(?:\\w+(?:\\s*<[^>]*>)?\\s+)+{_N}\\s*=(?:[^=]|$)', 1), '') END,
  nullif(regexp_extract({_S}, '^{_N}\\s*:=', 1), ''),
  nullif(regexp_extract({_S}, '^(?:const|let|var|final)\\s+{_N}\\s*=(?:[^=]|$)', 1), ''),
  nullif(regexp_extract({_S}, '^{_N}\\s*=(?:[^=>]|$)', 1), ''))"""


def _round(i: int) -> str:
    return f"""t{i + 1} AS (SELECT * FROM t{i} UNION ALL
  SELECT DISTINCT s.file, s.lhs, s.line_no FROM steps s WHERE (s.file, s.name) IN (SELECT file, name FROM t{i})
    AND (s.file, s.lhs) NOT IN (SELECT file, name FROM t{i}))"""


def window_sql(source: str, window: int, languages) -> str:
    """CTEs up to ``hits`` (file, language, line_no, rule_id, severity, msg, src_line) on rows of ``source``."""
    sinks = " UNION ALL ".join(
        f"SELECT file, language, line_no, names, {q(rule)} AS rule_id, {q(sev)} AS severity, {q(msg)} AS msg FROM facts "
        f"WHERE language = {q(lang)} AND regexp_matches(line, {q('(?i)' + p)})"
        for lang, rule, sev, p, msg in WINDOW_SINKS if lang in languages)
    return f"""
facts AS MATERIALIZED (SELECT *, {_LHS} AS lhs, list_distinct(regexp_extract_all(line, '[A-Za-z_]\\w*')) AS names, {_cases(WINDOW_SOURCES)} AS src
  FROM {source} WHERE language IN ({', '.join(q(x) for x in languages)})),
t0 AS (SELECT DISTINCT file, lhs AS name, line_no FROM facts WHERE src AND lhs IS NOT NULL),
steps AS MATERIALIZED (SELECT file, lhs, line_no, unnest(names) AS name FROM facts WHERE lhs IS NOT NULL AND regexp_matches(line, '[.+&]|concat|\\|\\|')),
{_round(0)}, {_round(1)}, {_round(2)},
sinks AS (SELECT * EXCLUDE names, unnest(names) AS name FROM ({sinks})),
hits AS (SELECT s.file, s.language, s.line_no, s.rule_id, s.severity, s.msg, max(t.line_no) AS src_line FROM sinks s JOIN t3 t
  ON s.file = t.file AND s.name = t.name AND t.line_no < s.line_no AND s.line_no - t.line_no <= {window} GROUP BY ALL)"""


WINDOW_SQL = f"""WITH {window_sql(f'({CODE_LINES})', WINDOW, ALL)}
SELECT file, line_no AS line, rule_id, severity, msg || ' - tainted by user input on line ' || src_line AS message FROM hits"""

# --- reachability on a large graph ----------------------------------------------
EDGE_SQL = """
SELECT concat('s', CAST(l_suppkey AS STRING)) AS file, 'f' AS scope, concat('n', CAST(l_partkey % 997 AS STRING)) AS name,
       'f' AS to_scope, concat('n', CAST((l_partkey * 7 + l_linenumber) % 997 AS STRING)) AS to_name,
       l_linenumber = 1 AND l_returnflag = 'R' AS seed
FROM {lineitem}
"""


def taint_fixed_point(spark, sf):
    """Nodes reached: in a graph for each supplier, and along a chain of a thousand steps for each brand of line."""
    rows = cut_lineage(derive(spark, sf, EDGE_SQL, "lineitem").unionByName(derive(spark, sf, CHAIN_SQL, "lineitem")))
    seeds = rows.where("seed").select("file", "scope", "name", F.lit("web").alias("label"))
    return tn.propagate(seeds, rows.drop("seed")).select("file", "name")


# Lines of an order chain a thousand numbers; a chain is whole if the table holds all of its steps.
CHAIN_SQL = """
SELECT concat('k', CAST(l_linenumber AS STRING)) AS file, 'f' AS scope, concat('c', CAST(l_orderkey % 1000 AS STRING)) AS name,
       'f' AS to_scope, concat('c', CAST(l_orderkey % 1000 + 1 AS STRING)) AS to_name, l_orderkey % 1000 = 1 AS seed
FROM {lineitem}
"""


FIXED_POINT = f"""
WITH RECURSIVE a AS (SELECT * FROM ({duck(EDGE_SQL, 'lineitem')}) UNION ALL SELECT * FROM ({duck(CHAIN_SQL, 'lineitem')})),
e AS (SELECT DISTINCT file, name, to_name FROM a),
r AS (SELECT DISTINCT file, name FROM a WHERE seed
      UNION SELECT e.file, e.to_name FROM r JOIN e ON r.file = e.file AND r.name = e.name)
SELECT file, name FROM r"""

# --- part as code files ---------------------------------------------------------
# language, code (| ends a line, # is the part number, ^ the number before it), findings of the
# flow pass, findings of the call-shape pass.  Findings are "line:rule".
SAMPLES = [
    ("python", 'def show(db):|    term = request.args.get("q")|    db.execute("SELECT a FROM t WHERE b = " + term)', "3:SEC004T", ""),
    ("python", 'def show(db):|    raw = request.form["q"]|    term = raw.strip()|    sql = "SELECT a WHERE b = " + term|    db.execute(sql)',
     "5:SEC004T", ""),
    ("python", 'def show(db):|    raw = request.args.get("q")|    items = [raw, "x"]|    one = items[0]|    db.execute("SELECT a" + one)',
     "5:SEC004T", ""),
    ("python", 'def show(db):|    raw = request.args.get("q")|    num = int(raw)|    db.execute("SELECT a" + str(num))', "", ""),
    ("python", 'def show(db):|    name = request.args.get("q")|    sql = "SELECT a WHERE b = "|    sql += name|    db.execute(sql)',
     "5:SEC004T", ""),
    ("python", 'def show(db):|    name = request.args.get("q")|    parts = []|    parts.append(name)|    db.execute("SELECT" + parts[0])',
     "5:SEC004T", ""),
    ("python", 'def show(db):|    raw = request.args.get("q")|    val = raw if raw else "none"|    db.execute("SELECT" + val)', "4:SEC004T", ""),
    ("python", 'def show(box):|    box.value = request.args.get("q")|    os.system("ls " + box.value)', "3:SEC002T", "3:SEC002S 3:SEC_PI004"),
    ("python", 'class View:|    def load(self, req):|        self.term = req.args.get("q")||    def run(self, db):|        db.execute(self.term)',
     "6:SEC004T", ""),
    ("python", 'def show(db):|    conf = dict()|    conf["k"] = request.args.get("q")|    db.execute(conf["k"])', "4:SEC004T", ""),
    ("python", 'def show(db):|    name = request.args.get("q")|    db.execute(f"SELECT a WHERE b = <<name>>")', "3:SEC004T", ""),
    ("python", 'def helper#(text):|    db.execute("SELECT a WHERE b = " + text)||def view():|    value = request.args.get("v")|    helper#(value)',
     "6:SEC004T", ""),
    ("python", 'def store#(text, n):|    db.execute("SELECT a WHERE b = " + text)', "", ""),
    ("python", 'def view():|    value = request.args.get("v")|    store^(value, 1)', "3:SEC004T", ""),
    ("python", 'def fetch#():|    return request.args.get("v")||def use(db):|    v = fetch#()|    db.execute(v)', "6:SEC004T", ""),
    ("python", 'def get(name):|    name = request.args.get("f")|    path = os.path.realpath(os.path.join(BASE, name))|'
               '    if not path.startswith(BASE):|        return abort(403)|    return open(path)', "", ""),
    ("python", 'def load(data):|    try:|        x = pickle.loads(data)|    except Exception:|        x = None|    return x', "", "3:SEC069S"),
    ("python", 'def load(data):|    x = pickle.loads(data)|    return x', "", "2:SEC069S 2:SEC_PI001"),
    ("python", 'def fetch(url):|    r = requests.get(url, verify=False)|    return r.text', "", "2:SEC082S 2:SEC_PI008"),
    ("python", 'def parse(data):|    return yaml.load(data)', "", "2:SEC068S"),
    ("python", 'def parse(data):|    return yaml.load(data, Loader=yaml.SafeLoader)', "", ""),
    ("python", 'def run(cmd):|    subprocess.run(cmd, shell=True)', "", "2:SEC080S 2:SEC_PI014"),
    ("javascript", 'app.get("/u", (req, res) => <<|  const id = req.query.id;|  db.query("SELECT a WHERE b = " + id, done);|>>);', "3:SEC004T", ""),
    ("javascript", 'app.post("/u", (req, res) => <<|  const << name >> = req.body;|  db.query(`SELECT a WHERE b = @<<name>>`);|>>);', "3:SEC004T", ""),
    ("javascript", 'app.get("/u", (req, res) => <<|  const id = parseInt(req.query.id);|  db.query("SELECT a WHERE b = " + id);|>>);', "", ""),
    ("javascript", 'function show() <<|  const p = new URLSearchParams(location.search);|  el.innerHTML = p.get("q");|>>', "3:SEC006T", ""),
    ("javascript", 'app.get("/p", (req, res) => <<|  const host = req.query.host;|  exec(`ping @<<host>>`, (err, out) => <<|    res.send(out);|  >>);|>>);',
     "3:SEC003T", ""),
    ("javascript", 'app.get("/f", (req, res) => <<|  const f = req.params.f;|  fs.readFile("/base/" + f, done);|>>);', "3:SEC035T", "3:SEC_PT001"),
    ("javascript", 'app.get("/r", (req, res) => <<|  res.redirect(req.query.next);|>>);', "2:SEC056T", "2:SEC_EX006"),
    ("javascript", 'function find#(id) <<|  return db.query("SELECT a WHERE b = " + id);|>>|app.get("/u", (req, res) => <<|  const id = req.query.id;|  find#(id);|>>);',
     "6:SEC004T", ""),
    ("javascript", 'app.get("/u", (req, res) => <<|  const id = req.query.id;|  if (id) <<|    db.query("SELECT a WHERE b = " + id);|  >>|>>);', "4:SEC004T", ""),
    ("php", '@name = @_GET["n"];|@html = "<b>" . @name;|echo @html;', "3:SEC006TS", ""),
    ("php", '@name = htmlspecialchars(@_GET["n"]);|echo "<b>" . @name;|@n = (int) @_GET["k"];|system("ls " . @n);', "", ""),
    ("java", 'class A <<|  void f(String id) throws Exception <<|    String sql = "SELECT a WHERE b = " + id;|    stmt.executeQuery(sql);|  >>|>>', "4:SEC004TS", ""),
    ("java", 'class A <<|  void f(String id) throws Exception <<|    int n = Integer.parseInt(id);|    stmt.executeQuery("SELECT a" + n);|  >>|>>', "", ""),
    ("go", 'func show(w http.ResponseWriter, r *http.Request) <<|  id := r.FormValue("id")|  rows, err := db.Query("SELECT a WHERE b = " + id)|>>', "3:SEC004TS", ""),
    ("go", 'func show(w http.ResponseWriter, r *http.Request) <<|  n, err := strconv.Atoi(r.FormValue("id"))|  db.Query("SELECT a", n)|>>', "", ""),
    ("python", 'def find(db, user):|    sql = "SELECT a FROM t WHERE b = " + user|    db.execute(sql)', "3:SEC004T", ""),
    ("python", '&app.route("/x")|def page(name):|    return name', "", "3:SEC_PI012"),
    ("python", 'def hash_password(data):|    return hashlib.md5(data)', "", "2:SEC005S 2:SEC_PI015"),
    ("python", 'def pull#():|    return request.args.get("v")', "", ""),
    ("python", 'def use(db):|    v = pull^()|    db.execute(v)', "3:SEC004T", ""),
]
_MARKS = {"|": "chr(10)", "<<": "chr(123)", ">>": "chr(125)", "@": "chr(36)", "&": "chr(64)",
          "#": "CAST(p_partkey AS STRING)", "^": "CAST(p_partkey - 1 AS STRING)"}


def _sample_sql() -> str:
    text = "split_part('" + "~".join(s[1] for s in SAMPLES) + f"', '~', CAST(p_partkey % {len(SAMPLES)} + 1 AS INT))"
    for mark, value in _MARKS.items():
        text = f"replace({text}, '{mark}', {value})"
    lang = "split_part('" + "~".join(s[0] for s in SAMPLES) + f"', '~', CAST(p_partkey % {len(SAMPLES)} + 1 AS INT))"
    return f"SELECT concat('p', CAST(p_partkey AS STRING), '.src') AS file, {lang} AS language, {text} AS content FROM {{part}}"


CODE_FILES_SQL = _sample_sql()


def code_files(spark, sf):
    return derive(spark, sf, CODE_FILES_SQL, "part")


def expected_sql(column: int) -> str:
    """Findings the samples are known to have, for every part."""
    rows = ", ".join(f"({i}, {f.split(':')[0]}, {q(f.split(':')[1])})" for i, s in enumerate(SAMPLES) for f in s[column].split())
    return (f"SELECT 'p' || p_partkey || '.src' AS file, x.line, x.rule_id FROM part JOIN (VALUES {rows}) x(i, line, rule_id) "
            f"ON p_partkey % {len(SAMPLES)} = x.i")


# What a call in the other file reaches is there only if the part before it is.
FLOW_SQL = f"""SELECT * FROM ({expected_sql(2)}) WHERE file NOT IN (SELECT 'p' || p.p_partkey || '.src' FROM part p
  LEFT JOIN part b ON b.p_partkey = p.p_partkey - 1 WHERE p.p_partkey % {len(SAMPLES)} IN (13, 41) AND b.p_partkey IS NULL)"""


def scope_taint(spark, sf):
    return tn.scan_flow(tn.extract(code_files(spark, sf))).select("file", "line", "rule_id")


def call_pattern_join(spark, sf):
    return st.scan_structural(tn.extract(code_files(spark, sf))).select("file", "line", "rule_id")


def inside_semi_join(spark, sf):
    """Call shapes before and after the context conditions, per rule."""
    facts = tn.extract(code_files(spark, sf))
    hits = st.match_calls(facts.called, st.rule_table(spark, structural_rules()))
    count = lambda rows, name: rows.groupBy("rule_id").agg(F.countDistinct("file", "line_no").alias(name))
    return (
        count(hits, "matched").join(count(st.match_inside(hits), "inside"), "rule_id", "left")
        .join(count(st.match_not_inside(hits), "not_inside"), "rule_id", "left")
        .select("rule_id", "matched", F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("not_inside", F.lit(0)).alias("not_inside"))
    )


# (rule, sample) of every call shape in the samples; in sample 16 a try is around SEC_PI001.
SHAPES = (("SEC002S", 7), ("SEC005S", 39), ("SEC068S", 19), ("SEC069S", 16), ("SEC069S", 17), ("SEC080S", 21), ("SEC082S", 18),
          ("SEC_EX006", 28), ("SEC_FI002", 15), ("SEC_PI001", 16), ("SEC_PI001", 17), ("SEC_PI004", 7), ("SEC_PI008", 18),
          ("SEC_PI014", 21), ("SEC_PI015", 39), ("SEC_PT001", 27))
_PER = f"(SELECT count(*) FROM part WHERE p_partkey % {len(SAMPLES)} = "
INSIDE = f"""SELECT rule_id, count(*) AS matched, count(*) AS inside, count(*) FILTER (rule_id <> 'SEC_PI001' OR i <> 16) AS not_inside
FROM part JOIN (VALUES {', '.join(f"('{r}', {i})" for r, i in SHAPES)}) x(rule_id, i) ON p_partkey % {len(SAMPLES)} = x.i GROUP BY rule_id"""


def guard_anti_join(spark, sf):
    return tn.extract(code_files(spark, sf)).guarded.select("file", "name")


GUARD = f"SELECT 'p' || p_partkey || '.src' AS file, 'path' AS name FROM part WHERE p_partkey % {len(SAMPLES)} = 15"


def _summaries(spark, sf):
    facts = tn.extract(code_files(spark, sf))
    sinks = cut_lineage(tn.sink_arguments(facts))
    _, reached = tn.spread_taint(facts, sinks)
    return facts, reached, tn.function_summaries(facts, reached, sinks)


def function_summaries(spark, sf):
    """Parameters that reach a sink."""
    _, _, summaries = _summaries(spark, sf)
    return summaries.select("file", "func_name", "idx", "rule_id")


SUMMARIES = f"""SELECT 'p' || p_partkey || '.src' AS file, CASE WHEN x.own THEN x.f || p_partkey ELSE x.f END AS func_name, x.idx, x.rule_id
FROM part JOIN (VALUES (7, 'show', false, 0, 'SEC002T'), (11, 'helper', true, 0, 'SEC004T'), (12, 'store', true, 0, 'SEC004T'),
  (21, 'run', false, 0, 'SEC002T'), (29, 'find', true, 0, 'SEC004T'), (37, 'find', false, 1, 'SEC004T')) x(i, f, own, idx, rule_id)
  ON p_partkey % {len(SAMPLES)} = x.i"""


def tainted_return(spark, sf):
    facts, reached, _ = _summaries(spark, sf)
    return tn.tainted_functions(facts, reached).select("file", "func_name")


RETURNS = f"""SELECT 'p' || p_partkey || '.src' AS file, CASE WHEN p_partkey % {len(SAMPLES)} = 14 THEN 'fetch' ELSE 'pull' END || p_partkey AS func_name
FROM part WHERE p_partkey % {len(SAMPLES)} IN (14, 40)"""


def interprocedural_join(spark, sf):
    facts, reached, summaries = _summaries(spark, sf)
    return tn.interprocedural(facts, reached, summaries).select("file", "line", "rule_id")


INTER = f"""SELECT * FROM ({FLOW_SQL}) WHERE CAST(regexp_extract(file, '([0-9]+)', 1) AS INT) % {len(SAMPLES)} IN (11, 13, 29)"""


def summary_stats(spark, sf):
    facts, reached, summaries = _summaries(spark, sf)
    return tn.summary_stats(facts, reached, summaries)


# Functions are counted in the text; the other two follow from the samples.
STATS = f"""SELECT sum(len(regexp_extract_all(content, 'def |function |=> [{{]|void f[(]|func '))) AS functions,
  (SELECT count(*) FROM part WHERE p_partkey % {len(SAMPLES)} IN (14, 40)) AS tainted_return,
  (SELECT count(*) FROM part WHERE p_partkey % {len(SAMPLES)} IN (7, 11, 12, 21, 29, 37)) AS sink_reaching
FROM ({duck(CODE_FILES_SQL, 'part')})"""


def prior_assignment(spark, sf):
    """Names in sink arguments by what the assignment before it was: a source, a sanitiser, other, or none."""
    facts = tn.extract(code_files(spark, sf))
    uses = tn.sink_arguments(facts).select("file", "func", "line_no", F.explode("uses").alias("name"))
    return tn.prior_assignment(facts, uses).select("file", F.col("line_no").alias("line"), "name", "kind").distinct()


# (sample, line, names) by kind.
ASSIGNED = {
    "source": ((0, 3, "term"), (7, 3, "box.value"), (9, 4, "conf"), (10, 3, "name"), (22, 3, "id"), (23, 3, "name"), (25, 3, "p"),
               (26, 3, "host"), (27, 3, "f"), (30, 4, "id"), (35, 3, "id")),
    "sanitised": ((3, 4, "num"), (24, 3, "id"), (32, 2, "$name"), (32, 4, "$n"), (34, 4, "n"), (36, 3, "n")),
    "other": ((1, 5, "sql"), (2, 5, "one"), (4, 5, "sql"), (5, 5, "parts"), (6, 4, "val"), (14, 6, "v"), (15, 6, "path"), (31, 3, "$html"),
              (33, 4, "sql"), (37, 3, "sql"), (41, 3, "v")),
    None: ((3, 4, "str"), (7, 3, "box"), (8, 6, "self self.term"), (11, 2, "text"), (12, 2, "text"), (21, 2, "True shell cmd"), (25, 3, "p.get"),
           (26, 3, "out err"), (26, 4, "out"), (27, 3, "done"), (28, 2, "req req.query req.query.next"), (29, 2, "id")),
}
_ASSIGNED = ", ".join(f"({i}, {line}, {q(n)}, {q(kind) if kind else 'NULL'})" for kind, rows in ASSIGNED.items()
                      for i, line, names in rows for n in names.split())
PRIOR = f"""SELECT 'p' || p_partkey || '.src' AS file, x.line, x.name, x.kind FROM part JOIN (VALUES {_ASSIGNED}) x(i, line, name, kind)
ON p_partkey % {len(SAMPLES)} = x.i"""


def sql_param_concat(spark, sf):
    return tn.sql_parameter_concat(tn.extract(code_files(spark, sf))).select("file", "line", "rule_id")


SQL_PARAM = f"SELECT 'p' || p_partkey || '.src' AS file, 3 AS line, 'SEC004T' AS rule_id FROM part WHERE p_partkey % {len(SAMPLES)} = 37"

# --- multi-line rules -----------------------------------------------------------
MULTI = [
    ("javascript", 'const sql =|  "x";|run(|  sql = "SELECT a" +|  id);', "3:SEC004M"),
    ("javascript", 'el.innerHTML = pick(|  req.body.x|);', "1:SEC006M"),
    ("javascript", 'app.get("/", (req, res) => <<|  const f = path.join(base, req.query.f);|  const g = req.query.g;|  path.join(b, g);|  fs.readFile(g);|>>);',
     "1:SEC035M"),
    ("php", 'mysqli_query(@c,|  "SELECT a" . @_GET["x"]|);', "1:SEC004M"),
    ("php", 'print 1;|echo "a" . f(|  @_POST["b"]);', "2:SEC006M"),
    ("java", 'stmt.executeQuery(|  "SELECT a" + request.getParameter("x"));', "1:SEC004M"),
    ("go", 'db.Query(|  "SELECT a" + id)', "1:SEC004M"),
    ("python", 'db.Query(|  "SELECT a" + id)', ""),
]


def _multi_sql() -> str:
    pick = lambda k: "split_part('" + "~".join(s[k] for s in MULTI) + f"', '~', CAST(p_partkey % {len(MULTI)} + 1 AS INT))"
    text = pick(1)
    for mark in ("|", "<<", ">>", "@"):
        text = f"replace({text}, '{mark}', {_MARKS[mark]})"
    return f"SELECT concat('q', CAST(p_partkey AS STRING)) AS file, {pick(0)} AS language, {text} AS content FROM {{part}}"


def multiline_match(spark, sf):
    return scan_multiline(derive(spark, sf, _multi_sql(), "part")).select("file", "line", "rule_id")


_ROWS = ", ".join(f"({i}, {s[2].split(':')[0]}, {q(s[2].split(':')[1])})" for i, s in enumerate(MULTI) if s[2])
MULTILINE = f"SELECT 'q' || p_partkey AS file, x.line, x.rule_id FROM part JOIN (VALUES {_ROWS}) x(i, line, rule_id) ON p_partkey % {len(MULTI)} = x.i"


def full_scan(spark, sf):
    """Every pass over the code files, merged in engine order."""
    return scan_files(code_files(spark, sf)).groupBy("language", "rule_id", "severity", "confidence").agg(F.count("*").alias("n"))


_FLOW_SEVERITY = {rule: sev for _, rule, sev, *_ in FLOW_SINKS}
_CALL_SEVERITY = {(r.language, r.rule_id): r.severity for r in structural_rules()}


def _graded(expected: str, severities: dict, engine: int) -> str:
    """Expected findings with language, severity and engine order."""
    langs = "CASE " + " ".join(f"WHEN i = {i} THEN {q(s[0])}" for i, s in enumerate(SAMPLES)) + " END"
    grade = "CASE " + " ".join(f"WHEN rule_id = {q(r)} THEN {q(v)}" for r, v in severities.items()) + " END"
    return (f"SELECT file, line, rule_id, {grade} AS severity, {langs} AS language, 'HIGH' AS confidence, {engine} AS engine_ord, 0 AS ord "
            f"FROM (SELECT *, CAST(regexp_extract(file, '([0-9]+)', 1) AS INT) % {len(SAMPLES)} AS i FROM ({expected}))")


_PICK = "file, line, rule_id, severity, language, confidence, engine_ord, ord"
FULL_SCAN = f"""WITH {logical_sql(duck(CODE_FILES_SQL, 'part'))},
clean AS (SELECT * FROM lines WHERE trim(line, {BLANKS}) <> '' AND NOT {comment_sql()} AND NOT {nosec_sql()}),
{window_sql('lines', 25, tw.DEFAULT_LANGUAGES)},
found AS (
  SELECT {_PICK} FROM ({rules_sql('clean')}) UNION ALL SELECT {_PICK} FROM ({entropy_sql('clean')})
  UNION ALL SELECT file, line, rule_id, severity, language, 'MEDIUM', 3, ord FROM ({rules_sql('logical', multiline_rules())})
  UNION ALL SELECT file, line_no, rule_id, severity, language, 'MEDIUM', 8, 0 FROM hits
  UNION ALL {_graded(FLOW_SQL, _FLOW_SEVERITY, 5)}
  UNION ALL {_graded(expected_sql(3), {r: v for (_, r), v in _CALL_SEVERITY.items()}, 9)}),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, line, rule_id ORDER BY engine_ord, ord) AS rn FROM found) WHERE rn = 1)
SELECT language, rule_id, severity, confidence, count(*) AS n FROM first
WHERE NOT (rule_id = 'SEC011' AND language = 'php' AND file NOT IN (SELECT file FROM first WHERE language = 'php' AND rule_id LIKE '%TS'))
GROUP BY ALL"""

# --- code as deep as the part says ----------------------------------------------
# Python: 1 to 40 functions or tries inside each other; 1 to 60 brackets around a cleaned value; calls that
# hand a value on through 0 to 5 functions.  JavaScript: 1 to 100 statements on one line.  All languages
# with braces: a header, an assignment and a sink on one line, and the same with a value that is cleaned inside 1 to 60 brackets.
_G = "repeat('g(', CAST(wide AS INT))"
_H = "repeat(')', CAST(wide AS INT))"
_ONE_LINE = {
    "js": ("javascript", ('app.get("/u", (req, res) => << const id = req.query.id; db.query("SELECT a" + ', 'id', '); >>);'),
           ('function two(req, db) << const n = parseInt(', 'req.query.n', '); db.query("SELECT b" + n); >>')),
    "php": ("php", ('function f(@x) << @name = @_GET["n"]; echo "<b>" . ', '@name', '; >>'),
            ('function h(@x) << @n = intval(', '@_GET["k"]', '); system("ls " . @n); >>')),
    "java": ("java", ('class A << void f(String id) throws Exception << String sql = "SELECT a" + id; stmt.executeQuery(', 'sql', '); >> >>'),
             ('class B << void g(String id) throws Exception << int n = Integer.parseInt(', 'id', '); stmt.executeQuery("SELECT a" + n); >> >>')),
    "go": ("go", ('func one(w http.ResponseWriter, r *http.Request) << id := r.FormValue("id"); rows, err := db.Query("SELECT a" + ', 'id', ') >>'),
           ('func two(w http.ResponseWriter, r *http.Request) << n, err := strconv.Atoi(', 'r.FormValue("id")', '); db.Query("SELECT a", n) >>')),
}


def _marked(text: str) -> str:
    text = q(text)
    for mark in ("<<", ">>", "@"):
        text = f"replace({text}, '{mark}', {_MARKS[mark]})"
    return text


def _one_line_sql(suffix: str) -> str:
    language, *lines = _ONE_LINE[suffix]
    parts = [x for head, value, tail in lines for x in (_marked(head), _G, _marked(value), _H, _marked(tail), "chr(10)")]
    return f"""
UNION ALL
SELECT concat('b', CAST(p_partkey AS STRING), '.{suffix}'), '{language}', concat({', '.join(parts)})
FROM (SELECT p_partkey, p_partkey % 60 + 1 AS wide FROM {{part}})"""


DEEP_SQL = f"""
SELECT concat('d', CAST(p_partkey AS STRING), '.py') AS file, 'python' AS language, concat(
         array_join(transform(sequence(1, deep), i -> concat(repeat('    ', CAST(i - 1 AS INT)), CASE WHEN i % 2 = 1 THEN concat('def f', CAST(i AS STRING), '(a, b):')
                                                     ELSE 'try:' END)), chr(10)), chr(10),
         repeat('    ', CAST(deep AS INT)), 'v = request.args.get("q")', chr(10),
         repeat('    ', CAST(deep AS INT)), 'cursor.execute("SELECT a FROM t WHERE b = " + v)', chr(10),
         repeat('    ', CAST(deep AS INT)), 'pickle.loads(v)', chr(10),
         repeat('    ', CAST(deep AS INT)), 'n = int(', {_G}, 'v', {_H}, ')', chr(10),
         repeat('    ', CAST(deep AS INT)), 'cursor.execute("SELECT a FROM t WHERE c = " + n)', chr(10)) AS content
FROM (SELECT p_partkey, p_partkey % 40 + 1 AS deep, p_partkey % 60 + 1 AS wide FROM {{part}})
UNION ALL
SELECT concat('r', CAST(p_partkey AS STRING), '.py'), 'python', concat(
         'def get', CAST(p_partkey AS STRING), 'x0():', chr(10), '    v = request.args.get("q")', chr(10), '    return v', chr(10),
         coalesce(array_join(transform(CASE WHEN hops > 0 THEN sequence(1, hops) END, i -> concat(
           'def get', CAST(p_partkey AS STRING), 'x', CAST(i AS STRING), '():', chr(10), '    w = get', CAST(p_partkey AS STRING), 'x', CAST(i - 1 AS STRING), '()', chr(10),
           '    return w', chr(10))), ''), ''),
         'def run():', chr(10), '    z = get', CAST(p_partkey AS STRING), 'x', CAST(hops AS STRING), '()', chr(10),
         '    cursor.execute("SELECT a FROM t WHERE b = " + z)', chr(10))
FROM (SELECT p_partkey, p_partkey % 6 AS hops FROM {{part}})
UNION ALL
SELECT concat('w', CAST(p_partkey AS STRING), '.js'), 'javascript', concat(
         'function f(req, db) ', chr(123), chr(10), repeat('g(1);', CAST(1 + (p_partkey * 7) % 100 AS INT)), 'const v = req.query.q;db.query("SELECT " + v);', chr(10), chr(125), chr(10),
         '/', '/ x', chr(10), 'function h(db) ', chr(123), chr(10), '  db.query("SELECT 1");', chr(10), chr(125), chr(10))
FROM {{part}}
""" + "".join(map(_one_line_sql, _ONE_LINE))


def deep_code(spark, sf):
    """Flows and context conditions, however deep the code nests; the SQL computes what must be found."""
    # The kinds of files follow each other and differ in cost; dealt by name, every task gets some of each.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    facts = tn.extract(derive(spark, sf, DEEP_SQL, "part").repartition(tasks, "file"))
    shapes = st.scan_structural(facts).where(F.col("rule_id") == "SEC_PI001")
    return tn.scan_flow(facts).select("file", "line", "rule_id").unionByName(shapes.select("file", "line", "rule_id"))


# SEC_PI001 is an unguarded load: only a file without a try around it has one.
DEEP = """
SELECT 'd' || p_partkey || '.py' AS file, p_partkey % 40 + 3 AS line, 'SEC004T' AS rule_id FROM part
UNION ALL SELECT 'd' || p_partkey || '.py', 4, 'SEC_PI001' FROM part WHERE p_partkey % 40 = 0
UNION ALL SELECT 'r' || p_partkey || '.py', 3 + 3 * (p_partkey % 6) + 3, 'SEC004T' FROM part
UNION ALL SELECT 'w' || p_partkey || '.js', 2, 'SEC004T' FROM part
UNION ALL SELECT 'b' || p_partkey || x.suffix, 1, x.rule_id FROM part,
  (VALUES ('.js', 'SEC004T'), ('.php', 'SEC006TS'), ('.java', 'SEC004TS'), ('.go', 'SEC004TS')) x(suffix, rule_id)
"""

# --- a call of each shape ---------------------------------------------------------
_WRAPPED = {
    "SEC_PI007": ("def show(a):", '    password = "hunter2hunter2"'),
    "SEC_PI011": ("class View:|    def get(self, req):", "        model.objects.raw(query)"),
    "SEC_PI012": ('&app.route("/x")|def page(name):', "    return name"),
}


def _shape(language: str, rule_id: str, pattern: str) -> tuple[str, int]:
    """Code with a call of the pattern, and the line it is on."""
    call = re.sub(r"\$([A-Z]\w*)", lambda m: m.group(1).lower(), pattern).replace("'", '"')
    if rule_id in _WRAPPED:
        head, call = _WRAPPED[rule_id]
    elif rule_id == "SEC_PI013":
        head, call = "def hash_password(data):", '    open(path, "w")'
    else:
        head, call = ("def hash_password(data):", "    " + call) if language == "python" else ("function show(a) <<", "  " + call.replace(
            "{", "<<").replace("}", ">>").replace("$", "@") + ";|>>")
    return f"{head}|{call}", head.count("|") + 2


SHAPE_FILES = [(language, row[0], *_shape(language, row[0], row[3]))
               for language, table in (("python", PYTHON_SHAPES), ("javascript", JAVASCRIPT_SHAPES)) for row in table]


def _shapes_sql() -> str:
    pick = lambda values: "split_part('" + "~".join(values) + f"', '~', CAST(p_partkey % {len(SHAPE_FILES)} + 1 AS INT))"
    text = pick(s[2] for s in SHAPE_FILES)
    for mark in ("|", "<<", ">>", "@", "&"):
        text = f"replace({text}, '{mark}', {_MARKS[mark]})"
    return (f"SELECT concat('c', CAST(p_partkey AS STRING), '.src') AS file, {pick(s[0] for s in SHAPE_FILES)} AS language, {text} AS content, "
            f"{pick(s[1] for s in SHAPE_FILES)} AS shape FROM {{part}}")


def call_shapes(spark, sf):
    """A file for every call shape: the finding of the shape it was written for."""
    files = derive(spark, sf, _shapes_sql(), "part")
    found = st.scan_structural(tn.extract(files.drop("shape")))
    return found.join(files.select("file", "shape"), "file").where(F.col("rule_id") == F.col("shape")).select("file", "line", "rule_id")


_SHAPE_ROWS = ", ".join(f"({i}, {s[3]}, {q(s[1])})" for i, s in enumerate(SHAPE_FILES))
CALL_SHAPES = f"""SELECT 'c' || p_partkey || '.src' AS file, x.line, x.rule_id FROM part JOIN (VALUES {_SHAPE_ROWS}) x(i, line, rule_id)
ON p_partkey % {len(SHAPE_FILES)} = x.i"""

# --- rows of a user ---------------------------------------------------------------
SHAPE_PACK = """
rules:
  - id: OWN1
    language: python
    kind: structural
    severity: high
    cwe: CWE-200
    pattern: show_part($KEY, raw=True)
  - id: OWN2
    language: javascript
    kind: structural
    pattern: store($A, ...)
    pattern_either: ["store($A, ...)", "keep.$B($A)"]
"""
USER_SQL = """
SELECT concat('u', CAST(p_partkey AS STRING), '.src') AS file, CASE WHEN p_partkey % 2 = 0 THEN 'python' ELSE 'javascript' END AS language,
       CASE p_partkey % 4 WHEN 0 THEN concat('def f(db):', chr(10), '    v = queue.take(', CAST(p_partkey AS STRING), ')', chr(10), '    db.execute("SELECT " + v)', chr(10),
                                             '    show_part(v, raw=True)')
         WHEN 2 THEN concat('def f(db):', chr(10), '    v = tidy(g(request.args.get("q")))', chr(10), '    db.execute("SELECT " + v)', chr(10), '    show_part(v)')
         WHEN 1 THEN concat('function f(req) ', chr(123), chr(10), '  launch(req.query.x);', chr(10), '  store(1, 2, 3);', chr(10), chr(125))
         ELSE concat('function f(req) ', chr(123), chr(10), '  const v = tidy(req.query.x);', chr(10), '  launch(v);', chr(10), '  keep(1);', chr(10), chr(125)) END AS content
FROM {part}
"""
USER_RULES = tn.FlowRules(
    sources={"python": r"\bqueue\.take\b"}, sanitisers={"python": "tidy", "javascript": "tidy"},
    sinks=(("javascript", "OWN3", "HIGH", "any", "", ("launch",), "Launches"),))


def user_rows(spark, sf):
    """Sources, sanitisers, sinks and call shapes that a user adds."""
    _, shapes, problems = load_rules(SHAPE_PACK)
    assert not problems
    facts = tn.extract(derive(spark, sf, USER_SQL, "part"), USER_RULES)
    own = st.scan_structural(facts, shapes).select("file", "line", "rule_id")
    return tn.scan_flow(facts).select("file", "line", "rule_id").unionByName(own)


USER_ROWS = """SELECT 'u' || p_partkey || '.src' AS file, x.line, x.rule_id FROM part
JOIN (VALUES (0, 3, 'SEC004T'), (0, 4, 'OWN1'), (1, 2, 'OWN3'), (1, 3, 'OWN2')) x(i, line, rule_id) ON p_partkey % 4 = x.i"""

QUERIES = {
    "deep_code": (deep_code, DEEP),
    "call_shapes": (call_shapes, CALL_SHAPES),
    "user_rows": (user_rows, USER_ROWS),
    "taint_window_join": (taint_window_join, WINDOW_SQL),
    "taint_fixed_point": (taint_fixed_point, FIXED_POINT),
    "scope_taint": (scope_taint, FLOW_SQL),
    "call_pattern_join": (call_pattern_join, expected_sql(3)),
    "inside_semi_join": (inside_semi_join, INSIDE),
    "guard_anti_join": (guard_anti_join, GUARD),
    "function_summary_labels": (function_summaries, SUMMARIES),
    "tainted_return": (tainted_return, RETURNS),
    "interprocedural_join": (interprocedural_join, INTER),
    "prior_assignment": (prior_assignment, PRIOR),
    "sql_param_concat": (sql_param_concat, SQL_PARAM),
    "summary_stats": (summary_stats, STATS),
    "multiline_match": (multiline_match, MULTILINE),
    "full_scan": (full_scan, FULL_SCAN),
}
