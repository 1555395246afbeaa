"""Flow, window and call-shape passes on small programs."""

import textwrap

import pytest

from pyspark.sql import functions as F

from codescan.operators import facts, outline, structural, taint, taint_window
from codescan.operators import lines as ln
from codescan.plans import q_flow
from codescan.plans.q_flow import SAMPLES
from codescan.plans.scan import scan, scan_files
from tests.conftest import rows

# name -> (language, code, rules the flow pass must report, rules it must not)
PROGRAMS = {
    "basic.py": ("python", """
        def view():
            cursor = conn.cursor()
            q = request.args.get("q")
            cursor.execute("SELECT * FROM t WHERE x = " + q)
        """, "SEC004T", ""),
    "fstring.py": ("python", """
        def view(cur):
            name = flask.request.args.get("n", "")
            cur.execute(f"SELECT a FROM t WHERE n = '{name}'")
        """, "SEC004T", ""),
    "template.py": ("python", """
        def view():
            name = request.args.get("n")
            html = f"<h1>{name}</h1>"
            return render_template_string(html)
        """, "SEC026T", ""),
    "escape.py": ("python", """
        def view():
            query = html.escape(request.args.get("q"))
            return Response("<b>" + query)
        """, "", "SEC006T"),
    "compare.py": ("python", """
        def view(db):
            ok = request.args.get("q") == "yes"
            db.execute(ok)
        """, "", "SEC004T"),
    "walrus.py": ("python", """
        def view(db):
            if (raw := request.args.get("q")):
                db.execute(raw)
        """, "SEC004T", ""),
    "multiline.py": ("python", """
        def view(db):
            raw = request.args.get(
                "q",
                "none")
            db.execute(
                "SELECT a "
                + raw)
        """, "SEC004T", ""),
    "literal.py": ("python", """
        def view(db):
            raw = request.args.get("q")
            db.execute("SELECT raw FROM t")
        """, "", "SEC004T"),
    "cycle.py": ("python", """
        def view(db):
            a = b
            b = a
            c = request.args.get("q")
            b = c
            db.execute(a)
        """, "SEC004T", ""),
    "recursion.py": ("python", """
        def walk(node):
            node = request.args.get("n")
            walk(node)
            db.execute(node)
        """, "SEC004T", ""),
    "chain.py": ("python", """
        class Flow:
            def __init__(self, req):
                self.raw = req.args.get("x")

            def middle(self):
                self.sql = "SELECT " + self.raw

            def last(self, db):
                db.execute(self.sql)
        """, "SEC004T", ""),
    "field_command.py": ("python", """
        class Job:
            def __init__(self, request):
                self.cmd = request.form["c"]

            def go(self):
                subprocess.run(self.cmd)
        """, "SEC002T", ""),
    "other_class.py": ("python", """
        class A:
            def set(self, req):
                self.x = req.args.get("x")

        class B:
            def use(self, db):
                db.execute(self.x)
        """, "", "SEC004T"),
    "two_functions.py": ("python", """
        def first():
            value = request.args.get("x")
            return 1

        def second(db, value):
            db.execute(value)
        """, "", "SEC004T"),
    "path.js": ("javascript", """
        app.get('/f', (req, res) => {
            const f = req.query.f;
            const p = path.resolve(path.join(BASE, f));
            if (!p.startsWith(BASE)) {
                return res.status(403).end();
            }
            fs.readFile(p, cb);
        });
        """, "", "SEC035T"),
    "params.js": ("javascript", """
        app.get('/u', (req, res) => {
            const id = req.query.id;
            db.query('SELECT a WHERE b = ?', [id], done);
            execFile('ping', ['-c', id], done);
        });
        """, "", "SEC004T SEC003T"),
    "loop.js": ("javascript", """
        function all(req) {
            for (const x of req.body.items) {
                eval(x);
            }
        }
        """, "SEC002T", ""),
    "closure.js": ("javascript", """
        app.get('/u', (req, res) => {
            const id = req.query.id;
            load(function (err, row) {
                db.query('SELECT ' + id);
            });
        });
        """, "SEC004T", ""),
    "property.js": ("javascript", """
        function go(req) {
            const o = {};
            o.target = req.query.t;
            link.href = o.target;
        }
        """, "SEC056T", ""),
    "include.php": ("php", """
        <?php
        $page = $_GET['page'];
        include $page;
        header("Location: $page");
        """, "SEC035TS SEC056TS", ""),
    "interpolated.php": ("php", """
        <?php
        function find($db) {
            $id = $_POST['id'];
            return $db->query("SELECT a FROM t WHERE id = '$id'");
        }
        """, "SEC004TS", ""),
    "foreach.php": ("php", """
        <?php
        foreach ($_POST as $value) {
            system($value);
        }
        """, "SEC002TS", ""),
    "Servlet.java": ("java", """
        public class Servlet {
            void doGet(HttpServletRequest request, HttpServletResponse response) throws Exception {
                String name = request.getParameter("n");
                response.getWriter().println("<b>" + name);
                logger.println(name);
                response.sendRedirect(name);
            }
        }
        """, "SEC006TS SEC056TS", ""),
    "Quiet.java": ("java", """
        public class Quiet {
            void run(int id) throws Exception {
                stmt.executeQuery("SELECT " + id);
                System.out.println(id);
            }
        }
        """, "", "SEC004TS SEC006TS"),
    "server.go": ("go", """
        func handle(w http.ResponseWriter, r *http.Request) {
            host := r.URL.Query().Get("host")
            out, _ := exec.Command("ping", host).Output()
            fmt.Fprintf(w, "%s", host)
            http.Get("http://" + host)
        }
        """, "SEC002TS SEC006TS SEC066TS", ""),
    "escaped.go": ("go", """
        func handle(w io.Writer, name string) {
            fmt.Fprintf(w, "%s", html.EscapeString(name))
        }
        """, "", "SEC006TS"),
}


def frame(spark, programs):
    data = [(name, lang, textwrap.dedent(code).strip("\n") + "\n") for name, (lang, code, *_) in programs.items()]
    return spark.createDataFrame(data, "file string, language string, content string")


@pytest.fixture(scope="module")
def flow(spark):
    got = {}
    for r in taint.scan_flow(taint.extract(frame(spark, PROGRAMS))).collect():
        got.setdefault(r.file, set()).add(r.rule_id)
        assert r.confidence == "HIGH" and r.code_snippet
    return got


@pytest.mark.parametrize("name", PROGRAMS)
def test_flow(flow, name):
    _, _, must, must_not = PROGRAMS[name]
    found = flow.get(name, set())
    assert set(must.split()) <= found
    assert not set(must_not.split()) & found


def marks(code):
    for a, b in (("|", "\n"), ("<<", "{"), (">>", "}"), ("@", "$"), ("&", "@"), ("#", "7"), ("^", "7")):
        code = code.replace(a, b)
    return code


def sample_frame(spark):
    data = [(f"s{i}", s[0], marks(s[1])) for i, s in enumerate(SAMPLES)]
    return spark.createDataFrame(data, "file string, language string, content string")


def expected(column):
    return {(f"s{i}", int(f.split(":")[0]), f.split(":")[1]) for i, s in enumerate(SAMPLES) for f in s[column].split()}


def test_samples(spark):
    facts = taint.extract(sample_frame(spark))
    assert rows(taint.scan_flow(facts), "file", "line", "rule_id") == expected(2)
    assert rows(structural.scan_structural(facts), "file", "line", "rule_id") == expected(3)


def test_scan_is_local_to_files_and_independent_of_partitions(spark):
    """scan(A ∪ B) = scan(A) ∪ scan(B) without calls across files; input order does not matter."""
    files = frame(spark, {k: v for k, v in PROGRAMS.items() if not k.startswith("recursion")})
    columns = ["file", "line", "rule_id", "severity", "message"]
    whole = rows(scan_files(files.orderBy(F.desc("file")).repartition(8)), *columns)
    a, b = files.where("language = 'python'"), files.where("language <> 'python'")
    assert rows(scan_files(a.coalesce(1)), *columns) | rows(scan_files(b), *columns) == whole


def test_window(spark):
    def program(gap):
        return ["v = request.args.get('x')"] + ["pass"] * (gap - 1) + ["os.system(v)"]

    text = {"near": program(25), "far": program(26), "step": ["a = input()", "b = a + 'x'", "c = b + 'y'", "d = c + 'z'",
            "e = d + 'z'", "open(d)", "open(e)"], "same": ["os.system(request.args.get('x'))"]}
    data = [(f, "python", i, line) for f, body in text.items() for i, line in enumerate(body, 1)]
    lines = spark.createDataFrame(data, "file string, language string, line_no int, line string")
    got = {(r.file, r.line): r for r in taint_window.taint_window(lines).collect()}
    assert set(got) == {("near", 26), ("step", 6)}  # e is a fourth step
    assert got["near", 26].message.endswith("on line 1") and got["step", 6].message.endswith("on line 4")


def test_window_over_long_files(spark):
    """Blocks of a long file agree with a direct search."""
    body = []
    for i in range(1, 5001):
        body.append("v = input()" if i % 37 == 0 else "os.system(v)" if i % 11 == 0 else "x = 1")
    lines = spark.createDataFrame([("f", "python", i, b) for i, b in enumerate(body, 1)],
                                  "file string, language string, line_no int, line string")
    want = {i for i, b in enumerate(body, 1) if b.startswith("os") and any(
        body[j - 1].startswith("v =") for j in range(max(1, i - 25), i))}
    assert {r[0] for r in rows(taint_window.taint_window(lines), "line")} == want


def test_whole_scan(spark):
    corpus = spark.createDataFrame([
        ("app/a.py", "import os\npassword = 'hunter2222'\nprint(eval(x))\n"), ("node_modules/b.js", "eval(x)"),
        ("requirements.txt", "flask==1.0\nrequests\n"), ("web/x.php", "<?php\n$a = htmlspecialchars($_GET['a']);\n$b = $_GET['b'];\n"),
    ], "file string, content string")
    advisories = spark.createDataFrame([
        ("PyPI", "flask", "1.0", i, f"A{i}", "bad", [("CVSS_V3", s)]) for i, s in enumerate(["5.0", "9.1", "CVSS:3.1/AV:N", "1.0"])],
        "ecosystem string, name string, version string, seq int, id string, summary string, severity array<struct<type:string,score:string>>")
    found, suppressed = scan(corpus, advisories)
    got = rows(found, "file", "rule_id", "severity")
    assert ("app/a.py", "SEC001", "HIGH") in got and ("app/a.py", "SEC002", "HIGH") in got
    assert not any(f.startswith("node_modules") for f, *_ in got)
    assert {s for f, r, s in got if r == "SCA001"} == {"MEDIUM", "HIGH"}
    assert found.where("rule_id = 'SCA001'").count() == 3
    assert not any(r == "SEC011" for _, r, _ in got)  # the flow pass found nothing in x.php
    assert suppressed.first()[0] == 0
    from codescan.operators.findings import fingerprints

    known = fingerprints(found.where("file = 'app/a.py'"))
    left, suppressed = scan(corpus, advisories, baseline=known)
    assert {f for f, *_ in rows(left, "file", "rule_id")} == {"requirements.txt"} and suppressed.first()[0] > 0
    again, _ = scan(corpus, advisories, baseline=fingerprints(found))
    assert again.count() == 0


def test_assert_statements(spark):
    from codescan.operators.secrets import scan_assert

    lines = ln.explode_lines(spark.createDataFrame([("a", "python", "  assert x\nasserted = 1\n")],
                                                   "file string, language string, content string"))
    assert rows(scan_assert(lines), "line", "rule_id") == {(1, "SEC003")}


def test_files_of_a_shard_stay_apart(spark):
    """Files share shards, so rounds cost what their edges are; names of one file never reach another, nor are nodes broadcast."""
    edges = spark.range(300).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("s").alias("scope"), F.lit("a").alias("name"),
                                    F.lit("s").alias("to_scope"), F.lit("b").alias("to_name"))
    reach = taint.Reach(edges)
    assert reach.shards == reach.buckets
    seed = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("s").alias("scope"),
                                                     F.lit("a").alias("name"), F.lit("web").alias("label"))
    reach.grow(seed(0, 100))
    reach.grow(seed(200, 250))
    hit = lambda upto: {(f"f{i}", n) for i in [*range(100), *(range(200, 250) if upto else ())] for n in "ab"}
    assert rows(reach.table(upto=0), "file", "name") == hit(0) and rows(reach.table(), "file", "name") == hit(1)
    joined = edges.join(reach.table(), ["file", "scope", "name"], "left_semi")
    assert joined.count() == 150 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


CALLS = [
    ("python", "n = int(g(g(v)), b, (c, d))", [("int", ["g(g(v))", "b", "(c, d)"]), ("g", ["g(v)"]), ("g", ["v"])]),
    ("python", "x = f( ) + h(a[1, 2], {k: 1}) + new  (z", [("f", []), ("h", ["a[1, 2]", "{k: 1}"])]),
    ("python", "a.b.run(x, ", [("a.b.run", ["x"])]),
    ("python", "p(x] + q(y)", [("q", ["y"])]),
    ("javascript", "app.get('/u', (req, res) => {", [("app.get", ["'/u'", "(req, res) => {"])]),
    ("php", "echo f($a) . h($b)", [("echo", ["f($a) . h", "$b"]), ("f", ["$a"])]),
    ("php", "echo ($a), foo(", [("echo", ["$a)", "foo("])]),
    ("php", "print($x->y(1, 2))", [("print", ["$x->y(1, 2)"]), ("$x.y", ["1", "2"])]),
    ("java", "x = new  a.B (c) + p::q(all(d))", [("new a.B", ["c"]), ("p.q", ["all(d)"]), ("all", ["d"])]),
]


def test_calls_are_cut_out_by_their_marks(spark):
    """Arguments of nested, open and crossed calls; no pattern runs from every bracket to its partner."""
    kept = ["raw", "snippet", "func", "func_name", "parent", "class_name", "header_name"]
    flags = ["header", "in_route", "in_try", "in_method", "in_function"]
    scoped = spark.createDataFrame([(str(i), language, outline.paired(code)) for i, (language, code, _) in enumerate(CALLS)],
                                   "file string, language string, paired string")
    scoped = scoped.select("*", F.lit(1).alias("line_no"), *[F.lit("").alias(c) for c in kept], *[F.lit(False).alias(c) for c in flags])
    called = facts.calls(scoped)
    found = called.select("file", "callee", facts.call_args().alias("args")).collect()
    for i, (_, code, want) in enumerate(CALLS):
        assert sorted((r["callee"], r["args"]) for r in found if r["file"] == str(i)) == sorted(want), code
    heads = next(line for line in called._jdf.queryExecution().optimizedPlan().toString().splitlines() if "AS _heads" in line)
    assert r"\k<b>" not in heads


def test_arguments_are_read_for_names_with_a_summary_only(spark):
    """Calls of other names are dropped before their arguments are taken apart, and are not stored a second time without marks."""
    code = spark.createDataFrame([("a.py", "python", "def show(q):\n    cursor.execute(\"SELECT \" + q)\n\n"
                                   "def run():\n    v = request.args.get(\"q\")\n    show(g(g(v)))\n    other(g(g(v)))\n")],
                                 "file string, language string, content string")
    known = taint.extract(code)
    assert "args" not in known.called.columns
    sinks = taint.sink_arguments(known)
    _, reached = taint.spread_taint(known, sinks)
    found = taint.interprocedural(known, reached, taint.function_summaries(known, reached, sinks))
    assert rows(found, "file", "line", "rule_id") == {("a.py", 6, "SEC004T")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi, (last" in plan[plan.index("Generate posexplode(paired_args"):]


def test_deep_code_is_dealt_evenly(spark, tmp_path, monkeypatch):
    """Every task that reads the files of deep_code gets some of each kind."""
    spark.range(400).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    taken = []
    monkeypatch.setattr(q_flow.tn, "extract", lambda files: taken.append(files) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        q_flow.deep_code(spark, str(tmp_path))
    parts = taken[0].groupBy(F.spark_partition_id().alias("p")).agg(
        F.count_distinct(F.substring("file", 1, 1)).alias("kinds"), F.count("*").alias("n")).collect()
    assert len(parts) >= 4 * spark.sparkContext.defaultParallelism and min(r["kinds"] for r in parts) == 4
    assert sum(r["n"] for r in parts) == 2800
