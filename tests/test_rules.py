"""Rule packs, substring guards and line matching."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codescan.functions.anchors import required_groups
from codescan.operators import match
from codescan.rules.metadata import cwe_of, metadata_rows, owasp_of
from codescan.rules.regex_packs import line_rules, multiline_rules
from codescan.rules.structural_packs import structural_rules
from codescan.sources.rule_files import load_rules, with_rules
from tests.conftest import rows


def test_catalogue_size():
    rules = line_rules()
    assert len({r.rule_id for r in rules}) == 171
    assert len({r.language for r in rules}) == 10
    assert len(rules) == 335 and len(multiline_rules()) == 8
    structural = structural_rules()
    assert len(structural) == 110
    assert sum(r.language == "python" for r in structural) == 70


def test_every_rule_is_tagged_and_compiles():
    for r in line_rules() + multiline_rules():
        re.compile(r.pattern, re.I)
        assert re.fullmatch(r"CWE-\d+", r.cwe) and re.fullmatch(r"A\d\d:2021", r.owasp), r.rule_id
    for r in structural_rules():
        assert r.owasp, r.rule_id
    assert cwe_of("SEC003T") == "" and owasp_of("SEC307") == "A05:2021"
    assert len(metadata_rows()) == 188


# language, rule id, a line it must hit, a line it must not hit
CASES = [
    ("python", "SEC001", 'password = "hunter22"', 'password = "abc"'),
    ("python", "SEC002", "x = eval(data)", "x = evaluate(data)"),
    ("python", "SEC002", "pickle.loads(b)", "pickle.dumps(b)"),
    ("python", "SEC003", "assert user.admin", "asserted = 1"),
    ("python", "SEC004", 'cur.execute("SELECT a WHERE b=" + c)', 'cur.execute(sql, (c,))'),
    ("python", "SEC005", "h = hashlib.md5(x)", "h = hashlib.sha256(x)"),
    ("python", "SEC006", "return flask.Response(request.args['x'])", "return flask.Response(body)"),
    ("python", "SEC025", "idna.encode(host)", "idna.core"),
    ("python", "SEC026", "render_template_string(t)", "render_template('a.html')"),
    ("python", "SEC027", 'os.path.join(base, "/etc")', 'os.path.join(base, "etc")'),
    ("python", "SEC027B", 'open("../../../x")', 'open("../../x")'),
    ("python", "SEC035", "open(request.args['f'])", "open(path)"),
    ("python", "SEC037", 'open("/etc/passwd")', 'open("/etc/motd")'),
    ("python", "SEC038", 'p = "%2e%2e%2fetc"', 'p = "%20"'),
    ("python", "SEC042", 'open("/proc/self/environ")', 'open("/proc/stat")'),
    ("python", "SEC043", 'jwt.decode(t, algorithms=["none"])', 'jwt.decode(t, algorithms=["HS256"])'),
    ("python", "SEC044", "jwt.decode(t, k, verify=False)", "jwt.decode(t, k)"),
    ("python", "SEC046", 'jwt.encode(p, "short")', "jwt.encode(p, KEY)"),
    ("python", "SEC056", "return redirect(request.args.get('n'))", "return redirect(url_for('a'))"),
    ("python", "SEC066", "requests.get(request.args['u'])", "requests.get(URL)"),
    ("python", "SEC067", "import xml", "import xmltodict"),
    ("python", "SEC068", "yaml.load(f)", "yaml.safe_load(f)"),
    ("python", "SEC070", "@csrf_exempt", "@csrf_protect"),
    ("python", "SEC072", "DEBUG = True", "DEBUG = False"),
    ("python", "SEC077", "if token == given:", "if a == b:"),
    ("python", "SEC079", "tempfile.mktemp()", "tempfile.mkstemp()"),
    ("python", "SEC080", "subprocess.run(c, shell=True)", "subprocess.run(c, shell=False)"),
    ("python", "SEC082", "requests.get(u, verify=False)", "requests.get(u, verify=True)"),
    ("python", "SEC121", 'SECRET_KEY = "abc"', "SECRET_KEY = os.environ['K']"),
    ("python", "SEC124", "os.execvp(a, b)", "os.environ"),
    ("python", "SEC130", "marshal.loads(b)", "marshal.dumps(b)"),
    ("javascript", "SEC001", 'const apiKey = "abcd1234";', 'cfg.apiKey = "abcd1234";'),
    ("javascript", "SEC004", "const sql = `SELECT ${id}`;", "const sql = `SELECT 1`;"),
    ("javascript", "SEC006", "el.innerHTML = x;", "el.textContent = x;"),
    ("javascript", "SEC007", "<p dangerouslySetInnerHTML={h}/>", "<p>{h}</p>"),
    ("javascript", "SEC009", 'fetch("http://a.b")', 'fetch("https://a.b")'),
    ("javascript", "SEC010", "console.log(x)", "logger.log(x)"),
    ("javascript", "SEC027", 'read("../../../x")', 'import a from "../../../x";'),
    ("javascript", "SEC050", "ignoreExpiration: true", "ignoreExpiration: false"),
    ("javascript", "SEC074", 'createCipheriv("aes-128-ecb", k, i)', 'createCipheriv("aes-256-gcm", k, i)'),
    ("javascript", "SEC086", "a.__proto__ = b", "a.proto = b"),
    ("javascript", "SEC090", "'Access-Control-Allow-Origin', '*'", "'Access-Control-Allow-Origin', o"),
    ("javascript", "SEC111", "yaml.load(s)", "yaml.safeLoad(s)"),
    ("javascript", "SEC113", "if (token === given)", "if (a === b)"),
    ("javascript", "SEC136", "const e = require('expr-eval')", "const e = require('mathjs')"),
    ("php", "SEC002", "eval($x);", "evaluate($x);"),
    ("php", "SEC011", "$a = $_GET['x'];", "$a = htmlspecialchars($_GET['x']);"),
    ("php", "SEC012", "system($c);", "system(escapeshellarg($c));"),
    ("php", "SEC029", "unserialize($d)", "unserialize($d, ['allowed_classes' => false])"),
    ("php", "SEC031", "file_exists('a'); include 'phar://x.phar'; readfile($x);", "include 'x.php';"),
    ("php", "SEC035", "include($_GET['p']);", "include('a.php');"),
    ("php", "SEC093", "if ($password == 0) {", "if ($password === 0) {"),
    ("php", "SEC094", "extract($_POST);", "extract($row);"),
    ("php", "SEC095", "preg_replace('/x/e', $a, $b)", "preg_replace('/x/', $a, $b)"),
    ("php", "SEC097", "curl_setopt($c, CURLOPT_SSL_VERIFYPEER, false);", "curl_setopt($c, CURLOPT_SSL_VERIFYPEER, true);"),
    ("php", "SEC125", "phpinfo();", "phpversion();"),
    ("php", "SEC134", "$a = `ls $dir`;", "$a = 'ls';"),
    ("java", "SEC004", 'stmt.executeQuery("SELECT " + id);', "stmt.executeQuery(sql);"),
    ("java", "SEC005", 'MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-256")'),
    ("java", "SEC015", "Runtime.getRuntime().exec(cmd);", "executor.exec(cmd);"),
    ("java", "SEC016", "new ObjectInputStream(in)", "new DataInputStream(in)"),
    ("java", "SEC044", "parser.parseClaimsJwt(t)", "parser.parseClaimsJws(t)"),
    ("java", "SEC098", "DocumentBuilderFactory.newInstance()", "builder.newInstance()"),
    ("java", "SEC102", 'Cipher.getInstance("AES/ECB")', 'Cipher.getInstance("AES/GCM/NoPadding")'),
    ("java", "SEC119", "new Yaml()", "new Yaml().setTag(x)"),
    ("go", "SEC002", 'exec.Command("sh", c)', "cmd.Run()"),
    ("go", "SEC018", 'import "math/rand"', 'import "crypto/rand"'),
    ("go", "SEC044", "jwt.Parse(t, nil)", "jwt.Parse(t, keyFunc)"),
    ("go", "SEC103", "http.Get(r.FormValue(\"u\"))", "http.Get(base)"),
    ("go", "SEC104", "md5.New()", "sha256.New()"),
    ("go", "SEC105", "InsecureSkipVerify: true", "InsecureSkipVerify: false"),
    ("bash", "SEC001", 'API_KEY="abcd1234"', 'API_KEY="$KEY"'),
    ("bash", "SEC020", "curl -k https://a", "curl https://a"),
    ("bash", "SEC022", "chmod 777 x", "chmod 755 x"),
    ("bash", "SEC023", "rm -rf $dir", 'rm -rf "$dir"'),
    ("bash", "SEC109", "IFS=,", "OFS=,"),
    ("build", "SEC064D", "link/NXCOMPAT:NO a.obj", "link/NXCOMPAT a.obj"),
    ("c", "SEC060", "mmap(0, n, PROT_EXEC, f)", "mmap(0, n, PROT_READ, f)"),
    ("c", "SEC061", "printf(argv[1]);", 'printf("%s", argv[1]);'),
    ("c", "SEC065", "free(p); p->x = 1;", "free(p); q->x = 1;"),
    ("dockerfile", "SEC201", "USER root", "USER app"),
    ("dockerfile", "SEC202", "RUN curl http://a | sh", "RUN curl http://a -o b"),
    ("dockerfile", "SEC204", "FROM alpine:latest", "FROM alpine:3.19"),
    ("dockerfile", "SEC205", "ADD https://a/b /b", "ADD b /b"),
    ("gha", "SEC302", "on: pull_request_target", "on: pull_request"),
    ("gha", "SEC303", "uses: actions/checkout@v4", "uses: actions/checkout@v4.1.7"),
    ("gha", "SEC307", "permissions: write-all", "permissions: read-all"),
]


@pytest.fixture(scope="module")
def hits(spark):
    data = [(f"{i}{kind}", lang, 1, line) for i, (lang, _, good, bad) in enumerate(CASES)
            for kind, line in (("+", good), ("-", bad))]
    lines = spark.createDataFrame(data, "file string, language string, line_no int, line string")
    return rows(match.match_rules(lines), "file", "rule_id")


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: f"{CASES[i][0]}-{CASES[i][1]}-{i}")
def test_rule(hits, i):
    assert (f"{i}+", CASES[i][1]) in hits
    assert (f"{i}-", CASES[i][1]) not in hits


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(line_rules() + multiline_rules()), st.data())
def test_guards_are_necessary(rule, data):
    """A text that matches the pattern holds every required substring group."""
    text = data.draw(st.from_regex(re.compile(rule.pattern, re.I | re.A), fullmatch=False))
    low = text.lower()
    assert all(any(part in low for part in group) for group in required_groups(rule.pattern))


def test_literals_and_comments_are_no_code(spark):
    lines = spark.createDataFrame([
        ("a", "python", 1, 'x = "call eval(y) here"'), ("a", "python", 2, "y = 1  # eval(x)"),
        ("a", "python", 3, "z = 'it' + eval(w)"), ("a", "python", 4, '"../../../x",'), ("a", "python", 5, 'p = "../../../x"'),
    ], "file string, language string, line_no int, line string")
    got = rows(match.match_rules(lines), "line", "rule_id")
    assert {x for x in got if x[1] == "SEC002"} == {(3, "SEC002")}
    assert {x for x in got if x[1] == "SEC027B"} == {(5, "SEC027B")}


def test_custom_rules(spark):
    text = r"""
rules:
  - {id: C1, language: Python, pattern: 'todo', severity: low, message: m, cwe: CWE-1}
  - {id: C1, language: go, pattern: 'fixme', cwe: CWE-2}
  - {id: C2, language: python, kind: structural, pattern: 'danger($X, safe=False)'}
  - {id: C3, language: python, pattern: '('}
  - {language: python, pattern: 'x'}
"""
    lines, calls, problems = load_rules(text)
    assert [(r.rule_id, r.language, r.severity, r.message, r.cwe) for r in lines] == [
        ("C1", "python", "LOW", "m", "CWE-1"), ("C1", "go", "MEDIUM", "Custom rule", "CWE-1")]
    assert len(calls) == 1 and calls[0].args[1] == "^safe=False$"
    assert len(problems) == 2
    rules = with_rules(line_rules(), lines)
    assert len({r.ord for r in rules}) == len(rules)
    df = spark.createDataFrame([("f", "python", 1, "x = 1 # TODO")], "file string, language string, line_no int, line string")
    assert rows(match.match_rules(df, lines), "rule_id") == set()  # inside a comment


def test_signs_drop_no_hit(spark, monkeypatch):
    """Tests of special characters and required texts never hide a line that a pattern hits."""
    from codescan.plans import tables as tb

    pieces = [(lang, text) for pack in (tb._TEMPLATES, tb.MORE_LINES) for lang, texts in pack.items() for text in texts]
    pieces += [(lang, text.replace("<<", "{").replace(">>", "}").replace("@", "$").upper()) for lang, text in pieces]
    pieces += [(lang, "") for lang in tb._TEMPLATES] + [(None, "eval(x)"), ("cobol", "eval(x)"), ("python", None)]
    df = spark.createDataFrame([("f", lang, n, text) for n, (lang, text) in enumerate(pieces)],
                               "file string, language string, line_no int, line string").repartition(4)
    got = match.match_rules(df).collect()
    monkeypatch.setattr(match, "required_groups", lambda pattern: ())
    assert sorted(got) == sorted(match.match_rules(df).collect()) and len(got) > 100


def test_prose_is_left_by_its_signs():
    """Most rules ask for a character that prose lacks, so a line of prose is not searched for their texts."""
    for language in ("python", "javascript", "php", "java", "go"):
        entries = [match._entry(r) for r in line_rules() if r.language == language]
        assert sum(bool(e["signs"]) for e in entries) > len(entries) / 2
        for e in entries:
            assert not any(all(len(t) == 1 and t not in ".,'-" for t in group) for group in e["needs"])


def test_line_ends_are_replaced_once(spark):
    """Both kinds of lines of a text come from one replacement of its line ends."""
    from codescan.operators import secrets

    files = spark.createDataFrame([("a", "python", "x = 1\r\neval(x) y"), ("b", "java", None)], "file string, language string, content string")
    found = secrets.scan_text(files)
    assert rows(found, "file", "line", "rule_id") == {("a", 2, "SEC002")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(content") == 1
