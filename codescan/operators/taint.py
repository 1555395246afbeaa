"""Scope taint: sources to sinks over assignment and call facts.

All languages share one propagation: nodes are (file, scope, name, label), edges come
from assignments, and what a file's seeds reach is found where its edges lie.  The label tells where
the taint started, so the flows of the web sources and of every function parameter are computed together.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameWriter, Window
from pyspark.sql import functions as F

from codescan.operators import facts as fa
from codescan.operators.skew import salted_lookup
from codescan.rules.metadata import cwe_of, owasp_of
from codescan.rules.taint_tables import (
    FLOW_SINKS, JS_REQUEST_PARAMS, PROPERTY_SINKS, REQUEST_NAMES, SQL_WORDS, sink_message,
)
from codescan.session import cut_lineage, work_folder, work_table, write_counted

WEB = "web"
NODE = ["file", "scope", "name", "label"]
SHARD_EDGES = 20_000


@dataclass(frozen=True)
class FlowRules:
    """Rows of a user beside the fixed ones.

    ``sources`` and ``sanitisers`` map a language to an expression: of untrusted input, and of the name of a call
    that cleans its arguments.  ``sinks`` are rows (language, rule, severity, policy, receiver, callees, message).
    """

    sources: dict[str, str] = field(default_factory=dict)
    sanitisers: dict[str, str] = field(default_factory=dict)
    sinks: tuple = ()


@dataclass
class CodeFacts:
    scoped: DataFrame
    assigned: DataFrame
    called: DataFrame
    returned: DataFrame
    params: DataFrame
    guarded: DataFrame
    rules: FlowRules


def extract(files: DataFrame, rules: FlowRules | None = None) -> CodeFacts:
    """Facts of (file, language, content) rows, one row per file; kept in the shared folder."""
    rules = rules or FlowRules()
    scoped = cut_lineage(fa.statements(files))
    assigned = cut_lineage(fa.assignments(scoped, rules.sources, rules.sanitisers))
    called = cut_lineage(fa.calls(scoped))
    # Rounds read these again and again, so they are kept too.
    returned = fa.returns(scoped, rules.sources, rules.sanitisers).drop("raw", "code", "paired", "next_code", "params", "expr")
    return CodeFacts(scoped, assigned, called, cut_lineage(returned), cut_lineage(fa.parameters(scoped)),
                     cut_lineage(fa.guarded_names(scoped, assigned)).hint("merge"), rules)


def scope_of(name: Column, func: Column, class_name: Column) -> Column:
    """Fields of the own object live in the class, other names in the function."""
    field = name.rlike(r"^(self|cls|this)\.") & (class_name != "")
    return F.when(field, F.concat(F.lit("class "), class_name)).otherwise(func)


def flow_edges(facts: CodeFacts) -> DataFrame:
    """(file, scope, name, to_scope, to_name): taint of the first reaches the second.  Edges stay inside a file."""
    a, c = facts.assigned, facts.called
    steps = (
        a.select("file", "func", "class_name", "target", F.explode_outer("uses").alias("name"))
        .where(F.col("name").isNotNull() & (F.col("name") != F.col("target")))
        .select("file", scope_of(F.col("name"), F.col("func"), F.col("class_name")).alias("scope"), "name",
                scope_of(F.col("target"), F.col("func"), F.col("class_name")).alias("to_scope"),
                F.col("target").alias("to_name"))
    )
    # Nested functions see the names of the function around them.
    seen = (
        a.select("file", "parent", "func", F.explode_outer("uses").alias("name"))
        .unionByName(c.select(
            "file", "parent", "func", F.explode_outer(F.flatten(F.transform(fa.call_args(), fa.names_in))).alias("name")))
        .where(F.col("parent").isNotNull() & (F.col("parent") != "") & F.col("name").isNotNull())
        .select("file", F.col("parent").alias("scope"), "name", F.col("func").alias("to_scope"),
                F.col("name").alias("to_name"))
    )
    return steps.unionByName(seen)


def source_seeds(facts: CodeFacts) -> DataFrame:
    """Nodes tainted by untrusted input: source assignments and request-like parameters."""
    assigned = facts.assigned.where("is_source").select(
        "file", scope_of(F.col("target"), F.col("func"), F.col("class_name")).alias("scope"),
        F.col("target").alias("name"))
    kind = F.lower("type")
    untrusted = (
        ((F.col("language") == "javascript") & F.col("name").rlike(f"^({JS_REQUEST_PARAMS})$"))
        | ((F.col("language") == "python") & (F.col("class_name") != "") & F.col("name").rlike(f"^({REQUEST_NAMES})$"))
        | ((F.col("language") == "java") & (
            kind.rlike("httpservletrequest|servletrequest|httpexchange|serverrequest|requestinfo")
            | kind.rlike(r"^(?:final\s+|@\w+(?:\([^)]*\))?\s+)*(string|charsequence|object|stringbuilder|stringbuffer)$")))
        | ((F.col("language") == "go") & kind.rlike("request|responsewriter"))
    )
    # Destructured request objects ({ body }) name the tainted parts themselves.
    params = facts.params.where(untrusted).select("file", F.col("func").alias("scope"), "name")
    return assigned.unionByName(params).distinct().withColumn("label", F.lit(WEB))


def parameter_seeds(facts: CodeFacts, sinks: DataFrame, languages=("python", "javascript")) -> DataFrame:
    """Parameters of functions with a sink inside, each a seed of its own label ``func#index``.

    Other functions cannot have a summary, so most parameters of a corpus never enter.
    """
    owners = sinks.select("file", "func").unionByName(
        sinks.where(F.col("parent") != "").select("file", F.col("parent").alias("func"))).distinct()
    return facts.params.where(F.col("language").isin(*languages)).join(owners, ["file", "func"], "left_semi").select(
        "file", F.col("func").alias("scope"), "name",
        F.concat("func", F.lit("#"), F.col("idx").cast("string")).alias("label")).distinct()


class Reach:
    """Nodes reached over edges, both in tables bucketed by shard, a few thousand edges of whole files.

    An edge never leaves its file, so one pass over the edges of a file, a cell of the input, ends the
    search in it, however long the chains are.  Edges are shuffled once, when they are stored; a round finds edges and
    known nodes of a shard in one bucket, follows those of files with new seeds, and its new nodes are written where they belong.
    """

    def __init__(self, edges: DataFrame):
        self.spark = edges.sparkSession
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.edges, self.nodes, self.turn = work_table(self.spark, "edges"), work_table(self.spark, "reached"), 0
        steps = edges.select("file", "scope", "name", "to_scope", "to_name").repartition(self.buckets, "file").distinct()
        path = work_folder(self.spark, "steps")
        self.shards = max(self.buckets, write_counted(steps, path) // SHARD_EDGES)
        self._bucketed(self.spark.read.schema(steps.schema).parquet(path)).saveAsTable(self.edges)

    def _bucketed(self, rows: DataFrame) -> DataFrameWriter:
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("file"), F.lit(self.shards)))
        return rows.repartition(self.buckets, "shard").write.bucketBy(self.buckets, "shard").format("parquet")

    def add(self, nodes: DataFrame, turn: int) -> None:
        """Store nodes without following them."""
        self._bucketed(nodes.select(*NODE).distinct().withColumn("turn", F.lit(turn))).mode("append").saveAsTable(self.nodes)

    def grow(self, seeds: DataFrame) -> None:
        """Add seeds, of which none may be known yet, and all nodes that they reach."""
        self.add(seeds, self.turn)
        self.following(self.turn).write.mode("append").bucketBy(self.buckets, "shard").format("parquet").saveAsTable(self.nodes)
        self.turn += 1

    def following(self, turn: int) -> DataFrame:
        """The nodes that the seeds of a round reach and that are not known."""

        def follow(edges: pa.Table, nodes: pa.Table) -> pa.Table:
            files = nodes.filter(pc.equal(nodes["turn"], turn))["file"].unique()
            edges, nodes = (t.filter(pc.is_in(t["file"], value_set=files)) for t in (edges, nodes))
            rows = list(zip(*(nodes.column(c).to_pylist() for c in (*NODE, "turn"))))
            seen = {r[:4] for r in rows}
            todo = [r[:4] for r in rows if r[4] == turn]
            found = []
            steps = defaultdict(list)
            for file, scope, name, *to in zip(*(edges.column(c).to_pylist() for c in ("file", "scope", "name", "to_scope", "to_name"))):
                steps[file, scope, name].append(to)
            while todo:
                file, scope, name, label = todo.pop()
                for to in steps.get((file, scope, name), ()):
                    node = (file, *to, label)
                    if node not in seen:
                        seen.add(node)
                        found.append(node)
                        todo.append(node)
            shard = nodes.column("shard")[0].as_py() if found else None
            columns = [[n[i] for n in found] for i in range(4)]
            return pa.table([*(pa.array(c, pa.string()) for c in columns), pa.array([turn] * len(found), pa.int32()),
                             pa.array([shard] * len(found), pa.int64())], [*NODE, "turn", "shard"])

        read = self.spark.table
        return read(self.edges).groupBy("shard").cogroup(read(self.nodes).groupBy("shard")).applyInArrow(
            follow, "file string, scope string, name string, label string, turn int, shard long")

    def table(self, upto: int | None = None) -> DataFrame:
        """The nodes known; they grow with the corpus and are small only in their files, so no join may broadcast them."""
        rows = self.spark.table(self.nodes).hint("merge")
        return (rows if upto is None else rows.where(F.col("turn") <= upto)).select(*NODE)


def propagate(seeds: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All nodes reachable from the seeds, and the known ones."""
    reach = Reach(edges)
    if known is not None:
        reach.add(known, -1)
        seeds = seeds.select(*NODE).join(known.select(*NODE), NODE, "left_anti")
    reach.grow(seeds)
    return reach.table()


def sink_table(spark, extra: tuple = ()) -> DataFrame:
    """The fixed sinks and any further rows of the same shape."""
    rows = [(lang, callee, rule, sev, policy, receiver, message, i)
            for i, (lang, rule, sev, policy, receiver, callees, message) in enumerate([*FLOW_SINKS, *extra])
            for callee in callees]
    return spark.createDataFrame(
        rows, "language string, last string, rule_id string, severity string, policy string, receiver_like string, "
              "message string, sink_ord int")


def sink_arguments(facts: CodeFacts, extra: tuple = ()) -> DataFrame:
    """Arguments of sink calls that count for the sink: (…, rule_id, uses, is_source)."""
    spark, extra = facts.called.sparkSession, (*facts.rules.sinks, *extra)
    key = F.when(F.col("language") == "php", F.lower("last")).otherwise(F.col("last"))
    hits = (
        facts.called.withColumn("last", key)
        .join(F.broadcast(sink_table(spark, extra)), ["language", "last"])  # bounded: a fixed table of a few hundred names
        .where((F.col("receiver_like") == "") | F.expr("receiver rlike concat('^(?:', receiver_like, ')$')"))
    )
    counted = F.when(F.col("policy") == "first", F.slice("paired_args", 1, 1)).when(
        F.col("policy") == "rest", F.slice("paired_args", F.lit(2), F.greatest(F.size("paired_args"), F.lit(1)))).otherwise(F.col("paired_args"))
    clean = lambda a: fa.without_sanitised(a, F.col("language"), facts.rules.sanitisers)
    keep = ["file", "language", "line_no", "snippet", "func", "func_name", "parent", "class_name", "rule_id", "severity",
            "message", "sink_ord"]
    calls = hits.select(*keep, F.array_join(F.transform(counted, clean), " , ").alias("_text"))
    # Writes to dangerous properties are sinks too.
    rule = F.create_map(*[F.lit(v) for kv in PROPERTY_SINKS.items() for v in kv])
    writes = (
        facts.assigned.where((F.col("language") == "javascript") & F.col("property").isin(*PROPERTY_SINKS))
        .withColumn("rule_id", F.element_at(rule, F.col("property"))).withColumn("severity", F.lit("HIGH"))
        .withColumn("message", F.concat(
            F.element_at(F.create_map(*[F.lit(v) for r in sorted(set(PROPERTY_SINKS.values())) for v in (r, sink_message(r))]),
                         F.col("rule_id")), F.lit(" (property "), F.col("property"), F.lit(")")))
        .withColumn("sink_ord", F.lit(1000)).select(*keep, F.col("clean").alias("_text"))
    )
    both = calls.unionByName(writes)
    return (
        both.withColumn("uses", fa.names_in(F.col("_text")))
        .withColumn("is_source", fa.has_source(F.col("_text"), F.col("language"), facts.rules.sources)).drop("_text")
    )


def reached_sinks(sinks: DataFrame, tainted: DataFrame, guarded: DataFrame) -> DataFrame:
    """Sink rows whose argument mentions a tainted, unguarded name; with the label."""
    uses = (
        sinks.withColumn("name", F.explode_outer("uses")).where(F.col("name").isNotNull())
        .join(guarded, ["file", "func", "name"], "left_anti")
        .withColumn("scope", scope_of(F.col("name"), F.col("func"), F.col("class_name")))
    )
    return uses.join(tainted, ["file", "scope", "name"])


def prior_assignment(facts: CodeFacts, uses: DataFrame) -> DataFrame:
    """(file, func, name, line_no) uses with the kind of the last assignment above them.

    The kind is ``sanitised`` when a sanitiser produced the value, ``source`` for untrusted
    input, ``other`` otherwise, NULL without an assignment.  It tells a reader whether a
    reported flow was cleaned on the way; findings themselves do not depend on it.
    """
    kind = (F.when(F.col("is_source"), "source")
            .when((F.size("uses") == 0) & (F.col("clean") != F.col("rhs")) & (F.col("clean") != ""), "sanitised")
            .otherwise("other"))
    writes = facts.assigned.select("file", "func", F.col("target").alias("name"), "line_no", kind.alias("_kind"))
    events = writes.unionByName(
        uses.select("file", "func", "name", "line_no").distinct().withColumn("_use", F.lit(True)), allowMissingColumns=True)
    above = Window.partitionBy("file", "func", "name").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    return (
        events.withColumn("kind", F.last("_kind", ignorenulls=True).over(above)).where("_use").drop("_kind", "_use"))


_SUFFIX = {"python": " (AST taint analysis)", "javascript": " (JS taint)"}


def _findings(rows: DataFrame, engine_ord: Column | int, message: Column) -> DataFrame:
    cwe, owasp = F.lit(""), F.lit("")
    for rule in sorted({s[1] for s in FLOW_SINKS} | set(PROPERTY_SINKS.values())):
        cwe = F.when(F.col("rule_id") == rule, cwe_of(rule)).otherwise(cwe)
        owasp = F.when(F.col("rule_id") == rule, owasp_of(rule)).otherwise(owasp)
    order = F.lit(engine_ord) if isinstance(engine_ord, int) else engine_ord
    out = rows.select(
        "file", F.col("line_no").alias("line"), "severity", "rule_id", "language", message.alias("message"),
        F.col("snippet").alias("code_snippet"), F.lit("HIGH").alias("confidence"), cwe.alias("cwe"),
        owasp.alias("owasp"), F.lit("").alias("ai_explanation"), order.alias("engine_ord"),
        F.col("sink_ord").alias("ord"))
    rest = [c for c in out.columns if c not in ("file", "line", "rule_id")]
    return (
        out.groupBy("file", "line", "rule_id").agg(F.min_by(F.struct(*rest), F.struct("ord", "message")).alias("_f"))
        .select("file", "line", "rule_id", "_f.*").select(*out.columns)
    )


def _engine(language: Column) -> Column:
    return (F.when(language == "python", 5).when(language == "javascript", 7).when(language == "php", 11)
            .when(language == "java", 12).otherwise(13))


def tainted_functions(facts: CodeFacts, tainted: DataFrame) -> DataFrame:
    """(language, file, func, func_name, class_name) of functions that return untrusted data."""
    rows = facts.returned.where(F.col("language").isin("python", "javascript"))
    key = ["language", "file", "func", "func_name", "class_name"]
    direct = rows.where("is_source").select(*key)
    via = (
        rows.withColumn("name", F.explode_outer("uses")).where(F.col("name").isNotNull())
        .join(facts.guarded, ["file", "func", "name"], "left_anti")
        .withColumn("scope", scope_of(F.col("name"), F.col("func"), F.col("class_name")))
        .join(tainted.where(F.col("label") == WEB), ["file", "scope", "name"], "left_semi").select(*key)
    )
    return direct.unionByName(via).distinct().where(F.col("func_name") != "")


def call_result_seeds(facts: CodeFacts, returning: DataFrame) -> DataFrame:
    """Targets assigned from a call of a function that returns untrusted data.

    Python names count across files, JavaScript names within the file.
    """
    a = facts.assigned.where(F.col("rhs_call") != "").select(
        "language", "file", "func", "class_name", "target",
        F.regexp_extract("rhs_call", r"([\w$]+)$", 1).alias("func_name"))
    names = returning.where(F.col("language") == "python").select("func_name").distinct()
    across = salted_lookup(a.where(F.col("language") == "python"), names, ["func_name"])
    within = a.join(returning.where(F.col("language") == "javascript").select("file", "func_name").distinct(),
                    ["file", "func_name"], "left_semi")
    return across.select(*a.columns).unionByName(within.select(*a.columns)).select(
        "file", scope_of(F.col("target"), F.col("func"), F.col("class_name")).alias("scope"),
        F.col("target").alias("name"), F.lit(WEB).alias("label"))


def function_summaries(facts: CodeFacts, tainted: DataFrame, sinks: DataFrame) -> DataFrame:
    """Which sinks each parameter reaches: (language, file, func, func_name, class_name, line_no, idx, rule...)."""
    hits = reached_sinks(sinks, tainted.where(F.col("label") != WEB), facts.guarded)
    owner = F.regexp_extract("label", r"^(.*)#\d+$", 1)
    return (
        # Sinks of the function itself or of one nested in it.
        hits.where((F.col("func") == owner) | F.coalesce(F.col("parent") == owner, F.lit(False)))
        .select("file", "label", "rule_id", "severity", "message", "sink_ord").distinct()
        .withColumn("func", owner)
        .withColumn("idx", F.regexp_extract("label", r"#(\d+)$", 1).cast("int"))
        .join(facts.params.select("language", "file", "func", "func_name", "class_name", "line_no").distinct(), ["file", "func"])
        .where(F.col("func_name") != "").drop("label")
    )


def summary_keys(summaries: DataFrame) -> DataFrame:
    """One row per callable key; of several functions with one key the first by (file, line) holds.

    Python keys: bare name, module.name, Class.name.  JavaScript: the name within its file.
    """
    module = F.regexp_replace(F.substring_index("file", "/", -1), r"\.\w+$", "")
    keys = F.when(F.col("language") == "python", F.array_compact(F.array(
        F.col("func_name"), F.concat(module, F.lit("."), F.col("func_name")),
        F.when(F.col("class_name") != "", F.concat("class_name", F.lit("."), F.col("func_name")))))).otherwise(
        F.array(F.concat("file", F.lit(":"), F.col("func_name"))))
    each = summaries.withColumn("key", F.explode(keys))
    first = each.groupBy("key").agg(F.min(F.struct("file", "line_no")).alias("_o")).select("key", "_o.*")
    # All three columns in the key: a name that many files define is spread over tasks.
    return each.join(first, ["key", "file", "line_no"], "left_semi")


def interprocedural(facts: CodeFacts, tainted: DataFrame, summaries: DataFrame) -> DataFrame:
    """Calls that pass untrusted data to a parameter which reaches a sink.

    The full dotted callee decides if a summary has that key, its last name otherwise.  Either way the last name is that
    of the function, so calls of other names are left out before their arguments are read.
    """
    summaries = cut_lineage(summaries)
    names = cut_lineage(summaries.select(F.col("func_name").alias("last")).distinct())
    args = (
        facts.called.where(F.col("language").isin("python", "javascript"))
        .join(names, "last", "left_semi")
        .select("language", "file", "line_no", "snippet", "func", "func_name", "class_name", "callee", "last",
                F.posexplode("paired_args").alias("idx", "arg"))
        .where(~F.col("arg").rlike(r"^\s*\w+=(?!=)"))
        .withColumn("name", F.explode_outer(fa.names_in(fa.without_sanitised(F.col("arg"), F.col("language"), facts.rules.sanitisers))))
        .where(F.col("name").isNotNull())
        .withColumn("scope", scope_of(F.col("name"), F.col("func"), F.col("class_name")))
        .join(tainted.where(F.col("label") == WEB).select("file", "scope", "name"), ["file", "scope", "name"], "left_semi")
        .select("language", "file", "line_no", "snippet", "func", F.col("func_name").alias("caller"), "callee", "last", "idx")
        .distinct()
    )
    s = summary_keys(summaries).select(
        "key", "idx", "rule_id", "severity", "message", "sink_ord", F.col("func_name").alias("summary_name"),
        F.col("file").alias("def_file"), F.col("line_no").alias("def_line"))
    prefix = F.when(F.col("language") == "python", F.lit("")).otherwise(F.concat("file", F.lit(":")))
    known = s.select(F.col("key").alias("_full")).distinct().withColumn("_known", F.lit(True))
    keyed = (
        salted_lookup(args.withColumn("_full", F.concat(prefix, F.col("callee"))), known, ["_full"], how="left")
        .withColumn("key", F.when(F.col("_known"), F.col("_full")).otherwise(F.concat(prefix, F.col("last"))))
        .drop("_known", "_full")
    )
    hits = salted_lookup(keyed, s, ["key", "idx"]).where(F.col("summary_name") != F.col("caller"))
    return _findings(hits, 6, F.concat(
        F.col("message"), F.lit(" - tainted arg passed to '"), F.col("summary_name"), F.lit("' (defined in "),
        F.substring_index("def_file", "/", -1), F.lit(", line "), F.col("def_line").cast("string"), F.lit(")")))


def sql_parameter_concat(facts: CodeFacts) -> DataFrame:
    """A parameter joined into SQL text that is then executed without bound values (SEC004T)."""
    joined = (
        facts.assigned.where((F.col("language") == "python") & F.col("raw").rlike(f"(?i)[\"'].*{SQL_WORDS}") & F.col("joins"))
        .select("file", "func", F.col("target").alias("name"), F.explode_outer("uses").alias("param"))
    )
    own = facts.params.select("file", "func", F.col("name").alias("param")).distinct().hint("merge")
    built = joined.join(own, ["file", "func", "param"]).groupBy("file", "func", "name").agg(
        F.array_join(F.sort_array(F.collect_set("param")), ", ").alias("joined"))  # bounded by a signature
    runs = (
        facts.called.where((F.col("language") == "python") & F.col("last").isin("execute", "executemany")
                           & (F.size("paired_args") == 1) & F.col("callee").contains("."))
        .withColumn("name", F.element_at(fa.call_args(), 1))
    )
    hits = (
        runs.join(built.hint("merge"), ["file", "func", "name"])
        .withColumn("rule_id", F.lit("SEC004T")).withColumn("severity", F.lit("HIGH")).withColumn("sink_ord", F.lit(2000))
    )
    return _findings(hits, 5, F.concat(
        F.lit("SQL injection - parameter(s) "), F.col("joined"), F.lit(" concatenated into SQL string passed to execute()")))


def spread_taint(facts: CodeFacts, sinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes reached from sources and parameters, the same plus results of tainted functions).

    A function may return what another returned: results are added until no call yields a new one.
    """
    reach = Reach(flow_edges(facts))
    reach.grow(cut_lineage(source_seeds(facts).unionByName(parameter_seeds(facts, sinks))))
    while True:
        results = call_result_seeds(facts, tainted_functions(facts, reach.table())).distinct()
        results = cut_lineage(results.join(reach.table(), NODE, "left_anti"))
        if results.isEmpty():
            return reach.table(upto=0), reach.table()
        reach.grow(results)


def scan_flow(facts: CodeFacts) -> DataFrame:
    """Findings of the scope pass: direct, through functions, and SQL built from parameters."""
    sinks = cut_lineage(sink_arguments(facts))
    _, tainted = spread_taint(facts, sinks)
    web = tainted.where(F.col("label") == WEB).select("file", "scope", "name")
    # Module-level Python code is left to the line-window pass.
    in_scope = (F.col("language") != "python") | (F.col("func") != "")
    direct = sinks.where(F.col("is_source") & in_scope)
    flowed = reached_sinks(sinks.where(in_scope), web, facts.guarded).select(*sinks.columns)
    suffix = F.lit("")
    for name, text in _SUFFIX.items():
        suffix = F.when(F.col("language") == name, text).otherwise(suffix)
    found = _findings(direct.unionByName(flowed), _engine(F.col("language")), F.concat(F.col("message"), suffix))
    summaries = function_summaries(facts, tainted, sinks)
    return found.unionByName(interprocedural(facts, tainted, summaries)).unionByName(sql_parameter_concat(facts))


def summary_stats(facts: CodeFacts, tainted: DataFrame, summaries: DataFrame) -> DataFrame:
    """Number of functions, of those returning untrusted data, of those whose parameters reach a sink."""
    functions = facts.scoped.where("header").select("file", "header_id").distinct()
    return functions.agg(F.count("*").alias("functions")).select(
        "functions",
        tainted_functions(facts, tainted).agg(F.count("*")).scalar().alias("tainted_return"),
        summaries.agg(F.countDistinct("file", "func")).scalar().alias("sink_reaching"))
