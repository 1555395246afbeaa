"""Line dedup by a tree of templates.

A line is parsed into a tree of fixed depth: number of tokens, then the leading tokens; tokens
with a digit are variable (``<*>``).  In a leaf, a token behind the leading ones is a constant of its
place if enough of the leaf's documents hold it there, else it is variable.  A line's template is its
leaf and its constants.  Templates that recur in enough documents mark lines to drop, if enough of the
tokens behind the leading ones are constant: a beginning that lines share is no template.  A line that
recurs as it is is a template of its own, with digits replaced if few of its tokens have some.

DataFrame functions only.  A line is represented by hashes; its text is read again only where a
leaf recurs but the line itself does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescan.session import cut_lineage

DEPTH = 3            # leading tokens of the tree
MIN_DOCS = 10        # documents a template or a constant occurs in
MIN_SUPPORT = 0.1    # share of the leaf's documents that a constant occurs in
MIN_CONSTANT = 0.6   # share of the tokens behind the leading ones that are constant
VARIABLE = "<*>"
_BLANKS = "\t\r\f\u000b"


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a doc_id; the text's hash tells rows with one doc_id apart."""
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
        F.col(text_col).alias("text"))


def _plain(line: Column) -> Column:
    """A line without outer blanks, other blanks as spaces."""
    for blank in _BLANKS:
        line = F.replace(line, F.lit(blank), F.lit(" "))
    return F.trim(line)


def _masked(line: Column) -> Column:
    """A line without outer blanks, tokens with a digit replaced.

    Most lines have neither other blanks nor digits; plain searches find that out at less cost
    than a translation or a pattern.
    """
    plain, digit = _plain(line), F.lit(False)
    for d in "0123456789":
        digit = digit | line.contains(d)
    return F.when(digit, F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(plain)


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _leaf(line: Column, depth: int) -> Column:
    return F.xxhash64(_tokens(line), F.substring_index(line, " ", depth))


def _variables(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(VARIABLE), F.lit("")))) / len(VARIABLE)


def parse_lines(base: DataFrame, depth: int = DEPTH, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """(doc_id, key, line_no, leaf, n, h1, h2, fixed): all lines but blank ones, by hashes.

    ``fixed`` lines have few enough tokens with digits to be a template as they are.  A line
    that is not fixed is there once more, unmasked and without a leaf: a template of its own words.
    """
    lines = base.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "key", "line_no", _masked(F.col("line")).alias("line"), _plain(F.col("line")).alias("plain"))
    tokens = _tokens(F.col("line"))
    # Written before it is filtered: a filter would be pushed down and mask every line once more.
    lines = cut_lineage(lines.select(
        "doc_id", "key", "line_no", tokens.alias("n"), _leaf(F.col("line"), depth).alias("leaf"), F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"), (tokens - _variables(F.col("line")) >= tokens * min_constant).alias("fixed"),
        (F.col("line") != "").alias("filled"), F.xxhash64(F.lit(2), "plain").alias("v1"), F.xxhash64(F.lit(3), "plain").alias("v2")))
    lines = lines.where("filled")
    verbatim = lines.where("not fixed").select("doc_id", "key", "line_no", F.lit(None).cast("long").alias("leaf"), F.lit(0).alias("n"),
                                               F.col("v1").alias("h1"), F.col("v2").alias("h2"), F.lit(True).alias("fixed"))
    return lines.select(*verbatim.columns).unionByName(verbatim)


def line_templates(base: DataFrame, lines: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT,
                   min_support: float = MIN_SUPPORT) -> DataFrame:
    """(h1, h2, first): lines whose template recurs, with the first document that has the template."""
    pairs = cut_lineage(lines.groupBy("leaf", "n", "h1", "h2", "fixed", "doc_id").agg(F.min(F.struct("key", "line_no")).alias("at")))
    # One row for each different line: how many documents have it, and where it is first.
    kinds = cut_lineage(pairs.groupBy("leaf", "n", "h1", "h2", "fixed").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "at")).alias("source")))
    same = kinds.where(F.col("fixed") & (F.col("docs") >= min_docs))
    # Lookups are written before they are joined, so that a popular key can be split.  Lines that end with
    # the leading tokens have no token to generalise.
    longer = F.col("n") > depth
    leaves = cut_lineage(pairs.where(longer).select("leaf", "doc_id").distinct().groupBy("leaf").agg(
        F.count(F.lit(1)).alias("leaf_docs")).where(F.col("leaf_docs") >= min_docs))
    other = kinds.where(longer).join(leaves.select("leaf"), "leaf", "left_semi").select(
        "leaf", "h1", "h2", "docs", "source.doc_id", "source.at.key", "source.at.line_no")
    # The text of the different lines of a recurring leaf, read where each is first.
    reads = other.groupBy("doc_id", "key").agg(F.collect_list(F.struct("leaf", "h1", "h2", "docs", "line_no")).alias("wanted"))
    # Repeated rows are one text: read k times, a line would count k times.
    texts = base.dropDuplicates(["doc_id", "key"]).join(reads.hint("shuffle_hash"), ["doc_id", "key"]).select(
        "doc_id", F.split("text", "\n").alias("all"), F.explode("wanted").alias("w"))
    texts = texts.select("w.leaf", "w.h1", "w.h2", "w.docs", _masked(F.expr("all[w.line_no]")).alias("line"))
    behind = F.split(F.col("line"), " ")
    tokens = cut_lineage(texts.select("leaf", "h1", "h2", "docs", F.posexplode(
        F.slice(behind, depth + 1, F.size(behind))).alias("place", "token")))
    support = tokens.where(F.col("token") != VARIABLE).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support")).where(
        F.col("support") >= min_docs)
    constants = cut_lineage(support.join(leaves, "leaf").where(F.col("support") >= F.col("leaf_docs") * min_support).select(
        "leaf", "place", "token", F.lit(True).alias("constant")))
    shaped = tokens.join(constants, ["leaf", "place", "token"], "left").groupBy("leaf", "h1", "h2").agg(
        F.count("constant").alias("constants"), F.count(F.lit(1)).alias("size"),
        F.xxhash64(F.sort_array(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("token")).alias("token"))))).alias("template"))
    shaped = cut_lineage(shaped.where((F.col("constants") > 0) & (F.col("constants") >= F.col("size") * min_constant)).select(
        "leaf", "h1", "h2", "template"))
    # A document counts once for a template, however many of its lines have it.
    holders = pairs.where(longer).join(shaped, ["leaf", "h1", "h2"]).groupBy("leaf", "template", "doc_id").agg(F.lit(1).alias("one"))
    recurring = cut_lineage(holders.groupBy("leaf", "template").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs))
    # A line that recurs as it is is a template of its own, even where others share a wider one.
    marked = shaped.join(recurring.select("leaf", "template", "first"), ["leaf", "template"]).select("h1", "h2", "first")
    marked = marked.union(same.select("h1", "h2", F.col("source.doc_id").alias("first")))
    return marked.groupBy("h1", "h2").agg(F.min("first").alias("first"))


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until docs has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                        min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT, keep_first: bool = True,
                        counts: tuple[str, str] | None = None, min_support: float = MIN_SUPPORT) -> DataFrame:
    """docs with the lines of recurring templates cut out of the text; rows and other columns stay.

    With ``keep_first`` the document with the least doc_id keeps its lines of a template, so no text
    is lost altogether.  Blank lines stay, and rows without doc_id and null texts stay as they are; a doc_id may be
    of any type that has an order.  ``counts`` names two more columns: lines of the text and lines dropped.
    """
    base = _base(docs, id_col, text_col)
    lines = parse_lines(base, depth, min_constant)
    marked = cut_lineage(line_templates(base, lines, depth, min_docs, min_constant, min_support))
    hits = lines.join(marked, ["h1", "h2"])
    if keep_first:
        hits = hits.where(F.col("doc_id") > F.col("first"))
    gone = hits.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line_no")).alias("_gone"))
    # The kept lines are the runs between the dropped ones: one pass over a text, however many are dropped.
    c_key, c_id, c_of, c_gone, c_lines, c_ends = _unused(docs, "_key", "_id", "_of", "_gone", "_lines", "_ends")
    rows = docs.withColumn(c_key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    gone = gone.select(F.col("doc_id").alias(c_id), F.col("key").alias(c_of), F.col("_gone").alias(c_gone))
    rows = rows.join(gone.hint("shuffle_hash"), (rows[id_col] == gone[c_id]) & (rows[c_key] == gone[c_of]), "left")
    rows = rows.withColumn(c_lines, F.split(text_col, "\n")).withColumn(
        c_ends, F.when(F.col(c_gone).isNotNull(), F.concat(F.array(F.lit(-1)), c_gone, F.array(F.size(c_lines)))))
    kept = F.expr(f"array_join(flatten(transform(sequence(1, size({c_ends}) - 1), "
                  f"i -> slice({c_lines}, {c_ends}[i - 1] + 2, {c_ends}[i] - {c_ends}[i - 1] - 1))), '\n')")
    text = F.when(F.col(c_gone).isNull(), F.col(text_col)).otherwise(kept)
    extra = []
    if counts:
        extra = [F.when(F.col(c_lines).isNull(), 0).otherwise(F.size(c_lines)).cast("long").alias(counts[0]),
                 F.when(F.col(c_gone).isNull(), 0).otherwise(F.size(c_gone)).cast("long").alias(counts[1])]
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *extra)
