"""The queries of the numbered operators over whole tables, with the SQL that checks them.

A query that SQL cannot express has None in its place and is tested against a brute-force
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescan.llm import (
    decontaminate, digests, lexical, licenses, line_templates, packing, quality, residents, simhash, substring, suffixes, toxicity, urls,
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_substring(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the 50-word windows that an earlier one has."""
    kept = substring.remove_repeats(_table(spark, sf, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Importance weight of every document, and which half is sampled."""
    return quality.resample(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out rows are not learnt from."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Bucket, batch and slot of every sequence of the documents."""
    return packing.pack(_table(spark, sf, "documents"))


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and group of every document; three-word shingles, links at two bits or fewer."""
    found = simhash.near_duplicates(_table(spark, sf, "documents"), shingle=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items, and the items."""
    found = decontaminate.hit_report(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op7_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return digests.edit_with_next(_table(spark, sf, "documents"))


def op8_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines of templates that recur in ten documents or more; the first document keeps them."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    kept = line_templates.drop_repeated_lines(docs, counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS w FROM documents),
raw AS (SELECT rid, doc_id, unnest(w) AS line, unnest(range(len(w))) AS line_no FROM d),
plain AS (SELECT rid, doc_id, line_no, line,
                 trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')) AS p FROM raw),
masked AS (SELECT rid, doc_id, line_no, line, p, regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM plain),
t AS (SELECT *, len(m) - len(replace(m, ' ', '')) + 1 AS n, array_to_string(string_split(m, ' ')[1:3], ' ') AS lead FROM masked),
f AS (SELECT *, n - (len(m) - len(replace(m, '<*>', ''))) / 3 >= n * 0.6 AS fixed FROM t),
deep AS (SELECT * FROM f WHERE m <> '' AND doc_id IS NOT NULL),
kinds AS (SELECT n, lead, m, fixed, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM deep GROUP BY n, lead, m, fixed),
verbatim AS (SELECT p, min(doc_id) AS f FROM deep WHERE NOT fixed GROUP BY p HAVING count(DISTINCT doc_id) >= 10),
leaves AS (SELECT n, lead, count(DISTINCT doc_id) AS leaf_docs FROM deep WHERE n > 3 GROUP BY n, lead HAVING count(DISTINCT doc_id) >= 10),
tok AS (SELECT n, lead, leaf_docs, m, docs, unnest(string_split(m, ' ')[4:]) AS token, unnest(range(n - 3)) AS place
        FROM kinds JOIN leaves USING (n, lead)),
con AS (SELECT n, lead, place, token FROM tok WHERE token <> '<*>' GROUP BY n, lead, leaf_docs, place, token
        HAVING sum(docs) >= 10 AND sum(docs) >= leaf_docs * 0.1),
shaped AS (SELECT tok.n, tok.lead, m, count(con.token) AS constants,
                  list(CASE WHEN con.token IS NULL THEN NULL ELSE tok.token END ORDER BY tok.place) AS template
           FROM tok LEFT JOIN con ON con.n = tok.n AND con.lead = tok.lead AND con.place = tok.place AND con.token = tok.token
           GROUP BY tok.n, tok.lead, m),
good AS (SELECT n, lead, m, template FROM shaped WHERE constants > 0 AND constants >= (n - 3) * 0.6),
recur AS (SELECT n, lead, template, min(doc_id) AS f FROM good JOIN deep USING (n, lead, m)
          GROUP BY n, lead, template HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT m, min(f) AS f FROM (SELECT m, f FROM good JOIN recur USING (n, lead, template)
                                       UNION ALL SELECT m, first FROM kinds WHERE docs >= 10 AND fixed) GROUP BY m),
hits AS (SELECT f.*, coalesce(m <> '' AND (k.f < doc_id OR (NOT fixed AND v.f < doc_id)), false) AS gone
         FROM f LEFT JOIN marked k USING (m) LEFT JOIN verbatim v USING (p)),
kept AS (SELECT rid, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone) AS kept
         FROM hits GROUP BY rid)
SELECT doc_id, coalesce(len(w), 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN w IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def op9_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return urls.filter_urls(_table(spark, sf, "pages"), _table(spark, sf, "labels"))


_SECOND_LEVEL = ", ".join(f"'{x}'" for x in urls.SECOND_LEVEL)


def _strength_sql(level: str) -> str:
    return f"""(SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE least(greatest(
    avg(mean * (1 - mean)) / greatest(avg(power(k / n - mean, 2)) - avg(mean * (1 - mean) / n), 1e-6) - 1, 1.0), 1000.0) END
    FROM {level} WHERE n > 0)"""


OP9_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, regexp_replace(host, ':[0-9]*$', '') AS bare
            FROM p LEFT JOIN lab ON doc_id = page_id GROUP BY host),
named AS (SELECT host, n, k, string_split(bare, '.') AS w, array_to_string(string_split(bare, '.')[-2:], '.') AS two FROM counted),
hosts AS (SELECT host, n, k, CASE WHEN two IN ({_SECOND_LEVEL}) THEN two ELSE w[-1] END AS suffix,
                 CASE WHEN two IN ({_SECOND_LEVEL}) THEN array_to_string(w[-3:], '.') ELSE two END AS domain FROM named),
doms AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
sufs AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM hosts) AS mean,
                (SELECT sum(n) + 2 FROM hosts) AS most FROM hosts GROUP BY suffix),
suf AS (SELECT suffix, (k + least(s, most) * mean) / (n + least(s, most)) AS rate, n + least(s, most) AS total
        FROM sufs, (SELECT {_strength_sql('sufs')} AS s)),
domm AS (SELECT doms.*, rate AS mean, total AS most FROM doms JOIN suf USING (suffix)),
dom AS (SELECT domain, (k + least(s, most) * mean) / (n + least(s, most)) AS rate, n + least(s, most) AS total
        FROM domm, (SELECT {_strength_sql('domm')} AS s)),
hostm AS (SELECT hosts.*, rate AS mean, total AS most FROM hosts JOIN dom USING (domain)),
judged AS (SELECT host, (k + least(s, most) * mean) / (n + least(s, most)) AS rate, n + least(s, most) AS total
           FROM hostm, (SELECT {_strength_sql('hostm')} AS s)),
ruled AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN judged USING (host)
"""


def op10_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Licence phrases, labels and permission of every document."""
    found = licenses.scan(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
                        F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
                        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


_ALNUM_WORDS = ("coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])")

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2),
             lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
      FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0)),
p AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i,
             unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
      FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
m AS (SELECT rid, i, n, item_id FROM p JOIN g USING (n, gram)),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""


def op11_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start anywhere else."""
    kept = suffixes.remove_repeats(_table(spark, sf, "documents"), length=400)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Bytes are pairs of hex digits here.  Runs that touch are one run.
OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT rid, b, substr(x, CAST(2 * b + 1 AS BIGINT), 2 * (512 + 399)) AS y
      FROM (SELECT rid, x, unnest(range(0, len(x) // 2 - 399, 512)) AS b FROM d)),
w AS (SELECT rid, b + j AS i, md5(substr(y, CAST(2 * j + 1 AS BIGINT), 800)) AS g
      FROM (SELECT rid, b, y, unnest(range(0, len(y) // 2 - 399)) AS j FROM c)),
r AS (SELECT rid, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
e AS (SELECT *, i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) + 400 AS new FROM r),
k AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY rid ORDER BY i) AS island FROM e),
runs AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY rid, island),
gaps AS (SELECT rid, a, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS since
         FROM (SELECT rid, a, b FROM runs UNION ALL SELECT rid, len(x) // 2, len(x) // 2 FROM d)),
kept AS (SELECT rid, string_agg(substr(x, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) AS h
         FROM gaps JOIN d USING (rid) GROUP BY rid),
n AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""


def op12_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every finite vector as four indexes into codebooks of 256 entries, after four rounds."""
    codes, books = residents.compress(_table(spark, sf, "embeddings"))
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    digits = F.array_join(F.transform("code", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    return codes.join(totals, codes["label"].eqNullSafe(totals["of"])).select(
        "vec_id", digits.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _op12_sql() -> str:
    turn = lambda i: f"""
a{i} AS MATERIALIZED (SELECT row, p, any_value(x) AS x, min((xx - 2 * list_inner_product(x, y) + yy) * 256 + e) AS m FROM parts JOIN c{i} USING (p) GROUP BY row, p)"""  # noqa: E731
    mean = lambda i: f"""
m{i} AS (SELECT p, CAST(m AS BIGINT) % 256 AS e, k, floor(sum(x[k]) / count(*)) AS v
         FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS k FROM a{i}) GROUP BY ALL),
n{i} AS (SELECT p, e, list(v ORDER BY k) AS y FROM m{i} GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT p, e, y, list_inner_product(y, y) AS yy FROM (
    SELECT c.p, c.e, coalesce(n.y, c.y) AS y FROM c{i} c LEFT JOIN n{i} n ON c.p = n.p AND c.e = n.e))"""  # noqa: E731
    rounds = ",".join(turn(i) + "," + mean(i) for i in range(4))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
               list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 1024)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (SELECT row, p, x, list_inner_product(x, x) AS xx FROM (
    SELECT row, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p))),
c0 AS MATERIALIZED (SELECT p, row - 1 AS e, x AS y, xx AS yy FROM parts WHERE row <= 256),{rounds},{turn(4)},
coded AS (SELECT row, string_agg(printf('%02x', CAST(CAST(m AS BIGINT) % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(CAST(m AS BIGINT) // 256) AS BIGINT) AS error FROM a4 GROUP BY row),
book AS (SELECT sha256(string_agg(CAST(CAST(y[k] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k)) AS h
         FROM (SELECT p, e, y, unnest(range(1, len(y) + 1)) AS k FROM c4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (row), book
"""


OP12_SQL = _op12_sql()


def op13_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS iid, item_id, {_ALNUM_WORDS} AS w FROM benchmark),
s AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT iid, item_id, term, count(*) AS times FROM (SELECT iid, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, big_n),
v AS (SELECT rid, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))) AS worth
      FROM p JOIN f USING (term), s),
r AS (SELECT iid, item_id, rid, doc_id, CAST(sum(times * worth) AS BIGINT) AS score FROM q JOIN v USING (term) GROUP BY ALL
      HAVING sum(times * worth) > 0),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r)
SELECT * FROM o WHERE rank <= 10
"""

QUERIES = {
    "op1_substring": (op1_substring, None),
    "op2_quality": (op2_quality, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_packing": (op4_packing, None),
    "op5_simhash": (op5_simhash, None),
    "op6_decontaminate": (op6_decontaminate, OP6_SQL),
    "op7_digests": (op7_digests, None),
    "op8_lines": (op8_lines, OP8_SQL),
    "op9_urls": (op9_urls, OP9_SQL),
    "op10_licenses": (op10_licenses, None),
    "op11_suffixes": (op11_suffixes, OP11_SQL),
    "op12_codes": (op12_codes, OP12_SQL),
    "op13_lexical": (op13_lexical, OP13_SQL),
}
