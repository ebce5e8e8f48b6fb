"""The corpus operators bound to the given tables, with SQL to check them where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.llm import (
    decontam,
    html,
    langid,
    lines,
    mixing,
    neardup,
    perplexity,
    ranked,
    secretscan,
    tokenalign,
    toolcalls,
    vectors,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ARCHIVE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
b AS (
  SELECT h, last, [('0x' || substr(h, (i * 5 + 1)::INT, 5))::BIGINT FOR i IN range(8)] AS parts FROM g
),
d AS (
  SELECT h, last, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) % 32 + 1)::INT, 1)
    FOR s IN [15, 10, 5, 0]], '') FOR v IN parts], '') AS digest FROM b
)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN d USING (h)
"""


@query(ARCHIVE_SQL)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back by byte ranges."""
    found = warc.archive_round_trip(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, t, 'assign' AS kind, 0 AS o, 2 AS g, 6 AS least,
    '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS re,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hits,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals,
    regexp_split_to_array(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS pieces
  FROM d
  UNION ALL
  SELECT doc_id, t, 'access', 1, 0, 20, 'AKIA[A-Z0-9]+', regexp_extract_all(t, 'AKIA[A-Z0-9]+'),
    regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL
  SELECT doc_id, t, 'hex', 2, 0, 24, '[0-9a-f]+', regexp_extract_all(t, '[0-9a-f]+'),
    regexp_extract_all(t, '[0-9a-f]+'), regexp_split_to_array(t, '[0-9a-f]+') FROM d
),
e AS (
  SELECT doc_id, kind, o, least, unnest(hits) AS hit, unnest(vals) AS val, unnest(pieces[1:len(hits)]) AS piece,
    generate_subscripts(hits, 1) AS i
  FROM k WHERE len(hits) > 0
),
p AS (
  SELECT doc_id, kind, o, least, length(val) AS n, i, length(hit) AS w,
    sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS fin FROM e
),
s AS (SELECT doc_id, kind, o, (fin - w)::BIGINT AS st, fin::BIGINT AS fin FROM p WHERE n >= least),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b,
    count(*) FILTER (kind = 'hex') AS c, string_agg(kind || ':' || st || ':' || fin, ',' ORDER BY st, o) AS txt
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(txt, '')) AS base_sha256, coalesce(txt, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


@query(SECRETS_SQL)
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in all documents. The SQL has the base kinds; the given tables hold no other."""
    found = secretscan.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    base = [r.kind for r in secretscan.BASE]
    basic = F.filter("spans", lambda s: s["kind"].isin(base))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(secretscan.spans_text(basic), 256).alias("base_sha256"),
        secretscan.spans_text(F.col("spans")).alias("spans"),
    )


@query()
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = neardup.near_components(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_shingles",
        F.col("component").alias("component_id"),
        (F.col("doc_id") == F.col("component")).alias("kept"),
    )


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source
),
t AS (SELECT sum(source_size)::BIGINT AS size, sum(weight)::BIGINT AS weight FROM s),
f AS (
  SELECT s.*, 4 * s.source_size * (t.weight - coalesce(sum(s.weight) OVER w, 0))
    < s.weight * (3 * t.size - 4 * coalesce(sum(s.source_size) OVER w, 0)) AS is_full, t.size
  FROM s, t WINDOW w AS (ORDER BY s.source_size / s.weight, s.source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
r AS (
  SELECT coalesce(sum(weight) FILTER (NOT is_full), 1)::BIGINT AS w, coalesce(sum(source_size) FILTER (is_full), 0)::BIGINT AS c FROM f
),
g AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE (weight * (3 * size - 4 * c))::DOUBLE / (2.0::DOUBLE * w) END AS target
  FROM f, r
),
n AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) AS i FROM d
),
j AS (
  SELECT n.doc_id, n.size, g.source_size, g.target, n.i,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS x,
    ('0x' || substr(md5(coalesce(n.source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM n JOIN g ON n.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, ((floor(u + i * x) - floor(u + (i - 1) * x)) * size)::BIGINT AS taken FROM j
"""


@query(MIXING_SQL)
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.copies(docs).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, by a model of those that aren't held out."""
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.fit(docs))


@query()
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, folder, "documents")
    return lines.judge(docs, lines.fit(docs, table(spark, folder, "labels")))


@query()
def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, folder, "pages"))


@query()
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    return perplexity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a text of the benchmark."""
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SCHEMA = [
    ("lookup", "after", "integer", False),
    ("lookup", "query", "string", True),
    ("lookup", "limit", "integer", True),
]


def derived_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tool calls made of a conversation's turns: (calls, results, needs).

    Every user turn asks the tool ``lookup`` for its text, with the turn as the
    identifier; the turn after it, if it is the assistant's, is the result. The
    call of turn ``t`` needs that of turn ``t div 2`` if the user has it. Null
    turns and conversations are left to the operator.
    """
    asked = turns.where("role = 'user'")
    call_id = F.concat(F.lit("call_"), F.col("turn"))
    half = F.expr("turn div 2")
    users = asked.select("conv_id", F.col("turn").alias("half"), F.lit(True).alias("held")).distinct()
    after = asked.withColumn("half", half).join(users, ["conv_id", "half"], "left")
    behind = F.coalesce(F.col("held"), F.lit(False)) & (F.col("half") < F.col("turn"))
    arguments = F.to_json(
        F.struct(
            F.col("text").alias("query"),
            F.when(F.length("text") % 7 > 0, F.lit(10)).alias("limit"),
            F.when(behind, F.col("half")).alias("after"),
        )
    )
    calls = after.select("conv_id", call_id.alias("call_id"), "turn", F.lit("lookup").alias("name"), arguments.alias("arguments"))
    needs = after.where(behind).select("conv_id", call_id.alias("call_id"), F.concat(F.lit("call_"), "half").alias("needs"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call_"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results, needs


CALLS_SQL = r"""
WITH RECURSIVE u AS (
  SELECT conv_id, turn, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL
),
a AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL
),
w AS (
  SELECT u.*, CASE WHEN h.turn IS NOT NULL AND h.turn < u.turn THEN h.turn END AS half
  FROM u LEFT JOIN u AS h ON h.conv_id = u.conv_id AND h.turn = u.turn // 2
),
l AS (
  SELECT conv_id, turn, 0 AS level FROM w WHERE half IS NULL
  UNION ALL
  SELECT w.conv_id, w.turn, l.level + 1 FROM w JOIN l ON w.conv_id = l.conv_id AND w.half = l.turn
),
j AS (
  SELECT coalesce(w.conv_id, a.conv_id) AS conv_id, coalesce(w.turn, a.turn) AS t, w.turn, w.half, a.turn + 1 AS result_turn,
    w.text, a.content, w.n AS cn, a.n AS rn
  FROM w FULL JOIN a ON w.conv_id = a.conv_id AND w.turn = a.turn
),
k AS (
  SELECT j.*, l.level, CASE WHEN j.turn IS NOT NULL THEN
    '{' || CASE WHEN half IS NOT NULL THEN '"after":' || half || ',' ELSE '' END
    || CASE WHEN length(text) % 7 > 0 THEN '"limit":10,' ELSE '' END || '"query":' || to_json(text) || '}' END AS arguments
  FROM j LEFT JOIN l ON l.conv_id = j.conv_id AND l.turn = j.turn
)
SELECT conv_id, 'call_' || t AS call_id, turn, result_turn,
  CASE WHEN turn IS NULL THEN 'stray' WHEN cn > 1 OR rn > 1 THEN 'repeated' WHEN result_turn IS NULL THEN 'unanswered'
    ELSE 'linked' END AS status,
  level, CASE WHEN turn IS NOT NULL AND length(text) % 7 = 0 THEN 'missing limit' ELSE '' END AS errors,
  arguments,
  CASE WHEN turn IS NOT NULL THEN '{"arguments":' || arguments || ',"id":"call_' || t || '","name":"lookup"'
    || CASE WHEN result_turn IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END || ',"turn":' || turn || '}' END AS message
FROM k
"""


@query(CALLS_SQL)
def op10_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Tool calls derived from all conversations, linked, ordered, validated and written as canonical JSON."""
    calls, results, needs = derived_calls(table(spark, folder, "conversations"))
    schemas = spark.createDataFrame(SCHEMA, "name string, field string, type string, required boolean")
    linked = toolcalls.link_calls(calls, results, needs, schemas)
    return linked.withColumn("errors", F.array_join("errors", ","))


RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
s AS (SELECT (count(*) FILTER (len(terms) > 0))::BIGINT AS n_all, sum(len(terms))::BIGINT AS l_all FROM d),
x AS (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM x WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, n_all
),
p AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all))))::BIGINT AS score
  FROM f JOIN w USING (term) JOIN i USING (term), s GROUP BY item_id, doc_id
),
r AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM p WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query(RANKED_SQL)
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op12_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest neighbours of every twentieth vector among all."""
    return vectors.nearest(table(spark, folder, "embeddings"))


@query()
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Token groups and links of every document under two tokenizers."""
    return tokenalign.alignments(table(spark, folder, "documents"))
