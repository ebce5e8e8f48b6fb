"""Scalar functions, templates and log queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusforge import functions as L
from locusforge.operators import logs
from locusforge.plans.registry import epoch, query
from locusforge.sources import listing


@query(
    """
    SELECT doc_id, 'gs' AS protocol, 'bucket.' || lang AS root,
           'data/GCST' || doc_id || '/study=' || source AS prefix, 'part-' || doc_id || '.tsv' AS filename
    FROM documents
    """
)
def uri_segments(t):
    uri = F.concat(
        F.lit("gs://bucket."), "lang", F.lit("/data/GCST"), "doc_id", F.lit("/study="), "source",
        F.lit("/part-"), "doc_id", F.lit(".tsv"),
    )
    return t.documents.select("doc_id", L.uri_segments(uri).alias("u")).select("doc_id", "u.*")


@query(
    """
    SELECT doc_id, 'gs' AS protocol, 'bucket' AS root, 'data/GCST' || doc_id AS prefix, 'study' AS filename
    FROM documents
    """
)
def uri_segments_strict(t):
    uri = F.concat(F.lit("gs://bucket/data/GCST"), "doc_id", F.lit("/study="), "source")
    return t.documents.select("doc_id", L.uri_segments(uri, strict=True).alias("u")).select("doc_id", "u.*")


@query(
    r"""
    SELECT page_id, nullif(regexp_extract(regexp_replace(url, '/$', ''), '\w*=\w*', 0), '') AS partition
    FROM pages
    """
)
def partition_key(t):
    return t.pages.select("page_id", L.partition_key(F.col("url"), on_error="null").alias("partition"))


@query("SELECT doc_id, 'GCST' || doc_id AS study FROM documents")
def study_id(t):
    path = F.concat(F.lit("gs://bucket/raw/GCST"), "doc_id", F.lit("/harmonised/"), "source", F.lit(".h.tsv.gz"))
    return t.documents.select("doc_id", L.study_id(path).alias("study"))


@query("SELECT DISTINCT p_type, p_name, regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9-]', '-', 'g') AS cleaned FROM part")
def clean_name(t):
    both = F.concat_ws(" ", "p_type", "p_name")
    return t.part.select("p_type", "p_name", L.clean_name(both).alias("cleaned")).distinct()


@query("SELECT p_partkey, regexp_replace(lower(p_type || '-' || p_name), '[^a-z0-9-]', '-', 'g') AS created FROM part")
def create_name(t):
    return t.part.select("p_partkey", L.create_name(F.col("p_type"), F.col("p_name")).alias("created"))


@query(
    """
    SELECT doc_id, left(regexp_replace(lower(left(text, 400)), '[^a-z0-9_-]', '-', 'g'), 63) AS label
    FROM (SELECT doc_id, lang || '_' || source || ' / ' || lang || ' ' || n_chars || ' ' ||
                 'A_Long.Label of document ' || doc_id || ' with more than sixty-three characters' AS text
          FROM documents)
    """
)
def clean_label(t):
    text = F.concat(
        "lang", F.lit("_"), "source", F.lit(" / "), "lang", F.lit(" "), "n_chars", F.lit(" "),
        F.lit("A_Long.Label of document "), "doc_id", F.lit(" with more than sixty-three characters"),
    )
    return t.documents.select("doc_id", L.clean_label(text).alias("label"))


@query("SELECT c_custkey, left(sha256(c_name), 5) AS hash FROM customer")
def strhash(t):
    return t.customer.select("c_custkey", L.strhash(F.col("c_name")).alias("hash"))


@query("SELECT c_custkey, left(sha256(c_name), 5) AS hash FROM customer")
def register_functions(t):
    L.register_functions(t.spark)
    return t.customer.select("c_custkey", F.expr("strhash(c_name)").alias("hash"))


@query(
    """
    SELECT unit, count(*) AS n, sum(seconds)::BIGINT AS seconds FROM (
      SELECT CASE l_linenumber % 4 WHEN 0 THEN 's' WHEN 1 THEN 'm' WHEN 2 THEN 'h' ELSE 'd' END AS unit,
             l_quantity::BIGINT * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END
               AS seconds
      FROM lineitem) GROUP BY unit
    """
)
def duration_seconds(t):
    unit = F.element_at(F.array(*[F.lit(u) for u in "smhd"]), F.col("l_linenumber") % 4 + 1)
    text = F.concat(F.col("l_quantity").cast("bigint").cast("string"), unit)
    return (
        t.lineitem.select(unit.alias("unit"), L.duration_seconds(text).alias("seconds"))
        .groupBy("unit")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))
    )


@query(
    """
    SELECT page_id, CASE WHEN url LIKE '%.json' THEN 'json' WHEN url LIKE '%.yaml' OR url LIKE '%.yml' THEN 'yaml'
                    ELSE 'text' END AS format
    FROM (SELECT page_id, replace(replace(url, '.html', '.yml'), '?utm_source=feed', '.json') AS url FROM pages)
    """
)
def format_of(t):
    path = F.replace(F.replace("url", F.lit(".html"), F.lit(".yml")), F.lit("?utm_source=feed"), F.lit(".json"))
    return t.pages.select("page_id", L.format_of(path).alias("format"))


@query(
    """
    SELECT page_id, CASE WHEN url LIKE 'gs://%' THEN 'object_store'
                         WHEN url LIKE 'file://%' OR url NOT LIKE '%://%' THEN 'local' ELSE 'unsupported' END AS scheme
    FROM (SELECT page_id, replace(replace(replace(url, 'https://www.', 'gs://'), 'https://m.', 'file://'),
                                  'http://blog.', '') AS url FROM pages)
    """
)
def scheme_of(t):
    path = F.replace("url", F.lit("https://www."), F.lit("gs://"))
    path = F.replace(path, F.lit("https://m."), F.lit("file://"))
    path = F.replace(path, F.lit("http://blog."), F.lit(""))
    return t.pages.select("page_id", L.scheme_of(path).alias("scheme"))


def _message(value="value"):
    v = F.col(value)
    code = F.floor(v).cast("bigint").cast("string")
    return (
        F.when(v < 1, F.lit("startup-script exit status 0"))
        .when(v >= 50, F.concat(F.lit('Script "startup-script" failed with error: exit status '), code))
        .otherwise(F.concat(F.lit("step done, value "), code))
    )


_EXIT = "CASE WHEN value < 1 THEN 0 WHEN value >= 50 THEN floor(value)::BIGINT END"


@query(f"SELECT event_id, {_EXIT} AS exit_code FROM events")
def exit_status(t):
    return t.events.select("event_id", L.exit_status(_message()).alias("exit_code"))


@query(
    """
    SELECT event_id, 'step=' || event_type || ';step.user=' || user_id || ';step.session.spark_uri=yarn' AS pairs
    FROM events
    """
)
def map_to_pairs(t):
    params = F.create_map(
        F.lit("step"), F.col("event_type"), F.lit("step.user"), F.col("user_id").cast("string")
    )
    return t.events.select("event_id", F.array_join(L.map_to_pairs(params, with_session=True), ";").alias("pairs"))


@query(
    """
    SELECT event_id, unnest(['events/user' || user_id || '/a.json', 'events/k' || (props::JSON->>'k') || '/b.json'])
           AS destination
    FROM events
    """
)
def json_path_explode(t):
    prefix = "https://download.example.org/"
    doc = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    F.array(
                        F.struct(F.concat(F.lit(prefix + "events/user"), "user_id", F.lit("/a.json")).alias("file")),
                        F.struct(
                            F.concat(
                                F.lit(prefix + "events/k"), F.get_json_object("props", "$.k"), F.lit("/b.json")
                            ).alias("file")
                        ),
                    ).alias("partitions")
                ).alias("event")
            ).alias("results")
        )
    )
    return listing.json_path_explode(
        t.events.select("event_id", doc.alias("document")),
        "document",
        "results struct<event:struct<partitions:array<struct<file:string>>>>",
        F.col("doc.results.event.partitions.file"),
        prefix,
    ).select("event_id", "destination")


@query(
    """
    SELECT c_custkey, 'download ' || c_name || ' dictionary' AS name,
           'https://ftp.example.org/' || n_name || '/' || c_name || '.json' AS source
    FROM customer JOIN nation ON n_nationkey = c_nationkey
    """
)
def expand_template(t):
    templates = t.nation.select(
        F.col("n_nationkey").alias("grp"),
        F.lit("download ${species} dictionary").alias("name"),
        F.concat(F.lit("https://ftp.example.org/"), "n_name", F.lit("/${species}.json")).alias("source"),
    )
    variables = t.customer.select(F.col("c_nationkey").alias("grp"), "c_custkey", "c_name")
    return listing.expand_template(templates, variables, "grp", ["name", "source"], {"species": "c_name"}).select(
        "c_custkey", "name", "source"
    )


@query(
    """
    SELECT n_nationkey, 'download ' || n_name || ' ' || kind AS name, 'https://ftp.example.org/' || n_name || '/' || kind || '.json' AS source
    FROM nation, (VALUES ('dictionary'), ('genes'), ('homologies')) k(kind)
    """
)
def expand_template_for_all(t):
    """Three templates for each species, without a group."""
    kinds = F.explode(F.array(*map(F.lit, ("dictionary", "genes", "homologies")))).alias("kind")
    templates = t.region.agg(F.count(F.lit(1)).alias("__n")).select(kinds).select(
        F.concat(F.lit("download ${species} "), "kind").alias("name"),
        F.concat(F.lit("https://ftp.example.org/${species}/"), "kind", F.lit(".json")).alias("source"),
    )
    variables = t.nation.select("n_nationkey", "n_name")
    return listing.expand_template(templates, variables, None, ["name", "source"], {"species": "n_name"}).select(
        "n_nationkey", "name", "source"
    )


def log_entries(t):
    return t.events.select(
        "event_id", "user_id", "ts", epoch("ts").alias("at"), _message().alias("message")
    )


@query(
    """
    SELECT event_id, user_id, date_diff('second', TIMESTAMP '1970-01-01', ts) AS "at" FROM events
    WHERE value >= 50 AND ts > TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 1
    """
)
def first_matching(t):
    failed = log_entries(t).where(F.col("message").contains("failed"))
    start = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    return logs.first_matching(failed, "ts", start, "event_id").select("event_id", "user_id", "at")


@query(
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'Empty log message'
      WHEN value < 1 THEN 'startup-script exit status 0'
      WHEN value >= 50 THEN 'Script "startup-script" failed with error: exit status ' || floor(value)::BIGINT
      ELSE 'step done, value ' || floor(value)::BIGINT END AS message
    FROM events WHERE event_type IN ('error', 'click')
    """
)
def instance_log(t):
    entries = t.events.select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") != "error", _message()).alias("message")
    )
    return logs.instance_log(
        entries, instance=F.col("event_type").isin("error", "click"), ts="ts", tie="event_id", message="message"
    ).select("event_id", "message")


FIRST_EXIT_SQL = f"""
    SELECT user_id, exit_code, exit_code = 0 AS succeeded FROM (
      SELECT user_id, {_EXIT} AS exit_code,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events WHERE ts > TIMESTAMP '2024-01-05' AND (value < 1 OR value >= 50))
    WHERE rn = 1
    """


@query(FIRST_EXIT_SQL)
def first_exit_status(t):
    return logs.first_exit_status(
        log_entries(t),
        instance="user_id",
        ts="ts",
        message="message",
        start=F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"),
        tie="event_id",
    )
