"""Manifest operators, filters and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusforge.operators import loci, manifests, validation
from locusforge.operators.intervals import exclude_region
from locusforge.operators.l2g import score_threshold
from locusforge.plans.registry import epoch, joined, query
from locusforge.sources import listing
from locusforge.sources.readers import project_fields

_STATUS = ("P", "F", "O")


def raw_studies(t):
    study = F.concat(F.lit("GCST"), F.col("doc_id"))
    return t.documents.select(
        study.alias("studyId"),
        F.concat(F.lit("gs://raw/"), study, F.lit("/"), F.col("source"), F.lit(".tsv.gz")).alias("rawPath"),
    )


def known_studies(t):
    return t.labels.select(F.concat(F.lit("GCST"), F.col("doc_id")).alias("studyId"))


def flagged(t):
    return t.labels.select(
        "doc_id", (F.col("quality") == 1).alias("passQuality"), (F.col("toxic") == 0).alias("passToxic")
    )


_NEW = "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


@query(
    f"""
    SELECT 'GCST' || doc_id AS "studyId", 'gs://raw/GCST' || doc_id || '/' || source || '.tsv.gz' AS "rawPath",
           'gs://staging/GCST' || doc_id || '/manifest.json' AS "manifestPath",
           'gs://staging/GCST' || doc_id || '/harmonised' AS "harmonisedPath",
           'gs://staging/GCST' || doc_id || '/qc' AS "qcPath",
           false AS "passHarmonisation", false AS "passQc", 'pending' AS status
    FROM documents d WHERE {_NEW}
    """
)
def make_manifest_rows(t):
    new = manifests.new_studies(raw_studies(t), known_studies(t), "studyId")
    return manifests.make_manifest_rows(new, "gs://staging")


@query("SELECT doc_id FROM labels WHERE quality <> 1 OR toxic <> 0")
def filter_any_flag_false(t):
    return manifests.filter_any_flag_false(flagged(t)).select("doc_id")


@query(
    """
    SELECT doc_id, count(*) AS copies FROM (
      SELECT doc_id FROM labels WHERE quality <> 1 UNION ALL SELECT doc_id FROM labels WHERE toxic <> 0)
    GROUP BY doc_id
    """
)
def filter_any_flag_false_multiplicity(t):
    rows = manifests.filter_any_flag_false(flagged(t), multiplicity=True)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT o_orderkey, o_orderstatus AS frame FROM orders")
def split_by_status(t):
    frames = manifests.split_by_status(t.orders, "o_orderstatus", _STATUS)
    a, b, c = [df.select("o_orderkey", F.lit(name).alias("frame")) for name, df in frames.items()]
    return a.unionByName(b).unionByName(c)


@query(
    """
    SELECT 'CONTINUE' AS mode, doc_id, NULL::BOOLEAN AS "passQuality" FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'RESUME', doc_id, quality = 1 FROM labels WHERE quality <> 1 OR toxic <> 0
    """
)
def choose_manifests(t):
    existing = flagged(t)
    new = manifests.new_studies(t.documents.select("doc_id"), existing, "doc_id").withColumn(
        "passQuality", F.lit(None).cast("boolean")
    )
    rows = [
        manifests.choose_manifests(new, existing, mode).select(F.lit(mode).alias("mode"), "doc_id", "passQuality")
        for mode in ("CONTINUE", "RESUME")
    ]
    return rows[0].unionByName(rows[1])


@query(
    """
    SELECT 'gs://loci/studyLocusId=' || o_orderkey AS study_locus_input, 'gs://susie/' || o_orderkey AS study_locus_output,
           'gs://logs/' || o_orderkey AS log_output FROM orders
    """
)
def locus_rows(t):
    keys = t.orders.select(F.concat(F.lit("studyLocusId="), F.col("o_orderkey")).alias("key"))
    return manifests.locus_rows(keys, "key", "gs://loci", "gs://susie", "gs://logs")


@query(
    """
    SELECT DISTINCT string_split(url, '/')[-1] AS input_file,
           replace(string_split(url, '/')[-1], '.html', '.json') AS output_file FROM pages
    """
)
def io_name_pairs(t):
    return manifests.io_name_pairs(t.pages, "url", ".html", ".json")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def keep_with_files(t):
    return manifests.keep_with_files(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def project_fields_list(t):
    return project_fields(t.lineitem, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src3')")
def exclude_sources(t):
    return manifests.exclude_sources(t.documents.select("doc_id", "source"), "source", ["src0", "src3"])


@query(
    """
    SELECT l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber AS "studyId", count(*) AS n
    FROM lineitem GROUP BY 1
    """
)
def rebuild_study_id(t):
    rows = manifests.rebuild_study_id(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return rows.groupBy("studyId").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, value FROM events WHERE value >= 5.0")
def pvalue_filter(t):
    return loci.pvalue_filter(t.events.select("event_id", "user_id", "value"), "value", 5.0)


@query(
    """
    SELECT event_id, event_type FROM events
    WHERE NOT (event_type = 'click' AND date_diff('second', TIMESTAMP '1970-01-01', ts) BETWEEN 1704500000 AND 1705500000)
    """
)
def exclude_region_mhc(t):
    rows = t.events.select("event_id", "event_type", epoch("ts").alias("pos"))
    return exclude_region(rows, "pos", 1704500000, 1705500000, "event_type", "click").drop("pos")


@query(
    """
    SELECT event_id, user_id FROM events
    WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING max(value) > 100)
    """
)
def blacklist_filter(t):
    bad = (
        t.events.where(F.col("event_type") == "error")
        .groupBy(F.col("user_id").alias("listed"))
        .agg(F.max("value").alias("m"))
        .where(F.col("m") > 100)
    )
    return loci.blacklist_filter(t.events.select("event_id", "user_id"), bad, "user_id", "listed").select(
        "event_id", "user_id"
    )


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.05")
def score_threshold_filter(t):
    return score_threshold(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount"), "l_discount")


@query("SELECT doc_id, source, lang FROM documents d WHERE " + _NEW)
def new_studies(t):
    return manifests.new_studies(t.documents.select("doc_id", "source", "lang"), t.labels, "doc_id")


@query(
    """
    SELECT s_suppkey, CASE WHEN s_nationkey = 10 THEN 'added' ELSE 'changed' END AS change
    FROM supplier WHERE s_nationkey <= 5 OR s_nationkey = 10
    UNION ALL SELECT -1 - s_suppkey, 'removed' FROM supplier WHERE s_nationkey = 11
    """
)
def changed_rows(t):
    extra = t.supplier.where(F.col("s_nationkey") == 11).withColumn("s_suppkey", -1 - F.col("s_suppkey"))
    remote = (
        t.supplier.where(F.col("s_nationkey") != 10)
        .withColumn("s_acctbal", F.when(F.col("s_nationkey") > 5, F.col("s_acctbal")))
        .unionByName(extra)
    )
    return manifests.changed_rows(t.supplier, remote, "s_suppkey", ["s_name", "s_acctbal"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def inclusion_join(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return manifests.inclusion_join(rows, t.part.where("p_size > 40"), "l_partkey", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def exclusion_join(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return manifests.exclusion_join(rows, t.part.where("p_size > 10"), "l_partkey", "p_partkey")


@query(
    """
    SELECT c_custkey, c_name, c_mktsegment AS curation FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT c_custkey, c_name, NULL FROM customer WHERE c_mktsegment <> 'BUILDING'
    """
)
def curation_update(t):
    existing = t.customer.where("c_mktsegment = 'BUILDING'").select(
        "c_custkey", "c_name", F.col("c_mktsegment").alias("curation")
    )
    new = t.customer.select("c_custkey", "c_name")
    return manifests.curation_update(existing, new, "c_custkey")


@query(
    """
    SELECT count(*) FILTER (o_orderstatus = 'P') AS "n_P", count(*) FILTER (o_orderstatus = 'F') AS "n_F",
           count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) AS n_total FROM orders
    """
)
def status_summary(t):
    return manifests.status_summary(t.orders, "o_orderstatus", _STATUS)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def last_per_key(t):
    return manifests.last_per_key(
        t.orders, "o_custkey", "o_orderkey", [F.col("o_orderdate"), F.col("o_orderkey")], "last_order"
    )


@query("SELECT l_orderkey || '-' || l_linenumber AS target, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_targets(t):
    rows = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("target"))
    return manifests.duplicate_targets(rows, "target")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_difference(t):
    return manifests.id_difference(t.documents, t.labels, "doc_id")


@query("SELECT DISTINCT string_split(url, '/')[-1] AS name FROM pages")
def distinct_names(t):
    return manifests.distinct_names(t.pages, "url")


@query(
    """
    SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS duplicated
    FROM lineitem
    """
)
def duplicate_flag(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber")
    return manifests.duplicate_flag(rows, ["l_orderkey", "l_linenumber"], "duplicated")


@query("SELECT count(*) > 0 AS found FROM pages WHERE url LIKE 'https://blog.%'")
def folder_exists(t):
    return listing.folder_exists(t.pages.select(F.col("url").alias("path")), "https://blog.")


@query("SELECT o_custkey AS source, arg_max('order/' || o_orderkey, (o_orderdate, 'order/' || o_orderkey)) AS path FROM orders GROUP BY 1")
def select_latest(t):
    files = t.orders.select(
        "o_custkey", F.concat(F.lit("order/"), F.col("o_orderkey")).alias("path"),
        F.col("o_orderdate").alias("modificationTime"),
    )
    return listing.select_latest(files, F.col("o_custkey")).drop("modificationTime")


@query(
    """
    SELECT url AS path, 'with' AS part FROM pages WHERE contains(url, 'utm_source')
    UNION ALL SELECT url, 'without' FROM pages WHERE NOT contains(url, 'utm_source')
    """
)
def filter_listing(t):
    files = t.pages.select(F.col("url").alias("path"))
    return listing.filter_listing(files, "utm_source").withColumn("part", F.lit("with")).unionByName(
        listing.filter_listing(files, "!utm_source").withColumn("part", F.lit("without"))
    )


_VALIDATED = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',',
      CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) THEN 'UNRESOLVED_TARGET' END,
      CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 'UNRESOLVED_DISEASE' END,
      CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'UNKNOWN_STUDY_TYPE' END,
      CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN 'DUPLICATED_STUDY' END,
      CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') THEN 'UNKNOWN_BIOSAMPLE' END
    ) AS reasons FROM lineitem"""


def validated_studies(t):
    return validation.validate_study(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"),
        t.part.where("p_size <= 40"),
        t.supplier.where("s_acctbal > 0"),
        t.orders.where("o_orderstatus <> 'P'"),
        study=["l_orderkey", "l_linenumber"],
        gene=("l_partkey", "p_partkey"),
        disease=("l_suppkey", "s_suppkey"),
        biosample=("l_orderkey", "o_orderkey"),
        study_type="l_returnflag",
        known_types=["A", "N"],
    )


@query(_VALIDATED)
def validate_study(t):
    return validated_studies(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", joined("qualityControls").alias("reasons")
    )


@query(
    f"""
    SELECT reasons = '' AS valid, reasons, count(*) AS n, sum(l_partkey)::BIGINT AS keys FROM ({_VALIDATED}) GROUP BY 1, 2
    """
)
def split_valid(t):
    good, bad = validation.split_valid(validated_studies(t), validation.STUDY_REASONS)
    rows = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return rows.groupBy("valid", joined("qualityControls").alias("reasons")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("keys")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, concat_ws(',',
      CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) THEN 'MISSING_STUDY' END,
      CASE WHEN l_shipdate IS NULL THEN 'NO_GENOMIC_LOCATION_FLAG' END,
      CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'PALINDROMIC_ALLELE_FLAG' END,
      CASE WHEN l_discount < 0.03 THEN 'SUBSIGNIFICANT_FLAG' END,
      CASE WHEN l_partkey BETWEEN 500 AND 700 THEN 'IN_MHC' END) AS reasons
    FROM lineitem
    """
)
def qc_flags(t):
    rows = validation.resolve(t.lineitem, t.part.where("p_size <= 40"), "l_partkey", "p_partkey", "missing")
    return validation.qc_flags(
        rows,
        {
            "MISSING_STUDY": F.col("missing"),
            "NO_GENOMIC_LOCATION_FLAG": F.col("l_shipdate").isNull(),
            "PALINDROMIC_ALLELE_FLAG": (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"),
            "SUBSIGNIFICANT_FLAG": F.col("l_discount") < 0.03,
            "IN_MHC": F.col("l_partkey").between(500, 700),
        },
    ).select("l_orderkey", "l_linenumber", joined("qualityControls").alias("reasons"))


@query(
    """
    SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS valid
    FROM orders
    """
)
def target_validation(t):
    good, bad = validation.target_validation(
        t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey"
    )
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@query(
    """
    SELECT o_orderkey, c_name, c_custkey IS NOT NULL AS drug_known
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey
    """
)
def pgx_join(t):
    return validation.pgx_join(
        t.orders.select("o_orderkey", "o_custkey"),
        t.customer.where("c_mktsegment = 'BUILDING'"),
        "o_custkey",
        "c_custkey",
        ["c_name"],
    ).drop("o_custkey")


@query(
    """
    SELECT criteria, included, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (
      SELECT 'curation' AS criteria, o_orderpriority = '1-URGENT' AS included, o_orderkey FROM orders
      UNION ALL SELECT 'summary_stats', o_totalprice > 250000, o_orderkey FROM orders) GROUP BY 1, 2
    """
)
def study_inclusion(t):
    frames = []
    for criteria in ("curation", "summary_stats"):
        pair = validation.study_inclusion(
            t.orders, criteria, F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 250000
        )
        for included, df in zip((True, False), pair):
            frames.append(
                df.select(F.lit(criteria).alias("criteria"), F.lit(included).alias("included"), "o_orderkey")
            )
    rows = frames[0]
    for df in frames[1:]:
        rows = rows.unionByName(df)
    return rows.groupBy("criteria", "included").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")
    )
