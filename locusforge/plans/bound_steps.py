"""Release steps on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusforge.functions.stats import erfc_sql
from locusforge.operators import graph
from locusforge.plans import bound_evidence as e
from locusforge.plans import bound_genetics as g
from locusforge.plans import steps
from locusforge.plans.registry import joined, query


@query(
    """
    SELECT 'GCST' || doc_id AS "studyId", 'raw/GCST' || doc_id || '/v2.tsv.gz' AS "rawPath",
           'staging/GCST' || doc_id || '/manifest.json' AS "manifestPath", 'pending' AS status
    FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    """
)
def manifest_run(t):
    versions = F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("v")
    files = t.documents.select("doc_id", versions).select(
        F.concat(F.lit("raw/GCST"), "doc_id", F.lit("/"), "v", F.lit(".tsv.gz")).alias("path")
    )
    known = t.labels.select(F.concat(F.lit("staging/GCST"), "doc_id", F.lit("/manifest.json")).alias("path"))
    rows = steps.manifest_run(files, known, "staging")
    return rows.select("studyId", "rawPath", "manifestPath", "status")


@query(
    """
    SELECT 'loci/studyLocusId=' || k AS study_locus_input, 'susie/' || k AS study_locus_output, 'logs/' || k AS log_output,
           rn // 4000 AS chunk, rn % 4000 AS locus_index
    FROM (SELECT o_orderkey::VARCHAR AS k, row_number() OVER (ORDER BY 'loci/studyLocusId=' || o_orderkey) - 1 AS rn FROM orders)
    """
)
def finemapping_manifests(t):
    files = t.orders.select("o_orderkey", F.explode(F.array(F.lit("part-0"), F.lit("part-1"))).alias("p")).select(
        F.concat(F.lit("collected/studyLocusId="), "o_orderkey", F.lit("/"), "p", F.lit(".parquet")).alias("path")
    )
    return steps.finemapping_manifests(files, "loci", "susie", "logs", 4000)


@query(
    """
    WITH v AS (SELECT DISTINCT l_partkey || '_' || l_returnflag AS id, l_partkey * 100 AS pos, l_returnflag AS chrom FROM lineitem),
    g AS (SELECT s_nationkey AS gene, s_suppkey * 2000 AS site, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom,
                 s_acctbal > 5000 AS curated, s_acctbal > 0 AS canonical FROM supplier),
    n AS (SELECT id, gene, abs(pos - site) AS distance, row_number() OVER (PARTITION BY id, gene
            ORDER BY curated DESC, canonical DESC, abs(pos - site), site) AS rn
          FROM v JOIN g ON v.chrom = g.chrom AND abs(pos - site) <= 5000),
    p AS (SELECT id, string_agg(gene || ':' || distance, ',' ORDER BY gene, distance) AS genes FROM n WHERE rn = 1 GROUP BY id)
    SELECT v.id, genes FROM v LEFT JOIN p ON p.id = v.id
    """
)
def annotate_variants(t):
    rows = t.lineitem.select(
        F.concat_ws("_", "l_partkey", "l_returnflag").alias("id"), (F.col("l_partkey") * 100).alias("pos"),
        F.col("l_returnflag").alias("chrom"),
    ).distinct()
    code = F.col("s_suppkey") % 3
    genes = t.supplier.select(
        F.col("s_nationkey").alias("gene"), (F.col("s_suppkey") * 2000).alias("site"),
        F.when(code == 0, "A").when(code == 1, "N").otherwise("R").alias("chrom"),
        (F.col("s_acctbal") > 5000).alias("curated"), (F.col("s_acctbal") > 0).alias("canonical"),
    )
    found = steps.annotate_variants(
        rows, genes, variant="id", by=["chrom"], position="pos", gene="gene", site="site", curated="curated",
        canonical="canonical", distance=5000,
    )
    texts = F.transform("genes", lambda x: F.concat_ws(":", x["gene"], x["distance"]))
    return found.select("id", F.array_join(texts, ",").alias("genes"))


_STATS = """
    SELECT l_suppkey AS study, l_partkey AS event_id, l_partkey * 10 AS pos, max(l_extendedprice) / 10000 AS value FROM lineitem GROUP BY ALL"""


@query(
    f"""
    WITH RECURSIVE picked AS ({g._greedy_sql(_STATS, "study", 8, 300)}),
    d AS ({g._LD}),
    kept AS (SELECT * FROM picked a WHERE NOT EXISTS (
      SELECT 1 FROM d JOIN picked b ON b.lead_id = d.variant WHERE d.tag = a.lead_id AND b.study = a.study AND d.r * d.r >= 0.5
        AND (b.lead_strength > a.lead_strength OR (b.lead_strength = a.lead_strength AND b.lead_id < a.lead_id)))),
    tags AS (SELECT study, lead_id, tag, max(r * r) AS r2, any_value(lead_strength) AS m FROM kept
             JOIN d ON d.variant = lead_id WHERE r * r >= 0.5 GROUP BY study, lead_id, tag),
    z AS (SELECT *, sqrt(1 - pow(sqrt(r2), 6.4)) * sqrt(m) / 2 AS sd FROM tags),
    x AS (SELECT *, (m - r2 * m) / sd / sqrt(2.0) AS x FROM z),
    w AS (SELECT *, CASE WHEN sd > 0 THEN {erfc_sql("x")} ELSE 1 END AS w FROM x),
    p AS (SELECT study, lead_id, tag, w / sum(w) OVER (PARTITION BY study, lead_id) AS pip FROM w),
    c AS (SELECT *, sum(pip) OVER (PARTITION BY study, lead_id ORDER BY pip DESC, tag ROWS UNBOUNDED PRECEDING) AS cum FROM p)
    SELECT study, lead_id, tag, round(pip, 5) AS pip FROM c WHERE round(cum - pip, 9) < 0.95
    """
)
def summary_statistics_to_credible_sets(t):
    stats = t.lineitem.groupBy(F.col("l_suppkey").alias("study"), F.col("l_partkey").alias("variant")).agg(
        (F.max("l_extendedprice") / 10000).alias("strength")
    )
    sets = steps.summary_statistics_to_credible_sets(
        stats.withColumn("pos", F.col("variant") * 10), g.ld_pairs(t).drop("population"), study="study",
        variant="variant", position="pos", strength="strength", threshold=8, distance=300, mass=0.95,
    )
    return sets.select("study", "lead_id", "tag", F.round("pip", 5).alias("pip"))


@query(
    g.QUERY_SPLIT_LARGE.replace("SELECT study, \"start\", \"end\", lead_id, lead_pos, lead_strength FROM loci", "SELECT * FROM (SELECT study, \"start\", \"end\", lead_id, lead_pos, lead_strength FROM loci")
    + ") WHERE lead_pos NOT BETWEEN 1704900000 AND 1705500000"
)
def locus_breaker_step(t):
    return steps.locus_breaker_step(
        g.signals(t), ["study"], position="pos", strength="value", tie="event_id", baseline=20, threshold=100,
        gap=40_000, flank=5_000, large=100_000, distance=30_000, excluded=(1704900000, 1705500000),
    )


@query(
    f"""{g.COLOC_SQL}
    SELECT left_locus, right_locus, n_shared, method, CASE WHEN method = 'eCAVIAR' THEN clpp END AS clpp,
           CASE WHEN method = 'COLOC' THEN h0 END AS h0, CASE WHEN method = 'COLOC' THEN h1 END AS h1,
           CASE WHEN method = 'COLOC' THEN h2 END AS h2, CASE WHEN method = 'COLOC' THEN h3 END AS h3,
           CASE WHEN method = 'COLOC' THEN h4 END AS h4
    FROM coloc, (VALUES ('eCAVIAR'), ('COLOC')) m(method)
    """
)
def colocalisation(t):
    rows = steps.colocalisation(g.overlaps(t), g.credible_rows(t), locus="locus", log_bf="log_bf")
    return rows.withColumns({"clpp": F.round("clpp", 8), **{f"h{i}": F.round(f"h{i}", 6) for i in range(5)}})


_SETS = """
    SELECT l_orderkey, l_linenumber, l_orderkey || ':' || l_linenumber AS locus, l_suppkey AS study, l_partkey AS variant,
           CASE WHEN l_quantity < 50 THEN l_returnflag END AS chrom, l_partkey * 10 AS pos, l_partkey * 10 - 2 AS s,
           l_partkey * 10 + 2 AS e, substr('ACGT', (l_linenumber % 4 + 1)::INTEGER, 1) AS ref,
           substr('ACGT', (l_orderkey % 4 + 1)::INTEGER, 1) AS alt, l_extendedprice / 10000 AS value, l_tax,
           CASE WHEN l_discount < 0.03 THEN 'SuSiE' WHEN l_discount < 0.06 THEN 'PICS' ELSE 'PICS top hit' END AS method
    FROM lineitem"""
_SETS_PLACED = f"""
    SELECT study || chrom AS k, study, chrom, variant AS event_id, pos, value FROM ({_SETS}) WHERE chrom IS NOT NULL"""


@query(
    f"""
    WITH RECURSIVE picked AS ({g._greedy_sql(_SETS_PLACED, "k", 2, 100)}),
    rows AS ({_SETS}),
    leads AS (SELECT study, variant, max(value) AS value FROM rows GROUP BY study, variant),
    d AS (SELECT * FROM ({g._LD}) WHERE r * r >= 0.5),
    clumped AS (SELECT DISTINCT a.study, a.variant FROM leads a JOIN d ON d.tag = a.variant
                JOIN leads b ON b.variant = d.variant AND b.study = a.study
                WHERE b.value > a.value OR (b.value = a.value AND b.variant < a.variant)),
    studies AS (SELECT s_suppkey AS study, count(*) > 1 AS ambiguous, bool_or(s_acctbal < 1000) AS failed FROM (
                  SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_nationkey < 4) WHERE s_suppkey % 7 <> 0 GROUP BY 1),
    known AS (SELECT p_partkey, substr('ACGT', (p_size % 4 + 1)::INTEGER, 1) AS kref,
                     substr('ACGT', (p_partkey % 4 + 1)::INTEGER, 1) AS kalt FROM part WHERE p_size < 45),
    f AS (SELECT rows.*, concat_ws(',',
        CASE WHEN count(*) OVER (PARTITION BY locus) > 1 THEN 'DUPLICATED_STUDYLOCUS_ID' END,
        CASE WHEN ambiguous THEN 'AMBIGUOUS_STUDY' END,
        CASE WHEN failed THEN 'FAILED_STUDY' END,
        CASE WHEN studies.study IS NULL THEN 'MISSING_STUDY' END,
        CASE WHEN chrom IS NULL THEN 'NO_GENOMIC_LOCATION_FLAG' END,
        CASE WHEN l_tax >= 0.07 THEN 'COMPOSITE_FLAG' END,
        CASE WHEN ref <> kref OR alt <> kalt THEN 'INCONSISTENCY_FLAG' END,
        CASE WHEN ref || alt IN ('AT', 'TA', 'CG', 'GC') THEN 'PALINDROMIC_ALLELE_FLAG' END,
        CASE WHEN value < 2 THEN 'SUBSIGNIFICANT_FLAG' END,
        CASE WHEN clumped.study IS NOT NULL THEN 'LD_CLUMPED' END,
        CASE WHEN chrom = 'N' AND pos BETWEEN 5000 AND 9000 THEN 'IN_MHC' END,
        CASE WHEN method = 'PICS top hit' AND EXISTS (SELECT 1 FROM rows o WHERE o.study = rows.study AND o.method = 'PICS'
             AND o.s <= rows.e AND rows.s <= o.e) THEN 'REDUNDANT_PICS_TOP_HIT' END,
        CASE WHEN method <> 'SuSiE' AND EXISTS (SELECT 1 FROM rows o WHERE o.study = rows.study AND o.method = 'SuSiE'
             AND o.s <= rows.e AND rows.s <= o.e) THEN 'EXPLAINED_BY_SUSIE' END,
        CASE WHEN chrom IS NOT NULL AND value >= 2 AND NOT EXISTS (
             SELECT 1 FROM picked WHERE picked.k = rows.study || chrom AND lead_id = rows.variant) THEN 'WINDOW_CLUMPED' END,
        CASE WHEN p_partkey IS NULL THEN 'NON_MAPPED_VARIANT_FLAG' END) AS reasons
      FROM rows LEFT JOIN studies ON studies.study = rows.study LEFT JOIN known ON p_partkey = rows.variant
      LEFT JOIN clumped ON clumped.study = rows.study AND clumped.variant = rows.variant)
    SELECT l_orderkey, l_linenumber, variant, reasons = '' AS valid, reasons FROM f
    """
)
def credible_set_validation(t):
    def base(number):
        return F.substring(F.lit("ACGT"), (number % 4 + 1).cast("int"), F.lit(1))

    cut = F.when(F.col("l_discount") < 0.03, "SuSiE").when(F.col("l_discount") < 0.06, "PICS").otherwise("PICS top hit")
    place = F.col("l_partkey") * 10
    sets = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("locus"),
        F.col("l_suppkey").alias("study"), F.col("l_partkey").alias("variant"),
        F.when(F.col("l_quantity") < 50, F.col("l_returnflag")).alias("chrom"), place.alias("pos"),
        (place - 2).alias("s"), (place + 2).alias("e"), base(F.col("l_linenumber")).alias("ref"),
        base(F.col("l_orderkey")).alias("alt"), (F.col("l_extendedprice") / 10000).alias("value"), "l_tax",
        cut.alias("method"),
    )
    studies = t.supplier.unionByName(t.supplier.where("s_nationkey < 4")).where("s_suppkey % 7 <> 0")
    known = t.part.where("p_size < 45").select(
        F.col("p_partkey").alias("variant"), base(F.col("p_size")).alias("ref"), base(F.col("p_partkey")).alias("alt")
    )
    good, bad = steps.credible_set_validation(
        sets, studies.withColumnRenamed("s_suppkey", "study"), known, g.ld_pairs(t).drop("population"), locus="locus",
        study="study", variant="variant", chromosome="chrom", position="pos", start="s", end="e", ref="ref", alt="alt",
        strength="value", method="method", composite=F.col("l_tax") >= 0.07, failed=F.col("s_acctbal") < 1000,
        threshold=2, mhc=("N", 5000, 9000), width=100, distance=100,
    )
    rows = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return rows.select("l_orderkey", "l_linenumber", "variant", "valid", F.array_join("qualityControls", ",").alias("reasons"))


@query(
    f"""
    WITH v AS (SELECT p_partkey AS idx, concat_ws('_', p_partkey * 10 + c.shift, 'A', 'G') AS id FROM part
               JOIN (SELECT s_suppkey * 100 AS s, s_suppkey * 100 + 79 AS e, s_nationkey * 1000000 AS shift FROM supplier) c
               ON p_partkey * 10 BETWEEN c.s AND c.e),
    p AS (SELECT a.id AS a, b.id AS b, r, population FROM ({g._ENTRIES}) x JOIN v a ON a.idx = x.i JOIN v b ON b.idx = x.j
          WHERE x.i <> x.j AND r * r >= 0.25),
    u AS (SELECT a AS variant, b AS tag, r, population FROM p UNION ALL SELECT b, a, r, population FROM p)
    SELECT variant, population, count(*) AS n, string_agg(tag, ',' ORDER BY tag, r) AS tags FROM u GROUP BY variant, population
    """
)
def ld_index(t):
    known = t.part.select(
        "p_partkey", (F.col("p_partkey") * 10).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt")
    )
    chain = t.supplier.select(
        (F.col("s_suppkey") * 100).alias("s"), (F.col("s_suppkey") * 100 + 79).alias("e"),
        (F.col("s_nationkey") * 1000000).cast("bigint").alias("shift"),
    )
    rows = steps.ld_index(
        g.ld_entries(t), known, chain, row="i", column="j", r="r", population="population", index="p_partkey", by=[],
        position="pos", ref="ref", alt="alt", start="s", end="e", offset="shift", width=500, min_r2=0.25,
    )
    tags = F.transform("ldSet", lambda x: x["tag"])
    return rows.select(
        "variant", "population", F.size("ldSet").cast("bigint").alias("n"), F.array_join(tags, ",").alias("tags")
    )


@query(
    """
    SELECT o_orderkey, lines FROM orders LEFT JOIN (
      SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines
      FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """
)
def catalog_study_index(t):
    studies = t.orders.select("o_orderkey", "o_custkey")
    included = t.orders.join(
        t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi"
    ).select("o_orderkey")
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    rows = steps.catalog_study_index(studies, lines, included, "o_orderkey", F.struct("l_linenumber", "l_partkey"))
    texts = F.transform("ancestries", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    return rows.select("o_orderkey", F.array_join(texts, ",").alias("lines"))


@query(
    """
    SELECT l_orderkey, l_linenumber, p_name, concat_ws(',', CASE WHEN p_partkey IS NULL THEN 'NON_MAPPED_VARIANT_FLAG' END,
           CASE WHEN l_discount < 0.05 THEN 'SUBSIGNIFICANT_FLAG' END) AS reasons
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 30) ON p_partkey = l_partkey
    """
)
def catalog_top_hits(t):
    rows = steps.catalog_top_hits(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"), t.part.where("p_size < 30"),
        {"l_partkey": "p_partkey"}, ["p_name"], "l_discount", 0.05,
    )
    return rows.select("l_orderkey", "l_linenumber", "p_name", joined("qualityControls").alias("reasons"))


@query(
    """
    SELECT 'Q' || l_suppkey AS "studyId", 'SuSie' AS "finemappingMethod", l_suppkey, l_orderkey, l_linenumber, lead FROM lineitem
    JOIN (SELECT s_suppkey, s_acctbal / 1000 AS lead FROM supplier WHERE s_acctbal / 1000 >= 3.0
          AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)) ON s_suppkey = l_suppkey
    """
)
def molecular_credible_sets(t):
    summary = t.supplier.select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", (F.col("s_acctbal") / 1000).alias("lead")
    )
    return steps.molecular_credible_sets(
        t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber"), summary, t.nation.where("n_regionkey = 2"),
        on=["l_suppkey"], study=F.concat(F.lit("Q"), "l_suppkey"), method="s_nationkey", listed="n_nationkey",
        lead_strength="lead", threshold=3.0,
    )


_RELEASE = """
    SELECT *, concat_ws(',', CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'UNRESOLVED_TARGET' END,
           CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'UNRESOLVED_DISEASE' END) AS reasons
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"""


@query(
    f"""
    SELECT m AS mode, lang AS "datasourceId", reasons = '' AS valid, reasons, count(*) AS n, sum(doc_id)::BIGINT AS ids
    FROM ({_RELEASE}) JOIN (VALUES ('partner'), ('public')) v(m)
      ON (m = 'partner' AND lang IN ('en', 'fr', 'es', 'de')) OR (m = 'public' AND lang IN ('en', 'fr'))
    GROUP BY ALL
    """
)
def evidence_release(t):
    docs = t.documents.select("doc_id", "lang", "source", "text")
    by_lang = {lang: docs.where(F.col("lang") == lang) for lang in ("en", "fr", "es", "de")}
    known = t.documents.where(F.col("source").isin("src0", "src1", "src2", "src3")).select("source")
    frames = []
    for mode in ("partner", "public"):
        pair = steps.evidence_release(
            {k: by_lang[k] for k in ("en", "fr", "de")}, {"es": by_lang["es"]}, partner=mode == "partner",
            excluded=["de"], id_columns=["lang", "text"], order=[F.col("doc_id")], targets=t.labels, target="doc_id",
            diseases=known, disease="source",
        )
        for valid, rows in zip((True, False), pair):
            frames.append(rows.withColumn("mode", F.lit(mode)).withColumn("valid", F.lit(valid)))
    rows = frames[0]
    for df in frames[1:]:
        rows = rows.unionByName(df)
    return rows.groupBy("mode", "datasourceId", "valid", joined("qualityControls").alias("reasons")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")
    )


@query(
    f"""
    SELECT 'direct' AS kind, * FROM ({e._association_sql(e._DIRECT)}) UNION ALL
    SELECT 'indirect', * FROM ({e._association_sql(e._INDIRECT)})
    """
)
def associations(t):
    closure = graph.hierarchy_closure(g.world_edges(t), "child", "parent")
    rows = steps.associations(
        e.scored(t), closure, target="target", disease="disease", source="source", score="score",
    )
    return rows.withColumn("score", F.round("score", 6))
