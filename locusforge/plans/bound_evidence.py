"""Drug-target tables, locus-to-gene and fine-mapping on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusforge.operators import annotate, evidence, finemap, graph, l2g
from locusforge.plans.bound_genetics import world_edges
from locusforge.plans.registry import joined, query
from locusforge.session import cut_lineage

_ANCESTORS = """
    SELECT n_nationkey AS nation, 'N' || n_nationkey AS disease FROM nation
    UNION ALL SELECT n_nationkey, 'R' || n_regionkey FROM nation
    UNION ALL SELECT n_nationkey, 'ROOT' FROM nation"""
_SALES = """
    SELECT l.*, c_nationkey, c_custkey, o_orderdate FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey"""


def sales(t):
    """Line items with the nation of their customer."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.customer, F.col("o_custkey") == F.col("c_custkey")
    )


def scored(t):
    """Evidence rows: target, disease, source, score."""
    return sales(t).select(
        F.col("l_suppkey").alias("target"),
        F.concat(F.lit("N"), "c_nationkey").alias("disease"),
        F.col("l_returnflag").alias("source"),
        (F.col("l_discount") * 10).alias("score"),
        "l_orderkey",
        "l_linenumber",
    )


def _association_sql(rows: str) -> str:
    return f"""
    WITH top AS (SELECT sum(1.0::DOUBLE / (i * i)) AS m FROM range(1, 51) r(i)),
    ev AS ({rows}),
    r AS (SELECT *, row_number() OVER (PARTITION BY target, disease, source ORDER BY score DESC) AS rk FROM ev),
    s AS (SELECT target, disease, source, sum(score / (rk * rk)) / (SELECT m FROM top) AS ss,
                 count(*) AS n FROM r GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY target, disease ORDER BY ss DESC, source) AS pl FROM s)
    SELECT target, disease, round(sum(ss / (pl * pl)) / (SELECT m FROM top), 6) AS score, sum(n)::BIGINT AS n_evidence,
           count(*) AS n_sources FROM p GROUP BY target, disease"""


_DIRECT = f"SELECT l_suppkey AS target, 'N' || c_nationkey AS disease, l_returnflag AS source, l_discount * 10 AS score FROM ({_SALES})"
_INDIRECT = f"""
    SELECT l_suppkey AS target, a.disease, l_returnflag AS source, l_discount * 10 AS score
    FROM ({_SALES}) s JOIN ({_ANCESTORS}) a ON a.nation = s.c_nationkey"""


@query(_association_sql(_DIRECT))
def harmonic_association(t):
    rows = evidence.harmonic_association(scored(t), ["target", "disease"], "source", "score")
    return rows.withColumn("score", F.round("score", 6))


@query(_association_sql(_INDIRECT))
def harmonic_association_indirect(t):
    closure = graph.hierarchy_closure(world_edges(t), "child", "parent")
    rows = evidence.harmonic_association(
        evidence.propagate(scored(t), closure, "disease"), ["target", "disease"], "source", "score"
    )
    return rows.withColumn("score", F.round("score", 6))


_EXPRESSION = """
    SELECT user_id, event_type, mean_value, n, z, CASE WHEN z < -3 THEN 0 WHEN z >= 3 THEN 11
           ELSE floor((z + 3) / 0.6)::BIGINT + 1 END AS bin FROM (
      SELECT *, (mean_value - avg(mean_value) OVER w) / stddev_samp(mean_value) OVER w AS z FROM (
        SELECT user_id, event_type, avg(value) AS mean_value, count(*) AS n FROM events GROUP BY ALL)
      WINDOW w AS (PARTITION BY event_type))"""


@query(f"SELECT user_id, event_type, round(mean_value, 6) AS mean_value, n, round(z, 6) AS zscore, bin::BIGINT AS bin FROM ({_EXPRESSION})")
def expression_summary(t):
    rows = evidence.expression_summary(t.events, "user_id", "event_type", "value")
    return rows.select(
        "user_id", "event_type", F.round("mean_value", 6).alias("mean_value"), "n", F.round("zscore", 6).alias("zscore"), "bin"
    )


@query(f"SELECT user_id, 0::INTEGER AS part, string_agg(event_type || ':' || bin, ',' ORDER BY event_type) AS tissues FROM ({_EXPRESSION}) GROUP BY user_id")
def expression_by_gene(t):
    summary = evidence.expression_summary(t.events, "user_id", "event_type", "value")
    rows = evidence.expression_by_gene(summary, "user_id", "event_type")
    texts = F.transform("tissues", lambda x: F.concat_ws(":", x["event_type"], x["bin"]))
    return rows.select("user_id", "part", F.array_join(texts, ",").alias("tissues"))


@query(
    """
    SELECT "geneA", "geneB", count(*) AS n_evidence, count(DISTINCT s) AS n_sources, round(max(score), 8) AS max_score FROM (
      SELECT least(l_partkey, l_suppkey) AS "geneA", greatest(l_partkey, l_suppkey) AS "geneB", l_discount AS score, 'intact' AS s
      FROM lineitem WHERE l_returnflag = 'A'
      UNION ALL SELECT least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey), l_tax, 'string' FROM lineitem WHERE l_returnflag <> 'A'
      UNION ALL SELECT least(floor(o_totalprice / 250)::BIGINT, o_custkey), greatest(floor(o_totalprice / 250)::BIGINT, o_custkey), o_totalprice / 1000000, 'reactome' FROM orders)
    GROUP BY 1, 2
    """
)
def interaction_edges(t):
    items = t.lineitem
    rows = evidence.interaction_edges(
        {
            "intact": items.where("l_returnflag = 'A'").select(
                F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_discount").alias("score")
            ),
            "string": items.where("l_returnflag <> 'A'").select(
                F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_tax").alias("score")
            ),
            "reactome": t.orders.select(
                F.floor(F.col("o_totalprice") / 250).cast("bigint").alias("a"), F.col("o_custkey").alias("b"),
                (F.col("o_totalprice") / 1000000).alias("score"),
            ),
        },
        "a",
        "b",
        "score",
    )
    return rows.withColumn("max_score", F.round("max_score", 8))


@query(
    """
    WITH c AS (SELECT l_suppkey AS drug, l_returnflag || l_linestatus AS event, count(DISTINCT l_orderkey) AS n_ij
               FROM lineitem GROUP BY ALL),
    m AS (SELECT *, sum(n_ij) OVER (PARTITION BY event)::BIGINT AS n_i, sum(n_ij) OVER (PARTITION BY drug)::BIGINT AS n_j,
                 sum(n_ij) OVER ()::BIGINT AS n_total FROM c),
    e AS (SELECT *, n_i::DOUBLE * n_j::DOUBLE / n_total::DOUBLE AS ex FROM m)
    SELECT drug, event, n_ij, n_i, n_j, n_total, round(CASE WHEN n_ij > ex THEN n_ij * ln(n_ij / ex) +
      CASE WHEN n_j > n_ij THEN (n_j - n_ij) * ln((n_j - n_ij) / (n_j - ex)) ELSE 0 END ELSE 0 END, 6) AS llr FROM e
    """
)
def adverse_event_llr(t):
    reports = t.lineitem.select(
        "l_orderkey", F.col("l_suppkey").alias("drug"), F.concat("l_returnflag", "l_linestatus").alias("event")
    )
    rows = evidence.adverse_event_llr(reports, "l_orderkey", "drug", "event")
    return rows.withColumn("llr", F.round("llr", 6))


@query(
    r"""
    SELECT "datasourceId", id, n_chars, resolved FROM (
      SELECT 'src_' || lang AS "datasourceId", sha256(concat_ws(chr(31), lang, text)) AS id, n_chars,
             doc_id IN (SELECT doc_id FROM labels) AS resolved,
             row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS rn
      FROM documents)
    WHERE rn = 1
    """
)
def evidence_union(t):
    docs = t.documents.select("doc_id", "lang", "text", "n_chars")
    rows = evidence.evidence_union(
        {f"src_{lang}": docs.where(F.col("lang") == lang) for lang in ("en", "fr", "es", "de")},
        ["lang", "text"],
        [F.col("doc_id")],
    )
    known = t.labels.select("doc_id", F.lit(True).alias("resolved"))
    return rows.join(known, "doc_id", "left").select(
        "datasourceId", "id", "n_chars", F.coalesce("resolved", F.lit(False)).alias("resolved")
    )


@query(
    """
    SELECT p_partkey, p_name, 0::INTEGER AS part, string_agg(k, ',' ORDER BY k) AS keywords FROM part JOIN (
      SELECT p_partkey AS key, p_brand AS k FROM part UNION SELECT p_partkey, p_type FROM part
      UNION SELECT l_partkey, l_returnflag FROM lineitem) ON key = p_partkey GROUP BY p_partkey, p_name
    """
)
def search_documents(t):
    rows = evidence.search_documents(
        t.part.select("p_partkey", "p_name"),
        "p_partkey",
        [
            t.part.select("p_partkey", F.col("p_brand").alias("k")),
            t.part.select("p_partkey", F.col("p_type").alias("k")),
            t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("k")),
        ],
        "k",
    )
    return rows.withColumn("keywords", F.array_join("keywords", ","))


@query(
    """
    SELECT 'lang' AS facet, lang AS value, count(DISTINCT doc_id) AS n_entities FROM documents GROUP BY lang
    UNION ALL SELECT 'source', source, count(DISTINCT doc_id) FROM documents GROUP BY source
    """
)
def facet_documents(t):
    return evidence.facet_documents(t.documents, ["lang", "source"], "doc_id")


@query(
    """
    SELECT l_suppkey, c_nationkey, n, s_name, n_name FROM (
      SELECT l_suppkey, c_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey
    """
)
def ebi_documents(t):
    associations = sales(t).groupBy("l_suppkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return evidence.ebi_documents(
        associations,
        t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"),
        t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"),
        target="l_suppkey",
        disease="c_nationkey",
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS score,
           l_returnflag || '/' || l_linestatus AS facet FROM lineitem
    """
)
def association_facts(t):
    rows = evidence.association_facts(
        t.lineitem,
        ["l_orderkey", "l_linenumber", "l_suppkey"],
        {
            "score": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "facet": F.concat_ws("/", "l_returnflag", "l_linestatus"),
        },
    )
    return rows.withColumn("score", F.round("score", 4))


@query(
    """
    WITH roots AS (SELECT c_custkey, CASE WHEN c_custkey >= 25 THEN c_nationkey ELSE c_custkey END AS root FROM customer),
    o AS (SELECT root, count(*) AS n, max(o_orderkey) AS last, min(o_orderkey) AS first, sum(o_orderkey)::BIGINT AS keys
          FROM orders JOIN roots ON o_custkey = c_custkey GROUP BY root),
    m AS (SELECT root, count(*) AS n, string_agg(c_custkey, ',' ORDER BY c_custkey) AS members FROM roots GROUP BY root)
    SELECT c_custkey, c_name, o.n AS n_orders, first AS first_order, last AS last_order, keys AS order_keys, m.members
    FROM customer JOIN m ON m.root = c_custkey LEFT JOIN o ON o.root = c_custkey WHERE c_custkey < 25
    """
)
def drug_table(t):
    molecules = t.customer.select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") >= 25, F.col("c_nationkey").cast("bigint")).alias("parent")
    )
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    rows = evidence.drug_table(
        molecules,
        "c_custkey",
        {
            "orders": (orders, F.col("o_orderkey")),
            "members": (t.customer.select("c_custkey", F.col("c_custkey").alias("m")), F.col("m")),
        },
        parent="parent",
    )
    return rows.select(
        "c_custkey", "c_name", F.size("orders").cast("bigint").alias("n_orders"), F.array_min("orders").alias("first_order"),
        F.array_max("orders").alias("last_order"),
        F.aggregate("orders", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("order_keys"),
        joined("members").alias("members"),
    )


@query(
    f"""
    SELECT l_partkey, l_suppkey, c_nationkey, max(l_linenumber) AS max_phase, count(*) AS n_evidence, any_value(p_name) AS p_name,
           any_value(s_name) AS s_name, any_value(n_name) AS n_name
    FROM ({_SALES}) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = c_nationkey
    GROUP BY l_partkey, l_suppkey, c_nationkey
    """
)
def known_drug(t):
    return evidence.known_drug(
        sales(t).select("l_partkey", "l_suppkey", "c_nationkey", "l_linenumber"),
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"),
        t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"),
        t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"),
        drug="l_partkey",
        target="l_suppkey",
        disease="c_nationkey",
        phase="l_linenumber",
    )


@query(
    """
    SELECT coalesce(a.k, b.k, c.k) AS nation, n_customers, n_suppliers, n_name FROM
      (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) a
      FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) b ON a.k = b.k
      FULL JOIN (SELECT n_nationkey AS k, n_name FROM nation) c ON c.k = coalesce(a.k, b.k)
    """
)
def target_table(t):
    return evidence.target_table(
        {
            "customers": t.customer.groupBy(F.col("c_nationkey").alias("nation"))
            .agg(F.count(F.lit(1)).alias("n_customers")),
            "suppliers": t.supplier.groupBy(F.col("s_nationkey").alias("nation"))
            .agg(F.count(F.lit(1)).alias("n_suppliers")),
            "names": t.nation.select(F.col("n_nationkey").alias("nation"), "n_name"),
        },
        "nation",
    )


@query(
    """
    SELECT gene, name, species, homologue, kind FROM (
      SELECT 'S' || s_suppkey AS gene, s_name AS name, 'supplier' AS species FROM supplier
      UNION ALL SELECT 'C' || c_custkey, c_name, 'customer' FROM customer)
    JOIN (SELECT 'C' || o_custkey AS gene, o_orderkey AS homologue, 'protein' AS kind FROM orders
          UNION ALL SELECT DISTINCT 'S' || l_suppkey, l_partkey, 'ncrna' FROM lineitem) USING (gene)
    """
)
def homologues(t):
    return evidence.homologues(
        {
            "supplier": t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("gene"), F.col("s_name").alias("name")),
            "customer": t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("gene"), F.col("c_name").alias("name")),
        },
        [
            t.orders.select(
                F.concat(F.lit("C"), "o_custkey").alias("gene"), F.col("o_orderkey").alias("homologue"),
                F.lit("protein").alias("kind"),
            ),
            t.lineitem.select(
                F.concat(F.lit("S"), "l_suppkey").alias("gene"), F.col("l_partkey").alias("homologue"),
                F.lit("ncrna").alias("kind"),
            ).distinct(),
        ],
        "gene",
    )


@query(
    """
    SELECT p_partkey, p_brand, qty, best FROM part
    LEFT JOIN (SELECT l_partkey, sum(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY 1) a ON a.l_partkey = p_partkey
    LEFT JOIN (SELECT l_partkey, max(l_discount) AS best FROM lineitem GROUP BY 1) b ON b.l_partkey = p_partkey
    """
)
def prioritise_targets(t):
    key = F.col("l_partkey").alias("p_partkey")
    return evidence.prioritise_targets(
        t.part.select("p_partkey", "p_brand"),
        [
            t.lineitem.groupBy(key).agg(F.sum("l_quantity").cast("bigint").alias("qty")),
            t.lineitem.groupBy(key).agg(F.max("l_discount").alias("best")),
        ],
        "p_partkey",
    )


@query("SELECT c_nationkey, arg_min(c_name, (-c_acctbal, c_custkey)) AS c_name, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def gene_index(t):
    rows = t.customer.select("c_nationkey", "c_name", "c_custkey", "c_acctbal")
    return evidence.gene_index(rows, "c_nationkey", [-F.col("c_acctbal"), F.col("c_custkey")]).drop("c_acctbal")


@query(
    """
    WITH o AS (SELECT 0 AS pr, n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN n_name END AS name, n_name AS syn FROM nation
               UNION ALL SELECT 1, s_nationkey, min(s_name), NULL FROM supplier GROUP BY s_nationkey
               UNION ALL SELECT 1, s_nationkey, NULL, s_name FROM supplier
               UNION ALL SELECT 2, c_nationkey, c_mktsegment, c_mktsegment FROM customer)
    SELECT id, (SELECT name FROM o p WHERE p.id = o.id AND name IS NOT NULL ORDER BY pr, name LIMIT 1) AS name,
           string_agg(DISTINCT syn, ',' ORDER BY syn) AS synonyms FROM o GROUP BY id
    """
)
def biosample_index(t):
    nations = t.nation.select(
        F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") < 2, F.col("n_name")).alias("name"),
        F.array("n_name").alias("synonyms"),
    )
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("id")).agg(
        F.min("s_name").alias("name"), F.collect_set("s_name").alias("synonyms")
    )
    customers = t.customer.groupBy(F.col("c_nationkey").alias("id")).agg(
        F.min("c_mktsegment").alias("name"), F.collect_set("c_mktsegment").alias("synonyms")
    )
    rows = evidence.biosample_index([nations, suppliers, customers], "id", "name", "synonyms")
    return rows.select("id", "name", F.array_join("synonyms", ",").alias("synonyms"))


@query(
    """
    SELECT o_orderkey, c_name AS doi FROM orders
    LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey
    """
)
def literature_ids(t):
    known = t.customer.where("c_mktsegment <> 'BUILDING'")
    return evidence.literature_ids(
        t.orders.select("o_orderkey", "o_custkey"), known, "o_custkey", "c_custkey", "c_name", "doi"
    ).drop("o_custkey")


# ---- ingestion -----------------------------------------------------------------


@query(
    """
    SELECT 'FINNGEN_R11_' || c_custkey AS "studyId", 'FINNGEN_R11' AS "projectId", 'gwas' AS "studyType", c_mktsegment AS trait,
           453733::BIGINT AS "nSamples", 'gs://summary_stats/finngen_R11_' || c_custkey || '.gz' AS "summarystatsLocation", n_name AS efo
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey
    """
)
def ingest_study_index(t):
    rows = annotate.id_mapping(
        t.customer, t.nation.where("n_regionkey < 3"), "c_nationkey", "n_nationkey", F.col("n_name"), "efo"
    )
    return annotate.ingest_study_index(
        rows,
        study=F.concat(F.lit("FINNGEN_R11_"), "c_custkey"),
        project="FINNGEN_R11",
        study_type="gwas",
        trait=F.col("c_mktsegment"),
        statistics_path=F.concat(F.lit("gs://summary_stats/finngen_R11_"), "c_custkey", F.lit(".gz")),
        samples=453733,
        extra={"efo": F.col("efo")},
    )


@query(
    """
    SELECT 'STUDY_' || l_suppkey AS "studyId", 'SuSie' AS "finemappingMethod", l_suppkey, l_orderkey, l_linenumber, l_discount, lead
    FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_discount FROM lineitem)
    JOIN (SELECT l_suppkey AS k, max(l_extendedprice) / 10000 AS lead FROM lineitem GROUP BY 1 HAVING lead >= 9.0)
      ON k = l_suppkey
    """
)
def ingest_study_locus(t):
    snps = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_discount")
    summary = t.lineitem.groupBy("l_suppkey").agg((F.max("l_extendedprice") / 10000).alias("lead"))
    return annotate.ingest_study_locus(
        snps, summary, on=["l_suppkey"], study=F.concat(F.lit("STUDY_"), "l_suppkey"), lead_strength="lead",
        threshold=9.0, method="SuSie",
    )


# ---- locus to gene ---------------------------------------------------------------

FEATURES = ["distance_min", "distance_weighted", "pip_max", "pip_sum", "n_variants", "coloc_max"]


def feature_matrix(t):
    sets = t.lineitem.groupBy(F.col("l_suppkey").alias("locus"), F.col("l_partkey").alias("variant")).agg(
        (F.max("l_discount") / 100).alias("pip")
    )
    sets = sets.join(t.supplier.select(F.col("s_suppkey").alias("locus"), F.col("s_nationkey").alias("study")), "locus")
    genes = t.part.select(
        F.col("p_partkey").alias("variant"), F.col("p_brand").alias("gene"), (F.col("p_size") * 1000).alias("distance")
    )
    coloc = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("locus"), F.col("p_brand").alias("gene"), F.col("l_tax").alias("clpp")
    )
    return l2g.l2g_features(
        sets, genes, coloc, t.nation.select(F.col("n_nationkey").alias("study")),
        t.part.select(F.col("p_brand").alias("gene")).distinct(), locus="locus", variant="variant", gene="gene",
        study="study", pip="pip", distance="distance", coloc_score="clpp",
    )


_FEATURES = """
    SELECT locus, study, gene, min(distance) AS distance_min, sum(pip * distance) AS distance_weighted, max(pip) AS pip_max,
           sum(pip) AS pip_sum, count(*) AS n_variants, coalesce(any_value(cm), 0) AS coloc_max FROM (
      SELECT l_suppkey AS locus, l_partkey AS variant, max(l_discount) / 100 AS pip FROM lineitem GROUP BY ALL) cs
    JOIN (SELECT s_suppkey, s_nationkey AS study FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON s_suppkey = locus
    JOIN (SELECT p_partkey, p_brand AS gene, p_size * 1000 AS distance FROM part) ON p_partkey = variant
    LEFT JOIN (SELECT l_suppkey, p_brand, max(l_tax) AS cm FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) c ON c.l_suppkey = locus AND c.p_brand = gene
    GROUP BY locus, study, gene"""


@query(
    f"""
    SELECT locus, study, gene, distance_min, round(distance_weighted, 4) AS distance_weighted, round(pip_max, 6) AS pip_max,
           round(pip_sum, 6) AS pip_sum, n_variants, round(coloc_max, 4) AS coloc_max FROM ({_FEATURES})
    """
)
def l2g_features(t):
    rows = feature_matrix(t)
    return rows.select(
        "locus", "study", "gene", "distance_min", F.round("distance_weighted", 4).alias("distance_weighted"),
        F.round("pip_max", 6).alias("pip_max"), F.round("pip_sum", 6).alias("pip_sum"), "n_variants",
        F.round("coloc_max", 4).alias("coloc_max"),
    )


def document_features(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", "source", F.col("n_chars").cast("double").alias("chars"),
        F.length(F.regexp_replace(text, r"[^\s]", "")).cast("double").alias("spaces"),
        F.size(F.split(text, "\n")).cast("double").alias("lines"),
        F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double").alias("digits"),
        F.size(F.split(text, r"[.!?]")).cast("double").alias("sentences"),
    )


DOCUMENT_FEATURES = ["chars", "spaces", "lines", "digits", "sentences"]


def _gold(t):
    return t.labels.select("doc_id", F.col("quality").alias("label"))


@query(
    """
    WITH c AS (SELECT DISTINCT l_orderkey AS locus, l_partkey AS gene FROM lineitem),
    p AS (SELECT DISTINCT l_orderkey AS locus, l_partkey AS gene FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
    i AS (SELECT p_partkey AS a, p_partkey + 1 AS b, p_size / 50 AS s FROM part),
    b AS (SELECT a, b FROM i WHERE s >= 0.8 UNION SELECT b, a FROM i WHERE s >= 0.8),
    t AS (SELECT DISTINCT locus, b.b AS gene FROM p JOIN b ON b.a = p.gene)
    SELECT locus, gene, 1 AS label FROM p
    UNION ALL SELECT locus, gene, 0 FROM c WHERE locus IN (SELECT locus FROM p)
      AND NOT EXISTS (SELECT 1 FROM p WHERE p.locus = c.locus AND p.gene = c.gene)
      AND NOT EXISTS (SELECT 1 FROM t WHERE t.locus = c.locus AND t.gene = c.gene)
    """
)
def l2g_labels(t):
    """Orders as loci and parts as genes; the gold standard is a returned first line."""
    pairs = t.lineitem.select(F.col("l_orderkey").alias("locus"), F.col("l_partkey").alias("gene"))
    gold = t.lineitem.where("l_returnflag = 'R' AND l_linenumber = 1").select(
        F.col("l_orderkey").alias("locus"), F.col("l_partkey").alias("gene")
    )
    interactions = t.part.select(
        F.col("p_partkey").alias("gene"), (F.col("p_partkey") + 1).alias("partner"), (F.col("p_size") / 50).alias("s")
    )
    rows = l2g.l2g_labels(pairs, gold, interactions, locus="locus", gene="gene", partner="partner", score="s")
    return rows.select("locus", "gene", "label")


@query()
def l2g_train(t):
    """Importance of each feature in the trained model."""
    features = document_features(t)
    model = l2g.l2g_train(features, _gold(t), ["doc_id"], DOCUMENT_FEATURES)
    importance = model.stages[-1].featureImportances.toArray().tolist()
    counted = features.join(_gold(t), "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    named = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(float(v)).alias("importance"))
                      for n, v in zip(DOCUMENT_FEATURES, importance)])
    return counted.select("label", "n_rows", F.explode(named).alias("f")).select("label", "n_rows", "f.*")


@query()
def l2g_predict(t):
    features = document_features(t)
    model = l2g.l2g_train(features, _gold(t), ["doc_id"], DOCUMENT_FEATURES)
    return l2g.l2g_predict(model, features).select("doc_id", F.round("score", 6).alias("score"))


@query(
    """
    WITH p AS (SELECT l_suppkey AS locus, p_brand AS gene, max(l_discount) AS score FROM lineitem
               JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT locus, gene, score, s_nationkey AS study, n_name, row_number() OVER (PARTITION BY locus ORDER BY score DESC, gene) AS rank
    FROM p JOIN supplier ON s_suppkey = locus JOIN nation ON s_nationkey = n_nationkey WHERE score >= 0.05
    """
)
def l2g_evidence(t):
    predictions = (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("locus"), F.col("p_brand").alias("gene"))
        .agg(F.max("l_discount").alias("score"))
    )
    sets = t.supplier.select(F.col("s_suppkey").alias("locus"), F.col("s_nationkey").alias("study"))
    studies = t.nation.select(F.col("n_nationkey").alias("study"), "n_name")
    return l2g.l2g_evidence(predictions, sets, studies, locus="locus", gene="gene", study="study", score="score")


# ---- fine-mapping ----------------------------------------------------------------


def finemap_inputs(t):
    """Loci are suppliers, variants parts; z from discounts, LD from neighbouring parts of a locus."""
    rows = t.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("locus"), "l_partkey").agg(
        ((F.max("l_discount") - 0.05) / (F.min("l_tax") + 0.01)).alias("z")
    )
    rows = cut_lineage(rows.withColumn("variant", F.col("l_partkey").cast("string")))
    step = rows.select("locus", F.col("l_partkey"), F.explode(F.array(F.lit(1), F.lit(2))).alias("d"))
    pairs = step.withColumn("other", F.col("l_partkey") + F.col("d")).join(
        rows.select("locus", F.col("l_partkey").alias("other")), ["locus", "other"], "left_semi"
    )
    ld = pairs.select(
        "locus", F.col("l_partkey").cast("string").alias("variant_a"), F.col("other").cast("string").alias("variant_b"),
        F.when(F.col("d") == 1, 0.6).otherwise(0.3).alias("r"),
    )
    return rows.select("locus", "variant", "z"), ld


@query()
def finemap_loci(t):
    rows, ld = finemap_inputs(t)
    return finemap.finemap_loci(rows, ld, lead_neglog10=5.0)


_Z = """
    SELECT locus, variant, 0.5 * (ln(1 - 50.0 / 51.0) + 50.0 / 51.0 * z * z) AS bf FROM (
      SELECT l_suppkey::VARCHAR AS locus, l_partkey::VARCHAR AS variant, (max(l_discount) - 0.05) / (min(l_tax) + 0.01) AS z
      FROM lineitem GROUP BY ALL)"""


@query(
    f"""
    WITH q AS (SELECT locus, variant, exp(bf - m) / sum(exp(bf - m)) OVER (PARTITION BY locus) AS exact FROM (
                 SELECT *, max(bf) OVER (PARTITION BY locus) AS m FROM ({_Z}))),
    p AS (SELECT *, round(exact, 9) AS alpha FROM q),
    c AS (SELECT *, sum(alpha) OVER (PARTITION BY locus ORDER BY alpha DESC, variant ROWS UNBOUNDED PRECEDING) AS cum FROM p)
    SELECT locus, count(*) AS n, round(max(exact), 6) AS top FROM c WHERE round(cum - alpha, 9) < 0.99 GROUP BY locus
    """
)
def finemap_single_effect(t):
    """With one effect and no purity limits the fit is the single-effect posterior."""
    rows, ld = finemap_inputs(t)
    sets = finemap.finemap_loci(rows, ld, effects=1, mean_r2=-1.0, min_r2=-1.0, min_log_bf=-1e9)
    return sets.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("alpha"), 6).alias("top"))



@query(
    """
    SELECT locus, true AS sums, true AS sizes, true AS pips FROM (
      SELECT l_suppkey::VARCHAR AS locus, (max(l_discount) - 0.05) / (min(l_tax) + 0.01) AS z FROM lineitem GROUP BY l_suppkey, l_partkey)
    GROUP BY locus HAVING max(abs(z)) >= 4.417173413
    """
)
def finemap_invariants(t):
    """Of every locus with a strong lead: what its credible sets, if any, have to keep to."""
    rows, ld = finemap_inputs(t)
    sets = finemap.finemap_loci(rows, ld, lead_neglog10=5.0)
    each = sets.groupBy("locus", "effect").agg(
        F.sum("alpha").alias("mass"), F.count(F.lit(1)).alias("n"), F.min(F.col("pip") - F.col("alpha")).alias("gap"), F.max("pip").alias("top")
    )
    whole = each.groupBy("locus").agg(
        F.min((F.col("mass") >= finemap.SUM_PIPS - 1e-6) & (F.col("mass") <= 1 + 1e-6)).alias("sums"),
        F.count(F.lit(1)).alias("effects"), F.max("n").alias("largest"),
        F.min((F.col("gap") >= -1e-9) & (F.col("top") <= 1 + 1e-9)).alias("pips"),
    )
    loci = rows.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("z")).alias("top")).where("top >= 4.417173413")
    joined = loci.join(whole, "locus", "left")
    sizes = (F.col("effects") <= finemap.MAX_CAUSAL) & (F.col("largest") <= F.col("n"))
    return joined.select(
        "locus", F.coalesce("sums", F.lit(True)).alias("sums"), F.coalesce(sizes, F.lit(True)).alias("sizes"),
        F.coalesce("pips", F.lit(True)).alias("pips"),
    )


@query("SELECT doc_id, least(n_chars // 500, 20) >= 4 AS positive FROM documents")
def l2g_scores_on_a_separable_feature(t):
    """Documents of at least 2,000 characters are positive; the model has to put all others below them."""
    steps = F.least(F.floor(F.col("n_chars") / 500), F.lit(20)).cast("double")
    features = t.documents.select("doc_id", steps.alias("steps"), F.length("source").cast("double").alias("noise"))
    gold = features.select("doc_id", (F.col("steps") >= 4).cast("int").alias("label"))
    model = l2g.l2g_train(features, gold, ["doc_id"], ["steps", "noise"], estimators=5, depth=2)
    return l2g.l2g_predict(model, features).select("doc_id", (F.col("score") > 0.5).alias("positive"))
