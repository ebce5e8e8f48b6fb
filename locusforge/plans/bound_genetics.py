"""Variant, interval, locus, posterior and hierarchy operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusforge.functions.stats import erfc_sql, log_abf, rounded
from locusforge.operators import annotate, graph, intervals, loci, posteriors, variants
from locusforge.operators.scale import nest_rows
from locusforge.plans.registry import epoch, joined, query
from locusforge.session import cut_lineage

DAY = 86_400


# ---- variants -----------------------------------------------------------------


def variant_sources(t):
    """Three variant sources out of lineitem, one per return flag."""
    ident = F.concat_ws("_", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    rows = t.lineitem
    return {
        flag: variants.variant_rows_from_source(
            rows.where(F.col("l_returnflag") == flag), ident, {"INFO": F.col("l_orderkey").cast("string")}
        )
        for flag in ("A", "N", "R")
    }


_VARIANTS = """
    SELECT l_suppkey::VARCHAR AS chrom, l_partkey AS pos, l_returnflag AS ref, l_linestatus AS alt, min(l_orderkey::VARCHAR) AS info
    FROM lineitem GROUP BY l_suppkey, l_partkey, l_returnflag, l_linestatus"""
WHOLE = """
    chrom AS "#CHROM", pos AS "POS", concat_ws('_', chrom, pos, ref, alt) AS "ID", ref AS "REF", alt AS "ALT", '.' AS "QUAL",
    '.' AS "FILTER", info AS "INFO\""""
_NUMBERED = f"""
    SELECT *, row_number() OVER (ORDER BY chrom, pos, ref, alt) - 1 AS rn FROM ({_VARIANTS})"""


def merged(t):
    return variants.merge_variants(list(variant_sources(t).values()))


@query(
    f"""
    SELECT rn // 2000 AS chunk, count(*) AS n, arg_min(chrom, rn) AS first_chrom, arg_min(pos, rn) AS first_pos,
           arg_max(chrom, rn) AS last_chrom, arg_max(pos, rn) AS last_pos
    FROM ({_NUMBERED}) GROUP BY 1
    """
)
def variant_chunks(t):
    return variants.variant_chunks(merged(t))


@query(
    """
    SELECT l_suppkey::VARCHAR AS "#CHROM", l_partkey AS "POS",
           concat_ws('_', l_suppkey, l_partkey, l_returnflag, l_linestatus) AS "ID", l_returnflag AS "REF",
           l_linestatus AS "ALT", '.' AS "QUAL", '.' AS "FILTER", l_orderkey::VARCHAR AS "INFO"
    FROM lineitem
    """
)
def variant_rows_from_source(t):
    return variants.union_sources(list(variant_sources(t).values()))


@query(
    """
    SELECT l_suppkey, l_partkey, l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag, l_linestatus
                                   ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem)
    WHERE rn = 1
    """
)
def dedup_first(t):
    keys = ["l_suppkey", "l_partkey", "l_returnflag", "l_linestatus"]
    rest = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return variants.dedup_first(t.lineitem.select(*keys, *rest), keys, [F.col(c) for c in rest])


@query(f"SELECT {WHOLE} FROM ({_VARIANTS})")
def sort_variants(t):
    return variants.sort_variants(merged(t))


@query(f"SELECT {WHOLE} FROM ({_VARIANTS})")
def merge_variants(t):
    return variants.merge_variants(list(variant_sources(t).values()), tie_break=[F.col("INFO")])


@query(f"SELECT {WHOLE}, rn AS \"row\", rn // 2000 AS chunk FROM ({_NUMBERED})")
def chunk_sorted(t):
    return variants.chunk_sorted(merged(t), [F.col(k) for k in variants.VARIANT_KEYS])


@query(
    f"""
    SELECT (rn // 5000 * 5000 + 1) || '-' || (rn // 5000 * 5000 + 5000) AS label, count(*) AS n, sum(pos)::BIGINT AS positions
    FROM ({_NUMBERED}) GROUP BY 1
    """
)
def row_range_chunks(t):
    rows = variants.row_range_chunks(merged(t), [F.col(k) for k in variants.VARIANT_KEYS], 5000)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("POS").alias("positions"))


_ORDERS_NUMBERED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders"


@query(f"SELECT o_orderkey, rn AS \"row\", rn // 4000 AS chunk, rn % 4000 AS locus_index FROM ({_ORDERS_NUMBERED})")
def index_in_chunk(t):
    rows = variants.chunk_rows(t.orders.select("o_orderkey"), [F.col("o_orderkey")], 4000)
    return variants.index_in_chunk(rows, 4000)


@query(f"SELECT rn // 4000 AS chunk, count(*) AS n FROM ({_ORDERS_NUMBERED}) GROUP BY 1")
def chunk_rows(t):
    rows = variants.chunk_rows(t.orders.select("o_orderkey"), [F.col("o_orderkey")], 4000)
    return variants.chunk_counts(rows)


@query(
    "SELECT ceil(count(*) / 4000.0)::BIGINT AS n_chunks, count(*) AS n_rows, ceil(count(*) / 4000.0)::BIGINT AS expected, "
    "true AS ok FROM orders"
)
def chunk_counts(t):
    rows = variants.chunk_rows(t.orders.select("o_orderkey"), [F.col("o_orderkey")], 4000)
    return variants.chunk_check(rows, 4000)


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_sizes(t):
    return variants.source_sizes(t.documents, "source")


@query("SELECT doc_id, lang, source, CASE WHEN lang = 'en' THEN n_chars END AS n_chars FROM documents")
def union_sources(t):
    docs = t.documents
    return variants.union_sources(
        [
            docs.where("lang = 'en'").select("doc_id", "lang", "source", "n_chars"),
            docs.where("lang <> 'en'").select("doc_id", "lang", "source"),
        ]
    )


# ---- intervals ----------------------------------------------------------------


@query(
    """
    SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT AS pos,
           floor(l_extendedprice)::BIGINT + p_size * 1000 AS lifted
    FROM lineitem LEFT JOIN part
      ON floor(l_extendedprice)::BIGINT BETWEEN p_partkey * 50 AND p_partkey * 50 + 39
    """
)
def lift_coordinates(t):
    points = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.floor("l_extendedprice").cast("bigint").alias("pos")
    )
    chain = t.part.select(
        (F.col("p_partkey") * 50).alias("s"),
        (F.col("p_partkey") * 50 + 39).alias("e"),
        (F.col("p_size") * 1000).cast("bigint").alias("shift"),
    )
    return intervals.lift_coordinates(
        points, chain, by=[], position="pos", start="s", end="e", offset="shift", width=1000, out="lifted"
    ).select("l_orderkey", "l_linenumber", "pos", "lifted")


@query(
    """
    SELECT o_orderkey, c_custkey, round(abs(o_totalprice - c_acctbal * 50), 2) AS distance
    FROM orders JOIN customer ON abs(o_totalprice - c_acctbal * 50) <= 100
    """
)
def gene_distance(t):
    points = t.orders.select("o_orderkey", "o_totalprice")
    genes = t.customer.select("c_custkey", (F.col("c_acctbal") * 50).alias("site"))
    near = intervals.gene_distance(points, genes, position="o_totalprice", site="site", distance=100)
    return near.select("o_orderkey", "c_custkey", rounded(F.col("distance"), 2).alias("distance"))


def signals(t):
    """Events as association signals: study, position in seconds, -log10 p."""
    return t.events.select(
        F.col("user_id").alias("study"), F.col("event_type").alias("kind"), epoch("ts").alias("pos"), "value", "event_id"
    )


_SIGNALS = """
    SELECT user_id AS study, event_type AS kind, date_diff('second', TIMESTAMP '1970-01-01', ts) AS pos, value, event_id
    FROM events"""

_BREAKER = f"""
    WITH s AS (SELECT * FROM ({_SIGNALS}) WHERE value >= 20),
    g AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 40000 THEN 1 ELSE 0 END AS fresh FROM s
          WINDOW w AS (PARTITION BY study ORDER BY pos, event_id)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY study ORDER BY pos, event_id) AS block FROM g),
    loci AS (
      SELECT study, block::BIGINT AS block, min(pos) - 5000 AS "start", max(pos) + 5000 AS "end", count(*) AS n,
             arg_min(event_id, (-value, pos, event_id)) AS lead_id, arg_min(pos, (-value, pos, event_id)) AS lead_pos,
             max(value) AS lead_strength
      FROM b GROUP BY study, block HAVING max(value) >= 100)"""


def broken_loci(t):
    return loci.locus_breaker(
        signals(t), ["study"], position="pos", strength="value", tie="event_id", baseline=20, gap=40_000,
        threshold=100, flank=5_000,
    )


@query(_BREAKER + " SELECT * FROM loci")
def locus_breaker(t):
    return broken_loci(t)


@query(
    f"""
    SELECT study, kind, min(pos) AS "start", max(pos) AS "end", count(*) AS n, arg_min(event_id, (-value, pos, event_id)) AS lead_id,
           arg_min(pos, (-value, pos, event_id)) AS lead_pos, max(value) AS lead_strength
    FROM ({_SIGNALS}) GROUP BY study, kind
    """
)
def locus_peak(t):
    rows = loci.locus_peak(signals(t), ["study", "kind"], position="pos", strength="value", tie="event_id")
    return rows.select(
        "study", "kind", "start", "end", "n", F.col("lead.id").alias("lead_id"), F.col("lead.pos").alias("lead_pos"),
        F.col("lead.strength").alias("lead_strength"),
    )


@query(
    _BREAKER
    + f"""
    SELECT l.study || ':' || l.block AS locus, 0::INTEGER AS part, count(*) AS n, string_agg(s.event_id, ',' ORDER BY s.pos, s.event_id) AS tags
    FROM loci l JOIN ({_SIGNALS}) s ON s.study = l.study AND s.pos BETWEEN l."start" AND l."end" GROUP BY 1
    """
)
def collect_locus(t):
    bounds = broken_loci(t).select(
        "study", F.concat_ws(":", "study", "block").alias("locus_id"), "start", "end"
    )
    rows = intervals.collect_locus(
        bounds, signals(t), by=["study"], locus="locus_id", position="pos", start="start", end="end", width=100_000,
        item=F.struct("pos", "event_id"),
    )
    ids = F.transform("locus", lambda x: x["event_id"])
    return rows.select(
        F.col("locus_id").alias("locus"), "part", F.size("locus").cast("bigint").alias("n"), joined(ids).alias("tags")
    )


def _greedy_sql(source: str, key: str, threshold: int, distance: int) -> str:
    """Leads of a greedy choice, one candidate after the other."""
    return f"""
    WITH RECURSIVE s AS (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY value DESC, pos, event_id) AS rn
      FROM ({source}) WHERE value >= {threshold}),
    g AS (
      SELECT {key} AS k, rn, [{{'pos': pos, 'id': event_id, 'v': value}}] AS leads FROM s WHERE rn = 1
      UNION ALL
      SELECT g.k, s.rn, CASE WHEN len(list_filter(g.leads, lambda x: abs(x.pos - s.pos) < {distance})) > 0 THEN g.leads
                        ELSE list_append(g.leads, {{'pos': s.pos, 'id': s.event_id, 'v': s.value}}) END
      FROM g JOIN s ON s.{key} = g.k AND s.rn = g.rn + 1),
    picked AS (SELECT k, unnest(leads) AS lead FROM (SELECT k, arg_max(leads, rn) AS leads FROM g GROUP BY k))
    SELECT k AS {key}, lead.id AS lead_id, lead.pos AS lead_pos, lead.v AS lead_strength FROM picked"""


def window_leads(t, **options):
    return loci.window_clump(
        signals(t), ["study"], position="pos", strength="value", tie="event_id", distance=DAY, threshold=50, **options
    )


@query(_greedy_sql(_SIGNALS, "study", 50, DAY))
def window_clump(t):
    return window_leads(t)


@query(_greedy_sql(_SIGNALS, "study", 50, DAY))
def window_clump_in_rounds(t):
    return window_leads(t, fold_positions=0)


QUERY_SPLIT_LARGE = (
    _BREAKER.replace("WITH s", "WITH RECURSIVE s")
    + f""",
    wide AS (SELECT l.study || ':' || l.block AS wkey, s.* FROM loci l JOIN ({_SIGNALS}) s
             ON s.study = l.study AND s.pos BETWEEN l."start" AND l."end" WHERE l."end" - l."start" > 100000),
    s2 AS (SELECT *, row_number() OVER (PARTITION BY wkey ORDER BY value DESC, pos, event_id) AS rn FROM wide WHERE value >= 100),
    g2 AS (
      SELECT wkey, study, rn, [{{'pos': pos, 'id': event_id, 'v': value}}] AS leads FROM s2 WHERE rn = 1
      UNION ALL
      SELECT g2.wkey, g2.study, s2.rn,
             CASE WHEN len(list_filter(g2.leads, lambda x: abs(x.pos - s2.pos) < 30000)) > 0 THEN g2.leads
                  ELSE list_append(g2.leads, {{'pos': s2.pos, 'id': s2.event_id, 'v': s2.value}}) END
      FROM g2 JOIN s2 ON s2.wkey = g2.wkey AND s2.rn = g2.rn + 1),
    picked AS (SELECT study, unnest(leads) AS lead FROM (SELECT wkey, study, arg_max(leads, rn) AS leads FROM g2 GROUP BY ALL))
    SELECT study, "start", "end", lead_id, lead_pos, lead_strength FROM loci WHERE "end" - "start" <= 100000
    UNION ALL
    SELECT study, lead.pos - 15000, lead.pos + 15000, lead.id, lead.pos, lead.v FROM picked
    """
)


@query(QUERY_SPLIT_LARGE)
def split_large_loci(t):
    return loci.split_large_loci(
        broken_loci(t), signals(t), ["study"], position="pos", strength="value", tie="event_id", threshold=100,
        large=100_000, distance=30_000,
    )


@query(
    f"""
    WITH loci AS (SELECT study, kind, study || kind AS id, min(pos) AS s, max(pos) AS e FROM ({_SIGNALS}) GROUP BY study, kind)
    SELECT a.study, a.kind, a.s AS "start", a.e AS "end",
           EXISTS (SELECT 1 FROM loci b WHERE b.kind = 'error' AND b.study = a.study AND b.s <= a.e AND a.s <= b.e) AS explained
    FROM loci a WHERE a.kind <> 'error'
    """
)
def explained_by(t):
    peaks = loci.locus_peak(
        signals(t), ["study", "kind"], position="pos", strength="value", tie="event_id"
    ).select("study", "kind", F.concat("study", "kind").alias("id"), "start", "end")
    return loci.explained_by(
        peaks.where("kind <> 'error'"), peaks.where("kind = 'error'"), locus="id", by=["study"], start="start",
        end="end", width=DAY,
    ).drop("id")


# ---- linkage disequilibrium ----------------------------------------------------


def ld_entries(t):
    """Orders as matrix entries: row, column, correlation, population."""
    cents = F.round(F.col("o_totalprice") - F.floor("o_totalprice"), 2)
    return t.orders.select(
        F.col("o_custkey").alias("i"),
        F.floor(F.col("o_totalprice") / 250).cast("bigint").alias("j"),
        cents.alias("r"),
        F.col("o_orderstatus").alias("population"),
    )


_ENTRIES = """
    SELECT o_custkey AS i, floor(o_totalprice / 250)::BIGINT AS j, round(o_totalprice - floor(o_totalprice), 2) AS r,
           o_orderstatus AS population FROM orders"""
_LD = f"""
    SELECT i AS variant, j AS tag, r, population FROM ({_ENTRIES}) UNION ALL
    SELECT j, i, r, population FROM ({_ENTRIES}) WHERE i <> j"""


def ld_pairs(t):
    return loci.expand_ld(ld_entries(t), "i", "j", "r", "population")


def study_leads(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("study"), F.col("l_partkey").alias("lead")).agg(
        F.max("l_extendedprice").alias("strength"), F.max("l_tax").alias("tax")
    )


_LEADS = """
    SELECT l_suppkey AS study, l_partkey AS lead, max(l_extendedprice) AS strength, max(l_tax) AS tax
    FROM lineitem GROUP BY ALL"""


@query(
    f"""
    SELECT study, lead, tag, population, round(r * r, 4) AS r2 FROM ({_LEADS}) l JOIN ({_LD}) d
      ON d.variant = l.lead AND d.population = 'F' WHERE r * r >= 0.9
    """
)
def ld_join(t):
    leads = study_leads(t).withColumn("population", F.lit("F"))
    rows = loci.ld_join(leads, ld_pairs(t), variant="lead", population="population", min_r2=0.9)
    return rows.select("study", "lead", "tag", "population", F.round("r2", 4).alias("r2"))


@query(
    f"""
    WITH l AS ({_LEADS}), d AS ({_LD})
    SELECT a.study, a.lead, EXISTS (
      SELECT 1 FROM d JOIN l b ON b.lead = d.variant
      WHERE d.tag = a.lead AND b.study = a.study AND d.r * d.r >= 0.5
        AND (b.strength > a.strength OR (b.strength = a.strength AND b.lead < a.lead))) AS ld_clumped
    FROM l a
    """
)
def ld_clump(t):
    pairs = ld_pairs(t).drop("population")
    return loci.ld_clump(
        study_leads(t), pairs, study="study", variant="lead", strength="strength", min_r2=0.5
    ).select("study", "lead", "ld_clumped")


@query(
    f"""
    WITH v AS (SELECT p_partkey AS idx, 'v' || p_partkey AS id FROM part),
    p AS (SELECT a.id AS a, b.id AS b, r, population FROM ({_ENTRIES}) e JOIN v a ON a.idx = e.i JOIN v b ON b.idx = e.j
          WHERE e.i <> e.j AND r * r >= 0.25),
    u AS (SELECT a AS variant, b AS tag, r, population FROM p UNION ALL SELECT b, a, r, population FROM p)
    SELECT variant, population, 0::INTEGER AS part, count(*) AS n, string_agg(tag, ',' ORDER BY tag, r) AS tags
    FROM u GROUP BY variant, population
    """
)
def ld_index_build(t):
    known = t.part.select("p_partkey", F.concat(F.lit("v"), "p_partkey").alias("id"))
    rows = annotate.ld_index_build(
        ld_entries(t), known, row="i", column="j", r="r", population="population", index="p_partkey", variant_id="id",
        min_r2=0.25,
    )
    tags = F.transform("ldSet", lambda x: x["tag"])
    return rows.select(
        "variant", "population", "part", F.size("ldSet").cast("bigint").alias("n"), F.array_join(tags, ",").alias("tags")
    )


@query(
    f"""
    WITH tags AS (SELECT study, lead, tag, max(r * r) AS r2, any_value(strength) / 10000 AS m FROM ({_LEADS}) l
                  JOIN ({_LD}) d ON d.variant = l.lead WHERE r * r >= 0.5 GROUP BY study, lead, tag),
    z AS (SELECT *, sqrt(1 - pow(sqrt(r2), 6.4)) * sqrt(m) / 2 AS sd FROM tags),
    x AS (SELECT *, (m - r2 * m) / sd / sqrt(2.0) AS x FROM z),
    w AS (SELECT *, CASE WHEN sd > 0 THEN {erfc_sql("x")} ELSE 1 END AS w FROM x)
    SELECT study, lead, tag, round(w / sum(w) OVER (PARTITION BY study, lead), 5) AS pip FROM w
    """
)
def pics(t):
    rows = loci.ld_join(study_leads(t), ld_pairs(t), variant="lead", min_r2=0.5)
    tags = rows.groupBy("study", "lead", "tag").agg(
        F.max("r2").alias("r2"), (F.max("strength") / 10000).alias("m")
    )
    return posteriors.pics(tags, ["study", "lead"], lead_strength="m", r2="r2").select(
        "study", "lead", "tag", rounded(F.col("pip"), 5).alias("pip")
    )


# ---- posteriors ----------------------------------------------------------------


def credible_rows(t):
    """One row per (supplier, part) with a log Bayes factor from a made-up effect and error."""
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("locus"), F.col("l_partkey").alias("variant")).agg(
        F.max("l_discount").alias("beta"), (F.max("l_tax") + 0.02).alias("se")
    )
    return rows.withColumn("log_bf", log_abf(F.col("beta"), F.col("se"), 0.04))


_BF = """
    SELECT locus, variant, 0.5 * (ln(1 - 0.04 / (se * se + 0.04)) + 0.04 / (se * se + 0.04) * (beta / se) * (beta / se)) AS log_bf
    FROM (SELECT l_suppkey AS locus, l_partkey AS variant, max(l_discount) AS beta, max(l_tax) + 0.02 AS se
          FROM lineitem GROUP BY ALL)"""
_PIP = f"""
    SELECT locus, variant, log_bf, exp(log_bf - m) / sum(exp(log_bf - m)) OVER (PARTITION BY locus) AS pip
    FROM (SELECT *, max(log_bf) OVER (PARTITION BY locus) AS m FROM ({_BF}))"""


def pip_rows(t):
    return posteriors.single_effect_posterior(credible_rows(t), ["locus"], "log_bf")


@query(f"SELECT locus, variant, round(log_bf, 6) AS log_bf, round(pip, 8) AS pip FROM ({_PIP})")
def single_effect_posterior(t):
    return pip_rows(t).select(
        "locus", "variant", F.round("log_bf", 6).alias("log_bf"), F.round("pip", 8).alias("pip")
    )


@query(
    f"""
    SELECT locus, variant, pip FROM (
      SELECT locus, variant, pip, sum(pip) OVER (PARTITION BY locus ORDER BY pip DESC, variant
             ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT locus, variant, round(pip, 10) AS pip FROM ({_PIP})))
    WHERE round(cum - pip, 9) < 0.99
    """
)
def credible_set(t):
    return credible_members(t).select("locus", "variant", "pip")


def credible_members(t):
    rows = pip_rows(t).withColumn("pip", F.round("pip", 10))
    return posteriors.credible_set(rows, ["locus"], pip="pip", tie="variant")


def overlaps(t, **options):
    """Colocalisation works on credible sets, not on all rows of the loci."""
    members = cut_lineage(credible_members(t).select("locus", "variant", "pip", "log_bf"))
    return posteriors.credible_set_overlaps(
        members, locus="locus", variant="variant", carry=["pip", "log_bf"], **options
    )


_MEMBERS = f"""
    SELECT locus, variant, pip, log_bf FROM (
      SELECT *, sum(pip) OVER (PARTITION BY locus ORDER BY pip DESC, variant ROWS UNBOUNDED PRECEDING) AS cum
      FROM (SELECT locus, variant, log_bf, round(pip, 10) AS pip FROM ({_PIP})))
    WHERE round(cum - pip, 9) < 0.99"""
_OVERLAPS = f"""
    SELECT a.locus AS left_locus, b.locus AS right_locus, a.variant, a.pip AS left_pip, b.pip AS right_pip,
           a.log_bf AS l1, b.log_bf AS l2
    FROM ({_MEMBERS}) a JOIN ({_MEMBERS}) b ON a.variant = b.variant AND a.locus < b.locus"""


@query(
    f"SELECT left_locus, right_locus, variant, left_pip, right_pip FROM ({_OVERLAPS})"
)
def credible_set_overlaps(t):
    return overlaps(t, block=3).select("left_locus", "right_locus", "variant", "left_pip", "right_pip")


@query(
    f"""
    SELECT left_locus, right_locus, count(*) AS n_shared, round(sum(left_pip * right_pip), 8) AS clpp
    FROM ({_OVERLAPS}) GROUP BY ALL
    """
)
def ecaviar(t):
    return posteriors.ecaviar(overlaps(t)).withColumn("clpp", F.round("clpp", 8))


#: Totals of a locus over all its variants, only the shared cause over the overlaps.
COLOC_SQL = f"""
    WITH t AS (SELECT locus, any_value(m) + ln(sum(exp(log_bf - m))) AS l, count(*) AS n
               FROM (SELECT locus, log_bf, max(log_bf) OVER (PARTITION BY locus) AS m FROM ({_BF})) GROUP BY locus),
    m AS (SELECT *, max(l1 + l2) OVER (PARTITION BY left_locus, right_locus) AS m12 FROM ({_OVERLAPS})),
    s AS (SELECT left_locus, right_locus, count(*) AS n_shared, sum(left_pip * right_pip) AS clpp,
                 any_value(m12) + ln(sum(exp(l1 + l2 - m12))) AS c FROM m GROUP BY left_locus, right_locus),
    h AS (SELECT left_locus, right_locus, n_shared, clpp, 1.0 AS e0, exp(a.l + ln(1e-4)) AS e1, exp(b.l + ln(1e-4)) AS e2,
                 CASE WHEN greatest(a.n, b.n) > 1 AND c < a.l + b.l
                      THEN exp(a.l + b.l + ln(1 - exp(c - a.l - b.l)) + ln(1e-8)) ELSE 0 END AS e3,
                 exp(c + ln(1e-5)) AS e4
          FROM s JOIN t a ON a.locus = left_locus JOIN t b ON b.locus = right_locus),
    coloc AS (
      SELECT left_locus, right_locus, n_shared, round(clpp, 8) AS clpp, round(e0 / e, 6) AS h0, round(e1 / e, 6) AS h1,
             round(e2 / e, 6) AS h2, round(e3 / e, 6) AS h3, round(e4 / e, 6) AS h4
      FROM (SELECT *, e0 + e1 + e2 + e3 + e4 AS e FROM h))"""


@query(f"{COLOC_SQL} SELECT left_locus, right_locus, n_shared, h0, h1, h2, h3, h4 FROM coloc")
def coloc(t):
    rows = posteriors.coloc(overlaps(t), credible_rows(t), locus="locus", log_bf="log_bf")
    return rows.select(
        "left_locus", "right_locus", "n_shared", *[F.round(f"h{i}", 6).alias(f"h{i}") for i in range(5)]
    )


# ---- annotation ----------------------------------------------------------------


@query(
    """
    SELECT o_orderkey, o_custkey, lines, n FROM orders LEFT JOIN (
      SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines, count(*) AS n
      FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
    """
)
def study_ancestry_join(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    rows = annotate.study_ancestry_join(
        t.orders.select("o_orderkey", "o_custkey"), lines, "o_orderkey", F.struct("l_linenumber", "l_partkey")
    )
    texts = F.transform("ancestries", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    return rows.select(
        "o_orderkey", "o_custkey", F.array_join(texts, ",").alias("lines"), F.size("ancestries").cast("bigint").alias("n")
    ).withColumn("n", F.when(F.col("lines").isNotNull(), F.col("n")))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_partkey IS NULL AS non_mapped FROM lineitem
    LEFT JOIN (SELECT * FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')) ON l_partkey = p_partkey
    """
)
def map_to_variants(t):
    known = t.part.where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
    return annotate.map_to_variants(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), known, {"l_partkey": "p_partkey"}, ["p_name"]
    )


@query(
    """
    WITH v AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'O' ELSE 'N' END AS r,
                      CASE p_size % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'R' ELSE 'O' END AS a, 'v' || p_partkey AS id FROM part),
    m AS (SELECT l.*, v.*, v.r = l_linestatus AND v.a = l_returnflag AS flipped FROM lineitem l JOIN v ON l_partkey = p_partkey
          AND ((v.r = l_returnflag AND v.a = l_linestatus) OR (v.r = l_linestatus AND v.a = l_returnflag)))
    SELECT l_orderkey, l_linenumber, l_partkey, r AS ref, a AS alt, id,
           round(CASE WHEN flipped THEN -(l_discount - 0.05) ELSE l_discount - 0.05 END, 4) + 0.0 AS beta, flipped, false AS palindromic
    FROM m
    """
)
def harmonise_sumstats(t):
    raw, known = _raw_statistics(t)
    rows = annotate.harmonise_sumstats(
        raw, known, position=["l_partkey"], ref="ref", alt="alt", beta="beta", variant_id="id"
    )
    return rows.withColumn("beta", F.round("beta", 4) + F.lit(0.0))


def _raw_statistics(t):
    """Lines as statistics, and parts as variants with made-up alleles."""
    code = F.col("p_size") % 3
    known = t.part.select(
        F.col("p_partkey").alias("l_partkey"),
        F.when(code == 0, "A").when(code == 1, "O").otherwise("N").alias("ref"),
        F.when(code == 0, "F").when(code == 1, "R").otherwise("O").alias("alt"),
        F.concat(F.lit("v"), "p_partkey").alias("id"),
    )
    raw = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"),
        (F.col("l_discount") - 0.05).alias("beta"),
    )
    return raw, known


@query(
    """
    WITH v AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'O' ELSE 'N' END AS r,
                      CASE p_size % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'R' ELSE 'O' END AS a FROM part)
    SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS ref, l_linestatus AS alt FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM v WHERE p_partkey = l_partkey
      AND ((v.r = l_returnflag AND v.a = l_linestatus) OR (v.r = l_linestatus AND v.a = l_returnflag)))
    """
)
def unmatched_sumstats(t):
    raw, known = _raw_statistics(t)
    return annotate.unmatched_sumstats(
        raw, known, position=["l_partkey"], ref="ref", alt="alt", variant_id="id"
    ).drop("beta")


@query(
    """
    SELECT l_orderkey, l_linenumber, p_retailprice, p_size, s_acctbal FROM lineitem
    LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey
    LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey
    """
)
def annotate_scores(t):
    rows = annotate.annotate_scores(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        [
            (t.part.where("p_size > 25"), {"l_partkey": "p_partkey"}, ["p_retailprice", "p_size"]),
            (t.supplier.where("s_acctbal > 0"), {"l_suppkey": "s_suppkey"}, ["s_acctbal"]),
        ],
    )
    return rows.drop("l_partkey", "l_suppkey")


@query(
    """
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, curated, canonical FROM (
      SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY curated DESC, canonical DESC,
               l_orderkey, l_linenumber, l_extendedprice) AS rn
      FROM (SELECT *, l_returnflag = 'R' AS curated, l_linestatus = 'O' AS canonical FROM lineitem)) WHERE rn = 1
    """
)
def pick_consequence(t):
    rows = t.lineitem.select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice",
        (F.col("l_returnflag") == "R").alias("curated"), (F.col("l_linestatus") == "O").alias("canonical"),
    )
    return annotate.pick_consequence(
        rows, ["l_partkey", "l_suppkey"], "curated", "canonical", ["l_orderkey", "l_linenumber", "l_extendedprice"]
    ).drop("l_extendedprice")


@query(
    """
    SELECT p_partkey, 0::INTEGER AS part, c AS consequences, f AS frequencies FROM part
    LEFT JOIN (SELECT l_partkey, string_agg(x, ',' ORDER BY x) AS c FROM (SELECT DISTINCT l_partkey, l_returnflag || l_linestatus AS x FROM lineitem)
               GROUP BY 1) a ON a.l_partkey = p_partkey
    LEFT JOIN (SELECT l_partkey, string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) AS f
               FROM (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1) b ON b.l_partkey = p_partkey
    """
)
def variant_index(t):
    consequences = t.lineitem.select(
        F.col("l_partkey").alias("p_partkey"), F.concat("l_returnflag", "l_linestatus").alias("c")
    ).distinct()
    frequencies = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    rows = annotate.variant_index(
        t.part.select("p_partkey"), consequences, frequencies, "p_partkey", F.col("c"), F.struct("l_returnflag", "n")
    )
    freq = F.transform("frequencies", lambda x: F.concat_ws("=", x["l_returnflag"], x["n"]))
    return rows.select(
        "p_partkey", F.coalesce("part", F.lit(0)).alias("part"), F.array_join("consequences", ",").alias("consequences"),
        F.array_join(freq, ",").alias("frequencies"),
    )


@query(
    """
    SELECT c_custkey, part_rows, n FROM (
      SELECT o_custkey AS c_custkey, count(*) AS n, max(o_orderkey) AS part_rows FROM orders GROUP BY 1)
    """
)
def nest_rows_in_parts(t):
    rows = nest_rows(
        t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], F.col("o_orderkey"), "orders", max_items=5
    )
    return rows.groupBy("c_custkey").agg(
        F.sum(F.size("orders")).alias("n"), F.max(F.array_max("orders")).alias("part_rows")
    )


@query(
    """
    SELECT s_suppkey, s_nationkey, n_name FROM supplier
    LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey
    """
)
def id_mapping(t):
    return annotate.id_mapping(
        t.supplier.select("s_suppkey", "s_nationkey"), t.nation.where("n_regionkey < 3"), "s_nationkey", "n_nationkey",
        F.col("n_name"), "n_name",
    )


@query(
    """
    SELECT o_orderkey, n_name FROM orders LEFT JOIN
      (SELECT DISTINCT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
      ON c_custkey = o_custkey
    """
)
def id_mapping_of_arrays(t):
    members = t.customer.withColumnRenamed("c_nationkey", "n_nationkey")
    mapping = nest_rows(members, ["n_nationkey"], F.col("c_custkey"), "ids").join(t.nation, "n_nationkey")
    return annotate.id_mapping(
        t.orders.select("o_orderkey", "o_custkey"), mapping, "o_custkey", "ids", F.col("n_name"), "n_name"
    ).drop("o_custkey")


# ---- hierarchies ---------------------------------------------------------------


def world_edges(t):
    """Nation to region to root."""
    nation = t.nation.select(
        F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent")
    )
    region = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("child"), F.lit("ROOT").alias("parent"))
    return nation.unionByName(region)


_EDGES = """
    SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation
    UNION ALL SELECT 'R' || r_regionkey, 'ROOT' FROM region"""


def _closure_sql(edges: str) -> str:
    return f"""
    WITH RECURSIVE e AS (SELECT DISTINCT child, parent FROM ({edges}) WHERE child <> parent),
    c AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e
          UNION SELECT c.node, e.parent, c.depth + 1 FROM c JOIN e ON e.child = c.ancestor)
    SELECT node, ancestor, min(depth)::INTEGER AS depth FROM c GROUP BY node, ancestor"""


_ALL_EDGES = f"""{_EDGES}
    UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
    UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders"""


@query(_closure_sql(_ALL_EDGES))
def hierarchy_closure(t):
    customers = t.customer.select(
        F.concat(F.lit("C"), "c_custkey").alias("child"), F.concat(F.lit("N"), "c_nationkey").alias("parent")
    )
    orders = t.orders.select(
        F.concat(F.lit("O"), "o_orderkey").alias("child"), F.concat(F.lit("C"), "o_custkey").alias("parent")
    )
    edges = world_edges(t).unionByName(customers).unionByName(orders)
    return graph.hierarchy_closure(edges, "child", "parent")


def page_edges(t):
    """Path tree of the page addresses, every folder below its parent."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    parts = F.split(F.regexp_replace(path, "/$", ""), "/")
    steps = t.pages.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(2), F.size("p"))).alias("n"))
    return steps.select(
        F.array_join(F.slice("p", 1, F.col("n")), "/").alias("child"),
        F.array_join(F.slice("p", 1, F.col("n") - 1), "/").alias("parent"),
    )


_PAGE_EDGES = r"""
    SELECT array_to_string(p[1:n], '/') AS child, array_to_string(p[1:n - 1], '/') AS parent FROM (
      SELECT p, unnest(range(2, len(p) + 1)) AS n FROM (
        SELECT string_split(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/$', ''), '/') AS p
        FROM pages))"""


@query(_closure_sql(_PAGE_EDGES))
def hierarchy_closure_of_paths(t):
    return graph.hierarchy_closure(page_edges(t), "child", "parent")


@query(
    f"""
    SELECT s_suppkey, 'N' || s_nationkey AS disease, ancestor, depth FROM supplier JOIN (
      SELECT node, ancestor, depth FROM ({_closure_sql(_EDGES)})
      UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey, 0 FROM nation) ON node = 'N' || s_nationkey
    """
)
def project_disease(t):
    closure = graph.hierarchy_closure(world_edges(t), "child", "parent")
    mapping = t.supplier.select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("disease"))
    return graph.project_disease(t.supplier.select("s_suppkey"), mapping, closure, on="s_suppkey", disease="disease")


@query(
    """
    SELECT DISTINCT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey OR s_nationkey = n_regionkey
    """
)
def disease_phenotypes(t):
    terms = t.nation.select("n_name", F.array("n_nationkey", "n_regionkey").alias("refs"))
    return graph.disease_phenotypes(
        terms, t.supplier, term="n_name", references="refs", on="s_nationkey", phenotype="s_name",
    )
