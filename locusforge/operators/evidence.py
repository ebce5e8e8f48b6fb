"""Drug-target release tables: evidence, associations, drugs, targets, search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusforge.functions.stats import inverse_squares
from locusforge.operators.annotate import id_mapping
from locusforge.operators.scale import first_by, nest_rows, null_safe_join, running_total
from locusforge.operators.variants import union_sources
from locusforge.session import cut_lineage


def evidence_union(
    sources: Mapping[str, DataFrame], id_columns: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """All sources by name, with an id from the content, each id once."""
    named = [df.withColumn("datasourceId", F.lit(name)) for name, df in sources.items()]
    rows = union_sources(named)
    key = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_columns]), 256)
    return first_by(rows.withColumn("id", key), ["id"], order)


def harmonic_association(
    evidence: DataFrame,
    keys: Sequence[str],
    source: str,
    score: str,
    scaling_ranks: int = 50,
) -> DataFrame:
    """Harmonic sums of ranked scores per source, then over the sources of a pair.

    Scores are ranked per (pair, source); every one weighs ``score / rank^2``
    (Koscielny et al. 2017), and the sum is divided by what ``scaling_ranks``
    scores of one would give. Equal scores take neighbouring ranks, so rows are
    first counted per score, which combines on the map side; the ranks of a
    score follow from a running total of these counts, and their weights from
    a closed form. A pair has few sources, so the second ranking is a window
    over those.
    """
    top = sum(1.0 / (i * i) for i in range(1, scaling_ranks + 1))
    keys = list(keys)
    runs = evidence.groupBy(*keys, source, score).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_total(runs, [*keys, source], [F.col(score).desc()], F.col("__n"), "__to")
    weight = inverse_squares(F.col("__to")) - inverse_squares(F.col("__to") - F.col("__n"))
    per_source = ranked.groupBy(*keys, source).agg(
        (F.sum(F.col(score) * weight) / F.lit(top)).alias("source_score"), F.sum("__n").alias("n_evidence")
    )
    w = Window.partitionBy(*keys).orderBy(F.col("source_score").desc(), F.col(source))
    place = F.row_number().over(w)
    return (
        per_source.withColumn("__place", place)
        .groupBy(*keys)
        .agg(
            (F.sum(F.col("source_score") / (F.col("__place") * F.col("__place"))) / F.lit(top)).alias("score"),
            F.sum("n_evidence").alias("n_evidence"),
            F.count(F.lit(1)).alias("n_sources"),
        )
    )


def propagate(evidence: DataFrame, closure: DataFrame, disease: str) -> DataFrame:
    """Evidence also under every ancestor of its disease.

    The ancestors of a term, bounded by its ontology, are gathered first, so the
    evidence is read and joined once and no row is lost.
    """
    up = closure.groupBy(F.col("node").alias("__node")).agg(F.collect_set("ancestor").alias("__up"))
    own = F.array(F.col(disease))
    places = F.when(F.col("__up").isNull(), own).otherwise(F.array_union(own, F.col("__up")))
    columns = [F.explode(places).alias(c) if c == disease else F.col(c) for c in evidence.columns]
    return evidence.join(up, F.col(disease) == F.col("__node"), "left").select(*columns)


def expression_summary(
    df: DataFrame, gene: str, tissue: str, value: str, bins: int = 10, low: float = -3.0, high: float = 3.0
) -> DataFrame:
    """Mean per (gene, tissue) with its z-score inside the tissue and the bin of that."""
    means = cut_lineage(
        df.groupBy(gene, tissue).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    )
    spread = means.groupBy(tissue).agg(F.avg("mean_value").alias("__avg"), F.stddev_samp("mean_value").alias("__sd"))
    z = (F.col("mean_value") - F.col("__avg")) / F.col("__sd")
    return (
        null_safe_join(means, spread, [tissue])
        .withColumn("zscore", F.when(F.col("__sd") > 0, z))
        .withColumn("bin", F.width_bucket("zscore", F.lit(low), F.lit(high), F.lit(bins)))
        .drop("__avg", "__sd")
    )


def expression_by_gene(summary: DataFrame, gene: str, tissue: str) -> DataFrame:
    """Tissues of each gene as one array."""
    return nest_rows(summary, [gene], F.struct(tissue, "mean_value", "zscore", "bin"), "tissues")


def interaction_edges(sources: Mapping[str, DataFrame], a: str, b: str, score: str) -> DataFrame:
    """Unordered pairs over all sources with evidence count, source count and best score.

    Sources are counted by a flag each: a distinct count would keep every (pair, source) in a first aggregate.
    """
    held = [F.max((F.col("source") == name).cast("bigint")) for name in sources]
    rows = union_sources([df.select(a, b, score, F.lit(n).alias("source")) for n, df in sources.items()])
    return (
        rows.select(F.least(a, b).alias("geneA"), F.greatest(a, b).alias("geneB"), score, "source")
        .groupBy("geneA", "geneB")
        .agg(
            F.count(F.lit(1)).alias("n_evidence"),
            sum(held[1:], held[0]).alias("n_sources"),
            F.max(score).alias("max_score"),
        )
    )


def adverse_event_llr(reports: DataFrame, report: str, drug: str, event: str) -> DataFrame:
    """Log-likelihood ratio per drug and event (Huang et al. 2011).

    Reports are reduced to distinct (report, drug, event) before counting, and
    the marginals are aggregates joined back instead of windows, as one event
    may hold most of the reports. The counted cells feed four consumers and are
    materialised, so the reports are read once.
    """
    known = reports.where(F.col(drug).isNotNull() & F.col(event).isNotNull())
    cells = cut_lineage(
        known.select(report, drug, event).distinct().groupBy(drug, event).agg(F.count(F.lit(1)).alias("n_ij"))
    )
    by_event = cells.groupBy(event).agg(F.sum("n_ij").alias("n_i"))
    by_drug = cells.groupBy(drug).agg(F.sum("n_ij").alias("n_j"))
    total = cells.agg(F.sum("n_ij")).scalar()
    rows = cells.join(by_event, event).join(by_drug, drug).withColumn("n_total", total)
    n, nj = F.col("n_ij").cast("double"), F.col("n_j").cast("double")
    expected = F.col("n_i").cast("double") * nj / F.col("n_total").cast("double")
    rest = F.when(nj > n, (nj - n) * F.log((nj - n) / (nj - expected))).otherwise(F.lit(0.0))
    return rows.withColumn("llr", F.when(n > expected, n * F.log(n / expected) + rest).otherwise(F.lit(0.0)))


def drug_table(
    molecules: DataFrame,
    key: str,
    nested: Mapping[str, tuple[DataFrame, Column]],
    parent: str | None = None,
) -> DataFrame:
    """One row per drug with nested arrays; a drug with very long arrays has several parts.

    With ``parent`` the children's rows go to the parent molecule.
    """
    heads = molecules
    link = None
    if parent:
        link = molecules.select(F.col(key).alias("__child"), F.coalesce(F.col(parent), F.col(key)).alias("__root"))
        heads = molecules.where(F.col(parent).isNull() | (F.col(parent) == F.col(key)))
    frames = []
    for name, (df, item) in nested.items():
        if link is not None:
            df = (
                df.join(link, F.col(key) == F.col("__child"))
                .drop(key, "__child")
                .withColumnRenamed("__root", key)
            )
        frames.append(nest_rows(df, [key], item, name))
    arrays = reduce(lambda x, y: x.join(y, [key, "part"], "full_outer"), frames)
    return heads.join(arrays, key, "left").withColumn("part", F.coalesce("part", F.lit(0)))


def known_drug(
    evidence: DataFrame, drugs: DataFrame, targets: DataFrame, diseases: DataFrame, *, drug: str, target: str,
    disease: str, phase: str,
) -> DataFrame:
    """Drug, target and disease with the highest phase and the evidence count.

    Evidence is counted before the joins, so only one row per triple is joined.
    """
    triples = evidence.groupBy(drug, target, disease).agg(
        F.max(phase).alias("max_phase"), F.count(F.lit(1)).alias("n_evidence")
    )
    return triples.join(drugs, drug).join(targets, target).join(diseases, disease)


def target_table(sources: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Merge of sources that have one row per key; a key of any source is kept."""
    return reduce(lambda x, y: x.join(y, key, "full_outer"), sources.values())


def homologues(
    dictionaries: Mapping[str, DataFrame], homologies: Sequence[DataFrame], gene: str
) -> DataFrame:
    """Gene dictionaries of all species joined to protein and non-coding homologies."""
    genes = union_sources([df.withColumn("species", F.lit(n)) for n, df in dictionaries.items()])
    return genes.join(union_sources(homologies), gene)


def prioritise_targets(targets: DataFrame, features: Sequence[DataFrame], key: str) -> DataFrame:
    """Wide frame of one row per target."""
    return reduce(lambda x, y: x.join(y, key, "left"), features, targets)


def search_documents(entities: DataFrame, key: str, keywords: Sequence[DataFrame], keyword: str) -> DataFrame:
    """One document per entity with its distinct keywords, in parts where they are very many."""
    words = union_sources([k.select(key, keyword) for k in keywords]).where(F.col(keyword).isNotNull()).distinct()
    return entities.join(nest_rows(words, [key], F.col(keyword), "keywords"), key, "left")


def facet_documents(df: DataFrame, facets: Sequence[str], entity: str) -> DataFrame:
    """Distinct entities per facet value."""
    stack = F.explode(
        F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    )
    return (
        df.select(entity, stack.alias("f"))
        .where(F.col("f.value").isNotNull())
        .select("f.facet", "f.value", entity)
        .distinct()
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("n_entities"))
    )


def ebi_documents(associations: DataFrame, targets: DataFrame, diseases: DataFrame, *, target: str, disease: str) -> DataFrame:
    """Flat association documents with names of both sides."""
    return associations.join(targets, target).join(diseases, disease)


def association_facts(evidence: DataFrame, columns: Sequence[str], facets: Mapping[str, Column]) -> DataFrame:
    """Row-level facts: plain columns plus facet texts, ready to be aggregated on demand."""
    return evidence.select(*columns, *[c.alias(n) for n, c in facets.items()])


def write_association_facts(facts: DataFrame, path: str, target: str, order: Sequence[str]) -> None:
    """Facts clustered by target, so that a lookup of one target reads few files.

    The further columns of the order spread a target of very many facts over as many tasks and files as it needs.
    """
    keys = [target, *order]
    facts.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def gene_index(targets: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per gene."""
    return first_by(targets, [key], order)


def biosample_index(ontologies: Sequence[DataFrame], key: str, name: str, synonyms: str) -> DataFrame:
    """Merge of ontologies in order of priority: first known name, union of synonyms.

    The array of a term is bounded by its distinct synonyms.
    """
    rows = union_sources([df.withColumn("__priority", F.lit(i)) for i, df in enumerate(ontologies)])
    names = rows.where(F.col(name).isNotNull()).groupBy(key).agg(F.min_by(name, "__priority").alias(name))
    words = rows.select(key, F.explode_outer(synonyms).alias("__s")).distinct()
    merged = nest_rows(words.where(F.col("__s").isNotNull()), [key], F.col("__s"), synonyms)
    return rows.select(key).distinct().join(names, key, "left").join(merged, key, "left")


def literature_ids(df: DataFrame, mapping: DataFrame, on: str, old: str, new: str, out: str) -> DataFrame:
    """Publication ids through a translation table."""
    return id_mapping(df, mapping, on, old, F.col(new), out)
