"""Joins that annotate studies, statistics and variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.operators.loci import expand_ld
from locusforge.operators.scale import first_by, nest_rows
from locusforge.operators.validation import palindromic

# Population codes of the LD index.
LD_POPULATIONS = ("afr", "amr", "asj", "eas", "est", "fin", "nfe", "nwe", "seu")


def study_ancestry_join(
    studies: DataFrame, ancestries: DataFrame, key: str, item: Column, out: str = "ancestries"
) -> DataFrame:
    """Studies with their ancestries collected; studies without any are kept."""
    return studies.join(nest_rows(ancestries, [key], item, out), key, "left")


def map_to_variants(
    associations: DataFrame, variants: DataFrame, on: Mapping[str, str], columns: Sequence[str], flag: str = "non_mapped"
) -> DataFrame:
    """Associations with the known variant; unmapped ones are flagged, not dropped."""
    side = variants.select(*[F.col(v).alias(f"__{v}") for v in on.values()], *columns, F.lit(True).alias("__hit"))
    condition = None
    for a, v in on.items():
        c = F.col(a) == F.col(f"__{v}")
        condition = c if condition is None else condition & c
    return (
        associations.join(side, condition, "left")
        .withColumn(flag, F.col("__hit").isNull())
        .drop("__hit", *[f"__{v}" for v in on.values()])
    )


def _allele_offers(
    variants: DataFrame, position: Sequence[str], ref: str, alt: str, variant_id: str
) -> tuple[DataFrame, Column]:
    """Each variant under its alleles in both orders, one offer per position and order, and the condition that meets it."""
    direct = F.struct(F.col(ref).alias("__ref"), F.col(alt).alias("__alt"), F.lit(False).alias("flipped"))
    swapped = F.struct(F.col(alt).alias("__ref"), F.col(ref).alias("__alt"), F.lit(True).alias("flipped"))
    ways = F.array_compact(F.array(direct, F.when(F.col(ref) != F.col(alt), swapped)))
    offered = variants.select(*position, variant_id, F.explode(ways).alias("__way")).select(
        *position, variant_id, "__way.*"
    )
    # the direct offer of an order goes first
    offers = first_by(offered, [*position, "__ref", "__alt"], [F.col("flipped"), F.col(variant_id)])
    renamed = offers.select(*[F.col(p).alias(f"__p_{p}") for p in position], "__ref", "__alt", variant_id, "flipped")
    condition = (F.col(ref) == F.col("__ref")) & (F.col(alt) == F.col("__alt"))
    for p in position:
        condition = condition & (F.col(p) == F.col(f"__p_{p}"))
    return renamed, condition


def unmatched_sumstats(
    raw: DataFrame, variants: DataFrame, *, position: Sequence[str], ref: str, alt: str, variant_id: str
) -> DataFrame:
    """The statistics that ``harmonise_sumstats`` finds no variant for, in either allele order; nulls match nothing."""
    offers, condition = _allele_offers(variants, position, ref, alt, variant_id)
    return raw.join(offers, condition, "left_anti")


def harmonise_sumstats(
    raw: DataFrame,
    variants: DataFrame,
    *,
    position: Sequence[str],
    ref: str,
    alt: str,
    beta: str,
    variant_id: str,
) -> DataFrame:
    """Match statistics to known variants in direct or swapped allele order.

    Both orders are tried through one equi join: each variant is offered under
    its alleles in both orders. A direct match wins over a swapped one; a
    swapped match changes the sign of the effect and the alleles. Palindromic
    pairs are flagged. Statistics without a known variant are not in the
    result; ``unmatched_sumstats`` has them.
    """
    offers, condition = _allele_offers(variants, position, ref, alt, variant_id)
    return (
        raw.join(offers, condition, "inner")
        .withColumn(beta, F.when(F.col("flipped"), -F.col(beta)).otherwise(F.col(beta)))
        .withColumn("palindromic", palindromic(F.col(ref), F.col(alt)))
        .withColumn("__swap", F.col(ref))
        .withColumn(ref, F.when(F.col("flipped"), F.col(alt)).otherwise(F.col(ref)))
        .withColumn(alt, F.when(F.col("flipped"), F.col("__swap")).otherwise(F.col(alt)))
        .drop("__ref", "__alt", "__swap", *[f"__p_{p}" for p in position])
    )


def annotate_scores(variants: DataFrame, tables: Sequence[tuple[DataFrame, Mapping[str, str], Sequence[str]]]) -> DataFrame:
    """Left joins to score tables, each with its key mapping and columns.

    A score table has one row per key; rows of the variants never multiply.
    """
    out = variants
    for number, (table, on, columns) in enumerate(tables):
        side = table.select(*[F.col(t).alias(f"__{number}_{t}") for t in on.values()], *columns)
        condition = None
        for v, t in on.items():
            c = F.col(v) == F.col(f"__{number}_{t}")
            condition = c if condition is None else condition & c
        out = out.join(side, condition, "left").drop(*[f"__{number}_{t}" for t in on.values()])
    return out


def pick_consequence(df: DataFrame, keys: Sequence[str], curated: str, canonical: str, tie: Sequence[str]) -> DataFrame:
    """One consequence per (variant, gene): curated transcript first, then canonical."""
    order = [
        F.when(F.col(curated), F.lit(0)).otherwise(F.lit(1)),
        F.when(F.col(canonical), F.lit(0)).otherwise(F.lit(1)),
        *[F.col(t) for t in tie],
    ]
    return first_by(df, keys, order)


def variant_index(
    variants: DataFrame, consequences: DataFrame, frequencies: DataFrame, key: str, consequence: Column, frequency: Column
) -> DataFrame:
    """One row per variant with consequences and allele frequencies as arrays."""
    c = nest_rows(consequences, [key], consequence, "consequences")
    f = nest_rows(frequencies, [key], frequency, "frequencies")
    nested = c.join(f, [key, "part"], "full_outer")
    return variants.join(nested, key, "left")


def ld_index_build(
    entries: DataFrame,
    variants: DataFrame,
    *,
    row: str,
    column: str,
    r: str,
    population: str,
    index: str,
    variant_id: str,
    min_r2: float = 0.0,
) -> DataFrame:
    """Per variant and population the sorted array of its LD partners.

    Matrix entries are stored once per pair; they are cut by r2 first, resolved
    to variant ids on both sides, and only then expanded to both directions.
    """
    a = variants.select(F.col(index).alias(row), F.col(variant_id).alias("__a"))
    b = variants.select(F.col(index).alias(column), F.col(variant_id).alias("__b"))
    pairs = (
        entries.where((F.col(r) * F.col(r) >= min_r2) & (F.col(row) != F.col(column)))
        .join(a, row)
        .join(b, column)
        .select("__a", "__b", F.col(r).alias("r"), F.col(population).alias("population"))
    )
    both = expand_ld(pairs, "__a", "__b", "r", "population")
    return nest_rows(both, ["variant", "population"], F.struct("tag", "r"), "ldSet")


def id_mapping(df: DataFrame, mapping: DataFrame, on: str, old: str, new: Column, out: str) -> DataFrame:
    """Translate identifiers; rows without a translation keep null.

    The old id may be an array column of the map, which is exploded first.
    """
    kind = mapping.schema[old].dataType.typeName()
    ids = F.explode(old) if kind == "array" else F.col(old)
    side = mapping.select(ids.alias("__old"), new.alias(out)).distinct()
    return df.join(side, F.col(on) == F.col("__old"), "left").drop("__old")


def ingest_study_index(
    rows: DataFrame,
    *,
    study: Column,
    project: str,
    study_type: str,
    trait: Column,
    statistics_path: Column,
    samples: int | None = None,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Source rows as study-index rows of one project."""
    return rows.select(
        study.alias("studyId"),
        F.lit(project).alias("projectId"),
        F.lit(study_type).alias("studyType"),
        trait.alias("trait"),
        F.lit(samples).cast("bigint").alias("nSamples"),
        statistics_path.alias("summarystatsLocation"),
        *[v.alias(k) for k, v in (extra or {}).items()],
    )


def ingest_study_locus(
    snps: DataFrame,
    summary: DataFrame,
    *,
    on: Sequence[str],
    study: Column,
    lead_strength: str,
    threshold: float,
    method: str,
) -> DataFrame:
    """Credible-set members of the sets whose lead passes the threshold."""
    passing = summary.where(F.col(lead_strength) >= threshold).select(*on, lead_strength)
    return snps.join(passing, list(on)).select(
        study.alias("studyId"), F.lit(method).alias("finemappingMethod"), *snps.columns, lead_strength
    )
