"""Quality reasons per row and the valid / invalid split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.operators.manifests import duplicate_flag

# The reasons that make a row invalid.
STUDY_REASONS = (
    "UNRESOLVED_TARGET",
    "UNRESOLVED_DISEASE",
    "UNKNOWN_STUDY_TYPE",
    "DUPLICATED_STUDY",
    "UNKNOWN_BIOSAMPLE",
)
CREDIBLE_SET_REASONS = (
    "DUPLICATED_STUDYLOCUS_ID",
    "AMBIGUOUS_STUDY",
    "FAILED_STUDY",
    "MISSING_STUDY",
    "NO_GENOMIC_LOCATION_FLAG",
    "COMPOSITE_FLAG",
    "INCONSISTENCY_FLAG",
    "PALINDROMIC_ALLELE_FLAG",
    "SUBSIGNIFICANT_FLAG",
    "LD_CLUMPED",
    "IN_MHC",
    "REDUNDANT_PICS_TOP_HIT",
    "EXPLAINED_BY_SUSIE",
    "WINDOW_CLUMPED",
    "NON_MAPPED_VARIANT_FLAG",
)
# Allele pairs that read the same on both strands.
PALINDROMES = ("AT", "TA", "CG", "GC")


def palindromic(ref: Column, alt: Column) -> Column:
    """Whether an allele pair reads the same on both strands."""
    return F.concat(ref, alt).isin(*PALINDROMES)


def qc_flags(df: DataFrame, rules: Mapping[str, Column], out: str = "qualityControls") -> DataFrame:
    """Array of the reasons whose rule holds, in the order of the rules.

    Slices of one reason or none put together are compiled, rules included; a
    filter of an array would have all of them interpreted.
    """
    held = [F.slice(F.array(F.lit(name)), F.lit(1), F.when(rule, 1).otherwise(0)) for name, rule in rules.items()]
    return df.withColumn(out, F.concat(*held))


def is_invalid(reasons: Column, invalid: Sequence[str]) -> Column:
    """True when a row carries one of the configured reasons."""
    return F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in invalid]))


def split_valid(
    df: DataFrame, invalid: Sequence[str], reasons: str = "qualityControls"
) -> tuple[DataFrame, DataFrame]:
    """Valid rows and invalid rows."""
    bad = is_invalid(F.col(reasons), invalid)
    return df.where(~bad), df.where(bad)


def resolve(df: DataFrame, index: DataFrame, on: str, index_key: str, out: str) -> DataFrame:
    """Add a flag that is true when the value is set but unknown to the index.

    The index is reduced to its distinct keys; whether it is broadcast is left
    to the size statistics of the optimiser.
    """
    known = index.select(F.col(index_key).alias("__known")).distinct()
    return (
        df.join(known, F.col(on) == F.col("__known"), "left")
        .withColumn(out, F.col(on).isNotNull() & F.col("__known").isNull())
        .drop("__known")
    )


def validate_study(
    studies: DataFrame,
    genes: DataFrame,
    diseases: DataFrame,
    biosamples: DataFrame,
    *,
    study: Sequence[str],
    gene: tuple[str, str],
    disease: tuple[str, str],
    biosample: tuple[str, str],
    study_type: str,
    known_types: Sequence[str],
) -> DataFrame:
    """Quality reasons of studies against the three indexes."""
    df = resolve(studies, genes, *gene, "__no_gene")
    df = resolve(df, diseases, *disease, "__no_disease")
    df = resolve(df, biosamples, *biosample, "__no_biosample")
    df = duplicate_flag(df, study, "__repeated")
    flagged = qc_flags(
        df,
        {
            "UNRESOLVED_TARGET": F.col("__no_gene"),
            "UNRESOLVED_DISEASE": F.col("__no_disease"),
            "UNKNOWN_STUDY_TYPE": F.col(study_type).isNull() | ~F.col(study_type).isin(*known_types),
            "DUPLICATED_STUDY": F.col("__repeated"),
            "UNKNOWN_BIOSAMPLE": F.col("__no_biosample"),
        },
    )
    return flagged.drop("__no_gene", "__no_disease", "__no_biosample", "__repeated")


def target_validation(
    df: DataFrame, targets: DataFrame, on: str, target_key: str
) -> tuple[DataFrame, DataFrame]:
    """Rows with a known target and rows without."""
    known = targets.select(F.col(target_key).alias(on)).distinct()
    return df.join(known, on, "left_semi"), df.join(known, on, "left_anti")


def pgx_join(df: DataFrame, drugs: DataFrame, on: str, drug_key: str, drug_columns: Sequence[str]) -> DataFrame:
    """Keep every row, add drug columns and whether the drug is known."""
    side = drugs.select(F.col(drug_key).alias("__drug"), *drug_columns)
    return (
        df.join(side, F.col(on) == F.col("__drug"), "left")
        .withColumn("drug_known", F.col("__drug").isNotNull())
        .drop("__drug")
    )


def study_inclusion(
    studies: DataFrame, criteria: str, curated: Column, has_statistics: Column
) -> tuple[DataFrame, DataFrame]:
    """Inclusion and exclusion lists by criteria ``curation`` or ``summary_stats``.

    A row for which the criterion is unknown is in neither list.
    """
    if criteria not in ("curation", "summary_stats"):
        raise ValueError(f"unknown criteria: {criteria}")
    rule = curated if criteria == "curation" else has_statistics
    return studies.where(rule), studies.where(~rule)
