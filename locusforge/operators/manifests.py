"""Tracking of per-study inputs: what is new, failed, changed or duplicated."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.functions.paths import base_name
from locusforge.operators.scale import null_safe_join

# The three states of a study.
STATUSES = ("pending", "failure", "success")


def make_manifest_rows(
    raw: DataFrame,
    common_path: str,
    study: str = "studyId",
    raw_path: str = "rawPath",
    harmonised: str = "harmonised",
    qc: str = "qc",
) -> DataFrame:
    """One pending manifest per new study, all paths below ``common_path``."""
    folder = F.concat_ws("/", F.lit(common_path), F.col(study).cast("string"))
    return raw.select(
        F.col(study).alias("studyId"),
        F.col(raw_path).alias("rawPath"),
        F.concat_ws("/", folder, F.lit("manifest.json")).alias("manifestPath"),
        F.concat_ws("/", folder, F.lit(harmonised)).alias("harmonisedPath"),
        F.concat_ws("/", folder, F.lit(qc)).alias("qcPath"),
        F.lit(False).alias("passHarmonisation"),
        F.lit(False).alias("passQc"),
        F.lit("pending").alias("status"),
    )


def filter_any_flag_false(df: DataFrame, prefix: str = "pass", multiplicity: bool = False) -> DataFrame:
    """Rows with a flag that is false or null.

    With ``multiplicity`` a row comes once per failing flag.
    """
    failing = [~F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in df.columns if c.startswith(prefix)]
    if not failing:
        return df.where(F.lit(False))
    if not multiplicity:
        return df.where(reduce(lambda a, b: a | b, failing))
    count = reduce(lambda a, b: a + b, [f.cast("int") for f in failing])
    return (
        df.withColumn("__copies", count)
        .where(F.col("__copies") > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .drop("__copies", "__copy")
    )


def split_by_status(
    df: DataFrame, status: str = "status", values: Sequence[str] = STATUSES
) -> dict[str, DataFrame]:
    """One lazy frame per known status; a row of any other status is in none."""
    return {v: df.where(F.col(status) == v) for v in values}


def status_summary(df: DataFrame, status: str = "status", values: Sequence[str] = STATUSES) -> DataFrame:
    """Counts per status and the total, in one pass."""
    return df.agg(
        *[F.count_if(F.col(status) == v).cast("bigint").alias(f"n_{v}") for v in values],
        F.count(F.lit(1)).cast("bigint").alias("n_total"),
    )


def choose_manifests(
    new: DataFrame, existing: DataFrame, mode: str, failed: Column | None = None
) -> DataFrame:
    """Mode CONTINUE takes the new rows, any other mode the failed existing ones."""
    if mode == "CONTINUE":
        return new
    return existing.where(failed) if failed is not None else filter_any_flag_false(existing)


def locus_rows(
    loci: DataFrame, key: str, input_path: str, output_path: str, log_path: str, partition: str = "studyLocusId"
) -> DataFrame:
    """Input, output and log path per locus; only the input keeps ``partition=``."""
    bare = F.regexp_replace(F.col(key), f"^{partition}=", "")
    return loci.select(F.col(key)).distinct().select(
        F.concat(F.lit(input_path + "/"), F.col(key)).alias("study_locus_input"),
        F.concat(F.lit(output_path + "/"), bare).alias("study_locus_output"),
        F.concat(F.lit(log_path + "/"), bare).alias("log_output"),
    )


def io_name_pairs(files: DataFrame, path: str, old: str = ".vcf", new: str = ".json") -> DataFrame:
    """Distinct input base names with the output name made from each."""
    return (
        files.select(base_name(F.col(path)).alias("input_file"))
        .distinct()
        .withColumn("output_file", F.replace(F.col("input_file"), F.lit(old), F.lit(new)))
    )


def keep_with_files(studies: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Studies that have a statistics file."""
    return studies.join(listing.select(key), key, "left_semi")


def exclude_sources(df: DataFrame, column: str, excluded: Sequence[str]) -> DataFrame:
    """Drop rows of the listed sources; an empty list drops nothing."""
    return df.where(~F.col(column).isin(*excluded)) if excluded else df


def rebuild_study_id(df: DataFrame, parts: Sequence[str], out: str = "studyId") -> DataFrame:
    """New id from several columns, for studies that share one statistics file."""
    return df.withColumn(out, F.concat_ws("_", *[F.col(p).cast("string") for p in parts]))


def new_studies(raw: DataFrame, known: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not known yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return raw.join(known.select(*keys), keys, "left_anti")


def changed_rows(local: DataFrame, remote: DataFrame | None, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose compared columns differ, with the kind of change.

    Without a remote copy every row is new.
    """
    if remote is None:
        return local.select(key, F.lit("added").alias("change"))
    left = local.select(key, F.struct(*columns).alias("__l"))
    right = remote.select(key, F.struct(*columns).alias("__r"))
    return (
        left.join(right, key, "full_outer")
        .where(~F.col("__l").eqNullSafe(F.col("__r")))
        .select(
            key,
            F.when(F.col("__r").isNull(), "added")
            .when(F.col("__l").isNull(), "removed")
            .otherwise("changed")
            .alias("change"),
        )
    )


def inclusion_join(df: DataFrame, listed: DataFrame, on: str, listed_key: str) -> DataFrame:
    """Rows whose key is on the inclusion list."""
    return df.join(listed.select(F.col(listed_key).alias(on)), on, "left_semi")


def exclusion_join(df: DataFrame, listed: DataFrame, on: str, listed_key: str) -> DataFrame:
    """Rows whose key is not on the exclusion list."""
    return df.join(listed.select(F.col(listed_key).alias(on)), on, "left_anti")


def curation_update(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Curated rows as they are, then the studies seen for the first time."""
    return existing.unionByName(new_studies(new, existing, key), allowMissingColumns=True)


def last_per_key(df: DataFrame, key: str, value: str, order: Sequence[Column], out: str) -> DataFrame:
    """Value of the last row per key."""
    return df.groupBy(key).agg(
        F.max_by(F.col(value), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias(out)
    )


def duplicate_targets(df: DataFrame, column: str) -> DataFrame:
    """Values used more than once, with their counts."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Set of left keys that are not right keys."""
    return left.select(key).subtract(right.select(key))


def distinct_names(df: DataFrame, path: str, out: str = "name") -> DataFrame:
    """Distinct base names."""
    return df.select(base_name(F.col(path)).alias(out)).distinct()


def duplicate_flag(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Flag every row whose key occurs more than once.

    Counting by aggregation and joining the repeated keys back keeps a key with
    very many rows from landing in one window task.
    """
    repeated = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > 1)
        .withColumn("__dup", F.lit(True))
        .drop("__n")
    )
    return null_safe_join(df, repeated, keys, "left").withColumn(
        out, F.coalesce(F.col("__dup"), F.lit(False))
    ).drop("__dup")
