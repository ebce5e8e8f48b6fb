"""Merging, deduplicating, ordering and chunking of variant tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusforge.operators.scale import first_by, row_numbers

# The columns of a variant file and the sizes of chunks.
VARIANT_SCHEMA = T.StructType(
    [
        T.StructField("#CHROM", T.StringType()),
        T.StructField("POS", T.LongType()),
        T.StructField("ID", T.StringType()),
        T.StructField("REF", T.StringType()),
        T.StructField("ALT", T.StringType()),
        T.StructField("QUAL", T.StringType()),
        T.StructField("FILTER", T.StringType()),
        T.StructField("INFO", T.StringType()),
    ]
)
VARIANT_KEYS = ("#CHROM", "POS", "REF", "ALT")
VARIANT_CHUNK = 2000
LOCUS_CHUNK = 100_000


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns a frame lacks are null."""
    head, *rest = frames
    for frame in rest:
        head = head.unionByName(frame, allowMissingColumns=True)
    return head


def source_sizes(df: DataFrame, source: str) -> DataFrame:
    """Rows per source."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key; the order decides which, so the result is repeatable."""
    return first_by(df, keys, order)


def sort_variants(df: DataFrame, keys: Sequence[str] = VARIANT_KEYS) -> DataFrame:
    """Order by chromosome as text, then position, then alleles; nulls last."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def merge_variants(
    frames: Sequence[DataFrame],
    keys: Sequence[str] = VARIANT_KEYS,
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """Union and the first whole row per key, by the tie-break or else by all other columns in turn."""
    rows = union_sources(frames)
    return dedup_first(rows, keys, tie_break or [F.col(c) for c in rows.columns if c not in keys])


def chunk_sorted(
    df: DataFrame, order: Sequence[Column], n: int = VARIANT_CHUNK, chunk: str = "chunk", row: str = "row"
) -> DataFrame:
    """0-based row number over the whole ordered frame and its chunk of ``n`` rows."""
    if n < 1:
        raise ValueError("chunk size must be positive")
    numbered = row_numbers(df, [], order, "__rn")
    return (
        numbered.withColumn(row, F.col("__rn") - 1)
        .withColumn(chunk, F.floor((F.col("__rn") - 1) / n).cast("bigint"))
        .drop("__rn")
    )


def row_range_chunks(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Chunks with the label ``first-last`` of their nominal 1-based row range."""
    first = F.col("chunk") * n + 1
    return chunk_sorted(df, order, n).withColumn(
        "label", F.concat_ws("-", first.cast("string"), (first + n - 1).cast("string"))
    )


def index_in_chunk(df: DataFrame, n: int, out: str = "locus_index") -> DataFrame:
    """0-based position inside the chunk, from the global row number."""
    return df.withColumn(out, F.col("row") - F.col("chunk") * n)


def chunk_rows(df: DataFrame, order: Sequence[Column], max_rows: int = LOCUS_CHUNK) -> DataFrame:
    """Chunks of at most ``max_rows``; an empty frame stays empty."""
    return chunk_sorted(df, order, max_rows)


def chunk_counts(df: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Rows per chunk."""
    return df.groupBy(chunk).agg(F.count(F.lit(1)).alias("n"))


def chunk_check(df: DataFrame, n: int, chunk: str = "chunk") -> DataFrame:
    """One row: chunks found, chunks expected from the row count, and whether they agree."""
    return (
        chunk_counts(df, chunk)
        .agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
        .withColumn("expected", F.ceil(F.col("n_rows") / n).cast("bigint"))
        .withColumn("ok", F.col("n_chunks") == F.col("expected"))
    )


def chunk_descriptors(df: DataFrame, prefix: str, chunk: str = "chunk") -> DataFrame:
    """Index, folder below the prefix and row count of each chunk."""
    return chunk_counts(df, chunk).select(
        F.col(chunk).alias("idx"),
        F.concat(F.lit(f"{prefix}/{chunk}="), F.col(chunk).cast("string")).alias("path"),
        "n",
    )


def variant_chunks(df: DataFrame, n: int = VARIANT_CHUNK, keys: Sequence[str] = VARIANT_KEYS) -> DataFrame:
    """Ordered chunks with row count and first and last chromosome and position."""
    order = [F.col(k).asc_nulls_last() for k in keys]
    chrom, pos = keys[0], keys[1]
    at = F.struct(F.col(chrom).alias("chrom"), F.col(pos).alias("pos"))
    return (
        chunk_sorted(df.select(*keys), order, n)
        .groupBy("chunk")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by(at, F.col("row")).alias("__first"),
            F.max_by(at, F.col("row")).alias("__last"),
        )
        .select(
            "chunk",
            "n",
            F.col("__first.chrom").alias("first_chrom"),
            F.col("__first.pos").alias("first_pos"),
            F.col("__last.chrom").alias("last_chrom"),
            F.col("__last.pos").alias("last_pos"),
        )
    )


def variant_rows_from_source(df: DataFrame, variant_id: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """The eight variant columns from a ``chromosome_position_ref_alt`` id."""
    parts = F.split(variant_id, "_")
    values = {
        "#CHROM": parts[0],
        "POS": parts[1].cast("bigint"),
        "ID": variant_id,
        "REF": parts[2],
        "ALT": parts[3],
        "QUAL": F.lit("."),
        "FILTER": F.lit("."),
        "INFO": F.lit("."),
    }
    values.update(extra or {})
    return df.select(*[v.alias(k) for k, v in values.items()])
