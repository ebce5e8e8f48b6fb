"""Building blocks that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusforge.session import cut_lineage

EXPONENT_STEP = 256

# Spark's partition-wise id holds the row number in its lower bits.
ID_ROW_BITS = 33

# Largest rank filter that Spark pushes below the shuffle by default.
GROUP_LIMIT = 1000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the left key columns are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over the rows up to and including each row of its group.

    A window over the group would put a large group, or the whole frame, into
    one task. Here the frame is range-partitioned by group and order, each
    (group, slice) is totalled, and the totals of the earlier slices are added
    to a running sum inside the slice. A group of any size is spread over as
    many slices as it needs. The sliced frame is checkpointed: both passes have
    to see the same slices, also after an executor is lost.
    """
    group = list(group)
    sliced = cut_lineage(
        df.withColumn("__value", value)
        .repartitionByRange(*[F.col(g) for g in group], *order)
        .withColumn("__slice", F.spark_partition_id())
    )
    keys = [*group, "__slice"]
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys)
        .agg(F.sum("__value").alias("__total"))
        .select(*keys, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("__local", F.sum("__value").over(inside))
    return (
        null_safe_join(local, offsets, keys)
        .withColumn(out, F.col("__before") + F.col("__local"))
        .drop("__value", "__slice", "__local", "__before")
    )


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1-based position of each row in its group, without one task per group.

    Over the whole frame the position inside a sorted slice is the low part of
    Spark's partition-wise id, so one range sort is the only shuffle. The slice
    offsets are one row per partition and are broadcast.
    """
    if group:
        return running_total(df, group, order, F.lit(1).cast("bigint"), out)
    ident = F.col("__id")
    sliced = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    )
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(F.shiftright(ident, ID_ROW_BITS).alias("__slice"))
        .agg(F.count(F.lit(1)).alias("__total"))
        .select("__slice", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    )
    inside = ident.bitwiseAND(F.lit((1 << ID_ROW_BITS) - 1))
    return (
        sliced.withColumn("__slice", F.shiftright(ident, ID_ROW_BITS))
        .join(F.broadcast(offsets), "__slice")
        .withColumn(out, F.col("__before") + inside + 1)
        .drop("__id", "__slice", "__before")
    )


def log_sum_exp(df: DataFrame, group: Sequence[str], **measures: Column) -> DataFrame:
    """``ln(sum(exp(x)))`` per group for each named measure, in one pass.

    Values are bucketed by exponent so that partial sums neither overflow nor
    vanish and combine on the map side; a second step folds the few buckets of
    a group. Null measures are left out.
    """
    group = list(group)
    step = F.lit(float(EXPONENT_STEP))
    names = list(measures)
    rows = df.select(*group, *[m.cast("double").alias(f"__x_{n}") for n, m in measures.items()])
    for n in names:
        rows = rows.withColumn(f"__k_{n}", F.floor(F.col(f"__x_{n}") / step))
    buckets = rows.groupBy(*group, *[f"__k_{n}" for n in names]).agg(
        *[F.sum(F.exp(F.col(f"__x_{n}") - F.col(f"__k_{n}") * step)).alias(f"__s_{n}") for n in names],
        F.count(F.lit(1)).alias("__n"),
    )
    folded = buckets.groupBy(*group).agg(
        *[
            F.collect_list(
                F.when(
                    F.col(f"__s_{n}").isNotNull(),
                    F.struct(F.col(f"__k_{n}").alias("k"), F.col(f"__s_{n}").alias("s")),
                )
            ).alias(f"__b_{n}")
            for n in names
        ],
        F.sum("__n").alias("n_rows"),
    )

    def fold(name: str) -> Column:
        pieces = F.col(f"__b_{name}")
        top = F.array_max(F.transform(pieces, lambda b: b["k"]))
        total = F.aggregate(
            pieces, F.lit(0.0), lambda acc, b: acc + b["s"] * F.exp((b["k"] - top).cast("double") * step)
        )
        return F.log(total) + top.cast("double") * step

    return folded.select(*group, *[fold(n).alias(n) for n in names], "n_rows")


def nest_rows(
    df: DataFrame,
    keys: Sequence[str],
    item: Column,
    out: str,
    max_items: int = 100_000,
) -> DataFrame:
    """One sorted array of items per key, in several numbered parts for a huge key.

    Keys of at most ``max_items`` rows, the ordinary case, give one row with
    part 0. A larger key is spread by a hash of the item over as many parts as
    its row count asks for, so no array grows without bound and no item is lost.
    """
    keys = list(keys)
    rows = df.select(*keys, item.alias("__item"))
    large = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > max_items)
        .withColumn("__parts", F.ceil(F.col("__n") / max_items).cast("int"))
        .drop("__n")
    )
    placed = null_safe_join(rows, large, keys, "left").withColumn(
        "part",
        F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64("__item"), F.col("__parts")).cast("int")
        ),
    )
    return placed.groupBy(*keys, "part").agg(F.array_sort(F.collect_list("__item")).alias(out))


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank"
) -> DataFrame:
    """The first ``limit`` rows per key with their 1-based rank.

    A rank filter of up to ``GROUP_LIMIT`` is applied by Spark in each task
    before the shuffle, so a huge group sends only ``limit`` rows per task. A
    larger limit ranks over range slices instead.
    """
    if limit > GROUP_LIMIT:
        return row_numbers(df, keys, order, rank).where(F.col(rank) <= limit)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order.

    The order columns must make ties impossible or irrelevant.
    """
    return top_rows(df, keys, order, 1, "__rank").drop("__rank")
