"""Queries over log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.functions.text import exit_status

# Fixed value: text shown for an entry without a message.
EMPTY_MESSAGE = "Empty log message"


def first_matching(df: DataFrame, ts: str, start: Column, tie: str) -> DataFrame:
    """First entry after a start time."""
    columns = df.columns
    first = df.where(F.col(ts) > start).agg(
        F.min_by(F.struct(*columns), F.struct(F.col(ts).alias("a"), F.col(tie).alias("b"))).alias("__r")
    )
    return first.where(F.col("__r").isNotNull()).select("__r.*")


def instance_log(
    df: DataFrame, *, instance: Column, ts: str, tie: str, message: str
) -> DataFrame:
    """All lines of one instance in order of time."""
    return (
        df.where(instance)
        .withColumn(message, F.coalesce(F.col(message), F.lit(EMPTY_MESSAGE)))
        .orderBy(ts, tie)
    )


def first_exit_status(df: DataFrame, *, instance: str, ts: str, message: str, start: Column, tie: str) -> DataFrame:
    """First exit code per instance after the start time; zero is success."""
    codes = df.where(F.col(ts) > start).withColumn("exit_code", exit_status(F.col(message)))
    return (
        codes.where(F.col("exit_code").isNotNull())
        .groupBy(instance)
        .agg(F.min_by("exit_code", F.struct(F.col(ts).alias("a"), F.col(tie).alias("b"))).alias("exit_code"))
        .withColumn("succeeded", F.col("exit_code") == 0)
    )
