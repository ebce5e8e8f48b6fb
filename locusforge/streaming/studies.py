"""Structured Streaming over study inputs, log messages and status changes."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locusforge.functions.text import exit_status
from locusforge.operators.manifests import new_studies


# Buckets into which the state of a stream is dealt by key.
STATE_BUCKETS = 64


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """Earlier output of a stream, or none on the first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def new_file_stream(
    raw: DataFrame, known: DataFrame, key: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Append the studies that are neither known nor found by an earlier batch.

    Each batch writes to its own folder in overwrite mode, so a batch that is
    run again replaces its rows. Studies are dealt into buckets by a hash, as
    folders in each batch's own, and a batch reads only those of its studies.
    """

    def process(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(STATE_BUCKETS)).cast("int")
        fresh = new_studies(batch, known, key).dropDuplicates([key]).withColumn("bucket", bucket).persist()
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``STATE_BUCKETS``
        earlier = _existing(batch.sparkSession, target) if touched else None
        found = fresh
        if earlier is not None:
            found = new_studies(fresh, earlier.where((F.col("batch") < number) & F.col("bucket").isin(touched)), key)
        found.write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(target, f"batch={number}"))
        fresh.unpersist()

    return (
        raw.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _versions(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(bucket, version) of the folders of a state table, from their names alone."""
    pattern = os.path.join(target, "bucket=*", "version=*")
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = paths.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(paths) or []
    names = [str(x.getPath()) for x in found]
    return [(int(n.rsplit("bucket=", 1)[1].split("/")[0]), int(n.rsplit("version=", 1)[1])) for n in names]


def _state_folder(target: str, bucket: int, version: int) -> str:
    return os.path.join(target, f"bucket={bucket}", f"version={version}")


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _one_row_per_key(
    changes: DataFrame,
    key: str,
    pick: Callable[[Column, Column], Column],
    ts: str,
    tie: str,
    target: str,
    checkpoint: str,
    buckets: int = STATE_BUCKETS,
) -> StreamingQuery:
    """Keep one row per key over all batches, chosen by time.

    The state is dealt into buckets by a hash of the key. A batch is reduced to
    one row per key, and only the buckets of its keys are read and written
    again, each as a new version in a folder of its own; the others aren't
    touched. The version before the newest stays, so that a batch that is run
    again starts from what it found the first time.
    """
    columns = [c for c in changes.columns if c != key]

    def reduce_rows(df: DataFrame) -> DataFrame:
        row = pick(F.struct(*columns), F.struct(F.col(ts).alias("a"), F.col(tie).alias("b")))
        return df.groupBy(key, "bucket").agg(row.alias("__r")).select(key, "bucket", "__r.*")

    def process(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = reduce_rows(batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))).persist()
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most ``buckets``
        before: dict[int, list[int]] = {}
        for bucket, version in _versions(spark, target):
            if bucket in touched:
                before.setdefault(bucket, []).append(version)
        newest = {b: max(v for v in found if v < number) for b, found in before.items() if min(found) < number}
        if newest:
            held = spark.read.schema(changes.schema).option("basePath", target)
            held = held.parquet(*[_state_folder(target, b, v) for b, v in sorted(newest.items())])
            hashed = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
            merged = reduce_rows(rows.unionByName(held.select(*changes.columns).withColumn("bucket", hashed)))
        else:
            merged = rows
        merged.withColumn("version", F.lit(number)).repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("bucket", "version").parquet(target)
        rows.unpersist()
        for bucket, found in before.items():
            for version in found:
                if version < newest.get(bucket, 0):
                    _remove(spark, _state_folder(target, bucket, version))

    return (
        changes.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def exit_status_stream(
    logs: DataFrame, *, instance: str, ts: str, tie: str, message: str, start: Column, target: str, checkpoint: str
) -> StreamingQuery:
    """First exit code per instance after a start time; zero is success.

    Late messages are handled by time, not by arrival: an earlier message that
    comes in a later batch still wins.
    """
    codes = (
        logs.withColumn("exit_code", exit_status(F.col(message)))
        .where((F.col(ts) > start) & F.col("exit_code").isNotNull())
        .select(instance, ts, tie, "exit_code", (F.col("exit_code") == 0).alias("succeeded"))
    )
    return _one_row_per_key(codes, instance, F.min_by, ts, tie, target, checkpoint)


def status_state_stream(
    changes: DataFrame, *, study: str, status: str, ts: str, tie: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Latest status per study."""
    rows = changes.select(study, status, ts, tie)
    return _one_row_per_key(rows, study, F.max_by, ts, tie, target, checkpoint)


def newest_state(spark: SparkSession, target: str) -> DataFrame:
    """The table after the last batch: the newest version of each bucket."""
    newest: dict[int, int] = {}
    for bucket, version in _versions(spark, target):
        newest[bucket] = max(version, newest.get(bucket, version))
    folders = [_state_folder(target, b, v) for b, v in sorted(newest.items())]
    return spark.read.option("basePath", target).parquet(*folders).drop("bucket", "version")
