"""Writers."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.operators.manifests import duplicate_targets
from locusforge.operators.validation import is_invalid
from locusforge.operators.variants import chunk_descriptors, row_range_chunks
from locusforge.session import cut_lineage, ship_package
from locusforge.sources.blockgzip import store_of
from locusforge.sources.readers import bulk_decompress

# Write modes of a release.
MODES = ("overwrite", "ignore", "errorifexists")
# fixed values: the file in the folder of a chunk
CHUNK_FILE = "part-00000.csv"


def _commit(batches: Iterator[pa.RecordBatch], root: str | None) -> Iterator[pa.RecordBatch]:
    """Write each document beside its path and move it there, so that a task that runs again replaces its files."""
    for batch in batches:
        paths = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            whole = path if root is None or path.startswith("/") or ":/" in path else f"{root.rstrip('/')}/{path}"
            store, place = store_of(whole)
            folder, _, name = place.rpartition("/")
            store.create_dir(folder, recursive=True)
            draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(text.encode())
            store.move(draft, place)
            paths.append(whole)
        yield pa.RecordBatch.from_arrays([batch.column("study"), pa.array(paths, pa.string())], names=["study", "path"])


def write_manifests(
    df: DataFrame, root: str | None = None, key: str = "studyId", path: str = "manifestPath"
) -> DataFrame:
    """One JSON file per manifest at the path that its row names; returns (study, path) of what was written.

    Paths without a scheme or a leading slash lie below ``root``. A target path
    used twice is an error that names the path, and so is a missing one. The
    cost lies in opening files, so the few bytes are spread over all tasks. Each
    file is put in place by a move: a reader never sees half of one, and a task
    that is tried again leaves one file. Files are written through Arrow's file
    systems. The returned frame is checkpointed, so using it writes nothing again.
    """
    repeated = duplicate_targets(df, path).select(path).limit(5).collect()
    if repeated:
        raise ValueError(f"target paths used more than once: {[r[0] for r in repeated]}")
    spark = df.sparkSession
    ship_package(spark)
    kind = dict(df.dtypes)[key]
    target = F.when(F.col(path).isNull(), F.raise_error(F.lit("a manifest without a target path"))).otherwise(F.col(path))
    rows = df.select(F.col(key).alias("study"), target.alias("path"), F.to_json(F.struct(*df.columns)).alias("text"))
    tasks = spark.sparkContext.defaultParallelism
    written = rows.repartition(tasks, "path").mapInArrow(partial(_commit, root=root), f"study {kind}, path string")
    return cut_lineage(written)


def sink(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    """Write with one of the release modes; ``ignore`` keeps an existing output."""
    if mode not in MODES:
        raise ValueError(f"unknown write mode: {mode}")
    df.write.mode(mode).format(fmt).save(path)


def clean_then_write(df: DataFrame, path: str, partition: str | None = None, fmt: str = "parquet") -> None:
    """Replace what lies at the path; with a partition column only the partitions written."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def _whole_files(batches: Iterator[pa.RecordBatch], root: str, header: str) -> Iterator[pa.RecordBatch]:
    """Write the lines of each label, which follow each other, beside their file and move it into its folder."""
    out = label = None

    def close() -> pa.RecordBatch:
        out.close()
        store.move(draft, f"{folder}/{CHUNK_FILE}")
        return pa.RecordBatch.from_arrays([pa.array([label], pa.string())], names=["label"])

    for batch in batches:
        labels, lines = batch.column("label"), batch.column("line")
        # the lines of a batch lie one after the other
        places = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset :].tolist()
        text, first = lines.buffers()[2], 0
        while first < batch.num_rows:
            own = labels[first].as_py()
            last = bisect_right(range(batch.num_rows), False, lo=first, key=lambda i: labels[i].as_py() != own)
            if own != label:
                if out is not None:
                    yield close()
                label = own
                store, folder = store_of(f"{root.rstrip('/')}/chunk={label}")
                store.create_dir(folder, recursive=True)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                out = store.open_output_stream(draft, compression=None)
                out.write(f"{header}\n".encode())
            out.write(text.slice(places[first], places[last] - places[first]))
            first = last
    if out is not None:
        yield close()


def write_variant_chunks(df: DataFrame, path: str, order: list, n: int) -> None:
    """Tab-separated files with a header, one per chunk, in a folder named by its row range.

    The cost lies in opening files: Spark's writer sets the rights of each file
    by a command of its own on local disks and moves all of them from the
    driver. Here Spark makes the lines and tasks put the files in place through
    Arrow's file systems; a task that runs again replaces its files. The mark of
    success comes last.
    """
    spark = df.sparkSession
    ship_package(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    target = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    options = {"sep": "\t"}
    names = F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    header = spark.range(1).select(F.to_csv(names, options)).first()[0]
    labelled = row_range_chunks(df, order, n)
    line = F.concat(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options), F.lit("\n")).alias("line")
    # rows of a chunk have neighbouring numbers
    rows = labelled.repartition("label").sortWithinPartitions("row").select("label", line)
    store.delete(target, True)
    store.mkdirs(target)
    rows.mapInArrow(partial(_whole_files, root=target.toString(), header=header), "label string").write.format("noop").mode("overwrite").save()
    store.create(hadoop.Path(target, "_SUCCESS"), True).close()


def write_validated(
    df: DataFrame, invalid: Sequence[str], path: str, reasons: str = "qualityControls"
) -> tuple[DataFrame, DataFrame]:
    """Write valid and invalid rows in one pass and return both, read back from their folders.

    Filtering a flagged frame twice would compute its joins twice.
    """
    df.withColumn("valid", ~is_invalid(F.col(reasons), invalid)).write.mode("overwrite").partitionBy("valid").parquet(path)
    back = df.sparkSession.read.parquet(path)
    good, bad = (back.where(F.col("valid") == flag).drop("valid") for flag in ("true", "false"))
    return good, bad


def write_path_list(df: DataFrame, path: str, target: str) -> None:
    """Object names, one per line, ordered over the files of the target folder."""
    df.select(F.col(path).alias("value")).orderBy("value").write.mode("overwrite").text(target)


def write_chunk_manifests(df: DataFrame, path: str, order: Sequence[str], chunk: str = "chunk") -> DataFrame:
    """CSV manifest per chunk, its rows in the given order; returns the descriptors of the written folders."""
    (
        df.repartition(chunk)
        .sortWithinPartitions(chunk, *order)
        .write.mode("overwrite")
        .option("header", "true")
        .partitionBy(chunk)
        .csv(path)
    )
    return chunk_descriptors(df, path, chunk)


def copy_dataset(spark: SparkSession, source: str, target: str, fmt: str = "parquet") -> None:
    """Copy a dataset into the release folder."""
    spark.read.format(fmt).load(source).write.mode("overwrite").format(fmt).save(target)


def write_by_chromosome(df: DataFrame, path: str, chromosome: str, position: str) -> None:
    """Folders per chromosome, ordered by position; a large chromosome gets several files."""
    (
        df.repartitionByRange(chromosome, position)
        .sortWithinPartitions(chromosome, position)
        .write.mode("overwrite")
        .partitionBy(chromosome)
        .parquet(path)
    )


def _below(prefix: str) -> Column:
    """The part of ``path`` below a prefix, whatever slashes follow their schemes."""
    bare = re.sub(r"^[a-z0-9]+:/*", "/", prefix).strip("/")
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    return F.regexp_replace(plain, "^/*" + re.escape(bare) + "/+", "")


def write_decompressed(spark: SparkSession, prefix: str, glob: str, out: str, failures: str) -> None:
    """Decompress every matching file to a folder of its path below the prefix; broken files go to a failure list."""
    lines, broken = bulk_decompress(spark, prefix, glob)
    order = ["file", "piece", "pos"]
    (
        lines.withColumn("file", _below(prefix))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("file", F.col("line").alias("value"))
        .write.mode("overwrite")
        .partitionBy("file")
        .text(out)
    )
    broken.write.mode("overwrite").json(failures)
