"""Written tables and row keys shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge.operators import scale
from locusforge.session import scratch_path, ship_package


#: Tables that each open scope removes when it ends, the innermost scope last.
_scopes: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope() -> Iterator[None]:
    """Tables settled inside are removed at the end, but for those settled with ``outer``.

    What leaves the scope must therefore be settled with ``outer``; it then
    belongs to the scope around this one, if there is one.
    """
    own: list[tuple[SparkSession, str]] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for spark, path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the scratch folder, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame, name: str, outer: bool = False, by: str | None = None) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back.

    Later passes read the files, so they see the same rows when an executor is
    lost, and Spark knows the size of the table when it plans a join. The table
    goes with the innermost open scope; with ``outer``, with the one around it.
    With ``by``, each value of that column has a folder of its own.
    """
    path = scratch_path(df.sparkSession, name)
    held = _scopes.get()[: -1 if outer else None]
    if held:
        held[-1].append((df.sparkSession, path))
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replayable(df: DataFrame, name: str) -> DataFrame:
    """The frame itself if it only scans files, whose rows come in the same order in every pass; else a written copy."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = set(re.findall(r"^[\s:+\-|]*([A-Za-z]+)", plan, re.M))
    return df if nodes <= {"Project", "Filter", "Relation"} else settle(df, name)


def mapped(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Arrow batches of each task through a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(partial(_released, fn=fn), schema)


def _released(
    batches: Iterator[pa.RecordBatch], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """The function's batches; at the end the worker, which stays for later tasks, gives free memory back."""
    yield from fn(batches)
    give_back()


def give_back() -> None:
    """Return memory that Arrow and numpy have freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(columns: Sequence[str], stem: str) -> str:
    """A column name that clashes with none of the given ones, whatever their case."""
    taken = {c.lower() for c in columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def plain_text(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def joined_by(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on one key where null equals null; the right key is dropped."""
    other = fresh([*left.columns, *right.columns], "right_key")
    return left.join(right.withColumnRenamed(key, other), F.col(key).eqNullSafe(F.col(other)), how).drop(other)


#: Rows into which a small table's row is dealt, for joins on a key of few values.
SALTS = 32


def hashed_first(rows: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group by a hash of the key, then by the key.

    Groups are counted first. A row whose hash lies far beyond the place where
    the last one must be stays where it is, so that few rows of a group are
    sent to its task, whatever the number of tasks.
    """
    counts = settle(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")), "group_sizes")
    share = fresh([*rows.columns, "n_rows"], "share")
    # twice as many as wanted and a hundred more: fewer than wanted are as good as impossible
    wide = counts.select(group, ((2.0 * limit + 100) / F.col("n_rows")).alias(share))
    near = salted(rows, wide, group, key).where(
        (F.xxhash64(key).cast("double") / 2.0**64 + 0.5 <= F.col(share)) | (F.col(share) >= 1)
    )
    order = [F.xxhash64(key), F.col(key)]
    return scale.top_rows(near.drop(share), [group], order, limit)


def salted(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join on a key of few values, each dealt over ``SALTS`` tasks by a column of ``left``.

    ``right`` has one row per key. Null keys join nothing.
    """
    salt = fresh([*left.columns, *right.columns], "salt")
    dealt = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(dealt, [key, salt], how).drop(salt)
