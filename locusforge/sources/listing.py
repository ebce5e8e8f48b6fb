"""Object listings as frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_objects(spark: SparkSession, prefix: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Path, length and modification time of the files below a prefix; no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", glob)
        .load(prefix)
        .select("path", "length", "modificationTime")
    )


def folder_exists(listing: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """One row that tells whether any object starts with the prefix."""
    return listing.where(F.col(path).startswith(prefix)).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def select_latest(
    listing: DataFrame, group: Column, path: str = "path", modified: str = "modificationTime", out: str = "source"
) -> DataFrame:
    """Newest object per source; equal times go to the greater path."""
    newest = F.struct(F.col(modified).alias("t"), F.col(path).alias("p"))
    return listing.groupBy(group.alias(out)).agg(F.max(newest).alias("__m")).select(
        out, F.col("__m.p").alias(path), F.col("__m.t").alias(modified)
    )


def filter_listing(listing: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Paths that contain the pattern, or that do not when it starts with ``!``."""
    if pattern.startswith("!"):
        return listing.where(~F.col(path).contains(pattern[1:]))
    return listing.where(F.col(path).contains(pattern))


# Sets of variables that are sent to every task, at most; more are spread by a join on blocks.
MOST_VARIABLES = 10_000


def expand_template(
    templates: DataFrame, variables: DataFrame, on: str | None, texts: Sequence[str], names: Mapping[str, str]
) -> DataFrame:
    """Templates filled with each set of variables, or each of their group if ``on`` names one.

    ``names`` maps placeholder to variable column. A placeholder that stays open
    is an error. Without a group every template meets every set: few sets, as
    counted first, go to all tasks as one array; more are cut into blocks of
    that many, and the templates are shown to each block.
    """
    if on is None:
        joined = _every_set(templates, variables)
    else:
        joined = templates.join(variables, on)

    def fill(text: str) -> Column:
        value = reduce(
            lambda acc, kv: F.replace(acc, F.lit("${" + kv[0] + "}"), F.col(kv[1]).cast("string")),
            names.items(),
            F.col(text),
        )
        return F.when(
            value.contains("${"), F.raise_error(F.concat(F.lit("unresolved placeholder: "), value))
        ).otherwise(value)

    filled = {t: fill(t) for t in texts}
    return joined.select(*[filled.get(c, F.col(c)).alias(c) for c in joined.columns])


def _every_set(templates: DataFrame, variables: DataFrame) -> DataFrame:
    """Each template with each set of variables."""
    blocks = -(-variables.count() // MOST_VARIABLES)
    block = F.pmod(F.xxhash64(*variables.columns), F.lit(max(blocks, 1))).cast("int").alias("__block")
    sets = variables.select(block, F.struct(*variables.columns).alias("__set"))
    sets = sets.groupBy("__block").agg(F.collect_list("__set").alias("__sets"))
    shown = templates.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    met = shown.join(sets, "__block").withColumn("__set", F.explode("__sets"))
    return met.select(*templates.columns, "__set.*")


def json_path_explode(df: DataFrame, document: str, schema: str, field: Column, prefix: str, out: str = "source") -> DataFrame:
    """One row per element of an array inside a JSON text, with a name cut from the prefix.

    ``field`` is written against the parsed column ``doc``.
    """
    parsed = df.withColumn("doc", F.from_json(document, schema))
    rows = parsed.withColumn(out, F.explode(field)).drop("doc")
    return rows.withColumn(
        "destination",
        F.when(F.col(out).startswith(prefix), F.substring(F.col(out), len(prefix) + 1, 1 << 30)).otherwise(F.col(out)),
    )
