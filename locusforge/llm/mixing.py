"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in the mix the same number of times.
These expectations are summed along the source, one offset drawn from the
source's name is added, and a document is emitted once for every integer the
sum passes. Documents are ordered by size, so that the words of the emitted
copies come near the target as well as their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusforge.llm.frames import fresh, joined_by, scope, settle
from locusforge.operators import scale

WEIGHTS = (3, 1, 2)
#: The mix in half sizes of the corpus, and the largest number of times a source is taken.
MIX_HALVES = 3
MOST_TIMES = 2
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of (source, source_size) rows.

    Sources in code point order, null last, take the weights in turn. A source
    whose share would pass ``MOST_TIMES`` its size stops there; what it leaves
    goes to the others by weight. In the order of size per weight that is
    decided from running totals: a source is full if its share of what the
    sources before it leave is above its limit.
    """
    ranked = scale.row_numbers(sizes, [], [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = settle(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    filled = scale.running_total(weighed, [], order, F.col("source_size"), "size_to")
    filled = scale.running_total(filled, [], order, F.col("weight"), "weight_to")
    total = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # longs whatever their value: a literal takes the type that just holds it, and products of it overflow
    size, all_weight = F.lit(total["size"] or 0).cast("long"), F.lit(total["weight"] or 0).cast("long")
    left = MIX_HALVES * size - 2 * MOST_TIMES * (F.col("size_to") - F.col("source_size"))
    rest = all_weight - (F.col("weight_to") - F.col("weight"))
    full = 2 * MOST_TIMES * F.col("source_size") * rest < F.col("weight") * left
    placed = settle(filled.withColumn("full", full), "sources")
    open_ = placed.where("not full").agg(F.sum("weight").alias("w")).first()["w"] or 1
    full_size = F.lit(placed.where("full").agg(F.sum("source_size").alias("s")).first()["s"] or 0).cast("long")
    share = (F.col("weight") * (MIX_HALVES * size - 2 * MOST_TIMES * full_size)).cast("double") / F.lit(2.0 * open_)
    return placed.select(
        "source",
        "source_size",
        F.when(F.col("full"), (MOST_TIMES * F.col("source_size")).cast("double")).otherwise(share).alias("target"),
    )


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] = (), weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(key, size, source_size, target, copies, taken) of every row, and the columns to carry.

    ``size`` counts the words; a null text has none. A source without words has
    the target 0 and its documents are never taken. Rows equal in all columns
    are documents of their own; which of them is emitted more often is
    immaterial. Equal input gives equal output.
    """
    rows = docs.select(F.col(source).alias("source"), n_words(text).alias("size"), F.col(key).alias("__key"), *carry)
    rows = settle(rows, "sizes")
    targets = settle(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    order = [F.col("size").desc(), F.col("__key"), *[F.col(c) for c in carry]]
    ranked = scale.row_numbers(rows, ["source"], order, "rank")
    offset = F.conv(F.substring(F.md5(F.coalesce("source", F.lit("null"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    per_doc = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n = F.floor(offset + F.col("rank") * per_doc) - F.floor(offset + (F.col("rank") - 1) * per_doc)
    return joined_by(ranked, targets, "source", "inner").select(
        F.col("__key").alias(key), "size", "source_size", "target", n.cast("long").alias("copies"),
        (n * F.col("size")).cast("long").alias("taken"), *carry,
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The mix: every row as often as it is emitted, numbered from 1 in ``copy``.

    The rows are written first, so that their numbers stay the same in both passes.
    """
    row, copy = fresh(docs.columns, "row"), fresh(docs.columns, "copies")
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    with scope():
        taken = copies(numbered, carry=[row], weights=weights).where("copies > 0").select(row, F.col("copies").alias(copy))
        taken = settle(taken, "taken", outer=True)
    name = "copy" if "copy" not in {c.lower() for c in docs.columns} else fresh(docs.columns, "copy")
    return (
        numbered.join(taken, row)
        .withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))))
        .drop(row, copy)
    )
