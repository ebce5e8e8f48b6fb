"""Posterior probabilities, credible sets and colocalisation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusforge.functions.stats import with_normal_two_sided
from locusforge.operators.scale import log_sum_exp, null_safe_join, running_total

# Priors and thresholds of the configured steps.
PRIOR_1 = 1e-4
PRIOR_2 = 1e-4
PRIOR_12 = 1e-5
CREDIBLE_MASS = 0.99

# Beyond the smallest power of two a double can hold.
SMALLEST_POWER = 1100

# Rows of one variant that a single overlap task meets on its right side.
OVERLAP_BLOCK = 2_000


def single_effect_posterior(
    df: DataFrame, locus: Sequence[str], log_bf: str, out: str = "pip"
) -> DataFrame:
    """Inclusion probability per row of a locus from log Bayes factors."""
    total = log_sum_exp(df, locus, __lse=F.col(log_bf)).drop("n_rows")
    return (
        null_safe_join(df, total, locus)
        .withColumn(out, F.exp(F.col(log_bf) - F.col("__lse")))
        .drop("__lse")
    )


def credible_set(
    df: DataFrame, locus: Sequence[str], *, pip: str, tie: str, mass: float = CREDIBLE_MASS
) -> DataFrame:
    """Most probable rows of a locus until ``mass`` is reached, the crossing row included.

    Rows are first totalled by powers of two of their probability. Once the
    total of the more probable powers reaches the mass, the powers behind cannot
    contribute; their rows, nearly all of a locus, are dropped before the sort.
    """
    value = F.coalesce(F.col(pip), F.lit(0.0))
    power = F.when(value > 0, F.floor(-F.log2(value))).otherwise(F.lit(SMALLEST_POWER)).cast("int")
    rows = df.withColumn("__power", power)
    earlier = Window.partitionBy(*locus).orderBy("__power").rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        rows.groupBy(*locus, "__power")
        .agg(F.sum(value).alias("__sum"))
        .withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)))
        .where(F.col("__before") < F.lit(float(mass) + 1e-8))
        .groupBy(*locus)
        .agg(F.max("__power").alias("__last"))
    )
    near = null_safe_join(rows, reach, locus).where(F.col("__power") <= F.col("__last")).drop("__power", "__last")
    order = [F.col(pip).desc_nulls_last(), F.col(tie).asc()]
    summed = running_total(near, locus, order, value, "cumulative")
    return summed.where(F.round(F.col("cumulative") - value, 9) < F.lit(float(mass)))


def credible_set_overlaps(
    cs: DataFrame,
    *,
    locus: str,
    variant: str,
    study: str | None = None,
    carry: Sequence[str] = (),
    block: int = OVERLAP_BLOCK,
) -> DataFrame:
    """Variants shared by two loci, each pair of loci once, left id below right id.

    Expects one row per (locus, variant). Loci of one study are not compared
    when ``study`` is given. A variant that many loci share is cut into blocks
    on the right and its left rows are shown to each block, so that no task has
    to pair all rows of the variant by itself.
    """
    extra = [study] if study else []
    rows = cs.select(locus, variant, *extra, *carry)
    wide = (
        rows.groupBy(variant)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > block)
        .select(F.col(variant).alias("__wide"), F.ceil(F.col("__n") / block).cast("int").alias("__blocks"))
    )
    sized = (
        rows.join(wide, F.col(variant) == F.col("__wide"), "left")
        .withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
        .drop("__wide")
    )
    left = sized.select(
        F.col(variant),
        F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"),
        F.col(locus).alias("left_locus"),
        *[F.col(c).alias(f"left_{c}") for c in [*extra, *carry]],
    )
    right = sized.select(
        F.col(variant),
        F.pmod(F.xxhash64(locus), F.col("__blocks")).cast("int").alias("__block"),
        F.col(locus).alias("right_locus"),
        *[F.col(c).alias(f"right_{c}") for c in [*extra, *carry]],
    )
    pairs = left.join(right, [variant, "__block"]).where(F.col("left_locus") < F.col("right_locus"))
    if study:
        pairs = pairs.where(F.col(f"left_{study}") != F.col(f"right_{study}"))
    return pairs.drop("__block")


def ecaviar(overlaps: DataFrame, left_pip: str = "left_pip", right_pip: str = "right_pip") -> DataFrame:
    """Colocalisation posterior: sum of products of inclusion probabilities
    (Hormozdiari et al. 2016)."""
    return overlaps.groupBy("left_locus", "right_locus").agg(
        F.count(F.lit(1)).alias("n_shared"),
        F.sum(F.col(left_pip) * F.col(right_pip)).alias("clpp"),
    )


def coloc(
    overlaps: DataFrame,
    rows: DataFrame,
    *,
    locus: str,
    log_bf: str,
    left_bf: str = "left_log_bf",
    right_bf: str = "right_log_bf",
    pips: tuple[str, str] | None = None,
    p1: float = PRIOR_1,
    p2: float = PRIOR_2,
    p12: float = PRIOR_12,
) -> DataFrame:
    """Posteriors of the five hypotheses (Giambartolomei et al. 2014).

    ``rows`` holds every variant of every locus with its log Bayes factor, one
    row per (locus, variant): one cause in a locus, and two distinct ones, may
    lie at any of them. Only the shared cause is summed over the overlaps. Loci
    of a single variant each, the same one, cannot have two distinct causes.
    With ``pips``, the two columns of inclusion probabilities, the same
    aggregate gives ``clpp`` as well.
    """
    pair = ["left_locus", "right_locus"]
    measures = {"l12": F.col(left_bf) + F.col(right_bf)}
    if pips:
        measures["clpp"] = F.log(F.col(pips[0])) + F.log(F.col(pips[1]))
    totals = log_sum_exp(rows, [locus], total=F.col(log_bf))
    sums = log_sum_exp(overlaps, pair, **measures).withColumnRenamed("n_rows", "n_shared")
    for side, name in (("left", "1"), ("right", "2")):
        side_totals = totals.select(
            F.col(locus).alias(f"{side}_locus"), F.col("total").alias(f"l{name}"), F.col("n_rows").alias(f"n{name}")
        )
        sums = sums.join(side_totals, f"{side}_locus")
    ln = math.log
    gap = F.col("l12") - F.col("l1") - F.col("l2")
    diff = F.when(
        (F.greatest("n1", "n2") > 1) & (gap < 0), F.col("l1") + F.col("l2") + F.log(F.lit(1.0) - F.exp(gap))
    )
    hyp = {
        "h0": F.lit(0.0),
        "h1": F.col("l1") + ln(p1),
        "h2": F.col("l2") + ln(p2),
        "h3": diff + (ln(p1) + ln(p2)),
        "h4": F.col("l12") + ln(p12),
    }
    kept = [*pair, "n_shared", *(["clpp"] if pips else [])]
    if pips:
        sums = sums.withColumn("clpp", F.coalesce(F.exp("clpp"), F.lit(0.0)))
    cols = sums.select(*kept, *[c.alias(f"__{k}") for k, c in hyp.items()])
    top = F.greatest(*[F.col(f"__{k}") for k in hyp])
    weights = {k: F.coalesce(F.exp(F.col(f"__{k}") - top), F.lit(0.0)) for k in hyp}
    total = sum(weights.values(), F.lit(0.0))
    return cols.select(*kept, *[(w / total).alias(k) for k, w in weights.items()])


def pics(
    tags: DataFrame, locus: Sequence[str], *, lead_strength: str, r2: str, min_r2: float = 0.5, out: str = "pip"
) -> DataFrame:
    """Probability per tag variant from the lead's -log10 p and r2 (Farh et al. 2015).

    The tag's signal is normal with mean ``r2 * m`` and deviation
    ``sqrt(1 - |r|^6.4) * sqrt(m) / 2``; its weight is the two-sided tail at the
    lead's ``m``. The lead itself, with no deviation, has weight one, and so
    has an ``r2`` that rounding put above 1. A locus holds the partners of one
    lead and is summed in a window, which spills what memory does not hold: a
    join with the totals would compute tags and weights twice.
    """
    m = F.col(lead_strength)
    r = F.sqrt(F.least(F.col(r2), F.lit(1.0)))
    sd = F.sqrt(F.lit(1.0) - F.pow(r, F.lit(6.4))) * F.sqrt(m) / 2
    z = F.when(F.col("__sd") > 0, (m - F.col(r2) * m) / F.col("__sd"))
    rows = with_normal_two_sided(tags.where(F.col(r2) >= min_r2).withColumn("__sd", sd), z, "__w").drop("__sd")
    rows = rows.withColumn("__w", F.coalesce("__w", F.lit(1.0)))
    total = F.sum("__w").over(Window.partitionBy(*locus))
    return rows.withColumn(out, F.col("__w") / total).drop("__w")
