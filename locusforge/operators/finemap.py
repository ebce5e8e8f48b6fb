"""SuSiE fine-mapping of many loci (Wang et al. 2020; summary form Zou et al. 2022)."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.operators.posteriors import credible_set
from locusforge.operators.scale import log_sum_exp
from locusforge.session import cut_lineage, ship_package

# Parameters of the fine-mapping step.
MAX_CAUSAL = 10
LEAD_PVALUE = 1e-5
PURITY_MEAN_R2 = 0.25
PURITY_MIN_R2 = 0.25
MIN_LOG_BF = 2.0
SUM_PIPS = 0.99

# Variants of a locus that are solved inside one task; wider loci are solved by joins.
TASK_VARIANTS = 2_000
# A matrix with fewer than one in so many entries listed is kept as a list.
LISTED_SHARE = 16
RESULT = "locus string, effect int, variant string, alpha double, log_bf double, pip double"


def _single_effect(z: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Probabilities, posterior means on the z scale and log Bayes factor of one effect."""
    shrink = prior / (1.0 + prior)
    lbf = 0.5 * (np.log1p(-shrink) + shrink * z * z)
    top = lbf.max()
    w = np.exp(lbf - top)
    total = w.sum()
    return w / total, shrink * z, float(top + np.log(total / len(z)))


class ListedLD:
    """Correlations of ``n`` variants as listed pairs, both ways round; the diagonal is 1, all others are 0."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, r: np.ndarray):
        self.n = n
        self.i, self.j, self.r = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([r, r])
        self.full = None
        if len(self.r) * LISTED_SHARE > n * n:
            self.full = np.eye(n)
            self.full[self.i, self.j] = self.r

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        if self.full is not None:
            return self.full @ x
        return x + np.bincount(self.i, weights=self.r * x[self.j], minlength=self.n)

    def purity(self, chosen: np.ndarray) -> tuple[float, float]:
        """Mean and least r2 of all pairs of the chosen variants, each with itself included."""
        held = np.zeros(self.n, dtype=bool)
        held[chosen] = True
        r2 = self.r[held[self.i] & held[self.j]] ** 2
        k = len(chosen)
        least = 0.0 if len(r2) < k * (k - 1) else r2.min(initial=1.0)
        return (r2.sum() + k) / (k * k), least


def susie(z: np.ndarray, ld: np.ndarray | ListedLD, effects: int, prior: float, sweeps: int = 100, tol: float = 1e-4):
    """Iterative single-effect fits on z-scores; the prior variance stays fixed."""
    alpha = np.full((effects, len(z)), 1.0 / len(z))
    part = np.zeros_like(alpha)
    lbf = np.zeros(effects)
    for _ in range(sweeps):
        old = alpha.copy()
        for k in range(effects):
            others = part.sum(axis=0) - part[k]
            alpha[k], mean, lbf[k] = _single_effect(z - ld @ others, prior)
            part[k] = alpha[k] * mean
        if np.abs(alpha - old).max() < tol:
            break
    return alpha, lbf


def _solve(settings: dict):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = sorted(left["variant"].unique())
        at = {v: i for i, v in enumerate(names)}
        z = np.zeros(len(names))
        z[[at[v] for v in left["variant"]]] = left["z"].to_numpy()
        a = right["variant_a"].map(at)
        b = right["variant_b"].map(at)
        ok = a.notna() & b.notna()
        i, j, r = a[ok].to_numpy(dtype=int), b[ok].to_numpy(dtype=int), right["r"][ok].to_numpy(dtype=float)
        ld = ListedLD(len(names), i, j, r)
        alpha, lbf = susie(z, ld, min(settings["effects"], len(names)), settings["prior"])
        pip = 1.0 - np.prod(1.0 - alpha, axis=0)
        parts = []
        for k in range(len(alpha)):
            if lbf[k] < settings["min_log_bf"]:
                continue
            rank = np.argsort(-alpha[k], kind="stable")
            before = np.cumsum(alpha[k][rank]) - alpha[k][rank]
            chosen = rank[np.round(before, 9) < settings["mass"]]
            mean_r2, min_r2 = ld.purity(chosen)
            if mean_r2 < settings["mean_r2"] or min_r2 < settings["min_r2"]:
                continue
            parts.append(
                pd.DataFrame(
                    {
                        "locus": key[0],
                        "effect": k,
                        "variant": [names[c] for c in chosen],
                        "alpha": alpha[k][chosen],
                        "log_bf": lbf[k],
                        "pip": pip[chosen],
                    }
                )
            )
        columns = ["locus", "effect", "variant", "alpha", "log_bf", "pip"]
        return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)

    return run


def _wide_effects(
    rows: DataFrame, ld: DataFrame, effects: int, prior: float, sweeps: int = 100, tol: float = 1e-4
) -> DataFrame:
    """The same fits for loci too wide for a task: every step is a join and an aggregate.

    State is one row per (locus, variant) with an array of the products of
    probability and mean, one entry per effect. The effect of the others on a
    variant is a sum over its LD partners. A locus leaves the rounds when its
    own fit has settled, so its result does not depend on the other loci.
    """
    shrink = prior / (1.0 + prior)
    if effects == 1:
        # no other effect pulls, so LD is not read
        bf = F.lit(0.5) * (F.lit(float(np.log1p(-shrink))) + shrink * F.col("z") * F.col("z"))
        one = rows.withColumn("__bf", bf)
        one = one.join(log_sum_exp(one, ["locus"], __lse=F.col("__bf")), "locus")
        alpha = F.exp(F.col("__bf") - F.col("__lse"))
        lbf = F.col("__lse") - F.log(F.col("n_rows").cast("double"))
        return cut_lineage(one.select("locus", "variant", "z", F.array(alpha).alias("alpha"), F.array(lbf).alias("lbf")))
    both = ld.select("locus", "variant_a", "variant_b", "r").unionByName(
        ld.select("locus", F.col("variant_b").alias("variant_a"), F.col("variant_a").alias("variant_b"), "r")
    )
    both = cut_lineage(both)
    zero = F.array_repeat(F.lit(0.0), effects)
    state = rows.select("locus", "variant", "z", zero.alias("b"), zero.alias("alpha"), zero.alias("lbf"))
    settled = []
    for _ in range(sweeps):
        state = state.withColumn("old", F.col("alpha"))
        for k in range(effects):
            others = F.aggregate("b", F.lit(0.0), lambda s, x: s + x) - F.col("b")[k]
            held = state.withColumn("__o", others)
            pulled = (
                both.join(
                    held.where(F.col("__o") != 0).select("locus", F.col("variant").alias("variant_b"), "__o"),
                    ["locus", "variant_b"],
                )
                .groupBy("locus", F.col("variant_a").alias("variant"))
                .agg(F.sum(F.col("r") * F.col("__o")).alias("__pull"))
            )
            resid = held.join(pulled, ["locus", "variant"], "left").withColumn(
                "__z", F.col("z") - F.col("__o") - F.coalesce("__pull", F.lit(0.0))
            )
            resid = resid.withColumn(
                "__bf", F.lit(0.5) * (F.lit(float(np.log1p(-shrink))) + shrink * F.col("__z") * F.col("__z"))
            )
            total = log_sum_exp(resid, ["locus"], __lse=F.col("__bf"))
            one = resid.join(total, "locus").withColumn("__a", F.exp(F.col("__bf") - F.col("__lse")))

            def put(array: str, value):
                return F.transform(array, lambda x, i: F.when(i == k, value).otherwise(x))

            state = cut_lineage(
                one.select(
                    "locus",
                    "variant",
                    "z",
                    "old",
                    put("b", F.col("__a") * shrink * F.col("__z")).alias("b"),
                    put("alpha", F.col("__a")).alias("alpha"),
                    put("lbf", F.col("__lse") - F.log(F.col("n_rows").cast("double"))).alias("lbf"),
                )
            )
        moved = F.array_max(F.zip_with("alpha", "old", lambda a, o: F.abs(a - o)))
        at_rest = cut_lineage(state.groupBy("locus").agg((F.max(moved) < tol).alias("rest")))
        if at_rest.where("rest").isEmpty():
            continue
        settled.append(state.join(at_rest.where("rest"), "locus", "left_semi"))
        state = state.join(at_rest.where("not rest"), "locus", "left_semi")
        if at_rest.where("not rest").isEmpty():
            break
    return reduce(DataFrame.unionByName, settled, state)


def _wide_sets(state: DataFrame, ld: DataFrame, settings: dict) -> DataFrame:
    """Credible sets of the wide fits with the same thresholds."""
    pip = F.lit(1.0) - F.aggregate("alpha", F.lit(1.0), lambda p, a: p * (F.lit(1.0) - a))
    long = (
        state.withColumn("pip", pip)
        .select("locus", "variant", "pip", F.posexplode(F.arrays_zip("alpha", "lbf")).alias("effect", "e"))
        .select("locus", "variant", "pip", "effect", F.col("e.alpha").alias("alpha"), F.col("e.lbf").alias("log_bf"))
        .where(F.col("log_bf") >= settings["min_log_bf"])
    )
    chosen = cut_lineage(
        credible_set(long, ["locus", "effect"], pip="alpha", tie="variant", mass=settings["mass"]).drop("cumulative")
    )
    a = chosen.select("locus", "effect", F.col("variant").alias("variant_a"))
    b = chosen.select("locus", "effect", F.col("variant").alias("variant_b"))
    sizes = chosen.groupBy("locus", "effect").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = (
        ld.select("locus", "variant_a", "variant_b", (F.col("r") * F.col("r")).alias("r2"))
        .join(a, ["locus", "variant_a"])
        .join(b, ["locus", "effect", "variant_b"])
        .groupBy("locus", "effect")
        .agg(F.sum("r2").alias("s"), F.min("r2").alias("m"), F.count(F.lit(1)).alias("k"))
    )
    # pairs that are not listed have r2 = 0, the diagonal has 1
    purity = sizes.join(pairs, ["locus", "effect"], "left").select(
        "locus",
        "effect",
        ((F.lit(2.0) * F.coalesce("s", F.lit(0.0)) + F.col("n")) / (F.col("n") * F.col("n"))).alias("mean_r2"),
        F.when(F.coalesce("k", F.lit(0)) < F.col("n") * (F.col("n") - 1) / 2, F.lit(0.0))
        .otherwise(F.coalesce("m", F.lit(1.0)))
        .alias("min_r2"),
    )
    pure = purity.where(
        (F.col("mean_r2") >= settings["mean_r2"]) & (F.col("min_r2") >= settings["min_r2"])
    ).select("locus", "effect")
    return chosen.join(pure, ["locus", "effect"], "left_semi").select(
        "locus", F.col("effect").cast("int").alias("effect"), "variant", "alpha", "log_bf", "pip"
    )


def finemap_loci(
    rows: DataFrame,
    ld: DataFrame,
    *,
    effects: int = MAX_CAUSAL,
    prior: float = 50.0,
    lead_neglog10: float | None = None,
    mean_r2: float = PURITY_MEAN_R2,
    min_r2: float = PURITY_MIN_R2,
    min_log_bf: float = MIN_LOG_BF,
    mass: float = SUM_PIPS,
    task_variants: int = TASK_VARIANTS,
) -> DataFrame:
    """Credible sets per locus: ``locus, effect, variant, alpha, log_bf, pip``.

    ``rows`` holds locus, variant (texts) and z; of several rows of a variant in a locus the strongest counts;
    ``ld`` holds locus, variant_a, variant_b, r, pairs not listed count as 0.
    ``prior`` is the prior variance of an effect on the z scale. Loci whose
    strongest signal is below ``lead_neglog10`` are left out. A locus of up to
    ``task_variants`` is solved in a task; wider ones by joins over all such
    loci at once.
    """
    # read by every join below
    least, most = F.min("z"), F.max("z")
    rows = cut_lineage(
        rows.groupBy("locus", "variant").agg(F.when(F.abs(least) > F.abs(most), least).otherwise(most).alias("z"))
    )
    sizes = rows.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("z")).alias("top"))
    if lead_neglog10 is not None:
        least = -NormalDist().inv_cdf(10.0**-lead_neglog10 / 2.0)
        sizes = sizes.where(F.col("top") >= least)
    settings = {
        "effects": effects,
        "prior": prior,
        "mean_r2": mean_r2,
        "min_r2": min_r2,
        "min_log_bf": min_log_bf,
        "mass": mass,
    }
    # each pair once and only between variants of the locus, which bounds a task's share
    pairs = (
        ld.where(F.col("variant_a") != F.col("variant_b"))
        .groupBy(
            "locus",
            F.least("variant_a", "variant_b").alias("variant_a"),
            F.greatest("variant_a", "variant_b").alias("variant_b"),
        )
        .agg(F.max("r").alias("r"))
        .join(rows.select("locus", F.col("variant").alias("variant_a")), ["locus", "variant_a"], "left_semi")
        .join(rows.select("locus", F.col("variant").alias("variant_b")), ["locus", "variant_b"], "left_semi")
        .select("locus", "variant_a", "variant_b", "r")
    )
    small = sizes.where(F.col("n") <= task_variants).select("locus")
    ship_package(rows.sparkSession)
    narrow = (
        rows.join(small, "locus", "left_semi")
        .select("locus", "variant", "z")
        .groupBy("locus")
        .cogroup(
            pairs.join(small, "locus", "left_semi")
            .select(F.col("locus").alias("pair_locus"), "variant_a", "variant_b", "r")
            .groupBy("pair_locus")
        )
        .applyInPandas(_solve(settings), RESULT)
    )
    large = sizes.where(F.col("n") > task_variants).select("locus")
    if large.isEmpty():
        return narrow
    wide_pairs = cut_lineage(pairs.join(large, "locus", "left_semi"))
    state = _wide_effects(rows.join(large, "locus", "left_semi"), wide_pairs, effects, prior)
    return narrow.unionByName(_wide_sets(state, wide_pairs, settings))
