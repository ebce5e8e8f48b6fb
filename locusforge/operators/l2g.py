"""Locus-to-gene: features, model, predictions, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.operators.graph import connected
from locusforge.operators.scale import row_numbers
from locusforge.session import cut_lineage

# Model settings and the evidence threshold.
ESTIMATORS = 100
DEPTH = 5
EVIDENCE_THRESHOLD = 0.05
# Least score at which a gene that interacts with a positive is no negative, and parts of cross-validation.
INTERACTION_SCORE = 0.8
FOLDS = 5


def l2g_features(
    credible_sets: DataFrame,
    variant_genes: DataFrame,
    colocalisation: DataFrame,
    studies: DataFrame,
    genes: DataFrame,
    *,
    locus: str,
    variant: str,
    gene: str,
    study: str,
    pip: str,
    distance: str,
    coloc_score: str,
) -> DataFrame:
    """One row per (locus, gene) with distance and colocalisation features.

    Members are reduced per (locus, gene) before studies, genes and
    colocalisation are joined, so the later joins carry one row per pair.
    """
    members = credible_sets.select(locus, study, variant, pip).join(
        variant_genes.select(variant, gene, distance), variant
    )
    base = members.groupBy(locus, study, gene).agg(
        F.min(distance).alias("distance_min"),
        F.sum(F.col(pip) * F.col(distance)).alias("distance_weighted"),
        F.max(pip).alias("pip_max"),
        F.sum(pip).alias("pip_sum"),
        F.count(F.lit(1)).alias("n_variants"),
    )
    colocs = colocalisation.groupBy(locus, gene).agg(F.max(coloc_score).alias("coloc_max"))
    return (
        base.join(studies, study, "left_semi")
        .join(genes, gene)
        .join(colocs, [locus, gene], "left")
        .withColumn("coloc_max", F.coalesce("coloc_max", F.lit(0.0)))
    )


def score_threshold(df: DataFrame, score: str, threshold: float = EVIDENCE_THRESHOLD) -> DataFrame:
    """Predictions at or above the threshold."""
    return df.where(F.col(score) >= F.lit(float(threshold)))


def l2g_labels(
    pairs: DataFrame,
    gold: DataFrame,
    interactions: DataFrame,
    *,
    locus: str,
    gene: str,
    partner: str,
    score: str,
    min_score: float = INTERACTION_SCORE,
    folds: int = FOLDS,
) -> DataFrame:
    """Labelled (locus, gene) pairs for training: ``locus, gene, label, component, fold``.

    ``pairs`` are the candidates, ``gold`` the (locus, gene) pairs held to be
    true. A gold pair among the candidates is a positive. The other genes of a
    locus with a positive are negatives, but for those that an interaction of at
    least ``min_score``, in either direction, ties to a positive gene of the
    locus: they may be true themselves and have no label. Loci that share a
    gene are one component, and a component lies in one fold.
    """
    key = [locus, gene]
    candidates = pairs.select(*key).distinct()
    positives = cut_lineage(candidates.join(gold.select(*key).distinct(), key))
    others = candidates.join(positives.select(locus).distinct(), locus, "left_semi").join(positives, key, "left_anti")
    strong = interactions.where(F.col(score) >= F.lit(float(min_score)))
    both = strong.select(F.col(gene).alias("__a"), F.col(partner).alias("__b")).unionByName(
        strong.select(F.col(partner).alias("__a"), F.col(gene).alias("__b"))
    ).distinct()
    tied = positives.join(both, F.col(gene) == F.col("__a")).select(locus, F.col("__b").alias(gene)).distinct()
    labelled = positives.withColumn("label", F.lit(1)).unionByName(
        others.join(tied, key, "left_anti").withColumn("label", F.lit(0))
    )
    labelled = cut_lineage(labelled)
    parts = connected(labelled, locus, gene).select(F.col("node").alias(locus), "component")
    fold = F.pmod(F.xxhash64("component"), F.lit(folds)).cast("int").alias("fold")
    return labelled.join(parts, locus).select(locus, gene, "label", "component", fold)


def l2g_train(
    features: DataFrame,
    gold: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    label: str = "label",
    estimators: int = ESTIMATORS,
    depth: int = DEPTH,
) -> PipelineModel:
    """Gradient-boosted trees on the features of the gold-standard pairs."""
    # every pass of the training reads the rows, so features are computed once
    rows = cut_lineage(features.join(gold.select(*keys, F.col(label).cast("double").alias(label)), list(keys)))
    assemble = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(
        featuresCol="features",
        labelCol=label,
        maxIter=estimators,
        maxDepth=depth,
        lossType="logistic",
        seed=42,
        cacheNodeIds=True,
    )
    return Pipeline(stages=[assemble, trees]).fit(rows)


def l2g_predict(model: PipelineModel, features: DataFrame, out: str = "score") -> DataFrame:
    """Score of the positive class per row."""
    scored = model.transform(features).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def l2g_evidence(
    predictions: DataFrame,
    credible_sets: DataFrame,
    studies: DataFrame,
    *,
    locus: str,
    gene: str,
    study: str,
    score: str,
    threshold: float = EVIDENCE_THRESHOLD,
) -> DataFrame:
    """Predictions above the threshold with study columns and the gene's rank in its locus.

    """
    kept = row_numbers(
        score_threshold(predictions, score, threshold), [locus], [F.col(score).desc(), F.col(gene)], "rank"
    )
    loci = credible_sets.select(locus, study).distinct()
    return kept.join(loci, locus).join(studies, study)
