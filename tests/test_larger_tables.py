"""Findings of round 3 about larger tables, on rows of their own."""

import math
import re

from pyspark.sql import functions as F

from locusforge.functions.stats import rounded
from locusforge.operators import l2g, posteriors


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounded_is_what_round_gives(spark):
    values = [0.0, -0.0, 0.005, 0.015, 1.005, 2.675, 99.995, 0.125, -0.125, -0.001, 1e-300, 1e300, 1e15 + 0.3, 12345678.915]
    values += [k / 1000 for k in range(-3000, 3000)] + [math.sqrt(k) for k in range(2000)] + [k * 50.01 - 17.37 for k in range(2000)]
    values += [float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 5):
        rows = df.select("x", rounded(F.col("x"), digits).alias("a"), F.round("x", digits).alias("b")).collect()
        assert [r["x"] for r in rows if repr(r["a"]) != repr(r["b"])] == []


def test_weights_of_tags_are_compiled_and_computed_once(spark):
    rows = [("a", 8.0, 1.0), ("a", 8.0, 0.9), ("a", 8.0, 0.6), ("b", 30.0, 0.5), ("b", 30.0, 1.0 + 1e-12), (None, 5.0, 0.7), (None, 5.0, 0.99)]
    rows += [("c", None, 0.8), ("c", 9.0, None), ("c", 9.0, 0.1)]
    source = spark.createDataFrame(rows, "locus string, m double, r2 double")
    got = posteriors.pics(source.groupBy("locus", "r2").agg(F.max("m").alias("m")), ["locus"], lead_strength="m", r2="r2")
    weights = {}
    for locus, m, r2 in rows:
        if r2 is not None and r2 >= 0.5:
            sd = 0.0 if m is None else math.sqrt(1 - min(math.sqrt(r2), 1.0) ** 6.4) * math.sqrt(m) / 2
            weights[locus, r2] = math.erfc((m - r2 * m) / sd / math.sqrt(2)) if sd > 0 else 1.0
    totals = {locus: sum(w for (k, _), w in weights.items() if k == locus) for locus, _ in weights}
    pips = {(r["locus"], r["r2"]): r["pip"] for r in got.collect()}
    assert pips.keys() == weights.keys()
    assert all(abs(p - weights[k] / totals[k[0]]) < 1e-9 for k, p in pips.items())
    plan = got._jdf.queryExecution().executedPlan()
    assert "Join" not in plan.toString()
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenString(plan)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", code)]
    # Java compiles no larger methods
    assert sizes and all(0 < n < 8000 for n in sizes)


def test_training_computes_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def feature(k):
        seen.add(1)
        return float(k % 7)

    df = spark.range(80, numPartitions=2).select("id", F.udf(feature, "double")("id").alias("a"), F.rand(1).alias("b"))
    gold = spark.range(80).select("id", (F.col("id") % 7 > 3).cast("int").alias("label"))
    l2g.l2g_train(df, gold, ["id"], ["a", "b"], estimators=2, depth=2)
    assert seen.value == 80
