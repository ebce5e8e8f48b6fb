"""Findings of round 4, on rows of their own."""

import re
import time

import pytest
from pyspark.sql import functions as F

from locusforge import session
from locusforge.llm import mixing
from locusforge.operators import graph, intervals
from locusforge.plans import steps


@pytest.mark.parametrize("size", [750_000_000, 2_000_000_000, 3_000_000_000])
def test_targets_of_large_sources(spark, size):
    # weights 3, 1, 2: the first source is full, the others share what it leaves
    sizes = {"a": size // 10, "b": size // 10 * 4, "c": size // 2}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    left = 1.5 * size - 2 * sizes["a"]
    expected = {"a": 2.0 * sizes["a"], "b": left / 3, "c": left * 2 / 3}
    assert {r["source"]: r["source_size"] for r in rows} == sizes
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(expected)


def test_targets_where_full_sources_pass_32_bits(spark):
    sizes = {"a": 600_000_000, "b": 2_000_000_000}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in rows} == pytest.approx({"a": 1.2e9, "b": 2.7e9})


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_stored_leaves_no_shuffle_files(spark):
    kept = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    assert kept.count() == 7
    before = shuffle_files(spark)
    setting = spark.conf.get(session.CLEANUP_SETTING)
    got = session.stored(spark.range(1000).repartition(4).groupBy((F.col("id") % 5).alias("k")).count(), "kept")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert {tuple(r) for r in got.collect()} == {(k, 200) for k in range(5)}
    assert spark.conf.get(session.CLEANUP_SETTING) == setting


def test_sets_meet_their_reasons_by_number(spark):
    """What is shuffled at the end is keyed by the number of a row; a variant known twice gives its sets twice, as ever."""
    places = "study string, variant string, chromosome string, position long, start long, end long, ref string, alt string"
    sets = [("l1", "s1", "v1", "1", 100, 90, 110, "A", "C", 9.0, "SuSiE"), ("l1", "s1", "v2", "1", 105, 95, 115, "A", "T", 1.0, "PICS")]
    sets += [("l2", "s2", "v2", None, 105, 95, 115, "G", "T", 8.0, "PICS"), (None, None, None, "1", None, None, None, None, None, 7.0, None)]
    sets += [("l3", "s1", "v3", "1", 5000, 4990, 5010, "A", "C", 9.0, "PICS top hit")] * 2
    sets = spark.createDataFrame(sets, f"locus string, {places}, strength double, method string")
    known = spark.createDataFrame([("v1", "A", "C"), ("v2", "A", "T"), ("v2", "G", "T")], "variant string, ref string, alt string")
    studies = spark.createDataFrame([("s1", True)], "study string, bad boolean")
    ld = spark.createDataFrame([("v1", "v2", 0.9)], "variant string, tag string, r double")
    good, bad = steps.credible_set_validation(
        sets, studies, known, ld, locus="locus", study="study", variant="variant", chromosome="chromosome", position="position",
        start="start", end="end", ref="ref", alt="alt", strength="strength", method="method", composite=F.lit(False),
        failed=F.col("bad"), threshold=2, mhc=("6", 1, 2), width=100, distance=10,
    )
    plan = bad.select("locus", "qualityControls")._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)
    assert all(k.startswith("__row") for k in keys) and len(keys) <= 4
    assert good.count() == 0
    pairs = "DUPLICATED_STUDYLOCUS_ID FAILED_STUDY".split()
    weak = [*pairs, "PALINDROMIC_ALLELE_FLAG", "SUBSIGNIFICANT_FLAG", "LD_CLUMPED", "EXPLAINED_BY_SUSIE"]
    lost = ["MISSING_STUDY", "NO_GENOMIC_LOCATION_FLAG"]
    expected = [("l1", "v1", pairs), ("l1", "v2", weak), ("l1", "v2", [*pairs, "INCONSISTENCY_FLAG", *weak[2:]])]
    expected += [("l2", "v2", lost), ("l2", "v2", [*lost[:2], "INCONSISTENCY_FLAG"])]
    expected += [(None, None, ["NO_GENOMIC_LOCATION_FLAG", "NON_MAPPED_VARIANT_FLAG"])]
    expected += [("l3", "v3", [*pairs, "NON_MAPPED_VARIANT_FLAG"])] * 2
    got = [(r["locus"], r["variant"], r["qualityControls"]) for r in bad.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_phenotypes_come_in_lists(spark, monkeypatch):
    monkeypatch.setattr(graph, "PHENOTYPE_LIST", 2)
    terms = [("a", ["x", "y"]), ("b", ["y", "x", None]), ("c", ["x"]), ("d", ["z"]), (None, ["z"]), ("e", ["n"]), ("f", ["none"])]
    notes = [("x", f"p{k % 9}") for k in range(18)] + [("y", "p1"), ("y", None), ("z", "q"), ("n", None), ("n", None), (None, "s")]
    got = graph.disease_phenotypes(
        spark.createDataFrame(terms, "id string, refs array<string>"), spark.createDataFrame(notes, "disease string, phenotype string"),
        term="id", references="refs", on="disease", phenotype="phenotype", block=1,
    )
    expected = {(t, p) for t, refs in terms for r in refs for d, p in notes if r is not None and r == d}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")


def test_genes_of_a_bin_are_merged(spark):
    rows = [(k, k % 3, float(k * 7 % 50)) for k in range(60)] + [(60, 1, None), (61, None, 5.0)]
    sites = [(k, k % 3, float(k * 11 % 60)) for k in range(40)] + [(7, 1, 3.0), (40, 0, None), (41, None, 5.0)]
    variants = spark.createDataFrame(rows, "id int, chromosome int, pos double")
    genes = spark.createDataFrame(sites, "gene int, chromosome int, site double")
    near = intervals.gene_distance(variants, genes, by=["chromosome"], position="pos", site="site", distance=5)
    got = sorted((r["id"], r["gene"], r["distance"]) for r in near.collect())
    assert got == sorted(
        (i, g, abs(p - x)) for i, c, p in rows for g, d, x in sites if None not in (c, p, x) and c == d and abs(p - x) <= 5
    )
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
