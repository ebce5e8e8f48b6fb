"""Operators against plain Python on frames with one dominating group, ties and edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusforge.operators import finemap, graph, intervals, loci, posteriors, scale, variants


def skewed(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = [
        ("hot" if rnd.random() < 0.4 else f"g{rnd.randrange(40)}", rnd.randrange(200), rnd.randrange(1, 50), i)
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "grp string, k long, v long, id long").repartition(7)


def test_running_total(spark):
    rows, df = skewed(spark)
    got = {
        r["id"]: r["t"]
        for r in scale.running_total(df, ["grp"], [F.col("k").desc(), F.col("id").asc()], F.col("v"), "t").collect()
    }
    expected, sums = {}, {}
    for grp, k, v, i in sorted(rows, key=lambda r: (r[0], -r[1], r[3])):
        sums[grp] = sums.get(grp, 0) + v
        expected[i] = sums[grp]
    assert got == expected


def test_running_total_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v long")
    rows = scale.running_total(df, ["g"], [F.col("v")], F.col("v"), "t").collect()
    assert sorted((r["g"] or "", r["t"]) for r in rows) == [("", 1), ("", 3), ("a", 3)]


def test_row_numbers_without_group(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["n"] for r in scale.row_numbers(df, [], [F.col("k"), F.col("id")], "n").collect()}
    expected = {r[3]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[3])), 1)}
    assert got == expected


def test_log_sum_exp_extremes(spark):
    rows = [("a", 800.0), ("a", 801.0), ("a", -900.0), ("b", -2000.0), ("b", -2000.5), ("c", None), ("c", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["s"] for r in scale.log_sum_exp(df, ["g"], s=F.col("x")).collect()}
    assert math.isclose(got["a"], 801 + math.log1p(math.exp(-1)), rel_tol=1e-12)
    assert math.isclose(got["b"], -2000 + math.log1p(math.exp(-0.5)), rel_tol=1e-12)
    assert math.isclose(got["c"], 3.0, rel_tol=1e-12)


def test_nest_rows_keeps_everything(spark):
    rows, df = skewed(spark)
    nested = scale.nest_rows(df, ["grp"], F.struct("k", "id"), "items", max_items=100).collect()
    assert sum(1 for r in nested if r["grp"] == "hot") > 1
    assert sorted(x["id"] for r in nested for x in r["items"]) == list(range(len(rows)))
    small = [r for r in nested if r["grp"] == "g0"]
    assert len(small) == 1 and small[0]["part"] == 0
    assert [tuple(x) for x in small[0]["items"]] == sorted((r[1], r[3]) for r in rows if r[0] == "g0")


@pytest.mark.parametrize("limit", [3, 1500])
def test_top_rows(spark, limit):
    rows, df = skewed(spark)
    got = {(r["grp"], r["rank"]): r["id"] for r in scale.top_rows(df, ["grp"], [F.col("k"), F.col("id")], limit).collect()}
    expected = {}
    for grp in {r[0] for r in rows}:
        inside = sorted((r for r in rows if r[0] == grp), key=lambda r: (r[1], r[3]))
        expected.update({(grp, n): r[3] for n, r in enumerate(inside[:limit], 1)})
    assert got == expected


@pytest.mark.parametrize("count", [0, 1, 1999, 2000, 2001, 4000])
def test_chunk_edges(spark, count):
    df = spark.range(count).select(F.col("id").cast("string").alias("id"))
    row = variants.chunk_check(variants.chunk_sorted(df, [F.col("id")], 2000), 2000).first()
    assert row["n_rows"] == count and row["ok"] and row["n_chunks"] == math.ceil(count / 2000)


def test_chunk_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        variants.chunk_sorted(spark.range(3), [F.col("id")], 0)


def test_chromosome_sorts_as_text_nulls_last(spark):
    df = spark.createDataFrame(
        [("2", 5, "A", "C"), ("10", 1, "A", "C"), ("10", None, "A", "C"), (None, 1, "A", "C"), ("1", 9, "A", "C")],
        "`#CHROM` string, POS long, REF string, ALT string",
    )
    got = [(r["#CHROM"], r["POS"]) for r in variants.sort_variants(df).collect()]
    assert got == [("1", 9), ("10", 1), ("10", None), ("2", 5), (None, 1)]


def test_dedup_keeps_first_payload(spark):
    df = spark.createDataFrame([("1", 5, "z"), ("1", 5, "a"), ("2", 5, "m")], "c string, p long, x string")
    got = {tuple(r) for r in variants.dedup_first(df, ["c", "p"], [F.col("x")]).collect()}
    assert got == {("1", 5, "a"), ("2", 5, "m")}


def greedy(rows, distance):
    leads = []
    for neg, pos, i in sorted(rows):
        if all(abs(pos - p) >= distance for _, p, _ in leads):
            leads.append((neg, pos, i))
    return {i for _, _, i in leads}


@pytest.mark.parametrize("fold", [0, 20, 100_000])
def test_window_clump(spark, fold):
    rnd = random.Random(5)
    rows = []
    for i in range(1200):
        study = "hot" if rnd.random() < 0.5 else f"s{rnd.randrange(5)}"
        rows.append((study, rnd.randrange(20_000), float(rnd.randrange(5, 30)), i))
    # a chain in which every signal is claimed by a slightly stronger neighbour
    rows += [("chain", 50 * n, 100.0 - n * 0.1, 10_000 + n) for n in range(60)]
    df = spark.createDataFrame(rows, "study string, pos long, v double, id long")
    got = loci.window_clump(
        df, ["study"], position="pos", strength="v", tie="id", distance=100, threshold=8.0, fold_positions=fold
    ).collect()
    by_study = {}
    for study, pos, v, i in rows:
        if v >= 8.0:
            by_study.setdefault(study, []).append((-v, pos, i))
    expected = {s: greedy(r, 100) for s, r in by_study.items()}
    assert {s: {r["lead_id"] for r in got if r["study"] == s} for s in expected} == expected


@pytest.mark.parametrize("fold", [0, 1000])
def test_window_clump_without_study(spark, fold):
    rows = [(None, 5, 9.0, 1), (None, 30, 8.5, 2), (None, 500, 8.0, 3), (None, None, 99.0, 4)]
    df = spark.createDataFrame(rows, "study string, pos long, v double, id long")
    got = loci.window_clump(
        df, ["study"], position="pos", strength="v", tie="id", distance=100, threshold=8.0, fold_positions=fold
    )
    assert sorted(r["lead_id"] for r in got.collect()) == [1, 3]


def test_locus_breaker_gap_equal_to_cutoff(spark):
    df = spark.createDataFrame(
        [("s", 0, 9.0, 1), ("s", 100, 9.0, 2), ("s", 201, 12.0, 3), ("s", 250, 1.0, 4), ("s", 301, 9.0, 5)],
        "study string, pos long, v double, id long",
    )
    args = dict(position="pos", strength="v", tie="id", baseline=5.0, gap=100, flank=10)
    rows = loci.locus_breaker(df, ["study"], threshold=5.0, **args).orderBy("start").collect()
    assert [(r["start"], r["end"], r["n"], r["lead_id"]) for r in rows] == [(-10, 110, 2, 1), (191, 311, 2, 3)]
    assert loci.locus_breaker(df, ["study"], threshold=10.0, **args).count() == 1


def test_range_joins_match_brute_force(spark):
    rnd = random.Random(3)
    points = [("c" + str(rnd.randrange(2)), rnd.randrange(-500, 1000), i) for i in range(300)]
    bounds = [("c" + str(rnd.randrange(2)), s := rnd.randrange(-500, 900), s + rnd.randrange(0, 300), i) for i in range(60)]
    p = spark.createDataFrame(points, "chrom string, pos long, id long")
    b = spark.createDataFrame(bounds, "chrom string, s long, e long, iv long")
    got = {
        (r["id"], r["iv"])
        for r in intervals.join_points_to_intervals(p, b, by=["chrom"], point="pos", start="s", end="e", width=70).collect()
    }
    assert got == {(i, j) for c, x, i in points for d, s, e, j in bounds if c == d and s <= x <= e}
    marked = intervals.mark_overlapping(
        b, b.where("iv < 10"), key="iv", by=["chrom"], start="s", end="e", width=70, out="hit"
    )
    expected = {
        j: any(c == d and s <= e2 and s2 <= e for d, s2, e2, k in bounds if k < 10) for c, s, e, j in bounds
    }
    assert {r["iv"]: r["hit"] for r in marked.collect()} == expected


def test_exclude_region_keeps_missing_positions(spark):
    df = spark.createDataFrame([("6", 30), ("6", 50), ("7", 30), ("6", None)], "c string, p long")
    kept = {tuple(r) for r in intervals.exclude_region(df, "p", 20, 40, "c", "6").collect()}
    assert kept == {("6", 50), ("7", 30), ("6", None)}


def test_closure_with_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("e", "d"), (None, "d")]
    df = spark.createDataFrame(edges, "child string, parent string")
    got = {(r["node"], r["ancestor"]): r["depth"] for r in graph.hierarchy_closure(df, "child", "parent").collect()}
    assert got == {
        ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "d"): 2, ("c", "a"): 1,
        ("c", "d"): 1, ("c", "b"): 2, ("e", "d"): 1,
    }


@pytest.mark.parametrize("length", [1, 2, 3, 7, 8, 9])
def test_closure_of_a_chain(spark, length):
    df = spark.createDataFrame([(i, i + 1) for i in range(length)], "child long, parent long")
    got = {(r["node"], r["ancestor"]): r["depth"] for r in graph.hierarchy_closure(df, "child", "parent").collect()}
    assert got == {(i, j): j - i for i in range(length + 1) for j in range(i + 1, length + 1)}
    short = graph.hierarchy_closure(df, "child", "parent", include_self=True, max_depth=3).collect()
    assert {(r["node"], r["ancestor"]) for r in short} == {
        (i, j) for i in range(length + 1) for j in range(i, length + 1) if j - i <= 3
    }


def test_closure_of_nothing(spark):
    df = spark.createDataFrame([], "child long, parent long")
    assert graph.hierarchy_closure(df, "child", "parent").isEmpty()


def test_credible_set_flat_locus(spark):
    rows = [("flat", i, 0.01) for i in range(100)] + [("sharp", 0, 0.995), ("sharp", 1, 0.005), ("none", 0, None)]
    df = spark.createDataFrame(rows, "locus string, v long, pip double")
    got = posteriors.credible_set(df, ["locus"], pip="pip", tie="v", mass=0.95).groupBy("locus").count().collect()
    assert {r["locus"]: r["count"] for r in got} == {"flat": 95, "sharp": 1, "none": 1}


def test_posteriors_sum_to_one(spark):
    rows = [("a", i, float(i)) for i in range(50)] + [("b", i, -3000.0 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "locus string, v long, bf double")
    sums = posteriors.single_effect_posterior(df, ["locus"], "bf").groupBy("locus").agg(F.sum("pip").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums.collect())


@pytest.mark.parametrize("block", [2, 1000])
def test_overlaps_of_a_hot_variant(spark, block):
    rows = [(i, "hot") for i in range(30)] + [(i, f"v{i % 7}") for i in range(30)]
    df = spark.createDataFrame(rows, "locus long, variant string")
    got = {
        (r["left_locus"], r["right_locus"], r["variant"])
        for r in posteriors.credible_set_overlaps(df, locus="locus", variant="variant", block=block).collect()
    }
    assert got == {(a, b, v) for a, v in rows for b, w in rows if v == w and a < b}


def test_coloc(spark):
    pairs = [(1, 2, "x", 4.0, 5.0, 0.5, 0.25), (1, 2, "y", 1.0, 700.0, 0.5, 0.5), (3, 4, "x", 4.0, 9.0, 1.0, 1.0)]
    df = spark.createDataFrame(
        pairs,
        "left_locus int, right_locus int, variant string, left_log_bf double, right_log_bf double, p double, q double",
    )
    # loci 1 and 2 have variants that they do not share
    whole = {1: [4.0, 1.0, 6.0], 2: [5.0, 700.0, 699.0], 3: [4.0], 4: [9.0]}
    rows = spark.createDataFrame([(k, v) for k, x in whole.items() for v in x], "locus int, bf double")
    found = posteriors.coloc(df, rows, locus="locus", log_bf="bf", pips=("p", "q")).collect()
    got = {r["right_locus"]: r for r in found}
    for r in got.values():
        assert abs(sum(r[f"h{i}"] for i in range(5)) - 1) < 1e-12
    assert got[4]["h3"] == 0.0
    assert abs(got[2]["clpp"] - 0.375) < 1e-12 and got[2]["n_shared"] == 2
    lse = lambda x: x.max() + np.log(np.exp(x - x.max()).sum())
    s1, s2, s12 = lse(np.array(whole[1])), lse(np.array(whole[2])), lse(np.array([9.0, 701.0]))
    h = np.array([
        0.0, math.log(1e-4) + s1, math.log(1e-4) + s2,
        2 * math.log(1e-4) + s1 + s2 + math.log1p(-math.exp(s12 - s1 - s2)), math.log(1e-5) + s12,
    ])
    assert np.allclose([got[2][f"h{i}"] for i in range(5)], np.exp(h - lse(h)), atol=1e-9)


def susie_case(spark):
    rng = np.random.default_rng(0)
    n = 12
    base = rng.normal(size=(400, n))
    base[:, 1] = base[:, 0] + 0.3 * base[:, 1]
    base[:, 7] = base[:, 6] + 0.3 * base[:, 7]
    ld = np.corrcoef(base, rowvar=False)
    z = ld @ (8.0 * np.eye(n)[0] + 7.0 * np.eye(n)[6])
    rows = spark.createDataFrame([("L", f"v{i:02d}", float(z[i])) for i in range(n)], "locus string, variant string, z double")
    pairs = spark.createDataFrame(
        [("L", f"v{i:02d}", f"v{j:02d}", float(ld[i, j])) for i in range(n) for j in range(i + 1, n)],
        "locus string, variant_a string, variant_b string, r double",
    )
    return rows, pairs


def test_susie_by_joins_equals_susie_in_a_task(spark):
    rows, pairs = susie_case(spark)
    kinds = {}
    for name, limit in (("task", 100), ("joins", 5)):
        found = finemap.finemap_loci(rows, pairs, effects=2, task_variants=limit).collect()
        kinds[name] = {(r["effect"], r["variant"]): (r["alpha"], r["log_bf"], r["pip"]) for r in found}
    assert kinds["task"] and kinds["task"].keys() == kinds["joins"].keys()
    for key, values in kinds["task"].items():
        assert np.allclose(values, kinds["joins"][key], atol=1e-3)
    assert {"v00", "v06"} <= {v for _, v in kinds["task"]}


def test_wide_loci_settle_each_on_its_own(spark):
    rows, pairs = susie_case(spark)
    # the weak locus takes two sweeps more than the other
    both = rows.unionByName(rows.withColumns({"locus": F.lit("weak"), "z": F.col("z") * 0.3}))
    state = finemap._wide_effects(both, pairs.unionByName(pairs.withColumn("locus", F.lit("weak"))), 2, 50.0, tol=0.02)
    got = state.select("locus", "variant", "alpha").collect()
    ld = np.eye(12)
    for r in pairs.collect():
        i, j = int(r["variant_a"][1:]), int(r["variant_b"][1:])
        ld[i, j] = ld[j, i] = r["r"]
    z = np.array([r["z"] for r in sorted(rows.collect(), key=lambda r: r["variant"])])
    for locus, scaled in (("L", z), ("weak", 0.3 * z)):
        alpha, _ = finemap.susie(scaled, ld, 2, 50.0, tol=0.02)
        mine = [r["alpha"] for r in sorted((r for r in got if r["locus"] == locus), key=lambda r: r["variant"])]
        assert np.allclose(np.array(mine).T, alpha, atol=1e-9)


def test_pics_lead_has_most(spark):
    df = spark.createDataFrame([("l", "lead", 9.0, 1.0), ("l", "near", 9.0, 0.9), ("l", "far", 9.0, 0.3)], "locus string, tag string, m double, r2 double")
    got = {r["tag"]: r["pip"] for r in posteriors.pics(df, ["locus"], lead_strength="m", r2="r2").collect()}
    assert set(got) == {"lead", "near"} and got["lead"] > got["near"] and abs(sum(got.values()) - 1) < 1e-12


@pytest.mark.parametrize("tile_rows", [25])
def test_window_clump_over_tile_borders(spark, tile_rows):
    rnd = random.Random(8)
    rows = [("loose", rnd.randrange(3_000), float(rnd.randrange(8, 40)), i) for i in range(400)]
    rows += [("rising", 30 * n, 10.0 + n, 1_000 + n) for n in range(80)]
    rows += [("wave", 40 * n, 50.0 + (n % 13) * (-1) ** (n // 13), 2_000 + n) for n in range(100)]
    df = spark.createDataFrame(rows, "study string, pos long, v double, id long")
    got = loci.window_clump(
        df, ["study"], position="pos", strength="v", tie="id", distance=100, threshold=8.0, fold_positions=0, tile_rows=tile_rows
    ).collect()
    for study in ("loose", "rising", "wave"):
        want = greedy([(-v, pos, i) for s, pos, v, i in rows if s == study], 100)
        assert {r["lead_id"] for r in got if r["study"] == study} == want


def jobs_of(spark, run):
    """Spark jobs that a call starts."""
    name = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_clumping_jobs_do_not_grow_with_a_chain(spark):
    counts = []
    for windows in (5, 20, 100):
        rows = [("chain", 50 * n, 10.0 + n, n) for n in range(2 * windows)]
        df = spark.createDataFrame(rows, "study string, pos long, v double, id long")
        args = dict(position="pos", strength="v", tie="id", distance=100, threshold=8.0, fold_positions=0)
        counts.append(jobs_of(spark, lambda: loci.window_clump(df, ["study"], **args).collect()))
    assert counts[0] == counts[1] == counts[2]


def test_one_effect_of_a_wide_locus_reads_no_ld(spark):
    """The fit by joins equals the one in a task; a table of LD that can't be read isn't needed."""
    rnd = random.Random(2)
    z = [rnd.gauss(0, 1) + (6 if i == 3 else 0) for i in range(40)]
    rows = spark.createDataFrame([("L", f"v{i:02d}", x) for i, x in enumerate(z)], "locus string, variant string, z double")
    broken = spark.range(1).select(
        F.lit("L").alias("locus"), F.lit("v00").alias("variant_a"), F.lit("v01").alias("variant_b"), F.raise_error(F.lit("read")).cast("double").alias("r")
    )
    state = finemap._wide_effects(rows, broken, 1, 50.0).collect()
    alpha, lbf = finemap.susie(np.array(z), np.eye(40), 1, 50.0)
    for r in state:
        assert abs(r["alpha"][0] - alpha[0][int(r["variant"][1:])]) < 1e-9 and abs(r["lbf"][0] - lbf[0]) < 1e-9
