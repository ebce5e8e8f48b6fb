"""Reasons of credible sets on larger tables (F4), on rows of their own."""

import random

import pytest
from pyspark.sql import functions as F

from locusforge.operators import intervals, loci, validation
from locusforge.plans import steps


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


SETS = "locus string, study long, variant string, chrom string, pos long, s long, e long, ref string, alt string, v double, method string"


def some_sets(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        pos = rnd.randrange(600)
        rows.append((
            rnd.choice([None, "twice", f"l{i}", f"l{i}"]), rnd.choice([None, 1, 1, 2, 3]), rnd.choice([None, f"v{pos % 40}", f"v{pos % 40}"]),
            rnd.choice([None, "1", "1", "2"]), rnd.choice([None, pos, pos, pos]), pos - 2, pos + rnd.randrange(3),
            rnd.choice("ACGT"), rnd.choice("ACGT"), rnd.choice([None, 1.0, 3.0, float(rnd.randrange(2, 9))]),
            rnd.choice([None, "SuSiE", "PICS", "PICS top hit", "PICS top hit"]),
        ))
    return rows + rows[:9]


def validated(spark, sets, studies, known, pairs):
    return steps.credible_set_validation(
        spark.createDataFrame(sets, SETS), spark.createDataFrame(studies, "study long, bad boolean"),
        spark.createDataFrame(known, "variant string, ref string, alt string"),
        spark.createDataFrame(pairs, "variant string, tag string, r double"), locus="locus", study="study", variant="variant",
        chromosome="chrom", position="pos", start="s", end="e", ref="ref", alt="alt", strength="v", method="method",
        composite=F.col("v") == 5, failed=F.col("bad"), threshold=2, mhc=("2", 100, 200), width=10, distance=30,
    )


def expected_reasons(sets, studies, known, pairs):
    """The rules row by row; a set comes once for each known variant of its name."""
    leads = {}
    for _, study, variant, *_, v, _ in sets:
        best = leads.setdefault((study, variant), v)
        leads[study, variant] = max((x for x in (best, v) if x is not None), default=None)

    def order(key):
        return (leads[key] is not None, -(leads[key] or 0.0), key[1])

    picked = set()
    for study, chrom in {(r[1], r[3]) for r in sets if r[3] is not None}:
        rows = {(-r[9], r[4], (r[2] is not None, r[2] or ""), r[2]) for r in sets if r[1] == study and r[3] == chrom and None not in (r[4], r[9]) and r[9] >= 2}
        taken = []
        for _, pos, _, variant in sorted(rows):
            if all(abs(pos - p) >= 30 for p in taken):
                taken.append(pos)
                if None not in (study, variant):
                    picked.add((study, chrom, variant))
    found = []
    for row in sets:
        locus, study, variant, chrom, pos, s, e, ref, alt, v, method = row
        own = [b for k, b in studies if k == study and study is not None]

        def beside(kind):
            return any(o[1] == study is not None and o[10] == kind and o[5] <= e and s <= o[6] for o in sets)

        for match in [k[1:] for k in known if k[0] == variant and variant is not None] or [None]:
            clumped = study is not None and any(
                b is not None and t == variant is not None and r * r >= 0.5 and (study, b) in leads and order((study, b)) < order((study, variant)) for b, t, r in pairs
            )
            rules = {
                "DUPLICATED_STUDYLOCUS_ID": sum(o[0] == locus for o in sets) > 1, "AMBIGUOUS_STUDY": len(own) > 1,
                "FAILED_STUDY": any(own), "MISSING_STUDY": study is not None and not own,
                "NO_GENOMIC_LOCATION_FLAG": chrom is None or pos is None, "COMPOSITE_FLAG": v == 5,
                "INCONSISTENCY_FLAG": match is not None and (ref, alt) != match,
                "PALINDROMIC_ALLELE_FLAG": ref + alt in ("AT", "TA", "CG", "GC"), "SUBSIGNIFICANT_FLAG": v is not None and v < 2,
                "LD_CLUMPED": clumped, "IN_MHC": chrom == "2" and pos is not None and 100 <= pos <= 200,
                "REDUNDANT_PICS_TOP_HIT": method == "PICS top hit" and beside("PICS"),
                "EXPLAINED_BY_SUSIE": method not in (None, "SuSiE") and beside("SuSiE"),
                "WINDOW_CLUMPED": None not in (chrom, pos, v) and v >= 2 and (study, chrom, variant) not in picked,
                "NON_MAPPED_VARIANT_FLAG": match is None,
            }
            found.append((*row, [n for n, holds in rules.items() if holds]))
    return sorted(map(str, found))


STUDIES = [(1, False), (1, None), (2, True), (4, False)]
KNOWN = [(f"v{k}", "ACGT"[k % 4], "ACGT"[k % 3]) for k in range(30)] + [("v3", "G", "G"), (None, "A", "C")]


@pytest.mark.parametrize("seed", [1, 2])
def test_reasons_are_those_of_the_rules(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"v{rnd.randrange(40)}", f"v{rnd.randrange(40)}", rnd.random()) for _ in range(150)] + [(None, "v1", 1.0), ("v1", None, 1.0)]
    sets = some_sets(160, seed)
    good, bad = validated(spark, sets, STUDIES, KNOWN, pairs)
    got = [tuple(r) for r in good.collect()] + [tuple(r) for r in bad.collect()]
    assert not any(r["qualityControls"] for r in good.collect()) and all(r["qualityControls"] for r in bad.collect())
    assert sorted(map(str, got)) == expected_reasons(sets, STUDIES, KNOWN, pairs)


def test_sets_pass_three_joins(spark):
    good, _ = validated(spark, some_sets(20, 1), STUDIES, KNOWN, [("v1", "v2", 0.9)])
    plan = plan_of(good)
    whole, depth = 0, None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if depth is None or indent > depth:
            depth = indent
            whole += " Join " in f" {line.lstrip(' :+-')}"
        else:
            break
    # the first branch down from the result is that of the sets themselves
    assert whole == 3


def test_reasons_keep_their_order_and_skip_unknown(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a int, b int")
    got = validation.qc_flags(df, {"B": F.col("b") > 1, "A": F.col("a") > 0, "N": F.lit(None).cast("boolean")})
    assert [r["qualityControls"] for r in got.collect()] == [["A"], ["B"], ["B", "A"]]
    assert not got.schema["qualityControls"].dataType.containsNull
    assert "lambda" not in plan_of(got)


def test_several_better_methods_are_looked_up_in_one_join(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, "a", "b"]), s := rnd.randrange(400), s + rnd.randrange(-3, 60), rnd.choice([None, "x", "y", "z"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "study string, s long, e long, kind string")
    got = loci.explained_by(
        df, {"by_x": df.where("kind = 'x'"), "by_y": df.where("kind = 'y'")}, locus=["s", "e", "study"], by=["study"], start="s",
        end="e", width=25, asked={"by_x": F.col("kind") != "x"}, places=df,
    )

    def beside(row, kind):
        return any(o[3] == kind and o[0] == row[0] is not None and row[1] <= o[2] and o[1] <= row[2] for o in rows)

    expected = [(*r, r[3] not in (None, "x") and beside(r, "x"), beside(r, "y")) for r in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert plan_of(got).count("LeftOuter") == 1
    one = intervals.mark_overlapping(df, df.where("kind = 'y'"), key=["s", "e", "study"], by=["study"], start="s", end="e", width=25, out="hit")
    assert sorted(r["hit"] for r in one.collect()) == sorted(beside(r, "y") for r in rows)


def test_signals_alone_are_not_compared(spark, monkeypatch):
    seen = []
    fold = loci._fold_islands
    monkeypatch.setattr(loci, "_fold_islands", lambda rows, *a: seen.append(rows.count()) or fold(rows, *a))
    rows = [(None if k % 2 else "s", 1000 * k, 9.0, k) for k in range(50)] + [("s", 7, 9.5, 99), ("s", 2100, 9.0, 98), ("s", 4100, 8.9, 97)]
    df = spark.createDataFrame(rows, "study string, pos long, v double, id long")
    got = loci.window_clump(df, ["study"], position="pos", strength="v", tie="id", distance=100, threshold=8.0)
    assert {r["lead_id"] for r in got.collect()} == set(range(1, 50)) | {97, 98, 99}
    assert got.count() == 52 and seen == [2]


def test_most_partners_that_are_no_leads_stay_out_of_the_shuffle(spark):
    leads = spark.range(3000).select((F.col("id") % 1000).alias("study"), (F.col("id") % 100).alias("variant"), F.col("id").cast("double").alias("v"))
    pairs = spark.range(100).select(F.col("id").alias("variant"), ((F.col("id") * 7 + 3) % 100).alias("tag"), F.lit(0.9).alias("r"))
    sketch = loci._study_sketch(leads, "study", "variant")
    ways = loci.ld_join(leads, pairs, variant="variant").join(sketch, F.col("tag") == F.col("__led"))
    kept = ways.where(loci._sketched(F.col("study"))).select("study", "tag").distinct()
    held = leads.select("study", F.col("variant").alias("tag")).distinct()
    met = ways.select("study", "tag").distinct().join(held, ["study", "tag"], "left_semi")
    assert met.join(kept, ["study", "tag"], "left_anti").isEmpty()
    assert kept.count() < 0.2 * ways.select("study", "tag").distinct().count()
    assert "__w0" in plan_of(loci.ld_clump(leads, pairs, study="study", variant="variant", strength="v"))
