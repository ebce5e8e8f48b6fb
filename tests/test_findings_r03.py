"""Findings of round 3, on rows of their own."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from locusforge.llm import perplexity, tokenalign
from locusforge.llm.words import chunks
from locusforge.operators import evidence, finemap, graph, loci, variants
from locusforge.sources import readers, sinks


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_phenotype_pairs_are_not_shuffled(spark):
    terms = [("a", ["x", "y", "x", None]), ("b", ["y", "x"]), ("c", ["x"]), ("c", ["z"]), (None, ["y"]), ("d", []), ("e", None)]
    terms += [(f"t{i}", ["x", "y"]) for i in range(9)]
    notes = [("x", "p"), ("x", "q"), ("y", "p"), ("y", "p"), ("z", None), ("w", "r"), (None, "s")]
    got = graph.disease_phenotypes(
        spark.createDataFrame(terms, "id string, refs array<string>"),
        spark.createDataFrame(notes, "disease string, phenotype string"),
        term="id", references="refs", on="disease", phenotype="phenotype", block=2,
    )
    expected = {(t, p) for t, refs in terms for r in refs or [] for d, p in notes if r is not None and r == d}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    plan = optimized(got)
    assert plan.index("Join") < plan.index("Aggregate")


def test_listed_pairs_fit_as_the_matrix_does():
    rnd = np.random.default_rng(3)
    n = 90
    full = np.eye(n)
    i = np.arange(n - 1)
    full[i, i + 1] = full[i + 1, i] = 0.6
    listed = finemap.ListedLD(n, i, i + 1, np.full(n - 1, 0.6))
    assert listed.full is None
    z = rnd.normal(size=n) * 3
    for a, b in zip(finemap.susie(z, listed, 4, 50.0), finemap.susie(z, full, 4, 50.0)):
        assert np.allclose(a, b)
    for chosen in ([3], [3, 4], [3, 4, 5], [7, 30]):
        r2 = full[np.ix_(chosen, chosen)] ** 2
        assert np.allclose(listed.purity(np.array(chosen)), (r2.mean(), r2.min()))


def test_a_locus_with_few_pairs_makes_no_matrix():
    names = [f"v{k}" for k in range(2000)]
    left = pd.DataFrame({"locus": "a", "variant": names, "z": [9.0] + [0.1] * 1999})
    right = pd.DataFrame({"pair_locus": ["a"], "variant_a": ["v0"], "variant_b": ["v1"], "r": [0.3]})
    settings = {"effects": 2, "prior": 50.0, "mean_r2": 0.25, "min_r2": 0.25, "min_log_bf": 2.0, "mass": 0.99}
    tracemalloc.start()
    found = finemap._solve(settings)(("a",), left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["variant"].tolist() == ["v0"]
    assert peak < 8_000_000


def test_partners_of_leads_are_dealt_before_they_are_compared(spark):
    leads = [(1, "a", 5.0), (1, "b", 5.0), (1, "c", 7.0), (2, "a", 1.0), (2, "b", None), (None, "a", 3.0), (None, "c", 9.0)]
    pairs = [("a", "b", 0.9), ("b", "a", 0.9), ("c", "b", 0.8), ("b", "c", 0.8), ("c", "a", 0.1), (None, "a", 1.0)]
    got = loci.ld_clump(
        spark.createDataFrame(leads, "study long, variant string, strength double"),
        spark.createDataFrame(pairs, "variant string, tag string, r double"),
        study="study", variant="variant", strength="strength",
    )

    def order(lead):
        return (lead[2] is not None, -(lead[2] or 0.0), lead[1])

    expected = {
        lead: any(
            b[0] == lead[0] is not None and (b[1], lead[1]) == (v, tag) and r * r >= 0.5 and order(b) < order(lead)
            for b in leads for v, tag, r in pairs
        )
        for lead in leads
    }
    assert {(r["study"], r["variant"], r["strength"]): r["ld_clumped"] for r in got.collect()} == expected
    plan = optimized(got)
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression")


def test_sources_of_edges_are_counted_in_one_aggregate(spark):
    schema = "a long, b long, score double"
    sources = {
        "x": spark.createDataFrame([(1, 2, 0.1), (2, 1, 0.4), (3, 3, None)], schema),
        "y": spark.createDataFrame([(2, 1, 0.3), (None, 5, 0.2)], schema),
        "z": spark.createDataFrame([], schema),
    }
    got = evidence.interaction_edges(sources, "a", "b", "score")
    assert {tuple(r) for r in got.collect()} == {(1, 2, 3, 2, 0.4), (3, 3, 1, 1, None), (5, 5, 1, 1, 0.2)}
    assert dict(got.dtypes)["n_sources"] == "bigint"
    assert "distinct" not in optimized(got)


def test_texts_aligned_at_a_time_stay_within_two_mebibytes():
    texts = pa.array(["x" * 100_000] * 60)
    parts = list(chunks(texts, tokenalign.BLOCK_BYTES))
    assert sum(p.n for p in parts) == 60
    assert max(p.n for p in parts) * 100_000 <= 2 << 20


def test_many_small_files_are_read_whole_by_few_tasks(spark, tmp_path):
    for k in range(600):
        folder = tmp_path / "m" / f"study {k}"
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(f'{{\n  "studyId": "s{k}",\n  "passQc": null\n}}\n')
    (tmp_path / "m" / "_hidden").mkdir()
    for name in ("_hidden/x.json", ".x.json", "x.txt", "empty.json"):
        (tmp_path / "m" / name).write_text("" if name == "empty.json" else "{")
    (tmp_path / "m" / "broken.json").write_text("{\n")
    rows, bad = readers.read_manifests(spark, str(tmp_path / "m"))
    assert sorted(r["studyId"] for r in rows.collect()) == sorted(f"s{k}" for k in range(600))
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert [(r["source_file"].rsplit("/", 1)[1], r["_corrupt_record"]) for r in bad.collect()] == [("broken.json", "{\n")]
    found = {r["source_file"].rsplit("/", 1)[1] for r in readers.read_small_files(spark, str(tmp_path / "m"), "{b,x}*").collect()}
    assert found == {"broken.json", "x.txt"}


def test_chunk_files_are_not_moved_by_the_driver(spark, tmp_path):
    rows = [("1", 5 * i, f'a "{i}"\t' if i % 3 else " b ", "" if i % 2 else None, None) for i in range(95)]
    df = spark.createDataFrame(rows, "`#CHROM` string, POS long, `ID.x` string, `REF` string, ALT string").repartition(7)
    root = tmp_path / "chunks"
    for _ in range(2):  # a second run replaces the files
        sinks.write_variant_chunks(df, str(root), [F.col("POS").desc()], 10)
    folders = {f"chunk={10 * k + 1}-{10 * k + 10}" for k in range(10)}
    assert {p.name for p in root.iterdir() if not p.name.startswith(".")} == folders | {"_SUCCESS"}
    assert {p.name for f in folders for p in (root / f).iterdir()} == {"part-00000.csv"}
    written = variants.row_range_chunks(df, [F.col("POS").desc()], 10)
    plain = written.repartition("label").sortWithinPartitions("label", "row").drop("row", "chunk").withColumnRenamed("label", "chunk")
    plain.write.option("sep", "\t").option("header", "true").partitionBy("chunk").csv(str(tmp_path / "plain"))
    for folder in folders:
        (one,) = (tmp_path / "plain" / folder).glob("*.csv")
        assert (root / folder / "part-00000.csv").read_bytes() == one.read_bytes()
    sinks.write_variant_chunks(df.limit(0), str(root), [F.col("POS")], 10)
    assert [p.name for p in root.iterdir() if not p.name.startswith(".")] == ["_SUCCESS"]


def test_texts_of_a_block_travel_packed(monkeypatch):
    texts = [f"{k} the same words come again and again, as they do in text" for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts), pa.array([None, "en"] * 250)], names=["c0", "text", "grp"])
    monkeypatch.setattr(perplexity, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    cut = list(perplexity._numbered(iter([batch.slice(0, 200), batch.slice(200)]), "text"))
    assert sum(len(value.as_py()) for part in cut for value in part.column("packed")) < sum(map(len, texts)) / 3
    assert perplexity._unpacked(pa.Table.from_batches(cut).column("packed")).to_pylist() == batch.to_pylist()
