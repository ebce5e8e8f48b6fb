"""Manifests, joins, sources, sinks and streams on small frames."""

import gzip
import json
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from locusforge.operators import annotate, evidence, graph, l2g, logs, manifests, posteriors, validation
from locusforge.sources import blockgzip, listing, readers, sinks
from locusforge.streaming import studies as streams

MANIFEST = readers.MANIFEST_SCHEMA


def manifest(study, harmonised=False, qc=False, status="pending", path=None):
    return (study, f"raw/{study}", path or f"m/{study}/manifest.json", f"h/{study}", f"q/{study}", harmonised, qc, status, "gwas", None, True, "1")


def test_flags(spark):
    df = spark.createDataFrame(
        [manifest("a", True, True), manifest("b", False, False), manifest("c", True, None), manifest("d", True, False)], MANIFEST
    )
    got = sorted(r["studyId"] for r in manifests.filter_any_flag_false(df).collect())
    assert got == ["b", "c", "d"]
    got = sorted(r["studyId"] for r in manifests.filter_any_flag_false(df, multiplicity=True).collect())
    assert got == ["b", "b", "c", "d"]
    assert manifests.filter_any_flag_false(df.select("studyId")).isEmpty()


def test_status(spark):
    df = spark.createDataFrame(
        [manifest("a", status="success"), manifest("b", status="failure"), manifest("c"), manifest("d", status="odd")], MANIFEST
    )
    frames = manifests.split_by_status(df)
    assert {k: [r["studyId"] for r in v.collect()] for k, v in frames.items()} == {
        "success": ["a"], "failure": ["b"], "pending": ["c"],
    }
    assert manifests.status_summary(df).first().asDict() == {"n_pending": 1, "n_failure": 1, "n_success": 1, "n_total": 4}


def test_choose(spark):
    new = spark.createDataFrame([manifest("n")], MANIFEST)
    old = spark.createDataFrame([manifest("o", True, True), manifest("p", True, False)], MANIFEST)
    assert [r["studyId"] for r in manifests.choose_manifests(new, old, "CONTINUE").collect()] == ["n"]
    assert [r["studyId"] for r in manifests.choose_manifests(new, old, "RESUME").collect()] == ["p"]


def test_changed_rows_first_run(spark):
    df = spark.createDataFrame([("a", 1)], "key string, value long")
    assert manifests.changed_rows(df, None, "key", ["value"]).collect()[0]["change"] == "added"
    assert manifests.changed_rows(df, df, "key", ["value"]).isEmpty()


def test_manifest_round_trip_and_rejects(spark, tmp_path):
    df = spark.createDataFrame([manifest("a"), manifest("b", True, None, "success")], MANIFEST)
    root = str(tmp_path / "m")
    sinks.write_manifests(df, root)
    (tmp_path / "m" / "broken.json").write_text('{"studyId": "x", ')
    rows, bad = readers.read_manifests(spark, root)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.collect()))
    assert [r["source_file"].rsplit("/", 1)[1] for r in bad.collect()] == ["broken.json"]


def test_duplicate_target_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([manifest("a", path="same"), manifest("b", path="same")], MANIFEST)
    with pytest.raises(ValueError, match="same"):
        sinks.write_manifests(df, str(tmp_path / "m"))


def test_template_with_open_placeholder(spark):
    t = spark.createDataFrame([(1, "get ${species} ${version}")], "g long, name string")
    v = spark.createDataFrame([(1, "mouse")], "g long, species string")
    with pytest.raises(PySparkException):
        listing.expand_template(t, v, "g", ["name"], {"species": "species"}).collect()


def test_select_latest_tie(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("t", "c", 0)], "src string, path string, modificationTime long")
    got = {r["source"]: r["path"] for r in listing.select_latest(df, F.col("src")).collect()}
    assert got == {"s": "b", "t": "c"}


def test_decompress_reports_failures(spark, tmp_path):
    (tmp_path / "two.gz").write_bytes(gzip.compress(b"a\nb\n") + gzip.compress(b"c"))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"lost\n" * 1000)[:-20])
    (tmp_path / "bad.bz2").write_bytes(b"no")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.tsv", "d\ne")
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.gz").write_bytes(gzip.compress(folder.encode()))
    out, failed = str(tmp_path / "out"), str(tmp_path / "failed")
    sinks.write_decompressed(spark, str(tmp_path), "*.{gz,bz2,zip}", out, failed)
    rows = spark.read.text(out).collect()
    assert sorted((r["file"], r["value"]) for r in rows) == [
        ("a/same.gz", "a"), ("b/same.gz", "b"),
        ("two.gz", "a"), ("two.gz", "b"), ("two.gz", "c"), ("z.zip", "d"), ("z.zip", "e"),
    ]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.json(failed).collect()) == ["bad.bz2", "cut.gz"]


def test_sink_modes(spark, tmp_path):
    path = str(tmp_path / "x")
    sinks.sink(spark.range(3), path)
    sinks.sink(spark.range(5), path, "ignore")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(PySparkException):
        sinks.sink(spark.range(5), path, "errorifexists")
    sinks.sink(spark.range(5), path, "overwrite")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        sinks.sink(spark.range(5), path, "append")


def test_partition_filter_prunes(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).withColumn("studyLocusId", F.col("id") % 3).write.partitionBy("studyLocusId").parquet(path)
    df = readers.read_partitioned(spark, path).where("studyLocusId = 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(studyLocusId" in plan


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(
        '#!build\n1\thavana\tgene\t11\t20\t.\t+\t.\tgene_id "G1"; gene_name "ABC d"; tag "x";\n'
    )
    row = readers.read_gene_annotation(spark, str(tmp_path / "a.gtf"), "gtf").first()
    assert row["start"] == 11 and row["attributes"]["gene_id"] == "G1" and row["attributes"]["gene_name"] == "ABC d"


def test_palindromic_and_flipped(spark):
    v = spark.createDataFrame([("1", 5, "A", "T", "v1"), ("1", 6, "G", "A", "v2")], "c string, p long, ref string, alt string, vid string")
    raw = spark.createDataFrame(
        [("1", 5, "T", "A", 0.5), ("1", 6, "G", "A", 0.2), ("1", 6, "A", "G", 0.3), ("1", 7, "A", "G", 0.3)],
        "c string, p long, ref string, alt string, beta double",
    )
    rows = annotate.harmonise_sumstats(raw, v, position=["c", "p"], ref="ref", alt="alt", beta="beta", variant_id="vid").collect()
    got = sorted((r["vid"], r["ref"], r["alt"], r["beta"], r["flipped"], r["palindromic"]) for r in rows)
    assert got == [
        ("v1", "A", "T", -0.5, True, True), ("v2", "G", "A", -0.3, True, False), ("v2", "G", "A", 0.2, False, False),
    ]


def test_direct_match_wins(spark):
    v = spark.createDataFrame([(5, "A", "T", "direct"), (5, "T", "A", "other")], "p long, ref string, alt string, vid string")
    raw = spark.createDataFrame([(5, "A", "T", 0.5)], "p long, ref string, alt string, beta double")
    rows = annotate.harmonise_sumstats(raw, v, position=["p"], ref="ref", alt="alt", beta="beta", variant_id="vid").collect()
    assert [(r["vid"], r["flipped"]) for r in rows] == [("direct", False)]


def test_validation_split_is_complete(spark):
    df = spark.createDataFrame([(1, "g1"), (2, "gx"), (3, None)], "id long, gene string")
    known = spark.createDataFrame([("g1",)], "gid string")
    rows = validation.qc_flags(validation.resolve(df, known, "gene", "gid", "no"), {"UNRESOLVED_TARGET": F.col("no"), "NOTE": F.col("id") == 3})
    good, bad = validation.split_valid(rows, validation.STUDY_REASONS)
    assert sorted(r["id"] for r in good.collect()) == [1, 3] and [r["id"] for r in bad.collect()] == [2]


def test_study_inclusion_unknown_in_neither(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, c boolean")
    a, b = validation.study_inclusion(df, "curation", F.col("c"), F.lit(True))
    assert [r["id"] for r in a.collect()] == [1] and [r["id"] for r in b.collect()] == [2]
    with pytest.raises(ValueError):
        validation.study_inclusion(df, "other", F.col("c"), F.col("c"))


def test_harmonic_sum_takes_every_rank(spark):
    df = spark.createDataFrame([("t", "d", "s", 1.0 if i % 3 else 0.5, i) for i in range(2000)], "t string, d string, s string, score double, id long")
    row = evidence.harmonic_association(df, ["t", "d"], "s", "score").first()
    top = sum(1 / i**2 for i in range(1, 51))
    scores = sorted((1.0 if i % 3 else 0.5 for i in range(2000)), reverse=True)
    exact = sum(x / (k * k) for k, x in enumerate(scores, 1)) / top / top
    assert abs(row["score"] - exact) < 1e-12 and row["n_evidence"] == 2000


def test_first_matching_empty(spark):
    df = spark.createDataFrame([(1, "x")], "ts long, id string")
    assert logs.first_matching(df, "ts", F.lit(5), "id").isEmpty()
    assert logs.first_matching(df, "ts", F.lit(0), "id").first()["id"] == "x"


def run_state_stream(spark, root):
    schema = "study string, status string, ts long, id long"
    stream = spark.readStream.schema(schema).parquet(root + "/in")
    streams.status_state_stream(
        stream, study="study", status="status", ts="ts", tie="id", target=root + "/out", checkpoint=root + "/state"
    ).awaitTermination()
    return {r["study"]: r["status"] for r in streams.newest_state(spark, root + "/out").collect()}


def test_state_stream_over_runs_with_late_rows(spark, tmp_path):
    root = str(tmp_path)
    schema = "study string, status string, ts long, id long"
    spark.createDataFrame([("a", "pending", 1, 1), ("b", "success", 5, 2)], schema).write.mode("append").parquet(root + "/in")
    assert run_state_stream(spark, root) == {"a": "pending", "b": "success"}
    spark.createDataFrame([("a", "failure", 3, 3), ("b", "pending", 2, 4)], schema).write.mode("append").parquet(root + "/in")
    assert run_state_stream(spark, root) == {"a": "failure", "b": "success"}
    spark.createDataFrame([("c", "pending", 9, 5)], schema).write.mode("append").parquet(root + "/in")
    assert run_state_stream(spark, root) == {"a": "failure", "b": "success", "c": "pending"}


def test_new_file_stream_does_not_repeat(spark, tmp_path):
    root = str(tmp_path)
    known = spark.createDataFrame([("k",)], "study string")
    for ids in (["k", "a"], ["a", "b"]):
        spark.createDataFrame([(i,) for i in ids], "study string").write.mode("append").parquet(root + "/in")
        raw = spark.readStream.schema("study string").parquet(root + "/in")
        streams.new_file_stream(raw, known, "study", root + "/out", root + "/state").awaitTermination()
    assert sorted(r["study"] for r in spark.read.parquet(root + "/out").collect()) == ["a", "b"]


def test_a_header_that_disagrees_is_an_error(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("b\ta\n1\t2\n")
    with pytest.raises(Exception, match="header|Header|HEADER"):
        readers.read_delimited_source(spark, str(tmp_path), "a int, b int").collect()


def test_r2_above_one_is_one(spark):
    rows = [("l", 9.0, 1.0000001), ("l", 9.0, 1.0), ("l", 9.0, 0.6)]
    got = posteriors.pics(spark.createDataFrame(rows, "locus string, m double, r2 double"), ["locus"], lead_strength="m", r2="r2").collect()
    assert abs(sum(r["pip"] for r in got) - 1) < 1e-9


def test_sum_of_inverse_squares(spark):
    from locusforge.functions.stats import inverse_squares

    got = spark.range(0, 300).select("id", inverse_squares(F.col("id")).alias("s")).collect()
    for r in got:
        assert abs(r["s"] - sum(1 / i**2 for i in range(1, r["id"] + 1))) < 1e-13


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    schema = "study string, status string, ts long, tie long"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        out, log = str(tmp_path / "state"), str(tmp_path / "log")
        streams.status_state_stream(stream, study="study", status="status", ts="ts", tie="tie", target=out, checkpoint=log).awaitTermination()
        return {r["study"]: r["status"] for r in streams.newest_state(spark, out).collect()}

    def files():
        return {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}

    put("a", [(f"s{i}", "old", 1, i) for i in range(200)])
    assert len(run()) == 200
    before = files()
    put("b", [("s7", "new", 5, 1), ("s8", "late", 0, 1)])
    state = run()
    after = files()
    assert state["s7"] == "new" and state["s8"] == "old" and len(state) == 200
    assert len(set(after) - set(before)) <= 2 and all(after[f] == before[f] for f in before)
    put("c", [("s7", "newer", 9, 1)])
    assert run()["s7"] == "newer"
    versions = {p.parts[-3]: set() for p in files()}
    for p in files():
        versions[p.parts[-3]].add(p.parts[-2])
    assert max(len(v) for v in versions.values()) <= 2


def block_gzip(text, size=200):
    """Block-gzip of a text: members of an extra field with their length, and the empty one at the end."""
    out = b""
    for first in [*range(0, len(text), size), None]:
        part = b"" if first is None else text[first : first + size]
        packed = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packed.compress(part) + packed.flush()
        extra = b"BC" + struct.pack("<HH", 2, 12 + 6 + len(body) + 8 - 1)
        head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra
        out += head + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize("size", [137, 1000, 5_000, 1 << 26])
def test_block_gzip_lines_by_ranges(spark, tmp_path, size):
    rnd = random.Random(4)
    # stored blocks: the text itself holds the magic of a block, which must not be taken for one
    lines = ["".join(rnd.choice("abc é") for _ in range(rnd.choice([0, 3, 40, 900]))) for _ in range(300)]
    lines[7] = "\x1f\x08\x04 no block BC"
    raw = "\n".join(lines).encode()
    (tmp_path / "with blanks 10%").mkdir()
    (tmp_path / "with blanks 10%" / "a.gz").write_bytes(block_gzip(raw + b"\n"))
    (tmp_path / "open.gz").write_bytes(block_gzip(raw.replace(b"abc", b"\x1f\x8b\x08\x04\xff")))
    (tmp_path / "plain.gz").write_bytes(gzip.compress(raw[:5000]) + gzip.compress(raw[5000:]))
    (tmp_path / "empty.gz").write_bytes(block_gzip(b""))
    found, broken = blockgzip.read_gzip_lines(spark, str(tmp_path), "*.gz", size)
    got = {}
    for r in found.orderBy("path", "start", "pos").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["line"])
    assert got["a.gz"] == lines and got["plain.gz"] == lines and "empty.gz" not in got
    errors = {r["path"].rsplit("/", 1)[1] for r in broken.collect()}
    assert errors == {"open.gz"} or not errors  # that text is no UTF-8
    if size == 137:
        assert found.where("path LIKE '%a.gz'").select("start").distinct().count() > 20


def test_ranges_that_fail_come_back(spark, tmp_path):
    good, bad = block_gzip(b"v\tx\n" + b"1\t2\n" * 2000), bytearray(block_gzip(b"v\tx\n" + b"3\t4\n" * 2000))
    bad[len(bad) // 2] ^= 0xFF
    (tmp_path / "good.gz").write_bytes(good)
    (tmp_path / "bad.gz").write_bytes(bytes(bad))
    (tmp_path / "sets.tsv").write_text("v\tc\n1\tcs\n")
    rows, sets, broken = readers.read_susie_files(
        spark, str(tmp_path), "*.gz", "v bigint, x bigint", str(tmp_path / "sets.tsv"), "v bigint, c string"
    )
    assert {r["path"].rsplit("/", 1)[1] for r in broken.collect()} == {"bad.gz"}
    assert rows.distinct().collect() == [(1, 2)] and rows.count() == 2000 and sets.count() == 1


def test_manifests_at_their_own_paths(spark, tmp_path):
    df = spark.createDataFrame([manifest("a", path=str(tmp_path / "x 1" / "one.json")), manifest("b", path="two.json")], MANIFEST)
    for _ in range(2):  # a second run replaces the files
        written = sinks.write_manifests(df, str(tmp_path / "root"))
        assert {r["study"]: r["path"] for r in written.collect()} == {"a": str(tmp_path / "x 1" / "one.json"), "b": str(tmp_path / "root/two.json")}
    files = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert sorted(p.name for p in files) == ["one.json", "two.json"]
    assert json.loads((tmp_path / "x 1" / "one.json").read_text())["studyId"] == "a"


def test_templates_meet_every_set(spark, monkeypatch):
    t = spark.createDataFrame([("get ${species}",), ("list ${species}",)], "name string")
    v = spark.createDataFrame([(f"s{i}",) for i in range(25)], "species string")
    want = sorted(f"{verb} s{i}" for verb in ("get", "list") for i in range(25))
    for most in (10_000, 4):
        monkeypatch.setattr(listing, "MOST_VARIABLES", most)
        got = listing.expand_template(t, v, None, ["name"], {"species": "species"})
        assert sorted(r["name"] for r in got.collect()) == want
    assert listing.expand_template(t, v.limit(0), None, ["name"], {"species": "species"}).count() == 0


def test_owl_terms_with_all_they_carry(spark, tmp_path):
    (tmp_path / "o.owl").write_text(
        '<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o" xmlns:obo="b" xmlns:oboInOwl="i">'
        '<owl:Class rdf:about="A"><rdfs:label>a</rdfs:label><oboInOwl:hasExactSynonym>x</oboInOwl:hasExactSynonym>'
        "<oboInOwl:hasRelatedSynonym>y</oboInOwl:hasRelatedSynonym><oboInOwl:hasDbXref>D:1</oboInOwl:hasDbXref>"
        '<rdfs:subClassOf rdf:resource="B"/><rdfs:subClassOf><owl:Restriction>'
        f'<owl:onProperty rdf:resource="{readers.PART_OF}"/><owl:someValuesFrom rdf:resource="C"/></owl:Restriction></rdfs:subClassOf></owl:Class>'
        '<owl:Class rdf:about="B"><owl:deprecated>true</owl:deprecated><obo:IAO_0100001 rdf:resource="A"/></owl:Class></rdf:RDF>'
    )
    terms, edges = readers.read_ontology_owl(spark, str(tmp_path / "o.owl"))
    assert sorted(map(tuple, terms.collect())) == [("A", "a", ["x", "y"], ["D:1"], False, None), ("B", None, [], [], True, "A")]
    assert sorted(map(tuple, edges.collect())) == [("A", "B", "is_a"), ("A", "C", "part_of")]


def test_replacements_along_chains(spark):
    rows = [("a", False, None), ("b", True, "c"), ("c", True, "a"), ("d", True, None), ("e", True, "f"), ("f", True, "e"), ("g", True, "gone")]
    df = spark.createDataFrame(rows, "id string, obsolete boolean, replaced_by string")
    got = {r["id"]: r["current"] for r in graph.current_terms(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": None, "e": None, "f": None, "g": None}


def test_labels_and_folds(spark):
    rnd = random.Random(6)
    pairs = [(i, rnd.randrange(150)) for i in range(120) for _ in range(3)] + [(500 + i, 1000 + i) for i in range(40)] + [(500 + i, 1001 + i) for i in range(40)]
    gold = [p for p in set(pairs) if rnd.random() < 0.2] + [(9999, 1)]
    ties = [(rnd.randrange(150), rnd.randrange(150), rnd.random()) for _ in range(400)]
    df = spark.createDataFrame(pairs, "locus long, gene long")
    got = l2g.l2g_labels(
        df, spark.createDataFrame(gold, "locus long, gene long"), spark.createDataFrame(ties, "gene long, partner long, s double"),
        locus="locus", gene="gene", partner="partner", score="s", folds=3,
    ).collect()
    true = set(gold) & set(pairs)
    strong = {(a, b) for a, b, s in ties if s >= 0.8} | {(b, a) for a, b, s in ties if s >= 0.8}
    want = {p: 1 for p in true}
    for locus, gene in set(pairs) - true:
        own = {g for l, g in true if l == locus}
        if own and not any((g, gene) in strong for g in own):
            want[locus, gene] = 0
    assert {(r["locus"], r["gene"]): r["label"] for r in got} == want and len(got) == len(want)
    root = {l: l for l, _ in want}
    for a, g in want:
        for b, h in want:
            if g == h and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert all(r["component"] == root[r["locus"]] for r in got)
    folds = {}
    for r in got:
        folds.setdefault(r["component"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in folds.values()) and {f for x in folds.values() for f in x} <= {0, 1, 2}
