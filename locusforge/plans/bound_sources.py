"""Readers, writers and streams: data derived from the given tables makes a round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusforge.operators import evidence, graph, manifests, validation, variants
from locusforge.operators.scale import nest_rows
from locusforge.plans.bound_functions import FIRST_EXIT_SQL, log_entries
from locusforge.plans.bound_genetics import _NUMBERED, _VARIANTS, WHOLE, merged
from locusforge.plans.bound_manifests import raw_studies
from locusforge.plans.registry import query
from locusforge.session import scratch_path
from locusforge.sources import blockgzip, listing, readers, sinks
from locusforge.streaming import studies as streams

_MANIFESTS = """
    SELECT 'GCST' || doc_id AS "studyId", 'gs://staging/GCST' || doc_id || '/manifest.json' AS "manifestPath",
           false AS "passQc", 'pending' AS status FROM documents"""


def _written_manifests(t):
    root = scratch_path(t.spark, "manifests")
    return root, sinks.write_manifests(manifests.make_manifest_rows(raw_studies(t), root))


@query(_MANIFESTS)
def read_manifests(t):
    root, _ = _written_manifests(t)
    rows, _ = readers.read_manifests(t.spark, root)
    path = F.replace("manifestPath", F.lit(root), F.lit("gs://staging")).alias("manifestPath")
    return rows.select("studyId", path, "passQc", "status")


@query("SELECT 'GCST' || doc_id AS study, 'GCST' || doc_id || '/manifest.json' AS path, 1::BIGINT AS n_files, 'GCST' || doc_id AS held FROM documents")
def write_manifests(t):
    """The returned paths, the files that lie there, and the study that each one holds."""
    root, written = _written_manifests(t)
    own = F.concat(F.lit("/"), F.regexp_replace("path", "^[a-z]+:/*", ""))
    below = F.substring_index(own, "/", -2).alias("path")
    files = readers.read_small_files(t.spark, root)
    files = files.select(F.col("source_file").alias("path"), F.get_json_object("value", "$.studyId").alias("held"))
    found = files.groupBy(below).agg(F.count(F.lit(1)).alias("n_files"), F.max("held").alias("held"))
    return written.select("study", below).join(found, "path")


@query("SELECT DISTINCT c_nationkey, c_mktsegment, true AS has_bytes FROM customer")
def list_objects(t):
    path = scratch_path(t.spark, "objects")
    t.customer.write.partitionBy("c_nationkey", "c_mktsegment").parquet(path)
    files = listing.list_objects(t.spark, path, "*.parquet")
    return files.groupBy(
        F.regexp_extract("path", r"c_nationkey=(\d+)/", 1).cast("int").alias("c_nationkey"),
        F.regexp_extract("path", r"c_mktsegment=(\w+)/", 1).alias("c_mktsegment"),
    ).agg((F.sum("length") > 0).alias("has_bytes"))


def _variant_file_rows(t):
    return merged(t).select(*variants.VARIANT_SCHEMA.fieldNames())


@query(f"SELECT {WHOLE} FROM ({_VARIANTS})")
def read_variant_tsv(t):
    path = scratch_path(t.spark, "variants")
    _variant_file_rows(t).write.option("sep", "\t").option("header", "true").csv(path)
    return readers.read_variant_tsv(t.spark, path, "*.csv")


@query(
    f"""
    SELECT (rn // 2000 * 2000 + 1) || '-' || (rn // 2000 * 2000 + 2000) AS chunk, {WHOLE} FROM ({_NUMBERED})
    """
)
def write_variant_chunks(t):
    path = scratch_path(t.spark, "chunks")
    order = [F.col(k) for k in variants.VARIANT_KEYS]
    sinks.write_variant_chunks(_variant_file_rows(t), path, order, 2000)
    kinds = ", ".join(f"`{c}` string" for c in variants.VARIANT_SCHEMA.fieldNames())
    back = t.spark.read.schema(f"{kinds}, chunk string").option("sep", "\t").option("header", "true").option("enforceSchema", "false").csv(path)
    return back.withColumn("POS", F.col("POS").cast("bigint"))


@query("SELECT url AS line FROM pages")
def write_path_list(t):
    path = scratch_path(t.spark, "paths")
    sinks.write_path_list(t.pages, "url", path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query(
    """
    SELECT rn // 4000 AS idx, 'chunk=' || rn // 4000 AS path, count(*) AS n
    FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) GROUP BY ALL
    """
)
def write_chunk_manifests(t):
    path = scratch_path(t.spark, "loci")
    keys = t.orders.select(F.concat(F.lit("studyLocusId="), "o_orderkey").alias("key"), "o_orderkey")
    rows = manifests.locus_rows(keys, "key", "gs://loci", "gs://susie", "gs://logs")
    number = F.regexp_extract("study_locus_input", r"(\d+)$", 1).cast("bigint")
    chunked = variants.chunk_rows(rows.withColumn("k", number), [F.col("k")], 4000)
    found = sinks.write_chunk_manifests(chunked.drop("row"), path, ["k"]).drop("n")
    written = t.spark.read.option("header", "true").csv(path + "/*").select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("folder"))
    counts = written.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    own = found.select("idx", F.element_at(F.split("path", "/"), -1).alias("folder"))
    return own.join(counts, "folder").select("idx", F.col("folder").alias("path"), "n")


@query("SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1")
def read_partitioned(t):
    path = scratch_path(t.spark, "partitioned")
    t.orders.select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    rows = readers.read_partitioned(t.spark, path).where("o_orderstatus <> 'O'")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT c_custkey, c_name FROM customer")
def sink(t):
    path = scratch_path(t.spark, "release")
    rows = t.customer.select("c_custkey", "c_name")
    sinks.sink(t.customer.select("c_custkey", F.lit("first").alias("c_name")), path, "errorifexists")
    sinks.sink(rows, path, "overwrite")
    sinks.sink(rows.limit(0), path, "ignore")
    return t.spark.read.parquet(path)


@query(
    """
    SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT -o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000
    """
)
def clean_then_write(t):
    path = scratch_path(t.spark, "clean")
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    sinks.clean_then_write(rows, path)
    sinks.clean_then_write(rows, path + "-parts", "o_orderstatus")
    failed = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 200000")
    sinks.clean_then_write(
        failed.select((-F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus"), path + "-parts", "o_orderstatus"
    )
    return t.spark.read.parquet(path + "-parts")


@query(
    """
    SELECT valid, reasons, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM (
      SELECT l_orderkey, l_discount >= 0.03 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40) AS valid,
             concat_ws(',', CASE WHEN l_discount < 0.03 THEN 'SUBSIGNIFICANT_FLAG' END,
               CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) THEN 'MISSING_STUDY' END,
               CASE WHEN l_tax = 0 THEN 'NOTE' END) AS reasons FROM lineitem) GROUP BY ALL
    """
)
def write_validated(t):
    path = scratch_path(t.spark, "validated")
    rows = validation.resolve(t.lineitem, t.part.where("p_size <= 40"), "l_partkey", "p_partkey", "missing")
    flagged = validation.qc_flags(
        rows,
        {
            "SUBSIGNIFICANT_FLAG": F.col("l_discount") < 0.03,
            "MISSING_STUDY": F.col("missing"),
            "NOTE": F.col("l_tax") == 0,
        },
    )
    good, bad = sinks.write_validated(flagged, validation.CREDIBLE_SET_REASONS, path)
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return both.groupBy("valid", F.array_join("qualityControls", ",").alias("reasons")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys")
    )


@query("SELECT c_name || ';' || c_mktsegment AS line FROM customer UNION ALL SELECT p_name || ' ' || p_partkey FROM part")
def bulk_decompress(t):
    path = scratch_path(t.spark, "packed")
    line = F.concat_ws(";", "c_name", "c_mktsegment")
    t.customer.select(line.alias("value")).repartition(4).write.option("compression", "gzip").text(path + "/a")
    other = F.concat_ws(" ", "p_name", "p_partkey")
    t.part.select(other.alias("value")).repartition(3).write.option("compression", "bzip2").text(path + "/b")
    lines, _ = readers.bulk_decompress(t.spark, path, "*.{gz,bz2}")
    return lines.select("line")


@query("SELECT c_mktsegment AS segment, count(*) AS n, max(c_name) AS last FROM customer GROUP BY 1")
def write_decompressed(t):
    path = scratch_path(t.spark, "unpacked")
    t.customer.select("c_name", "c_mktsegment").write.partitionBy("c_mktsegment").option("compression", "gzip").text(
        path + "/in"
    )
    frames = []
    for segment in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        sinks.write_decompressed(
            t.spark, f"{path}/in/c_mktsegment={segment}", "*.gz", f"{path}/out/{segment}", f"{path}/failed/{segment}"
        )
        frames.append(t.spark.read.text(f"{path}/out/{segment}").withColumn("segment", F.lit(segment)))
    rows = variants.union_sources(frames)
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("last"))


@query("SELECT event_id, event_type, (props::JSON->>'k')::BIGINT AS k FROM events")
def read_jsonl_source(t):
    path = scratch_path(t.spark, "jsonl")
    rows = t.events.select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    rows.write.option("compression", "gzip").json(path)
    back = readers.read_jsonl_source(t.spark, path, "event_id bigint, event_type string, props struct<k:bigint>")
    return back.select("event_id", "event_type", "props.k")


@query("SELECT c_mktsegment AS segment, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1")
def read_json_source(t):
    path = scratch_path(t.spark, "json")
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    rows.write.option("compression", "bzip2").json(path)
    back = readers.read_json_source(t.spark, path, "c_custkey bigint, segment string")
    return back.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def project_fields(t):
    nested = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_quantity", "l_tax").alias("line"))
    path = scratch_path(t.spark, "nested")
    nested.write.parquet(path)
    rows = readers.project_fields(t.spark.read.parquet(path), ["l_orderkey", "line.l_linenumber", "line.l_quantity"])
    return rows.toDF("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def read_delimited_source(t):
    path = scratch_path(t.spark, "tsv")
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    rows.write.option("sep", "\t").option("header", "true").option("compression", "gzip").csv(path)
    return readers.read_delimited_source(t.spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


_TERMS = """
    SELECT 'C:' || c_custkey AS child, 'N:' || c_nationkey AS parent FROM customer
    UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation"""


def _terms(t):
    people = t.customer.select(
        F.concat(F.lit("C:"), "c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("N:"), "c_nationkey").alias("parent"),
    )
    nations = t.nation.select(
        F.concat(F.lit("N:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("R:"), "n_regionkey").alias("parent"),
    )
    return people.unionByName(nations)


@query(_TERMS)
def read_ontology_obo(t):
    path = scratch_path(t.spark, "obo")
    stanza = F.concat(
        F.lit("[Term]\nid: "), "id", F.lit("\nname: "), "name", F.lit("\nis_a: "), "parent", F.lit(" ! parent\n")
    )
    _terms(t).select(stanza.alias("value")).write.text(path)
    return readers.read_ontology_obo(t.spark, path)[1].select("child", "parent")


@query(_TERMS)
def read_ontology_json(t):
    path = scratch_path(t.spark, "graph")
    node = F.struct("id", F.col("name").alias("lbl"), F.lit("CLASS").alias("type"))
    edge = F.struct(F.col("id").alias("sub"), F.lit("is_a").alias("pred"), F.col("parent").alias("obj"))
    graphs = F.array(F.struct(F.array(node).alias("nodes"), F.array(edge).alias("edges")))
    _terms(t).select(graphs.alias("graphs")).write.json(path)
    return readers.read_ontology_json(t.spark, path, multi_line=False)[1].select("child", "parent")


@query("SELECT id, name, count(*) AS parents FROM (SELECT 'C:' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'N:' || n_nationkey, n_name FROM nation) GROUP BY ALL")
def read_ontology_owl(t):
    path = scratch_path(t.spark, "owl")
    text = F.concat(
        F.lit('<owl:Class rdf:about="'), "id", F.lit('"><rdfs:label>'), "name",
        F.lit('</rdfs:label><rdfs:subClassOf rdf:resource="'), "parent", F.lit('"/></owl:Class>'),
    )
    root = (
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
        'xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
    )
    # one well-formed document per file: a parent and one part of its children
    documents = nest_rows(_terms(t).withColumn("text", text), ["parent"], F.col("text"), "classes", max_items=50)
    value = F.concat(F.lit(root), F.array_join("classes", ""), F.lit("</rdf:RDF>"))
    documents.select("parent", "part", value.alias("value")).write.partitionBy("parent", "part").text(path)
    terms, edges = readers.read_ontology_owl(t.spark, path)
    parents = edges.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("parents"))
    return terms.select("id", "name").join(parents, "id")


@query("SELECT 'P' || p_partkey AS gene, p_name AS name, p_partkey * 10 AS start, p_brand AS seqid FROM part")
def read_gene_annotation(t):
    path = scratch_path(t.spark, "gtf")
    line = F.concat_ws(
        "\t", "p_brand", F.lit("ensembl"), F.lit("gene"), F.col("p_partkey") * 10, F.col("p_partkey") * 10 + 5,
        F.lit("."), F.lit("+"), F.lit("."),
        F.concat(F.lit('gene_id "P'), "p_partkey", F.lit('"; gene_name "'), "p_name", F.lit('";')),
    )
    t.part.select(F.explode(F.array(F.lit("# comment"), F.regexp_replace(line, "Brand#", "chr"))).alias("value")).write.text(path)
    rows = readers.read_gene_annotation(t.spark, path, "gtf")
    return rows.select(
        F.col("attributes")["gene_id"].alias("gene"), F.col("attributes")["gene_name"].alias("name"), "start",
        F.regexp_replace("seqid", "chr", "Brand#").alias("seqid"),
    )


@query("SELECT 'P' || p_partkey AS gene, p_type AS kind FROM part UNION ALL SELECT 'G' || s_suppkey, 'GO:' || s_nationkey FROM supplier")
def read_gene_annotation_gff3_gaf(t):
    path = scratch_path(t.spark, "gff")
    line = F.concat_ws(
        "\t", "p_brand", F.lit("."), F.lit("gene"), F.lit(1), F.lit(5), F.lit("."), F.lit("+"), F.lit("."),
        F.concat(F.lit("ID=P"), "p_partkey", F.lit(";biotype="), "p_type"),
    )
    t.part.select(F.regexp_replace(line, "Brand#", "chr").alias("value")).write.text(path + "/gff")
    gaf = F.concat_ws(
        "\t", F.lit("DB"), F.concat(F.lit("G"), "s_suppkey"), F.lit("sym"), F.lit("involved_in"),
        F.concat(F.lit("GO:"), "s_nationkey"), *[F.lit("x")] * 12,
    )
    t.supplier.select(F.explode(F.array(F.lit("!gaf-version: 2.2"), gaf)).alias("value")).write.text(path + "/gaf")
    gff = readers.read_gene_annotation(t.spark, path + "/gff", "gff3").select(
        F.col("attributes")["ID"].alias("gene"), F.col("attributes")["biotype"].alias("kind")
    )
    return gff.unionByName(
        readers.read_gene_annotation(t.spark, path + "/gaf", "gaf").select(
            F.col("object_id").alias("gene"), F.col("term").alias("kind")
        )
    )


@query(
    """
    SELECT l_suppkey AS locus, count(*) AS n, sum(l_partkey)::BIGINT AS variants, 'cs' || l_suppkey AS cs
    FROM lineitem GROUP BY l_suppkey
    """
)
def read_susie_files(t):
    path = scratch_path(t.spark, "susie")
    snps = t.lineitem.select(F.col("l_suppkey").alias("locus"), F.col("l_partkey").alias("variant"), F.col("l_discount").alias("pip"))
    snps.repartition(4).write.option("sep", "\t").option("header", "true").option("compression", "gzip").csv(path + "/snp")
    summary = t.supplier.select(F.col("s_suppkey").alias("locus"), F.concat(F.lit("cs"), "s_suppkey").alias("cs"))
    for name in ("A_SUSIE.cred.summary.tsv", "A_SUSIE_99.cred.summary.tsv"):
        summary.write.option("sep", "\t").option("header", "true").csv(f"{path}/summary/{name}")
    rows, sets, _ = readers.read_susie_files(
        t.spark, path + "/snp", "*.gz", "locus bigint, variant bigint, pip double",
        path + "/summary/*SUSIE.cred.summary.tsv", "locus bigint, cs string",
    )
    counted = rows.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.sum("variant").alias("variants"))
    return counted.join(sets, "locus")


@query("SELECT s_suppkey, s_name FROM supplier")
def copy_dataset(t):
    path = scratch_path(t.spark, "copy")
    sinks.copy_dataset(t.spark, f"{t.folder}/supplier.parquet", path)
    return t.spark.read.parquet(path).select("s_suppkey", "s_name")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def write_by_chromosome(t):
    path = scratch_path(t.spark, "chromosomes")
    sinks.write_by_chromosome(t.events.select("event_id", "event_type", "ts"), path, "event_type", "ts")
    return t.spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


@query("SELECT l_suppkey, count(*) AS n, sum(l_orderkey)::BIGINT AS orders FROM lineitem GROUP BY 1")
def write_association_facts(t):
    path = scratch_path(t.spark, "facts")
    facts = evidence.association_facts(t.lineitem, ["l_suppkey", "l_orderkey", "l_linenumber"], {})
    evidence.write_association_facts(facts, path, "l_suppkey", ["l_orderkey", "l_linenumber"])
    return t.spark.read.parquet(path).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders")
    )


@query("SELECT d.doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_file_stream(t):
    path = scratch_path(t.spark, "stream")
    t.documents.select("doc_id", "lang").repartition(4).write.parquet(path + "/in")
    raw = (
        t.spark.readStream.schema("doc_id bigint, lang string").option("maxFilesPerTrigger", 2).parquet(path + "/in")
    )
    streams.new_file_stream(raw, t.labels, "doc_id", path + "/out", path + "/state").awaitTermination()
    return t.spark.read.parquet(path + "/out").select("doc_id", "lang")


@query(FIRST_EXIT_SQL)
def exit_status_stream(t):
    path = scratch_path(t.spark, "exits")
    rows = log_entries(t)
    rows.repartition(4).write.parquet(path + "/in")
    logs = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path + "/in")
    streams.exit_status_stream(
        logs, instance="user_id", ts="ts", tie="event_id", message="message",
        start=F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'"), target=path + "/out", checkpoint=path + "/state",
    ).awaitTermination()
    return streams.newest_state(t.spark, path + "/out").select("user_id", "exit_code", "succeeded")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def status_state_stream(t):
    path = scratch_path(t.spark, "states")
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    rows.repartition(4).write.parquet(path + "/in")
    changes = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path + "/in")
    streams.status_state_stream(
        changes, study="user_id", status="event_type", ts="ts", tie="event_id", target=path + "/out",
        checkpoint=path + "/state",
    ).awaitTermination()
    return streams.newest_state(t.spark, path + "/out").select("user_id", "event_type")


# ---- ontologies with all that terms carry --------------------------------------

_ONTOLOGY = """
    SELECT 'C:' || c_custkey AS id, c_name AS name, [c_mktsegment, c_name || ' "x"'] AS synonyms, ['X:' || c_nationkey] AS refs,
           c_custkey % 10 = 0 AS obsolete, CASE WHEN c_custkey % 10 = 0 AND c_custkey > 10 THEN 'C:' || (c_custkey - CASE WHEN c_custkey % 20 = 0 THEN 10 ELSE 1 END) END AS replaced_by
    FROM customer"""


def _ontology(t):
    """Customers as terms: every tenth is obsolete, and replaced by the one before or by another obsolete one."""
    number = F.col("c_custkey")
    behind = number - F.when(number % 20 == 0, 10).otherwise(1)
    return t.customer.select(
        F.concat(F.lit("C:"), number).alias("id"), F.col("c_name").alias("name"),
        F.array("c_mktsegment", F.concat("c_name", F.lit(' "x"'))).alias("synonyms"),
        F.array(F.concat(F.lit("X:"), "c_nationkey")).alias("references"), (number % 10 == 0).alias("obsolete"),
        F.when((number % 10 == 0) & (number > 10), F.concat(F.lit("C:"), behind)).alias("replaced_by"),
        F.concat(F.lit("N:"), "c_nationkey").alias("place"),
    )


def _written_obo(t) -> str:
    path = scratch_path(t.spark, "obo")
    synonyms = F.transform("synonyms", lambda x: F.concat(F.lit('synonym: "'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('" EXACT []')))
    lines = F.concat(
        F.array(F.lit("[Term]"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("name: "), "name")), synonyms,
        F.transform("references", lambda x: F.concat(F.lit("xref: "), x)),
        F.array(F.concat(F.lit("relationship: part_of "), "place", F.lit(" ! place"))),
        F.when(F.col("obsolete"), F.array(F.lit("is_obsolete: true"))).otherwise(F.array()),
        F.when(F.col("replaced_by").isNotNull(), F.array(F.concat(F.lit("replaced_by: "), "replaced_by"))).otherwise(F.array()),
    )
    people = _ontology(t).select(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value"))
    nations = t.nation.select(
        F.concat(F.lit("[Term]\nid: N:"), "n_nationkey", F.lit("\nname: "), "n_name", F.lit("\nis_a: R:"), "n_regionkey", F.lit("\n")).alias("value")
    )
    people.unionByName(nations).write.text(path)
    return path


@query(f"SELECT id, name, array_to_string(synonyms, ',') AS synonyms, array_to_string(refs, ',') AS refs, obsolete, replaced_by FROM ({_ONTOLOGY})")
def ontology_terms_of_obo(t):
    terms, _ = readers.read_ontology_obo(t.spark, _written_obo(t))
    return terms.where("id LIKE 'C:%'").select(
        "id", "name", F.array_join("synonyms", ",").alias("synonyms"), F.array_join("references", ",").alias("refs"), "obsolete", "replaced_by"
    )


@query(f"SELECT id, name, array_to_string(synonyms, ',') AS synonyms, array_to_string(refs, ',') AS refs, obsolete, replaced_by FROM ({_ONTOLOGY})")
def ontology_terms_of_json(t):
    path = scratch_path(t.spark, "graph")
    replaced = F.when(
        F.col("replaced_by").isNotNull(),
        F.array(F.struct(F.lit(readers.REPLACED_BY).alias("pred"), F.col("replaced_by").alias("val"))),
    )
    meta = F.struct(
        F.transform("synonyms", lambda x: F.struct(F.lit("hasExactSynonym").alias("pred"), x.alias("val"))).alias("synonyms"),
        F.transform("references", lambda x: F.struct(x.alias("val"))).alias("xrefs"),
        F.when(F.col("obsolete"), F.lit(True)).alias("deprecated"), replaced.alias("basicPropertyValues"),
    )
    node = F.struct("id", F.col("name").alias("lbl"), F.lit("CLASS").alias("type"), meta.alias("meta"))
    _ontology(t).select(F.array(F.struct(F.array(node).alias("nodes"))).alias("graphs")).write.json(path)
    terms, _ = readers.read_ontology_json(t.spark, path, multi_line=False)
    return terms.select(
        "id", "name", F.array_join("synonyms", ",").alias("synonyms"), F.array_join("references", ",").alias("refs"), "obsolete", "replaced_by"
    )


@query(
    """
    SELECT 'C:' || c_custkey AS node, 'N:' || c_nationkey AS ancestor, 'part_of' AS relation FROM customer
    UNION ALL SELECT 'C:' || c_custkey, 'R:' || n_regionkey, 'part_of' FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'is_a' FROM nation
    """
)
def typed_closure(t):
    _, edges = readers.read_ontology_obo(t.spark, _written_obo(t))
    return graph.typed_closure(edges, "child", "parent", "relation")


@query(
    f"""
    WITH RECURSIVE o AS ({_ONTOLOGY}),
    c AS (SELECT id, id AS place, obsolete, replaced_by FROM o
          UNION ALL SELECT c.id, o.id, o.obsolete, o.replaced_by FROM c JOIN o ON c.obsolete AND o.id = c.replaced_by)
    SELECT id, max(place) FILTER (NOT obsolete) AS current FROM c GROUP BY id
    """
)
def current_terms(t):
    terms, _ = readers.read_ontology_obo(t.spark, _written_obo(t))
    return graph.current_terms(terms.where("id LIKE 'C:%'"))


@query("SELECT DISTINCT 'C:' || c_custkey AS id, 'S:' || s_suppkey AS phenotype FROM customer JOIN supplier ON s_nationkey = c_nationkey")
def disease_phenotypes_of_files(t):
    """Cross-references from the ontology reader, annotations from the annotation reader."""
    path = scratch_path(t.spark, "phenotypes")
    empty = F.lit("")
    line = F.concat_ws(
        "\t", F.concat(F.lit("X:"), "s_nationkey"), "s_name", empty, F.concat(F.lit("S:"), "s_suppkey"), *[empty] * 7, F.lit("made")
    )
    header = F.lit("#version\ndatabase_id\tdisease_name\tqualifier\thpo_id\treference\tevidence\tonset\tfrequency\tsex\tmodifier\taspect\tbiocuration\n")
    t.supplier.select(F.concat(header, line).alias("value")).write.text(path)
    terms, _ = readers.read_ontology_obo(t.spark, _written_obo(t))
    annotations = readers.read_phenotype_annotation(t.spark, path)
    return graph.disease_phenotypes(
        terms, annotations, term="id", references="references", on="disease", phenotype="phenotype"
    )


@query(
    f"""
    SELECT o.id, o.name, (SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM (
      SELECT unnest(o.synonyms) AS s UNION ALL SELECT 'P' || c_custkey FROM customer WHERE 'C:' || c_custkey = o.id)) AS synonyms
    FROM ({_ONTOLOGY}) o
    """
)
def biosample_index_of_files(t):
    """Names and synonyms from the ontology reader, more synonyms from a table."""
    terms, _ = readers.read_ontology_obo(t.spark, _written_obo(t))
    more = t.customer.select(
        F.concat(F.lit("C:"), "c_custkey").alias("id"), F.lit(None).cast("string").alias("name"),
        F.array(F.concat(F.lit("P"), "c_custkey")).alias("synonyms"),
    )
    rows = evidence.biosample_index([terms.where("id LIKE 'C:%'").select("id", "name", "synonyms"), more], "id", "name", "synonyms")
    return rows.select("id", "name", F.array_join("synonyms", ",").alias("synonyms"))


@query("SELECT o_orderpriority AS file, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def read_gzip_lines(t):
    """Orders in a gzip file per priority, read in byte ranges."""
    path = scratch_path(t.spark, "lines")
    rows = t.orders.select(F.concat_ws("\t", "o_orderkey", "o_orderpriority", "o_orderdate").alias("value"), F.col("o_orderpriority").alias("file"))
    rows.write.partitionBy("file").option("compression", "gzip").text(path)
    lines, _ = blockgzip.read_gzip_lines(t.spark, path, "*.gz")
    cells = F.split("line", "\t")
    return lines.groupBy(cells[1].alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum(cells[0].cast("bigint")).alias("keys"))


@query("SELECT 'G' || s_suppkey AS gene, 'GO:' || s_nationkey AS term, s_name AS properties FROM supplier")
def read_gene_annotation_gpa(t):
    path = scratch_path(t.spark, "gpa")
    line = F.concat_ws(
        "\t", F.lit("DB"), F.concat(F.lit("G"), "s_suppkey"), F.lit("enables"), F.concat(F.lit("GO:"), "s_nationkey"), *[F.lit("x")] * 7, "s_name"
    )
    t.supplier.select(F.explode(F.array(F.lit("!gpa-version: 1.2"), line)).alias("value")).write.text(path)
    rows = readers.read_gene_annotation(t.spark, path, "gpa")
    return rows.select(F.col("object_id").alias("gene"), "term", "properties")


@query(
    """
    SELECT 'broken' AS kind, c_mktsegment AS segment, NULL::BIGINT AS n FROM customer GROUP BY ALL
    UNION ALL SELECT 'sound', c_mktsegment, count(*) FROM customer GROUP BY ALL
    """
)
def bulk_decompress_failures(t):
    """A sound and a broken file per segment: the text of the latter isn't what its name says."""
    path = scratch_path(t.spark, "mixed")
    rows = t.customer.select(F.col("c_name").alias("value"), F.regexp_replace("c_mktsegment", " ", "_").alias("segment")).repartition("segment")
    rows.write.partitionBy("segment").option("compression", "gzip").text(path + "/sound")
    rows.write.partitionBy("segment").option("compression", "deflate").text(path + "/broken")
    lines, failed = readers.bulk_decompress(t.spark, path, "*.{gz,deflate}")
    segment = F.regexp_replace(F.regexp_extract("path", "segment=([^/]+)/", 1), "_", " ").alias("segment")
    return lines.groupBy(F.lit("sound").alias("kind"), segment).agg(F.count(F.lit(1)).alias("n")).unionByName(
        failed.select(F.lit("broken").alias("kind"), segment, F.lit(None).cast("bigint").alias("n"))
    )
