"""Readers with explicit schemas."""

from __future__ import annotations

import bz2
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusforge.operators.variants import VARIANT_SCHEMA
from locusforge.session import cut_lineage, ship_package
from locusforge.sources.blockgzip import read_gzip_lines, store_of

CORRUPT = "_corrupt_record"
PIECE = 8 * 1024 * 1024
#: Names of files in a batch, at most.
LISTED = 4096
# fixed values: what Spark writes as a code in the address of a file
UNSAFE = re.compile(r"[^\x80-\U0010ffffA-Za-z0-9/_\-!.~'()*,;:$&+=@]")

# Fields of a manifest.
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("studyId", T.StringType()),
        T.StructField("rawPath", T.StringType()),
        T.StructField("manifestPath", T.StringType()),
        T.StructField("harmonisedPath", T.StringType()),
        T.StructField("qcPath", T.StringType()),
        T.StructField("passHarmonisation", T.BooleanType()),
        T.StructField("passQc", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("studyType", T.StringType()),
        T.StructField("analysisFlag", T.StringType()),
        T.StructField("isCurated", T.BooleanType()),
        T.StructField("pubmedId", T.StringType()),
    ]
)


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    return name.startswith(".") or name.endswith("._COPYING_") or (
        name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))
    )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder, its folders included."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, place = store_of(path)
            found = [e for e in store.get_file_info(fs.FileSelector(place)) if not _hidden(e.base_name)]
            for first in range(0, len(found), LISTED):
                part = found[first : first + LISTED]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{path.rstrip('/')}/{e.base_name}" for e in part], pa.string()),
                        pa.array([e.type == fs.FileType.Directory for e in part], pa.bool_()),
                    ],
                    names=["path", "folder"],
                )


def _small_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole text of each file, unpacked by its name."""
    paths, texts, size = [], [], 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["source_file", "value"])

    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, place = store_of(path)
            with store.open_input_stream(place) as file:
                text = file.read().decode("utf-8", "replace")
            if not text:
                continue
            texts.append(text)
            paths.append(UNSAFE.sub(lambda found: f"%{ord(found[0]):02X}", path))
            size += len(text)
            if size >= PIECE or len(paths) == LISTED:
                yield rows()
                paths, texts, size = [], [], 0
    if paths:
        yield rows()


def read_small_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(source_file, value) of every file below a path that is not empty, whole, whatever the number of files.

    Spark's own sources list on the driver, which then holds every file and cuts
    the read into tasks of some thirty. Here tasks list the folders, level by
    level, and the files found are dealt to tasks that read many each. Files are
    opened through Arrow's file systems.
    """
    ship_package(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    roots = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    if not roots:
        raise FileNotFoundError(path)
    rows = [(r.getPath().toString(), r.isDirectory()) for r in roots]
    level = spark.createDataFrame(rows, "path string, folder boolean")
    tasks = spark.sparkContext.defaultParallelism
    found = []
    while True:
        found.append(level.where("not folder").select("path"))
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            break
        level = cut_lineage(folders.repartition(tasks).mapInArrow(_entries, "path string, folder boolean"))
    name = F.substring_index("path", "/", -1)
    pattern = hadoop.GlobPattern(glob).compiled().pattern()
    files = reduce(DataFrame.unionByName, found).where(name.rlike(f"^(?:{pattern})$"))
    return files.repartition(tasks, "path").mapInArrow(_small_texts, "source_file string, value string")


def read_manifests(
    spark: SparkSession, path: str, schema: T.StructType = MANIFEST_SCHEMA, glob: str = "*.json"
) -> tuple[DataFrame, DataFrame]:
    """Manifests, one per file, and the files that could not be parsed."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    documents = read_small_files(spark, path, glob)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = documents.withColumn("doc", F.from_json("value", full, options))
    bad = F.col("doc").isNull() | F.col(f"doc.{CORRUPT}").isNotNull()
    return (
        rows.where(~bad).select(*[F.col(f"doc.{name}").alias(name) for name in schema.fieldNames()]),
        rows.where(bad).select("source_file", F.col("value").alias(CORRUPT)),
    )


def read_variant_tsv(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Tab-separated variant files with a header; one that disagrees with the columns is an error."""
    return (
        spark.read.schema(VARIANT_SCHEMA)
        .option("sep", "\t")
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .csv(path)
    )


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Dataset partitioned by ``key=value`` folders; filters on the key prune folders."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_json_source(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """JSON documents; gzip and bzip2 by file extension."""
    return spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)


def read_jsonl_source(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, compressed or not."""
    return read_json_source(spark, path, schema)


def read_delimited_source(
    spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t", header: bool = True,
    comment: str | None = None,
) -> DataFrame:
    """CSV, TSV and other delimited text, compressed or not; a header that disagrees with the schema is an error."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", str(header).lower())
    reader = reader.option("enforceSchema", str(not header).lower())
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def project_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Only the listed, possibly nested, fields; the scan is pruned to them."""
    return df.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])


# Identifiers of relations and annotations in graph documents.
PART_OF = "http://purl.obolibrary.org/obo/BFO_0000050"
REPLACED_BY = "http://purl.obolibrary.org/obo/IAO_0100001"


def _relation(name: Column) -> Column:
    """A relation by its plain name; identifiers of others stay as they are."""
    return F.when(name.isin(PART_OF, "BFO:0000050"), "part_of").otherwise(name)


def read_ontology_json(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Terms and edges of JSON graph documents.

    Terms: ``id, name, synonyms, references, obsolete, replaced_by``; the lists
    are empty where there is none. Edges: ``child, parent, relation`` with
    ``is_a``, ``part_of`` and any other relation by its identifier.
    """
    schema = (
        "graphs array<struct<nodes array<struct<id string, lbl string, type string, meta struct<"
        "synonyms array<struct<pred string, val string>>, xrefs array<struct<val string>>, deprecated boolean, "
        "basicPropertyValues array<struct<pred string, val string>>>>>,"
        "edges array<struct<sub string, pred string, obj string>>>>"
    )
    graphs = read_json_source(spark, path, schema, multi_line).select(F.explode("graphs").alias("g"))
    nodes = graphs.select(F.explode("g.nodes").alias("n"))
    replaced = F.filter("n.meta.basicPropertyValues", lambda x: x["pred"] == REPLACED_BY)
    terms = nodes.select(
        F.col("n.id").alias("id"),
        F.col("n.lbl").alias("name"),
        _listed(F.transform("n.meta.synonyms", lambda x: x["val"])).alias("synonyms"),
        _listed(F.transform("n.meta.xrefs", lambda x: x["val"])).alias("references"),
        F.coalesce("n.meta.deprecated", F.lit(False)).alias("obsolete"),
        F.get(F.transform(replaced, lambda x: x["val"]), 0).alias("replaced_by"),
    )
    edges = graphs.select(F.explode("g.edges").alias("e"))
    return terms, edges.select(
        F.col("e.sub").alias("child"), F.col("e.obj").alias("parent"), _relation(F.col("e.pred")).alias("relation")
    )


def _listed(values: Column) -> Column:
    return F.coalesce(F.array_compact(values), F.array().cast("array<string>"))


def read_ontology_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms and edges of OBO text as ``read_ontology_json`` gives them; stanzas are split at empty lines by the reader."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").contains("[Term]"))
    lines = F.split("value", "\n")

    def each(start: str, pattern: str) -> Column:
        return F.transform(F.filter(lines, lambda x: x.startswith(start)), lambda x: F.regexp_extract(x, pattern, 1))

    def one(pattern: str) -> Column:
        value = F.regexp_extract("value", pattern, 1)
        return F.when(value != "", value)

    links = F.transform(
        F.filter(lines, lambda x: x.startswith("relationship: ")),
        lambda x: F.struct(
            F.regexp_extract(x, r"^relationship: \S+ (\S+)", 1).alias("parent"),
            _relation(F.regexp_extract(x, r"^relationship: (\S+)", 1)).alias("relation"),
        ),
    )
    parents = F.transform(
        each("is_a: ", r"^is_a: (\S+)"), lambda x: F.struct(x.alias("parent"), F.lit("is_a").alias("relation"))
    )
    quoted = each("synonym: ", r'^synonym: "((?:[^"\\]|\\.)*)"')
    term = stanzas.select(
        F.regexp_extract("value", r"(?m)^id: (\S+)", 1).alias("id"),
        F.regexp_extract("value", r"(?m)^name: (.*)$", 1).alias("name"),
        F.transform(quoted, lambda x: F.regexp_replace(x, r"\\(.)", "$1")).alias("synonyms"),
        each("xref: ", r"^xref: (\S+)").alias("references"),
        F.col("value").rlike(r"(?m)^is_obsolete: true\s*$").alias("obsolete"),
        one(r"(?m)^replaced_by: (\S+)").alias("replaced_by"),
        F.concat(parents, links).alias("edges"),
    )
    edges = term.select(F.col("id").alias("child"), F.explode("edges").alias("e")).select("child", "e.parent", "e.relation")
    return term.drop("edges"), edges


def read_ontology_owl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms and edges of OWL classes in XML as ``read_ontology_json`` gives them."""
    schema = (
        "`_rdf:about` string, `rdfs:label` string, `oboInOwl:hasExactSynonym` array<string>, "
        "`oboInOwl:hasRelatedSynonym` array<string>, `oboInOwl:hasDbXref` array<string>, `owl:deprecated` string, "
        "`obo:IAO_0100001` struct<`_rdf:resource` string>, "
        "`rdfs:subClassOf` array<struct<`_rdf:resource` string, `owl:Restriction` struct<"
        "`owl:onProperty` struct<`_rdf:resource` string>, `owl:someValuesFrom` struct<`_rdf:resource` string>>>>"
    )
    classes = spark.read.format("xml").option("rowTag", "owl:Class").schema(schema).load(path)
    known = classes.where(F.col("`_rdf:about`").isNotNull())
    terms = known.select(
        F.col("`_rdf:about`").alias("id"),
        F.col("`rdfs:label`").alias("name"),
        F.concat(_listed(F.col("`oboInOwl:hasExactSynonym`")), _listed(F.col("`oboInOwl:hasRelatedSynonym`"))).alias("synonyms"),
        _listed(F.col("`oboInOwl:hasDbXref`")).alias("references"),
        F.coalesce(F.col("`owl:deprecated`") == "true", F.lit(False)).alias("obsolete"),
        F.col("`obo:IAO_0100001`.`_rdf:resource`").alias("replaced_by"),
    )
    rows = known.select(F.col("`_rdf:about`").alias("child"), F.explode("`rdfs:subClassOf`").alias("p"))
    link = F.col("p.`owl:Restriction`")
    edges = rows.select(
        "child",
        F.coalesce(F.col("p.`_rdf:resource`"), link["owl:someValuesFrom"]["_rdf:resource"]).alias("parent"),
        F.when(F.col("p.`_rdf:resource`").isNotNull(), F.lit("is_a"))
        .otherwise(_relation(link["owl:onProperty"]["_rdf:resource"]))
        .alias("relation"),
    )
    return terms, edges.where(F.col("parent").isNotNull())


# Columns of phenotype annotation files.
PHENOTYPE_SCHEMA = (
    "disease string, name string, qualifier string, phenotype string, reference string, evidence string, onset string, "
    "frequency string, sex string, modifier string, aspect string, curation string"
)


def read_phenotype_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Rows of phenotype annotation files (twelve tab-separated columns); comments and the header are left out."""
    rows = spark.read.schema(PHENOTYPE_SCHEMA).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    return rows.where(F.col("disease") != "database_id")


GFF_SCHEMA = (
    "seqid string, source string, type string, start bigint, end bigint, score string, strand string, "
    "phase string, attributes string"
)
# Columns of gene association files.
GAF_SCHEMA = (
    "db string, object_id string, symbol string, qualifier string, term string, reference string, "
    "evidence string, with_from string, aspect string, name string, synonym string, type string, "
    "taxon string, date string, assigned_by string, extension string, product string"
)
GPA_SCHEMA = (
    "db string, object_id string, qualifier string, term string, reference string, evidence string, "
    "with_from string, taxon string, date string, assigned_by string, extension string, properties string"
)


def read_gene_annotation(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """GFF3, GTF, GAF or GPA; the attributes of the first two become a map."""
    if kind in ("gaf", "gpa"):
        schema = GAF_SCHEMA if kind == "gaf" else GPA_SCHEMA
        return read_delimited_source(spark, path, schema, header=False, comment="!")
    # quotes belong to the attribute text of a GTF line
    rows = (
        spark.read.schema(GFF_SCHEMA).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    )
    if kind == "gff3":
        return rows.withColumn("attributes", F.expr("str_to_map(attributes, ';', '=')"))
    if kind != "gtf":
        raise ValueError(f"unknown annotation format: {kind}")
    tidy = F.regexp_replace(F.regexp_replace("attributes", r";\s*$", ""), '"', "")
    return rows.withColumn("attributes", tidy).withColumn(
        "attributes", F.expr("str_to_map(attributes, ';\\\\s*', ' ')")
    )


def _pieces(name: str, content: bytes) -> Iterator[bytes]:
    """Decompressed content in pieces; gzip and bzip2 may have several members."""
    if name.endswith((".gz", ".bgz")):
        rest = content
        while rest:
            stream = zlib.decompressobj(wbits=31)
            while not stream.eof:
                out = stream.decompress(rest, PIECE)
                rest = stream.unconsumed_tail
                if out:
                    yield out
                elif not rest and not stream.eof:
                    raise EOFError("truncated gzip stream")
            rest = stream.unused_data.lstrip(b"\0")
    elif name.endswith(".bz2"):
        with bz2.open(io.BytesIO(content)) as stream:
            while out := stream.read(PIECE):
                yield out
    elif name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for member in archive.namelist():
                with archive.open(member) as stream:
                    while out := stream.read(PIECE):
                        yield out
    else:
        raise ValueError("unknown compression")


def _texts(name: str, content: bytes) -> Iterator[str]:
    """Decompressed text in pieces that end at a line end."""
    tail = b""
    for data in _pieces(name, content):
        data = tail + data
        cut = data.rfind(b"\n") + 1
        if cut:
            yield data[:cut].decode("utf-8")
        tail = data[cut:]
    if tail:
        yield tail.decode("utf-8")


def _decompress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "piece", "text", "error"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            content = bytes(content)
            try:
                # read to the end first: a broken file must not leave lines behind
                for _ in _texts(path, content):
                    pass
            except Exception as problem:
                yield pd.DataFrame([(path, 0, None, str(problem))], columns=columns)
                continue
            for number, text in enumerate(_texts(path, content)):
                yield pd.DataFrame([(path, number, text, None)], columns=columns)


def bulk_decompress(spark: SparkSession, prefix: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """Lines of every compressed file below a prefix, and the files that failed.

    Spark spreads the files over tasks; a task decodes one file after the other
    in pieces cut at line ends. A file that fails contributes no lines. The
    compressed bytes of a file travel in one binary column, which Spark limits
    to 2 GB; larger gzip files are read by ``read_gzip_lines``.
    """
    ship_package(spark)
    rows = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(prefix)
        .select("path", "content")
        .mapInPandas(_decompress, "path string, piece bigint, text string, error string")
    )
    failures = rows.where(F.col("error").isNotNull()).select("path", "error")
    lines = rows.where(F.col("error").isNull()).select(
        "path", "piece", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("pos", "line")
    )
    return lines, failures


def read_susie_files(
    spark: SparkSession, snp_prefix: str, snp_glob: str, snp_schema: str, summary_path: str, summary_schema: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gzip SNP tables, credible-set summaries, and (path, start, error) of tables that are broken.

    Block-gzip tables are read by many tasks each. A broken one gives no rows.
    The summary path is a glob that must be tight enough to leave the files of
    the other credible level out.
    """
    lines, failures = read_gzip_lines(spark, snp_prefix, snp_glob)
    body = lines.where((F.col("start") > 0) | (F.col("pos") > 0))
    sound = body.join(failures.select("path").distinct(), "path", "left_anti")
    snps = sound.select(F.from_csv("line", F.lit(snp_schema), {"sep": "\t"}).alias("r")).select("r.*")
    return snps, read_delimited_source(spark, summary_path, summary_schema), failures
