"""Readers of the file formats of the field, each giving a DataFrame of plain columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
THREE = "ALA A ARG R ASN N ASP D CYS C GLN Q GLU E GLY G HIS H ILE I LEU L LYS K MET M PHE F PRO P SER S THR T TRP W TYR Y VAL V".split()
RARE = ["SEC", "U", "PYL", "O"]


def csv(spark: SparkSession, path: str, columns: list[str] | None = None, strict: bool = False, sep: str = ",", missing_ok: bool = False) -> DataFrame:
    """All-string CSV with header; a null is an empty string. ``strict`` fails on a row of another width."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep)
    reader = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("enforceSchema", False)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    try:
        return reader.csv(path).na.fill("")
    except Exception as error:
        if missing_ok and columns and "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
        raise


def tsv_with_comments(spark: SparkSession, path: str) -> DataFrame:
    """TSV with header whose lines after ``#`` and blank lines are skipped."""
    return spark.read.option("header", True).option("sep", "\t").option("comment", "#").option("quote", "").csv(path).na.fill("")


def header_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of the ``#key: value`` lines before the first other line of a single file."""
    text = spark.read.text(path, wholetext=True)
    head = text.select(F.regexp_extract("value", r"\A((?:#[^\n]*\n?)*)", 1).alias("h"))
    lines = head.select(F.explode(F.split("h", "\n")).alias("l")).where(F.col("l").rlike("^#[^:]+:"))
    pair = F.split(F.regexp_replace("l", "^#", ""), ":", 2)
    return lines.select(F.btrim(pair[0]).alias("key"), F.btrim(pair[1]).alias("value"))


def obo(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, parents[], alt_ids[], obsolete`` of the terms of an OBO ontology."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").rlike(r"(?m)^\[Term\]\s*$"))
    lines = stanzas.select(F.split("value", r"\r?\n").alias("l"))
    of = lambda tag: F.transform(F.filter("l", lambda x: F.startswith(x, F.lit(tag + ": "))), lambda x: F.btrim(F.substring(x, len(tag) + 3, 1_000_000)))
    target = lambda x: F.get(F.split(F.btrim(F.get(F.split(x, "!"), 0)), r"\s+"), 0)
    return lines.select(
        F.get(of("id"), 0).alias("id"), F.get(of("name"), 0).alias("name"), F.transform(of("is_a"), target).alias("parents"), of("alt_id").alias("alt_ids"),
        F.coalesce(F.get(of("is_obsolete"), 0) == "true", F.lit(False)).alias("obsolete"),
    ).where("id is not null")


def obographs(spark: SparkSession, path: str, prefix: str = "MONDO") -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label, synonyms[], xrefs[]`` and edges ``child, parent`` of an ontology in JSON, without deprecated ones."""
    schema = "graphs array<struct<nodes:array<struct<id:string,lbl:string,type:string,meta:struct<deprecated:boolean,synonyms:array<struct<pred:string,val:string>>,xrefs:array<struct<val:string>>>>>,edges:array<struct<sub:string,pred:string,obj:string>>>>"
    graphs = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("graphs").alias("g"))
    n = graphs.select(F.explode("g.nodes").alias("n")).where(~F.coalesce("n.meta.deprecated", F.lit(False)))
    none = F.array().cast("array<string>")
    nodes = n.select(curie(F.col("n.id")).alias("id"), F.col("n.lbl").alias("label"), F.coalesce("n.meta.synonyms.val", none).alias("synonyms"), F.coalesce("n.meta.xrefs.val", none).alias("xrefs"))
    edges = graphs.select(F.explode("g.edges").alias("e")).where("e.pred = 'is_a'").select(curie(F.col("e.sub")).alias("child"), curie(F.col("e.obj")).alias("parent"))
    return nodes.where(F.startswith(F.col("id"), F.lit(prefix + ":"))), edges.where(F.startswith(F.col("child"), F.lit(prefix + ":")))


def curie(url: Column) -> Column:
    """``…/obo/MONDO_0001`` to ``MONDO:0001``; only the first ``_`` changes."""
    return F.regexp_replace(F.substring_index(url, "/", -1), "^([^_]*)_", "$1:")


def mapping_tsv(spark: SparkSession, path: str, species: str) -> DataFrame:
    """``accession, pathway_id, url, pathway, evidence`` of one species from a headerless six-column mapping; the
    isoform suffix of accessions is cut."""
    cols = ("accession", "pathway_id", "url", "pathway", "evidence", "species")
    rows = spark.read.option("sep", "\t").option("quote", "").schema(", ".join(f"{c} string" for c in cols)).csv(path)
    return rows.where(F.col("species") == species).withColumn("accession", F.substring_index("accession", "-", 1)).drop("species")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``id, sequence``: the id is the header up to the first ``|`` or blank."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.btrim("value") != "")
    lines = F.split("value", r"\r?\n")
    return rows.select(F.regexp_extract(lines[0], r"^\s*([^|\s]+)", 1).alias("id"), F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, 1_000_000_000), ""), r"\s", "")).alias("sequence"))


def pdb_trace(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Cα atoms in file order: ``path, i, chain, number, icode, residue, x, y, z, plddt``.

    Strict: only unplaced or first alternate locations, an unknown residue raises. Lenient: any alternate location,
    rare residues have their letters and unknown ones ``X``. The first atom of a residue counts.
    """
    from pyspark.sql import Window as W

    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "l"))
    cut = lambda a, b: F.substring("l", a + 1, b - a)
    atoms = text.where((F.btrim(cut(0, 6)) == "ATOM") & (F.btrim(cut(12, 16)) == "CA"))
    if strict:
        atoms = atoms.where(cut(16, 17).isin(" ", "A"))
    letters = F.create_map(*map(F.lit, THREE + ([] if strict else RARE)))
    name = F.btrim(cut(17, 20))
    known = letters[name]
    residue = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown residue "), name)).cast("string")) if strict else F.coalesce(known, F.lit("X"))
    keys = ["path", "chain", "number", "icode"] if strict else ["path", "number", "icode"]
    rows = atoms.select("path", "line", cut(21, 22).alias("chain"), F.btrim(cut(22, 26)).cast("int").alias("number"), F.btrim(cut(26, 27)).alias("icode"), residue.alias("residue"), *(F.btrim(cut(a, a + 8)).cast("double").alias(c) for a, c in ((30, "x"), (38, "y"), (46, "z"))), F.btrim(cut(60, 66)).cast("double").alias("plddt"))
    first = rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy("line"))).where("__r = 1").drop("__r")
    out = first.withColumn("i", (F.row_number().over(W.partitionBy("path").orderBy("line")) - 1).cast("bigint")).drop("line")
    return out if strict else out.withColumn("plddt", F.bround("plddt"))


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, required: list[str] | None = None) -> DataFrame:
    """JSON lines; strict fails on a bad line, else bad lines and those without the required fields are dropped."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    for c in required or []:
        rows = rows.where(F.coalesce(F.col(c), F.lit("")) != "")
    return rows


def markdown_chunks(spark: SparkSession, path: str, limit: int = 1800) -> DataFrame:
    """``doc_id, source_path, source_locator, text`` of the chunks of Markdown files."""
    from weftgraph.operators.retrieval import chunks

    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(chunks(F.col("value"), limit)).alias("i", "text"))
    number = (F.col("i") + 1).cast("string")
    return text.select(F.concat(F.lit("MD:"), F.regexp_replace("file", r"\.md$", ""), F.lit(":"), number).alias("doc_id"), F.col("file").alias("source_path"), F.concat("file", F.lit("#chunk="), number).alias("source_locator"), "text")


def markdown_table(spark: SparkSession, path: str, row: str = r"^\|\s*E-?\d+", least: int = 6) -> DataFrame:
    """``cells[]`` of table rows that match ``row`` with at least ``least`` cells; links become their text."""
    lines = spark.read.text(path).where(F.col("value").rlike(row))
    plain = F.regexp_replace("value", r"\[([^\]]*)\]\([^)]*\)", "$1")
    cells = lines.select(F.transform(F.split(F.btrim(plain, F.lit("| \t\r")), r"\|"), lambda c: F.btrim(c)).alias("cells"))
    return cells.where(F.size("cells") >= least)


def manifest(spark: SparkSession, path: str) -> dict:
    """A JSON manifest; empty where there is none."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return {}
        raise


def script_json(text: Column) -> Column:
    """The JSON of ``window.X = {...};``: from the first ``{`` to the last ``}``."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def newest_release(spark: SparkSession, root: str, needed: list[str]) -> str | None:
    """The greatest tag (a folder of ``root``) that has all needed files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    tags = sorted((s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()), reverse=True)
    return next((t for t in tags if all(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{t}/{f}")) for f in needed)), None)


def safe_name(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")
