"""Readers for sequences, compendia, networks, stored null distributions and results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nulls import split_experiment
from ..params import Params

COMPENDIA = "accession string, site string, num_compendia int, compendia_class int"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, sequence): the second field of a header between bars, and the lines below it joined; a `>` begins a record at the beginning of a line only."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "").select(F.regexp_replace("value", "^>", "").alias("value"))
    header, body = F.regexp_extract("value", r"^([^\r\n]*)", 1), F.regexp_extract("value", r"(?s)^[^\r\n]*[\r\n]+(.*)$", 1)
    return records.select(F.get(F.split(header, r"\|"), F.lit(1)).alias("accession"), F.regexp_replace(body, r"\s", "").alias("sequence")).where("accession is not null")


def compendia(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPENDIA).csv(path, header=True)


def delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table with a header, separated by tabs or commas as its name says."""
    reader = spark.read.option("header", True).option("sep", "," if path.rstrip("/").endswith((".csv", ".csv.gz")) else "\t")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def networks(spark: SparkSession, folder: str, kinases: list[str] | None = None) -> DataFrame:
    """(network_id, accession, site, kinase) of all tables of a folder.

    Columns go by their names, in tables without these by their order (accession, site, kinase); the id is that of the
    folder `network_id=...` that holds a table, else the second part of the file's name.
    """
    rows = spark.read.option("header", True).option("sep", "\t").csv(folder)
    columns = [c for c in rows.columns if c != "network_id"]
    columns = ["accession", "site", "kinase"] if {"accession", "site", "kinase"} <= set(columns) else columns[:3]
    network_id = F.col("network_id").cast("int") if "network_id" in rows.columns else F.get(F.split(F.col("_metadata.file_name"), "_"), F.lit(1)).try_cast("int")
    rows = rows.select(network_id.alias("network_id"), *(F.col(f"`{c}`").alias(name) for c, name in zip(columns, ("accession", "site", "kinase"))))
    return rows.where(F.col("kinase").isin(kinases)) if kinases else rows


def wide_enrichment(spark: SparkSession, path: str) -> DataFrame:
    """(network_id, kinase, sample, rep, p) from a table with a column for each `sample:rep`."""
    wide = delimited(spark, path)
    values = [c for c in wide.columns if c not in ("network_id", "kinase")]
    long = wide.unpivot([F.col("network_id"), F.col("kinase")], [F.col(f"`{c}`") for c in values], "experiment", "p")
    sample, rep = split_experiment(F.col("experiment"))
    return long.select("network_id", "kinase", sample.alias("sample"), rep.alias("rep"), F.col("p").cast("double").alias("p"))


def wide_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(kinase, p) from a table with a column for each kinase."""
    wide = delimited(spark, path)
    return wide.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns]).unpivot([], [F.col(f"`{c}`") for c in wide.columns], "kinase", "p")


#: Fields of a run information text and how they begin there (fixed values).
RUN_FIELDS = {
    "unique_id": "Unique ID",
    "date": "Date Run",
    "network_used": "Network Used",
    "phospho_type": "Phospho Type",
    "kinase_size": "Kinase Size",
    "site_limit": "Site Limit",
    "networks": "# of Networks",
    "use_compendia": "Use Compendia",
}


def run_information(spark: SparkSession, path: str) -> DataFrame:
    """One row with the fields of a run information text or of its JSON form, and the sizes by compendia."""
    text = spark.read.text(path, wholetext=True)
    if path.endswith(".json"):
        kinds = ", ".join(f"{c} string" for c in RUN_FIELDS)
        return text.select(F.from_json("value", f"{kinds}, compendia array<int>").alias("r")).select("r.*")
    field = lambda name: F.trim(F.regexp_extract("value", rf"(?m)^\Q{name}\E\s*[:\t]\s*(.*)$", 1))
    sizes = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^Compendia\s+[0-9]+\s*[:\t]?\s*([0-9]+)"), F.lit(1)), lambda n: n.cast("int"))
    return text.select(*[field(v).alias(k) for k, v in RUN_FIELDS.items()], sizes.alias("compendia"))


def same_network(information: DataFrame, network_id: str) -> bool:
    """Whether stored nulls were made for this network."""
    row = information.select("unique_id").first()
    return row is not None and row[0] == network_id


def results(spark: SparkSession, folder: str, schemas: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], Params]:
    """Saved tables by name, whatever kind they were saved as, and the settings they were made with; `schemas` gives the columns of tables saved as text."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(hadoop) if s.isDirectory() and s.getPath().getName() != "params")
    settings = spark.read.text(f"{folder}/params").first()[0]
    tables = {}
    for name in names:
        base, _, kind = name.rpartition(".")
        path, schema = f"{folder}/{name}", (schemas or {}).get(base)
        if kind in ("tsv", "csv") and base:
            tables[base] = delimited(spark, path, schema)
        elif kind == "json" and base:
            tables[base] = (spark.read.schema(schema) if schema else spark.read).json(path)
        else:
            tables[base if kind == "parquet" and base else name] = spark.read.parquet(path)
    return tables, Params.from_json(settings)


def stored_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """What `save_nulls` wrote: enrichment of random experiments with their class mix and size, which choose the folders read."""
    return spark.read.parquet(folder).withColumns({"mix": F.col("mix").cast("string"), "size": F.col("size").cast("int")})


def wide_results(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(kinase, sample, value) from a table with a row for each kinase and a column for each sample, as tsv or csv."""
    wide = delimited(spark, path)
    index, *samples = wide.columns
    return wide.unpivot([F.col(f"`{index}`").alias("kinase")], [F.col(f"`{c}`") for c in samples], "sample", value).withColumn(value, F.col(value).cast("double"))


def result_tables(spark: SparkSession, activities: str, fpr: str) -> DataFrame:
    """(sample, kinase, mw_p, fpr) from the two wide tables that a run leaves."""
    return wide_results(spark, activities, "mw_p").join(wide_results(spark, fpr, "fpr"), ["kinase", "sample"], "full_outer").select("sample", "kinase", "mw_p", "fpr")


def long_results(spark: SparkSession, path: str) -> DataFrame:
    """(sample, kinase, mw_p, fpr) from long tables (data, kinase, activity, false positive rate), as workflow runs leave them."""
    rows = delimited(spark, path)
    sample, kinase, p, fpr = rows.columns[:4]
    return rows.select(F.col(f"`{sample}`").alias("sample"), F.col(f"`{kinase}`").alias("kinase"), F.col(f"`{p}`").cast("double").alias("mw_p"), F.col(f"`{fpr}`").cast("double").alias("fpr"))


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(name, valid, reason): the networks below a folder; a valid one has tables and a run information."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for entry in files.listStatus(path):
        if entry.isDirectory():
            names = [s.getPath().getName() for s in files.listStatus(entry.getPath())]
            lacks = [what for what, ok in (("run information", any(n.startswith("RUN_INFORMATION") for n in names)), ("network tables", any(n.endswith(".tsv") for n in names))) if not ok]
            rows.append((entry.getPath().getName(), not lacks, "no " + " and no ".join(lacks) if lacks else ""))
    return spark.createDataFrame(rows, "name string, valid boolean, reason string")


def settings(text: str) -> dict:
    """A configuration document."""
    return json.loads(text)
