"""Writers; tables are Parquet, partitioned where later reads choose a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import wide_form
from ..operators.mapping import Mapped, mapping_statistics
from ..operators.nulls import wide_experiments
from ..params import Params


def save_experiment(mapped: Mapped, folder: str, statistics: bool = True, rejects: bool = True) -> None:
    mapped.rows.write.mode("overwrite").parquet(f"{folder}/mapped")
    if rejects:
        mapped.rejects.write.mode("overwrite").parquet(f"{folder}/rejects")
    if statistics:
        mapping_statistics(mapped).write.mode("overwrite").parquet(f"{folder}/statistics")


def save_results(spark: SparkSession, tables: dict[str, DataFrame], params: Params, folder: str, minimal: bool = True, kind: str | None = None) -> None:
    """Evidence and activities, with the enrichment tables as well unless minimal, and the settings; as Parquet, or as files of a kind (see `save_tables`)."""
    chosen = {n: t for n, t in tables.items() if not minimal or n in ("evidence", "activities")}
    if kind is not None:
        save_tables(chosen, folder, kind)
    else:
        for name, table in chosen.items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(params.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/params")


def save_tables(tables: dict[str, DataFrame], folder: str, kind: str = "tsv") -> None:
    """Tables as files of one kind (tsv, csv, json or parquet), one folder each."""
    if kind not in ("tsv", "csv", "json", "parquet"):
        raise ValueError("kind is tsv, csv, json or parquet")
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if kind in ("tsv", "csv"):
            writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(f"{folder}/{name}.{kind}")
        else:
            writer.format(kind).save(f"{folder}/{name}.{kind}")


def save_wide_activities(activities: DataFrame, folder: str, samples: list[str], kind: str = "tsv") -> None:
    """Activities and false positive rates with a row for each kinase and a column for each sample."""
    wide = lambda value: wide_form(activities, samples, ["kinase"], "sample", value)
    save_tables({"mann_whitney_activities": wide("mw_p"), "mann_whitney_fpr": wide("fpr")}, folder, kind)


def save_nulls(enriched: DataFrame, folder: str) -> None:
    """Stored null enrichment, in one folder for each class mix and size."""
    enriched.write.mode("append").partitionBy("mix", "size").parquet(folder)


def save_networks(networks: DataFrame, folder: str, kind: str = "parquet") -> None:
    """Networks in a folder each, as Parquet or tsv."""
    if kind not in ("parquet", "tsv"):
        raise ValueError("kind is parquet or tsv")
    writer = networks.write.mode("overwrite").partitionBy("network_id")
    writer.parquet(folder) if kind == "parquet" else writer.option("header", True).option("sep", "\t").csv(folder)


def save_wide(enriched: DataFrame, path: str, names: list[str]) -> None:
    """One column for each `sample:rep`, for tools that want it so."""
    rows = enriched.withColumn("experiment", F.concat_ws(":", "sample", F.col("rep").cast("string")))
    wide = rows.groupBy("network_id", "kinase").pivot("experiment", names).agg(F.first("p"))
    wide.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def save_statistics(stats: DataFrame, folder: str) -> None:
    stats.write.mode("overwrite").parquet(folder)


def export_tsv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def export_experiments(drawn: DataFrame, path: str, names: list[str]) -> None:
    export_tsv(wide_experiments(drawn, names), path)
