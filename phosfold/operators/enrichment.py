"""Enrichment of kinases' substrates among evidence, over all networks, samples and replicates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, with_hypergeometric_tail, with_largest_overlap
from ..sources.paths import materialize
from . import nulls
from .evidence import KEYS


def network_sizes(networks: DataFrame) -> DataFrame:
    """(network_id, m): distinct sites of each network."""
    return networks.select("network_id", *KEYS).distinct().groupBy("network_id").agg(F.count("*").alias("m"))


def kinase_degrees(networks: DataFrame) -> DataFrame:
    """(network_id, kinase, degree): edges of each kinase."""
    return networks.groupBy("network_id", "kinase").agg(F.count("*").alias("degree"))


def choose_kinases(networks: DataFrame, kinases: list[str]) -> tuple[DataFrame, list[str]]:
    """Edges of the chosen kinases, and those of them that no network has."""
    known = {r[0] for r in networks.where(F.col("kinase").isin(kinases)).select("kinase").distinct().collect()}
    return networks.where(F.col("kinase").isin(kinases)), sorted(set(kinases) - known)


def enrich(networks: DataFrame, evidence: DataFrame, sizes: DataFrame | None = None, compendia: DataFrame | None = None, cuts: DataFrame | None = None, stratum: str = "compendia_class") -> DataFrame:
    """(network_id, kinase, sample, rep, frequency, p) for all kinases of all networks.

    `evidence` has (sample, accession, site), and rep if it holds replicates; `cuts` are cutoffs of random
    experiments on `compendia` (see `nulls`), which are added as replicates 0, 1, ... A network's kinases
    are gathered for each site, so one join of sites gives the evidence inside each network and its
    overlap with each kinase, and only counts are shuffled behind it. Kinases that meet no evidence get
    frequency 0 and p 1. `sizes` keeps the sizes of full networks when kinases were chosen before.
    The probability is computed once for each distinct set of its four numbers.
    """
    if "rep" not in evidence.columns:
        evidence = evidence.withColumn("rep", F.lit(-1))
    evidence = evidence.select("sample", "rep", *KEYS).distinct()
    sizes = network_sizes(networks) if sizes is None else sizes
    degrees = kinase_degrees(networks)
    # dealt by site for both the gathering and the join
    held = nulls.spread(networks).groupBy("network_id", *KEYS).agg(F.collect_list("kinase").alias("kinases"))
    met, tried = held.join(evidence, KEYS), evidence.select("sample", "rep").distinct()
    unit = ["network_id", "sample", "rep"]
    # a row without a kinase counts the site itself
    counts = met.select(*unit, F.explode(F.array_append("kinases", F.lit(None).cast("string"))).alias("kinase")).groupBy(*unit, "kinase").agg(F.count("*").alias("k"))
    if cuts is not None:
        counts = counts.unionByName(nulls.overlaps(held, compendia, cuts, stratum))
        tried = tried.unionByName(cuts.select("sample", "rep").distinct())
    counts = materialize(counts, "overlaps")
    inside = counts.where("kinase is null").select(*unit, F.col("k").alias("n"))
    # all networks meet all samples and replicates, whose number the settings bound
    grid = degrees.join(sizes, "network_id").crossJoin(tried)
    found = grid.join(inside, unit, "left").join(counts.where("kinase is not null"), [*unit, "kinase"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "k": F.coalesce("k", F.lit(0))})
    numbers = found.where("k > 0").select("k", "m", "degree", "n").distinct()
    tails = with_hypergeometric_tail(numbers)
    return found.join(tails, ["k", "m", "degree", "n"], "left").select("network_id", "kinase", "sample", "rep", F.col("k").alias("frequency"), F.coalesce("tail", F.lit(1.0)).alias("p"))


def median_enrichment(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("sample", "kinase").agg(F.median("p").alias("median_p"))


def top_kinases(medians: DataFrame, n: int = 5, value: str = "median_p") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(value, "kinase"))
    return medians.withColumn("rank", rank).where(F.col("rank") <= n)


def normalise(enriched: DataFrame, factors: DataFrame | None = None, default: float = 0.05, multiplier: float = 0.05) -> DataFrame:
    """p scaled by the sample's and kinase's factor into [0, 1], and whether it is significant for one of all networks."""
    rows = enriched.withColumn("factor", F.lit(default)) if factors is None else enriched.join(factors, ["sample", "kinase"], "left").withColumn("factor", F.coalesce("factor", F.lit(default)))
    many = enriched.select("network_id").distinct().agg(F.count("*").alias("networks"))
    rows = rows.join(F.broadcast(many))
    return rows.withColumns({"normalised": clip(F.coalesce(F.try_divide(F.col("p"), F.col("factor")) * multiplier, F.lit(1.0)), 0.0, 1.0), "significant": (F.col("p") <= F.col("factor") / F.col("networks")).cast("int")}).drop("factor", "networks")


def normalised_summary(normalised: DataFrame) -> DataFrame:
    return normalised.groupBy("sample", "kinase").agg(
        F.median("p").alias("median_original"), F.median("normalised").alias("median_normalised"), F.sum("significant").alias("count_significant"), F.avg("significant").alias("fraction_significant")
    )


def overlap_limits(networks: DataFrame, evidence: DataFrame) -> DataFrame:
    """(sample, limit): mean over networks of the largest overlap that a kinase of mean degree could have with a tail above zero."""
    evidence = evidence.select("sample", *KEYS).distinct()
    mean = kinase_degrees(networks).groupBy("network_id").agg(F.floor(F.avg("degree")).alias("size"))
    inside = networks.select("network_id", *KEYS).distinct().join(evidence, KEYS).groupBy("network_id", "sample").agg(F.count("*").alias("n"))
    rows = inside.join(mean, "network_id").join(network_sizes(networks), "network_id")
    found = with_largest_overlap(rows.select("m", F.col("size").alias("degree"), "n").distinct()).where("largest is not null").withColumnRenamed("degree", "size")
    return rows.join(found, ["m", "size", "n"]).groupBy("sample").agg(F.avg("largest").alias("limit"))


def pivot_unique(rows: DataFrame, index: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Wide form; an error if a cell has more than one value."""
    if rows.groupBy(index, column).count().where("count > 1").take(1):
        raise ValueError("a cell of the table has several values")
    return rows.groupBy(index).pivot(column, names).agg(F.first(value))
