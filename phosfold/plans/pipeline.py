"""The whole analysis as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrichment, evidence, nulls, significance
from ..operators import networks as pruning
from ..params import Params
from ..sources.paths import materialize
from ..sources.store import NetworkStore


@dataclass
class Analysis:
    """Each step's table; enrichment is written once, as activities read it several times."""

    evidence: DataFrame
    enrichment: DataFrame
    random_enrichment: DataFrame
    activities: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"evidence": self.evidence, "enrichment": self.enrichment, "random_enrichment": self.random_enrichment, "activities": self.activities}


def binary_evidence(raw: DataFrame, compendia: DataFrame, params: Params) -> DataFrame:
    """(sample, accession, site, num_compendia, compendia_class) of one phospho type."""
    rows = evidence.collapse(evidence.of_type(raw, params.phospho_type), params.agg)
    if params.top_n is not None:
        chosen = evidence.by_rank(rows, params.top_n, params.greater)
    else:
        valid = evidence.valid_samples(rows, [params.threshold], params.greater, params.min_evidence_size)
        chosen = evidence.by_threshold(rows, params.threshold, params.greater).join(valid.where("valid").select("sample"), "sample", "left_semi")
    return evidence.with_compendia(chosen, compendia)


def pregenerate(networks: DataFrame, compendia: DataFrame, params: Params, sizes: list[int], mixes: dict[str, list[float]], done: DataFrame | None = None, only: list[tuple[str, int]] | None = None) -> DataFrame:
    """(mix, size, network_id, kinase, sample, rep, frequency, p) of random experiments for every class mix and size that is not `done`, or for those in `only`."""
    networks, sites = evidence.of_type(networks, params.phospho_type), evidence.of_type(compendia, params.phospho_type)
    wanted = nulls.stored_quotas(sizes, mixes, networks.sparkSession)
    if done is not None:
        wanted = nulls.missing(wanted, done)
    if only is not None:
        wanted = wanted.where(F.col("sample").isin([f"{m}/{s}" for m, s in only]))
    quotas, full = wanted.select("sample", "stratum", "quota"), enrichment.network_sizes(networks)
    if max((q for m in mixes.values() for s in sizes for q in nulls.quotas(s, m)), default=0) <= nulls.FEW:
        # few sites in each: they are drawn with one look at the keys and meet the networks like evidence
        drawn = materialize(nulls.draw(sites, quotas, params.reps, params.seed), "drawn")
        rows = enrichment.enrich(networks, drawn, full)
    else:
        nobody = networks.sparkSession.createDataFrame([], "sample string, accession string, site string")
        rows = enrichment.enrich(networks, nobody, full, sites, nulls.cutoffs(sites, quotas, params.reps, params.seed))
    return rows.join(F.broadcast(wanted.select("sample", "mix", "size").distinct()), "sample").select("mix", "size", *rows.columns)


def fill_nulls(store: NetworkStore, compendia: DataFrame, params: Params, sizes: list[int], mixes: dict[str, list[float]]) -> None:
    """Store the random experiments that networks of the store lack; draws don't depend on networks, so earlier ones agree with later ones."""
    for ids, wanted in store.lacking(sizes, list(mixes)).items():
        networks = store.networks(check=False).where(F.col("network_id").isin(list(ids)))
        store.add_nulls(pregenerate(networks, compendia, params, sizes, mixes, only=wanted))


def build_networks(weighted: DataFrame, compendia: DataFrame, folder: str, params: Params, networks: int, kinase_size: int, site_limit: int, by_compendia: bool = True, sizes: list[int] | None = None, mixes: dict[str, list[float]] | None = None, date: str = "") -> DataFrame:
    """(network_id, kinase, accession, site) of pruned networks, kept in the store below `folder`.

    Only sites of the phospho type that compendia know are pruned; with `by_compendia`, each number
    of compendia apart. A size that the sites can't give is refused before anything is drawn. With
    `sizes` and `mixes`, random experiments over the networks are stored as well. What the store has
    already is kept as it is, which takes up an interrupted build.
    """
    known = evidence.unique_compendia(compendia)
    long = evidence.of_type(weighted, params.phospho_type).join(known.select(*evidence.KEYS), evidence.KEYS, "left_semi")
    store = NetworkStore(weighted.sparkSession, folder)
    done = store.manifest("networks").select("network_id").distinct()
    if done.where(F.col("network_id") < networks).count() < networks:
        store.add_networks(pruning.prune(long, compendia if by_compendia else None, networks, kinase_size, site_limit, params.seed, done))
    else:
        pruning.check_size(long, kinase_size, site_limit)
    if sizes and mixes:
        fill_nulls(store, compendia, params, sizes, mixes)
    histogram = {r[0]: r[1] for r in known.groupBy("num_compendia").count().collect()}
    store.save_information(params, date, kinase_size, site_limit, by_compendia, [histogram.get(k, 0) for k in range(max(histogram, default=-1) + 1)])
    return store.networks()


def analyse(raw: DataFrame, networks: DataFrame, compendia: DataFrame, params: Params, kinases: list[str] | None = None, stored: DataFrame | None = None) -> Analysis:
    """Evidence, enrichment of it and of random experiments that match its study bias, and activities.

    Real evidence is replicate -1 of the enrichment, random experiments are the others. With `stored`
    experiments (see `pregenerate`), samples near one of their sizes use them and the others draw their own.
    """
    networks = evidence.of_type(networks, params.phospho_type)
    sizes = enrichment.network_sizes(networks)
    if kinases is not None:
        networks, _ = enrichment.choose_kinases(networks, kinases)
    if params.m_from == "filtered":
        sizes = enrichment.network_sizes(networks)
    real = binary_evidence(raw, compendia, params)
    sites, quotas, route = evidence.of_type(compendia, params.phospho_type), evidence.stratum_sizes(real, params.stratum), None
    if stored is not None:
        known = stored.select("size").distinct()
        route = materialize(nulls.route(evidence.sizes(real), evidence.class_shares(real), known, params.phospho_type).join(stored.select("mix", F.col("size").alias("matched")).distinct().withColumn("there", F.lit(True)), ["mix", "matched"], "left").withColumn("source", F.when(F.col("there"), "stored").otherwise("drawn")), "route")
        quotas = quotas.join(route.where("source = 'stored'").select("sample"), "sample", "left_anti")
    cuts = nulls.cutoffs(sites, quotas, params.reps, params.seed, params.stratum)
    rows = enrichment.enrich(networks, real.select("sample", "accession", "site"), sizes, sites, cuts, params.stratum)
    if route is not None:
        chosen = stored if kinases is None else stored.where(F.col("kinase").isin(kinases))
        rows = rows.unionByName(nulls.use_stored(route, chosen.where(F.col("rep") < params.reps)))
    rows = materialize(rows, "enrichment")
    found, random = rows.where("rep = -1").drop("rep"), rows.where("rep >= 0")
    return Analysis(real, found, random, significance.activities(found, random, params.seed, params.drop))


def by_type(raw: DataFrame, networks: DataFrame, compendia: DataFrame, params: dict[str, Params]) -> dict[str, Analysis]:
    """One analysis for each phospho type."""
    return {kind: analyse(raw, networks, compendia, p) for kind, p in params.items()}
