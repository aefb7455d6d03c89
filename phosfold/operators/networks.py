"""Pruning weighted networks into binary ones, and what networks cover."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import materialize
from .evidence import KEYS, compendia_class, of_type, unique_compendia
from .places import numbered


def numeric_columns(wide: DataFrame, keep: list[str]) -> list[str]:
    """Kinase columns: numbers, and texts that hold a number somewhere ('-' stands for none)."""
    numbers = [c for c, t in wide.dtypes if c not in keep and t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal") and c not in keep]
    texts = [c for c, t in wide.dtypes if c not in keep and t == "string"]
    if texts:
        value = lambda c: F.expr(f"try_cast(nullif(`{c}`, '-') as double)")
        checks = [F.every((F.col(f"`{c}`").isNull()) | (F.col(f"`{c}`") == "-") | value(c).isNotNull()).alias(f"t{i}") for i, c in enumerate(texts)]
        row = wide.agg(*checks).first()
        numbers += [c for i, c in enumerate(texts) if row[f"t{i}"]]
    return [c for c in wide.columns if c in numbers]


def weights(wide: DataFrame, phospho_type: str) -> DataFrame:
    """(accession, site, kinase, weight) of positive weights; rows of one site must agree."""
    rows = of_type(wide.dropna(subset=KEYS), phospho_type)
    kinases = numeric_columns(rows, KEYS)
    named = rows.select(*KEYS, *[F.expr(f"try_cast(nullif(cast(`{c}` as string), '-') as double)").alias(c) for c in kinases])
    # one row a key: as many distinct rows as rows that differ
    clash = named.distinct().groupBy(*KEYS).count().where("count > 1")
    if clash.take(1):
        raise ValueError("a site has rows with different weights")
    long = named.distinct().unpivot([F.col(k) for k in KEYS], [F.col(f"`{c}`") for c in kinases], "kinase", "weight")
    return long.where("weight > 0 and not isnan(weight)")


def used_kinases(long: DataFrame) -> list[str]:
    """Kinases with an edge; columns without any drop out."""
    return [r[0] for r in long.select("kinase").distinct().orderBy("kinase").collect()]


def compendia_quota(histogram: dict[int, int], size: int) -> dict[int, int]:
    """Sites of each number of compendia: shares times a multiplier, cut, that grows until the size is reached."""
    total = sum(histogram.values())
    multiplier = size
    while total:
        quota = {k: int(n / total * multiplier) for k, n in histogram.items()}
        if sum(quota.values()) >= size:
            return quota
        multiplier += 1
    return {}


def feasible_size(long: DataFrame, site_limit: int) -> DataFrame:
    """Largest kinase size for the sites and kinases, and the recommended range."""
    sums = long.agg(F.count_distinct(*KEYS).alias("sites"), F.count_distinct("kinase").alias("kinases"))
    most = F.try_divide(F.col("sites") * site_limit, F.col("kinases"))
    return sums.select("sites", "kinases", F.floor(most).alias("largest"), F.floor(most * 0.2).alias("low"), F.floor(most * 0.4).alias("high"))


def check_size(long: DataFrame, kinase_size: int, site_limit: int) -> None:
    row = feasible_size(long, site_limit).first()
    if row.largest is None or kinase_size > row.largest:
        raise ValueError(f"kinase_size must be at most {row.largest}; {row.low} to {row.high} is recommended")


def clocks(rows: DataFrame, seed: int) -> DataFrame:
    """`rows` (network_id, stratum, kinase, accession, site, weight) with `clock`: a kinase that draws sites by weight without replacement takes them in this order."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "network_id", "kinase", *KEYS), 11) + 0.5) * 2.0**-53
    return rows.withColumn("clock", -F.log(uniform) / F.col("weight"))


def turn(seed: int, network: int, stratum: int, number: int, kinase: str) -> int:
    """A kinase's place among the kinases of a round: rounds shuffle them anew."""
    name = f"{seed}|{network}|{stratum}|{number}|{kinase}".encode()
    return int.from_bytes(hashlib.blake2b(name, digest_size=7).digest(), "big")


_ASKED = "network_id int, stratum int, accession string, site string, round int, turn bigint, kinase string, short boolean"


def _walk(listed: DataFrame, quota: dict[int, int], width: int, seed: int) -> DataFrame:
    """What each kinase asks for, in the order of its clocks: a slot takes the next site whose last holder (`cut`) is not before it.

    Lists are streamed, in memory of a batch. A list that goes on behind `width` with slots left gives a row marked `short`.
    """
    unit = ["network_id", "stratum", "kinase"]

    def run(stream):
        at = rank = None
        left = 0
        for batch in stream:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            found = []
            for n, s, k, place, full in zip(cols["network_id"], cols["stratum"], cols["kinase"], cols["place"], zip(cols["c_round"], cols["c_turn"], cols["c_kinase"])):
                if at != (n, s, k):
                    at, left, number = (n, s, k), quota[s], 0
                    rank = (0, turn(seed, n, s, 0, k), k)
                over = place > width
                if not left or not over and full[0] is not None and rank > full:
                    found.append(None)
                    continue
                found.append((*rank, over))
                if not over:
                    left, number = left - 1, number + 1
                    rank = (number, turn(seed, n, s, number, k), k)
            rows = [i for i, f in enumerate(found) if f is not None]
            kept = batch.take(pa.array(rows, pa.int64()))
            slot = list(zip(*(found[i] for i in rows))) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in ("network_id", "stratum", *KEYS)), pa.array(slot[0], pa.int32()), pa.array(slot[1], pa.int64()), pa.array(slot[2], pa.string()), pa.array(slot[3], pa.bool_())],
                names=["network_id", "stratum", *KEYS, "round", "turn", "kinase", "short"],
            )

    return listed.repartition(*unit).sortWithinPartitions(*unit, "place").mapInArrow(run, _ASKED)


UNIT = ["network_id", "stratum", "kinase"]


def _masses(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, size, mass): edges and sum of weights of each list."""
    return rows.groupBy(*by).agg(F.count("*").alias("size"), F.sum("weight").alias("mass"))


def _lists(rows: DataFrame, lists: DataFrame, width: int, seed: int) -> DataFrame:
    """(network_id, stratum, kinase, accession, site, place): the first `width` + 1 sites of each kinase by its clocks.

    `lists` has (network_id, stratum, kinase, size, mass). Of a list about as many clocks lie below a bound as the bound
    times its mass, so only clocks below one that should leave enough of them are put in order. Lists that get
    fewer have a larger bound, at last none.
    """
    order, most = F.row_number().over(Window.partitionBy(*UNIT).orderBy("clock", *KEYS)), width + 1
    found, enough = [], most + 8 * most**0.5 + 16
    for bound in (enough, 32 * enough, None):
        clocked = clocks(rows, seed)
        if bound is not None:
            clocked = clocked.where(F.col("clock") * F.col("mass") < bound)
        some = materialize(clocked.select(*UNIT, *KEYS, order.alias("place")).where(F.col("place") <= most), "lists")
        got = some.groupBy(*UNIT).agg(F.count("*").alias("got"))
        lists = lists.join(got, UNIT, "left").withColumn("short", F.coalesce("got", F.lit(0)) < F.least("size", F.lit(most))).drop("got")
        short = lists.where("short").drop("short")
        if bound is None or not short.take(1):
            found.append(some)
            break
        # a row for each list, whose number the settings bound
        lists = materialize(short, "short")
        found.append(some.join(F.broadcast(lists.select(*UNIT)), UNIT, "left_anti"))
        rows = rows.join(F.broadcast(lists.select(*UNIT)), UNIT, "left_semi")
    return reduce(DataFrame.unionByName, found)


def settle(rows: DataFrame, quota: dict[int, int], site_limit: int, seed: int, width: int | None = None, lists: DataFrame | None = None) -> DataFrame:
    """(network_id, kinase, accession, site): which edges rounds of draws take, by deferred acceptance.

    In round after round the kinases, in a shuffled order, each take the next site of their clocks (see `clocks`) that
    has room. Sites want the earliest turns and kinases the earliest clocks, so this is the one stable matching of turns
    and sites: all kinases ask at once, sites tell the last turn that they have room for, and kinases ask again until
    nothing changes. The turns before the first one that is still wrong stay right, so it ends, mostly within a few passes.

    Only the first `width` sites of each list are read; it doubles while a kinase could go on behind them. `lists` may give
    the size and mass of each list (see `_lists`), and `rows` the mass as a column then.
    """
    wanted = F.col("stratum").isin([s for s, q in quota.items() if q > 0])
    rows = rows.where(wanted)
    if lists is None:
        lists = materialize(_masses(rows, UNIT), "masses")
        rows = rows.join(F.broadcast(lists.select(*UNIT, "mass")), UNIT)
    lists = lists.where(wanted)
    width = width or 2 * max(quota.values(), default=0) + 16
    listed = asked = None
    slot = F.struct("round", "turn", "kinase")
    while True:
        if listed is None:
            listed = _lists(rows, lists, width, seed)
        if asked is None:
            full = listed.sparkSession.createDataFrame([], "network_id int, accession string, site string, c_round int, c_turn bigint, c_kinase string")
        else:
            # a kinase asks once for a site, so a list is at most as long as there are kinases
            held = asked.where("not short").groupBy("network_id", *KEYS).agg(F.count("*").alias("n"), F.collect_list(slot).alias("held")).where(F.col("n") >= site_limit)
            last = F.element_at(F.array_sort("held"), site_limit)
            full = held.select("network_id", *KEYS, last["round"].alias("c_round"), last["turn"].alias("c_turn"), last["kinase"].alias("c_kinase"))
        found = materialize(_walk(listed.join(full, ["network_id", *KEYS], "left"), quota, width, seed), "asked")
        same = asked is not None and found.count() == asked.count() and not found.join(asked, found.columns, "left_anti").take(1)
        asked = found
        if same and not asked.where("short").take(1):
            return asked.select("network_id", "kinase", *KEYS)
        if same:
            width, listed = 2 * width, None


def prune(long: DataFrame, compendia: DataFrame | None, networks: int, kinase_size: int, site_limit: int, seed: int = 1, done: DataFrame | None = None) -> DataFrame:
    """(network_id, kinase, accession, site) of `networks` pruned networks.

    With compendia, each number of compendia is pruned apart with its part of the kinase size; the
    strata share no site, so their capacities are apart as well. All networks are settled together, and
    each only depends on the seed and its number. Networks in `done` are left out, which restarts an interrupted build.
    """
    if compendia is None:
        edges = long.withColumn("stratum", F.lit(0))
    else:
        edges = long.join(unique_compendia(compendia).select(*KEYS, F.col("num_compendia").cast("int").alias("stratum")), KEYS, "left")
    # written before it is multiplied by networks: it is counted and summed up first
    edges = materialize(edges, "edges")
    check_size(edges, kinase_size, site_limit)
    edges = edges.where("stratum is not null")
    if compendia is None:
        quota = {0: kinase_size}
    else:
        # one row for each number of compendia
        histogram = {r[0]: r[1] for r in edges.select("stratum", *KEYS).distinct().groupBy("stratum").count().collect()}
        quota = compendia_quota(dict(sorted(histogram.items())), kinase_size)
    ids = long.sparkSession.range(networks).select(F.col("id").cast("int").alias("network_id"))
    if done is not None:
        ids = ids.join(done.select("network_id").distinct(), "network_id", "left_anti")
    chosen = F.explode(F.array(*[F.lit(r[0]) for r in ids.collect()]).cast("array<int>"))
    masses = materialize(_masses(edges, ["stratum", "kinase"]), "masses")
    rows = edges.join(F.broadcast(masses.drop("size")), ["stratum", "kinase"]).withColumn("network_id", chosen)
    return settle(rows, quota, site_limit, seed, lists=masses.withColumn("network_id", chosen))


def network_hash(networks: DataFrame) -> DataFrame:
    """(network_id, hash): the same for the same edges in any order.

    Edges are digested in 4,096 buckets by the first digits of their own digest and the buckets'
    digests in one row, so no row holds a network.
    """
    edge = F.sha2(F.concat_ws("|", "kinase", *KEYS), 256)
    digest = lambda rows: F.sha2(F.array_join(F.array_sort(F.collect_list(rows)), ""), 256)
    buckets = networks.withColumn("e", edge).groupBy("network_id", F.substring("e", 1, 3).alias("b")).agg(digest("e").alias("e"))
    return buckets.groupBy("network_id").agg(digest(F.concat("b", "e")).alias("hash"))


def available_kinases(networks: DataFrame) -> DataFrame:
    return networks.select("kinase").distinct().orderBy("kinase")


def add_networks(*parts: DataFrame) -> DataFrame:
    """One table of networks, each under its own id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def substrates(networks: DataFrame) -> DataFrame:
    """Distinct sites over all networks."""
    return networks.agg(F.count_distinct(*KEYS).alias("substrates"))


def mean_substrates(networks: DataFrame) -> DataFrame:
    """(phospho_type, substrates): mean over networks of distinct sites; other residues count for no type."""
    kind = F.when(F.substring("site", 1, 1) == "Y", "Y").when(F.substring("site", 1, 1).isin("S", "T"), "ST")
    each = networks.select("network_id", *KEYS, kind.alias("phospho_type")).where("phospho_type is not null").distinct().groupBy("network_id", "phospho_type").agg(F.count("*").alias("n"))
    return each.groupBy("phospho_type").agg(F.avg("n").alias("substrates"))


def study_bias(sites: DataFrame, compendia: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, num_compendia, sites): how well studied the sites of the proteome, an experiment or its samples are."""
    if compendia is not None:
        sites = sites.select(*(by or []), *KEYS).distinct().join(unique_compendia(compendia), KEYS)
    return sites.groupBy(*(by or []), *KEYS).agg(F.avg("num_compendia").alias("num_compendia")).groupBy(*(by or []), "num_compendia").agg(F.count("*").alias("sites"))


def coverage(sites: DataFrame, networks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, coverage): share of distinct sites that some network has."""
    inside = networks.select(*KEYS).distinct().withColumn("hit", F.lit(1))
    rows = sites.select(*(by or []), *KEYS).distinct().join(inside, KEYS, "left")
    return rows.groupBy(*(by or [])).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("coverage"))


def influence(networks: DataFrame, kinase: str, subset: DataFrame | None = None) -> DataFrame:
    """(accession, site, networks): in how many networks each site is the kinase's substrate."""
    rows = networks.where(F.col("kinase") == kinase)
    if subset is not None:
        rows = rows.join(subset.select(*KEYS).distinct(), KEYS, "left_semi")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("networks")).orderBy(F.desc("networks"), *KEYS)


def influence_by_sample(networks: DataFrame, evidence: DataFrame, kinase: str) -> DataFrame:
    counts = influence(networks, kinase)
    return evidence.select("sample", *KEYS).distinct().join(counts, KEYS).select("sample", *KEYS, "networks")


def shared_substrates(networks: DataFrame) -> DataFrame:
    """(first, second, shared, jaccard) of kinases, averaged over the networks that have both."""
    rows = networks.select("network_id", "kinase", *KEYS).distinct()
    size = rows.groupBy("network_id", "kinase").agg(F.count("*").alias("n"))
    pairs = rows.withColumnRenamed("kinase", "first").join(rows.withColumnRenamed("kinase", "second"), ["network_id", *KEYS]).where("first <= second")
    shared = pairs.groupBy("network_id", "first", "second").agg(F.count("*").alias("shared"))
    a, b = size.select("network_id", F.col("kinase").alias("first"), F.col("n").alias("na")), size.select("network_id", F.col("kinase").alias("second"), F.col("n").alias("nb"))
    both = a.join(b, "network_id").where("first <= second").join(shared, ["network_id", "first", "second"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    each = both.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return each.groupBy("first", "second").agg(F.avg("shared").alias("shared"), F.avg("jaccard").alias("jaccard"))


def profile(networks: DataFrame) -> DataFrame:
    """(network_id, edges, kinases, largest, fullest): edges of a network, of its largest kinase and of its fullest site."""
    per = lambda *by: F.count("*").over(Window.partitionBy("network_id", *by))
    rows = networks.withColumns({"_k": per("kinase"), "_s": per(*KEYS)})
    return rows.groupBy("network_id").agg(F.count("*").alias("edges"), F.count_distinct("kinase").alias("kinases"), F.max("_k").alias("largest"), F.max("_s").alias("fullest"))


def phosphoproteome(records: DataFrame, compendia_ids: DataFrame) -> DataFrame:
    """(accession, site, num_compendia, compendia_class) from records (accession, site, evidence list) and the ids that are compendia."""
    seen = records.select(*KEYS, F.explode_outer(F.split("evidence", ";")).alias("id")).withColumn("id", F.trim("id"))
    hits = seen.join(compendia_ids.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    counts = hits.groupBy(*KEYS).agg(F.count_distinct(F.when(F.col("hit") == 1, F.col("id"))).alias("num_compendia"))
    return counts.withColumn("compendia_class", compendia_class(F.col("num_compendia")))


def rank_positions(rows: DataFrame, column: str) -> DataFrame:
    """(value, position): places 5, 15, 25, ... of a column's distinct values on an axis."""
    return numbered(rows.select(column).distinct(), "position", column).withColumn("position", (F.col("position") - 1) * 10 + 5)
