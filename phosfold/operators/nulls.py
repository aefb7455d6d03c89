"""Random experiments that match a sample's study bias, drawn by hash order, and where to find stored ones.

A draw takes the sites of a class whose hash keys are smallest. So a whole experiment is one cutoff
for each class, and whether a site is in it follows from the site's own key: what needs the sites of
experiments joins a small table of cutoffs and never moves the experiments themselves.
"""

from __future__ import annotations

import math

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import materialize
from .evidence import KEYS, unique_compendia

#: Keys are products of two linear forms modulo this prime.
PRIME = (1 << 31) - 1
#: Draws of one pass, and counts (groups x draws) that a task holds: more draws take more passes.
DRAWS, COUNTS = 1 << 14, 1 << 23
#: Sites of a class that a task looks at together, and places (sites x draws) it marks at once.
SITES, PLACES = 1 << 15, 1 << 25
#: A draw of at most so many sites of a class is found with its sites, a larger one by its cutoff first.
FEW = 1 << 12
#: Standard deviations on either side of the expected cutoff that are looked through first.
NEAR = 8
DRAW = ["sample", "rep", "stratum"]


def numbers(of: Column, many: int) -> Column:
    """`many` (at most 4) numbers of 28 bits from a digest of a text."""
    digest = F.md5(of)
    return F.array(*[F.conv(F.substring(digest, 1 + 7 * k, 7), 16, 10).cast("long") for k in range(many)])


def _fold(w: np.ndarray, t: np.ndarray) -> None:
    """A smaller number with the same rest by PRIME, in place."""
    np.right_shift(w, 31, out=t)
    np.bitwise_and(w, PRIME, out=w)
    np.add(w, t, out=w)


def draw_keys(x: np.ndarray, y: np.ndarray, draws: np.ndarray):
    """The keys of sites (two numbers each) in each draw (four numbers): small keys are taken first. An array stands until the next one."""
    x, y = x.astype(np.uint64), y.astype(np.uint64)
    u, v, t = (np.empty(x.size, np.uint64) for _ in range(3))
    for a, b, c, d in draws.astype(np.uint64):
        for w, site, times, plus in ((u, x, a, b), (v, y, c, d)):
            np.multiply(site, times, out=w)
            np.add(w, plus, out=w)
            _fold(w, t)
        np.multiply(u, v, out=u)
        _fold(u, t)
        _fold(u, t)
        if u.size and u.max() >= PRIME:  # by now it is at most PRIME + 2
            u[u >= PRIME] -= np.uint64(PRIME)
        yield u


def _sites(compendia: DataFrame, stratum: str) -> DataFrame:
    rows = unique_compendia(spread(compendia.select(*KEYS, "num_compendia"))).select(*KEYS, F.col(stratum).alias("stratum")).where("stratum is not null")
    return rows.withColumn("xy", numbers(F.concat_ws("|", *KEYS), 2)).select(*KEYS, "stratum", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` dealt by site over all shuffle partitions: each of them is work for all draws, however small it is."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS)


def _passes(rows: DataFrame, draws: int = DRAWS) -> list[DataFrame]:
    """`rows` (sample, rep, ...) cut by samples into parts of at most `draws` draws, or one sample: small enough to be broadcast."""
    many = {r[0]: r[1] for r in rows.groupBy("sample").agg(F.count_distinct("rep")).collect()}
    parts, held = [], 0
    for sample in sorted(many):
        if not parts or held + many[sample] > draws:
            parts.append([])
            held = 0
        parts[-1].append(sample)
        held += many[sample]
    return [rows.where(F.col("sample").isin(p)) for p in parts]


def _gathered(stream, most: int = SITES):
    """Arrow batches put together to tables of at least `most` rows, but for the last one."""
    held, rows = [], 0
    for batch in stream:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _by_class(table: pa.Table, of: dict[object, np.ndarray]):
    """(draws, rows, names, x, y) for each class that has draws: names are those of all rows, x and y those of the class."""
    coded = table["stratum"].chunk(0).dictionary_encode()
    codes, x, y = coded.indices.to_numpy(zero_copy_only=False), table["x"].to_numpy(), table["y"].to_numpy()
    for code, s in enumerate(coded.dictionary.to_pylist()):
        if s in of:
            rows = np.flatnonzero(codes == code)
            yield of[s], rows, (table["accession"].chunk(0), table["site"].chunk(0)), x[rows], y[rows]


def _places(strata: list) -> dict[object, np.ndarray]:
    of: dict[object, list[int]] = {}
    for row, s in enumerate(strata):
        of.setdefault(s, []).append(row)
    return {s: np.array(rows) for s, rows in of.items()}


def _four(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(-1, 4)


def _picked(sites: DataFrame, wanted: pa.Table, stratum, near: float, members: bool) -> DataFrame:
    """(sample, rep, stratum, draw, cut), or (sample, rep, stratum, accession, site) of `members`, of the draws whose cutoff lies near the expected one.

    Each site's key is reckoned once for each draw of its class. Tasks count the keys below the range and hand on the
    sites inside, which meet by draws: some multiple of the square root of the draw's sites, and for `members` all of them.
    """
    quota, size = (wanted[c].to_numpy().astype(np.float64) for c in ("quota", "size"))
    apart = near * np.sqrt(quota) + 2 * near
    low, high = (np.clip(np.ceil((quota + side) / size * PRIME), 0, PRIME).astype(np.uint64) for side in (-apart, apart))
    if members:
        low[:] = 0
    named = list(zip(*(wanted[c].to_pylist() for c in (*DRAW, "draw", "quota"))))
    scanned = sites.sparkSession.sparkContext.broadcast((_places(wanted["stratum"].to_pylist()), _four(wanted["draw"]), low, high))
    shared = sites.sparkSession.sparkContext.broadcast(named)

    def scan(stream):
        of, four, low, high = scanned.value
        schema = pa.schema([("draw", pa.int32()), ("below", pa.int64()), ("keys", pa.list_(pa.int64())), ("accessions", pa.list_(pa.string())), ("sites", pa.list_(pa.string()))])

        def batch(names, draws, below, keys, found):
            offsets, at = pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found))
            lists = [pa.ListArray.from_arrays(offsets, c) for c in (pa.array(np.concatenate(keys).astype(np.int64)), *(n.take(at) for n in names))]
            return pa.RecordBatch.from_arrays([pa.array(draws, pa.int32()), pa.array(below, pa.int64()), *lists], schema=schema)

        for table in _gathered(stream, 2 * SITES):
            for draws, rows, names, x, y in _by_class(table, of):
                held, many = [], 0
                for draw, k in zip(draws.tolist(), draw_keys(x, y, four[draws])):
                    below = np.count_nonzero(k < low[draw]) if low[draw] else 0
                    inside = np.flatnonzero((k >= low[draw]) & (k < high[draw]))
                    if below or inside.size:
                        held.append((draw, below, k[inside], rows[inside]))
                        many += inside.size
                    if many > 1 << 20:
                        yield batch(names, *zip(*held))
                        held, many = [], 0
                if held:
                    yield batch(names, *zip(*held))

    kind = stratum.simpleString()
    out = f"sample string, rep int, stratum {kind}, " + ("accession string, site string" if members else "draw array<bigint>, cut struct<key: bigint, accession: string, site: string>")

    def pick(table):
        sample, rep, s, four, quota = shared.value[table["draw"][0].as_py()]
        keys = table["keys"].combine_chunks().flatten().to_numpy()
        names = [table[c].combine_chunks().flatten() for c in ("accessions", "sites")]
        place = quota - sum(table["below"].to_pylist())
        found = []
        if 1 <= place <= keys.size:
            key = int(np.partition(keys, place - 1)[place - 1])
            less, same = np.flatnonzero(keys < key), np.flatnonzero(keys == key)
            equal = sorted(zip(*(n.take(pa.array(same)).to_pylist() for n in names)))[: place - less.size]
            if members:
                found = [(sample, rep, s, *name) for name in (*zip(*(n.take(pa.array(less)).to_pylist() for n in names)), *equal)]
            else:
                found = [(sample, rep, s, four, {"key": key, "accession": equal[-1][0], "site": equal[-1][1]})]
        columns = list(zip(*found)) or [()] * len(shape)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    names = [("accession", pa.string()), ("site", pa.string())]
    rest = names if members else [("draw", pa.list_(pa.int64())), ("cut", pa.struct([("key", pa.int64()), *names]))]
    shape = pa.schema([("sample", pa.string()), ("rep", pa.int32()), ("stratum", wanted.schema.field("stratum").type), *rest])
    between = sites.mapInArrow(scan, "draw int, below bigint, keys array<bigint>, accessions array<string>, sites array<string>")
    return between.groupBy("draw").applyInArrow(pick, out)


def _wanted(sites: DataFrame, quotas: DataFrame, reps: int, seed: int) -> DataFrame:
    """(sample, rep, stratum, quota, size, draw): each class of each draw, its size, and the draw's numbers."""
    sizes = sites.groupBy("stratum").agg(F.count("*").alias("size"))
    wanted = quotas.where("quota > 0").join(sizes, "stratum").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draw = numbers(F.concat_ws("|", F.lit(str(seed)), "sample", F.col("rep").cast("string")), 4)
    return materialize(wanted.select(*DRAW, "quota", "size", draw.alias("draw")), "wanted")


def _found(sites: DataFrame, wanted: DataFrame, members: bool = False) -> DataFrame:
    """Cutoffs, or members, of all draws of `wanted`, which take fewer sites than their classes have; draws that the first range misses get wider ones."""
    found, near = [], NEAR
    while wanted.take(1):
        parts = [_picked(sites, p.toArrow(), wanted.schema["stratum"].dataType, near, members) for p in _passes(wanted)]
        found.append(materialize(reduce(DataFrame.unionByName, parts), "drawn"))
        wanted = wanted.join(found[-1].select(*DRAW).distinct(), DRAW, "left_anti")
        near *= 8
    if found:
        return reduce(DataFrame.unionByName, found)
    rest = "accession string, site string" if members else "draw array<bigint>, cut struct<key: bigint, accession: string, site: string>"
    return sites.sparkSession.createDataFrame([], f"sample string, rep int, stratum {wanted.schema['stratum'].dataType.simpleString()}, {rest}")


def _cutoffs(sites: DataFrame, wanted: DataFrame) -> DataFrame:
    every = wanted.where("quota >= size").select(*DRAW, "draw", F.struct(F.lit(PRIME).cast("long").alias("key"), F.lit("").alias("accession"), F.lit("").alias("site")).alias("cut"))
    return _found(sites, wanted.where("quota < size")).unionByName(every)


def cutoffs(compendia: DataFrame, quotas: DataFrame, reps: int, seed: int, stratum: str = "compendia_class") -> DataFrame:
    """(sample, rep, stratum, draw, cut): the last site that each draw takes, by (key, accession, site).

    `quotas` has (sample, stratum, quota); exactly `quota` sites of each class are drawn without
    replacement, or all if there are fewer. Only keys near the expected cutoff are ranked: eight standard
    deviations on either side and some more; for a draw whose cutoff should lie elsewhere, more of them.
    """
    sites = materialize(_sites(compendia, stratum), "sites")
    return materialize(_cutoffs(sites, _wanted(sites, quotas, reps, seed)), "cutoffs")


def _cut(cuts: pa.Table) -> tuple[dict[object, np.ndarray], np.ndarray, np.ndarray, list[tuple[str, str]]]:
    """Draws of each class, and each draw's numbers, last key and last site."""
    last = cuts["cut"].to_pylist()
    return _places(cuts["stratum"].to_pylist()), _four(cuts["draw"]), np.array([c["key"] for c in last], np.uint64), [(c["accession"], c["site"]) for c in last]


def _taken(table: pa.Table, cut):
    """(draws, rows, taken): of some rows of a class, which of the class's draws (in columns) take them."""
    of, four, key, last = cut
    for draws, rows, (accession, site), x, y in _by_class(table, of):
        step = max(256, min(SITES, PLACES // len(draws)))
        for k in range(0, len(rows), step):
            some, taken = rows[k : k + step], np.empty((len(draws), len(rows[k : k + step])), bool)
            for n, (draw, mine) in enumerate(zip(draws.tolist(), draw_keys(x[k : k + step], y[k : k + step], four[draws]))):
                np.less(mine, key[draw], out=taken[n])
                for i in np.flatnonzero(mine == key[draw]).tolist():  # equal keys go by name
                    taken[n, i] = (accession[some[i]].as_py(), site[some[i]].as_py()) <= last[draw]
            yield draws, some, np.ascontiguousarray(taken.T)


def _replicates(sites: DataFrame, cuts: DataFrame) -> DataFrame:
    """(sample, accession, site, reps): the replicates of each sample that take a site, in ascending order."""
    out, parts = "sample string, accession string, site string, reps array<int>", []
    for part in _passes(cuts):
        table = part.select("sample", "rep", "stratum", "draw", "cut").toArrow().sort_by([("sample", "ascending"), ("rep", "ascending")])
        names = table["sample"].combine_chunks().dictionary_encode()
        shared = sites.sparkSession.sparkContext.broadcast((_cut(table), names.dictionary.to_pylist(), names.indices.to_numpy(), table["rep"].to_numpy()))

        def run(stream, shared=shared):
            cut, names, sample, rep = shared.value
            names = pa.array(names, pa.string())
            for table in _gathered(stream):
                for draws, rows, taken in _taken(table, cut):
                    at, draw = np.divmod(np.flatnonzero(taken), len(draws))
                    of = sample[draws][draw]
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(of) != 0)])) if at.size else np.zeros(0, np.int64)
                    reps = pa.ListArray.from_arrays(pa.array(np.append(first, at.size), pa.int32()), pa.array(rep[draws][draw], pa.int32()))
                    row = pa.array(rows[at[first]])
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of[first])), table["accession"].chunk(0).take(row), table["site"].chunk(0).take(row), reps], names=["sample", *KEYS, "reps"])

        parts.append(sites.mapInArrow(run, out))
    return reduce(DataFrame.unionByName, parts) if parts else sites.sparkSession.createDataFrame([], out)


def overlaps(held: DataFrame, compendia: DataFrame, cuts: DataFrame, stratum: str = "compendia_class", draws: int = DRAWS) -> DataFrame:
    """(network_id, sample, rep, kinase, k) from `held` (network_id, accession, site, kinases): how many sites of each kinase a draw takes; kinase null counts the sites themselves.

    The networks of a site stand in one row, which a task marks with the draws that take it and adds to its counts; it hands
    on one count for each network, kinase and draw, so what is shuffled behind does not depend on the number of sites.
    There is a pass for some samples' draws, as many as their counts' memory allows.
    """
    spark = held.sparkSession
    groups = held.select("network_id", F.explode("kinases")).distinct().count() + held.select("network_id").distinct().count()
    in_networks = held.groupBy(*KEYS).agg(F.collect_list(F.struct(F.col("network_id").cast("int").alias("network_id"), "kinases")).alias("networks"))
    rows, found = in_networks.join(_sites(compendia, stratum), KEYS), []
    passes = _passes(cuts, max(1, min(draws, COUNTS // max(1, groups))))
    if len(passes) > 1:
        rows = materialize(rows, "sites")
    for part in passes:
        table = part.select("sample", "rep", "stratum", "draw", "cut").toArrow()
        names = sorted(set(zip(table["sample"].to_pylist(), table["rep"].to_pylist())))
        place = {d: n for n, d in enumerate(names)}
        at = np.array([place[d] for d in zip(table["sample"].to_pylist(), table["rep"].to_pylist())], np.int64)
        shared = spark.sparkContext.broadcast((_cut(table), at, names))

        def run(stream, shared=shared):
            cut, at, names = shared.value
            numbers: dict[tuple[int, str | None], int] = {}
            sums = np.zeros((0, len(names)), np.int64)
            for table in _gathered(stream):
                row, group = _members(table["networks"].chunk(0), numbers)
                if len(numbers) > len(sums):
                    sums = np.concatenate([sums, np.zeros((max(64, 2 * len(numbers)) - len(sums), len(names)), np.int64)])
                order = np.argsort(row, kind="stable")
                row, group = row[order], group[order]
                for draws, rows, taken in _taken(table, cut):
                    # the places of these rows among the members, one after another
                    start, end = np.searchsorted(row, rows), np.searchsorted(row, rows, side="right")
                    many = end - start
                    local = np.repeat(np.arange(len(rows)), many)
                    of = group[np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    order = np.argsort(of, kind="stable")
                    local, of, step = local[order], of[order], max(1, PLACES // len(draws))
                    for k in range(0, len(of), step):
                        g = of[k : k + step]
                        first = np.flatnonzero(np.concatenate([[True], np.diff(g) != 0]))
                        # runs of at most 255 rows, whose sums a byte holds
                        ends = np.append(first[1:], len(g))
                        first = np.concatenate([np.arange(a, b, 255) for a, b in zip(first, ends)])
                        part = np.add.reduceat(taken.view(np.uint8)[local[k : k + step]], first, axis=0, dtype=np.uint8)
                        whole = np.flatnonzero(np.concatenate([[True], np.diff(g[first]) != 0]))
                        sums[g[first[whole]][:, None], at[draws]] += np.add.reduceat(part, whole, axis=0, dtype=np.int64)
            # one group at a time: its counts that are not zero
            for (n, kinase), g in numbers.items():
                some = np.flatnonzero(sums[g])
                if some.size:
                    sample, rep = zip(*(names[i] for i in some.tolist()))
                    yield pa.RecordBatch.from_arrays([pa.array([n] * some.size, pa.int32()), pa.array(sample), pa.array(rep, pa.int32()), pa.array([kinase] * some.size, pa.string()), pa.array(sums[g][some])], names=["network_id", "sample", "rep", "kinase", "k"])

        found.append(rows.mapInArrow(run, "network_id int, sample string, rep int, kinase string, k long"))
    if not found:
        return spark.createDataFrame([], "network_id int, sample string, rep int, kinase string, k long")
    return reduce(DataFrame.unionByName, found).groupBy("network_id", "sample", "rep", "kinase").agg(F.sum("k").alias("k"))


def _members(networks: pa.ListArray, numbers: dict[tuple[int, str | None], int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) of each kinase of each network of each row, and of each network itself, whose groups' numbers are kept in `numbers`."""
    inner = networks.flatten()
    network, kinases = inner.field("network_id").to_numpy(), inner.field("kinases")
    row = np.repeat(np.arange(len(networks)), np.asarray(networks.value_lengths()))
    edges = np.asarray(kinases.value_lengths())
    coded = kinases.flatten().dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    code = np.concatenate([coded.indices.to_numpy(zero_copy_only=False), np.full(len(network), len(names) - 1)])
    of = np.concatenate([np.repeat(network, edges), network]).astype(np.int64)
    pairs, back = np.unique(of * len(names) + code, return_inverse=True)
    known = np.array([numbers.setdefault((int(p // len(names)), names[int(p % len(names))]), len(numbers)) for p in pairs.tolist()], np.int64)
    return np.concatenate([np.repeat(row, edges), row]), known[back]


def _drawn(compendia: DataFrame, quotas: DataFrame, reps: int, seed: int, stratum: str) -> tuple[DataFrame, DataFrame]:
    """(sample, rep, accession, site) of draws of few sites, and (sample, accession, site, reps) of the others."""
    sites = materialize(_sites(compendia, stratum), "sites")
    wanted = _wanted(sites, quotas, reps, seed)
    few = (F.col("quota") <= FEW) & (F.col("quota") < F.col("size"))
    return _found(sites, wanted.where(few), members=True).drop("stratum"), _replicates(sites, _cutoffs(sites, wanted.where(~few)))


def draw(compendia: DataFrame, quotas: DataFrame, reps: int, seed: int, stratum: str = "compendia_class") -> DataFrame:
    """(sample, rep, accession, site): for each sample and replicate exactly `quota` sites of each stratum, without replacement."""
    few, many = _drawn(compendia, quotas, reps, seed, stratum)
    return few.select("sample", "rep", *KEYS).unionByName(many.select("sample", F.explode("reps").alias("rep"), *KEYS))


def replicates(compendia: DataFrame, quotas: DataFrame, reps: int, seed: int, stratum: str = "compendia_class") -> DataFrame:
    """(sample, accession, site, reps): the same, with a site's replicates in ascending order."""
    few, many = _drawn(compendia, quotas, reps, seed, stratum)
    return few.groupBy("sample", *KEYS).agg(F.array_sort(F.collect_list("rep")).alias("reps")).unionByName(many)


def wide_experiments(drawn: DataFrame, names: list[str]) -> DataFrame:
    """One column `sample:rep` with 1 for each drawn site."""
    rows = drawn.select(*KEYS, F.concat_ws(":", "sample", F.col("rep").cast("string")).alias("experiment"), F.lit(1).alias("weight"))
    return rows.groupBy(*KEYS).pivot("experiment", names).agg(F.first("weight"))


def split_experiment(name: Column) -> tuple[Column, Column]:
    """Sample and replicate of `sample:rep`, by the last colon."""
    return F.regexp_extract(name, "^(.*):([0-9]+)$", 1), F.regexp_extract(name, "^(.*):([0-9]+)$", 2).try_cast("int")


def ladder(least: int, most: int, fraction: float = 0.25) -> list[int]:
    """Sizes for stored experiments, each a step above the middle between two."""
    sizes, size = [], least
    while size < most:
        size += int(size * fraction)
        sizes.append(size)
        size += int(size * fraction)
    return sizes


def quotas(size: int, shares: list[float]) -> list[int]:
    """Sites of each class: the shares if they sum up to the size, else the size's part of them, cut to whole sites."""
    total = sum(shares)
    if total == size:
        return [int(s) for s in shares]
    if abs(total - 1) < 1e-9:
        return [int(size * s) for s in shares]
    return [int(size * s / total) for s in shares]


def mix(phospho_type: Column, high_share: Column) -> Column:
    """The class mix of stored experiments that suits a sample; the share is cut to a whole number first."""
    return F.when(phospho_type == "ST", "0_30_70").when(F.floor(high_share) > 60, "0_30_70").otherwise("0_50_50")


def nearest_size(sample_sizes: DataFrame, stored: DataFrame | list[int], most_apart: float = 0.25, least: int = 50) -> DataFrame:
    """(sample, size, matched): the stored size nearest to the sample's, the smaller of two, null if none is near enough or the sample is small.

    Sizes are filed by their logarithm in steps as wide as the tolerance, so a size meets only the stored ones of its own
    step and the two beside it, in one keyed join of distinct sizes.
    """
    if isinstance(stored, list):
        stored = sample_sizes.sparkSession.createDataFrame([(s,) for s in stored], "size int")
    step = lambda c: F.floor(F.ln(c) / -math.log1p(-most_apart))
    near = stored.select(F.col("size").alias("_s")).where("_s > 0").distinct().withColumn("_step", F.explode(F.sequence(step("_s") - 1, step("_s") + 1)))
    apart = F.abs(F.col("_s") - F.col("size"))
    sizes = sample_sizes.select("size").where(F.col("size") >= F.greatest(F.lit(least), F.lit(1))).distinct().withColumn("_step", step("size"))
    found = sizes.join(near, "_step").where(apart / F.col("size") < most_apart).groupBy("size").agg(F.min(F.struct(apart.alias("d"), F.col("_s").alias("s")))["s"].alias("matched"))
    return sample_sizes.select("sample", "size").join(found, "size", "left").select("sample", "size", "matched")


def route(sample_sizes: DataFrame, shares: DataFrame, stored: DataFrame | list[int], phospho_type: str, **more) -> DataFrame:
    """(sample, source, matched, mix): whether a sample's null comes from storage or has to be drawn."""
    rows = nearest_size(sample_sizes, stored, **more).join(shares.select("sample", "class_2"), "sample")
    source = F.when(F.col("matched").isNotNull(), "stored").otherwise("drawn")
    return rows.select("sample", source.alias("source"), "matched", mix(F.lit(phospho_type), F.col("class_2")).alias("mix"))


def stored_quotas(sizes: list[int], shares: dict[str, list[float]], spark) -> DataFrame:
    """(mix, size, sample, stratum, quota) for all sizes and mixes to be stored; a sample stands for a mix and size."""
    rows = [(m, s, f"{m}/{s}", k, q) for m, f in shares.items() for s in sizes for k, q in enumerate(quotas(s, f))]
    return spark.createDataFrame(rows, "mix string, size int, sample string, stratum int, quota int")


def use_stored(route: DataFrame, stored: DataFrame) -> DataFrame:
    """(network_id, kinase, sample, rep, frequency, p) of the samples that `route` sends to storage: the stored replicates of their mix and size."""
    sent = route.where("source = 'stored'").select("sample", "mix", F.col("matched").alias("size"))
    return stored.drop("sample").join(sent, ["mix", "size"]).select("network_id", "kinase", "sample", "rep", "frequency", "p")


def merge(*parts: DataFrame) -> DataFrame:
    """Stored experiments of several folders or runs; of a mix and size that stand in more than one the first part counts."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(missing(part, out))
    return out


def missing(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """What is still to be stored."""
    return wanted.join(done.select("mix", "size").distinct(), ["mix", "size"], "left_anti")
