"""Operators against plain versions and hand-worked cases."""

import hashlib
import itertools
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phosfold.operators import enrichment, evidence, mapping, networks, nulls, presentation, significance, thresholds
from phosfold.params import Params, as_bool, prefixed, renamed
from phosfold.functions.stats import EXACT_UP_TO
from phosfold.sources.store import NetworkStore
from phosfold.plans.pipeline import analyse, build_networks, pregenerate
from phosfold.sources import readers, writers
from phosfold.streaming.evidence import drain, merged_evidence, running_counts, windowed_evidence

RAW = "sample string, accession string, site string, value double"


def test_missing_values(spark):
    wide = spark.createDataFrame([("P1", "S1", 1.0, float("nan")), ("P2", "T2", 0.5, 2.0)], "accession string, site string, `data:a` double, `data:b` double")
    long = evidence.long_form(wide, prefixed(wide.columns))
    assert long.where("value is null").count() == 1
    rows = spark.createDataFrame([("a", "P1", "S1", 1.0), ("a", "P2", "S2", None), ("a", "P3", "S3", 0.5)], RAW)
    flag = lambda greater: [r.flag for r in evidence.flags(rows, 1.0, greater).orderBy("accession").collect()]
    assert flag(True) == [1, 0, 0] and flag(False) == [1, 0, 1]
    assert evidence.collapse(spark.createDataFrame([("a", None, "S1", 1.0)], RAW)).count() == 0


def test_top_n(spark):
    rows = spark.createDataFrame([("a", f"P{i}", "S1", v) for i, v in enumerate([3.0, None, 1.0, 2.0])], RAW)
    assert {r.accession for r in evidence.by_rank(rows, 2).collect()} == {"P0", "P3"}
    assert evidence.by_rank(rows, 9).count() == 3
    assert {r.accession for r in evidence.by_rank(rows, 1, greater=False).collect()} == {"P2"}
    with pytest.raises(ValueError):
        evidence.require(evidence.valid_samples(rows, [99.0]))


def test_jaccard(spark):
    rows = spark.createDataFrame([("a", "P1", "S1"), ("a", "P2", "S1"), ("b", "P1", "S1"), ("b", "P3", "S1")], "sample string, accession string, site string")
    assert thresholds.jaccard(rows).first().jaccard == pytest.approx(1 / 3)
    assert thresholds.grid(0.0, 0.5, 0.1) == [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]


def test_ladder_and_quota():
    assert nulls.ladder(50, 1000) == [62, 96, 150, 233, 363, 566, 883]
    assert nulls.ladder(500, 20000) == [625, 976, 1525, 2382, 3721, 5813, 9082, 14190, 22171]
    assert nulls.quotas(62, [0, 30, 70]) == [0, 18, 43]
    assert networks.compendia_quota({0: 50, 1: 30, 2: 20}, 10) == {0: 5, 1: 3, 2: 2}
    assert networks.compendia_quota({0: 50, 1: 30, 2: 20}, 11) == {0: 6, 1: 3, 2: 2}
    assert networks.compendia_quota({}, 5) == {}


def test_classes(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 3, 4)], "n int")
    assert [r[0] for r in rows.select(evidence.compendia_class(F.col("n"))).collect()] == [0, 1, 1, 2]


def test_false_positive_rate(spark):
    stats = spark.createDataFrame([("a", "K", p) for p in (0.1, 0.2, 0.2, 0.5)], "sample string, kinase string, mw_p double")
    for p, fpr in ((0.2, 0.75), (0.9, 1.0), (0.05, 0.0)):
        found = spark.createDataFrame([("a", "K", p)], "sample string, kinase string, mw_p double")
        assert significance.false_positive_rate(found, stats).first().fpr == fpr
    nobody = spark.createDataFrame([("b", "K", 0.1)], "sample string, kinase string, mw_p double")
    assert significance.false_positive_rate(nobody, stats).first().fpr == 1.0
    many = spark.createDataFrame([("a", "K", i / 20) for i in range(20)], "sample string, kinase string, p double")
    assert significance.alpha_quantile(many, 0.05).first().factor == 0.05


def test_mann_whitney_against_pairs(spark):
    rng = random.Random(3)
    values = {u: [rng.randint(0, 6) / 7 for _ in range(rng.randint(2, 6))] for u in range(4)}
    rows = spark.createDataFrame([("s", "k", u, p) for u, ps in values.items() for p in ps], "sample string, kinase string, rep int, p double")
    for r in significance.null_statistics(rows).collect():
        rest = [p for u, ps in values.items() if u != r.rep for p in ps]
        assert r.u == sum((a < b) + 0.5 * (a == b) for a, b in itertools.product(values[r.rep], rest))
    flat = spark.createDataFrame([("s", "k", u, 0.5) for u in range(3)], "sample string, kinase string, rep int, p double")
    assert {(r.z, r.mw_p) for r in significance.null_statistics(flat).collect()} == {(None, 1.0)}


def test_mann_whitney_of_few_values_is_exact(spark):
    rng = random.Random(4)
    for n, rest in ((1, 1), (1, 4), (3, 5), (5, 3), (4, 4), (EXACT_UP_TO, 3)):
        values = [i / 100 for i in rng.sample(range(100), n + rest)]
        rows = [("s", "k", 1 if i < n else 0, p) for i, p in enumerate(values)]
        found = significance.statistics(significance.rank_sums(spark.createDataFrame(rows, "sample string, kinase string, unit int, p double"), "unit"))
        r = found.where("unit = 1").first()
        wins = [sum(a < b for a in s for b in set(values) - set(s)) for s in map(set, itertools.combinations(values, n))]
        assert r.mw_p == pytest.approx(sum(w >= r.u for w in wins) / len(wins), abs=1e-12)
    # equal values, or more than a few on both sides: the normal tail
    for values in ([0.5] * 3 + [0.25] * 4, [i / 50 for i in range(20)]):
        rows = spark.createDataFrame([("s", "k", i % 2, p) for i, p in enumerate(values)], "sample string, kinase string, unit int, p double")
        for r in significance.statistics(significance.rank_sums(rows, "unit")).collect():
            assert r.mw_p == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, abs=1e-12)


def test_draws(spark):
    sites = spark.createDataFrame([(f"P{i}", "S1", i % 6) for i in range(60)], "accession string, site string, num_compendia int")
    quota = spark.createDataFrame([("a", 0, 4), ("a", 1, 7), ("a", 2, 5)], "sample string, stratum int, quota long")
    drawn = nulls.draw(sites, quota, 5, 1)
    counts = evidence.with_compendia(drawn, sites).groupBy("rep", "compendia_class").count().collect()
    assert {(r.rep, r.compendia_class): r["count"] for r in counts} == {(i, c): n for i in range(5) for c, n in ((0, 4), (1, 7), (2, 5))}
    assert drawn.distinct().count() == drawn.count() == 80
    again = nulls.draw(sites.repartition(7), quota, 5, 1)
    assert set(map(tuple, drawn.collect())) == set(map(tuple, again.collect()))
    assert set(map(tuple, nulls.draw(sites, quota, 5, 2).collect())) != set(map(tuple, drawn.collect()))
    wide = nulls.wide_experiments(drawn, ["a:0", "a:1"])
    assert wide.where("`a:0` = 1").count() == 16


def test_pruning(spark):
    rng = random.Random(1)
    edges = [(f"P{i}", "S1", f"K{k}", rng.random() - 0.05) for i in range(80) for k in range(4)]
    wide = spark.createDataFrame(edges, "accession string, site string, kinase string, weight double").groupBy("accession", "site").pivot("kinase").agg(F.first("weight")).withColumn("name", F.lit("x"))
    long = networks.weights(wide, "ST")
    assert networks.used_kinases(long) == ["K0", "K1", "K2", "K3"]
    sites = spark.createDataFrame([(f"P{i}", "S1", i % 4) for i in range(80)], "accession string, site string, num_compendia int")
    built = networks.prune(long, sites, 3, 20, 2)
    counts = built.groupBy("network_id", "kinase").count().collect()
    assert len(counts) == 12 and {r["count"] for r in counts} == {20}
    assert built.groupBy("network_id", "accession", "site").count().agg(F.max("count")).first()[0] <= 2
    assert built.distinct().count() == built.count()
    positive = long.select("kinase", "accession", "site")
    assert built.join(positive, ["kinase", "accession", "site"], "left_anti").count() == 0
    done = built.where("network_id < 2")
    assert {r[0] for r in networks.prune(long, sites, 3, 20, 2, done=done).select("network_id").distinct().collect()} == {2}
    with pytest.raises(ValueError):
        networks.prune(long, sites, 1, 1000, 2)
    with pytest.raises(ValueError):
        networks.weights(wide.union(wide.withColumn("K0", F.col("K0") + 1)), "ST")
    hashes = {r.network_id: r.hash for r in networks.network_hash(built).collect()}
    assert len(set(hashes.values())) == 3
    assert {r.network_id: r.hash for r in networks.network_hash(built.repartition(5, "site")).collect()} == hashes
    assert networks.network_hash(built.where("kinase <> 'K0' or network_id > 0")).where("network_id = 0").first().hash != hashes[0]


@pytest.mark.parametrize("sites, kinases, quota, limit, width", [(40, 6, {0: 9, 2: 5}, 2, 3), (60, 8, {0: 12}, 2, None), (12, 5, {0: 12}, 1, 2)])
def test_settled_edges_are_those_of_turns_one_after_another(spark, sites, kinases, quota, limit, width):
    rng = random.Random(sites)
    edges = [(n, s, f"K{k}", f"P{s}.{i}", "S1", rng.random() ** 4 + 1e-3) for n in (3, 8) for s in (0, 2) for i in range(sites) for k in range(kinases) if rng.random() < 0.8]
    rows = spark.createDataFrame(edges, "network_id int, stratum int, kinase string, accession string, site string, weight double")
    got = sorted((r.network_id, r.kinase, r.accession) for r in networks.settle(rows, quota, limit, 5, width).collect())
    lists, room, taken = {}, Counter(), []
    for r in networks.clocks(rows, 5).collect():
        lists.setdefault((r.network_id, r.stratum, r.kinase), []).append((r.clock, r.accession))
    for n, s in ((n, s) for n in (3, 8) for s in quota):
        queues = {k: sorted(v) for (a, b, k), v in lists.items() if (a, b) == (n, s)}
        for number in range(quota[s]):
            for k in sorted(queues, key=lambda k: (networks.turn(5, n, s, number, k), k)):
                while queues[k]:
                    site = queues[k].pop(0)[1]
                    if room[n, site] < limit:
                        room[n, site] += 1
                        taken.append((n, k, site))
                        break
    assert got == sorted(taken) and got


def test_building_networks(spark, tmp_path):
    rng = random.Random(2)
    weighted = spark.createDataFrame([(f"P{i}", "S1" if i % 5 else "Y1", f"K{k}", rng.random() + 0.01) for i in range(100) for k in range(3)], "accession string, site string, kinase string, weight double")
    comp = spark.createDataFrame([(f"P{i}", "S1" if i % 5 else "Y1", i % 4) for i in range(90)], "accession string, site string, num_compendia int")
    params = Params(reps=3)
    edge = lambda df: sorted((r.network_id, r.kinase, r.accession, r.site) for r in df.collect())
    for by_compendia in (True, False):
        folder = str(tmp_path / f"built{by_compendia}")
        store = NetworkStore(spark, folder)
        built = build_networks(weighted, comp, folder, params, 3, 12, 2, by_compendia, [20], {"30_30_40": [30, 30, 40]})
        assert edge(store.networks()) == edge(built) and built.where("site like 'Y%'").count() == 0
        assert built.join(comp, ["accession", "site"], "left_anti").count() == 0
        assert {r["count"] for r in built.groupBy("network_id", "kinase").count().collect()} <= {12, 13, 14, 15}
        assert built.groupBy("network_id", "accession", "site").count().agg(F.max("count")).first()[0] <= 2
        hashes = store.manifest("networks").select("network_id", "hash").collect()
        assert sorted(map(tuple, hashes)) == sorted(map(tuple, networks.network_hash(built).collect()))
    row = readers.run_information(spark, f"{folder}/information").first()
    assert (row.unique_id, row.networks, row.kinase_size, row.use_compendia) == (store.unique_id(), "3", "12", "False") and sum(row.compendia) == 90
    assert readers.same_network(readers.run_information(spark, f"{folder}/information"), store.unique_id())
    # a build that is broken off and taken up again, with more sizes and a write that was never committed
    mixes, again = {"30_30_40": [30, 30, 40], "0_50_50": [0, 50, 50]}, str(tmp_path / "again")
    build_networks(weighted, comp, again, params, 2, 12, 2, False, [20], {"30_30_40": [30, 30, 40]})
    built.write.parquet(f"{again}/networks/broken")
    once = NetworkStore(spark, folder)
    assert edge(build_networks(weighted, comp, again, params, 3, 12, 2, False, [20, 30], mixes)) == edge(built)
    build_networks(weighted, comp, folder, params, 3, 12, 2, False, [20, 30], mixes)
    rows = lambda s: sorted(map(tuple, s.nulls().select("mix", "size", "network_id", "kinase", "sample", "rep", "frequency", "p").collect()))
    assert rows(NetworkStore(spark, again)) == rows(once) and len({r[:6] for r in rows(once)}) == len(rows(once)) == 2 * 2 * 3 * 3 * 3
    assert once.lacking([20, 30], list(mixes)) == {}
    # what was made on other networks is refused, and so are networks that are not those stored
    with pytest.raises(ValueError, match="other networks"):
        once.nulls(built.where("kinase <> 'K0' or network_id > 0"))
    assert once.nulls(built.where("network_id = 1")).select("network_id").distinct().collect()[0][0] == 1
    with pytest.raises(ValueError, match="of this id"):
        once.add_networks(built)
    path = once.manifest("networks").first().part
    built.where("kinase <> 'K1'").write.mode("append").parquet(f"{folder}/networks/{path}")
    with pytest.raises(ValueError, match="not the one"):
        once.networks()
    with pytest.raises(ValueError):
        build_networks(weighted, comp, str(tmp_path / "large"), params, 1, 1000, 2)
    writers.save_networks(built, str(tmp_path / "tsv"), "tsv")
    assert edge(readers.networks(spark, str(tmp_path / "tsv"))) == edge(built)
    assert {r.kinase for r in readers.networks(spark, str(tmp_path / "tsv"), ["K2"]).collect()} == {"K2"}
    with pytest.raises(ValueError):
        writers.save_networks(built, folder, "xml")


def test_mapping(spark):
    seqs = spark.createDataFrame([("P1", "MASDFSTYK"), ("P2", "AAAA")], "accession string, sequence string")
    raw = spark.createDataFrame([("P1-2;P9", "ASDF;FstYK", 1.0), ("P1", "FsTYK", 2.0), ("P2", "CsC", 3.0), (None, "AsK", 1.0)], "accession string, peptide string, value double")
    sites = spark.createDataFrame([("P1", "S6", 4)], "accession string, site string, num_compendia int")
    got = mapping.map_experiment(raw, seqs, sites)
    assert {(r.accession, r.site, r.aligned, r.compendia_class) for r in got.rows.collect()} == {("P1", "S6", "MASDFsTYK", 2)}
    assert {r.reason for r in got.rejects.collect()} == {mapping.NO_SEQUENCE, mapping.NO_ALIGNMENT, mapping.NO_COMPENDIA}
    assert sum(r.share for r in mapping.mapping_statistics(got).collect()) == pytest.approx(1)
    by_site = spark.createDataFrame([("P1", "S6;T7", 1.0)], "accession string, site string, value double")
    assert mapping.map_experiment(by_site, seqs, sites).rows.count() == 1
    with pytest.raises(ValueError):
        mapping.map_experiment(by_site.withColumn("site", F.lit("x")), seqs, sites)
    with pytest.raises(ValueError):
        mapping.map_experiment(by_site.drop("site"), seqs, sites)


def test_analysis_and_storage(spark, tmp_path):
    rng = random.Random(5)
    sites = [(f"P{i}", "S1") for i in range(60)]
    raw = spark.createDataFrame([(s, a, x, rng.random()) for s in ("data:a", "data:b") for a, x in sites], RAW)
    net = spark.createDataFrame([(n, f"K{k}", a, x) for n in range(4) for k in range(3) for a, x in rng.sample(sites, 20)], "network_id int, kinase string, accession string, site string")
    comp = spark.createDataFrame([(a, x, i % 6) for i, (a, x) in enumerate(sites)], "accession string, site string, num_compendia int")
    found = analyse(raw, net, comp, Params(threshold=0.5, reps=6), kinases=["K0", "K1"])
    rows = found.activities.collect()
    assert len(rows) == 4 and all(0 <= r.mw_p <= 1 and 0 <= r.fpr <= 1 for r in rows)
    writers.save_results(spark, found.tables(), Params(threshold=0.5, reps=6), str(tmp_path / "run"), minimal=False)
    tables, params = readers.results(spark, str(tmp_path / "run"))
    assert set(tables) == set(found.tables()) and params.reps == 6
    assert tables["enrichment"].count() == found.enrichment.count()
    writers.save_wide(found.random_enrichment, str(tmp_path / "wide"), [f"data:a:{i}" for i in range(6)])
    assert readers.wide_enrichment(spark, str(tmp_path / "wide")).where("p is not null").count() == found.random_enrichment.where("sample = 'data:a'").count()
    writers.save_networks(net, str(tmp_path / "nets"))
    assert spark.read.parquet(str(tmp_path / "nets")).where("network_id = 1").count() == net.where("network_id = 1").count()
    dots = presentation.dots(found.activities, 0.5)
    assert dots.count() == 4 and {r.x for r in dots.collect()} == {5, 15}
    with pytest.raises(ValueError):
        enrichment.pivot_unique(net.withColumn("v", F.lit(1)), "kinase", "network_id", "v", ["0"])


def test_stored_nulls(spark, tmp_path):
    """A run with stored experiments agrees with one that draws the same experiments itself."""
    rng = random.Random(7)
    sites = [(f"P{i}", "S1") for i in range(400)]
    comp = spark.createDataFrame([(a, x, 5 if i % 2 else 1 + i % 3) for i, (a, x) in enumerate(sites)], "accession string, site string, num_compendia int")
    net = spark.createDataFrame([(n, f"K{k}", a, x) for n in range(3) for k in range(3) for a, x in rng.sample(sites, 60)], "network_id int, kinase string, accession string, site string")
    raw = spark.createDataFrame([("data:near", a, x, 1.0) for a, x in sites[:98]] + [("data:far", a, x, 1.0) for a, x in sites[:300]], RAW)
    params = Params(reps=5)
    made = pregenerate(net, comp, params, [62, 96], {"0_30_70": [0, 30, 70]})
    assert made.select("mix", "size", "rep").distinct().count() == 10 and made.where("rep < 0").count() == 0
    writers.save_nulls(made, str(tmp_path / "nulls"))
    stored = readers.stored_nulls(spark, str(tmp_path / "nulls"))
    assert pregenerate(net, comp, params, [62, 96], {"0_30_70": [0, 30, 70]}, stored).count() == 0
    assert nulls.merge(stored, made).count() == made.count()
    found, plain = analyse(raw, net, comp, params, stored=stored), analyse(raw, net, comp, params)
    key = lambda r: (r.network_id, r.kinase, r.rep, r.frequency, round(r.p, 9))
    of = lambda df, s: sorted(map(key, df.where(F.col("sample") == s).collect()))
    assert of(found.random_enrichment, "data:near") == sorted(map(key, stored.where("size = 96").collect()))
    assert of(found.random_enrichment, "data:far") == of(plain.random_enrichment, "data:far")
    # the same activities as from these experiments' own enrichment
    want = significance.activities(plain.enrichment, stored.where("size = 96").withColumn("sample", F.lit("data:near")).unionByName(plain.random_enrichment.where("sample = 'data:far'"), allowMissingColumns=True))
    assert sorted(map(tuple, found.activities.collect())) == sorted(map(tuple, want.select(found.activities.columns).collect()))


def test_saved_tables(spark, tmp_path):
    rows = [("data:a", "K1", 0.5, 0.1), ("data:b", "K1", 0.25, 0.2), ("data:a", "K2", 1.0, 0.0), ("data:b", "K2", 0.125, 1.0)]
    acts = spark.createDataFrame(rows, "sample string, kinase string, mw_p double, fpr double")
    for kind in ("tsv", "csv"):
        writers.save_wide_activities(acts, str(tmp_path), ["data:a", "data:b"], kind)
        got = readers.result_tables(spark, f"{tmp_path}/mann_whitney_activities.{kind}", f"{tmp_path}/mann_whitney_fpr.{kind}")
        assert sorted(map(tuple, got.collect())) == sorted(rows)
        writers.save_tables({"long": acts}, str(tmp_path), kind)
        assert sorted(map(tuple, readers.long_results(spark, f"{tmp_path}/long.{kind}").collect())) == sorted(rows)
    writers.save_tables({"long": acts}, str(tmp_path), "json")
    assert spark.read.json(f"{tmp_path}/long.json").count() == 4
    with pytest.raises(ValueError):
        writers.save_tables({}, str(tmp_path), "xls")


def test_reshaping(spark):
    wide = spark.createDataFrame([("K1", 1.0, 2.0), ("K2", 3.0, 4.0)], "kinase string, a double, b double")
    assert sorted(map(tuple, evidence.transpose(wide, "kinase", ["K1", "K2"], "sample").collect())) == [("a", 1.0, 3.0), ("b", 2.0, 4.0)]
    assert renamed(["0_30_70:1", "x"], "0_30_70", "data:a") == {"0_30_70:1": "data:a:1"}
    one = spark.createDataFrame([("a", "P1", "S1")], "sample string, accession string, site string")
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")
    assert sorted(map(tuple, thresholds.jaccard(one, units=units).collect())) == [("a", "b", 0.0), ("a", "c", 0.0), ("b", "c", 0.0)]


def test_sample_that_misses_a_network(spark):
    net = spark.createDataFrame([(0, "A", "P1", "S1"), (0, "B", "P2", "S2"), (1, "A", "P3", "S3"), (1, "C", "P4", "S4")], "network_id int, kinase string, accession string, site string")
    tried = [("a", -1, "P1", "S1"), ("a", 0, "P3", "S3"), ("b", -1, "P9", "S9")]
    found = enrichment.enrich(net, spark.createDataFrame(tried, "sample string, rep int, accession string, site string")).collect()
    got = {(r.network_id, r.kinase, r.sample, r.rep): (r.frequency, round(r.p, 9)) for r in found}
    met = {(0, "A", "a", -1): (1, 0.5), (1, "A", "a", 0): (1, 0.5)}
    grid = itertools.product([(0, "A"), (0, "B"), (1, "A"), (1, "C")], [("a", -1), ("a", 0), ("b", -1)])
    assert len(found) == len(got) and got == {(*k, *s): met.get((*k, *s), (0, 1.0)) for k, s in grid}


def test_readers(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">sp|P1|name one\nABC\nDEF\n>sp|P2|beta 1->4 > lyase\r\nGG\r\nHH\r\n>tr|P3|\nI\n")
    assert {tuple(r) for r in readers.fasta(spark, str(tmp_path / "x.fasta")).collect()} == {("P1", "ABCDEF"), ("P2", "GGHH"), ("P3", "I")}
    folder = tmp_path / "nets" / "one"
    folder.mkdir(parents=True)
    for n in (0, 3):
        (folder / f"net_{n}_x.tsv").write_text("accession\tsite\tkinase\nP1\tS1\tK1\nP2\tS2\tK2\n")
    got = readers.networks(spark, str(folder / "*.tsv"), ["K1"])
    assert {(r.network_id, r.kinase) for r in got.collect()} == {(0, "K1"), (3, "K1")}
    (folder / "RUN_INFORMATION.txt").write_text("Unique ID:\tabc\nDate Run\t2020\n# of Networks:\t2\nUse Compendia:\tyes\nCompendia 0\t5\nCompendia 1\t7\n")
    info = readers.run_information(spark, str(folder / "RUN_INFORMATION.txt"))
    row = info.first()
    assert (row.unique_id, row.networks, row.compendia) == ("abc", "2", [5, 7]) and readers.same_network(info, "abc")
    (tmp_path / "nets" / "two").mkdir()
    assert {(r.name, r.valid) for r in readers.catalog(spark, str(tmp_path / "nets")).collect()} == {("one", True), ("two", False)}
    (tmp_path / "c.csv").write_text("accession,site,num_compendia,compendia_class\nP1,S1,4,2\n")
    assert readers.compendia(spark, str(tmp_path / "c.csv")).first().num_compendia == 4
    assert readers.delimited(spark, str(tmp_path / "c.csv")).columns[0] == "accession"


def test_params():
    p = Params(threshold=None, top_n=5)
    assert Params.from_json(p.to_json()) == p
    for bad in ({"agg": "sum"}, {"phospho_type": "X"}, {"top_n": 3}, {"alpha": 2}):
        with pytest.raises(ValueError):
            Params(**bad)
    with pytest.raises(ValueError):
        Params.from_json(json.dumps({"x": 1}))
    assert as_bool("Yes") and not as_bool("no")
    assert prefixed(["data:a", "b"]) == {"data:a": "data:a"} and prefixed(["b"], ["b"]) == {"b": "data:b"}
    with pytest.raises(ValueError):
        prefixed(["b"], ["c"])


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2020-01-0{1 + i % 5} 00:00:00", f"s{i % 2}", f"P{i % 3}", "S1", float(i % 7)) for i in range(60)], "t string, sample string, accession string, site string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert running_counts(stream).isStreaming
    got = {tuple(r) for r in drain(spark, windowed_evidence(stream, 3.0), "t").collect()}
    want = {tuple(r) for r in windowed_evidence(rows, 3.0).collect()}
    assert got and got == want


@pytest.mark.parametrize("files", [1, 1000])
def test_drained_stream_is_the_batch(spark, tmp_path, files):
    # the mean of the first window falls below the threshold in a later file, and the last windows stay open
    days = [[("2020-01-01", 9.0), ("2020-01-05", 4.0)], [("2020-01-06", 5.0), ("2020-01-06", 2.0)], [("2020-01-01", -9.0), ("2020-01-07", 8.0)]]
    for part in days:
        rows = spark.createDataFrame([(t, "s", "P", "S1", v) for t, v in part], "t string, sample string, accession string, site string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in drain(spark, windowed_evidence(stream, 3.0), "t").collect())
    assert got == sorted(tuple(r) for r in windowed_evidence(spark.read.parquet(str(tmp_path / "in")), 3.0).collect())
    assert got == sorted(tuple(r) for r in merged_evidence(stream, 3.0, "m").collect())
    assert merged_evidence(stream.where("value > 100"), 3.0, "m").count() == 0
    assert [r[0].day for r in got] == [5, 6, 7]


def test_bits_of_draws_against_drawn_sites(spark):
    """Counts by bit vectors are those of the sites that draws take, in one pass or many, for many samples."""
    rng = random.Random(12)
    comp = spark.createDataFrame([(f"P{i}", "S1", i % 6) for i in range(400)], "accession string, site string, num_compendia int")
    edges = sorted({(rng.randrange(3), f"K{rng.randrange(5)}", f"P{rng.randrange(420)}", "S1") for _ in range(1500)})
    net = spark.createDataFrame(edges, "network_id int, kinase string, accession string, site string")
    quotas = spark.createDataFrame([(f"s{i}", k, rng.randint(0, 200)) for i in range(500) for k in range(3)], "sample string, stratum int, quota int")
    cuts = nulls.cutoffs(comp, quotas, 2, 7)
    held = net.groupBy("network_id", "accession", "site").agg(F.collect_list("kinase").alias("kinases"))
    drawn = nulls.draw(comp, quotas, 2, 7).join(held, ["accession", "site"])
    want = drawn.select("network_id", "sample", "rep", F.explode(F.array_append("kinases", F.lit(None).cast("string"))).alias("kinase")).groupBy("network_id", "sample", "rep", "kinase").count()
    key = lambda df: sorted(map(str, df.collect()))
    want = sorted(tuple(r) for r in want.fillna("-", ["kinase"]).collect())
    assert len({r[1] for r in want}) == 500
    for draws in (1 << 14, 130):
        assert sorted(tuple(r) for r in nulls.overlaps(held, comp, cuts, draws=draws).fillna("-", ["kinase"]).collect()) == want
    assert nulls.overlaps(held, comp, cuts.limit(0)).count() == 0


def test_saved_bundles_of_all_kinds(spark, tmp_path):
    params = Params(reps=3, threshold=2.0)
    tables = {"evidence": spark.createDataFrame([("a", "P1", "S1", 2)], "sample string, accession string, site string, num_compendia int"), "activities": spark.createDataFrame([("a", "K1", 0.5, None)], "sample string, kinase string, mw_p double, fpr double")}
    schemas = {n: t.schema.simpleString()[7:-1].replace(":", " ") for n, t in tables.items()}
    for kind in (None, "parquet", "json", "csv", "tsv"):
        folder = str(tmp_path / str(kind))
        writers.save_results(spark, tables, params, folder, kind=kind)
        found, settings = readers.results(spark, folder, schemas)
        assert settings == params and {n: [tuple(r) for r in t.select(tables[n].columns).collect()] for n, t in found.items()} == {n: [tuple(r) for r in t.collect()] for n, t in tables.items()}


@pytest.mark.parametrize("few, digits", [(0, 7), (1 << 12, 7), (0, 1), (1 << 12, 1)])
def test_draws_against_ordering_all_keys(spark, monkeypatch, few, digits):
    """By cutoffs and with their sites, also where keys are equal and lie far from where they are expected."""
    monkeypatch.setattr(nulls, "FEW", few)
    monkeypatch.setattr(nulls, "numbers", lambda of, many: F.array(*[F.conv(F.substring(F.md5(of), 1 + 7 * k, digits), 16, 10).cast("long") for k in range(many)]))
    number = lambda text, k: int(hashlib.md5(text.encode()).hexdigest()[7 * k : 7 * k + digits], 16)
    sites = [(f"P{i}", "S1", i % 6) for i in range(90)]
    quotas = [("a", 0, 4), ("a", 1, 40), ("b", 1, 60), ("b", 2, 29), ("b", 0, 0)]
    comp, quota = spark.createDataFrame(sites, "accession string, site string, num_compendia int"), spark.createDataFrame(quotas, "sample string, stratum int, quota long")
    want = {}
    for sample, stratum, most in quotas:
        for rep in range(3):
            a, b, c, d = (number(f"1|{sample}|{rep}", k) for k in range(4))
            key = lambda s: (((a * number(f"{s[0]}|{s[1]}", 0) + b) % nulls.PRIME) * ((c * number(f"{s[0]}|{s[1]}", 1) + d) % nulls.PRIME) % nulls.PRIME, *s)  # noqa: B023, E731
            for s in sorted(((p, x) for p, x, n in sites if (n > 0) + (n > 3) == stratum), key=key)[:most]:
                want.setdefault((sample, *s), []).append(rep)
    found = [tuple(r) for r in nulls.replicates(comp, quota, 3, 1).collect()]
    assert {r[:3]: r[3] for r in found} == want and len(found) == len(want)
    assert sorted(tuple(r) for r in nulls.draw(comp, quota, 3, 1).collect()) == sorted((k[0], rep, *k[1:]) for k, reps in want.items() for rep in reps)


def test_mapping_looks_for_a_sequence_once(spark, monkeypatch):
    """Mapped rows and all rejects come from one join with the sequences, which tells unknown accessions from empty sequences."""
    searched = []
    monkeypatch.setattr(mapping, "materialize", lambda df, name: searched.append(name) or df.localCheckpoint())
    monkeypatch.setattr(mapping, "split_known", None)
    sequences = spark.createDataFrame([("P1", "MASTAYK"), ("P2", None)], "accession string, sequence string")
    comp = spark.createDataFrame([("P1", "S3", 2), ("P1", "S3", 4)], "accession string, site string, num_compendia int")
    raw = spark.createDataFrame([("P1-2", "AsTA", 1.0), ("P1", "AsTA", 1.0), ("P1", "MAStA", 1.0), ("P1", "AstA", 2.0), ("P1", "ASTA", 1.0), ("P1", "WsW", 1.0), ("P2;P3", "AsT", 1.0), ("P3", "AsT", 1.0)], "accession string, peptide string, value double")
    found = mapping.map_experiment(raw, sequences, comp)
    assert searched == ["aligned"]
    assert sorted(tuple(r) for r in found.rows.select("accession", "site", "peptide", "aligned", "value", "num_compendia", "compendia_class").collect()) == [("P1", "S3", "AsTA", "MAsTAYK", 1.0, 4, 2), ("P1", "S3", "AsTA", "MAsTAYK", 2.0, 4, 2)]
    rejects = sorted((r.reason, r.accession, r.peptide, r.site or "", r.value) for r in found.rejects.collect())
    lost = [(mapping.NO_COMPENDIA, "P1", "AStA", "T4", 2.0), (mapping.NO_COMPENDIA, "P1", "MAStA", "T4", 1.0)]
    assert rejects == sorted([(mapping.NO_SEQUENCE, "P3", "AsT", "", 1.0)] * 2 + lost + [(mapping.NO_ALIGNMENT, "P1", "WsW", "", 1.0), (mapping.NO_ALIGNMENT, "P2", "AsT", "", 1.0)])


def test_lists_of_pruning_put_few_edges_in_order(spark, monkeypatch):
    """The first sites of each list are those of ordering all its clocks, also where one edge has nearly all the weight; few rows are put in order."""
    rng = random.Random(5)
    rows = [(n, s, k, f"P{i}", "S1", 1e9 if k == "K1" and i == 7 else rng.random() + 0.01) for n in range(2) for s, k in ((0, "K0"), (0, "K1"), (1, "K0")) for i in range(600 if s == 0 else 5)]
    frame = spark.createDataFrame(rows, "network_id int, stratum int, kinase string, accession string, site string, weight double")
    masses, passed = networks._masses(frame, networks.UNIT), []
    keep = networks.materialize
    monkeypatch.setattr(networks, "materialize", lambda df, name: (passed.append(networks.clocks(frame, 3).join(masses, networks.UNIT).where("clock * mass < 60").count()) if name == "lists" else None, keep(df, name))[1])
    found = networks._lists(frame.join(masses.select(*networks.UNIT, "mass"), networks.UNIT), masses, 9, 3)
    want = {}
    for r in sorted(networks.clocks(frame, 3).collect(), key=lambda r: (r.clock, r.accession)):
        want.setdefault((r.network_id, r.stratum, r.kinase), []).append(r.accession)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        got.setdefault((r.network_id, r.stratum, r.kinase), []).append(r.accession)
    assert got == {u: some[:10] for u, some in want.items()}
    assert len(passed) > 1 and passed[0] < 400 < len(rows)


def test_small_stored_draws_need_no_cutoffs(spark, monkeypatch):
    """Stored experiments of few sites meet networks like evidence, with the counts that cutoffs give."""
    comp = spark.createDataFrame([(f"P{i}", "S1", i % 6) for i in range(60)], "accession string, site string, num_compendia int")
    net = spark.createDataFrame([(n, f"K{k}", f"P{(7 * i + n + k) % 60}", "S1") for n in range(2) for k in range(2) for i in range(9)], "network_id int, kinase string, accession string, site string")
    made = lambda: sorted(tuple(r) for r in pregenerate(net, comp, Params(reps=2), [20], {"0_50_50": [0, 50, 50]}).collect())
    monkeypatch.setattr(nulls, "FEW", 0)
    want = made()
    monkeypatch.setattr(nulls, "FEW", 1 << 12)
    monkeypatch.setattr(nulls, "overlaps", None)
    assert made() == want and len(want) == 8
