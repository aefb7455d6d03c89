"""Every registered query of the kinase-activity operators, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import accessions as A
from ..functions import peptides as P
from ..functions.stats import minus_log10
from ..operators import clustering as C
from ..operators import enrichment as E
from ..operators import evidence as V
from ..operators import mapping as M
from ..operators import networks as N
from ..operators import nulls as R
from ..operators import presentation as D
from ..operators import significance as S
from ..operators import thresholds as T
from ..params import Params
from ..sources.paths import materialize, work_path
from ..sources.readers import networks as read_networks
from ..sources.store import NetworkStore
from ..sources.writers import save_networks
from ..streaming.evidence import merged_evidence, windowed_evidence
from .pipeline import analyse, fill_nulls, pregenerate
from .testbed import duck, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

THRESHOLD, REPS, SEED, ALPHA = 30.0, 150, 1, 0.05
#: Replicates that a fixed number of trials takes.
TRIALS = 100
#: Experiments of the wide form, which has a column for each.
WIDE_REPS = 5
#: Samples of the test bed.
SAMPLES = [f"data:{flag}{status}" for flag in "ANR" for status in "FO"]


def _number(k: int) -> str:
    return f"CAST('0x' || substr(h, {1 + 7 * k}, 7) AS BIGINT)"


def _drawn(quota: str, reps: int) -> str:
    """The definition of a draw: each class is ordered by the sites' keys and the first ones are taken."""
    return f"""SELECT sample, rep, accession, site FROM (SELECT q.sample, q.rep, s.sid, q.quota, row_number() OVER (PARTITION BY q.sample, q.rep, q.stratum
        ORDER BY ((a * x + b) % {R.PRIME}) * ((c * y + d) % {R.PRIME}) % {R.PRIME}, sid) AS rank FROM sited s JOIN
        (SELECT *, {", ".join(f"{_number(k)} AS {n}" for k, n in enumerate("abcd"))} FROM (SELECT *, md5(concat_ws('|', '{SEED}', sample, CAST(rep AS VARCHAR))) AS h FROM {quota} CROSS JOIN (SELECT unnest(range({reps})) AS rep))) q USING (stratum))
        JOIN sited USING (sid) WHERE rank <= quota"""


#: Common table expressions that several queries share.
CTE = {
    "coll": "SELECT sample, accession, site, avg(value) AS value FROM tb_raw GROUP BY ALL",
    "evid": f"SELECT sample, accession, site FROM coll WHERE value >= {THRESHOLD}",
    "comp": "SELECT *, CASE WHEN num_compendia < 1 THEN 0 WHEN num_compendia <= 3 THEN 1 ELSE 2 END AS compendia_class FROM tb_compendia",
    "evc": "SELECT * FROM evid LEFT JOIN comp USING (accession, site)",
    "nsite": "SELECT DISTINCT network_id, accession, site FROM tb_network",
    "msize": "SELECT network_id, count(*) AS m FROM nsite GROUP BY ALL",
    "deg": "SELECT network_id, kinase, count(*) AS degree FROM tb_network GROUP BY ALL",
    "quota": "SELECT sample, compendia_class AS stratum, count(*) AS quota FROM evc WHERE compendia_class IS NOT NULL GROUP BY ALL",
    "sited": f"SELECT *, {_number(0)} AS x, {_number(1)} AS y FROM (SELECT accession, site, compendia_class AS stratum, md5(accession || '|' || site) AS h, row_number() OVER (ORDER BY accession, site) AS sid FROM comp)",
    "drawn": _drawn("quota", REPS),
    "few": _drawn("quota", WIDE_REPS),
    "tried": "SELECT sample, -1 AS rep, accession, site FROM evid UNION ALL SELECT sample, rep, accession, site FROM drawn",
    "real_only": "SELECT sample, -1 AS rep, accession, site FROM evid",
    "ins": "SELECT network_id, sample, rep, count(*) AS n FROM nsite JOIN tried USING (accession, site) GROUP BY ALL",
    "ov": "SELECT network_id, kinase, sample, rep, count(*) AS k FROM tb_network JOIN tried USING (accession, site) GROUP BY ALL",
    "grid": "SELECT network_id, kinase, sample, rep, m, degree FROM deg JOIN msize USING (network_id) CROSS JOIN (SELECT DISTINCT sample, rep FROM tried)",
    "num": "SELECT network_id, kinase, sample, rep, coalesce(k, 0) AS k, m, degree, coalesce(n, 0) AS n FROM grid LEFT JOIN ins USING (network_id, sample, rep) LEFT JOIN ov USING (network_id, kinase, sample, rep)",
    "enr": """SELECT network_id, kinase, sample, rep, k AS frequency, CASE WHEN k <= greatest(0, degree + n - m) THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE),
        list_sum([exp(lgamma(degree + 1) - lgamma(i + 1) - lgamma(degree - i + 1) + lgamma(m - degree + 1) - lgamma(n - i + 1) - lgamma(m - degree - n + i + 1)
        - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1)) FOR i IN range(k, least(degree, n) + 1)])) END AS p FROM num""",
    "real": "SELECT network_id, kinase, sample, frequency, p FROM enr WHERE rep = -1",
    "rand": "SELECT network_id, kinase, sample, rep, round(p, 9) AS p FROM enr WHERE rep >= 0",
    "dropped": f"SELECT sample, kinase, arg_min(rep, md5(concat_ws('|', '{SEED}', sample, kinase, CAST(rep AS VARCHAR)))) AS rep FROM rand GROUP BY ALL",
    "pool": "SELECT sample, kinase, 1 AS unit, round(p, 9) AS p FROM real UNION ALL SELECT sample, kinase, 0, p FROM rand ANTI JOIN dropped USING (sample, kinase, rep)",
    "sim": """SELECT first, second, coalesce(shared, 0) / (na + nb - coalesce(shared, 0)) AS jaccard FROM
        (SELECT a.sample AS first, b.sample AS second, a.n AS na, b.n AS nb FROM (SELECT sample, count(*) n FROM evid GROUP BY 1) a JOIN (SELECT sample, count(*) n FROM evid GROUP BY 1) b ON a.sample < b.sample)
        LEFT JOIN (SELECT a.sample AS first, b.sample AS second, count(*) AS shared FROM evid a JOIN evid b USING (accession, site) WHERE a.sample < b.sample GROUP BY ALL) USING (first, second)""",
}
RAW = ("tb_raw", "coll", "evid")
BIAS = ("tb_raw", "tb_compendia", "coll", "evid", "comp", "evc")
ENRICHED = ("ins", "ov", "grid", "num", "enr")
BOTH = (*BIAS, "tb_network", "nsite", "msize", "deg", "quota", "sited", "drawn", "tried", *ENRICHED)
REAL = (*RAW, "tb_network", "nsite", "msize", "deg", "tried=real_only", *ENRICHED, "real")
#: Computed once in each query that uses them.
KEPT = ("coll", "drawn", "few", "enr", "rand", "num", "gap", "medrow")


def ctes(*names: str) -> str:
    """Common table expressions by name; `a=b` gives the one of b the name a."""
    named = [(n, of or n) for n, _, of in (x.partition("=") for x in names)]
    return "WITH " + ", ".join(duck(n) if n.startswith("tb_") else f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({CTE[of]})" for n, of in named) + " "


def query(sql: str | None = None, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (ctes(*names) if names else "") + sql
        return f

    return add


def collapsed(spark, d):
    return V.collapse(view(spark, d, "tb_raw"))


def chosen(spark, d):
    return V.by_threshold(collapsed(spark, d), THRESHOLD)


def biased(spark, d):
    return V.with_compendia(chosen(spark, d), view(spark, d, "tb_compendia"))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# evidence


@query("SELECT sample, kinase, CAST(rank AS INT) AS rank, round(median_p, 6) AS median_p FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(median_p, 9), kinase) AS rank FROM (SELECT sample, kinase, median(p) AS median_p FROM real GROUP BY ALL)) WHERE rank <= 5", *REAL)
def flagship_top_kinases(spark, d):
    medians = E.median_enrichment(E.enrich(view(spark, d, "tb_network"), chosen(spark, d)))
    return rounded(E.top_kinases(medians.withColumn("median_p", F.round("median_p", 9))), "median_p")


for how, call in (("mean", "avg(value)"), ("median", "median(value)"), ("min", "min(value)"), ("max", "max(value)"), ("count", "count(value)")):

    def _collapse(spark, d, how=how):
        return rounded(V.collapse(view(spark, d, "tb_raw"), how), "value") if how in ("mean", "median") else V.collapse(view(spark, d, "tb_raw"), how)

    _collapse.__name__ = f"collapse_{how}"
    query(f"SELECT sample, accession, site, {f'round({call}, 6)' if how in ('mean', 'median') else call} AS value FROM tb_raw GROUP BY ALL", "tb_raw")(_collapse)


@query("SELECT sample, accession, site, round(avg(value), 6) AS value FROM tb_events WHERE accession IS NOT NULL AND site IS NOT NULL GROUP BY sample, accession, site", "tb_events")
def collapse_events(spark, d):
    return rounded(V.collapse(view(spark, d, "tb_events")), "value")


@query(f"SELECT sample, accession, site, CAST(coalesce(value >= {THRESHOLD}, false) AS INT) AS flag FROM coll", "tb_raw", "coll")
def threshold_flags(spark, d):
    return V.flags(collapsed(spark, d), THRESHOLD)


@query("SELECT sample, accession, site, CAST(value <= 20 AS INT) AS flag FROM coll", "tb_raw", "coll")
def masked_flags_below(spark, d):
    return V.mask(collapsed(spark, d), 20.0, greater=False)


@query("SELECT concat(sample, '_threshold=', CASE t WHEN 10 THEN '10.0' WHEN 25 THEN '25.0' ELSE '40.0' END) AS sample, accession, site FROM coll CROSS JOIN (VALUES (10.0), (25.0), (40.0)) v(t) WHERE value >= t", "tb_raw", "coll")
def multi_threshold_evidence(spark, d):
    return V.by_thresholds(collapsed(spark, d), [10, 25, 40])


@query("SELECT accession, site, sample, num_compendia, compendia_class FROM evc", *BIAS)
def evidence_with_compendia(spark, d):
    return biased(spark, d)


@query("SELECT sample, accession, site FROM evid WHERE site LIKE 'S%' OR site LIKE 'T%'", *RAW)
def evidence_of_type(spark, d):
    return V.of_type(chosen(spark, d), "ST")


@query("SELECT sample, count(*) AS size FROM evid GROUP BY ALL", *RAW)
def evidence_sizes(spark, d):
    return V.sizes(chosen(spark, d))


@query("SELECT max(size) AS largest, min(size) AS smallest, median(size) AS middle FROM (SELECT sample, count(*) AS size FROM evid GROUP BY ALL)", *RAW)
def evidence_size_summary(spark, d):
    return V.size_summary(chosen(spark, d))


@query("SELECT sample, count(*) FILTER (value >= 48) AS size, count(*) FILTER (value >= 48) > 100 AS valid FROM coll GROUP BY ALL", "tb_raw", "coll")
def sample_validity(spark, d):
    return V.valid_samples(collapsed(spark, d), [48.0, 49.0], min_size=100)


@query("SELECT t AS threshold, bool_or(n > 100) AS any_sample, bool_and(n > 100) AS all_samples FROM (SELECT t, sample, count(*) FILTER (value >= t) AS n FROM coll CROSS JOIN (VALUES (CAST(10 AS DOUBLE)), (40), (49)) v(t) GROUP BY ALL) GROUP BY t", "tb_raw", "coll")
def threshold_validity(spark, d):
    return V.threshold_validity(collapsed(spark, d), [10, 40, 49], min_size=100)


@query("SELECT sample, accession, site FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, accession, site) AS r FROM coll WHERE value IS NOT NULL) WHERE r <= 200", "tb_raw", "coll")
def top_n_evidence(spark, d):
    return V.by_rank(collapsed(spark, d), 200)


@query("SELECT sample, accession, site FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, accession, site) AS r FROM coll WHERE value IS NOT NULL) WHERE r <= 200", "tb_raw", "coll")
def bottom_n_evidence(spark, d):
    return V.by_rank(collapsed(spark, d), 200, greater=False)


@query("SELECT sample, round_even(count(*) FILTER (compendia_class = 0) * 100 / count(*), 2) AS class_0, round_even(count(*) FILTER (compendia_class = 1) * 100 / count(*), 2) AS class_1, round_even(count(*) FILTER (compendia_class = 2) * 100 / count(*), 2) AS class_2 FROM evc WHERE compendia_class IS NOT NULL GROUP BY ALL", *BIAS)
def compendia_distribution(spark, d):
    return V.class_shares(biased(spark, d))


@query("SELECT sample, CAST(stratum AS INT) AS stratum, quota FROM quota", *BIAS, "quota")
def stratum_sizes(spark, d):
    return V.stratum_sizes(biased(spark, d))


@query("SELECT sample, round(max(value) FILTER (r = 20), 6) AS value FROM (SELECT sample, value, row_number() OVER (PARTITION BY sample ORDER BY value DESC) AS r FROM coll WHERE value IS NOT NULL) GROUP BY ALL", "tb_raw", "coll")
def nth_values(spark, d):
    return rounded(V.nth_values(collapsed(spark, d), 20), "value")


@query("SELECT min(v) AS threshold FROM (SELECT sample, max(value) FILTER (r = 20) AS v FROM (SELECT sample, value, row_number() OVER (PARTITION BY sample ORDER BY value DESC) AS r FROM coll WHERE value IS NOT NULL) GROUP BY ALL)", "tb_raw", "coll")
def allowable_threshold(spark, d):
    return V.allowable_threshold(collapsed(spark, d))


@query("SELECT start, sample, accession, site, round(value, 6) AS value, n FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, sample, accession, site, avg(value) AS value, count(*) AS n FROM tb_events WHERE value IS NOT NULL GROUP BY ALL) WHERE value >= 50", "tb_events")
def windowed_event_evidence(spark, d):
    return rounded(windowed_evidence(view(spark, d, "tb_events"), 50.0), "value")


@query(SQL["windowed_event_evidence"])
def streamed_event_evidence(spark, d):
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a pattern: a stream takes no single file
    measured = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("sample"), F.concat(F.lit("U"), "user_id").alias("accession"), F.concat(F.substr(F.lit("STY"), F.length("event_type") % 3 + 1, F.lit(1)), F.col("event_id") % 50 + 1).alias("site"), "value")
    return rounded(merged_evidence(measured, 50.0, "events"), "value")


# thresholds and similarity


@query("SELECT first, second, round(jaccard, 6) AS jaccard FROM sim", *RAW, "sim")
def sample_jaccard(spark, d):
    return rounded(T.jaccard(chosen(spark, d)), "jaccard")


@query("SELECT round(max(jaccard), 6) AS largest, round(avg(jaccard), 6) AS mean, round(median(jaccard), 6) AS middle FROM sim", *RAW, "sim")
def jaccard_summary(spark, d):
    return rounded(T.jaccard_summary(T.jaccard(chosen(spark, d))), "largest", "mean", "middle")


@query("SELECT round(avg(m), 6) AS mean, round(max(x), 6) AS largest FROM (SELECT s, avg(jaccard) AS m, max(jaccard) AS x FROM (SELECT first AS s, jaccard FROM sim UNION ALL SELECT second, jaccard FROM sim) WHERE jaccard <> 1 GROUP BY s)", *RAW, "sim")
def jaccard_masked(spark, d):
    return rounded(T.jaccard_masked(T.jaccard(chosen(spark, d))), "mean", "largest")


SWEEP = """, t AS (SELECT CAST(unnest(range(10, 51, 5)) AS DOUBLE) AS threshold), hit AS (SELECT threshold, sample, accession, site FROM coll CROSS JOIN t WHERE value >= threshold),
per AS (SELECT threshold, sample, count(*) FILTER (value >= threshold) AS size FROM coll CROSS JOIN t GROUP BY ALL),
sizes AS (SELECT threshold, max(size) AS largest, min(size) AS smallest, median(size) AS middle FROM per GROUP BY ALL HAVING min(size) > 0),
shared AS (SELECT a.threshold, a.sample AS first, b.sample AS second, count(*) AS c FROM hit a JOIN hit b ON a.threshold = b.threshold AND a.accession = b.accession AND a.site = b.site AND a.sample < b.sample GROUP BY ALL),
pair AS (SELECT a.threshold, coalesce(c, 0) / (a.size + b.size - coalesce(c, 0)) AS j FROM per a JOIN per b ON a.threshold = b.threshold AND a.sample < b.sample LEFT JOIN shared s ON s.threshold = a.threshold AND s.first = a.sample AND s.second = b.sample WHERE a.size > 0 AND b.size > 0),
swept AS (SELECT * FROM sizes LEFT JOIN (SELECT threshold, max(j) AS similarity FROM pair GROUP BY ALL) USING (threshold)) """


def swept(spark, d):
    return T.sweep(collapsed(spark, d), T.grid(10, 50, 5))


@query()
def threshold_sweep(spark, d):
    return rounded(swept(spark, d), "similarity")


@query()
def threshold_by_size(spark, d):
    return T.by_size(swept(spark, d), 1500)


@query()
def threshold_by_similarity(spark, d):
    return T.by_similarity(swept(spark, d), 0.02)


SQL["threshold_sweep"] = ctes("tb_raw", "coll").rstrip() + SWEEP + "SELECT threshold, largest, smallest, middle, round(similarity, 6) AS similarity FROM swept"
SQL["threshold_by_size"] = ctes("tb_raw", "coll").rstrip() + SWEEP + "SELECT min(threshold) AS threshold FROM swept WHERE middle <= 1500"
SQL["threshold_by_similarity"] = ctes("tb_raw", "coll").rstrip() + SWEEP + "SELECT min(threshold) AS threshold FROM swept WHERE similarity < 0.02"


@query(ctes("tb_raw", "coll").rstrip() + SWEEP + """, found AS (SELECT greatest((SELECT min(threshold) FROM swept WHERE middle <= 1500), (SELECT min(threshold) FROM swept WHERE similarity < 0.02)) AS best),
top AS (SELECT min(v) AS most FROM (SELECT sample, max(value) FILTER (r = 20) AS v FROM (SELECT sample, value, row_number() OVER (PARTITION BY sample ORDER BY value DESC) AS r FROM coll WHERE value IS NOT NULL) GROUP BY ALL))
SELECT round(least(best, most), 2) AS threshold FROM found, top WHERE best IS NOT NULL""")
def recommended_threshold(spark, d):
    found = T.recommend(collapsed(spark, d), T.grid(10, 50, 5), desired=1500, most=0.02)
    return spark.createDataFrame([(found,)], "threshold double")


@query(SQL["recommended_threshold"].replace("SELECT round(least(best, most), 2) AS threshold FROM found, top WHERE best IS NOT NULL", "SELECT 'found' AS way, round(least(best, most), 2) AS threshold FROM found, top WHERE best IS NOT NULL UNION ALL SELECT 'fallback', 12.5"))
def automatic_threshold(spark, d):
    """What is recommended, and the fallback where no threshold leaves as little as is asked for."""
    rows = collapsed(spark, d)
    found, none = T.auto(rows, T.grid(10, 50, 5), 1500, 12.5, most=0.02), T.auto(rows, T.grid(10, 50, 5), -1, 12.5, most=-1.0)
    return spark.createDataFrame([("found", found), ("fallback", none)], "way string, threshold double")


@query("SELECT accession, site, sample, value FROM tb_raw WHERE (site LIKE '%S%' OR site LIKE '%T%') AND value IS NOT NULL", "tb_raw")
def loosely_filtered(spark, d):
    return V.of_type(view(spark, d, "tb_raw"), "ST", loose=True).where("value is not null").select("accession", "site", "sample", "value")


# networks and enrichment


@query("SELECT network_id, m FROM msize", "tb_network", "nsite", "msize")
def network_sizes(spark, d):
    return E.network_sizes(view(spark, d, "tb_network"))


@query("SELECT network_id, kinase, degree FROM deg", "tb_network", "deg")
def kinase_degrees(spark, d):
    return E.kinase_degrees(view(spark, d, "tb_network"))


@query("SELECT DISTINCT kinase FROM tb_network", "tb_network")
def available_kinases(spark, d):
    return N.available_kinases(view(spark, d, "tb_network"))


@query("SELECT network_id, kinase, accession, site FROM tb_network WHERE kinase IN ('K01', 'K07')", "tb_network")
def chosen_kinases(spark, d):
    return E.choose_kinases(view(spark, d, "tb_network"), ["K01", "K07", "K99"])[0]


def cutoffs(spark, d):
    return R.cutoffs(view(spark, d, "tb_compendia"), V.stratum_sizes(biased(spark, d)), REPS, SEED)


def enriched(spark, d):
    return E.enrich(view(spark, d, "tb_network"), chosen(spark, d), None, view(spark, d, "tb_compendia"), cutoffs(spark, d))


def really_enriched(spark, d):
    return E.enrich(view(spark, d, "tb_network"), chosen(spark, d))


# four places: over these many rows differences of 1e-10 between sums of log factorials show in the sixth
@query("SELECT network_id, kinase, sample, rep, frequency, round(p, 4) AS p FROM enr", *BOTH)
def enrichment_all(spark, d):
    return rounded(enriched(spark, d), "p", places=4)


@query("SELECT sample, kinase, round(median(p), 6) AS median_p FROM real GROUP BY ALL", *REAL)
def median_enrichment(spark, d):
    return rounded(E.median_enrichment(really_enriched(spark, d)), "median_p")


@query("SELECT sample, kinase, round(median(p), 6) AS median_original, round(median(least(greatest(p / 0.2 * 0.05, 0), 1)), 6) AS median_normalised, count(*) FILTER (p <= 0.2 / 10) AS count_significant, round(avg(CAST(p <= 0.2 / 10 AS INT)), 6) AS fraction_significant FROM real GROUP BY ALL", *REAL)
def normalised_summary(spark, d):
    rows = E.normalised_summary(E.normalise(really_enriched(spark, d), default=0.2))
    return rounded(rows, "median_original", "median_normalised", "fraction_significant")


@query("""SELECT sample, round(avg(largest), 6) AS "limit" FROM (SELECT sample, network_id, max(j) AS largest FROM (SELECT sample, network_id, m, n, size, unnest(range(0, CAST(least(size, n) AS BIGINT) + 1)) AS j
FROM (SELECT network_id, CAST(floor(avg(degree)) AS BIGINT) AS size FROM deg GROUP BY ALL) JOIN msize USING (network_id) JOIN ins USING (network_id))
WHERE j < least(size, n) AND (SELECT max(exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(m - size + 1) - lgamma(n - i + 1) - lgamma(m - size - n + i + 1) - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1))) FROM (SELECT unnest(range(greatest(j + 1, size + n - m), CAST(least(size, n) AS BIGINT) + 1)) AS i)) > 0 GROUP BY ALL) GROUP BY ALL""", *RAW, "tb_network", "nsite", "msize", "deg", "tried=real_only", "ins")
def overlap_limits(spark, d):
    return rounded(E.overlap_limits(view(spark, d, "tb_network"), chosen(spark, d)), "limit")


@query("SELECT kinase, " + ", ".join(f"round(max(m) FILTER (sample = '{n}'), 6) AS \"{n}\"" for n in SAMPLES) + " FROM (SELECT sample, kinase, median(p) AS m FROM real GROUP BY ALL) GROUP BY ALL", *REAL)
def enrichment_matrix(spark, d):
    medians = E.median_enrichment(really_enriched(spark, d))
    wide = E.pivot_unique(medians, "kinase", "sample", "median_p", SAMPLES)
    return wide.select("kinase", *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in SAMPLES])


@query("SELECT sample, kinase, round(max(p), 6) AS p, count(*) AS n FROM real GROUP BY ALL", *REAL)
def melted_enrichment(spark, d):
    rows = really_enriched(spark, d)
    wide = rows.groupBy("network_id", "kinase").pivot("sample", SAMPLES).agg(F.first("p"))
    long = V.long_form(wide, {c: c for c in SAMPLES}, ["network_id", "kinase"]).where("value is not null")
    return long.groupBy("sample", "kinase").agg(F.round(F.max("value"), 6).alias("p"), F.count("*").alias("n"))


@query("SELECT sample, accession, site, string_agg(rep, ',' ORDER BY rep) AS reps FROM drawn GROUP BY ALL", *BIAS, "quota", "sited", "drawn")
def random_experiments(spark, d):
    """The replicates that take each site."""
    drawn = R.replicates(view(spark, d, "tb_compendia"), V.stratum_sizes(biased(spark, d)), REPS, SEED)
    return drawn.select("sample", "accession", "site", F.array_join(F.col("reps").cast("array<string>"), ",").alias("reps"))


EXPERIMENTS = [f"{s}:{r}" for s in SAMPLES for r in range(WIDE_REPS)]


@query("SELECT accession, site, " + ", ".join(f"max(CASE WHEN sample || ':' || rep = '{e}' THEN 1 END) AS \"{e}\"" for e in EXPERIMENTS) + " FROM few GROUP BY ALL", *BIAS, "quota", "sited", "few")
def random_experiment_matrix(spark, d):
    drawn = R.draw(view(spark, d, "tb_compendia"), V.stratum_sizes(biased(spark, d)), WIDE_REPS, SEED)
    return R.wide_experiments(drawn, EXPERIMENTS)


# significance

SUMS = """, dist AS (SELECT sample, kinase, p, count(*) AS c FROM {pool} GROUP BY ALL), ranked AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY sample, kinase ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rank FROM dist),
tot AS (SELECT sample, kinase, sum(c) AS total, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM dist GROUP BY ALL),
sums AS (SELECT sample, kinase, {unit}, count(*) AS n, sum(rank) AS rank_sum FROM {pool} JOIN ranked USING (sample, kinase, p) GROUP BY ALL),
stat AS (SELECT sample, kinase, {unit}, n, total, rank_sum - n * (n + 1) / 2 AS u, n * (total - n) / 12 * ((total + 1) - ties / (total * (total - 1))) AS spread FROM sums JOIN tot USING (sample, kinase)),
z AS (SELECT *, CASE WHEN spread > 0 THEN (u - n * (total - n) / 2 - 0.5) / sqrt(spread) END AS z FROM stat) """


def activity(spark, d):
    rows = materialize(enriched(spark, d).withColumn("p", F.round("p", 9)), "enrichment")
    return rows.where("rep = -1").drop("rep"), rows.where("rep >= 0")


@query()
def mann_whitney(spark, d):
    real, random = activity(spark, d)
    background = random.join(S.dropped_rep(random, SEED), ["sample", "kinase", "rep"], "left_anti")
    pool = real.select("sample", "kinase", "p", F.lit(1).alias("unit")).unionByName(background.select("sample", "kinase", "p", F.lit(0).alias("unit")))
    return S.statistics(S.rank_sums(pool, "unit")).where("unit = 1").select("sample", "kinase", "u", F.round("z", 4).alias("z"))


SQL["mann_whitney"] = ctes(*BOTH, "real", "rand", "dropped", "pool").rstrip() + SUMS.format(pool="pool", unit="unit") + "SELECT sample, kinase, CAST(u AS DOUBLE) AS u, round(z, 4) AS z FROM z WHERE unit = 1"


@query()
def leave_one_out_statistics(spark, d):
    return S.null_statistics(activity(spark, d)[1]).select("sample", "kinase", "rep", "u", F.round("z", 4).alias("z"))


SQL["leave_one_out_statistics"] = ctes(*BOTH, "rand").rstrip() + SUMS.format(pool="rand", unit="rep") + "SELECT sample, kinase, rep, CAST(u AS DOUBLE) AS u, round(z, 4) AS z FROM z"


#: Activities by their definition: one-sided normal tails by Simpson's rule, and shares of null statistics that are no larger.
TAIL = "CASE WHEN z IS NULL THEN 1 ELSE least(1, (9 - z) / 3000 * list_sum([(CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (z + i * (9 - z) / 1000) ** 2) FOR i IN range(0, 1001)]) / sqrt(2 * pi())) END"
ACT = (
    SUMS.format(pool="pool", unit="unit").replace(" AS (", "_real AS (").replace("FROM dist", "FROM dist_real").replace("JOIN ranked", "JOIN ranked_real").replace("FROM sums JOIN tot", "FROM sums_real JOIN tot_real").replace("FROM stat", "FROM stat_real")
    + SUMS.format(pool="rand", unit="rep")
    + f""", act AS (SELECT r.sample, r.kinase, CAST(any_value(r.u) AS DOUBLE) AS u, any_value(r.z) AS z, CASE WHEN count(n.sample) = 0 THEN 1 ELSE count(*) FILTER (coalesce(n.z, -99) >= coalesce(r.z, -99)) / count(n.sample) END AS fpr
FROM z_real r LEFT JOIN z n USING (sample, kinase) WHERE r.unit = 1 GROUP BY r.sample, r.kinase), act_p AS (SELECT *, {TAIL} AS mw_p FROM act) """
)
ACTS = (*BOTH, "real", "rand", "dropped", "pool")


def acted(sql: str) -> str:
    return ctes(*ACTS).rstrip() + ACT + sql


CTE["rand_some"] = f"SELECT network_id, kinase, sample, rep, round(p, 9) AS p FROM enr WHERE rep BETWEEN 0 AND {TRIALS - 1}"


def active(spark, d):
    return S.activities(*activity(spark, d), SEED)


@query(acted("SELECT sample, kinase, u, round(z, 4) AS z, round(mw_p, 5) AS mw_p, round(fpr, 6) AS fpr FROM act_p"))
def activities(spark, d):
    return active(spark, d).select("sample", "kinase", "u", F.round("z", 4).alias("z"), F.round("mw_p", 5).alias("mw_p"), F.round("fpr", 6).alias("fpr"))


@query()
def analysis_from_raw(spark, d):
    found = analyse(view(spark, d, "tb_raw"), view(spark, d, "tb_network"), view(spark, d, "tb_compendia"), Params(threshold=THRESHOLD, reps=REPS))
    return found.activities.select("sample", "kinase", F.round("z", 3).alias("z"), F.round("fpr", 6).alias("fpr"))


# the same on serine and threonine alone
CTE |= {f"st_{n}": f"SELECT * FROM tb_{n} WHERE site LIKE 'S%' OR site LIKE 'T%'" for n in ("raw", "compendia", "network")}
for _name, _of in (("coll", "raw"), ("comp", "compendia"), ("nsite", "network"), ("deg", "network"), ("ov", "network")):
    CTE[f"st_{_name}"] = CTE[_name].replace(f"tb_{_of}", f"st_{_of}")
ST = [{"coll": "coll=st_coll", "comp": "comp=st_comp", "nsite": "nsite=st_nsite", "deg": "deg=st_deg", "ov": "ov=st_ov"}.get(n, n) for n in ACTS]
SQL["analysis_from_raw"] = ctes("tb_raw", "tb_compendia", "tb_network", "st_raw", "st_compendia", "st_network", *[n for n in ST if not n.startswith("tb_")]).rstrip() + ACT + "SELECT sample, kinase, round(z, 3) AS z, round(fpr, 6) AS fpr FROM act"


@query(ctes(*BOTH, "real", "rand=rand_some", "dropped", "pool").rstrip() + ACT + "SELECT sample, kinase, CAST(u AS DOUBLE) AS u, round(z, 3) AS z, round(fpr, 6) AS fpr FROM act")
def activities_of_fixed_trials(spark, d):
    return rounded(S.activities(*activity(spark, d), SEED, trials=TRIALS).select("sample", "kinase", "u", F.round("z", 3).alias("z"), "fpr"), "fpr")


NULLS = ", med AS (SELECT sample, kinase, rep, round(median(p), 9) AS s FROM rand GROUP BY ALL), rm AS (SELECT sample, kinase, round(median(p), 9) AS median_p FROM real GROUP BY ALL) "
FACTORS = f"SELECT sample, kinase, list_sort(list(s))[CAST(floor({REPS} * {ALPHA}) AS INT) + 1] AS factor FROM med GROUP BY ALL"


@query(ctes(*BOTH, "real", "rand").rstrip() + NULLS + f", factors AS ({FACTORS}) SELECT sample, kinase, round(median_p, 6) AS median_p, round(count(*) FILTER (s <= median_p) / count(*), 6) AS fpr, round(any_value(factor), 6) AS factor FROM rm JOIN med USING (sample, kinase) JOIN factors USING (sample, kinase) GROUP BY sample, kinase, median_p")
def fpr_at_alpha(spark, d):
    real, random = activity(spark, d)
    return rounded(S.fpr_at_alpha(E.median_enrichment(real), random, ALPHA, places=9), "median_p", "fpr", "factor")


@query(ctes(*BOTH, "real", "rand").rstrip() + NULLS + f", factors AS ({FACTORS}) SELECT sample, kinase, round(median(p), 6) AS median_original, round(median(least(greatest(p / factor * 0.05, 0), 1)), 6) AS median_normalised, count(*) FILTER (p <= factor / 10) AS count_significant, round(avg(CAST(p <= factor / 10 AS INT)), 6) AS fraction_significant FROM (SELECT sample, kinase, round(p, 9) AS p FROM real) JOIN factors USING (sample, kinase) GROUP BY ALL")
def normalised_by_factors(spark, d):
    real, random = activity(spark, d)
    factors = S.fpr_at_alpha(E.median_enrichment(real), random, ALPHA, places=9).select("sample", "kinase", "factor")
    return rounded(E.normalised_summary(E.normalise(real, factors)), "median_original", "median_normalised", "fraction_significant")


@query(acted(f"SELECT sample, count(*) FILTER (fpr < {ALPHA}) AS kinases FROM act GROUP BY sample UNION ALL SELECT NULL, count(DISTINCT kinase) FILTER (fpr < {ALPHA}) FROM act"))
def significant_kinases(spark, d):
    return S.significant_counts(active(spark, d), ALPHA)


@query(acted(f"SELECT sample, string_agg(kinase, ',' ORDER BY rank) AS kinases FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY z DESC NULLS LAST, kinase) AS rank FROM act WHERE fpr < {ALPHA}) WHERE rank <= 5 GROUP BY sample"))
def strongest_kinases(spark, d):
    found = S.ever_significant(S.significant(active(spark, d), ALPHA), ALPHA)
    return S.strongest(found, 5, ALPHA)


@query(acted(f"SELECT kinase, sample, CAST(dense_rank() OVER (ORDER BY sample) * 10 - 5 AS INT) AS x, CAST(dense_rank() OVER (ORDER BY kinase) * 10 - 5 AS INT) AS y, round(-log10(mw_p), 3) AS size, CAST(fpr <= {ALPHA} AS INT) AS colour FROM act_p"))
def dot_table(spark, d):
    return rounded(D.dots(active(spark, d), ALPHA), "size", places=3)


# coverage and study bias


@query("SELECT count(*) AS substrates FROM (SELECT DISTINCT accession, site FROM tb_network)", "tb_network")
def unique_substrates(spark, d):
    return N.substrates(view(spark, d, "tb_network"))


@query("SELECT phospho_type, round(avg(n), 6) AS substrates FROM (SELECT network_id, CASE WHEN site LIKE 'Y%' THEN 'Y' ELSE 'ST' END AS phospho_type, count(*) AS n FROM nsite GROUP BY ALL) GROUP BY ALL", "tb_network", "nsite")
def mean_substrates(spark, d):
    return rounded(N.mean_substrates(view(spark, d, "tb_network")), "substrates")


@query("SELECT CAST(num_compendia AS DOUBLE) AS num_compendia, count(*) AS sites FROM tb_compendia GROUP BY ALL", "tb_compendia")
def study_bias_proteome(spark, d):
    return N.study_bias(view(spark, d, "tb_compendia"))


@query("SELECT CAST(num_compendia AS DOUBLE) AS num_compendia, count(*) AS sites FROM (SELECT DISTINCT accession, site FROM evid) JOIN tb_compendia USING (accession, site) GROUP BY ALL", *RAW, "tb_compendia")
def study_bias_experiment(spark, d):
    return N.study_bias(chosen(spark, d), view(spark, d, "tb_compendia"))


@query("SELECT sample, CAST(num_compendia AS DOUBLE) AS num_compendia, count(*) AS sites FROM (SELECT DISTINCT sample, accession, site FROM evid) JOIN tb_compendia USING (accession, site) GROUP BY ALL", *RAW, "tb_compendia")
def study_bias_samples(spark, d):
    return N.study_bias(chosen(spark, d), view(spark, d, "tb_compendia"), ["sample"])


@query("SELECT round(avg(CAST(n.accession IS NOT NULL AS INT)), 6) AS coverage FROM (SELECT DISTINCT accession, site FROM coll) e LEFT JOIN (SELECT DISTINCT accession, site FROM tb_network) n USING (accession, site)", "tb_raw", "coll", "tb_network")
def experiment_coverage(spark, d):
    return rounded(N.coverage(collapsed(spark, d), view(spark, d, "tb_network")), "coverage")


@query("SELECT sample, round(avg(CAST(n.accession IS NOT NULL AS INT)), 6) AS coverage FROM (SELECT DISTINCT sample, accession, site FROM evid) e LEFT JOIN (SELECT DISTINCT accession, site FROM tb_network) n USING (accession, site) GROUP BY ALL", *RAW, "tb_network")
def sample_coverage(spark, d):
    return rounded(N.coverage(chosen(spark, d), view(spark, d, "tb_network"), ["sample"]), "coverage")


@query("SELECT network_id, round(avg(CAST(e.accession IS NOT NULL AS INT)), 6) AS coverage FROM nsite LEFT JOIN (SELECT DISTINCT accession, site FROM evid) e USING (accession, site) GROUP BY ALL", *RAW, "tb_network", "nsite")
def network_coverage(spark, d):
    return rounded(N.coverage(view(spark, d, "tb_network"), chosen(spark, d), ["network_id"]), "coverage")


@query("SELECT accession, site, count(*) AS networks FROM tb_network WHERE kinase = 'K01' GROUP BY ALL", "tb_network")
def substrate_influence(spark, d):
    return N.influence(view(spark, d, "tb_network"), "K01")


@query("SELECT sample, accession, site, networks FROM evid JOIN (SELECT accession, site, count(*) AS networks FROM tb_network WHERE kinase = 'K01' GROUP BY ALL) USING (accession, site)", *RAW, "tb_network")
def substrate_influence_samples(spark, d):
    return N.influence_by_sample(view(spark, d, "tb_network"), chosen(spark, d), "K01")


@query("""SELECT first, second, round(avg(s), 6) AS shared, round(avg(s / (na + nb - s)), 6) AS jaccard FROM (SELECT a.network_id, a.kinase AS first, b.kinase AS second, a.degree AS na, b.degree AS nb, coalesce(c, 0) AS s FROM deg a JOIN deg b ON a.network_id = b.network_id AND a.kinase <= b.kinase
LEFT JOIN (SELECT x.network_id, x.kinase AS k1, y.kinase AS k2, count(*) AS c FROM tb_network x JOIN tb_network y ON x.network_id = y.network_id AND x.accession = y.accession AND x.site = y.site AND x.kinase <= y.kinase GROUP BY ALL) j ON j.network_id = a.network_id AND k1 = a.kinase AND k2 = b.kinase) GROUP BY ALL""", "tb_network", "deg")
def shared_substrates(spark, d):
    return rounded(N.shared_substrates(view(spark, d, "tb_network")), "shared", "jaccard")


@query("SELECT network_id, count(*) AS edges, count(DISTINCT kinase) AS kinases, max(per_kinase) AS largest, max(per_site) AS fullest FROM (SELECT *, count(*) OVER (PARTITION BY network_id, kinase) AS per_kinase, count(*) OVER (PARTITION BY network_id, accession, site) AS per_site FROM tb_network) GROUP BY ALL", "tb_network")
def network_profile(spark, d):
    return N.profile(view(spark, d, "tb_network"))


# trees


def _gaps(cells: str) -> str:
    return f"SELECT x.item AS a, y.item AS b, sqrt(sum((x.v - y.v) * (x.v - y.v))) AS d FROM ({cells}) x JOIN ({cells}) y ON x.c = y.c AND x.item < y.item GROUP BY ALL"


def _tree(method: str) -> str:
    """Merging one pair at a time over `gap`: rows of pairs with what is kept of their distances, and rows of leaves with their paths."""
    height, kept = ("total / many", "sum(total)") if method in ("average", "ward") else ("total", "min(total)")
    start, pairs, gained = "d", "st WHERE pair", "total"
    if method == "ward":
        # squared distances between clusters on rows of pairs, and within each on its leaves
        each = "(SELECT b AS k, count(*) AS n, max(total) AS w FROM st WHERE NOT pair GROUP BY b)"
        start, pairs, gained = "d * d", f"st JOIN {each} u ON a = u.k JOIN {each} v ON b = v.k WHERE pair", "CASE WHEN NOT pair AND b IN (lo, hi) THEN (SELECT sum(w) FROM (SELECT max(total) AS w FROM st WHERE NOT pair AND b IN (lo, hi) GROUP BY b)) + (SELECT max(total) FROM st WHERE pair AND a = lo AND b = hi) ELSE total END"
        height = f"sqrt(greatest(round(2 * many / (u.n + v.n) * (total / many - u.w / (u.n * u.n) - v.w / (v.n * v.n)), {C.DIGITS}), 0))"
    return f"""WITH RECURSIVE st AS (SELECT 0 AS step, TRUE AS pair, a, b, {start} AS total, 1 AS many, '' AS path, CAST(-1 AS DOUBLE) AS made FROM gap
    UNION ALL SELECT 0, FALSE, i, i, 0, 1, '', CAST(-1 AS DOUBLE) FROM (SELECT a AS i FROM gap UNION SELECT b FROM gap)
    UNION ALL SELECT step, pair, a, b, {kept}, CAST(sum(many) AS INT), path, made FROM (
        SELECT step + 1 AS step, pair, CASE WHEN pair THEN least(na, nb) ELSE a END AS a, CASE WHEN pair THEN greatest(na, nb) ELSE nb END AS b, {gained} AS total, many,
            CASE WHEN NOT pair AND b IN (lo, hi) THEN (CASE WHEN (b = lo) = lo_left THEN '0' ELSE '1' END) || path ELSE path END AS path, CASE WHEN NOT pair AND b IN (lo, hi) THEN h ELSE made END AS made
        FROM (SELECT *, CASE WHEN a = hi THEN lo ELSE a END AS na, CASE WHEN b = hi THEN lo ELSE b END AS nb FROM st CROSS JOIN (
            SELECT lo, hi, h, (SELECT max(made) FROM st WHERE NOT pair AND b = lo) < (SELECT max(made) FROM st WHERE NOT pair AND b = hi) OR (SELECT max(made) FROM st WHERE NOT pair AND b = lo) = (SELECT max(made) FROM st WHERE NOT pair AND b = hi) AS lo_left
            FROM (SELECT x.a AS lo, x.b AS hi, x.h AS h FROM (SELECT min({{'h': round({height}, {C.DIGITS}), 'a': a, 'b': b}}) AS x FROM {pairs})) WHERE h IS NOT NULL)))
        WHERE NOT pair OR a <> b GROUP BY step, pair, a, b, path, made)
    SELECT a AS item, CAST(row_number() OVER (ORDER BY path, a) AS INT) AS position FROM st WHERE NOT pair AND step = (SELECT max(step) FROM st)"""


CTE["simrow"] = "SELECT first AS item, second AS c, jaccard AS v FROM sim UNION ALL SELECT second, first, jaccard FROM sim UNION ALL SELECT DISTINCT sample, sample, CAST(1 AS DOUBLE) FROM evid"
CTE["medrow"] = "SELECT kinase AS item, sample AS c, round(median(p), 6) AS v FROM real GROUP BY ALL"


def median_cells(spark, d):
    return rounded(E.median_enrichment(really_enriched(spark, d)), "median_p")


@query(f"SELECT a, b, round(d, 6) AS d FROM ({_gaps('SELECT * FROM medrow')})", *REAL, "medrow")
def kinase_distances(spark, d):
    return rounded(C.distances(median_cells(spark, d), "kinase", "sample", "median_p"), "d")


CTE["gap"] = _gaps("SELECT * FROM medrow")
CTE["simgap"] = _gaps("SELECT * FROM simrow")


@query(f"SELECT * FROM ({_tree('single')})", *REAL, "medrow", "gap")
def kinase_order(spark, d):
    return C.ordered(materialize(median_cells(spark, d), "medians"), "kinase", "sample", "median_p", "single")


@query(f"SELECT * FROM ({_tree('ward')})", *REAL, "medrow", "gap")
def kinase_order_ward(spark, d):
    return C.ordered(materialize(median_cells(spark, d), "medians"), "kinase", "sample", "median_p", "ward")


@query(f"SELECT * FROM ({_tree('average')})", *RAW, "sim", "simrow", "gap=simgap")
def sample_order(spark, d):
    rows = materialize(chosen(spark, d), "evidence")
    near, whole = T.jaccard(rows), rows.select("sample").distinct()
    cells = near.union(near.select("second", "first", "jaccard")).union(whole.select("sample", "sample", F.lit(1.0)))
    return C.ordered(materialize(cells, "cells"), "first", "second", "jaccard")


# pruning and stored nulls


@query("SELECT count(DISTINCT (accession, site)) AS sites, count(DISTINCT kinase) AS kinases, CAST(floor(count(DISTINCT (accession, site)) * 10 / count(DISTINCT kinase)) AS BIGINT) AS largest, CAST(floor(count(DISTINCT (accession, site)) * 10 / count(DISTINCT kinase) * 0.2) AS BIGINT) AS low, CAST(floor(count(DISTINCT (accession, site)) * 10 / count(DISTINCT kinase) * 0.4) AS BIGINT) AS high FROM tb_weight WHERE site NOT LIKE 'Y%'", "tb_weight")
def feasible_size(spark, d):
    return N.feasible_size(V.of_type(view(spark, d, "tb_weight"), "ST"), 10)


@query("SELECT accession, site, kinase, round(weight, 4) AS weight FROM tb_weight WHERE site NOT LIKE 'Y%' AND weight > 0 AND weight >= 20000", "tb_weight")
def weighted_sites(spark, d):
    """Weights read from a wide table of texts, in which '-' stands for an edge that is none."""
    long = view(spark, d, "tb_weight").withColumn("weight", F.when(F.col("weight") >= 20000, F.col("weight").cast("string")).otherwise("-"))
    wide = long.groupBy("accession", "site").pivot("kinase", [f"K{k:02d}" for k in range(20)]).agg(F.first("weight"))
    return rounded(N.weights(wide, "ST"), "weight", places=4)


@query("SELECT num_compendia, CAST(floor(n / total * m) AS BIGINT) AS sites FROM (SELECT num_compendia, count(*) AS n, (SELECT count(*) FROM tb_compendia) AS total FROM tb_compendia GROUP BY ALL) CROSS JOIN (SELECT min(m) AS m FROM (SELECT m, sum(floor(n / total * m)) AS s FROM (SELECT count(*) AS n, (SELECT count(*) FROM tb_compendia) AS total FROM tb_compendia GROUP BY num_compendia) CROSS JOIN (SELECT unnest(range(50, 400)) AS m) GROUP BY m) WHERE s >= 50)", "tb_compendia")
def compendia_quotas(spark, d):
    counts = V.unique_compendia(view(spark, d, "tb_compendia")).groupBy("num_compendia").count()
    # one row for each number of compendia
    quota = N.compendia_quota({r[0]: r[1] for r in counts.orderBy("num_compendia").collect()}, 50)
    return spark.createDataFrame(list(quota.items()), "num_compendia int, sites bigint")


@query()
def pruned_networks(spark, d):
    long = V.of_type(view(spark, d, "tb_weight"), "ST")
    return N.prune(long, view(spark, d, "tb_compendia"), 50, 50, 10)


@query()
def pruned_network_hashes(spark, d):
    return N.network_hash(pruned_networks(spark, d))


@query("SELECT sample, size, CASE WHEN size >= 50 THEN (SELECT arg_min(s, abs(s - size)) FROM (VALUES (62), (96), (150), (233), (363), (566), (883)) v(s) WHERE abs(s - size) / size < 0.25) END AS matched FROM (SELECT 'U' || (user_id % 40) AS sample, count(*) AS size FROM events GROUP BY ALL)")
def nearest_stored_size(spark, d):
    sizes = table(spark, d, "events").groupBy(F.concat(F.lit("U"), F.col("user_id") % 40).alias("sample")).agg(F.count("*").alias("size"))
    return R.nearest_size(sizes, R.ladder(50, 1000))


@query("SELECT sample, CASE WHEN floor(class_2) > 60 THEN '0_30_70' ELSE '0_50_50' END AS mix FROM (SELECT sample, count(*) FILTER (compendia_class = 2) * 100 / count(*) AS class_2 FROM evc WHERE compendia_class IS NOT NULL GROUP BY ALL)", *BIAS)
def null_mix(spark, d):
    return V.class_shares(biased(spark, d)).select("sample", R.mix(F.lit("Y"), F.col("class_2")).alias("mix"))


STORED = R.ladder(500, 20000)


@query(f"SELECT sample, CASE WHEN matched IS NULL THEN 'drawn' ELSE 'stored' END AS source, matched, '0_30_70' AS mix FROM (SELECT sample, CASE WHEN size >= 50 THEN (SELECT arg_min(s, abs(s - size)) FROM (VALUES {', '.join(f'({s})' for s in STORED)}) v(s) WHERE abs(s - size) / size < 0.25) END AS matched FROM (SELECT sample, count(*) AS size FROM evc GROUP BY ALL)) WHERE sample IN (SELECT sample FROM evc WHERE compendia_class IS NOT NULL)", *BIAS)
def null_routing(spark, d):
    rows = biased(spark, d)
    return R.route(V.sizes(rows), V.class_shares(rows), STORED, "ST")


LADDER = R.ladder(50, 1000)
MIXES = {"0_30_70": [0, 30, 70], "0_50_50": [0, 50, 50]}
# sizes of the ladder and each class's part of them, cut to whole sites
CTE["stored_quota"] = "SELECT concat(mix, '/', size) AS sample, stratum, CAST(floor(size * share / 100) AS BIGINT) AS quota FROM (VALUES " + ", ".join(f"('{m}', {k}, {s})" for m, f in MIXES.items() for k, s in enumerate(f)) + ") v(mix, stratum, share) CROSS JOIN (VALUES " + ", ".join(f"({s})" for s in LADDER) + ") z(size)"
CTE["stored_drawn"] = _drawn("(SELECT * FROM stored_quota WHERE quota > 0)", REPS)


@query("SELECT split_part(sample, '/', 1) AS mix, CAST(split_part(sample, '/', 2) AS INT) AS size, rep, accession, site FROM stored_drawn", "tb_compendia", "comp", "stored_quota", "sited", "stored_drawn")
def stored_null_experiments(spark, d):
    wanted = R.stored_quotas(LADDER, MIXES, spark)
    drawn = R.draw(view(spark, d, "tb_compendia"), wanted.select("sample", "stratum", "quota"), REPS, SEED)
    return drawn.join(F.broadcast(wanted.select("sample", "mix", "size").distinct()), "sample").select("mix", "size", "rep", "accession", "site")


# the same on serine and threonine, enriched
CTE["stored_tried"] = "SELECT sample, rep, accession, site FROM stored_drawn"


@query("SELECT split_part(sample, '/', 1) AS mix, CAST(split_part(sample, '/', 2) AS INT) AS size, network_id, kinase, rep, frequency, round(p, 4) AS p FROM enr", "tb_compendia", "tb_network", "st_compendia", "st_network", "comp=st_comp", "stored_quota", "sited", "stored_drawn", "nsite=st_nsite", "msize", "deg=st_deg", "tried=stored_tried", "ins", "ov=st_ov", "grid", "num", "enr")
def pregenerated_enrichment(spark, d):
    made = pregenerate(view(spark, d, "tb_network"), view(spark, d, "tb_compendia"), Params(reps=REPS, seed=SEED), LADDER, MIXES)
    return made.select("mix", "size", "network_id", "kinase", "rep", "frequency", F.round("p", 4).alias("p"))


@query(SQL["pregenerated_enrichment"])
def resumed_null_store(spark, d):
    """The same experiments from a store that was filled in two runs: some networks with the smaller sizes, then the others and all sizes."""
    store, comp, params = NetworkStore(spark, work_path(spark, "store")), view(spark, d, "tb_compendia"), Params(reps=REPS, seed=SEED)
    networks = view(spark, d, "tb_network")
    store.add_networks(networks.where("network_id < 6"))
    fill_nulls(store, comp, params, LADDER[:3], MIXES)
    store.add_networks(networks.where("network_id >= 6"))
    fill_nulls(store, comp, params, LADDER, MIXES)
    return store.nulls().select("mix", "size", "network_id", "kinase", "rep", "frequency", F.round("p", 4).alias("p"))


@query("SELECT network_id, accession, site, kinase FROM tb_network", "tb_network")
def saved_networks(spark, d):
    """Networks as they come back from a store, by way of a folder of tables for other tools."""
    store, folder = NetworkStore(spark, work_path(spark, "store")), work_path(spark, "networks")
    store.add_networks(view(spark, d, "tb_network"))
    save_networks(store.networks(), folder, "tsv")
    return read_networks(spark, folder)


# mapping


@query("SELECT DISTINCT l_orderkey, 'P' || l_partkey AS accession FROM lineitem")
def strip_isoforms(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("P"), "l_partkey", F.lit("-"), F.col("l_suppkey") % 3).alias("a"))
    return rows.select("l_orderkey", A.strip_isoform(F.col("a")).alias("accession")).distinct()


@query("SELECT doc_id, unnest(['D' || doc_id, 'E' || lang, 'F' || source]) AS accession FROM documents")
def exploded_accessions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("D"), "doc_id", F.lit(";E"), "lang", F.lit(";F"), "source").alias("accession"))
    return M.explode_list(rows, "accession")


@query("SELECT accession, c || place AS site, CASE WHEN substr(sequence, place, 1) = c THEN substr(sequence, greatest(1, place - 7), place - greatest(1, place - 7)) || lower(c) || substr(sequence, place + 1, 7) END AS aligned, substr(sequence, place, 1) = c AS valid FROM (SELECT accession, sequence, unnest(range(1, length(sequence) + 1)) AS place, substr('STY', CAST(place % 3 AS INT) + 1, 1) AS c FROM tb_protein) WHERE substr(sequence, place, 1) IN ('S', 'T', 'Y')", "tb_protein")
def aligned_peptides(spark, d):
    """Each S, T and Y of each protein under the residue that its place stands for, which is the right one for a third of them."""
    rows = peptides(spark, d)
    site = F.concat(F.substr(F.lit("STY"), F.col("place") % 3 + 1, F.lit(1)), F.col("place").cast("string"))
    return rows.select("accession", site.alias("site"), P.aligned_peptide(F.col("sequence"), site).alias("aligned"), P.valid_site(F.col("sequence"), site).alias("valid"))


PARTS = ", parts AS (SELECT accession, string_split(sequence, 'TION') AS s FROM tb_sequence WHERE sequence <> ''), each AS (SELECT accession, s, unnest(range(1, len(s))) AS i FROM parts) "


@query()
def peptide_occurrences(spark, d):
    rows = view(spark, d, "tb_sequence")
    return rows.select("accession", F.explode(P.occurrences(F.col("sequence"), F.lit("TION"))).alias("place"))


SQL["peptide_occurrences"] = ctes("tb_sequence").rstrip() + PARTS + "SELECT accession, CAST(1 + (i - 1) * 4 + list_sum([length(x) FOR x IN s[1:i]]) AS INT) AS place FROM each"


@query("SELECT accession, count(*) FILTER (c IN ('S', 'T', 'Y')) AS sites FROM (SELECT accession, unnest(string_split(substr(sequence, 1, length(sequence)), '')) AS c FROM tb_sequence WHERE sequence <> '') GROUP BY accession HAVING count(*) FILTER (c IN ('S', 'T', 'Y')) > 0", "tb_sequence")
def expanded_modifications(spark, d):
    """Every S, T and Y of each sequence as a modification of its own."""
    rows = view(spark, d, "tb_sequence").withColumn("peptide", F.translate("sequence", "STY", "sty"))
    return rows.select("accession", F.explode(P.modified_positions(F.col("peptide"))).alias("at")).groupBy("accession").agg(F.count("*").alias("sites"))


def peptides(spark, d, proteins=None):
    """(accession, place, peptide, sequence): the 15 residues around each S, T and Y of each protein, which is in lower case."""
    rows = (view(spark, d, "tb_protein") if proteins is None else proteins).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "accession")
    places = F.filter(F.transform(F.split("sequence", ""), lambda c, i: F.when(c.isin("S", "T", "Y"), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("place", F.explode(places))
    return rows.select("accession", "place", P.around(F.col("sequence"), F.col("place")).alias("peptide"), "sequence")


PEPTIDES = ", spots AS (SELECT * FROM (SELECT accession, sequence, unnest(range(1, length(sequence) + 1)) AS place FROM tb_protein) WHERE substr(sequence, place, 1) IN ('S', 'T', 'Y')), pep AS (SELECT accession, place, sequence, substr(sequence, greatest(1, place - 7), place - greatest(1, place - 7)) AS ahead, substr(sequence, place, 1) AS residue, substr(sequence, place + 1, 7) AS behind, ahead || lower(residue) || behind AS peptide FROM spots) "
FOUND = "residue || (instr(sequence, upper(peptide)) + length(ahead))"


@query(ctes("tb_protein").rstrip() + PEPTIDES + f"SELECT accession, place, {FOUND} AS site FROM pep")
def site_numbers(spark, d):
    return peptides(spark, d).select("accession", "place", P.site_number(F.col("sequence"), F.col("peptide")).alias("site"))


#: Ways to mark a residue, their form, and whether the peptide comes out with the residue in lower case, in upper case, or as null; a sign between two
#: residues that may be modified belongs to the one before it.
MARKS = [
    ("{s}", "acceptable", "lower"), ("p{S}", "lowercase_p", "lower"), ("{S}*", "annotated", "lower"), ("{S}(0.98)", "maxquant_perc", "lower"), ("{S}(UniMod_21)", "unimod", "lower"), ("{S}", "uppercase", "upper"),
    ("{S}(ph)", "annotated", "lower"), ("{S}[Phospho]", "annotated", "lower"), ("^{S}", "annotated", "next"), ("{S}(Phospho)", "annotated", "lower"), ("[ph]{S}", "annotated", "next"), ("{S}(2)", "unrecognized", "null"), ("{S}(0.10)", "maxquant_perc", "upper"), ("{S}*#", "annotated", "null"),
]


def marked(spark, d):
    """Each peptide with its residue marked in one of the ways, in turn."""
    rows = peptides(spark, d)
    at = F.instr(F.translate("peptide", "sty", "***"), "*")
    left, c, right = F.substr("peptide", F.lit(1), at - 1), F.substr("peptide", at, F.lit(1)), F.substr("peptide", at + 1)
    ways = []
    for way, _, _ in MARKS:
        before, upper, behind = way.partition("{S}") if "{S}" in way else way.partition("{s}")
        ways.append(F.concat(left, F.lit(before), F.upper(c) if upper == "{S}" else c, F.lit(behind), right))
    n = (F.col("place") % len(MARKS)).cast("int")
    # dealt anew, so that the choice is made once and not wherever the peptide is looked at
    return rows.select("accession", "place", F.get(F.array(*ways), n).alias("peptide")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "accession", "place")


def _by_mark(values: list[str]) -> str:
    return "CASE place % " + str(len(MARKS)) + " " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


FORM = _by_mark([f"'{form}'" for _, form, _ in MARKS])
CAME = _by_mark([{"lower": "peptide", "upper": "upper(peptide)", "null": "NULL", "next": "CASE WHEN ahead[-1] IN ('S', 'T', 'Y') THEN ahead[:-2] || lower(ahead[-1]) || residue || behind ELSE peptide END"}[out] for _, _, out in MARKS])


@query(ctes("tb_protein").rstrip() + PEPTIDES + f"SELECT accession, place, {FORM} AS form, {CAME} AS peptide FROM pep")
def formatted_peptides(spark, d):
    return marked(spark, d).select("accession", "place", P.peptide_format(F.col("peptide")).alias("form"), P.formatted(F.col("peptide")).alias("peptide"))


@query(ctes("tb_protein").rstrip() + PEPTIDES + f"SELECT {FORM} AS value, count(*) AS n FROM pep GROUP BY value ORDER BY n DESC, min(place), min(accession) LIMIT 1")
def common_peptide_form(spark, d):
    rows = marked(spark, d).withColumn("form", P.peptide_format(F.col("peptide")))
    return M.most_common(rows, "form", "place")


#: How identifiers of each kind are made from a number, and their kinds.
IDS = [("P{n}", "UniProtKB"), ("N{n}_HUMAN", "UniProtKB_AC-ID"), ("ENSG{n}_HUMAN", "UniProtKB_AC-ID"), ("ENSP{n}", "Ensembl_Protein"), ("ENST{n}", "Ensembl_Transcript"), ("ENSG{n}", "Ensembl"), ("NP_{n}", "RefSeq_Protein"), ("XM_{n}", "RefSeq_Nucleotide"), ("gi|{n}", "GI_number"), ("UPI{n}", "UniParc"), ("UniRef50_P{n}", "UniRef50"), ("UniRef90_P{n}", "UniRef90"), ("UniRef100_P{n}", "UniRef100"), ("CCDS{n}", "CCDS"), ("R{n}-2", "genename/unrecognized"), ("O{n}-2", "UniProtKB"), ("GENE{n}", "genename/unrecognized"), ("NR_{n}", "genename/unrecognized")]


def _made(text: str) -> str:
    head, tail = text.split("{n}")
    return f"concat('{head}', lpad({{number}}, 5, '0'), '{tail}')"


_ID = "CASE CAST(l_partkey % " + str(len(IDS)) + " AS INT) " + " ".join(f"WHEN {k} THEN {_made(text)}" for k, (text, _) in enumerate(IDS)) + " END"


@query(f"SELECT DISTINCT {_ID.format(number='CAST(l_partkey % 100000 AS VARCHAR)')} AS id, CASE CAST(l_partkey % {len(IDS)} AS INT) {' '.join(f'WHEN {k} THEN ' + repr(kind) for k, (_, kind) in enumerate(IDS))} END AS kind FROM lineitem")
def accession_types(spark, d):
    ids = table(spark, d, "lineitem").select(F.expr(_ID.format(number="CAST(l_partkey % 100000 AS STRING)")).alias("id")).distinct()
    return ids.select("id", A.accession_type(F.col("id")).alias("kind"))


@query(f"""SELECT kind, count(*) AS ids, count(*) FILTER (known) AS converted, round(avg(CAST(known AS INT)), 6) AS share FROM (SELECT kind, kind = 'UniProtKB' OR ((kind IN ('Ensembl', 'Ensembl_Protein') OR id LIKE 'GENE%') AND CAST(regexp_extract(id, '[0-9]{{5}}') AS INT) % 3 <> 0) AS known FROM ({SQL["accession_types"]})) GROUP BY kind""")
def converted_by_kind(spark, d):
    """Mixed lists of identifiers; proteins lead to genes, genes to names, and two names of three to an accession."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.expr(_ID.format(number="CAST(l_partkey % 100000 AS STRING)")).alias("id"))
    lists = rows.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("id")), ";").alias("ids"))
    n = F.regexp_extract("id", "[0-9]{5}", 0)
    step = lambda kind, start, to: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(start), n).alias("from_id"), F.concat(F.lit(to), n).alias("to_id"))
    steps = F.array(step("Ensembl_Protein", "ENSP", "ENSG"), step("Ensembl", "ENSG", "GENE"), step("genename/unrecognized", "GENE", "P"))
    maps = rows.select(F.explode(steps).alias("s")).select("s.*").distinct().where("kind <> 'genename/unrecognized' or cast(substr(from_id, 5) as int) % 3 <> 0")
    return rounded(A.convert_by_kind(lists, "ids", maps)[1], "share")


@query("SELECT DISTINCT 'E' || l_orderkey % 500 AS from_id, 'P' || p.l_partkey AS accession FROM lineitem JOIN (SELECT DISTINCT l_suppkey % 50 AS g, l_partkey FROM lineitem WHERE l_partkey % 7 = 0) p ON l_suppkey % 50 = p.g WHERE l_linenumber = 1")
def composed_ids(spark, d):
    """Identifiers to accessions through gene names."""
    rows = table(spark, d, "lineitem").withColumn("gene", F.concat(F.lit("G"), F.col("l_suppkey") % 50))
    to_gene = rows.where("l_linenumber = 1").select(F.concat(F.lit("E"), F.col("l_orderkey") % 500).alias("from_id"), "gene").distinct()
    return A.compose_maps(to_gene, rows.where("l_partkey % 7 = 0").select("gene", F.concat(F.lit("P"), "l_partkey").alias("accession")).distinct())


#: Columns of lists: how often they are parted by `;` and by `,`.
LISTED = {"semicolons": (2, 5), "commas": (7, 3), "single": (11, 12)}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, CASE WHEN greatest(a, b) > 0.1 THEN CASE WHEN a >= b THEN ';' ELSE ',' END END AS sep FROM (SELECT avg(CAST(l_partkey % {x} = 0 AS INT)) AS a, avg(CAST(l_partkey % {x} <> 0 AND l_partkey % {y} = 0 AS INT)) AS b FROM lineitem)" for n, (x, y) in LISTED.items()))
def list_separators(spark, d):
    id_, found = F.concat(F.lit("P"), F.col("l_partkey").cast("string")), []
    for name, (x, y) in LISTED.items():
        parted = F.when(F.col("l_partkey") % x == 0, F.concat(id_, F.lit(";Q"))).when(F.col("l_partkey") % y == 0, F.concat(id_, F.lit(",Q"))).otherwise(id_)
        found.append((name, A.separator(table(spark, d, "lineitem").select(parted.alias("ids")), "ids")))
    return spark.createDataFrame(found, "name string, sep string")


@query("SELECT l_orderkey, string_agg(a, ';' ORDER BY a) AS accession FROM (SELECT DISTINCT l_orderkey, 'Q' || (l_suppkey % 7) AS a FROM lineitem WHERE l_suppkey % 7 < 5) GROUP BY ALL UNION ALL SELECT l_orderkey, NULL FROM lineitem GROUP BY ALL HAVING min(l_suppkey % 7) >= 5")
def converted_ids(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("gene"), F.col("l_suppkey") % 7))), ";").alias("genes"))
    id_map = spark.createDataFrame([(f"gene{i}", f"Q{i}") for i in range(5)], "from_id string, accession string")
    return A.convert(rows, "genes", id_map).select("l_orderkey", "accession")


def mapped(spark, d):
    """Every peptide of every protein: of each tenth document under an unknown accession, at each eleventh place with residues that the protein has not."""
    # cut from the texts once: peptides, sequences and compendia are read from it
    known = materialize(view(spark, d, "tb_protein"), "proteins")
    accession = F.when(F.regexp_extract("accession", "^D([0-9]+)", 1).cast("long") % 10 == 0, F.concat(F.lit("X"), "accession")).otherwise(F.concat("accession", F.lit("-2")))
    peptide = F.when(F.col("place") % 11 == 0, F.concat(F.lit("123456789"), "peptide")).otherwise(F.col("peptide"))
    raw = peptides(spark, d, known).select(accession.alias("accession"), F.regexp_replace(peptide, "^123456789", "XQXQXQXQX").alias("peptide"), F.length("sequence").cast("double").alias("value"))
    places = known.select("accession", F.posexplode(F.split("sequence", "")).alias("at", "residue")).where("residue in ('S', 'T', 'Y')").withColumn("place", F.col("at") + 1)
    sites = places.where("place % 5 <> 1").select("accession", F.concat("residue", F.col("place").cast("string")).alias("site"), (F.col("place") % 6).cast("int").alias("num_compendia"))
    return M.map_experiment(raw, known.select("accession", "sequence"), sites)


#: What the same rows come to, from the definitions.
MAPPED = PEPTIDES + f""", tried AS (SELECT accession, place, sequence, CASE WHEN place % 11 = 0 THEN 'XQXQXQXQX' || ahead ELSE ahead END AS ahead, residue, behind, CAST(regexp_extract(accession, '^D([0-9]+)', 1) AS BIGINT) % 10 = 0 AS unknown FROM pep),
got AS (SELECT *, upper(ahead || residue || behind) AS whole, upper(ahead) || lower(residue) || upper(behind) AS peptide, instr(sequence, whole) + length(ahead) AS n FROM tried),
verdict AS (SELECT *, residue || n AS site, CASE WHEN unknown THEN '{M.NO_SEQUENCE}' WHEN instr(sequence, whole) = 0 THEN '{M.NO_ALIGNMENT}' WHEN n % 5 = 1 THEN '{M.NO_COMPENDIA}' ELSE 'mapped' END AS reason FROM got) """


@query(ctes("tb_protein").rstrip() + MAPPED + "SELECT DISTINCT accession, site, peptide, substr(sequence, greatest(1, n - 7), n - greatest(1, n - 7)) || lower(residue) || substr(sequence, n + 1, 7) AS aligned, CAST(length(sequence) AS DOUBLE) AS value, CAST(n % 6 AS INT) AS num_compendia, CASE WHEN n % 6 < 1 THEN 0 WHEN n % 6 <= 3 THEN 1 ELSE 2 END AS compendia_class FROM verdict WHERE reason = 'mapped'")
def mapped_experiment(spark, d):
    return mapped(spark, d).rows.select("accession", "site", "peptide", "aligned", "value", "num_compendia", "compendia_class")


@query(ctes("tb_protein").rstrip() + MAPPED + f"SELECT reason, count(*) AS n FROM (SELECT DISTINCT reason, accession, peptide, CASE WHEN reason = '{M.NO_COMPENDIA}' THEN site END AS site FROM verdict WHERE reason <> 'mapped') GROUP BY reason")
def mapping_rejects(spark, d):
    return mapped(spark, d).rejects.select("reason", "accession", "peptide", "site").distinct().groupBy("reason").agg(F.count("*").alias("n"))


@query(ctes("tb_protein").rstrip() + MAPPED + f"SELECT reason, sites, round(sites / sum(sites) OVER (), 6) AS share, peptides FROM (SELECT reason, count(DISTINCT (accession, CASE WHEN reason IN ('mapped', '{M.NO_COMPENDIA}') THEN site ELSE '' END)) AS sites, count(DISTINCT (accession, peptide)) AS peptides FROM verdict GROUP BY reason)")
def mapping_statistics(spark, d):
    return rounded(M.mapping_statistics(mapped(spark, d)), "share")


OCCURS = ", parts AS (SELECT *, string_split(sequence, upper(peptide)) AS s, place + CASE WHEN place % 3 = 0 THEN 0 ELSE 9 END AS g FROM pep WHERE place % 2 = 0), near AS (SELECT *, list_min([{'d': abs(CAST(1 + (i - 1) * length(peptide) + list_sum([length(x) FOR x IN s[1:i]]) + length(ahead) AS BIGINT) - g), 'n': CAST(1 + (i - 1) * length(peptide) + list_sum([length(x) FOR x IN s[1:i]]) + length(ahead) AS BIGINT)} FOR i IN range(1, len(s))]).n AS n FROM parts)"
UNKNOWN = "CAST(regexp_extract(accession, '^D([0-9]+)', 1) AS BIGINT) % 10 = 0"


@query(ctes("tb_protein").rstrip() + PEPTIDES + OCCURS + f"""
SELECT CASE WHEN {UNKNOWN} THEN 'X' || accession ELSE accession END AS accession, place, CASE WHEN {UNKNOWN} THEN residue || g ELSE residue || n END AS site, CASE WHEN {UNKNOWN} THEN 'no_sequence' WHEN n = g THEN 'ok' ELSE 'changed' END AS status FROM near
UNION ALL SELECT CASE WHEN {UNKNOWN} THEN 'X' || accession ELSE accession END, place, CASE WHEN place % 13 > 0 THEN substr('STY', CAST(place % 3 AS INT) + 1, 1) || place END,
CASE WHEN {UNKNOWN} THEN 'no_sequence' WHEN place % 13 = 0 THEN 'not_found' WHEN substr('STY', CAST(place % 3 AS INT) + 1, 1) = residue THEN 'ok' ELSE 'mismatch' END FROM pep WHERE place % 2 = 1""")
def checked_sites(spark, d):
    """All five outcomes: half of the sites come with a peptide and a place that is often wrong, half alone and under a residue that is often wrong."""
    known = view(spark, d, "tb_protein").select("accession", "sequence")
    accession = F.when(F.regexp_extract("accession", "^D([0-9]+)", 1).cast("long") % 10 == 0, F.concat(F.lit("X"), "accession")).otherwise(F.col("accession"))
    rows = peptides(spark, d).select(accession.alias("accession"), "place", "peptide", F.substr("sequence", "place", F.lit(1)).alias("residue"))
    moved = F.col("place") + F.when(F.col("place") % 3 == 0, 0).otherwise(9)
    both = rows.where("place % 2 = 0").withColumn("site", F.concat("residue", moved.cast("string")))
    alone = rows.where("place % 2 = 1").withColumn("site", F.when(F.col("place") % 13 > 0, F.concat(F.substr(F.lit("STY"), F.col("place") % 3 + 1, F.lit(1)), F.col("place").cast("string"))))
    out = [M.align(both, known, has_site=True), M.align(alone, known, has_peptide=False, has_site=True)]
    return out[0].unionByName(out[1]).select("accession", "place", "site", "status")


@query("SELECT CASE WHEN site LIKE 'Y%' THEN 'Y' ELSE 'ST' END AS phospho_type, sample, count(DISTINCT (accession, site)) AS sites FROM tb_raw WHERE value IS NOT NULL GROUP BY ALL", "tb_raw")
def measured_sites(spark, d):
    return M.sites_by_type(view(spark, d, "tb_raw"))


@query("SELECT accession, site, CAST(count(DISTINCT e) FILTER (e < 4) AS BIGINT) AS num_compendia, CASE WHEN count(DISTINCT e) FILTER (e < 4) < 1 THEN 0 WHEN count(DISTINCT e) FILTER (e < 4) <= 3 THEN 1 ELSE 2 END AS compendia_class FROM (SELECT 'P' || l_partkey AS accession, substr('STY', CAST(l_suppkey % 3 AS INT) + 1, 1) || l_linenumber AS site, l_orderkey % 6 AS e FROM lineitem) GROUP BY ALL")
def phosphoproteome(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("accession"), F.concat(F.substr(F.lit("STY"), (F.col("l_suppkey") % 3).cast("int") + 1, F.lit(1)), "l_linenumber").alias("site"), F.concat(F.lit("C"), F.col("l_orderkey") % 6).alias("e"))
    records = rows.groupBy("accession", "site").agg(F.array_join(F.collect_set("e"), ";").alias("evidence"))
    return N.phosphoproteome(records, spark.createDataFrame([(f"C{i}",) for i in range(4)], "id string"))


# sets, reshaping, presentation


@query("SELECT accession, site FROM (SELECT DISTINCT accession, site FROM tb_raw WHERE sample = 'data:AF') INTERSECT SELECT accession, site FROM tb_raw WHERE sample = 'data:NO'", "tb_raw")
def common_sites(spark, d):
    return V.shared_sites(view(spark, d, "tb_raw"), "data:AF", "data:NO")


@query("SELECT accession, site FROM tb_raw WHERE sample = 'data:NF' EXCEPT SELECT accession, site FROM tb_raw WHERE sample = 'data:NO'", "tb_raw")
def lost_sites(spark, d):
    return V.only_sites(view(spark, d, "tb_raw"), "data:NF", "data:NO")


@query("SELECT accession, site, " + ", ".join(f"max(value) FILTER (sample = '{n}') AS \"{n}\"" for n in SAMPLES) + " FROM coll GROUP BY ALL", "tb_raw", "coll")
def wide_values(spark, d):
    return V.wide_form(collapsed(spark, d), SAMPLES)


@query("SELECT sample, " + ", ".join(f"round(max(m) FILTER (kinase = 'K{k:02d}'), 6) AS K{k:02d}" for k in range(20)) + " FROM (SELECT sample, kinase, median(p) AS m FROM real GROUP BY ALL) GROUP BY ALL", *REAL)
def transposed_matrix(spark, d):
    names = [f"K{k:02d}" for k in range(20)]
    wide = E.pivot_unique(E.median_enrichment(really_enriched(spark, d)), "kinase", "sample", "median_p", SAMPLES)
    return rounded(V.transpose(wide, "kinase", names, "sample"), *names)


@query("SELECT s_suppkey AS id, position, category, value FROM (SELECT s_suppkey, n_name, r_name, CAST(row_number() OVER (ORDER BY s_suppkey) * 10 - 5 AS INT) AS position FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) UNPIVOT (value FOR category IN (n_name, r_name))")
def context_cells(spark, d):
    context = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    order = N.rank_positions(context, "s_suppkey").withColumnRenamed("s_suppkey", "id")
    return D.context_cells(context, "s_suppkey", ["n_name", "r_name"], order)


@query("SELECT sample, CAST((row_number() OVER (ORDER BY sample) - 1) * 10 + 5 AS INT) AS position FROM (SELECT DISTINCT sample FROM tb_raw)", "tb_raw")
def axis_positions(spark, d):
    return N.rank_positions(view(spark, d, "tb_raw"), "sample")


@query("SELECT kinase, CAST(row_number() OVER (ORDER BY round(median(p), 9), kinase) AS INT) AS position FROM real WHERE sample = 'data:AF' GROUP BY kinase", *REAL)
def ordered_kinases(spark, d):
    medians = E.median_enrichment(really_enriched(spark, d)).withColumn("median_p", F.round("median_p", 9))
    return D.ordered_by(medians, "sample", "data:AF", "median_p")


@query("SELECT sample, kinase, CASE WHEN p = 0 THEN CAST('inf' AS DOUBLE) ELSE round(-log10(p), 5) END AS score FROM (SELECT sample, kinase, median(p) AS p FROM real GROUP BY ALL)", *REAL)
def log_scores(spark, d):
    medians = E.median_enrichment(really_enriched(spark, d))
    return medians.select("sample", "kinase", F.round(minus_log10(F.col("median_p")), 5).alias("score"))
