"""From measured values to the sites that count as evidence in each sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import nan_to_null
from ..params import RESIDUES

KEYS = ["accession", "site"]


def of_type(rows: DataFrame, phospho_type: str, loose: bool = False) -> DataFrame:
    """Rows whose site is on the type's residues; loosely, whose site names one of them anywhere."""
    residues = RESIDUES[phospho_type]
    if loose:
        hit = F.lit(False)
        for r in residues:
            hit = hit | F.contains("site", F.lit(r))
        return rows.where(hit)
    return rows.where(F.substring("site", 1, 1).isin(*residues))


def long_form(wide: DataFrame, columns: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """(keys, sample, value) from one value column a sample; NaN becomes NULL."""
    keys = KEYS if keys is None else keys
    named = wide.select(*keys, *[F.col(f"`{old}`").cast("double").alias(new) for old, new in columns.items()])
    long = named.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`") for c in columns.values()], "sample", "value")
    return long.withColumn("value", nan_to_null(F.col("value")))


def wide_form(long: DataFrame, names: list[str], keys: list[str] | None = None, column: str = "sample", value: str = "value") -> DataFrame:
    """One value column for each name."""
    return long.groupBy(*(KEYS if keys is None else keys)).pivot(column, names).agg(F.first(value))


def transpose(wide: DataFrame, index: str, names: list[str], new_index: str) -> DataFrame:
    """Columns become rows and the values of `index`, which are `names`, become columns."""
    columns = [c for c in wide.columns if c != index]
    long = wide.unpivot([F.col(index)], [F.col(f"`{c}`") for c in columns], new_index, "_value")
    return wide_form(long, names, [new_index], index, "_value")


def shared_sites(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct sites that both samples have."""
    of = lambda s: rows.where(F.col("sample") == s).select(*KEYS)
    return of(first).intersect(of(second))


def only_sites(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct sites of the first sample that the second has not."""
    of = lambda s: rows.where(F.col("sample") == s).select(*KEYS)
    return of(first).subtract(of(second))


def collapse(raw: DataFrame, agg: str = "mean") -> DataFrame:
    """One value for each site and sample; missing values and rows without a key are left out."""
    how = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "count": F.count}[agg]
    return raw.dropna(subset=KEYS).groupBy("sample", *KEYS).agg(how("value").alias("value"))


def passes(value: Column, threshold, greater: bool = True) -> Column:
    return F.coalesce(value >= threshold if greater else value <= threshold, F.lit(False))


def flags(collapsed: DataFrame, threshold: float, greater: bool = True) -> DataFrame:
    """(sample, site, flag) with 0 for missing values."""
    return collapsed.withColumn("flag", passes(F.col("value"), threshold, greater).cast("int")).drop("value")


def mask(collapsed: DataFrame, threshold: float, greater: bool = True) -> DataFrame:
    """Like `flags`, but missing values stay missing."""
    return collapsed.withColumn("flag", F.when(F.col("value").isNotNull(), passes(F.col("value"), threshold, greater).cast("int"))).drop("value")


def by_threshold(collapsed: DataFrame, threshold: float, greater: bool = True) -> DataFrame:
    return collapsed.where(passes(F.col("value"), threshold, greater)).select("sample", *KEYS)


def by_thresholds(collapsed: DataFrame, thresholds: list[float], greater: bool = True) -> DataFrame:
    """Evidence of a new sample `name_threshold=t` for each sample and threshold."""
    rows = collapsed.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    rows = rows.where(passes(F.col("value"), F.col("t"), greater))
    return rows.select(F.concat("sample", F.lit("_threshold="), F.col("t").cast("string")).alias("sample"), *KEYS)


def by_rank(collapsed: DataFrame, n: int, greater: bool = True) -> DataFrame:
    """The n sites with the largest (smallest) values of each sample; ties by accession and site."""
    order = F.desc("value") if greater else F.asc("value")
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(order, *KEYS))
    return collapsed.where("value is not null").withColumn("rank", rank).where(F.col("rank") <= n).select("sample", *KEYS)


def unique_compendia(compendia: DataFrame) -> DataFrame:
    """One row a site: the largest number of compendia and its class."""
    most = compendia.groupBy(*KEYS).agg(F.max("num_compendia").alias("num_compendia"))
    return most.withColumn("compendia_class", compendia_class(F.col("num_compendia")))


def compendia_class(n: Column) -> Column:
    return F.when(n < 1, 0).when(n <= 3, 1).otherwise(2)


def with_compendia(evidence: DataFrame, compendia: DataFrame) -> DataFrame:
    return evidence.join(unique_compendia(compendia), KEYS, "left")


def sizes(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("sample").agg(F.count("*").alias("size"))


def size_summary(evidence: DataFrame) -> DataFrame:
    return sizes(evidence).agg(F.max("size").alias("largest"), F.min("size").alias("smallest"), F.median("size").alias("middle"))


def class_shares(evidence: DataFrame) -> DataFrame:
    """Per cent of a sample's sites in each class, of those that have one."""
    share = lambda k: F.bround(F.count_if(F.col("compendia_class") == k) * 100 / F.count("compendia_class"), 2).alias(f"class_{k}")
    return evidence.where("compendia_class is not null").groupBy("sample").agg(*[share(k) for k in range(3)])


def stratum_sizes(evidence: DataFrame, stratum: str = "compendia_class") -> DataFrame:
    return evidence.where(F.col(stratum).isNotNull()).groupBy("sample", F.col(stratum).alias("stratum")).agg(F.count("*").alias("quota"))


def valid_samples(collapsed: DataFrame, thresholds: list[float] | None, greater: bool = True, min_size: int = 0) -> DataFrame:
    """(sample, size, valid): more than `min_size` values pass the loosest threshold, or, without one, a value is there."""
    if thresholds:
        loosest = min(thresholds) if greater else max(thresholds)
        return collapsed.groupBy("sample").agg(F.count_if(passes(F.col("value"), loosest, greater)).alias("size")).withColumn("valid", F.col("size") > min_size)
    return collapsed.groupBy("sample").agg(F.count("value").alias("size")).withColumn("valid", F.col("size") > 0)


def threshold_validity(collapsed: DataFrame, thresholds: list[float], greater: bool = True, min_size: int = 0) -> DataFrame:
    """(threshold, any_sample, all_samples): which samples keep more than `min_size` sites."""
    rows = collapsed.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    per = rows.groupBy("threshold", "sample").agg(F.count_if(passes(F.col("value"), F.col("threshold"), greater)).alias("n"))
    return per.groupBy("threshold").agg(F.bool_or(F.col("n") > min_size).alias("any_sample"), F.bool_and(F.col("n") > min_size).alias("all_samples"))


def require(samples: DataFrame) -> DataFrame:
    """The valid samples; an error if there is none."""
    valid = samples.where("valid")
    if not valid.take(1):
        raise ValueError("no sample has enough evidence")
    return valid


def nth_values(collapsed: DataFrame, n: int, greater: bool = True) -> DataFrame:
    """(sample, value): the n-th largest (smallest) value; null if there are fewer."""
    order = F.desc("value") if greater else F.asc("value")
    ranked = collapsed.where("value is not null").withColumn("rank", F.row_number().over(Window.partitionBy("sample").orderBy(order)))
    nth = ranked.where(F.col("rank") == n).select("sample", "value")
    return collapsed.select("sample").distinct().join(nth, "sample", "left")


def allowable_threshold(collapsed: DataFrame, min_size: int = 20, greater: bool = True, allow_loss: bool = False) -> DataFrame:
    """The strictest threshold that leaves `min_size` sites in every sample, or in one if samples may be lost."""
    low = greater != allow_loss
    return nth_values(collapsed, min_size, greater).agg((F.min if low else F.max)("value").alias("threshold"))
