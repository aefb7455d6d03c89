"""Similarity of samples, and the search for a threshold over a grid in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import materialize
from .evidence import KEYS, allowable_threshold, passes


def jaccard(evidence: DataFrame, by: str = "sample", within: list[str] | None = None, units: DataFrame | None = None) -> DataFrame:
    """(within, first, second, jaccard) for each pair of different samples, 0 where both are empty.

    `units` (within, sample) lists the samples, with those that have no evidence; else those of `evidence` count.
    Shared sites come from a join on the site; a site's samples are few, whatever the number of sites.
    """
    within = within or []
    rows = evidence.select(*within, F.col(by).alias("s"), *KEYS).distinct()
    size = rows.groupBy(*within, "s").agg(F.count("*").alias("n"))
    if units is not None:
        size = units.select(*within, F.col(by).alias("s")).distinct().join(size, [*within, "s"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pairs = rows.withColumnRenamed("s", "first").join(rows.withColumnRenamed("s", "second"), [*within, *KEYS]).where("first < second")
    shared = pairs.groupBy(*within, "first", "second").agg(F.count("*").alias("shared"))
    a, b = size.withColumnRenamed("s", "first").withColumnRenamed("n", "na"), size.withColumnRenamed("s", "second").withColumnRenamed("n", "nb")
    # all pairs of the few samples of an experiment
    grid = a.join(b, within or F.expr("first < second")).where("first < second") if within else a.join(b, F.expr("first < second"))
    found = grid.join(shared, [*within, "first", "second"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return found.select(*within, "first", "second", F.coalesce(F.try_divide(F.col("shared"), F.col("na") + F.col("nb") - F.col("shared")), F.lit(0.0)).alias("jaccard"))


def jaccard_summary(pairs: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Largest, mean and middle similarity of different samples."""
    cells = [F.max("jaccard").alias("largest"), F.avg("jaccard").alias("mean"), F.median("jaccard").alias("middle")]
    return pairs.groupBy(*(within or [])).agg(*cells)


def jaccard_masked(pairs: DataFrame) -> DataFrame:
    """Mean of the samples' mean similarities and the largest one, over cells other than 1."""
    cells = pairs.select("first", "jaccard").union(pairs.select("second", "jaccard")).where("jaccard <> 1")
    each = cells.groupBy("first").agg(F.avg("jaccard").alias("mean"), F.max("jaccard").alias("most"))
    return each.agg(F.avg("mean").alias("mean"), F.max("most").alias("largest"))


def grid(low: float, high: float, step: float, places: int = 10) -> list[float]:
    """low, low + step, ... up to high, without the error that repeated addition gathers."""
    return [round(low + k * step, places) for k in range(int((high - low) / step + 1e-9) + 1)]


def level(value: Column, thresholds: list[float], greater: bool = True) -> Column:
    """How many of `thresholds`, from the loosest on, a value passes: a search by halves in one expression."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(passes(value, F.lit(thresholds[middle - 1]), greater), between(middle, high)).otherwise(between(low, middle - 1))

    return between(0, len(thresholds))


def _passing(counts: DataFrame, of: list[str], steps: DataFrame, name: str) -> DataFrame:
    """(of, k, name): from counts by level the number at each threshold, which are those of all levels above it."""
    # each unit meets each threshold once: a row of the result
    grid = counts.select(*of).distinct().crossJoin(F.broadcast(steps.select("k")))
    found = grid.join(counts.select(*of, (F.col("level") - 1).alias("k"), "n"), [*of, "k"], "left")
    stricter = Window.partitionBy(*of).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return found.select(*of, "k", F.coalesce(F.sum("n").over(stricter), F.lit(0)).alias(name))


def sweep(collapsed: DataFrame, thresholds: list[float], greater: bool = True) -> DataFrame:
    """(threshold, largest, smallest, middle, similarity) up to the first threshold at which a sample is empty.

    All thresholds come from one pass: a row has the number of thresholds it passes, two samples share a site
    at as many as the lower of theirs, and counts by these numbers are summed from the strictest threshold on.
    """
    order = sorted({float(t) for t in thresholds}, reverse=not greater)
    steps = collapsed.sparkSession.createDataFrame(list(enumerate(order)), "k int, threshold double")
    rows = collapsed.select("sample", *KEYS, level(F.col("value"), order, greater).alias("level"))
    per = _passing(rows.groupBy("sample", "level").agg(F.count("*").alias("n")), ["sample"], steps, "size")
    per = materialize(per, "sizes")
    sizes = per.groupBy("k").agg(F.max("size").alias("largest"), F.min("size").alias("smallest"), F.median("size").alias("middle"))
    hits = rows.where("level > 0").groupBy("sample", *KEYS).agg(F.max("level").alias("level"))
    first, second = (hits.select(*KEYS, F.col("sample").alias(s), F.col("level").alias(f"{s}_level")) for s in ("first", "second"))
    met = first.join(second, KEYS).where("first < second")
    both = met.groupBy("first", "second", F.least("first_level", "second_level").alias("level")).agg(F.count("*").alias("n"))
    shared = _passing(both, ["first", "second"], steps, "shared")
    a, b = (per.select("k", F.col("sample").alias(s), F.col("size").alias(n)) for s, n in (("first", "na"), ("second", "nb")))
    each = a.join(b, "k").where("first < second").join(shared, ["first", "second", "k"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    similar = each.groupBy("k").agg(F.max(F.coalesce(F.try_divide(F.col("shared"), F.col("na") + F.col("nb") - F.col("shared")), F.lit(0.0))).alias("similarity"))
    found = sizes.where("smallest > 0").join(similar, "k", "left").join(steps, "k")
    return found.select("threshold", "largest", "smallest", "middle", "similarity")


def by_size(swept: DataFrame, desired: float, pick: str = "middle", greater: bool = True) -> DataFrame:
    """The loosest threshold whose evidence is no larger than desired."""
    return swept.where(F.col(pick) <= desired).agg((F.min if greater else F.max)("threshold").alias("threshold"))


def by_similarity(swept: DataFrame, most: float, greater: bool = True) -> DataFrame:
    """The loosest threshold whose samples are less similar than `most`."""
    return swept.where(F.col("similarity") < most).agg((F.min if greater else F.max)("threshold").alias("threshold"))


def recommend(collapsed: DataFrame, thresholds: list[float], desired: float, most: float = 0.7, min_size: int = 20, greater: bool = True, allow_loss: bool = False) -> float | None:
    """The stricter of both recommendations, no stricter than what is allowed; None if neither finds one."""
    swept = sweep(collapsed, thresholds, greater)
    found = [r[0] for r in (by_size(swept, desired, greater=greater).first(), by_similarity(swept, most, greater).first()) if r[0] is not None]
    if not found:
        return None
    best = max(found) if greater else min(found)
    limit = allowable_threshold(collapsed, min_size, greater, allow_loss).first()[0]
    if limit is not None:
        best = min(best, limit) if greater else max(best, limit)
    return round(best, 2)


def auto(collapsed: DataFrame, thresholds: list[float], desired: float, fallback: float, **more) -> float:
    """The recommended threshold, or the fallback if there is none."""
    found = recommend(collapsed, thresholds, desired, **more)
    return fallback if found is None else found
