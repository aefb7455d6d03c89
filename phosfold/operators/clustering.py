"""Agglomerative clustering of kinases or samples, and the order in which a tree of them is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.paths import materialize
from .places import numbered

#: Items of a tree at most: each meets each other once.
MOST = 4096
#: Digits after the point that heights are compared by, since sums come in any order.
DIGITS = 12


def distances(rows: DataFrame, item: str, column: str, value: str, most: int = MOST) -> DataFrame:
    """(a, b, d): Euclidean distance of each pair of items, a before b, over all columns; a missing value counts as 0.

    `rows` hold one value for an item and column. The squared lengths are summed apart, so columns in which one of the two is 0 need no pair.
    """
    rows = rows.select(F.col(item).cast("string").alias("i"), F.col(column).alias("c"), F.coalesce(F.col(value), F.lit(0.0)).cast("double").alias("v")).where("i is not null")
    items = rows.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    if items.count() > most:
        raise ValueError(f"a tree has at most {most} items")
    # differences of values that both have, and whole squares of what one of them has
    held = rows.where("v <> 0")
    met = held.select(F.col("i").alias("a"), "c", F.col("v").alias("x")).join(held.select(F.col("i").alias("b"), "c", F.col("v").alias("y")), "c").where("a < b")
    both = met.groupBy("a", "b").agg(F.sum((F.col("x") - F.col("y")) ** 2 - F.col("x") ** 2 - F.col("y") ** 2).alias("m"))
    # the pairs are the result itself, and their number was checked
    grid = items.select(F.col("i").alias("a"), F.col("s").alias("sa")).join(items.select(F.col("i").alias("b"), F.col("s").alias("sb")), F.expr("a < b"))
    square = F.col("sa") + F.col("sb") + F.coalesce("m", F.lit(0.0))
    return grid.join(both, ["a", "b"], "left").select("a", "b", F.sqrt(F.greatest(square, F.lit(0.0))).alias("d"))


def _height(method: str) -> tuple[Column, list[Column]]:
    """Distance of two clusters from what is kept of their members' distances, and how that is merged.

    Ward's is the distance of the clusters' centres, from the sums of squared distances between and within them.
    """
    if method == "ward":
        between = F.col("total") / F.col("pairs") - F.col("within_a") / (F.col("n_a") * F.col("n_a")) - F.col("within_b") / (F.col("n_b") * F.col("n_b"))
        square = F.round(2 * F.col("pairs") / (F.col("n_a") + F.col("n_b")) * between, DIGITS)
        return F.round(F.sqrt(F.greatest(square, F.lit(0.0))), DIGITS), [F.sum("total").alias("total"), F.sum("pairs").alias("pairs")]
    if method == "average":
        return F.round(F.col("total") / F.col("pairs"), DIGITS), [F.sum("total").alias("total"), F.sum("pairs").alias("pairs")]
    if method not in ("single", "complete"):
        raise ValueError("linkage is single, complete, average or ward")
    best = F.min if method == "single" else F.max
    return F.round("total", DIGITS), [best("total").alias("total"), F.sum("pairs").alias("pairs")]


def linkage(items: DataFrame, pairs: DataFrame, method: str = "average") -> tuple[DataFrame, DataFrame]:
    """Merges (left, right, height, size) and leaves (item, position) of the tree over `items` (item) with distances `pairs` (a, b, d), a before b.

    A cluster is named after its first item. In each round all clusters that are each other's nearest merge, which
    for these linkages gives the tree of merging one pair at a time. Ward's asks for Euclidean distances. Equal distances go by the names of the nearer and the
    farther cluster. The child made first is on the left, single items before clusters, and leaves are numbered from the left.
    A round keeps a distance for each pair of clusters and a path of turns for each item.
    """
    height, merged = _height(method)
    spark = items.sparkSession
    leaves = materialize(items.select(F.col("item").cast("string").alias("item")).where("item is not null").distinct().select("item", F.col("item").alias("name"), F.lit("").alias("path"), F.lit(-1.0).alias("made"), F.lit(0.0).alias("within")), "leaves")
    kept = F.col("d") * F.col("d") if method == "ward" else F.col("d")
    near = materialize(pairs.select("a", "b", kept.alias("total"), F.lit(1).cast("long").alias("pairs")), "pairs")
    found = []
    while near.take(1):
        sizes = leaves.groupBy("name").agg(F.count("*").alias("n"), F.first("made").alias("made"), F.first("within").alias("within"))
        apart = near
        if method == "ward":
            # one row for each cluster
            for side in "ab":
                apart = apart.join(F.broadcast(sizes.select(F.col("name").alias(side), F.col("n").alias(f"n_{side}"), F.col("within").alias(f"within_{side}"))), side)
        best = F.min(F.struct(height.alias("height"), "a", "b", "total")).alias("best")
        each = apart.withColumn("name", F.explode(F.array("a", "b"))).groupBy("name").agg(best)
        mutual = each.groupBy("best").count().where("count = 2").select("best.*")
        one, two = (sizes.select(F.col("name").alias(c), F.col("n").alias(f"n{c}"), F.col("made").alias(f"m{c}"), F.col("within").alias(f"w{c}")) for c in "ab")
        first = F.struct("ma", "a") < F.struct("mb", "b")
        merges = materialize(
            mutual.join(one, "a").join(two, "b").select("a", "b", "height", (F.col("na") + F.col("nb")).alias("size"), (F.col("wa") + F.col("wb") + F.col("total")).alias("gained"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("left"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("right")), "merges"
        )
        found.append(merges.select("left", "right", "height", "size"))
        # at most half as many as there are items
        turned = F.broadcast(merges.select(F.explode(F.array("a", "b")).alias("name"), F.col("a").alias("_to"), "height", "left", "gained"))
        turn = F.when(F.col("name") == F.col("left"), "0").otherwise("1")
        leaves = leaves.join(turned, "name", "left").select("item", F.coalesce("_to", "name").alias("name"), F.when(F.col("_to").isNull(), F.col("path")).otherwise(F.concat(turn, "path")).alias("path"), F.coalesce("height", "made").alias("made"), F.coalesce("gained", "within").alias("within"))
        leaves = materialize(leaves, "leaves")
        moved = F.broadcast(merges.select(F.col("b").alias("_from"), F.col("a").alias("_to")))
        for side in "ab":
            near = near.join(moved, F.col(side) == F.col("_from"), "left").withColumn(side, F.coalesce("_to", side)).drop("_from", "_to")
        near = near.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(*merged)
        near = materialize(near, "pairs")
    tree = spark.createDataFrame([], "left string, right string, height double, size bigint")
    for merges in found:
        tree = tree.unionByName(merges)
    # one row for each item
    return tree, numbered(leaves.select("item", "path"), "position", "path", "item").select("item", "position")


def ordered(rows: DataFrame, item: str, column: str, value: str, method: str = "average") -> DataFrame:
    """(item, position): the order of a tree over the rows of a matrix in long form."""
    items = rows.select(F.col(item).cast("string").alias("item")).distinct()
    return linkage(items, distances(rows, item, column, value), method)[1]
