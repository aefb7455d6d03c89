"""Trees of items against merging one pair at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from phosfold.operators import clustering


def plainly(points, method):
    """Merges (names of both sides, height, size) and the leaves from the left."""
    gap = lambda p, q: math.dist(points[p], points[q])
    far = {"single": min, "complete": max, "average": lambda v: sum(v) / len(v), "ward": None}[method]
    centre = lambda g: [sum(c) / len(g) for c in zip(*(points[p] for p in g))]
    ward = lambda g, h: math.sqrt(round(2 * len(g) * len(h) / (len(g) + len(h)) * math.dist(centre(g), centre(h)) ** 2, clustering.DIGITS))
    apart = lambda g, h: far([gap(p, q) for p in g for q in h]) if far else ward(g, h)
    groups = {p: ([p], -1.0, [p]) for p in points}  # first item: members, height, leaves
    merges = []
    while len(groups) > 1:
        h, a, b = min((round(apart(groups[a][0], groups[b][0]), clustering.DIGITS), a, b) for a in groups for b in groups if a < b)
        left, right = (a, b) if (groups[a][1], a) < (groups[b][1], b) else (b, a)
        merges.append((left, right, h, len(groups[a][0]) + len(groups[b][0])))
        (ma, _, _), (mb, _, _) = groups[a], groups[b]
        new = (ma + mb, h, groups[left][2] + groups[right][2])
        del groups[b]
        groups[a] = new
    return merges, next(iter(groups.values()))[2]


@pytest.mark.parametrize("method", ["single", "complete", "average", "ward"])
def test_tree(spark, method):
    rng = random.Random(len(method))
    points = {f"K{i:02d}": [rng.random() if rng.random() < 0.8 else 0.0 for _ in range(4)] for i in range(17)}
    rows = spark.createDataFrame([(k, f"s{j}", v) for k, p in points.items() for j, v in enumerate(p)] + [(None, "s0", 1.0)], "kinase string, sample string, value double").withColumn("item", F.lit("x"))
    pairs = clustering.distances(rows, "kinase", "sample", "value")
    got = {(r.a, r.b): r.d for r in pairs.collect()}
    assert got == {(a, b): pytest.approx(math.dist(points[a], points[b]), abs=1e-7) for a in points for b in points if a < b}
    merges, order = clustering.linkage(rows.select(F.col("kinase").alias("item")), pairs, method)
    want, leaves = plainly(points, method)
    found = sorted(map(tuple, merges.collect()), key=lambda m: m[2])
    assert [(m[0], m[1], m[3]) for m in found] == [(m[0], m[1], m[3]) for m in want]
    assert [m[2] for m in found] == [pytest.approx(m[2], abs=1e-7) for m in want]
    assert [r.item for r in order.orderBy("position").collect()] == leaves


def test_ties_few_items_and_limits(spark):
    line = lambda *at: spark.createDataFrame([(f"i{k}", "x", float(v)) for k, v in enumerate(at)], "item string, c string, value double")
    # all gaps are equal: the first two names merge first
    order = lambda *at: [r.item for r in clustering.ordered(line(*at), "item", "c", "value", "single").orderBy("position").collect()]
    assert order(1, 1, 1) == ["i2", "i0", "i1"] and order(5) == ["i0"] and order() == []
    assert order(0, 9, 1) == ["i1", "i0", "i2"]
    # two pairs of equal items, then both pairs: clusters without any spread
    wards = clustering.linkage(line(1, 4, 1, 4).select("item"), clustering.distances(line(1, 4, 1, 4), "item", "c", "value"), "ward")[0]
    assert sorted(map(tuple, wards.collect())) == [("i0", "i1", pytest.approx(3 * math.sqrt(2)), 4), ("i0", "i2", 0.0, 2), ("i1", "i3", 0.0, 2)]
    with pytest.raises(ValueError):
        clustering.distances(line(1, 2, 3), "item", "c", "value", most=2)
    with pytest.raises(ValueError):
        clustering.ordered(line(1, 2), "item", "c", "value", "median")
