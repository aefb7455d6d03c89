"""Hard negatives against a plain search and against SQL."""

import collections
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from phosfold.llm import negatives

SF = "/root/testdata/sf0.001"


def plain(rows, scale=256.0, positives=5, many=10, low=30, high=90):
    use = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(scale * float(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = collections.Counter()
    for i, lab, v in use:
        if i % 100:
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in use if j != i)
        for p, j, _ in [o for o in others if o[2] == lab][:positives]:
            fit = [(n, k) for n, k, m in others if m != lab and low * -p <= 100 * -n <= high * -p]
            found.update((i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(fit[:many], 1))
    return found


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return df.withColumns({c: F.lit(1) for c in ("vector", "anchor", "windows", "score", "key", "fine", "ids", "size")})


RULE = "if(vec_id % 7 = 0, (label + 1) % 10, label)"


def made(seed, n=700, wide=8):
    rng = random.Random(seed)
    rows = [(rng.randrange(-400, 900), rng.randrange(3), [rng.choice((-0.5, 0.0, 0.25, 1.0)) for _ in range(wide)]) for _ in range(n)]
    nan, inf = float("nan"), float("inf")
    return rows + [(100, None, [1.0] * wide), (200, 1, None), (None, 1, [1.0] * wide), (300, 1, [nan] * wide), (400, 2, [inf] + [0.0] * (wide - 1)), (500, 2, [None] + [1.0] * (wide - 1)), (600, 1, []), (700, 0, [1.0]), (800, 0, [0.0] * wide), (0, 1, [-1.0] * wide)]


@pytest.mark.parametrize("blocks", [(1 << 19, 1 << 16, 1 << 19), (64, 24, 40)])
def test_hard_negatives(spark, monkeypatch, blocks):
    for name, value in zip(("ROW_BLOCK", "ANCHOR_BLOCK", "SCORES"), blocks):
        monkeypatch.setattr(negatives, name, value)
    rows = made(1)
    got = negatives.hard_negatives(table(spark, rows), label=RULE)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows)
    assert collections.Counter(tuple(r) for r in got.collect()) == want and any(k[4] == 0 for k in want)
    same = [(i, 1 if i < 300 else 2, [0.5, 0.25]) for i in range(600)] + [(i, 2, [0.25, 0.25]) for i in range(600, 1200)]
    assert collections.Counter(tuple(r) for r in negatives.hard_negatives(table(spark, same), label=RULE).collect()) == plain(same)
    assert negatives.hard_negatives(table(spark, rows).limit(0), label=RULE).count() == 0
    assert negatives.hard_negatives(table(spark, rows[:40]), label=RULE, anchors="vec_id is null").count() == 0


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = collections.Counter(con.sql(negatives.OP12_SQL).fetchall())
    got = negatives.op12_hard_negatives(spark, SF)
    assert collections.Counter(tuple(r) for r in got.collect()) == want and want


def test_scores_and_firsts():
    rng = np.random.default_rng(5)
    for top in (30, 1 << 40):
        a, b = (rng.integers(-top, top, s).astype(float) for s in ((7, 5), (40, 3)))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        if max(map(abs, sum(want, []))) < 1 << 63:
            assert negatives.scores(a, b).tolist() == want
        else:
            with pytest.raises(OverflowError):
                negatives.scores(a, b)
    for found in (rng.integers(-3, 3, (20, 50)), rng.integers(-3, 3, (20, 50)) << 58):
        mask = rng.random(found.shape) < 0.4
        want = np.zeros_like(mask)
        for k in range(20):
            want[k, sorted(np.flatnonzero(mask[k]), key=lambda j: (-found[k, j], j))[:6]] = True
        assert (negatives.first_of(found, mask, 6) == want).all()
    for p in range(-250, 250):
        low, high = negatives.bounds(p, 30, 90)
        assert [n for n in range(-300, 300) if 30 * p <= 100 * n <= 90 * p] == list(range(low, high + 1))


def test_keys_sort_as_they_should():
    rng = random.Random(8)
    rows = [(rng.choice((-5, 0, 7)), rng.choice((1, 2)), rng.choice((-(1 << 62), -1, 0, 1, 1 << 62)), rng.choice((0, 1)), rng.choice((-9, 0, 9))) for _ in range(200)]
    packed = [negatives.keys([a], [n], [s], k, [v])[0] for a, n, s, k, v in rows]
    assert list(negatives.read_keys(packed)) == rows
    assert [x for _, x in sorted(zip(packed, rows))] == sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))
