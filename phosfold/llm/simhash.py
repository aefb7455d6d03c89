"""SimHash near-duplicates by tiled exact comparison.

Words are runs of bytes other than ASCII white space after A-Z are lower-cased; shingles of three
words, repeats included, are joined by one space and hashed with XXH64 (seed 42). A bit of the
64-bit fingerprint is set if it is set in more than half of the hashes. Fewer words than a shingle
has make one shingle of them all; no words make fingerprint zero, which is linked like any other.

Distinct fingerprints go into tiles by the population counts of their two halves. Two tiles whose
counts differ by more than the radius in sum cannot hold a linked pair and never meet. A tile that
holds more than `tile_rows` fingerprints is dealt into blocks, and every pair of blocks is compared
exactly, by exclusive-or and bit counts. A task keeps a spanning forest of the links it finds, so
a group of many fingerprints never becomes all its pairs.

Results for odd inputs: null and empty texts have fingerprint zero; repeated rows each get the
same result; null ids take part and get their component's smallest id that is not null; an empty
table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

HASHES_AT_ONCE = 1 << 16
SALTS = 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *stops[:-1]]
    width = min(width, len(words))
    total, h = len(words) - width + 1, xxhash.xxh64_intdigest

    def parts():
        for at in range(0, total, HASHES_AT_ONCE):
            to = min(total, at + HASHES_AT_ONCE)
            yield np.array([h(line[a : b - 1], seed) for a, b in zip(starts[at:to], stops[at + width - 1 : to + width - 1])], "<u8")

    return majority(parts())


def majority(hashes) -> int:
    """The bits that are set in more than half of the hashes, which come as arrays."""
    counts, total = np.zeros(64, np.int64), 0
    for part in hashes:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += part.size
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) for every row; fp holds the fingerprint's bits."""

    def run(stream):
        for batch in stream:
            fps = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _segments(x: np.ndarray, bits: int) -> np.ndarray:
    parts = np.arange(0, 64, bits, dtype=np.uint64)
    return np.bitwise_count((x[:, None] >> parts) & np.uint64((1 << bits) - 1)).astype(np.int16)


def _exact(a: np.ndarray, b: np.ndarray, radius: int):
    step = max(1, (1 << 18) // max(1, b.size))
    for at in range(0, a.size, step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        if near.any():
            i, j = np.nonzero(near)
            yield i + at, j


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, bits: int = 16):
    """Index pairs (i, j) with at most `radius` differing bits between a[i] and b[j], in parts.

    Large inputs are cut by the population counts of ever smaller segments: the differences of
    these counts sum up to no more than the number of differing bits.
    """
    if a.size * b.size <= 1 << 22 or bits < 8:
        yield from _exact(a, b, radius)
        return
    ka, ia = np.unique(_segments(a, bits), axis=0, return_inverse=True)
    kb, ib = np.unique(_segments(b, bits), axis=0, return_inverse=True)
    oa, ob = np.argsort(ia.ravel(), kind="stable"), np.argsort(ib.ravel(), kind="stable")
    ca, cb = np.searchsorted(ia.ravel()[oa], np.arange(len(ka) + 1)), np.searchsorted(ib.ravel()[ob], np.arange(len(kb) + 1))
    for x in range(len(ka)):
        rows = oa[ca[x] : ca[x + 1]]
        for y in np.flatnonzero(np.abs(kb - ka[x]).sum(1) <= radius):
            cols = ob[cb[y] : cb[y + 1]]
            for i, j in close_pairs(a[rows], b[cols], radius, bits // 2):
                yield rows[i], cols[j]


def _forest(values: np.ndarray, pairs) -> np.ndarray:
    """The smallest linked value for every value; pairs are index arrays, in parts."""
    root = np.arange(values.size)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
    return values[root]


def links(distinct: DataFrame, radius: int = 3, tile_rows: int = 1 << 15) -> DataFrame:
    """Edges (u, v) that join every pair of fingerprints of `distinct(fp)` within the radius, as spanning forests of tile pairs."""
    spark = distinct.sparkSession
    ones = lambda bits: F.bit_count(bits).cast("int")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    tiles = distinct.select("fp", ones(low).alias("p"), ones(F.shiftrightunsigned("fp", 32)).alias("q"))
    # at most 33 x 33 tiles, whatever the number of rows
    blocks = tiles.groupBy("p", "q").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("n"))
    blocks = spark.createDataFrame([tuple(r) for r in blocks.collect()], "p int, q int, n int")
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near])
    mine = tiles.join(F.broadcast(blocks), ["p", "q"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n")))
    code = lambda p, q, b: (p * 33 + q).cast("long") * (1 << 40) + b
    to = blocks.select(F.col("p").alias("tp"), F.col("q").alias("tq"), F.col("n").alias("tn"))
    both = (
        mine.withColumn("o", F.explode(offsets))
        .withColumns({"tp": F.col("p") + F.col("o.i"), "tq": F.col("q") + F.col("o.j")})
        .join(F.broadcast(to), ["tp", "tq"])
        .withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("tn") - 1)))
        .select("fp", code(F.col("p"), F.col("q"), F.col("block")).alias("k"), code(F.col("tp"), F.col("tq"), F.col("tb")).alias("t"))
        .select("fp", F.least("k", "t").alias("a"), F.greatest("k", "t").alias("b"), F.expr("k <= t").alias("first"))
    )

    def compare(table: pa.Table) -> pa.Table:
        fps, first = table["fp"].to_numpy().view(np.uint64), table["first"].to_numpy()
        if table["a"][0].as_py() == table["b"][0].as_py():
            values = np.unique(fps)
            found = _forest(values, close_pairs(values, values, radius))
        else:
            left, right = np.unique(fps[first]), np.unique(fps[~first])
            values = np.concatenate([left, right])
            found = _forest(values, ((i, j + left.size) for i, j in close_pairs(left, right, radius)))
        linked = found != values
        return pa.table({"u": values[linked].view(np.int64), "v": found[linked].view(np.int64)})

    return both.groupBy("a", "b").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 3, tile_rows: int = 1 << 15) -> DataFrame:
    """(doc_id, fp long, component_id) for every row; component_id is the smallest id reachable over links."""
    rows = materialize(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("id").alias("least"))
    star = components(links(distinct.select("fp"), radius, tile_rows))
    nodes = star.union(star.select("root", "root").distinct()).select(F.col("node").alias("fp"), "root")
    linked = distinct.join(nodes, "fp")
    smallest = linked.groupBy("root").agg(F.min("least").alias("c"))
    of = distinct.join(linked.join(smallest, "root").select("fp", "c"), "fp", "left").select("fp", F.coalesce("c", "least").alias("component_id"))
    # copies share a fingerprint: the rows of each are dealt over SALTS tasks
    of = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(of, ["fp", "salt"]).select(F.col("id").alias("doc_id"), "fp", "component_id")


def op10_simhash(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

