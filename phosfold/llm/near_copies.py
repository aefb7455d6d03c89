"""Near copies by exact Jaccard similarity of word shingles, with SimHash and MinHash as proposers.

Words are those of `simhash`; a document is the set of its five-word shingles, and fewer words
than a shingle has make one shingle of them all, so texts without words are alike. Two documents
are linked if their sets' Jaccard similarity is `ALIKE` (4/5) or more.

Equal sets are one node. Nodes whose SimHash fingerprints differ in at most three bits, by the tiled
exact comparison of `simhash`, are linked loosely. At a similarity of 0.8 fingerprints differ in about
ten bits and often in more, so nodes that share one of `BANDS` bands of `ROWS` minima each are
linked loosely as well: a pair at similarity s shares none with probability (1 - s**ROWS)**BANDS, which is 7e-10
at 0.8 and less above. The loosely linked groups are then compared exactly, all with all, from
their texts, and what is linked there decides. A group of more than `block` shingles is dealt into
blocks and every pair of blocks is compared; a task returns a spanning forest of its links.

Rows are known by a hash of all their columns beside their id. Null ids take part: a component's id
is its smallest id that is not null, and of a component without one any row is kept. Repeated ids are
rows of their own; null and empty texts are alike; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, slices
from .simhash import SALTS, _forest, links, majority

WIDTH, ALIKE = 5, (4, 5)
ROWS, BANDS = 4, 40
_DRAW = np.random.default_rng(42)
_FLIP = _DRAW.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64)
_TIMES = _DRAW.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' XXH64 hashes in ascending order."""
    words = (text or "").encode().lower().split()
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))], np.uint64))


def node(hashes: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, hashes.size, 2048):
        np.minimum(least, ((hashes[at : at + 2048] ^ _FLIP) * _TIMES).min(1), out=least)
    return np.array([xxhash.xxh3_64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def alike(sets: list[np.ndarray], first: int | None = None):
    """Index pairs (i, j) of sets that are linked, in parts; with `first`, only pairs of the first sets with the others."""
    sizes = np.array([s.size for s in sets])
    owner, ends = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    held = owner[np.argsort(term, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(term))])
    over, under = ALIKE
    for i in range(len(sets) if first is None else first):
        mine = term[ends[i] - sizes[i] : ends[i]]
        shared = np.bincount(np.concatenate([held[starts[t] : starts[t + 1]] for t in mine]), minlength=len(sets))
        # shared / (a + b - shared) >= over / under
        j = np.flatnonzero(shared * (over + under) >= over * (sizes[i] + sizes))
        j = j[j > i] if first is None else j[j >= first]
        if j.size:
            yield np.full(j.size, i), j


def _rows(docs: DataFrame) -> DataFrame:
    """(row, id, h, text): each row of `docs` as a whole, its id, a hash of all its columns, and its text."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(*docs.columns).alias("h"), F.col("text").cast("string").alias("text"))


def _grouped(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, node) of each row, and (node, root, best) of each node, where best holds the node's first row by (id is null, id, h)."""

    def sketch(stream):
        for batch in (part for whole in stream for part in slices(whole, 2)):
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            # the fingerprint is one more key: equal ones propose each other
            fps = np.array([majority([s]) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([np.append(bands(s), fp) for s, fp in zip(sets, fps)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([node(s) for s in sets], pa.int64()), pa.array([s.size for s in sets], pa.int64()), pa.array(fps), keys], names=["id", "h", "node", "size", "fp", "keys"])

    texts = _rows(docs).select("id", "h", "text")
    rows = materialize(texts.mapInArrow(sketch, "id long, h long, node long, size long, fp long, keys array<long>"), "sketches")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("best")
    distinct = materialize(rows.groupBy("node").agg(best, F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "sets")

    keyed = distinct.select("node", F.explode("keys").alias("key")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    smallest = keyed.groupBy("key").agg(F.min("node").alias("m"), F.count("*").alias("n")).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = keyed.join(smallest, ["key", "salt"]).select(F.col("node").alias("u"), F.col("m").alias("v"))
    first = distinct.groupBy("fp").agg(F.min("node").alias("node"))
    near = links(first.select("fp")).join(first.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    loose = components(shared.union(near.select("a", "b")))
    loose = loose.union(loose.select("root", "root").distinct()).select("node", F.col("root").alias("g"))

    member = loose.join(distinct.select("node", F.col("best.h").alias("h"), "size"), "node")
    parts = member.groupBy("g").agg(F.ceil(F.sum("size") / block).cast("int").alias("n"))
    member = materialize(member.join(parts, "g").select("node", "g", "n", "h"), "members")

    def load(stream):
        for batch in (part for whole in stream for part in slices(whole, 3)):
            sets = [shingles(t) for t in batch.column(3).to_pylist()]
            right = pa.array([node(s) == k for s, k in zip(sets, batch.column(0).to_pylist())], pa.bool_())
            held = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], held], names=["node", "g", "n", "held"]).filter(right)

    # a hash may stand for several rows: only those with the node's shingles are kept
    loaded = member.join(texts, "h").select("node", "g", "n", "text").mapInArrow(load, "node long, g long, n int, held array<long>")
    both = (
        loaded.withColumn("k", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("node", "g", "held", "k", F.least("k", "t").alias("a"), F.greatest("k", "t").alias("b"))
    )

    def compare(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(table["node"].to_numpy(), return_index=True)
        sets = table["held"].combine_chunks().take(pa.array(at))
        sets, k = [s.values.to_numpy().view(np.uint64) for s in sets], table["k"].to_numpy()[at]
        first = None
        if table["a"][0].as_py() != table["b"][0].as_py():
            order = np.argsort(k, kind="stable")
            nodes, sets, first = nodes[order], [sets[i] for i in order], int((k == k.min()).sum())
            if first == len(sets):
                return pa.table({"u": nodes[:0], "v": nodes[:0]})
        found = _forest(nodes, alike(sets, first))
        return pa.table({"u": nodes[found != nodes], "v": found[found != nodes]})

    star = components(both.groupBy("g", "a", "b").applyInArrow(compare, "u long, v long"))
    star = star.union(star.select("root", "root").distinct())
    of = distinct.select("node", "best").join(star, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "best")
    return rows.select("id", "node"), of


def near_copies(docs: DataFrame, block: int = 1 << 21) -> DataFrame:
    """(doc_id, component_id) for every row; component_id is the smallest id reachable over links."""
    rows, of = _grouped(docs, block)
    least = of.groupBy("root").agg(F.min("best.id").alias("component_id"))
    of = of.join(least, "root").select("node", "component_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(of, ["node", "salt"]).select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, block: int = 1 << 21) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, of several such the one with the smallest hash of its columns."""
    _, of = _grouped(docs, block)
    # equal rows of a batch go on once, so a row that stands very often is shuffled a few times
    def unlike(stream):
        for batch in stream:
            _, at = np.unique(batch.column(2).to_numpy(), return_index=True)
            yield batch if at.size == batch.num_rows else batch.take(pa.array(np.sort(at)))

    nobody = F.lit(-(1 << 63))
    rows = _rows(docs).select("row", F.coalesce("id", nobody).alias("k"), "h")
    rows = rows.mapInArrow(unlike, rows.schema)
    best = of.groupBy("root").agg(F.min("best").alias("best")).select(F.coalesce("best.id", nobody).alias("k"), F.col("best.h").alias("h"))
    return rows.join(best, ["k", "h"], "left_semi").dropDuplicates(["k", "h"]).select("row.*")
