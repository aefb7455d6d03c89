"""Hard negatives by a secondary-sort shuffle.

Rows and anchors are packed into blocks of bounded size; each pair of a block of rows and a block of
anchors is scored by one product of matrices. Two passes keep what is shuffled small and lose nothing:

1. From each pair of blocks go the first `positives` rows of an anchor's own label; the first of these
   over all blocks are the anchor's positives, each of which opens a window of scores.
2. From each pair of blocks go the first `negatives` rows of other labels in each window. Scores are
   packed into keys (anchor, descending score, positive before negative, id), and
   repartitionAndSortWithinPartitions brings each anchor's keys together in order. An iterator streams
   through them: a positive opens its window, a negative is emitted for each open window that holds its
   score until the window is full. It holds an anchor's open windows and nothing else.

A row's label and vector may not be null, nor any component null, infinite or not a number; rows without
an id take no part either. Rows that share an id are rows of their own, but no row is a partner of an
anchor with its id. Shorter vectors count as ending in zeros, so an empty one scores 0. Scores
are exact whole numbers; one beyond 64 bits is an error. An empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Components of a block of rows, and of a block of anchors.
ROW_BLOCK, ANCHOR_BLOCK = 1 << 19, 1 << 16
#: Scores that a task holds at once.
SCORES = 1 << 19
#: An anchor's id and number, the score from the highest on, 0 for a positive and 1 for a negative, its id.
KEY = np.dtype([("anchor_id", ">u8"), ("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("vec_id", ">u8")])
_TOP = np.uint64(1 << 63)
_BLOCK = ["ids", "labels", "vectors", "anchors", "windows"]
_LEAST = -(1 << 63)


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), fine.alias("fine"))
    return kept.where("vec_id is not null and label is not null and vector is not null and fine").drop("fine")


def packed(rows: DataFrame, components: int, scale: float) -> DataFrame:
    """Blocks of (vec_id, label, vector, anchor, windows), each in the order of its ids, components as floor(scale * x)."""

    def lists(column: pa.Array):
        size = np.diff(column.offsets.to_numpy())
        return column.flatten().to_numpy(), size, np.cumsum(size) - size

    def matrix(flat, size, begin, some):
        out = np.zeros((some.size, int(size[some].max(initial=0))), flat.dtype)
        for k, i in enumerate(some.tolist()):
            out[k, : size[i]] = flat[begin[i] : begin[i] + size[i]]
        return out

    def run(stream):
        for batch in stream:
            ids, labels, anchors = (batch.column(k).to_numpy() for k in (0, 1, 3))
            vectors, windows = lists(batch.column(2)), lists(batch.column(4))
            vectors = (np.floor(scale * vectors[0]), *vectors[1:])
            step, order = max(1, components // max(1, int(vectors[1].max(initial=0)))), np.argsort(ids, kind="stable")
            for at in range(0, len(batch), step):
                some = order[at : at + step]
                block = (ids[some], labels[some], matrix(*vectors, some), anchors[some], matrix(*windows, some))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block], names=_BLOCK)

    return rows.select("vec_id", "label", "vector", "anchor", "windows").mapInArrow(run, ", ".join(f"{c} binary" for c in _BLOCK))


def unpacked(row: dict, prefix: str = "") -> list[np.ndarray]:
    found = [np.frombuffer(row[prefix + c], np.float64 if c == "vectors" else np.int64) for c in _BLOCK]
    return [x.reshape(found[0].size, -1) if c in ("vectors", "windows") else x for c, x in zip(_BLOCK, found)]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; shorter rows end in zeros."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if wide * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    return (exact(a) @ exact(b).T).astype(np.int64)


def first_of(found: np.ndarray, mask: np.ndarray, many: int) -> np.ndarray:
    """The first `many` of each row where `mask` holds, as a mask: higher scores first, of equal ones those further left."""
    if not mask.size or int(mask.sum(1).max()) <= many:
        return mask
    wide = found.shape[1]
    if float(np.abs(found).max()) * wide < 2**62:
        key = np.where(mask, found * wide + np.arange(wide - 1, -1, -1), _LEAST)
        return mask & (key >= np.partition(key, wide - many, axis=1)[:, [wide - many]])
    out = np.zeros_like(mask)
    for k in range(len(mask)):
        at = np.flatnonzero(mask[k])
        out[k, at[np.argsort(-found[k, at], kind="stable")[:many]]] = True
    return out


def bounds(score, low: int, high: int):
    """The least and the largest negative score from `low` to `high` percent of a positive's."""
    whole, rest = score // 100, score % 100
    return low * whole - -low * rest // 100, high * whole + high * rest // 100


def keys(anchor_id, anchor, score, kind: int, vec_id) -> list[bytes]:
    out = np.zeros(len(score), KEY)
    for c, x in (("anchor_id", anchor_id), ("anchor", anchor), ("vec_id", vec_id)):
        out[c] = np.asarray(x, np.int64).view(np.uint64) ^ _TOP
    out["score"] = ~(np.asarray(score, np.int64).view(np.uint64) ^ _TOP)
    out["kind"] = kind
    raw, size = out.tobytes(), KEY.itemsize
    return [raw[k : k + size] for k in range(0, len(raw), size)]


def read_keys(stream: Iterator[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    top = 1 << 63
    for key in stream:
        anchor_id, anchor, score, kind, vec_id = (int.from_bytes(key[i:j]) for i, j in ((0, 8), (8, 16), (16, 24), (24, 25), (25, 33)))
        yield anchor_id - top, anchor - top, top - 1 - score, kind, vec_id - top


def emitted(ordered: Iterator[bytes], low: int, high: int, negatives: int) -> Iterator[tuple]:
    """Rows of hard negatives from one partition's keys in order."""
    current, open_windows = None, []
    for anchor_id, anchor, score, kind, vec_id in read_keys(ordered):
        if (anchor_id, anchor) != current:
            current, open_windows = (anchor_id, anchor), []
        if kind == 0:
            open_windows.append([vec_id, score, *bounds(score, low, high), 0])
            continue
        for window in open_windows:
            if window[2] <= score <= window[3] and window[4] < negatives:
                window[4] += 1
                yield anchor_id, window[0], window[4], vec_id, window[1], score


def _met(rows: DataFrame, anchors: DataFrame, names: dict[str, pa.DataType], pick) -> DataFrame:
    """Rows of what `pick` gives of each pair of a block of rows and a block of the query set."""
    both = rows.crossJoin(anchors.select(*(F.col(c).alias("a_" + c) for c in _BLOCK)).hint("shuffle_replicate_nl"))

    def run(stream):
        for batch in stream:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                (ids, labels, vectors, *_), (a_ids, a_labels, a_vectors, a_numbers, a_windows) = unpacked(row), unpacked(row, "a_")
                step = max(1, SCORES // max(1, ids.size))
                for at in range(0, a_ids.size, step):
                    q = slice(at, at + step)
                    other, same = a_ids[q, None] != ids[None], a_labels[q, None] == labels[None]
                    out = pick(scores(a_vectors[q], vectors), other & same, other & ~same, ids, a_ids[q], a_numbers[q], a_windows[q])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, names.values())], names=list(names))

    return both.mapInArrow(run, ", ".join(f"{c} {'binary' if pa.types.is_binary(t) else 'long'}" for c, t in names.items()))


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", anchors: Column | str = "vec_id % 100 = 0", scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `label` and `anchors` are over the columns of `rows`; a negative's score is from `low` to `high` percent of its positive's.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("a window is from low to high percent of a positive's score, both from 0 to 100, so that a positive comes before its negatives")
    spark = rows.sparkSession
    picked, label = (F.expr(x) if isinstance(x, str) else x for x in (anchors, label))
    none = F.array().cast("array<long>")
    row_blocks = materialize(packed(usable(rows, id_col, vector_col, label).withColumns({"anchor": F.lit(0).cast("long"), "windows": none}), ROW_BLOCK, scale), "rows")
    queries = usable(rows.where(picked), id_col, vector_col, label).withColumn("anchor", F.monotonically_increasing_id())
    queries = materialize(queries, "anchors")
    size = queries.agg(F.sum(F.greatest(F.size("vector"), F.lit(1)))).first()[0] or 1
    blocks = lambda q: packed(q.repartition(-(-size // ANCHOR_BLOCK)), ANCHOR_BLOCK, scale)

    def own_label(found, same, other, ids, a_ids, a_numbers, a_windows):
        a, r = np.nonzero(first_of(found, same, positives))
        return a_ids[a], a_numbers[a], found[a, r], ids[r]

    longs = {c: pa.int64() for c in ("anchor_id", "anchor", "score", "vec_id")}
    best = _met(row_blocks, blocks(queries.withColumn("windows", none)), longs, own_label)
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
    best = materialize(best.withColumn("nth", nth).where(F.col("nth") <= positives).drop("nth"), "positives")
    scored = queries.join(best.groupBy("anchor").agg(F.collect_list("score").alias("windows")), "anchor")

    def in_windows(found, same, other, ids, a_ids, a_numbers, a_windows):
        wanted = np.zeros_like(other)
        for w in range(a_windows.shape[1]):
            least, most = bounds(a_windows[:, [w]], low, high)
            wanted |= first_of(found, other & (found >= least) & (found <= most), negatives)
        a, r = np.nonzero(wanted)
        return (keys(a_ids[a], a_numbers[a], found[a, r], 1, ids[r]),)

    def of_positives(stream):
        for batch in stream:
            anchor_id, anchor, score, vec_id = (batch.column(k).to_numpy() for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(keys(anchor_id, anchor, score, 0, vec_id), pa.binary())], names=["key"])

    packed_keys = _met(row_blocks, blocks(scored), {"key": pa.binary()}, in_windows).unionByName(best.select(*longs).mapInArrow(of_positives, "key binary"))
    ordered = packed_keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(int(spark.conf.get("spark.sql.shuffle.partitions")), lambda key: zlib.crc32(key[:16]))
    found = ordered.mapPartitions(lambda pairs: emitted((key for key, _ in pairs), low, high, negatives))
    return spark.createDataFrame(found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label="if(vec_id % 7 = 0, (label + 1) % 10, label)")


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS nth
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE nth <= 10
"""
