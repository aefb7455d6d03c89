"""Shared pieces of the training-data operators: work folders, key filters, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once, beside one text.
TEXT_AT_ONCE = 1 << 22

_LOCAL: dict[str, str] = {}
_POWERS: dict[str, np.ndarray] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    `spark.checkpoint.dir` decides. Where it is unset, a local master gets a temporary folder
    (tests) and any other master a folder below the warehouse, which a cluster shares as well.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = "file://" + _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(columns: dict[str, pa.DataType], rows: Callable[[pa.RecordBatch], Iterator[dict[str, list]]]):
    """An Arrow mapper from a function that yields columns for each batch."""
    schema = pa.schema(list(columns.items()))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for out in rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in columns.items()], schema=schema)

    return run


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """`batch` in slices of at most TEXT_AT_ONCE bytes of the texts in `column`, beside the first text of each.

    Spark bounds the rows of an Arrow batch and not their bytes.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = (np.flatnonzero(np.diff(ends // TEXT_AT_ONCE)) + 1).tolist()
    for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(i, j - i)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least `n` powers of an odd base and of its inverse, modulo 2**64, for hashes of all stretches from prefix sums."""
    if _POWERS.get("up", np.empty(0)).size < n:
        size, base = 1 << max(16, n.bit_length()), 0x9E3779B97F4A7C15
        _POWERS["up"] = np.cumprod(np.full(size, base, np.uint64))
        _POWERS["down"] = np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with their bits spread, in place."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def key_filter(keys: DataFrame, column: str, bits: int = 27) -> np.ndarray:
    """A bit map of 2**bits bits with the low bits of every long key set.

    Its size is fixed by `bits` (16 MB at 27) whatever the number of keys, so it may be broadcast.
    A clear bit proves that a key is absent; a set bit only lets a row through to an exact join.
    """
    word = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        keys.select(F.shiftright(word, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("m"))
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
    )
    found = np.zeros(1 << (bits - 6), np.uint64)
    table = words.toArrow()
    found[table["w"].to_numpy()] = table["m"].to_numpy().view(np.uint64)
    return found


def in_filter(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 or uint64 keys may be in the filter."""
    low = keys.view(np.uint64) & np.uint64(found.size * 64 - 1)
    return (found[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges(u, v)` that is not its component's smallest node.

    Alternating large-star and small-star steps turn each component into a star; every round is
    written to the shared folder, and the number of rounds grows with the logarithm of a component. A round is kept to
    five exchanges by joins that Spark can split, as the driver keeps books for every task of a stage.
    """
    spark = edges.sparkSession
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    seen = None
    while True:
        sign = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == seen or not sign[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sign
        # as u > v, a node's smaller neighbours are all it needs to know, and each edge is moved once
        e = materialize(small_star(large_star(e)).distinct(), "edges")


def large_star(e: DataFrame) -> DataFrame:
    """Each edge (u, v) of `e`, u > v, leads from u to the smallest node beside v, v itself included."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
    return e.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def small_star(e: DataFrame) -> DataFrame:
    """Edges from each node of `e`, u > v, and from its smaller neighbours to the smallest of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")])
    return e.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u != v")
