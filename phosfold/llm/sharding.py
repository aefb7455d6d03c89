"""A consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `points` arcs of a ring of 64-bit hashes. A row's key is hashed onto the ring and
belongs to the arc there; when that arc's shard is full, the row goes on clockwise to the next arc
whose shard has room. Capacities are the row count divided by the number of shards, rounded down or
up, so the counts of two shards differ by at most one (law `rows`).

Only the counts of arcs, whose number is a setting, reach the driver. Rows of one arc are placed in
the order of their hash; so the plan gives each arc a few ranges of ranks, each with its shard and
its first slot, and Spark joins rows to it by arc and rank. An arc's rows are ranked within
equal slices of its hashes, so no task sorts a whole arc.

The key is doc_id with the text's CRC, so rows without an id spread as well. Equal rows share a
position and get neighbouring slots. A null text has size 8 and CRC 0. An empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = 64
SLICES = 16


def ring(shards: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the arcs in ascending order, and the shard of each. A new shard only adds points."""
    ends = [(xxhash.xxh64_intdigest(f"shard {s} point {p}"), s) for s in range(shards) for p in range(points)]
    ends.sort()
    return np.array([e for e, _ in ends], np.uint64), np.array([s for _, s in ends])


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: np.ndarray, owners: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rank behind the last, shard, first slot) for the rows of all arcs.

    All rows try the shard of their arc at once, then those it has no room for try the next arc's,
    and so on around the ring; within a shard, arcs are served in ring order and low ranks first.
    """
    room, filled, placed = list(room), [0] * len(room), []
    waiting = [(a, 0, int(n), a) for a, n in enumerate(counts) if n]
    while waiting:
        onward = []
        for arc, low, high, at in sorted(waiting, key=lambda w: (w[3], w[0], w[1])):
            shard = int(owners[at])
            take = min(room[shard], high - low)
            if take:
                placed.append((arc, low, low + take, shard, filled[shard]))
                room[shard] -= take
                filled[shard] += take
            if low + take < high:
                onward.append((arc, low + take, high, (at + 1) % len(owners)))
        waiting = onward
    return placed


def shard_rows(docs: DataFrame, shards: int, points: int = POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64(F.col("doc_id"), "text_crc32"))
    ends, owners = ring(shards, points)

    def locate(stream):
        for batch in stream:
            h = batch.column("h").to_numpy().view(np.uint64)
            arc = np.searchsorted(ends, h)
            start, stop = ends[arc - 1], ends[arc % ends.size]
            share = (h - start).astype(np.float64) / np.maximum((stop - start).astype(np.float64), 1)
            cut = np.minimum(share * SLICES, SLICES - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((arc % ends.size).astype(np.int32)), pa.array(cut)], names=[*batch.schema.names, "arc", "cut"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(locate, f"doc_id {kind}, size long, text_crc32 long, h long, arc int, cut int")
    # one row for each slice of an arc, as many as the settings say
    found = {(r[0], r[1]): r[2] for r in rows.groupBy("arc", "cut").count().collect()}
    counts, firsts = np.zeros(ends.size, np.int64), []
    for (arc, cut), n in sorted(found.items()):
        firsts.append((arc, cut, int(counts[arc])))
        counts[arc] += n
    plan = place(counts, owners, capacities(int(counts.sum()), shards))
    firsts = spark.createDataFrame(firsts or [(0, 0, 0)], "arc int, cut int, first long")
    plan = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "arc int, low long, high long, shard int, base long")
    order = Window.partitionBy("arc", "cut").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(firsts), ["arc", "cut"]).withColumn("rank", F.col("rank") + F.col("first"))
    placed = ranked.join(F.broadcast(plan), "arc").where("low <= rank and rank < high")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))


def op4_sharding(spark, sf_dir):
    placed = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
