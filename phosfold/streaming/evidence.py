"""Evidence from a stream of measurements, in windows of event time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import work_path


def windowed_evidence(measured: DataFrame, threshold: float, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, sample, accession, site, value, n) of sites whose mean in a window reaches the threshold.

    `measured` has (ts, sample, accession, site, value), as a table or a stream; a stream's windows
    are given out once the watermark has passed them, and rows that come later are left out, unless
    its sink takes the complete state, as `drain` does.
    """
    if measured.isStreaming:
        measured = measured.withWatermark("ts", late)
    means = measured.where("value is not null").groupBy(F.window("ts", width).alias("w"), "sample", "accession", "site").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return means.where(F.col("value") >= threshold).select(F.col("w.start").alias("start"), "sample", "accession", "site", "value", "n")


def merged_evidence(measured: DataFrame, threshold: float, name: str, width: str = "1 day") -> DataFrame:
    """The windows of `windowed_evidence` over all of a finite stream, however late its rows come, without any state.

    Each batch writes its own sums and counts, under its number, so a batch that is repeated replaces itself; they are
    merged when the stream is through.
    """
    spark, unit = measured.sparkSession, ["start", "sample", "accession", "site"]
    out, log = work_path(spark, name), work_path(spark, f"{name}-log")
    parts = measured.where("value is not null").select(F.window("ts", width)["start"].alias("start"), *unit[1:], "value")

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*unit).agg(F.sum("value").alias("value"), F.count("*").alias("n"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    parts.writeStream.foreachBatch(put).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    schema = "start timestamp, sample string, accession string, site string, value double, n bigint"
    # a stream without rows has written nothing
    there = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    try:
        sums = there.parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        sums = spark.createDataFrame([], schema)
    total = sums.groupBy(*unit).agg((F.sum("value") / F.sum("n")).alias("value"), F.sum("n").alias("n"))
    return total.where(F.col("value") >= threshold)


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All that a finite stream of aggregates gives, with the windows that the watermark has not passed: each batch writes the whole state, the last one counts."""
    out, state = work_path(spark, name), work_path(spark, f"{name}-state")
    written = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        written.append(number)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/{written[-1]}") if written else spark.createDataFrame([], stream.schema)


def running_counts(stream: DataFrame) -> DataFrame:
    """(sample, n): measurements of each sample so far, for sinks that take updates."""
    return stream.groupBy("sample").agg(F.count("value").alias("n"))
