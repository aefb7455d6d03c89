"""Places in an order over all rows, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import materialize


def numbered(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """`rows` with their place, from 1, in an order that no two rows share.

    Rows are dealt into ranges of the order, numbered within each, and moved on by what the ranges before hold:
    one number for each range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(ahead), "_range").withColumn(name, (within + F.col("_ahead")).cast("int")).select(*rows.columns, name)
