"""Work folders shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset, a temporary folder on a local master, else one below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = "file://" + _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="spark-"))
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: what is used several times is computed once."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
