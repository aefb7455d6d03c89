"""Tables behind plots and reports; drawing itself is left to the caller's tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import minus_log10
from .places import numbered

GREEK, LATIN = "αβγδεκ", "abgdek"


def dots(activity: DataFrame, alpha: float = 0.05, row: str = "kinase", column: str = "sample") -> DataFrame:
    """(kinase, sample, x, y, size, colour): places on the axes, -log10 p as size, significance as colour."""
    place = lambda c, name: numbered(activity.select(c).distinct(), name, c).withColumn(name, (F.col(name) - 1) * 10 + 5)
    rows = activity.join(place(column, "x"), column).join(place(row, "y"), row)
    return rows.select(row, column, "x", "y", minus_log10(F.col("mw_p")).alias("size"), (F.col("fpr") <= alpha).cast("int").alias("colour"))


def context_cells(context: DataFrame, id_col: str, categories: list[str], order: DataFrame) -> DataFrame:
    """(id, position, category, value): annotations next to the samples' places on an axis (id, position)."""
    long = context.select(F.col(id_col).alias("id"), *[F.col(c).cast("string") for c in categories]).unpivot(["id"], categories, "category", "value")
    return long.join(order, "id").select("id", "position", "category", "value")


def ordered_by(activity: DataFrame, column: str, value, wanted: str) -> DataFrame:
    """The other axis' names in the order of the values in one row or column."""
    other = "kinase" if column == "sample" else "sample"
    rows = activity.where(F.col(column) == value)
    return numbered(rows.select(other, wanted), "position", wanted, other).select(other, "position")


def printable(text: Column) -> Column:
    """Greek letters as Latin ones, and nothing else outside of ASCII."""
    return F.regexp_replace(F.translate(text, GREEK, LATIN), r"[^\x20-\x7E]", "")


def substrate_key(accession: str = "accession", site: str = "site") -> Column:
    return F.concat_ws("_", accession, site)
