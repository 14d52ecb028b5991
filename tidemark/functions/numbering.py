"""Numbers of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dealing import tasks
from tidemark.sources.scratch import materialize

_PLACES = 33  # bits of monotonically_increasing_id below the partition's number


def numbered(df: DataFrame, keys: list[str], name: str = "number", size: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the order of ``keys``.

    Rows are dealt out by ranges of the keys and sorted there; the sizes of the
    ranges (a row for each) give every range its first number. Rows that agree
    in all keys are numbered in any order, so keys should tell rows apart. The
    sorted rows are written once, as ranges are sampled and a second sampling
    could deal them out otherwise. ``size``, about so many rows, sets the
    number of ranges; else it is that of shuffle partitions.
    """
    ranges = df.repartitionByRange(*keys) if size is None else df.repartitionByRange(tasks(size), *keys)
    placed = ranges.sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumn("_range", F.shiftright("_place", _PLACES))
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.select("_range", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_first"))
    at = F.col("_first") + F.col("_place").bitwiseAND(F.lit(2**_PLACES - 1))
    return placed.join(F.broadcast(first), "_range").withColumn(name, at.cast("long")).drop("_range", "_place", "_first")
