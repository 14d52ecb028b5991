"""A registry of runs: nested records kept as they came, flattened by rules that know all of their versions; units of amounts.

Records are appended as VARIANT, so a new version of a record needs no new
table. ``flatten`` reads a field from the first of its paths that a record
has, whatever the version.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Units that amounts come in, as multiples of price times volume (fixed values: yuan, lots of a hundred, thousands, ten thousands).
UNITS = (0.0001, 0.001, 0.01, 1.0, 100.0, 1000.0, 10000.0)


def parsed(raw: DataFrame, key: str = "run_id", created: str = "created", record: str = "record") -> DataFrame:
    """(run_id, created, record, readable) of JSON texts; what isn't JSON is kept as an unreadable run."""
    value = F.try_parse_json(record)
    return raw.select(F.col(key).alias("run_id"), F.col(created).alias("created"), value.alias("record"), value.isNotNull().alias("readable"))


def append(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Add runs to the registry at ``path``; nothing that is there is changed."""
    rows.select("run_id", "created", "record", "readable").write.mode("append").parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """The last record of each run by its time: later ones replace earlier ones."""
    return rows.groupBy("run_id").agg(F.max("created").alias("created"), F.max_by("record", "created").alias("record"), F.max_by("readable", "created").alias("readable"), F.count("*").alias("versions"))


def flatten(rows: DataFrame, fields: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """``rows`` with a column for each field: {name: (type, paths)}; NULL if no path has a value of that type."""
    value = lambda kind, path: F.try_variant_get("record", path, kind)
    return rows.select(*(c for c in rows.columns if c != "record"), *(F.coalesce(*(value(kind, p) for p in paths)).alias(name) for name, (kind, paths) in fields.items()))


def unknown_fields(rows: DataFrame, known: list[str]) -> DataFrame:
    """(field, runs) of top-level fields that the rules don't know: how records of another version show."""
    names = F.json_object_keys(F.to_json("record"))
    return rows.filter("record IS NOT NULL").select(F.explode(names).alias("field")).filter(~F.col("field").isin(known)).groupBy("field").agg(F.count("*").alias("runs"))


def amount_units(quotes: DataFrame, by: list[str], tolerance: float = 0.25) -> DataFrame:
    """(by, n, scale, unit, verified): in what unit the amounts of each group are.

    ``quotes`` has amount, volume and close. The scale is the median of amount
    over volume times close on a log scale, so a half of odd rows can't move it
    far; the unit is the nearest of ``UNITS`` on that scale, and verified if it
    is within ``tolerance`` of a factor of ten.
    """
    whole = (F.col("amount") > 0) & (F.col("volume") > 0) & (F.col("close") > 0)
    logged = F.when(whole, F.log10(F.when(whole, F.col("amount") / (F.col("volume") * F.col("close")))))
    out = quotes.groupBy(*by).agg(F.count(logged).alias("n"), F.median(logged).alias("_log"))
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col("_log") - math.log10(u)).alias("apart"), F.lit(u).alias("unit")) for u in UNITS)))
    out = out.withColumn("_near", F.when(F.col("_log").isNotNull(), nearest))
    return out.select(*by, "n", F.pow(F.lit(10.0), "_log").alias("scale"), F.col("_near.unit").alias("unit"), F.coalesce(F.col("_near.apart") <= tolerance, F.lit(False)).alias("verified"))


def unit_breaks(units: DataFrame, by: str, order: str) -> DataFrame:
    """(by, from, to, unit_before, unit_after): where the unit of a source changes from one period to the next."""
    w = Window.partitionBy(by).orderBy(order)
    known = units.filter("unit IS NOT NULL")
    moved = known.withColumns({"unit_before": F.lag("unit").over(w), "from": F.lag(order).over(w)})
    return moved.filter("unit_before IS NOT NULL AND unit_before <> unit").select(by, "from", F.col(order).alias("to"), "unit_before", F.col("unit").alias("unit_after"))
