"""Panels from quote tables: scans by dates and symbols, masters with one row for each symbol, aligned panels with features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.panel import check_contract, densify, technical_features
from tidemark.sources import readers
from tidemark.sources.assets import AssetError, read_texts


def scan_quotes(spark: SparkSession, path: str, start: str, end: str, symbols: DataFrame | None = None, fmt: str = "csv") -> DataFrame:
    """Quotes from ``start`` to ``end``, of ``symbols`` only if they are given; of rows of a symbol and date the greatest stays.

    Dates and symbols are judged before anything is shuffled. Rows without a
    date, symbol or close go; AssetError if none is left.
    """
    contract = readers.QUOTES
    rows = readers.parse(read_texts(spark, path, fmt), contract).filter("date IS NOT NULL AND symbol IS NOT NULL AND close IS NOT NULL")
    rows = rows.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if symbols is not None:
        rows = rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    rest = [c for c in rows.columns if c not in contract.key]
    # a row that knows more comes before one that knows less of the same values
    rows = rows.groupBy(*contract.key).agg(F.max(F.struct(*rest)).alias("_row")).select(*contract.key, "_row.*")
    if not rows.limit(1).count():
        raise AssetError(f"no quotes from {start} to {end}")
    return rows


def scan_master(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """One row for each symbol: the first listing, the last delisting if no row is without one, and the greatest of other values."""
    rows = readers.parse(read_texts(spark, path, fmt), readers.MASTER).filter("symbol IS NOT NULL")
    still = F.bool_or(F.col("delist_date").isNull())
    return rows.groupBy("symbol").agg(F.min("list_date").alias("list_date"), F.when(~still, F.max("delist_date")).alias("delist_date"), F.max("list_status").alias("list_status"), F.max("stock_type").alias("stock_type"))


def prepared_panel(quotes: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Quotes aligned to a calendar with technical features; ValueError if a key is missing or repeated."""
    faults = check_contract(quotes, {"date": "date", "symbol": "string", "close": "double", "amount": "double", "volume": "double"}, ["date", "symbol"])
    if faults["repeated"] or faults["null_keys"]:
        raise ValueError(f"quotes can't be prepared: {faults}")
    return technical_features(densify(quotes, calendar))


def synthetic_quotes(spark: SparkSession, symbols: int, days: int, seed: int = 1, start: str = "2020-01-01") -> DataFrame:
    """Made-up quotes that are the same on every run: a hash of seed, symbol and day moves each price; for trials and tests."""
    at = spark.range(symbols * days).select((F.col("id") / days).cast("long").alias("s"), (F.col("id") % days).alias("d"))
    unit = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), "s", *salt), F.lit(1_000_003)) / 1_000_003
    # the walk's height is a sum of a few waves, so that a day's price needs no day before it
    walk = sum((F.sin(F.col("d") * 6.2832 / period + unit(F.lit(period)) * 6.2832) / k for k, period in enumerate((7, 23, 61, 180), 2)), F.lit(0.0))
    close = F.round((5 + 45 * unit(F.lit(0))) * F.exp(0.1 * walk + 0.02 * (unit("d", F.lit(1)) - 0.5)), 2)
    volume = F.round(1000 + 90_000 * unit("d", F.lit(2)))
    symbol = F.concat(F.lpad(F.col("s").cast("string"), 6, "0"), F.when(F.col("s") % 2 == 0, ".SZ").otherwise(".SH"))
    rows = at.select(F.date_add(F.lit(start).cast("date"), F.col("d").cast("int")).alias("date"), symbol.alias("symbol"), close.alias("close"), volume.alias("volume"))
    return rows.withColumns({"open": F.round(F.col("close") * 0.99, 2), "high": F.round(F.col("close") * 1.02, 2), "low": F.round(F.col("close") * 0.97, 2), "amount": F.round(F.col("close") * F.col("volume"), 2)})
