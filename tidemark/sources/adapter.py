"""Engine-shaped tables from the driver's star schema: weekly sessions, one symbol per supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dealing import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week(ts: str) -> F.Column:
    return F.date_trunc("week", ts).cast("date")


def micro(x: F.Column) -> F.Column:
    """Rounded to millionths in the same few floating operations everywhere."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, symbol, amount, volume, close, high, low): decimal sums, so that every engine agrees to the last digit."""
    total = lambda x, scale: F.sum(x.cast(f"decimal(18,{scale})")).cast("double")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = read(spark, sf_dir, "lineitem").select("*", week("l_shipdate").alias("date"), F.col("l_suppkey").alias("symbol"))
    # lines hardly share a date and symbol, so totals of parts of the table would be kept for little
    return dealt(rows, lines(spark, sf_dir), "date", "symbol").groupBy("date", "symbol").agg(
        total(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("amount"), total(F.col("l_quantity"), 2).alias("volume"),
        micro(total(F.col("l_extendedprice"), 2) / total(F.col("l_quantity"), 2)).alias("close"), micro(F.max(price)).alias("high"), micro(F.min(price)).alias("low"),
        F.bool_or(F.col("l_returnflag") == "A").alias("has_a"), F.count_if(F.col("l_returnflag") == "R").alias("n_r"), F.count("*").alias("n_rows"),
    )


def lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``lineitem``, from the files' footers; the panel has fewer, and so has the panel on all sessions of these tables."""
    return read(spark, sf_dir, "lineitem").count()


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date): the sessions of the panel, from one column of its table."""
    return read(spark, sf_dir, "lineitem").select(week("l_shipdate").alias("date")).distinct()


def index_series(panel: DataFrame) -> DataFrame:
    """(date, close): total amount over total volume, one row per date."""
    total = lambda c: F.sum(F.col(c).cast("decimal(28,4)")).cast("double")
    return panel.groupBy("date").agg(micro(total("amount") / total("volume")).alias("close"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, period, published, value): orders by customer, published up to 59 days after the order."""
    day = F.col("o_orderdate").cast("date")
    rows = read(spark, sf_dir, "orders").select((F.pmod("o_custkey", F.lit(100)) + 1).alias("symbol"), F.date_sub(F.trunc(day, "quarter"), 1).alias("period"), F.date_add(day, F.pmod("o_orderkey", F.lit(60)).cast("int")).alias("published"), F.col("o_totalprice").alias("value"), "o_orderkey")
    best = rows.groupBy("symbol", "period").agg(F.max_by(F.struct("published", "value"), "o_orderkey").alias("x"))
    return best.select("symbol", "period", "x.published", "x.value")


def stock_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, list_date, delist_date, industry): every seventh symbol delists two thirds of the way."""
    panel = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.min(week("l_shipdate")).alias("a"), F.max(week("l_shipdate")).alias("b"))
    end = F.when(F.col("symbol") % 7 == 0, F.date_add("a", F.floor(F.datediff("b", "a") * 2 / 3).cast("int")))
    return panel.select("symbol", F.date_add("a", 28).alias("list_date"), end.alias("delist_date"), F.concat(F.lit("I"), (F.col("symbol") % 8).cast("string")).alias("industry"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, event_type, value) from ``events``."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("ts").cast("date").alias("date"), "event_type", "value")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date): the days on which each user has a click, as quotes for event windows."""
    return user_events(spark, sf_dir).filter("event_type = 'click'").select("symbol", "date").distinct()
