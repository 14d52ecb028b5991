"""Evidence gates: what a study's data and cells must fulfil before anything may be claimed, with a code for each unmet rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coded(rules: dict[str, Column]) -> Column:
    """The codes of the rules that are broken, in the rules' order; a rule of unknown outcome is broken."""
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(code)) for code, broken in rules.items())))


def monthly_cells(cells: DataFrame, registry: DataFrame, least_symbols: int) -> DataFrame:
    """(date, cells, unknown, valid, unresolved, smallest, complete) of each date.

    ``cells`` has a row for each date, variant and factor; ``registry`` the
    (variant, factor) that every date must have, and no others. A cell is valid
    with both figures over ``least_symbols`` symbols or more.
    """
    want = F.broadcast(registry.select("variant", "factor").distinct().withColumn("listed", F.lit(1)))
    sizes = registry.select("variant", "factor").distinct().agg(F.count("*").alias("all"))
    valid = F.col("ic").isNotNull() & F.col("spread").isNotNull() & (F.col("n") >= least_symbols)
    days = cells.join(want, ["variant", "factor"], "left").groupBy("date").agg(
        F.count("*").alias("cells"), F.count_if(F.col("listed").isNull()).alias("unknown"), F.count_distinct(F.when(F.col("listed") == 1, F.struct("variant", "factor"))).alias("known"),
        F.count_if(valid).alias("valid"), F.sum("unresolved").alias("unresolved"), F.min("n").alias("smallest"),
    )
    days = days.crossJoin(F.broadcast(sizes))
    # as many rows as registered cells, all of them different and registered, and every one valid
    whole = (F.col("cells") == F.col("all")) & (F.col("known") == F.col("all")) & (F.col("valid") == F.col("all"))
    return days.withColumn("complete", whole).withColumn("right_size", F.col("cells") == F.col("all")).drop("all", "known")


def status(days: DataFrame, months: DataFrame, classification: str, complete_months: int) -> DataFrame:
    """One row: ``code``, ``reasons``, ``passed``, complete dates and the smallest section.

    ``days`` is ``monthly_cells``, ``months`` the registered first days of
    months (``month``). Nothing observed breaks every rule but the unresolved one.
    """
    seen = days.select(F.trunc("date", "month").alias("month")).distinct().withColumn("seen", F.lit(1))
    both = months.select("month").distinct().withColumn("wanted", F.lit(1)).join(seen, "month", "full_outer")
    gaps = both.agg(F.count_if(F.col("seen").isNull() | F.col("wanted").isNull()).alias("gaps"))
    whole = days.agg(F.count("*").alias("dates"), F.count_if("complete").alias("complete"), F.count_if(~F.col("right_size")).alias("wrong_size"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"), F.coalesce(F.min("smallest"), F.lit(0)).alias("smallest_section"))
    reasons = coded({
        "SYNTHETIC_DATA": F.lit(classification != "real_market_data"),
        "UNRESOLVED_FORWARD_ENDPOINTS": F.col("unresolved") > 0,
        "MISSING_REGISTERED_REBALANCES": F.col("gaps") > 0,
        "INCOMPLETE_REGISTERED_MONTHLY_CELLS": (F.col("complete") != F.col("dates")) | (F.col("wrong_size") > 0),
        "INSUFFICIENT_COMPLETE_REGISTERED_REBALANCES": F.col("complete") != complete_months,
    })
    rows = whole.crossJoin(gaps).withColumn("reasons", reasons)
    passed = F.size("reasons") == 0
    code = F.when(passed, "REAL_MARKET_REGISTERED_HISTORICAL_IC_CORE_STATISTICS").otherwise("INSUFFICIENT_EVIDENCE")
    return rows.select(code.alias("code"), F.array_join("reasons", ",").alias("reasons"), passed.alias("passed"), F.col("complete").alias("complete_dates"), "smallest_section")


def early_status(classification: str, symbols: int | Column, rebalances: int | Column, least_symbols: int, least_rebalances: int) -> Column:
    """The early study's codes, joined by commas; empty if its evidence is enough."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    rules = {"SYNTHETIC_DATA": F.lit(classification != "real_market_data"), "INSUFFICIENT_SYMBOL_COVERAGE": as_column(symbols) < least_symbols, "INSUFFICIENT_OOS_REBALANCES": as_column(rebalances) < least_rebalances}
    return F.array_join(coded(rules), ",")
