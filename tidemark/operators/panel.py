"""Panel operators: contracts, calendar alignment, technical and cross-section features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import band, change, clip01, indicator, pct_rank, ratio, rolling, row_mean, series
from tidemark.functions.dealing import dealt


def check_contract(df: DataFrame, required: dict[str, str], key: list[str]) -> dict[str, int]:
    """Violations of a table's contract: missing columns raise, NULL and repeated keys are counted in one pass."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    per_key = df.groupBy(*key).agg(F.count("*").alias("_n"))
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    row = per_key.agg(F.sum("_n").alias("rows"), F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1).otherwise(0)).alias("repeated"), F.sum(F.when(null, F.col("_n")).otherwise(0)).alias("null_keys")).first()
    return {k: int(v or 0) for k, v in row.asDict().items()}


def densify(panel: DataFrame, calendar: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """Every symbol on every date of the calendar (default: the panel's own) from its first one on.

    Gaps carry the last close forward, trade nothing and count as suspended;
    ``raw`` tells real rows. Where the panel has them, highs, lows, limits
    and fundamental ratios of gaps are carried too, a missing open is the close before (the own close
    on the first date), flags of special treatment are carried and limit flags
    are off. The calendar is gathered in one row, a few thousand dates, and
    each symbol explodes its part of it. ``size``, about so many rows of the
    result, bounds the rows of a task in all windows by symbol.
    """
    dates = (panel if calendar is None else calendar).agg(F.array_sort(F.collect_set("date")).alias("_dates"))
    first = panel.groupBy("symbol").agg(F.min("date").alias("_first"))
    grid = first.crossJoin(F.broadcast(dates)).select("symbol", F.explode(F.filter("_dates", lambda x: x >= F.col("_first"))).alias("date"))
    real, at = panel.withColumn("raw", F.lit(True)), ("symbol", "date")
    full = dealt(dealt(grid, size, *at).join(dealt(real, size, *at), list(at), "left"), size, "symbol")
    held = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    close = F.last("close", ignorenulls=True).over(held)
    before = F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    gap, more = F.col("raw").isNull(), {}
    for c in ("high", "low", "limit_up", "limit_down", "is_st", "pe", "pb", "roe", "dividend_yield"):
        if c in panel.columns:
            more[c] = F.when(gap, F.last(c, ignorenulls=True).over(held)).otherwise(F.col(c))
    more |= {c: F.when(gap, F.lit(False)).otherwise(F.col(c)) for c in ("is_limit_up", "is_limit_down") if c in panel.columns}
    if "open" in panel.columns:
        more["open"] = F.coalesce("open", before, close)
    return full.withColumns(more | {"close": close, "raw": F.coalesce("raw", F.lit(False))}).withColumns({"amount": F.coalesce("amount", F.lit(0.0)), "volume": F.coalesce("volume", F.lit(0.0)), "is_suspended": ~F.col("raw")})


def technical_features(panel: DataFrame) -> DataFrame:
    """Momentum, volatility, drawdown, distance to the mean, share of up rows; frames count rows."""
    close = F.col("close")
    out = panel.withColumn("return_1", change(close, 1))
    r = F.col("return_1")
    return out.withColumns({
        "momentum_4": change(close, 4), "momentum_12": change(close, 12), "momentum_24": change(close, 24),
        "volatility_12": rolling(F.stddev_samp, r, 12), "downside_12": rolling(F.stddev_samp, F.when(r < 0, r).when(r.isNotNull(), 0.0), 12, 4),
        "drawdown_24": ratio(close, rolling(F.max, close, 24, 4)) - 1, "mean_gap_12": ratio(close, rolling(F.avg, close, 12, 4)) - 1,
        "up_share_24": rolling(F.avg, F.when(r.isNotNull(), indicator(r > 0)), 24, 8),
    })


def robust_factors(panel: DataFrame) -> DataFrame:
    """Row-wise scores: sane bands, clipped ratios, ranks and means of what is present."""
    rank = lambda c, **k: pct_rank(F.col(c), "date", **k)
    out = panel.withColumns({
        "value_sane": band(F.col("close"), 100.0, 2500.0), "momentum_positive": indicator(F.col("momentum_12") > 0),
        "liquidity_mid": clip01(1 - F.abs(rank("amount") - 0.62) / 0.62), "low_volatility": 1 - rank("volatility_12"), "low_downside": 1 - rank("downside_12"),
        "trend_confirmed": indicator((F.col("momentum_4") > 0) & (F.col("momentum_12") > 0) & (F.col("mean_gap_12") > 0)),
        "reversal_guard": clip01(1 - (0.45 * clip01(F.col("momentum_4") / 0.5) + 0.35 * clip01(F.col("mean_gap_12") / 0.3) + 0.20 * clip01(F.col("volatility_12") / 0.4))),
    })
    return out.withColumn("quality_stability", row_mean(F.col("low_volatility"), F.col("low_downside"), F.col("up_share_24"), F.col("reversal_guard")))


def liquid_universe(panel: DataFrame, lookback: int, least: int, top: int) -> DataFrame:
    """The ``top`` symbols of each date by mean amount of the ``lookback`` rows before it (that row left out)."""
    before = rolling(F.avg, F.col("amount"), lookback, min(least, lookback), shift=1)
    ranked = panel.withColumn("prior_amount", before).filter("prior_amount IS NOT NULL")
    order = Window.partitionBy("date").orderBy(F.desc(F.round("prior_amount", 4)), "symbol")
    return ranked.withColumn("liquidity_rank", F.row_number().over(order)).filter(F.col("liquidity_rank") <= top)


def composite(panel: DataFrame, weights: dict[str, tuple[str, float]]) -> Column:
    """Weighted sum of per-date percentile ranks; a missing factor adds nothing."""
    total = F.lit(0.0)
    for name, (direction, weight) in weights.items():
        total = total + F.coalesce(F.lit(weight) * pct_rank(F.col(name), "date", descending=direction == "asc"), F.lit(0.0))
    return F.round(total, 9)


def first_sessions(panel: DataFrame, unit: str = "month") -> DataFrame:
    """The first date of each month or week."""
    return panel.groupBy(F.date_trunc(unit, "date").alias("_p")).agg(F.min("date").alias("date")).select("date")


def select_top(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best scores of each date, ties to the smaller symbol."""
    order = Window.partitionBy("date").orderBy(F.desc("score"), "symbol")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def select_capped(scored: DataFrame, k: int, group: str, share: float) -> DataFrame:
    """As ``select_top``, with at most max(1, floor(k * share)) of a group first; what is deferred fills up the rest."""
    cap = max(1, int(k * share))
    inside = F.row_number().over(Window.partitionBy("date", group).orderBy(F.desc("score"), "symbol"))
    marked = scored.withColumn("deferred", (inside > cap).cast("int"))
    order = Window.partitionBy("date").orderBy("deferred", F.desc("score"), "symbol")
    return marked.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def score_buckets(scored: DataFrame, by: str, buckets: int) -> DataFrame:
    """Quantile bucket 1..``buckets`` of ``by`` within each date, ties in symbol order; NULL is bucket 0."""
    w = Window.partitionBy("date", F.col(by).isNull()).orderBy(by, "symbol")
    n = F.count(by).over(Window.partitionBy("date"))
    return scored.withColumn("bucket", F.when(F.col(by).isNull(), 0).otherwise(F.ceil(F.row_number().over(w) / n * buckets)).cast("int"))


def market_health(panel: DataFrame) -> DataFrame:
    """Per date: breadths, medians and their values one date earlier; one row per date, so one small sort."""
    share = lambda c: F.avg(F.when(F.col(c).isNotNull(), indicator(F.col(c) > 0)))
    days = panel.groupBy("date").agg(share("momentum_4").alias("breadth_4"), share("momentum_12").alias("breadth_12"), share("mean_gap_12").alias("above_mean"), F.median("momentum_12").alias("median_momentum"), F.median("volatility_12").alias("median_volatility"))
    w = Window.orderBy("date")
    return days.withColumns({f"{c}_lag1": F.lag(c).over(w) for c in days.columns if c != "date"})


def regime_features(index: DataFrame) -> DataFrame:
    """Lagged trend and volatility of one index series (date, close), with the 80 % quantile of past volatility."""
    w = Window.orderBy("date")
    out = index.withColumn("r", change(F.col("close"), 1, w))
    out = out.withColumns({"mean_12": rolling(F.avg, F.col("close"), 12, 6, w), "vol_12": rolling(F.stddev_samp, F.col("r"), 12, 6, w)})
    q80 = lambda x: F.percentile(x, 0.8)
    out = out.withColumn("vol_q80", rolling(q80, F.col("vol_12"), 52, 24, w))
    held = {c: F.lag(c).over(w) for c in ("close", "mean_12", "vol_12", "vol_q80")}
    out = out.withColumns({f"{c}_lag1": v for c, v in held.items()})
    return out.withColumn("trend_on", indicator(F.col("close_lag1") > F.col("mean_12_lag1"))).withColumn("vol_high", indicator(F.col("vol_12_lag1") > F.col("vol_q80_lag1")))


def block_status(side: str = "buy") -> Column:
    """Why an order can't be filled, first reason first; NULL if it can."""
    limit, flag = ("limit_up", "is_limit_up") if side == "buy" else ("limit_down", "is_limit_down")
    reached = F.col("open") >= F.col("limit_up") if side == "buy" else F.col("open") <= F.col("limit_down")
    unknown = F.col("is_st").isNull() | F.col("is_suspended").isNull() | F.col(limit).isNull() | F.col(flag).isNull()
    out = F.when(F.col("open").isNull() | (F.col("open") <= 0), "blocked_missing_open").when(unknown, "blocked_missing_constraint").when(F.col("is_suspended"), "blocked_suspended")
    if side == "buy":
        out = out.when(F.col("is_st"), "blocked_st")
    return out.when(F.col(flag) | reached, f"blocked_{limit}")


def keyword_flags(events: DataFrame, text: str, keywords: dict[str, list[str]]) -> DataFrame:
    """A 0/1 column per category: any of its keywords in the lower-cased text."""
    flags = {}
    for name, words in keywords.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(word))
        flags[name] = hit.cast("int")
    return events.withColumns(flags)
