"""Row-wise and cross-section factor families over a panel that has their inputs.

Each family is a function from a panel to the panel with its columns. Missing
inputs give NULL scores, except where a score counts what is there: indicators
are 0 for a missing value, and risks add nothing for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import band, clip, clip01, indicator, pct_rank, ratio, rolling, row_mean, series
from tidemark.functions.dealing import dealt


def _c(name: str) -> Column:
    return F.col(name)


def _or(x: Column, value: float = 0.0) -> Column:
    return F.coalesce(x, F.lit(value))


def _rank(name: str) -> Column:
    return pct_rank(F.col(name), "date")


def _affine(x: Column, low: float, high: float) -> Column:
    """0 at ``low`` and below, 1 at ``high`` and above."""
    return (clip(x, low, high) - low) / (high - low)


def dividend_yields(panel: DataFrame) -> DataFrame:
    y = _c("dividend_yield")
    return panel.withColumns({"dividend_yield_capped": F.when((y >= 0) & (y <= 0.20), clip(y, 0.0, 0.12)), "dividend_yield_sane": band(y, 0.0, 0.12), "dividend_yield_valid_score": indicator((y >= 0.005) & (y <= 0.12))})


def dividend_event_scores(panel: DataFrame) -> DataFrame:
    """From counts, cash and days of ``events.dividend_windows`` and the close."""
    cash_yield = ratio(_or(_c("dividend_event_cash_365d")), F.when(_c("close") > 0, _c("close")))
    out = panel.withColumns({
        "dividend_event_yield_365d": band(cash_yield, 0.0, 0.20), "dividend_event_regular_score": clip(_or(_c("dividend_event_count_365d").cast("double")), 0.0, 4.0) / 4,
        "dividend_event_recent_score": _or(1 - clip(_c("dividend_event_days_since_last"), 0.0, 365.0) / 365), "dividend_event_cash_score": clip(cash_yield, 0.0, 0.08) / 0.08,
    })
    return out.withColumn("dividend_event_quality_score", row_mean(_c("dividend_event_regular_score"), _c("dividend_event_recent_score"), _c("dividend_event_cash_score")))


def capital_flows(panel: DataFrame, size: int | None = None) -> DataFrame:
    """Net inflows, in units of 10,000, against the amount traded: strength, persistence and a guard against outflows.

    ``size``, about so many rows, bounds the rows of a task in windows by symbol and in ranks by date.
    """
    panel = dealt(panel, size, "symbol")
    traded = F.when(_c("amount") > 0, _c("amount"))
    out = panel.withColumns({f"{k}_net_inflow_to_amount": ratio(_c(f"{k}_net_inflow") * 10000, traded) for k in ("main", "large", "xlarge")})
    # rounded, so that ties in its rank don't depend on the order of a sum
    out = out.withColumn("flow_persistence_20d_raw", F.round(rolling(F.avg, _c("main_net_inflow_to_amount"), 20, 5), 12))
    out = dealt(out, size, "date")
    main, xlarge = _c("main_net_inflow_to_amount"), _c("xlarge_net_inflow_to_amount")
    risk = 0.60 * _or(-clip(main, -0.08, 0.0) / 0.08) + 0.40 * _or(-clip(xlarge, -0.05, 0.0) / 0.05)
    out = out.withColumns({
        "main_flow_strength_score": _rank("main_net_inflow_to_amount"), "large_flow_strength_score": _rank("large_net_inflow_to_amount"), "xlarge_flow_strength_score": _rank("xlarge_net_inflow_to_amount"),
        "main_flow_positive_score": F.when(_c("main_net_inflow").isNotNull(), indicator(_c("main_net_inflow") > 0)), "flow_persistence_20d_score": _rank("flow_persistence_20d_raw"),
        "flow_reversal_guard_score": F.when(main.isNotNull() | xlarge.isNotNull(), clip01(1 - risk)),
    })
    parts = ("main_flow_strength_score", "large_flow_strength_score", "xlarge_flow_strength_score", "flow_persistence_20d_score", "flow_reversal_guard_score")
    return out.withColumn("capital_flow_quality_score", clip01(row_mean(*map(_c, parts))))


def margin_trades(panel: DataFrame) -> DataFrame:
    """Margin buying, repayment and balances against the amount traded."""
    traded = F.when(_c("amount") > 0, _c("amount"))
    net = _c("margin_buy") - _c("margin_repay")
    out = panel.withColumns({
        "margin_net_buy_amount": net, "margin_buy_to_amount": ratio(_c("margin_buy"), traded), "margin_repay_to_amount": ratio(_c("margin_repay"), traded), "margin_net_buy_to_amount": ratio(net, traded),
        "margin_balance_to_amount": ratio(_c("margin_balance"), traded), "short_balance_to_amount": ratio(_c("short_balance"), traded),
    })
    share = _c("margin_net_buy_to_amount")
    out = out.withColumns({
        "margin_net_buy_strength_score": _rank("margin_net_buy_to_amount"), "margin_deleveraging_guard_score": F.when(share.isNotNull(), clip01(1 + clip(share, -0.20, 0.0) / 0.20)),
        "margin_balance_crowding_guard_score": clip01(1 - _rank("margin_balance_to_amount")), "margin_short_pressure_guard_score": clip01(1 - _rank("short_balance_to_amount")),
    })
    out = out.withColumn("margin_leverage_flow_score", clip01(row_mean(_c("margin_net_buy_strength_score"), _c("margin_deleveraging_guard_score"))))
    return out.withColumn("margin_trade_quality_score", clip01(row_mean(_c("margin_leverage_flow_score"), _c("margin_balance_crowding_guard_score"), _c("margin_short_pressure_guard_score"))))


def abnormal_list_scores(panel: DataFrame) -> DataFrame:
    """From ``events.abnormal_list_windows``: attention, amount, recency and a cool-down after hectic days."""
    out = panel.withColumns({
        "abnormal_attention_score": clip(_or(_c("abnormal_count_90d").cast("double")), 0.0, 3.0) / 3, "abnormal_amount_score": _rank("abnormal_amount_90d"),
        "abnormal_recency_score": _or(1 - clip(_c("abnormal_days_since_last"), 0.0, 90.0) / 90),
    })
    attention, recency = _c("abnormal_attention_score"), _c("abnormal_recency_score")
    out = out.withColumn("abnormal_cooldown_score", clip01(1 - (0.55 * attention * recency + 0.45 * (clip(F.abs("abnormal_max_deviation_90d"), 0.0, 15.0) / 15) * recency)))
    return out.withColumn("abnormal_event_score", clip01(row_mean(attention, _c("abnormal_amount_score"), recency)))


def announcement_scores(panel: DataFrame) -> DataFrame:
    """From ``events.announcement_windows``."""
    n = lambda name: _or(_c(name).cast("double"))
    out = panel.withColumns({
        "announcement_activity_score": clip(n("announcement_count_90d"), 0.0, 8.0) / 8, "announcement_recency_score": _or(1 - clip(_c("announcement_days_since_last"), 0.0, 90.0) / 90),
        "announcement_noise_guard_score": 1 - clip(n("announcement_count_30d"), 0.0, 10.0) / 10, "announcement_buyback_activity_score": clip(n("announcement_buyback_count_180d"), 0.0, 2.0) / 2,
        "announcement_shareholder_return_score": clip(n("announcement_dividend_count_365d"), 0.0, 3.0) / 3, "announcement_risk_alert_guard_score": 1 - clip(n("announcement_risk_alert_count_365d"), 0.0, 3.0) / 3,
        "announcement_financing_cooldown_score": 1 - clip(n("announcement_financing_count_365d"), 0.0, 4.0) / 4, "announcement_reorg_cooldown_score": 1 - clip(n("announcement_reorg_count_365d"), 0.0, 3.0) / 3,
    })
    mean = lambda *names: clip01(row_mean(*(_c(f"announcement_{x}_score") for x in names)))
    return out.withColumns({"announcement_stability_guard_score": mean("noise_guard", "risk_alert_guard", "financing_cooldown", "reorg_cooldown"), "announcement_event_score": mean("activity", "recency", "buyback_activity", "shareholder_return")})


def valuations(panel: DataFrame) -> DataFrame:
    pe, pb = _c("pe"), _c("pb")
    inside = (pe > 0) & (pe < 80)
    return panel.withColumns({"pe_sane": F.when(inside, pe), "pe_valid_score": indicator(inside), "pb_sane": band(pb, 0.1, 20.0), "pb_valid_score": indicator((pb >= 0.1) & (pb <= 20))})


def returns_on_equity(panel: DataFrame, rows: int = 252) -> DataFrame:
    """The level, its sign, its change over ``rows`` rows, and whether both are up."""
    roe = _c("roe")
    out = panel.withColumns({"roe_sane": F.when((roe >= -0.50) & (roe <= 0.60), clip(roe, -0.30, 0.40)), "roe_positive_score": indicator(roe > 0)})
    out = out.withColumn("roe_delta", _c("roe_sane") - F.lag("roe_sane", rows).over(series()))
    return out.withColumn("roe_repair_score", indicator((_c("roe_sane") > 0) & (_c("roe_delta") > 0)))


#: Input, sane band, and the ends of its score from 0 to 1.
STATEMENTS = {
    "profitability": (("gross_margin", (-0.20, 0.95), (0.0, 0.65)), ("net_margin", (-0.50, 0.60), (0.0, 0.35)), ("roic", (-0.50, 0.80), (0.0, 0.30))),
    "growth": (("rev_growth", (-0.80, 2.00), (-0.20, 0.60)), ("np_growth", (-1.00, 3.00), (-0.30, 0.80)), ("cfo_growth", (-2.00, 5.00), (-0.50, 1.00))),
    "cashflow": (("ocf_to_net_profit", (-5.00, 8.00), (0.0, 2.0)), ("cfo_to_revenue", (-1.00, 1.50), (0.0, 0.45))),
    "balance_sheet": (("cash_debt_ratio", (0.0, 10.0), (0.0, 3.0)), ("f_score", (0.0, 9.0), (0.0, 9.0))),
}


def statement_quality(panel: DataFrame, family: str) -> DataFrame:
    """Sane values and scores of one family of statement ratios, and the mean of its scores."""
    out, scores = panel, []
    for name, sane, ends in STATEMENTS[family]:
        out = out.withColumns({f"{name}_sane": band(_c(name), *sane), f"{name}_score": _affine(_c(name), *ends)})
        scores.append(f"{name}_score")
    if family == "cashflow":
        out, scores = out.withColumn("fcf_positive_score", indicator(_c("fcf") > 0)), [*scores, "fcf_positive_score"]
    if family == "balance_sheet":
        debt = _c("debt_asset_ratio")
        out = out.withColumns({"debt_asset_ratio_sane": band(debt, 0.0, 1.2), "low_debt_score": 1 - clip(debt, 0.0, 0.90) / 0.90})
        scores.append("low_debt_score")
    return out.withColumn(f"{family}_quality_score", row_mean(*map(_c, scores)))


def liquidity_scores(panel: DataFrame) -> DataFrame:
    """A tent around the 62nd percentile of amounts, a penalty for the top, and the same for turnover around the 55th."""
    tent = lambda rank, top: clip01(1 - F.abs(rank - top) / top)
    amount, turnover = _rank("amount"), _rank("turnover")
    return panel.withColumns({"liquidity_mid_score": tent(amount, 0.62), "liquidity_top_penalty_score": clip01(1 - amount), "turnover_sane_score": indicator((_c("turnover") >= 0.002) & (_c("turnover") <= 0.08)), "turnover_mid_score": tent(turnover, 0.55)})


def trend_scores(panel: DataFrame) -> DataFrame:
    """Confirmation without overheating, and the six-part quality of the long trend."""
    fast, slow, drawdown = _c("momentum_fast"), _c("momentum_slow"), _c("drawdown")
    parts = (_affine(slow, -0.10, 0.30), _affine(_c("momentum_long"), -0.15, 0.45), _affine(_c("momentum_year"), -0.20, 0.60), 1 + clip(_c("drawdown_year"), -0.45, 0.0) / 0.45, _affine(_c("up_share"), 0.40, 0.64), _affine(_c("mean_gap"), -0.12, 0.18))
    return panel.withColumns({
        **{f"{m}_positive_score": indicator(_c(m) > 0) for m in ("momentum_fast", "momentum_slow", "momentum_long", "momentum_year")},
        "trend_confirmation_score": indicator((fast > 0) & (slow > 0) & (fast < 0.35) & (drawdown > -0.30)), "anti_chase_score": indicator((fast >= -0.08) & (fast <= 0.25) & (drawdown > -0.35)), "long_trend_quality_score": clip01(row_mean(*parts)),
    })


def risk_guards(panel: DataFrame) -> DataFrame:
    """Ranks of volatility turned round, and blends of risks that guard against chasing, crowding and single names."""
    fast, drawdown = _c("momentum_fast"), _c("drawdown")
    chase, deep, negative = _or(clip(fast - 0.25, 0.0, 0.35) / 0.35), _or(-clip(_c("drawdown_year"), -0.55, 0.0) / 0.55), _or(-clip(_c("momentum_long"), -0.30, 0.0) / 0.30)
    fallen = -clip(drawdown, -0.50, 0.0) / 0.50
    out = panel.withColumns({"_amount_rank": _rank("amount"), "_volatility_rank": _rank("volatility")})
    risk = 0.35 * _or(_c("_amount_rank"), 0.5) + 0.35 * _or(_c("_volatility_rank"), 0.5) + 0.15 * (clip(fast, 0.0, 0.35) / 0.35) + 0.15 * fallen
    out = out.withColumns({"downside_volatility_score": clip01(1 - _rank("downside")), "low_volatility_score": clip01(1 - _c("_volatility_rank")), "reversal_risk_guard_score": clip01(1 - (0.45 * chase + 0.35 * deep + 0.20 * negative)), "liquidity_exposure_guard_score": clip01(1 - risk)})
    single = 0.45 * _or(_c("low_volatility_score"), 0.5) + 0.35 * _or(_c("liquidity_exposure_guard_score"), 0.5) + 0.20 * clip01(1 - fallen)
    return out.withColumn("single_name_risk_guard_score", clip01(single)).drop("_amount_rank", "_volatility_rank")


def mean_of(panel: DataFrame, name: str, scores: list[str]) -> DataFrame:
    """``name``: the mean of those of ``scores`` that the panel has, over what isn't missing."""
    return panel.withColumn(name, row_mean(*(_c(s) for s in scores if s in panel.columns)))
