"""Queries of the factor families and named event windows, over statement fields derived from the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import events, factors
from tidemark.plans.registry import PANEL, TECH, _even, _rank_sql, _tech, even, even_sql, query
from tidemark.sources import adapter

#: Statement fields of the test panel: multiplier of the row's number, scale and offset. A tenth of each is NULL.
FIELDS = {
    "dividend_yield": (7, 0.25, -0.02), "pe": (11, 120.0, -20.0), "pb": (13, 30.0, -1.0), "roe": (17, 1.4, -0.6), "gross_margin": (19, 1.4, -0.3), "net_margin": (23, 1.4, -0.6), "roic": (29, 1.6, -0.6),
    "rev_growth": (31, 3.2, -1.0), "np_growth": (37, 4.4, -1.2), "cfo_growth": (41, 8.0, -2.5), "ocf_to_net_profit": (43, 15.0, -6.0), "cfo_to_revenue": (47, 3.0, -1.2), "fcf": (53, 2.0, -1.0),
    "cash_debt_ratio": (59, 12.0, -1.0), "debt_asset_ratio": (61, 1.5, -0.1), "f_score": (67, 11.0, -1.0), "turnover": (71, 0.12, 0.0),
}
TRADED = {"main_net_inflow": (73, 2e-5, -1e-5), "large_net_inflow": (79, 2e-5, -1e-5), "xlarge_net_inflow": (83, 2e-5, -1e-5), "margin_buy": (89, 0.4, 0.0), "margin_repay": (97, 0.4, 0.0), "margin_balance": (101, 1.0, 0.0), "short_balance": (103, 0.1, 0.0)}


def fields(spark: SparkSession, d: str) -> DataFrame:
    """The panel with statement fields and, as shares of the amount, flows and margin trades."""
    rows = adapter.daily_panel(spark, d).select("date", "symbol", "amount", "close", "n_rows")
    number = F.pmod(F.col("symbol") * 37 + F.col("n_rows") * 101 + F.datediff("date", F.lit("1995-01-01")) * 13, F.lit(1000))
    rows = rows.withColumn("h", number.cast("long"))
    out = {}
    for name, (k, scale, offset) in {**FIELDS, **TRADED}.items():
        x = F.pmod(F.col("h") * k, F.lit(1000)) / F.lit(1000.0) * F.lit(scale) + F.lit(offset)
        out[name] = F.when(F.pmod(F.col("h") * k, F.lit(10)) != 3, x * F.col("amount") if name in TRADED else x)
    return rows.withColumns(out)


def _field_sql(name: str) -> str:
    k, scale, offset = {**FIELDS, **TRADED}[name]
    x = f"(((h * {k}) % 1000) / 1000.0::DOUBLE * {scale!r}::DOUBLE + ({offset!r}::DOUBLE))"
    return f"CASE WHEN (h * {k}) % 10 <> 3 THEN {x}{' * amount' if name in TRADED else ''} END AS {name}"


RAW = PANEL + """, numbered AS (SELECT date, symbol, amount, close, n_rows, CAST((symbol * 37 + n_rows * 101 + (date - DATE '1995-01-01') * 13) % 1000 AS BIGINT) AS h
  FROM panel), f AS (SELECT date, symbol, amount, close, n_rows, """ + ", ".join(map(_field_sql, {**FIELDS, **TRADED})) + " FROM numbered)"


def _clip(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low!r}::DOUBLE), {high!r}::DOUBLE) END)"


def _unit(x: str) -> str:
    return _clip(x, 0.0, 1.0)


def _band(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN {x} BETWEEN {low!r}::DOUBLE AND {high!r}::DOUBLE THEN {x} END)"


def _is(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _mean(*xs: str) -> str:
    return "((" + " + ".join(f"coalesce({x}, 0.0)" for x in xs) + ") / nullif(" + " + ".join(f"(({x}) IS NOT NULL)::INT" for x in xs) + ", 0))"


def _affine(x: str, low: float, high: float) -> str:
    return f"(({_clip(x, low, high)} - ({low!r}::DOUBLE)) / {high - low!r}::DOUBLE)"


def _out(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return even(df.select("date", "symbol", *names))


DIVIDEND = ("dividend_yield_capped", "dividend_yield_sane", "dividend_yield_valid_score")


@query(RAW + f""", x AS (SELECT date, symbol, CASE WHEN dividend_yield BETWEEN 0 AND 0.2 THEN {_clip('dividend_yield', 0.0, 0.12)} END AS dividend_yield_capped,
  {_band('dividend_yield', 0.0, 0.12)} AS dividend_yield_sane, {_is('dividend_yield BETWEEN 0.005 AND 0.12')} AS dividend_yield_valid_score
  FROM f) SELECT date, symbol, {even_sql(DIVIDEND)} FROM x""")
def dividend_yield_factors(spark: SparkSession, d: str) -> DataFrame:
    return _out(factors.dividend_yields(fields(spark, d)), DIVIDEND)


FLOW_RATIOS = ("main_net_inflow_to_amount", "large_net_inflow_to_amount", "xlarge_net_inflow_to_amount")
FLOW = (*FLOW_RATIOS, "main_flow_strength_score", "main_flow_positive_score", "flow_persistence_20d_score", "flow_reversal_guard_score", "capital_flow_quality_score")


@query(RAW + ", a AS (SELECT date, symbol, main_net_inflow, " + ", ".join(f"{k}_net_inflow * 10000 / nullif(amount, 0) AS {k}_net_inflow_to_amount" for k in ("main", "large", "xlarge")) + f""" FROM f),
b AS (SELECT *, CASE WHEN count(main_net_inflow_to_amount) OVER w >= 5 THEN round(avg(main_net_inflow_to_amount) OVER w,
  12) END AS raw FROM a WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
c AS (SELECT *, {_rank_sql('main_net_inflow_to_amount')} AS main_flow_strength_score, {_rank_sql('large_net_inflow_to_amount')} AS ls,
  {_rank_sql('xlarge_net_inflow_to_amount')} AS xs, {_rank_sql('raw')} AS flow_persistence_20d_score,
 CASE WHEN main_net_inflow IS NOT NULL THEN {_is('main_net_inflow > 0')} END AS main_flow_positive_score,
 CASE WHEN main_net_inflow_to_amount IS NOT NULL OR xlarge_net_inflow_to_amount IS NOT NULL THEN {_unit('1 - (0.6::DOUBLE * coalesce(-' + _clip('main_net_inflow_to_amount', -0.08, 0.0) + ' / 0.08::DOUBLE, 0) + 0.4::DOUBLE * coalesce(-' + _clip('xlarge_net_inflow_to_amount', -0.05, 0.0) + ' / 0.05::DOUBLE, 0))')} END AS flow_reversal_guard_score
  FROM b),
e AS (SELECT *, {_unit(_mean('main_flow_strength_score', 'ls', 'xs', 'flow_persistence_20d_score', 'flow_reversal_guard_score'))} AS capital_flow_quality_score
  FROM c) SELECT date, symbol, {even_sql(FLOW)} FROM e""")
def capital_flow_factors(spark: SparkSession, d: str) -> DataFrame:
    return _out(factors.capital_flows(fields(spark, d), adapter.lines(spark, d)), FLOW)


MARGIN = ("margin_net_buy_amount", "margin_buy_to_amount", "margin_repay_to_amount", "margin_net_buy_to_amount", "margin_balance_to_amount", "short_balance_to_amount", "margin_net_buy_strength_score", "margin_deleveraging_guard_score", "margin_balance_crowding_guard_score", "margin_short_pressure_guard_score", "margin_leverage_flow_score", "margin_trade_quality_score")


@query(RAW + f""", a AS (SELECT date, symbol, margin_buy - margin_repay AS margin_net_buy_amount, margin_buy / nullif(amount, 0) AS margin_buy_to_amount,
  margin_repay / nullif(amount, 0) AS margin_repay_to_amount, (margin_buy - margin_repay) / nullif(amount, 0) AS margin_net_buy_to_amount,
  margin_balance / nullif(amount, 0) AS margin_balance_to_amount, short_balance / nullif(amount, 0) AS short_balance_to_amount
  FROM f WHERE amount > 0 UNION ALL SELECT date, symbol, NULL, NULL, NULL, NULL, NULL, NULL
  FROM f WHERE amount <= 0),
b AS (SELECT *, {_rank_sql('margin_net_buy_to_amount')} AS margin_net_buy_strength_score, CASE WHEN margin_net_buy_to_amount IS NOT NULL
  THEN {_unit('1 + ' + _clip('margin_net_buy_to_amount', -0.2, 0.0) + ' / 0.2::DOUBLE')} END AS margin_deleveraging_guard_score,
  1 - {_rank_sql('margin_balance_to_amount')} AS margin_balance_crowding_guard_score, 1 - {_rank_sql('short_balance_to_amount')} AS margin_short_pressure_guard_score
  FROM a),
c AS (SELECT *, {_unit(_mean('margin_net_buy_strength_score', 'margin_deleveraging_guard_score'))} AS margin_leverage_flow_score
  FROM b), e AS (SELECT *, {_unit(_mean('margin_leverage_flow_score', 'margin_balance_crowding_guard_score', 'margin_short_pressure_guard_score'))} AS margin_trade_quality_score
  FROM c) SELECT date, symbol, {even_sql(MARGIN)} FROM e""")
def margin_trade_factors(spark: SparkSession, d: str) -> DataFrame:
    return _out(factors.margin_trades(fields(spark, d)), MARGIN)


VALUATION = ("pe_sane", "pe_valid_score", "pb_sane", "pb_valid_score")


@query(RAW + f""", x AS (SELECT date, symbol, CASE WHEN pe > 0 AND pe < 80 THEN pe END AS pe_sane, {_is('pe > 0 AND pe < 80')} AS pe_valid_score,
  {_band('pb', 0.1, 20.0)} AS pb_sane, {_is('pb BETWEEN 0.1 AND 20')} AS pb_valid_score
  FROM f) SELECT date, symbol, {even_sql(VALUATION)} FROM x""")
def valuation_factors(spark: SparkSession, d: str) -> DataFrame:
    return _out(factors.valuations(fields(spark, d)), VALUATION)


ROE = ("roe_sane", "roe_positive_score", "roe_delta", "roe_repair_score")


@query(RAW + f""", x AS (SELECT date, symbol, roe, CASE WHEN roe BETWEEN -0.5 AND 0.6 THEN {_clip('roe', -0.3, 0.4)} END AS roe_sane
  FROM f), y AS (SELECT *, roe_sane - lag(roe_sane, 52) OVER (PARTITION BY symbol ORDER BY date) AS roe_delta, {_is('roe > 0')} AS roe_positive_score
  FROM x), z AS (SELECT *, {_is('roe_sane > 0 AND roe_delta > 0')} AS roe_repair_score
  FROM y) SELECT date, symbol, {even_sql(ROE)} FROM z""")
def return_on_equity_factors(spark: SparkSession, d: str) -> DataFrame:
    """A year of weekly sessions back."""
    return _out(factors.returns_on_equity(fields(spark, d), 52), ROE)


#: Sane band, and the ends of the score.
BANDS = {
    "gross_margin": (-0.2, 0.95, 0.0, 0.65), "net_margin": (-0.5, 0.6, 0.0, 0.35), "roic": (-0.5, 0.8, 0.0, 0.3), "rev_growth": (-0.8, 2.0, -0.2, 0.6), "np_growth": (-1.0, 3.0, -0.3, 0.8), "cfo_growth": (-2.0, 5.0, -0.5, 1.0),
    "ocf_to_net_profit": (-5.0, 8.0, 0.0, 2.0), "cfo_to_revenue": (-1.0, 1.5, 0.0, 0.45), "cash_debt_ratio": (0.0, 10.0, 0.0, 3.0), "f_score": (0.0, 9.0, 0.0, 9.0),
}
FAMILIES = {"profitability": ("gross_margin", "net_margin", "roic"), "growth": ("rev_growth", "np_growth", "cfo_growth"), "cashflow": ("ocf_to_net_profit", "cfo_to_revenue"), "balance_sheet": ("cash_debt_ratio", "f_score")}
MORE = {"cashflow": {"fcf_positive_score": _is("fcf > 0")}, "balance_sheet": {"debt_asset_ratio_sane": _band("debt_asset_ratio", 0.0, 1.2), "low_debt_score": "1 - " + _clip("debt_asset_ratio", 0.0, 0.9) + " / 0.9::DOUBLE"}}


def _family(name: str):
    names, columns = FAMILIES[name], {}
    for f in names:
        low, high, a, b = BANDS[f]
        columns |= {f"{f}_sane": _band(f, low, high), f"{f}_score": _affine(f, a, b)}
    columns |= MORE.get(name, {})
    scores = [c for c in columns if c.endswith("_score") and not c.endswith("_sane")]
    out = (*columns, f"{name}_quality_score")
    sql = RAW + ", x AS (SELECT date, symbol, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM f), y AS (SELECT *, {_mean(*scores)} AS {name}_quality_score FROM x) SELECT date, symbol, {even_sql(out)} FROM y"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _out(factors.statement_quality(fields(spark, d), name), out)

    run.__name__ = f"{name}_factors"
    query(sql)(run)


for _name in FAMILIES:
    _family(_name)


LIQUIDITY = ("liquidity_mid_score", "liquidity_top_penalty_score", "turnover_sane_score", "turnover_mid_score")


@query(RAW + f""", a AS (SELECT *, {_rank_sql('amount')} AS ar, {_rank_sql('turnover')} AS tr FROM f), x AS (SELECT date, symbol,
  {_unit('1 - abs(ar - 0.62::DOUBLE) / 0.62::DOUBLE')} AS liquidity_mid_score, {_unit('1 - ar')} AS liquidity_top_penalty_score,
  {_is('turnover BETWEEN 0.002 AND 0.08')} AS turnover_sane_score, {_unit('1 - abs(tr - 0.55::DOUBLE) / 0.55::DOUBLE')} AS turnover_mid_score
  FROM a) SELECT date, symbol, {even_sql(LIQUIDITY)} FROM x""")
def liquidity_factors(spark: SparkSession, d: str) -> DataFrame:
    return _out(factors.liquidity_scores(fields(spark, d)), LIQUIDITY)


NAMED = {"momentum_fast": "momentum_4", "momentum_slow": "momentum_12", "momentum_long": "momentum_24", "momentum_year": "momentum_24", "drawdown": "drawdown_24", "drawdown_year": "drawdown_24", "up_share": "up_share_24", "mean_gap": "mean_gap_12", "volatility": "volatility_12", "downside": "downside_12"}


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Technical windows under the names of their roles, rounded, so that engines agree on ranks and bounds."""
    return _tech(spark, d).select("date", "symbol", F.round("amount", 2).alias("amount"), *(F.round(c, 9).alias(k) for k, c in NAMED.items()))


NAMED_SQL = TECH + ", f AS (SELECT date, symbol, round(amount, 2) AS amount, " + ", ".join(f"round({c}, 9) AS {k}" for k, c in NAMED.items()) + " FROM tech)"
TREND = ("momentum_fast_positive_score", "momentum_slow_positive_score", "momentum_long_positive_score", "momentum_year_positive_score", "trend_confirmation_score", "anti_chase_score", "long_trend_quality_score")
_LONG = _mean(_affine("momentum_slow", -0.10, 0.30), _affine("momentum_long", -0.15, 0.45), _affine("momentum_year", -0.20, 0.60), "1 + " + _clip("drawdown_year", -0.45, 0.0) + " / 0.45::DOUBLE", _affine("up_share", 0.40, 0.64), _affine("mean_gap", -0.12, 0.18))


@query(NAMED_SQL + ", x AS (SELECT date, symbol, " + ", ".join(f"{_is(m + ' > 0')} AS {m}_positive_score" for m in ("momentum_fast", "momentum_slow", "momentum_long", "momentum_year")) + f""", {_is('momentum_fast > 0 AND momentum_slow > 0 AND momentum_fast < 0.35 AND drawdown > -0.3')} AS trend_confirmation_score,
  {_is('momentum_fast BETWEEN -0.08 AND 0.25 AND drawdown > -0.35')} AS anti_chase_score, {_unit(_LONG)} AS long_trend_quality_score
  FROM f) SELECT date, symbol, {even_sql(TREND)} FROM x""")
def trend_factors(spark: SparkSession, d: str) -> DataFrame:
    return _out(factors.trend_scores(_named(spark, d)), TREND)


GUARDS = ("downside_volatility_score", "low_volatility_score", "reversal_risk_guard_score", "liquidity_exposure_guard_score", "single_name_risk_guard_score")
_FALLEN = "(-" + _clip("drawdown", -0.5, 0.0) + " / 0.5::DOUBLE)"
_REVERSAL = "1 - (0.45::DOUBLE * coalesce(" + _clip("momentum_fast - 0.25::DOUBLE", 0.0, 0.35) + " / 0.35::DOUBLE, 0) + 0.35::DOUBLE * coalesce(-" + _clip("drawdown_year", -0.55, 0.0) + " / 0.55::DOUBLE, 0) + 0.2::DOUBLE * coalesce(-" + _clip("momentum_long", -0.3, 0.0) + " / 0.3::DOUBLE, 0))"
_RISK = "1 - (0.35::DOUBLE * coalesce(ar, 0.5::DOUBLE) + 0.35::DOUBLE * coalesce(vr, 0.5::DOUBLE) + 0.15::DOUBLE * (" + _clip("momentum_fast", 0.0, 0.35) + " / 0.35::DOUBLE) + 0.15::DOUBLE * " + _FALLEN + ")"


@query(NAMED_SQL + f""", a AS (SELECT *, {_rank_sql('amount')} AS ar, {_rank_sql('volatility')} AS vr, {_rank_sql('downside')} AS dr
  FROM f), b AS (SELECT *, {_unit('1 - dr')} AS downside_volatility_score, {_unit('1 - vr')} AS low_volatility_score,
  {_unit(_REVERSAL)} AS reversal_risk_guard_score, {_unit(_RISK)} AS liquidity_exposure_guard_score
  FROM a), c AS (SELECT *, {_unit('0.45::DOUBLE * coalesce(low_volatility_score, 0.5::DOUBLE) + 0.35::DOUBLE * coalesce(liquidity_exposure_guard_score, 0.5::DOUBLE) + 0.2::DOUBLE * ' + _unit('1 - ' + _FALLEN))} AS single_name_risk_guard_score
  FROM b) SELECT date, symbol, {even_sql(GUARDS)} FROM c""")
def risk_guard_factors(spark: SparkSession, d: str) -> DataFrame:
    return _out(factors.risk_guards(_named(spark, d)), GUARDS)


@query(RAW + f""", x AS (SELECT date, symbol, {_mean(_is('pe > 0 AND pe < 80'), _is('pb BETWEEN 0.1 AND 20'), _is('dividend_yield BETWEEN 0.005 AND 0.12'))} AS valuation_sanity_score,
  {_is('roe > 0')} AS roe_positive_score FROM f), y AS (SELECT *, {_mean('roe_positive_score', 'valuation_sanity_score')} AS alpha_quality_stability_score
  FROM x) SELECT date, symbol, {even_sql(('valuation_sanity_score', 'alpha_quality_stability_score'))}
  FROM y""")
def composite_quality_means(spark: SparkSession, d: str) -> DataFrame:
    """Means over those of the named scores that the panel has."""
    rows = factors.returns_on_equity(factors.dividend_yields(factors.valuations(fields(spark, d))))
    rows = factors.mean_of(rows, "valuation_sanity_score", ["pe_valid_score", "pb_valid_score", "dividend_yield_valid_score"])
    return _out(factors.mean_of(rows, "alpha_quality_stability_score", ["roe_positive_score", "valuation_sanity_score", "not_there_score"]), ("valuation_sanity_score", "alpha_quality_stability_score"))


EV = PANEL + """, q AS (SELECT date, symbol, close FROM panel), o AS (
  SELECT o_custkey % 100 + 1 AS symbol, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price, o_orderkey AS k,
  o_orderpriority AS kind,
         CASE o_orderkey % 6 WHEN 0 THEN 'Share buyback plan' WHEN 1 THEN 'Cash Dividend notice' WHEN 2 THEN 'Private placement'
  WHEN 3 THEN 'MERGER talks' WHEN 4 THEN 'Penalty' ELSE 'Annual report' END AS title
  FROM orders)"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Events of the panel's symbols from all orders, since the test tables have no events of six years."""
    titles = ("Share buyback plan", "Cash Dividend notice", "Private placement", "MERGER talks", "Penalty", "Annual report")
    title = F.element_at(F.array(*map(F.lit, titles)), (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int"))
    rows = adapter.read(spark, d, "orders")
    return rows.select((F.pmod("o_custkey", F.lit(100)) + 1).alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("kind"), title.alias("title"))


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return adapter.daily_panel(spark, d).select("date", "symbol", "close")


DIVIDENDS = EV + f""", w AS (SELECT q.date, q.symbol, q.close, count(o.k) FILTER (o.date >= q.date - 365) AS dividend_event_count_365d,
  coalesce(CAST(sum(CAST({_even('o.price / 1e4')} AS DECIMAL(28,6))) FILTER (o.date >= q.date - 365) AS DOUBLE),
  0.0) AS dividend_event_cash_365d, max(struct_pack(a := o.date, b := {_even('o.price / 1e4')})) FILTER (o.k IS NOT NULL) AS last
  FROM q LEFT JOIN o ON o.symbol = q.symbol AND o.date <= q.date GROUP BY 1, 2, 3),
x AS (SELECT date, symbol, close, dividend_event_count_365d, dividend_event_cash_365d, CAST(date - last.a AS DOUBLE) AS dividend_event_days_since_last,
  last.b AS dividend_event_last_cash FROM w)"""


def _dividends(spark: SparkSession, d: str) -> DataFrame:
    return events.dividend_windows(_quotes(spark, d), _orders(spark, d).select("symbol", "date", adapter.micro(F.col("price") / 1e4).alias("cash")))


@query(DIVIDENDS + f""" SELECT date, symbol, dividend_event_count_365d, {even_sql(('dividend_event_cash_365d', 'dividend_event_last_cash'))},
  dividend_event_days_since_last FROM x""")
def dividend_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return even(_dividends(spark, d).drop("close"))


EVENT_YIELD = ("dividend_event_yield_365d", "dividend_event_regular_score", "dividend_event_recent_score", "dividend_event_cash_score", "dividend_event_quality_score")
_YIELD = "(coalesce(dividend_event_cash_365d, 0.0) / nullif(close, 0))"


@query(DIVIDENDS + f""", y AS (SELECT date, symbol, {_band(_YIELD, 0.0, 0.2)} AS dividend_event_yield_365d, {_clip('coalesce(dividend_event_count_365d, 0)::DOUBLE', 0.0, 4.0)} / 4 AS dividend_event_regular_score,
  coalesce(1 - {_clip('dividend_event_days_since_last', 0.0, 365.0)} / 365, 0) AS dividend_event_recent_score, {_clip(_YIELD, 0.0, 0.08)} / 0.08::DOUBLE AS dividend_event_cash_score
  FROM x), z AS (SELECT *, {_mean('dividend_event_regular_score', 'dividend_event_recent_score', 'dividend_event_cash_score')} AS dividend_event_quality_score
  FROM y) SELECT date, symbol, {even_sql(EVENT_YIELD)} FROM z""")
def dividend_event_factors(spark: SparkSession, d: str) -> DataFrame:
    return _out(factors.dividend_event_scores(_dividends(spark, d)), EVENT_YIELD)


ABNORMAL = EV + """, x AS (SELECT q.date, q.symbol, count(o.k) FILTER (o.date >= q.date - 90) AS abnormal_count_90d, coalesce(CAST(sum(CAST(o.price AS DECIMAL(28,4))) FILTER (o.date >= q.date - 90) AS DOUBLE),
  0.0) AS abnormal_amount_90d, max(abs(o.k % 40 - 20) / 2.0::DOUBLE) FILTER (o.date >= q.date - 90) AS abnormal_max_deviation_90d,
  CAST(q.date - max(o.date) AS DOUBLE) AS abnormal_days_since_last FROM q LEFT JOIN o ON o.symbol = q.symbol AND o.date < q.date
  GROUP BY 1, 2)"""
WINDOWS = ("abnormal_count_90d", "abnormal_amount_90d", "abnormal_max_deviation_90d", "abnormal_days_since_last")


def _abnormal(spark: SparkSession, d: str) -> DataFrame:
    listed = _orders(spark, d).select("symbol", "date", F.col("price").alias("traded"), ((F.pmod("k", F.lit(40)) - 20) / 2.0).alias("deviation"))
    return events.abnormal_list_windows(_quotes(spark, d).drop("close"), listed)


@query(ABNORMAL + " SELECT date, symbol, abnormal_count_90d, " + even_sql(("abnormal_amount_90d",)) + ", abnormal_max_deviation_90d, abnormal_days_since_last FROM x")
def abnormal_list_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return even(_abnormal(spark, d))


ABNORMAL_SCORES = ("abnormal_attention_score", "abnormal_amount_score", "abnormal_recency_score", "abnormal_cooldown_score", "abnormal_event_score")


@query(ABNORMAL + f""", y AS (SELECT *, {_clip('abnormal_count_90d::DOUBLE', 0.0, 3.0)} / 3 AS abnormal_attention_score, {_rank_sql('abnormal_amount_90d')} AS abnormal_amount_score,
  coalesce(1 - {_clip('abnormal_days_since_last', 0.0, 90.0)} / 90, 0) AS abnormal_recency_score
  FROM x), z AS (SELECT *, {_unit('1 - (0.55::DOUBLE * abnormal_attention_score * abnormal_recency_score + 0.45::DOUBLE * (' + _clip('abnormal_max_deviation_90d', 0.0, 15.0) + ' / 15) * abnormal_recency_score)')} AS abnormal_cooldown_score,
  {_unit(_mean('abnormal_attention_score', 'abnormal_amount_score', 'abnormal_recency_score'))} AS abnormal_event_score
  FROM y) SELECT date, symbol, {even_sql(ABNORMAL_SCORES)} FROM z""")
def abnormal_list_factors(spark: SparkSession, d: str) -> DataFrame:
    return _out(factors.abnormal_list_scores(_abnormal(spark, d)), ABNORMAL_SCORES)


CATEGORY = {"buyback": (180, "buyback"), "dividend": (365, "dividend"), "financing": (365, "private placement"), "reorg": (365, "merger"), "risk_alert": (365, "penalty"), "report": (365, "annual report")}
ANNOUNCEMENTS = EV + ", x AS (SELECT q.date, q.symbol, " + ", ".join(f"count(o.k) FILTER (o.date >= q.date - {n}) AS announcement_count_{n}d" for n in (30, 90, 180, 365)) + ", " + ", ".join(f"count(*) FILTER (o.date >= q.date - {n} AND contains(lower(o.title), '{word}')) AS announcement_{name}_count_{n}d" for name, (n, word) in CATEGORY.items()) + ", CAST(q.date - max(o.date) AS DOUBLE) AS announcement_days_since_last FROM q LEFT JOIN o ON o.symbol = q.symbol AND o.date < q.date GROUP BY 1, 2)"


def _announcements(spark: SparkSession, d: str) -> DataFrame:
    return events.announcement_windows(_quotes(spark, d).drop("close"), events.announcement_flags(_orders(spark, d)))


@query(ANNOUNCEMENTS + " SELECT * FROM x")
def announcement_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return _announcements(spark, d)


ANNOUNCED = {
    "activity": ("count_90d", 8, False), "noise_guard": ("count_30d", 10, True), "buyback_activity": ("buyback_count_180d", 2, False), "shareholder_return": ("dividend_count_365d", 3, False),
    "risk_alert_guard": ("risk_alert_count_365d", 3, True), "financing_cooldown": ("financing_count_365d", 4, True), "reorg_cooldown": ("reorg_count_365d", 3, True),
}
_SCORED = ", ".join(f"{'1 - ' if turned else ''}{_clip(f'announcement_{c}::DOUBLE', 0.0, float(n))} / {n} AS announcement_{k}_score" for k, (c, n, turned) in ANNOUNCED.items())
ANNOUNCED_OUT = tuple(f"announcement_{k}_score" for k in (*ANNOUNCED, "recency", "stability_guard", "event"))
_A = "announcement_{}_score".format


@query(ANNOUNCEMENTS + f""", y AS (SELECT *, {_SCORED}, coalesce(1 - {_clip('announcement_days_since_last', 0.0, 90.0)} / 90, 0) AS announcement_recency_score
  FROM x), z AS (SELECT *, {_unit(_mean(*map(_A, ('noise_guard', 'risk_alert_guard', 'financing_cooldown', 'reorg_cooldown'))))} AS announcement_stability_guard_score,
  {_unit(_mean(*map(_A, ('activity', 'recency', 'buyback_activity', 'shareholder_return'))))} AS announcement_event_score
  FROM y) SELECT date, symbol, {even_sql(ANNOUNCED_OUT)} FROM z""")
def announcement_factors(spark: SparkSession, d: str) -> DataFrame:
    return _out(factors.announcement_scores(_announcements(spark, d)), ANNOUNCED_OUT)
