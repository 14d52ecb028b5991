"""Queries over the driver's tables, one for each operator, and their SQL for an independent engine.

Sums are taken over decimals and final doubles rounded alike on both sides, so
that results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import change, pct_rank, ratio
from tidemark.operators import joins, panel as P, portfolio, study
from tidemark.sources import adapter, scratch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PANEL = """WITH panel AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey AS symbol,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS amount,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
         floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS close,
         floor(max(l_extendedprice / l_quantity) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS high, floor(min(l_extendedprice / l_quantity) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS low,
         bool_or(l_returnflag = 'A') AS has_a, count(*) FILTER (l_returnflag = 'R') AS n_r, count(*) AS n_rows
  FROM lineitem GROUP BY 1, 2)"""
DENSE = PANEL + """, grid AS (
  SELECT f.symbol, d.date FROM (SELECT symbol, min(date) AS first FROM panel GROUP BY symbol) f
  JOIN (SELECT DISTINCT date FROM panel) d ON d.date >= f.first
), dense AS (
  SELECT g.date, g.symbol, coalesce(p.amount, 0.0) AS amount, coalesce(p.volume, 0.0) AS volume, p.symbol IS NULL AS is_suspended,
         last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS close
  FROM grid g LEFT JOIN panel p ON p.symbol = g.symbol AND p.date = g.date)"""
TECH = DENSE + """, r AS (
  SELECT *, close / nullif(lag(close) OVER s, 0) - 1 AS return_1 FROM dense WINDOW s AS (PARTITION BY symbol ORDER BY date)
), tech AS (
  SELECT date, symbol, amount, close, is_suspended, return_1,
         close / nullif(lag(close, 4) OVER s, 0) - 1 AS momentum_4, close / nullif(lag(close, 12) OVER s, 0) - 1 AS momentum_12,
  close / nullif(lag(close, 24) OVER s, 0) - 1 AS momentum_24,
         CASE WHEN count(return_1) OVER w12 >= 12 THEN stddev_samp(return_1) OVER w12 END AS volatility_12,
         CASE WHEN count(return_1) OVER w12 >= 4 THEN stddev_samp(CASE WHEN return_1 < 0 THEN return_1 WHEN return_1 IS NOT NULL
  THEN 0.0 END) OVER w12 END AS downside_12,
         CASE WHEN count(close) OVER w24 >= 4 THEN close / max(close) OVER w24 - 1 END AS drawdown_24,
         CASE WHEN count(close) OVER w12 >= 4 THEN close / avg(close) OVER w12 - 1 END AS mean_gap_12,
         CASE WHEN count(return_1) OVER w24 >= 8 THEN avg(CASE WHEN return_1 > 0 THEN 1.0 WHEN return_1 IS NOT NULL
  THEN 0.0 END) OVER w24 END AS up_share_24
  FROM r WINDOW s AS (PARTITION BY symbol ORDER BY date), w12 AS (PARTITION BY symbol ORDER BY date ROWS 11 PRECEDING),
  w24 AS (PARTITION BY symbol ORDER BY date ROWS 23 PRECEDING))"""
FACTORS = ("momentum_4", "momentum_12", "momentum_24", "volatility_12", "downside_12", "drawdown_24", "mean_gap_12", "up_share_24")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def even(df: DataFrame) -> DataFrame:
    """Doubles to millionths in floating operations that every engine does alike."""
    return df.select(*(adapter.micro(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _even(x: str) -> str:
    return f"floor(({x}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"


def even_sql(names) -> str:
    return ", ".join(f"{_even(n)} AS {n}" for n in names)


def _tech(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d).select("date", "symbol", "amount", "volume", "close")
    return P.technical_features(P.densify(rows, adapter.calendar(spark, d), adapter.lines(spark, d)))


def _rank_sql(x: str, by: str = "date", desc: bool = False) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}{' DESC' if desc else ''}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {by}) END"


WEIGHTS = {"m": ("desc", 0.6), "v": ("asc", 0.4)}
SCORED = TECH + f""", rounded AS (
  SELECT date, symbol, amount, close, round(momentum_12, 9) AS m, round(volatility_12, 9) AS v
  FROM tech
), scored AS (
  SELECT *, round(0.0::DOUBLE + coalesce(0.6::DOUBLE * ({_rank_sql('m')}), 0.0) + coalesce(0.4::DOUBLE * ({_rank_sql('v', desc=True)}),
  0.0), 9) AS score
  FROM rounded), months AS (SELECT min(date) AS date FROM panel GROUP BY date_trunc('month', date))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = _tech(spark, d).select("date", "symbol", "amount", "close", F.round("momentum_12", 9).alias("m"), F.round("volatility_12", 9).alias("v"))
    return rows.withColumn("score", P.composite(rows, WEIGHTS))


def _rebalances(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).join(P.first_sessions(adapter.calendar(spark, d)), "date", "left_semi")


@query(SCORED + """ SELECT * FROM (SELECT date, symbol, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS position
  FROM scored WHERE date IN (SELECT date FROM months)) WHERE position <= 10""")
def flagship_top_composite(spark: SparkSession, d: str) -> DataFrame:
    """Ten best composite scores at the first session of each month."""
    return P.select_top(_rebalances(spark, d), 10).select("date", "symbol", "score", "position")


flagship = flagship_top_composite


@query(PANEL + " SELECT * FROM panel")
def panel_scan(spark: SparkSession, d: str) -> DataFrame:
    return adapter.daily_panel(spark, d)


@query(DENSE + " SELECT * FROM dense")
def calendar_alignment(spark: SparkSession, d: str) -> DataFrame:
    return P.densify(adapter.daily_panel(spark, d)).select("date", "symbol", "amount", "volume", "is_suspended", "close")


@query(TECH + f" SELECT date, symbol, {_r(('return_1', *FACTORS))} FROM tech")
def technical_windows(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_tech(spark, d).select("date", "symbol", "return_1", *FACTORS))


@query(PANEL + f" SELECT date, symbol, round({_rank_sql('n_rows')}, 8) AS row_rank, round({_rank_sql('amount', desc=True)}, 8) AS amount_rank FROM panel")
def cross_section_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d)
    return rows.select("date", "symbol", F.round(pct_rank(F.col("n_rows"), "date"), 8).alias("row_rank"), F.round(pct_rank(F.col("amount"), "date", descending=True), 8).alias("amount_rank"))


@query(TECH + f""", ranked AS (SELECT *, {_rank_sql('a')} AS ar, {_rank_sql('v')} AS vr, {_rank_sql('dn')} AS dr
  FROM (SELECT *, round(amount, 2) AS a, round(volatility_12, 9) AS v, round(downside_12, 9) AS dn
  FROM tech))
, scores AS (SELECT date, symbol, CASE WHEN close BETWEEN 100 AND 2500 THEN close END AS value_sane, CASE WHEN momentum_12 > 0
  THEN 1.0 ELSE 0.0 END AS momentum_positive,
  least(greatest(1 - abs(ar - 0.62) / 0.62, 0.0), 1.0) AS liquidity_mid, 1 - vr AS low_volatility, 1 - dr AS low_downside,
  CASE WHEN momentum_4 > 0 AND momentum_12 > 0 AND mean_gap_12 > 0 THEN 1.0 ELSE 0.0 END AS trend_confirmed, up_share_24,
  CASE WHEN momentum_4 IS NOT NULL AND mean_gap_12 IS NOT NULL AND volatility_12 IS NOT NULL THEN least(greatest(1 - (0.45 * least(greatest(momentum_4 / 0.5,
  0), 1) + 0.35 * least(greatest(mean_gap_12 / 0.3, 0), 1) + 0.20 * least(greatest(volatility_12 / 0.4, 0), 1)),
  0), 1) END AS reversal_guard FROM ranked)
SELECT date, symbol, value_sane, momentum_positive, round(liquidity_mid, 6) AS liquidity_mid, round(low_volatility,
  6) AS low_volatility, round(low_downside, 6) AS low_downside, trend_confirmed, round(reversal_guard, 6) AS reversal_guard,
  round((coalesce(low_volatility, 0) + coalesce(low_downside, 0) + coalesce(up_share_24, 0) + coalesce(reversal_guard,
  0)) / nullif((low_volatility IS NOT NULL)::INT + (low_downside IS NOT NULL)::INT + (up_share_24 IS NOT NULL)::INT + (reversal_guard IS NOT NULL)::INT,
  0), 6) AS quality_stability FROM scores""")
def robust_factor_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _tech(spark, d).withColumns({"amount": F.round("amount", 2), "volatility_12": F.round("volatility_12", 9), "downside_12": F.round("downside_12", 9)})
    return _rounded(P.robust_factors(rows).select("date", "symbol", "value_sane", "momentum_positive", "liquidity_mid", "low_volatility", "low_downside", "trend_confirmed", "reversal_guard", "quality_stability"))


FUNDAMENTALS = PANEL + """, raw AS (
  SELECT o_custkey % 100 + 1 AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS period, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS published,
  o_totalprice AS value, o_orderkey FROM orders
), facts AS (SELECT symbol, period, published, value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, period ORDER BY o_orderkey DESC) AS n
  FROM raw) WHERE n = 1)
, daily AS (SELECT symbol, published AS day, max(struct_pack(period := period, value := value)) AS x
  FROM facts GROUP BY 1, 2)"""


def _as_of(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    quotes = adapter.daily_panel(spark, d).select("date", "symbol", "close")
    return joins.as_of(quotes, adapter.fundamentals(spark, d), ["period", "value"], "published", strict)


@query(FUNDAMENTALS + """ SELECT p.date, p.symbol, p.close, f.x.period AS period, f.x.value AS value FROM panel p ASOF
  LEFT JOIN daily f ON p.symbol = f.symbol AND p.date >= f.day""")
def as_of_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d, False)


@query(FUNDAMENTALS + """ SELECT p.date, p.symbol, p.close, f.x.period AS period, f.x.value AS value FROM panel p ASOF
  LEFT JOIN daily f ON p.symbol = f.symbol AND p.date > f.day""")
def as_of_strict(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d, True)


@query(PANEL + """, members AS (SELECT date AS taken, symbol, n_rows AS weight FROM panel WHERE date IN (SELECT min(date)
  FROM panel GROUP BY date_trunc('quarter', date)) AND amount > 50000)
SELECT p.date, p.symbol, m.weight, m.symbol IS NOT NULL AS is_member FROM panel p
ASOF LEFT JOIN (SELECT DISTINCT taken FROM members) t ON p.date >= t.taken LEFT JOIN members m ON m.taken = t.taken
  AND m.symbol = p.symbol""")
def snapshot_membership(spark: SparkSession, d: str) -> DataFrame:
    """Index membership as of the latest quarterly snapshot."""
    rows = adapter.daily_panel(spark, d)
    firsts = rows.groupBy(F.date_trunc("quarter", "date")).agg(F.min("date").alias("date")).select("date")
    members = rows.join(firsts, "date", "left_semi").filter("amount > 50000").select("symbol", F.col("date").alias("taken"), F.col("n_rows").alias("weight"))
    return joins.snapshot_as_of(rows.select("date", "symbol"), members, "taken", ["weight"]).select("date", "symbol", "weight", F.col("weight").isNotNull().alias("is_member"))


MASTER = PANEL + """, master AS (SELECT symbol, a + 28 AS list_date, CASE WHEN symbol % 7 = 0 THEN a + CAST(floor((b - a) * 2 / 3) AS INTEGER) END AS delist_date
  FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM panel GROUP BY symbol))"""


@query(MASTER + """ SELECT p.symbol, p.date, p.close FROM panel p JOIN master m USING (symbol) WHERE m.list_date <= p.date AND (m.delist_date IS NULL
  OR p.date < m.delist_date)""")
def lifecycle_half_open(spark: SparkSession, d: str) -> DataFrame:
    return joins.within_lifecycle(adapter.daily_panel(spark, d), adapter.stock_master(spark, d)).select("symbol", "date", "close")


@query(MASTER + """ SELECT p.symbol, p.date, p.close FROM panel p JOIN master m USING (symbol) WHERE m.list_date <= p.date AND (m.delist_date IS NULL
  OR p.date <= m.delist_date)""")
def lifecycle_closed(spark: SparkSession, d: str) -> DataFrame:
    return joins.within_lifecycle(adapter.daily_panel(spark, d), adapter.stock_master(spark, d), closed=True).select("symbol", "date", "close")


@query(FUNDAMENTALS + """ SELECT p.date, p.symbol, f.period, f.published, f.value FROM panel p LEFT JOIN LATERAL (SELECT period, published,
  value FROM facts f WHERE f.symbol = p.symbol AND f.published < p.date AND f.period >= p.date - INTERVAL 18 MONTH ORDER BY period DESC,
  published DESC LIMIT 1) f ON true""")
def bitemporal_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest period published before the date and at most 18 months old."""
    quotes = adapter.daily_panel(spark, d).select("date", "symbol")
    return joins.latest_known(quotes, adapter.fundamentals(spark, d), ["period", "published"], "published", strict=True, stale_months=18)


@query(PANEL + """, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session FROM (SELECT DISTINCT date
  FROM panel)), p AS (SELECT panel.*, session FROM panel JOIN cal USING (date)) SELECT a.symbol, a.date, a.session,
  b.close AS close_ahead, round(b.close / a.close - 1, 8) AS forward_return FROM p a
  LEFT JOIN p b ON a.symbol = b.symbol AND b.session = a.session + 4""")
def exact_offset_join(spark: SparkSession, d: str) -> DataFrame:
    """Close exactly four sessions ahead, missing if the symbol has none then."""
    rows = adapter.daily_panel(spark, d).select("date", "symbol", "close")
    rows = rows.join(joins.sessions(rows), "date")
    out = joins.at_session_offset(rows, "close", 4, "close_ahead")
    return out.select("symbol", "date", F.col("session").cast("long").alias("session"), "close_ahead", F.round(ratio(F.col("close_ahead"), F.col("close")) - 1, 8).alias("forward_return"))


EVENTS = """WITH ev AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS date, event_type, value FROM events), q AS (SELECT DISTINCT symbol,
  date FROM ev WHERE event_type = 'click')"""


def _event_sql(days: int, op: str) -> str:
    return EVENTS + f""" SELECT q.symbol, q.date, count(e.symbol) AS n, count(*) FILTER (e.event_type = 'purchase') AS n_purchase, coalesce(CAST(sum(CAST(e.value AS DECIMAL(18,4))) AS DOUBLE),
  0.0) AS total, max(abs(e.value)) AS largest, CAST(max(e.date) AS DATE) AS last_date
FROM q LEFT JOIN ev e ON e.symbol = q.symbol AND e.date >= q.date - {days} AND e.date {op} q.date
  GROUP BY 1, 2"""


def _event_windows(spark: SparkSession, d: str, days: int, strict: bool) -> DataFrame:
    events = adapter.user_events(spark, d).withColumn("event_date", F.col("date"))
    found = {"n": F.count("event_date"), "n_purchase": F.count(F.when(F.col("event_type") == "purchase", 1)), "total": F.sum(F.col("value").cast("decimal(18,4)")), "largest": F.max(F.abs("value")), "last_date": F.max("event_date")}
    out = joins.event_window(adapter.user_days(spark, d), events, days, found, strict)
    return out.withColumn("total", F.coalesce(F.col("total").cast("double"), F.lit(0.0)))


@query(_event_sql(7, "<"))
def event_window_strict(spark: SparkSession, d: str) -> DataFrame:
    return _event_windows(spark, d, 7, True)


@query(_event_sql(14, "<="))
def event_window_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return _event_windows(spark, d, 14, False)


@query("""SELECT page_id, CAST(contains(lower(coalesce(url, '')), 'pills') OR contains(lower(coalesce(url, '')), 'bets') AS INTEGER) AS commerce,
  CAST(contains(lower(coalesce(url, '')), 'blog') AS INTEGER) AS blog FROM pages""")
def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.read(spark, d, "pages").select("page_id", "url")
    return P.keyword_flags(rows, "url", {"commerce": ["pills", "bets"], "blog": ["blog"]}).drop("url")


@query(PANEL + """, prior AS (SELECT date, symbol, CASE WHEN count(amount) OVER w >= 4 THEN avg(amount) OVER w END AS prior_amount
  FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT * FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY round(prior_amount, 4) DESC, symbol) AS liquidity_rank
  FROM prior WHERE prior_amount IS NOT NULL) WHERE liquidity_rank <= 20""")
def liquid_universe(spark: SparkSession, d: str) -> DataFrame:
    return P.liquid_universe(adapter.daily_panel(spark, d), 12, 4, 20).select("date", "symbol", "liquidity_rank")


@query(SCORED + """, g AS (SELECT *, symbol % 8 AS industry FROM scored WHERE date IN (SELECT date FROM months)), c AS (SELECT *, CASE
  WHEN row_number() OVER (PARTITION BY date, industry ORDER BY score DESC, symbol) > 2 THEN 1 ELSE 0 END AS deferred
  FROM g)
SELECT * FROM (SELECT date, symbol, industry, score, row_number() OVER (PARTITION BY date ORDER BY deferred, score DESC,
  symbol) AS position FROM c) WHERE position <= 10""")
def group_capped_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _rebalances(spark, d).withColumn("industry", F.col("symbol") % 8)
    return P.select_capped(rows, 10, "industry", 0.2).select("date", "symbol", "industry", "score", "position")


@query(SCORED + """, g AS (SELECT *, CASE WHEN m IS NULL THEN 0 ELSE CAST(ceil(row_number() OVER (PARTITION BY date, m IS NULL ORDER BY m,
  symbol) * 1.0::DOUBLE / count(m) OVER (PARTITION BY date) * 5) AS INTEGER) END AS bucket
  FROM scored WHERE date IN (SELECT date FROM months)), c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY date,
  bucket ORDER BY score DESC, symbol) > 3 THEN 1 ELSE 0 END AS deferred FROM g)
SELECT * FROM (SELECT date, symbol, bucket, score, row_number() OVER (PARTITION BY date ORDER BY deferred, score DESC,
  symbol) AS position FROM c) WHERE position <= 10""")
def bucket_capped_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = P.score_buckets(_rebalances(spark, d), "m", 5)
    return P.select_capped(rows, 10, "bucket", 0.3).select("date", "symbol", "bucket", "score", "position")


@query(TECH + """, h AS (SELECT date, avg(CASE WHEN momentum_4 > 0 THEN 1.0 WHEN momentum_4 IS NOT NULL THEN 0.0 END) AS breadth_4,
  avg(CASE WHEN momentum_12 > 0 THEN 1.0 WHEN momentum_12 IS NOT NULL THEN 0.0 END) AS breadth_12, avg(CASE WHEN mean_gap_12 > 0
  THEN 1.0 WHEN mean_gap_12 IS NOT NULL THEN 0.0 END) AS above_mean, median(momentum_12) AS median_momentum, median(volatility_12) AS median_volatility
  FROM tech GROUP BY date)
SELECT date, """ + _r(("breadth_4", "breadth_12", "above_mean", "median_momentum", "median_volatility")) + ", " + ", ".join(f"round(lag({c}) OVER (ORDER BY date), 6) AS {c}_lag1" for c in ("breadth_4", "breadth_12", "above_mean", "median_momentum", "median_volatility")) + " FROM h")
def market_health(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(P.market_health(_tech(spark, d)))


INDEX = PANEL + """, idx AS (SELECT date, floor(CAST(sum(CAST(amount AS DECIMAL(28,4))) AS DOUBLE) / CAST(sum(CAST(volume AS DECIMAL(28,4))) AS DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS close
  FROM panel GROUP BY date)"""


@query(INDEX + """, a AS (SELECT *, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM idx), b AS (SELECT *, CASE WHEN count(close) OVER w >= 6
  THEN avg(close) OVER w END AS mean_12, CASE WHEN count(r) OVER w >= 6 THEN stddev_samp(r) OVER w END AS vol_12
  FROM a WINDOW w AS (ORDER BY date ROWS 11 PRECEDING)),
c AS (SELECT *, CASE WHEN count(vol_12) OVER w >= 24 THEN quantile_cont(vol_12, 0.8) OVER w END AS vol_q80
  FROM b WINDOW w AS (ORDER BY date ROWS 51 PRECEDING)), e AS (SELECT date, lag(close) OVER o AS close_lag1, lag(mean_12) OVER o AS mean_12_lag1,
  lag(vol_12) OVER o AS vol_12_lag1, lag(vol_q80) OVER o AS vol_q80_lag1 FROM c WINDOW o AS (ORDER BY date))
SELECT date, round(close_lag1, 6) AS close_lag1, round(close_lag1 / mean_12_lag1 - 1, 6) AS mean_gap_lag1, round(vol_12_lag1,
  6) AS vol_12_lag1, round(vol_q80_lag1, 6) AS vol_q80_lag1, CASE WHEN close_lag1 > mean_12_lag1 THEN 1.0 ELSE 0.0 END AS trend_on
  FROM e""")
def regime_features(spark: SparkSession, d: str) -> DataFrame:
    out = P.regime_features(adapter.index_series(adapter.daily_panel(spark, d)))
    gap = ratio(F.col("close_lag1"), F.col("mean_12_lag1")) - 1
    return _rounded(out.select("date", "close_lag1", gap.alias("mean_gap_lag1"), "vol_12_lag1", "vol_q80_lag1", "trend_on"))


IC = TECH + f""", fwd AS (SELECT date, symbol, round(momentum_12, 9) AS m, round(volatility_12, 9) AS v, round(lead(close, 4) OVER s / close - 1,
  9) AS f4, round(lead(close, 12) OVER s / close - 1, 9) AS f12 FROM tech WINDOW s AS (PARTITION BY symbol ORDER BY date)),
months AS (SELECT min(date) AS date FROM panel GROUP BY date_trunc('month', date)),
cells AS (SELECT date, symbol, u.factor, u.horizon, u.score, u.outcome FROM fwd, LATERAL (VALUES ('momentum', 4,
  m, f4), ('momentum', 12, m, f12), ('low_vol', 4, -v, f4), ('low_vol', 12, -v, f12)) u(factor, horizon, score, outcome)
  WHERE date IN (SELECT date FROM months) AND u.score IS NOT NULL AND u.outcome IS NOT NULL),
ranked AS (SELECT *, {_rank_sql('score', 'date, factor, horizon')} AS x, {_rank_sql('outcome', 'date, factor, horizon')} AS y,
  row_number() OVER (PARTITION BY date, factor, horizon ORDER BY score, symbol) * 1.0::DOUBLE / count(*) OVER (PARTITION BY date,
  factor, horizon) AS share FROM cells),
ics AS (SELECT date, factor, horizon, count(*) AS n, CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN covar_samp(x,
  y) / (stddev_samp(x) * stddev_samp(y)) END AS ic, coalesce(avg(outcome) FILTER (share > 0.8) - avg(outcome) FILTER (share <= 0.2),
  0.0) AS spread FROM ranked GROUP BY date, factor, horizon HAVING count(*) >= 20)"""


def _ics(spark: SparkSession, d: str) -> DataFrame:
    ahead = lambda h: F.round(ratio(F.lead("close", h).over(P.series()), F.col("close")) - 1, 9)
    rows = _tech(spark, d).select("date", "symbol", F.round("momentum_12", 9).alias("m"), F.round("volatility_12", 9).alias("v"), ahead(4).alias("f4"), ahead(12).alias("f12"))
    rows = rows.join(P.first_sessions(adapter.calendar(spark, d)), "date", "left_semi")
    cells = rows.selectExpr("date", "symbol", "stack(4, 'momentum', 4, m, f4, 'momentum', 12, m, f12, 'low_vol', 4, -v, f4, 'low_vol', 12, -v, f12) AS (factor, horizon, score, outcome)")
    # a row for each first session of a month, factor and horizon: as many as lines or fewer
    return study.rank_ic(cells, ["date", "factor", "horizon"], size=adapter.lines(spark, d))


@query(IC + " SELECT date, factor, horizon, n, round(ic, 6) AS ic, round(spread, 6) AS spread FROM ics")
def rank_ic_cells(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ics(spark, d))


@query(IC + """ SELECT factor, horizon, count(ic) AS periods, round(avg(ic), 6) AS mean_ic, round(median(ic), 6) AS median_ic, round(stddev_samp(ic),
  6) AS sd_ic, round(CASE WHEN count(ic) > 1 AND stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END,
  5) AS t_stat, round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 6) AS positive_share, round(avg(spread),
  6) AS mean_spread FROM ics GROUP BY 1, 2""")
def ic_summary(spark: SparkSession, d: str) -> DataFrame:
    out = study.ic_summary(_ics(spark, d), ["factor", "horizon"])
    return _rounded(out).withColumn("t_stat", F.round("t_stat", 5))


NW = """, o AS (SELECT *, ic - avg(ic) OVER (PARTITION BY factor, horizon) AS c FROM ics WHERE ic IS NOT NULL), g AS (SELECT *,
  c * lag(c, 1) OVER w AS g1, c * lag(c, 2) OVER w AS g2, c * lag(c, 3) OVER w AS g3
  FROM o WINDOW w AS (PARTITION BY factor, horizon ORDER BY date)),
s AS (SELECT factor, horizon, count(*) AS n, avg(ic) AS mean, sum(c * c) AS v, coalesce(sum(g1), 0) AS g1, coalesce(sum(g2),
  0) AS g2, coalesce(sum(g3), 0) AS g3 FROM g GROUP BY 1, 2)"""


@query(IC + NW + """, e AS (SELECT *, least(3, n - 1) AS l FROM s) SELECT factor, horizon, n, round(mean, 6) AS mean, round(CASE WHEN n >= 3
  THEN mean / nullif(sqrt(greatest(v / n + CASE WHEN l >= 1 THEN 2 * (1 - 1.0 / (l + 1)) * g1 / n ELSE 0 END + CASE
  WHEN l >= 2 THEN 2 * (1 - 2.0 / (l + 1)) * g2 / n ELSE 0 END + CASE WHEN l >= 3 THEN 2 * (1 - 3.0 / (l + 1)) * g3 / n
  ELSE 0 END, 0) / n), 0) END, 5) AS t_stat FROM e""")
def newey_west_effective(spark: SparkSession, d: str) -> DataFrame:
    out = study.newey_west(_ics(spark, d), ["factor", "horizon"], "ic", "date")
    return out.select("factor", "horizon", "n", F.round("mean", 6).alias("mean"), F.round("t_stat", 5).alias("t_stat"))


@query(IC + NW + """, e AS (SELECT *, v / n + 2 * 0.75 * g1 / n + 2 * 0.5 * g2 / n + 2 * 0.25 * g3 / n AS var
  FROM s) SELECT factor, horizon, n, round(mean, 6) AS mean, round(CASE WHEN var > 0 THEN mean / sqrt(var / n) END,
  5) AS t_stat FROM e""")
def newey_west_asked_lag(spark: SparkSession, d: str) -> DataFrame:
    out = study.newey_west(_ics(spark, d), ["factor", "horizon"], "ic", "date", effective=False)
    return out.select("factor", "horizon", "n", F.round("mean", 6).alias("mean"), F.round("t_stat", 5).alias("t_stat"))


VALUES = """WITH v AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, concat_ws('+', CASE WHEN l_linenumber % 2 = 1
  THEN 'a' END, CASE WHEN l_returnflag = 'N' THEN 'b' END, CASE WHEN l_linestatus = 'O' THEN 'c' END) AS variant,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM lineitem
  GROUP BY 1, 2), w AS (SELECT month, CASE WHEN variant = '' THEN 'none' ELSE variant END AS variant, value
  FROM v)"""


def _values(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("+", F.when(F.col("l_linenumber") % 2 == 1, "a"), F.when(F.col("l_returnflag") == "N", "b"), F.when(F.col("l_linestatus") == "O", "c"))
    rows = adapter.read(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month"), F.when(name == "", "none").otherwise(name).alias("variant"))
    return rows.agg((F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("value"))


_SHAPLEY_ROWS = ", ".join(f"('{c}', '{a}', '{b}', {w!r}::DOUBLE)" for c, a, b, w in study.shapley_weights(["a", "b", "c"]))


@query(VALUES + f""", t(component, without, w_ith, weight) AS (VALUES {_SHAPLEY_ROWS}), full_ AS (SELECT month
  FROM w GROUP BY month HAVING count(DISTINCT variant) = 8) SELECT month, component, round(sum(weight * (y.value - x.value)),
  8) AS contribution FROM full_ JOIN t ON true JOIN w x USING (month) JOIN w y USING (month)
  WHERE x.variant = t.without AND y.variant = t.w_ith GROUP BY 1, 2""")
def shapley_attribution(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(study.shapley(_values(spark, d), ["a", "b", "c"], ["month"]), 8)


@query(VALUES + """ SELECT count(x.value - y.value) AS matched, count(*) FILTER (x.value - y.value IS NULL) AS unmatched, round(avg(x.value - y.value),
  8) AS mean_difference, round(max(abs(x.value - y.value)), 8) AS max_difference FROM (SELECT *
  FROM w WHERE variant = 'a') x FULL JOIN (SELECT * FROM w WHERE variant = 'none') y ON x.month = y.month""")
def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(study.paired_difference(_values(spark, d), "a", "none", ["month"]), 8)


@query("""WITH t AS (SELECT p_brand AS family, p_partkey AS test, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE round((p_partkey * 7919 % 10007) / 10007.0::DOUBLE,
  9) END AS p_value FROM part),
r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family, p_value IS NULL ORDER BY p_value,
  test) AS k FROM t)
SELECT family, test, p_value, CASE WHEN p_value IS NOT NULL THEN round(least(max((m - k + 1) * p_value) OVER (PARTITION BY family,
  p_value IS NULL ORDER BY p_value, test ROWS UNBOUNDED PRECEDING), 1.0), 8) END AS holm,
CASE WHEN p_value IS NOT NULL THEN round(least(min(m * 1.0::DOUBLE / k * p_value) OVER (PARTITION BY family, p_value IS NULL ORDER BY p_value,
  test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 8) END AS bh FROM r""")
def multiplicity_adjustment(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("p_partkey") % 11 != 0, F.round((F.col("p_partkey") * 7919 % 10007) / 10007.0, 9))
    tests = adapter.read(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("test"), p.alias("p_value"))
    return study.adjust_p(tests, "family").withColumns({"holm": F.round("holm", 8), "bh": F.round("bh", 8)})


@query(INDEX + """, s AS (SELECT date, avg(close / prev - 1) AS strategy FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev
  FROM panel) GROUP BY date HAVING avg(close / prev - 1) IS NOT NULL), i AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS index
  FROM idx), j AS (SELECT date, round(strategy, 9) AS strategy, round(index, 9) AS index
  FROM s JOIN i USING (date) WHERE index IS NOT NULL) SELECT count(*) AS n, round(stddev_samp(strategy - index) * sqrt(52),
  6) AS tracking_error, round(avg(strategy - index) * 52 / (stddev_samp(strategy - index) * sqrt(52)), 6) AS information_ratio,
  round(corr(strategy, index), 6) AS correlation FROM j""")
def benchmark_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d)
    own = rows.withColumn("r", change(F.col("close"), 1)).groupBy("date").agg(F.avg("r").alias("strategy"))
    index = adapter.index_series(rows).withColumn("index", change(F.col("close"), 1, P.Window.orderBy("date")))
    both = own.join(index.select("date", "index"), "date").select("date", F.round("strategy", 9).alias("strategy"), F.round("index", 9).alias("index")).dropna()
    return _rounded(study.comparison_metrics(both, 52)).select("n", "tracking_error", "information_ratio", "correlation")


@query(PANEL + """, m AS (SELECT count(DISTINCT symbol) AS all_symbols FROM panel) SELECT CAST(date_trunc('month', date) AS DATE) AS month,
  count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS sessions, count(*) AS n_rows, count(*) FILTER (has_a) AS flagged,
  round(count(DISTINCT symbol) * 1.0::DOUBLE / max(all_symbols), 8) AS coverage FROM panel, m
  GROUP BY 1""")
def monthly_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d)
    everything = rows.agg(F.count_distinct("symbol").alias("all_symbols"))
    out = rows.groupBy(F.trunc("date", "month").alias("month")).agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("date").alias("sessions"), F.count("*").alias("n_rows"), F.count_if("has_a").alias("flagged"))
    return out.crossJoin(F.broadcast(everything)).select("month", "symbols", "sessions", "n_rows", "flagged", F.round(F.col("symbols") / F.col("all_symbols"), 8).alias("coverage"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (l_quantity IS NULL OR l_quantity <= 0) AS bad_quantity, count(*) FILTER (l_extendedprice IS NULL
  OR l_extendedprice <= 0) AS bad_price, count(*) FILTER (l_discount < 0 OR l_discount > 1) AS bad_discount, count(*) -
  count(DISTINCT (l_orderkey, l_linenumber)) AS repeated_keys, count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS bad_flag
  FROM lineitem""")
def integrity_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts of numeric, enumeration and key violations in one grouped pass."""
    rows = adapter.read(spark, d, "lineitem")
    bad = lambda c: F.col(c).isNull() | (F.col(c) <= 0)
    keys = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(bad("l_quantity")).alias("q"), F.count_if(bad("l_extendedprice")).alias("p"), F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 1)).alias("c"), F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("f"))
    return keys.agg(F.sum("n").alias("n_rows"), F.sum("q").alias("bad_quantity"), F.sum("p").alias("bad_price"), F.sum("c").alias("bad_discount"), F.sum(F.col("n") - 1).alias("repeated_keys"), F.sum("f").alias("bad_flag"))


BARS = PANEL + """, bars AS (SELECT date, symbol, coalesce(prev, close) AS open, high, close, CASE WHEN n_rows % 5 = 0 THEN NULL ELSE n_r > 3 END AS is_st,
  n_rows = 1 AS is_suspended, prev * 1.1 AS limit_up, prev * 0.9 AS limit_down, coalesce(close >= prev * 1.1, false) AS is_limit_up,
  coalesce(close <= prev * 0.9, false) AS is_limit_down FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev
  FROM panel))"""


def _bars(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d).withColumn("prev", F.lag("close").over(P.series()))
    return rows.select("date", "symbol", F.coalesce("prev", "close").alias("open"), "high", "close", F.when(F.col("n_rows") % 5 != 0, F.col("n_r") > 3).alias("is_st"), (F.col("n_rows") == 1).alias("is_suspended"), (F.col("prev") * 1.1).alias("limit_up"), (F.col("prev") * 0.9).alias("limit_down"), F.coalesce(F.col("close") >= F.col("prev") * 1.1, F.lit(False)).alias("is_limit_up"), F.coalesce(F.col("close") <= F.col("prev") * 0.9, F.lit(False)).alias("is_limit_down"))


def _block_sql(limit: str, side: str) -> str:
    reached = "open >= limit_up" if side == "buy" else "open <= limit_down"
    st = "WHEN is_st THEN 'blocked_st' " if side == "buy" else ""
    return f"CASE WHEN open IS NULL OR open <= 0 THEN 'blocked_missing_open' WHEN is_st IS NULL OR is_suspended IS NULL OR {limit} IS NULL THEN 'blocked_missing_constraint' WHEN is_suspended THEN 'blocked_suspended' {st}WHEN is_{limit} OR {reached} THEN 'blocked_{limit}' END"


@query(BARS + f" SELECT date, symbol, {_block_sql('limit_up', 'buy')} AS buy_block, {_block_sql('limit_down', 'sell')} AS sell_block FROM bars")
def execution_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d).select("date", "symbol", P.block_status("buy").alias("buy_block"), P.block_status("sell").alias("sell_block"))


def _simulated(spark: SparkSession, d: str) -> DataFrame:
    bars = _bars(spark, d).withColumns({"buy_block": P.block_status("buy"), "sell_block": P.block_status("sell")}).select("date", "symbol", "open", "close", "buy_block", "sell_block")
    targets = P.select_top(_rebalances(spark, d), 15).select("date", "symbol", F.col("position").alias("target_rank"))
    rows = bars.join(targets, ["date", "symbol"], "left").join(P.first_sessions(bars).withColumn("rebalance", F.lit(True)), "date", "left").withColumn("rebalance", F.coalesce("rebalance", F.lit(False)))
    return portfolio.simulate(rows, portfolio.sensitivity_scenarios(spark, 10, 5.0), portfolio.Rules(cash_yield=0.02, stop_loss=-0.35, cooldown_days=30))


@query()
def portfolio_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Equity and orders of five scenarios."""
    return _simulated(spark, d)


@query()
def portfolio_metrics(spark: SparkSession, d: str) -> DataFrame:
    # written once: equity and orders are read apart, and each reading would simulate anew
    return portfolio.metrics(scratch.materialize(_simulated(spark, d), "records"))


@query()
def portfolio_yearly(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.yearly_returns(_simulated(spark, d))


@query(PANEL + """, s AS (SELECT min(date) AS a, max(date) AS b FROM panel), w AS (SELECT a, unnest(range(0, 200)) AS k
  FROM s) SELECT CAST(k AS INTEGER) AS window_id, CAST(w.a + to_months(CAST(3 * k AS INTEGER)) AS DATE) AS train_start,
  CAST(CAST(w.a + to_months(CAST(3 * k AS INTEGER)) AS DATE) + INTERVAL 6 MONTH AS DATE) AS test_start, CAST(CAST(w.a + to_months(CAST(3 * k AS INTEGER)) AS DATE) + INTERVAL 9 MONTH AS DATE) AS test_end
  FROM w, s WHERE w.a + to_months(CAST(3 * k + 9 AS INTEGER)) <= b""")
def walk_forward_windows(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.walk_forward_windows(adapter.daily_panel(spark, d))


@query("""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value
  FROM events GROUP BY 1, 2""")
def event_day_totals(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of one day: the batch twin of the streaming totals."""
    rows = adapter.read(spark, d, "events").groupBy(F.window("ts", "1 day").start.cast("date").alias("day"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))


@query("""SELECT o_custkey AS symbol, CAST(CAST(o_orderdate AS DATE) AS DATE) AS date FROM orders
  WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders
  WHERE o_orderstatus <> 'F'""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.read(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus")
    return rows.filter("o_orderstatus = 'F'").drop("o_orderstatus").subtract(rows.filter("o_orderstatus <> 'F'").drop("o_orderstatus"))
