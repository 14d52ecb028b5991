"""Queries of trust: panel quality, master validation, audits, walk-forward windows, alpha health and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.operators import panel as P, portfolio, study, trust
from tidemark.plans import study_queries as S
from tidemark.plans.registry import INDEX, PANEL, TECH, _even, _rounded, _tech, even, query
from tidemark.plans.study_queries import _unsigned, _unsigned_sql
from tidemark.sources import adapter

AS_OF, YEAR = "2001-11-02", 52


@query(PANEL + f""", q AS (SELECT date, symbol, symbol % 5 AS source, CASE WHEN symbol % 5 = 1 AND n_rows = 1 THEN NULL ELSE close END AS close,
  CASE WHEN symbol % 5 = 2 AND n_rows < 3 THEN NULL ELSE amount END AS amount FROM panel
  WHERE symbol % 5 <> 3 OR date < DATE '2001-09-01'),
m AS (SELECT * FROM q UNION ALL SELECT * FROM q WHERE source = 4 AND symbol % 3 = 0),
k AS (SELECT source, symbol, date, count(*) AS n, count(*) - count(close) AS c, count(*) - count(amount) AS a
  FROM m GROUP BY 1, 2, 3),
g AS (SELECT source, sum(n)::BIGINT AS n_rows, count(DISTINCT symbol) AS symbols, max(date) AS latest, sum(c) / sum(n)::DOUBLE AS null_close,
  sum(a) / sum(n)::DOUBLE AS null_amount, sum(n - 1)::BIGINT AS repeated_keys FROM k
  GROUP BY source)
SELECT source, n_rows, symbols, latest, round(null_close, 6) AS null_close, round(null_amount, 6) AS null_amount,
  repeated_keys, (DATE '{AS_OF}' - latest)::INTEGER AS age_days,
  CASE WHEN DATE '{AS_OF}' - latest > 5 THEN 'stale' WHEN null_close > 0.01 OR null_amount > 0.05 OR repeated_keys > 0
  THEN 'warn' ELSE 'ok' END AS status FROM g""")
def panel_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each source's panel: one lacks closes, one amounts, one is old, one repeats keys."""
    source = (F.col("symbol") % 5).alias("source")
    close = F.when(~((F.col("symbol") % 5 == 1) & (F.col("n_rows") == 1)), F.col("close")).alias("close")
    amount = F.when(~((F.col("symbol") % 5 == 2) & (F.col("n_rows") < 3)), F.col("amount")).alias("amount")
    rows = adapter.daily_panel(spark, d).filter("symbol % 5 <> 3 OR date < DATE '2001-09-01'").select("date", "symbol", source, close, amount, "high", "low", F.col("close").alias("open"))
    rows = rows.unionByName(rows.filter("source = 4 AND symbol % 3 = 0"))
    return _rounded(trust.panel_quality(rows, ["source"], AS_OF))


_MASTER = """WITH m AS (
  SELECT CASE WHEN c_custkey % 53 = 0 THEN 'X' || c_custkey WHEN c_custkey % 101 = 0 THEN '600001.SH' ELSE lpad(CAST(c_custkey % 900000 AS VARCHAR),
  6, '0') || CASE WHEN c_custkey % 2 = 0 THEN '.SH' ELSE '.SZ' END END AS symbol,
    CASE WHEN c_custkey % 31 <> 0 THEN DATE '1990-01-01' + CAST(c_custkey % 4000 AS INTEGER) END AS list_date, CASE
  WHEN c_custkey % 7 = 0 THEN DATE '1996-01-01' + CAST(c_custkey % 2000 AS INTEGER) END AS delist_date,
    CASE WHEN c_custkey % 200 = 0 THEN 'B' WHEN c_custkey % 11 = 0 THEN NULL ELSE 'A' END AS stock_type
  FROM customer),
p AS (SELECT symbol, count(*) AS n, count(list_date) AS dated, count(delist_date) AS gone, count(*) FILTER (regexp_full_match(symbol,
  '(900\\d{3}\\.SH|200\\d{3}\\.SZ)') OR coalesce(stock_type, '') NOT IN ('', 'A')) AS other, count(*) FILTER (stock_type = 'A') AS typed,
  bool_or(coalesce(list_date <= DATE '2000-12-31' AND (delist_date IS NULL OR delist_date >= DATE '1998-01-01'),
  false)) AS alive, regexp_full_match(symbol, '\\d{6}\\.(SH|SZ|BJ)') AS good FROM m
  GROUP BY symbol),
f AS (SELECT sum(n)::BIGINT AS n_rows, count(*) FILTER (good) AS unique_symbols, sum(n) FILTER (good) / sum(n)::DOUBLE AS valid_rate,
  sum(n - 1)::BIGINT AS duplicates, sum(dated) / sum(n)::DOUBLE AS list_date_rate, sum(gone)::BIGINT AS delisted,
  count(*) FILTER (good AND symbol LIKE '%SH') AS in_sh, count(*) FILTER (good AND symbol LIKE '%SZ') AS in_sz, sum(other)::BIGINT AS other_shares,
  sum(typed) / sum(n)::DOUBLE AS typed_rate, count(*) FILTER (good AND alive) AS eligible
  FROM p)"""


@query(_MASTER + """ SELECT n_rows, unique_symbols, round(valid_rate, 6) AS valid_rate, duplicates, round(list_date_rate, 6) AS list_date_rate,
  delisted, in_sh, in_sz, other_shares, round(typed_rate, 6) AS typed_rate, eligible,
  array_to_string(list_filter([CASE WHEN n_rows < 100 THEN 'row_coverage' END, CASE WHEN unique_symbols < 100 THEN 'unique_symbol_coverage' END,
  CASE WHEN valid_rate < 0.98 THEN 'symbol_format' END, CASE WHEN duplicates > 0 THEN 'duplicate_symbols' END, CASE
  WHEN list_date_rate < 0.95 THEN 'list_date_coverage' END,
    CASE WHEN delisted < 50 THEN 'delisted_security_coverage' END, CASE WHEN least(in_sh, in_sz) < 1 THEN 'exchange_coverage' END,
  CASE WHEN other_shares > 0 THEN 'a_share_rows_only' END], lambda x: x IS NOT NULL), ',') AS hard,
  array_to_string(list_filter([CASE WHEN typed_rate < 0.95 THEN 'a_share_type_coverage' END, CASE WHEN eligible < 100
  THEN 'eligible_period_symbols' END], lambda x: x IS NOT NULL), ',') AS soft, 'invalid' AS status
  FROM f""")
def master_validation(spark: SparkSession, d: str) -> DataFrame:
    """A master with malformed and repeated symbols, missing dates and other shares."""
    k = F.col("c_custkey")
    symbol = F.when(k % 53 == 0, F.concat(F.lit("X"), k.cast("string"))).when(k % 101 == 0, "600001.SH").otherwise(F.concat(F.lpad((k % 900000).cast("string"), 6, "0"), F.when(k % 2 == 0, ".SH").otherwise(".SZ")))
    day = lambda a, n: F.date_add(F.lit(a).cast("date"), (k % n).cast("int"))
    master = adapter.read(spark, d, "customer").select(symbol.alias("symbol"), F.when(k % 31 != 0, day("1990-01-01", 4000)).alias("list_date"), F.when(k % 7 == 0, day("1996-01-01", 2000)).alias("delist_date"), F.when(k % 200 == 0, "B").when(k % 11 != 0, "A").alias("stock_type"))
    checked = trust.master_status(trust.broken_rules(trust.master_measures(master, "1998-01-01", "2000-12-31"), trust.master_rules(100, 100, 50)))
    return _rounded(checked.withColumns({c: F.array_join(c, ",") for c in ("hard", "soft")}))


_RETURNS = PANEL + """, ret AS (SELECT symbol, symbol % 10 AS pool, date, n_rows AS trades, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r
  FROM panel), day AS (SELECT pool, date, avg(r) / 20 + 0.002 * (pool - 4) AS r, sum(trades)::BIGINT AS trades
  FROM ret GROUP BY 1, 2 HAVING count(r) > 0)"""


def _pool_returns(spark: SparkSession, d: str) -> DataFrame:
    """(pool, date, r, trades): mean weekly changes of ten pools of symbols, scaled down to what portfolios make."""
    rows = adapter.daily_panel(spark, d).withColumn("pool", F.col("symbol") % 10)
    change = ratio(F.col("close"), F.lag("close").over(P.series())) - 1
    days = rows.withColumn("r", change).groupBy("pool", "date").agg((F.avg("r") / 20 + 0.002 * (F.first("pool") - 4)).alias("r"), F.sum("n_rows").alias("trades"))
    return days.filter("r IS NOT NULL")


_WINDOWS = """, span AS (SELECT min(date) AS a, max(date) AS b FROM panel), win AS (SELECT i AS window_id, a + to_months(CAST(3 * i AS INTEGER)) AS train_start,
  a + to_months(CAST(3 * i + 6 AS INTEGER)) AS test_start, a + to_months(CAST(3 * i + 9 AS INTEGER)) AS test_end
  FROM span, range(0, 200) t(i) WHERE a + to_months(CAST(3 * i + 9 AS INTEGER)) <= b)"""
_RESULTS = _RETURNS + _WINDOWS + f""", h AS (SELECT pool, window_id, sum(ln(1 + r)) FILTER (date < test_start) AS a, count(*) FILTER (date < test_start) AS train_n,
  sum(ln(1 + r)) FILTER (date >= test_start) AS b, count(*) FILTER (date >= test_start) AS test_n,
  coalesce(sum(trades) FILTER (date >= test_start), 0)::BIGINT AS test_trades FROM day
  JOIN win ON date >= train_start AND date < test_end GROUP BY 1, 2),
y AS (SELECT *, CASE WHEN train_n > 0 THEN exp(a * {YEAR} / train_n) - 1 END AS tr, CASE WHEN test_n > 0 THEN exp(b * {YEAR} / test_n) - 1 END AS te
  FROM h),
res AS (SELECT *, CASE WHEN tr > 0 THEN te / tr END AS oos, CASE WHEN tr IS NULL OR te IS NULL THEN 'error' WHEN te <= 0
  THEN 'failed_oos' WHEN tr > 0 AND te < tr * 0.5 THEN 'weak_oos' WHEN test_trades < 10 THEN 'low_trade_sample' ELSE 'ok' END AS status
  FROM y)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    return trust.window_results(_pool_returns(spark, d), portfolio.walk_forward_windows(adapter.calendar(spark, d)), ["pool"], YEAR)


@query(_RESULTS + f""" SELECT pool, window_id, train_n, test_n, test_trades, {_unsigned_sql('tr', 5)} AS train_annualized, {_unsigned_sql('te', 5)} AS test_annualized,
  {_unsigned_sql('oos', 3)} AS oos_ratio, {_unsigned_sql('te - tr', 5)} AS return_decay, status
  FROM res""")
def walk_forward_status(spark: SparkSession, d: str) -> DataFrame:
    """Train and test returns of ten pools in every window, and how the test compares."""
    return _results(spark, d).withColumns({c: _unsigned(F.col(c), k) for c, k in (("train_annualized", 5), ("test_annualized", 5), ("oos_ratio", 3), ("return_decay", 5))})


@query(_RESULTS + f""" SELECT pool, count(*) FILTER (status <> 'error') AS windows, round(avg(CASE WHEN status <> 'error' THEN (te > 0)::INT::DOUBLE END),
  6) AS positive_share, count(*) FILTER (status = 'failed_oos') AS failed, {_unsigned_sql('median(oos)', 3)} AS median_ratio
  FROM res GROUP BY pool""")
def walk_forward_summary(spark: SparkSession, d: str) -> DataFrame:
    out = trust.walk_forward_summary(_results(spark, d), ["pool"])
    return out.select("pool", "windows", F.round("positive_share", 6).alias("positive_share"), "failed", _unsigned(F.col("median_ratio"), 3).alias("median_ratio"))


@query(_RETURNS + f""", grown AS (SELECT pool, date, trades, r, exp(sum(ln(1 + r)) OVER w) AS e, exp(sum(ln(1 + r - 0.004)) OVER w) AS x
  FROM day WINDOW w AS (PARTITION BY pool ORDER BY date ROWS UNBOUNDED PRECEDING)),
fell AS (SELECT *, e / greatest(1.0, max(e) OVER (PARTITION BY pool ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd,
  year(date) AS y FROM grown),
yearly AS (SELECT pool, count(*) AS n_years, count(*) FILTER (g > 0) AS positive_years
  FROM (SELECT pool, y, sum(ln(1 + r)) AS g FROM fell GROUP BY 1, 2) GROUP BY pool),
cover AS (SELECT pool, count(r) / count(*)::DOUBLE AS coverage FROM ret GROUP BY pool),
m AS (SELECT pool, sum(trades)::BIGINT AS trades, min(dd) AS max_drawdown, exp(sum(ln(1 + r)) * {YEAR} / count(*)) - 1 AS annualized,
  exp(sum(ln(1 + r - 0.004)) * {YEAR} / count(*)) - 1 AS stressed, (max(date) - min(date)) / 365.25 AS years, sum(trades) / 1000.0 AS turnover
  FROM fell GROUP BY pool),
j AS (SELECT * FROM m JOIN yearly USING (pool) JOIN cover USING (pool)),
f AS (SELECT pool, list_filter([CASE WHEN trades < 30 THEN 'trade_count' END, CASE WHEN max_drawdown < -0.30 THEN 'drawdown' END,
  CASE WHEN -annualized > -1e-12 THEN 'annualized_return' END, CASE WHEN years < 0.75 THEN 'years_tested' END, CASE
  WHEN coverage < 0.70 THEN 'factor_coverage' END,
    CASE WHEN positive_years < greatest(1, n_years // 2) THEN 'positive_years' END, CASE WHEN annualized > 0 AND stressed < annualized * 0.5
  THEN 'stress_half' END, CASE WHEN -stressed > -1e-12 THEN 'stress_positive' END], lambda x: x IS NOT NULL) AS hard,
  list_filter([CASE WHEN turnover > 24 THEN 'turnover' END, CASE WHEN years >= 0.75 AND years < 3 THEN 'few_years' END,
  CASE WHEN coverage >= 0.70 AND coverage < 0.90 THEN 'thin_factor' END], lambda x: x IS NOT NULL) AS soft
  FROM j)
SELECT pool, array_to_string(hard, ',') AS hard, array_to_string(soft, ',') AS soft, CASE WHEN len(hard) >= 2 THEN 'abandon'
  WHEN len(hard) = 1 OR len(soft) > 0 THEN 'refine' ELSE 'deploy_simulation' END AS verdict
  FROM f""")
def audit_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Red flags, warnings and verdict of ten pools' results, with higher costs as the stress."""
    days = _pool_returns(spark, d)
    so_far = Window.partitionBy("pool").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = days.withColumn("e", F.exp(F.sum(F.log1p("r")).over(so_far)))
    fell = grown.withColumn("dd", F.col("e") / F.greatest(F.lit(1.0), F.max("e").over(so_far)) - 1)
    years = fell.groupBy("pool", F.year("date").alias("y")).agg(F.sum(F.log1p("r")).alias("g")).groupBy("pool").agg(F.count("*").alias("n_years"), F.count_if(F.col("g") > 0).alias("positive_years"))
    rows = adapter.daily_panel(spark, d).select((F.col("symbol") % 10).alias("pool"), (ratio(F.col("close"), F.lag("close").over(P.series())) - 1).alias("r"))
    coverage = rows.groupBy("pool").agg((F.count("r") / F.count("*")).alias("coverage"))
    annual = lambda x: F.exp(F.sum(x) * YEAR / F.count("*")) - 1
    measured = fell.groupBy("pool").agg(F.sum("trades").alias("trades"), F.min("dd").alias("max_drawdown"), annual(F.log1p("r")).alias("annualized"), annual(F.log1p(F.col("r") - 0.004)).alias("stressed"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"), (F.sum("trades") / 1000.0).alias("turnover"))
    out = trust.audit(measured.join(years, "pool").join(coverage, "pool"))
    return out.select("pool", F.array_join("hard", ",").alias("hard"), F.array_join("soft", ",").alias("soft"), "verdict")


_SCORES = ("up_share_24", "calm")
_HEALTH = ("breadth_12", "breadth_24", "above_mean", "drawdown_ok", "up_share_24_median", "calm_median")


@query(TECH + """, t AS (SELECT *, 1 / (1 + volatility_12) AS calm FROM tech),
h AS (SELECT date, avg(CASE WHEN momentum_12 IS NOT NULL THEN (momentum_12 > 0)::INT::DOUBLE END) AS breadth_12,
  avg(CASE WHEN momentum_24 IS NOT NULL THEN (momentum_24 > 0)::INT::DOUBLE END) AS breadth_24,
  avg(CASE WHEN mean_gap_12 IS NOT NULL THEN (mean_gap_12 > 0)::INT::DOUBLE END) AS above_mean, avg(CASE WHEN drawdown_24 IS NOT NULL
  THEN (drawdown_24 > -0.20)::INT::DOUBLE END) AS drawdown_ok, median(up_share_24) AS up_share_24_median, median(calm) AS calm_median
  FROM t GROUP BY date),
a AS (SELECT *, CASE WHEN coalesce(""" + ", ".join(_HEALTH) + ") IS NOT NULL THEN least(greatest((" + " + ".join(f"coalesce({c}, 0.0)" for c in _HEALTH) + ") / (" + " + ".join(f"({c} IS NOT NULL)::INT" for c in _HEALTH) + "), 0.0), 1.0) END AS alpha_health FROM h)\nSELECT date, " + ", ".join(f"{_even(c)} AS {c}" for c in (*_HEALTH, "alpha_health")) + ", " + ", ".join(f"{_even(f'lag({c}) OVER (ORDER BY date)')} AS {c}_lag1" for c in (*_HEALTH, "alpha_health")) + " FROM a")  # fmt: skip
def market_alpha_health(spark: SparkSession, d: str) -> DataFrame:
    """Breadths, shares and medians of each date and the health that they add up to."""
    rows = _tech(spark, d).withColumn("calm", 1 / (1 + F.col("volatility_12")))
    return even(trust.alpha_health(rows, _SCORES))


@query(INDEX + """, a AS (SELECT date, close, CASE WHEN count(close) OVER (ORDER BY date ROWS 23 PRECEDING) >= 12 THEN avg(close) OVER (ORDER BY date ROWS 23 PRECEDING) END AS mean_24,
  CASE WHEN count(close) OVER (ORDER BY date ROWS 39 PRECEDING) >= 24 THEN avg(close) OVER (ORDER BY date ROWS 39 PRECEDING) END AS mean_40,
  close / lag(close, 4) OVER (ORDER BY date) - 1 AS momentum_4, close / lag(close, 12) OVER (ORDER BY date) - 1 AS momentum_12,
  close / lag(close, 24) OVER (ORDER BY date) - 1 AS momentum_24 FROM idx),
b AS (SELECT date, lag(close) OVER o AS c, lag(mean_24) OVER o AS mean_24_lag1, lag(mean_40) OVER o AS mean_40_lag1,
  lag(momentum_4) OVER o AS momentum_4_lag1, lag(momentum_12) OVER o AS momentum_12_lag1, lag(momentum_24) OVER o AS momentum_24_lag1
  FROM a WINDOW o AS (ORDER BY date))
SELECT date, CASE WHEN c IS NOT NULL AND mean_24_lag1 IS NOT NULL THEN (c > mean_24_lag1)::INT::DOUBLE END AS trend_24_lag1,
  CASE WHEN c IS NOT NULL AND mean_40_lag1 IS NOT NULL THEN (c > mean_40_lag1)::INT::DOUBLE END AS trend_40_lag1,
  round(mean_24_lag1, 6) AS mean_24_lag1, round(mean_40_lag1, 6) AS mean_40_lag1, round(momentum_4_lag1, 6) AS momentum_4_lag1,
  round(momentum_12_lag1, 6) AS momentum_12_lag1, round(momentum_24_lag1, 6) AS momentum_24_lag1
  FROM b""")
def regime_trends(spark: SparkSession, d: str) -> DataFrame:
    """Two trends and three changes of the index, as known a date before."""
    return _rounded(trust.regime_trends(adapter.index_series(adapter.daily_panel(spark, d))))


_CARRIED = {"high": "high", "low": "low", "limit_up": "close * 1.25", "limit_down": "close * 0.75", "pe": "CASE WHEN n_rows > 1 THEN close / n_rows END", "is_st": "n_r > 3"}
_CARRY = ", ".join(f"last_value(p.{c} IGNORE NULLS) OVER held AS v_{c}" for c in _CARRIED)


@query(PANEL + f""", q AS (SELECT date, symbol, close, low AS open, {', '.join(f'{x} AS {c}' for c, x in _CARRIED.items() if c not in ('high', 'low'))}, high, low, n_r > 5 AS is_limit_up, amount FROM panel),
grid AS (SELECT f.symbol, d.date FROM (SELECT symbol, min(date) AS first FROM panel GROUP BY symbol) f JOIN (SELECT DISTINCT date FROM panel) d ON d.date >= f.first),
full_ AS (
  SELECT g.date, g.symbol, p.symbol IS NULL AS gap, last_value(p.close IGNORE NULLS) OVER held AS v_close, p.open, p.amount, p.is_limit_up, {_CARRY}, {', '.join(f'p.{c} AS o_{c}' for c in _CARRIED)}
  FROM grid g LEFT JOIN q p ON p.symbol = g.symbol AND p.date = g.date WINDOW held AS (PARTITION BY g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING))
SELECT date, symbol, gap AS is_suspended, v_close AS close, coalesce(open, lag(v_close) OVER (PARTITION BY symbol ORDER BY date), v_close) AS open, coalesce(amount, 0.0) AS amount,
  CASE WHEN gap THEN false ELSE is_limit_up END AS is_limit_up, {', '.join(f'CASE WHEN gap THEN v_{c} ELSE o_{c} END AS {c}' for c in _CARRIED)} FROM full_""")
def calendar_alignment_fields(spark: SparkSession, d: str) -> DataFrame:
    """Alignment with all fields: highs, lows, limits, ratios and treatment are carried, flags aren't, a missing open is the close before."""
    rows = adapter.daily_panel(spark, d).select("date", "symbol", "close", F.col("low").alias("open"), "high", "low", "amount", "volume", (F.col("n_r") > 5).alias("is_limit_up"), *(F.expr(x).alias(c) for c, x in _CARRIED.items() if c not in ("high", "low")))
    return P.densify(rows).select("date", "symbol", "is_suspended", "close", "open", "amount", "is_limit_up", *_CARRIED)


@query(INDEX + """, s AS (
  SELECT date, avg(close / prev - 1) AS strategy FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM panel) GROUP BY date HAVING avg(close / prev - 1) IS NOT NULL),
i AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS index FROM idx),
j AS (SELECT date, round(strategy, 9) AS strategy, round(index, 9) AS index FROM s JOIN i USING (date) WHERE index IS NOT NULL),
g AS (SELECT date, exp(sum(ln(1 + strategy)) OVER w) AS a, exp(sum(ln(1 + index)) OVER w) AS b FROM j WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
f AS (SELECT a / greatest(max(a) OVER w, 1.0) - 1 AS x, b / greatest(max(b) OVER w, 1.0) - 1 AS y FROM g WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT count(*) AS n, round(min(x), 6) AS strategy_drawdown, round(min(y), 6) AS index_drawdown FROM f""")
def benchmark_drawdowns(spark: SparkSession, d: str) -> DataFrame:
    """Deepest falls of the mean symbol and of the index over their common dates."""
    rows = adapter.daily_panel(spark, d)
    own = rows.withColumn("r", ratio(F.col("close"), F.lag("close").over(P.series())) - 1).groupBy("date").agg(F.avg("r").alias("strategy"))
    index = adapter.index_series(rows).withColumn("index", ratio(F.col("close"), F.lag("close").over(Window.orderBy("date"))) - 1)
    both = own.join(index.select("date", "index"), "date").select("date", F.round("strategy", 9).alias("strategy"), F.round("index", 9).alias("index")).dropna()
    return _rounded(study.comparison_metrics(both, 52)).select("n", "strategy_drawdown", "index_drawdown")


@query(S.CANDIDATES + """ SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS candidates, count(roe_report) AS with_report, count(roe_publication) AS with_publication,
  round(count(roe_publication) / count(*)::DOUBLE, 6) AS share, max(date - period_publication)::INTEGER AS oldest_days, count(*) FILTER (roe_publication IS NOT NULL AND momentum IS NOT NULL AND low_vol IS NOT NULL) AS complete
  FROM cand WHERE in_pit GROUP BY 1""")
def fundamental_month_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many of each month's listed candidates have fundamentals that were known, and how old the oldest is."""
    rows = S._candidates(spark, d).filter("in_pit").groupBy(F.trunc("date", "month").alias("month"))
    known = F.col("roe_publication").isNotNull()
    out = rows.agg(
        F.count("*").alias("candidates"), F.count("roe_report").alias("with_report"), F.count("roe_publication").alias("with_publication"), (F.count("roe_publication") / F.count("*")).alias("share"),
        F.max(F.datediff("date", "period_publication")).alias("oldest_days"), F.count_if(known & F.col("momentum").isNotNull() & F.col("low_vol").isNotNull()).alias("complete"),
    )
    return _rounded(out)
