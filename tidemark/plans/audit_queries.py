"""Queries of normalisation, masks, checked joins, coverage and integrity audits, and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import coverage, joins, normalise, panel as P
from tidemark.plans.factor_queries import RAW, fields
from tidemark.plans.registry import BARS, EVENTS, MASTER, PANEL, _bars, _even, even, even_sql, query
from tidemark.sources import adapter

#: Raw codes of all forms: plain, short, of a number, with an exchange, with blanks, missing.
CODES = """WITH c AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '900' ELSE '688' END || lpad(CAST(s_suppkey % 1000 AS VARCHAR),
  3, '0') AS full_code, s_nationkey FROM supplier),
codes AS (SELECT k, CASE k % 7 WHEN 0 THEN full_code WHEN 1 THEN CAST(CAST(full_code AS BIGINT) AS VARCHAR) || '.0'
  WHEN 2 THEN ' ' || CAST(k % 1000 AS VARCHAR) || ' ' WHEN 3 THEN full_code || '.sz' WHEN 4 THEN 'nan' WHEN 5 THEN NULL
  ELSE CAST(CAST(full_code AS BIGINT) AS VARCHAR) || '.SH' END AS code,
 CASE s_nationkey % 5 WHEN 0 THEN 'sse' WHEN 1 THEN 'Shenzhen' WHEN 2 THEN 'BJ' WHEN 3 THEN 'elsewhere' END AS market
  FROM c),
t AS (SELECT k, code, market, CASE WHEN upper(trim(coalesce(code, ''))) IN ('NAN', 'NONE', 'NULL') THEN '' ELSE regexp_replace(upper(trim(coalesce(code,
  ''))), '^(\\d+)\\.0$', '\\1') END AS text FROM codes)"""


def _codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    head = F.element_at(F.array(*map(F.lit, ("600", "000", "900", "688"))), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    full = F.concat(head, F.lpad((k % 1000).cast("string"), 3, "0"))
    short = full.cast("long").cast("string")
    code = F.when(k % 7 == 0, full).when(k % 7 == 1, F.concat(short, F.lit(".0"))).when(k % 7 == 2, F.concat(F.lit(" "), (k % 1000).cast("string"), F.lit(" "))).when(k % 7 == 3, F.concat(full, F.lit(".sz"))).when(k % 7 == 4, "nan").when(k % 7 == 6, F.concat(short, F.lit(".SH")))
    market = F.when(F.col("s_nationkey") % 5 == 0, "sse").when(F.col("s_nationkey") % 5 == 1, "Shenzhen").when(F.col("s_nationkey") % 5 == 2, "BJ").when(F.col("s_nationkey") % 5 == 3, "elsewhere")
    return adapter.read(spark, d, "supplier").select(k.alias("k"), code.alias("code"), market.alias("market"))


_PAD = "CASE WHEN length({x}) < 6 THEN lpad({x}, 6, '0') ELSE {x} END".format
_NORMAL = f"""CASE WHEN text = '' THEN '' WHEN contains(text, '.') THEN ({_PAD(x="split_part(text, '.', 1)")}) || '.' || split_part(text, '.', 2) ELSE ({_PAD(x='text')}) || CASE WHEN regexp_matches({_PAD(x='text')}, '^(600|601|603|605|688|689)') THEN '.SH' WHEN regexp_matches({_PAD(x='text')}, '^[489]') THEN '.BJ' ELSE '.SZ' END END"""
_IN_MARKET = f"""CASE WHEN text = '' THEN '' WHEN upper(trim(market)) IN ('SH', 'SSE', 'XSHG', 'SHANGHAI') THEN ({_PAD(x='text')}) || '.SH' WHEN upper(trim(market)) IN ('SZ', 'SZSE', 'XSHE', 'SHENZHEN') THEN ({_PAD(x='text')}) || '.SZ' WHEN upper(trim(market)) IN ('BJ', 'BSE', 'XBEI', 'BEIJING') THEN ({_PAD(x='text')}) || '.BJ' ELSE {_NORMAL} END"""


@query(CODES + f""" SELECT k, {_NORMAL} AS symbol, CASE WHEN contains(text, '.') THEN NULL ELSE {_IN_MARKET} END AS in_market, regexp_matches(upper({_NORMAL}),
  '^(200\\d{{3}}\\.SZ|900\\d{{3}}\\.SH)$') AS b_share FROM t""")
def symbol_normalisation(spark: SparkSession, d: str) -> DataFrame:
    rows = _codes(spark, d)
    symbol = normalise.normal_symbol(F.col("code"))
    market = F.when(~F.contains(normalise.symbol_code(F.col("code")), F.lit(".")), normalise.symbol_in_market(F.col("code"), F.col("market")))
    return rows.select("k", symbol.alias("symbol"), market.alias("in_market"), normalise.is_b_share(symbol).alias("b_share"))


MASTER_ROWS = MASTER + """, m AS (SELECT CASE symbol % 5 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '900' WHEN 3 THEN '200' ELSE '830' END || lpad(CAST(symbol % 1000 AS VARCHAR),
  3, '0') || CASE symbol % 5 WHEN 0 THEN '.SH' WHEN 2 THEN '.SH' WHEN 4 THEN '.BJ' ELSE '.SZ' END AS symbol, symbol AS k,
  CASE WHEN symbol % 29 <> 0 THEN list_date END AS list_date, CASE WHEN symbol % 49 <> 0 THEN CASE WHEN symbol % 63 = 0
  THEN list_date - 5 ELSE delist_date END END AS delist_date,
 CASE WHEN symbol % 31 = 0 THEN 'paused' WHEN symbol % 7 = 0 AND symbol % 2 = 0 THEN 'delisted' ELSE 'listed' END AS list_status,
  CASE WHEN symbol % 11 = 0 THEN 'fund' ELSE ' a ' END AS stock_type FROM master)"""


def _master(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("symbol")
    head = F.element_at(F.array(*map(F.lit, ("600", "000", "900", "200", "830"))), (F.pmod(k, F.lit(5)) + 1).cast("int"))
    tail = F.when((k % 5 == 0) | (k % 5 == 2), ".SH").when(k % 5 == 4, ".BJ").otherwise(".SZ")
    gone = F.when(k % 49 != 0, F.when(k % 63 == 0, F.date_sub("list_date", 5)).otherwise(F.col("delist_date")))
    status = F.when(k % 31 == 0, "paused").when((k % 7 == 0) & (k % 2 == 0), "delisted").otherwise("listed")
    return adapter.stock_master(spark, d).select(F.concat(head, F.lpad((k % 1000).cast("string"), 3, "0"), tail).alias("symbol"), k.alias("k"), F.when(k % 29 != 0, F.col("list_date")).alias("list_date"), gone.alias("delist_date"), status.alias("list_status"), F.when(k % 11 == 0, "fund").otherwise(" a ").alias("stock_type"))


@query(MASTER_ROWS + """ SELECT DISTINCT symbol FROM m WHERE upper(trim(stock_type)) IN ('A股', 'A', 'ASHARE', 'A-SHARE') AND list_date IS NOT NULL
  AND NOT regexp_matches(symbol, '^(200\\d{3}\\.SZ|900\\d{3}\\.SH)$') AND (list_status = 'listed' OR (list_status = 'delisted'
  AND delist_date IS NOT NULL)) AND NOT suffix(symbol, '.BJ') AND list_date <= DATE '2000-01-01' AND (delist_date IS NULL
  OR delist_date > DATE '1996-01-01')""")
def eligible_symbols(spark: SparkSession, d: str) -> DataFrame:
    return normalise.eligible_symbols(_master(spark, d), "1996-01-01", "2000-01-01")


@query(MASTER_ROWS + """ SELECT count(*) AS n_rows, count(*) FILTER (list_date IS NULL) AS missing_list_date, count(*) FILTER (list_status = 'delisted'
  AND delist_date IS NULL) AS delisted_without_date, count(*) FILTER (list_status = 'listed' AND delist_date IS NOT NULL) AS listed_with_delist_date,
  count(*) FILTER (delist_date < list_date) AS delisted_before_listed, count(*) FILTER (list_status = 'paused') AS unknown_status,
  count(DISTINCT symbol) FILTER (list_status = 'delisted') AS delisted_symbols, count(DISTINCT symbol) FILTER (list_date <= DATE '2000-06-30'
  AND (delist_date IS NULL OR delist_date > DATE '2000-06-30')) AS survivors FROM m""")
def master_lifecycle_integrity(spark: SparkSession, d: str) -> DataFrame:
    return coverage.lifecycle_integrity(_master(spark, d), "2000-06-30")


@query(MASTER_ROWS + """, raw AS (SELECT CASE k % 13 WHEN 0 THEN ' ' || symbol WHEN 1 THEN '' WHEN 2 THEN 'X' || symbol ELSE symbol END AS symbol
  FROM m) SELECT count(*) AS n_rows, count(*) FILTER (trim(symbol) = '') AS blank, count(*) FILTER (symbol <> trim(symbol)
  AND trim(symbol) <> '') AS padded, count(*) FILTER (trim(symbol) <> '' AND NOT regexp_matches(trim(symbol), '^[0-9]{6}\\.(SH|SZ)$')) AS malformed,
  count(DISTINCT symbol) FILTER (regexp_matches(symbol, '^[0-9]{6}\\.(SH|SZ)$')) AS symbols
  FROM raw""")
def symbol_integrity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k") % 13
    raw = _master(spark, d).select(F.when(k == 0, F.concat(F.lit(" "), "symbol")).when(k == 1, "").when(k == 2, F.concat(F.lit("X"), "symbol")).otherwise(F.col("symbol")).alias("symbol"))
    return coverage.symbol_integrity(raw)


@query(RAW + f""", two AS (SELECT date, symbol, dividend_yield AS share, dividend_yield * 100 AS per_cent
  FROM f) SELECT date, symbol, {_even('share')} AS share, {_even('per_cent / 100')} AS per_cent
  FROM two""")
def yield_unit_inference(spark: SparkSession, d: str) -> DataFrame:
    """A column of shares stays, one of per cents is divided by 100."""
    rows = fields(spark, d).select("date", "symbol", F.col("dividend_yield").alias("share"), (F.col("dividend_yield") * 100).alias("per_cent"))
    return even(normalise.in_unit(normalise.in_unit(rows, "share"), "per_cent"))


@query(BARS + """, b AS (SELECT b.*, p.amount FROM bars b JOIN panel p USING (date, symbol)) SELECT date, symbol, NOT coalesce(is_st,
  false) AND NOT coalesce(is_suspended, false) AND coalesce(amount, 0) >= 20000 AS ic_eligible, coalesce(is_st IS NOT NULL
  AND limit_up IS NOT NULL AND limit_down IS NOT NULL AND NOT is_st AND NOT is_suspended AND amount >= 20000, false) AS trade_candidate
  FROM b""")
def eligibility_masks(spark: SparkSession, d: str) -> DataFrame:
    """Unknown flags pass the diagnostics' mask and fail the portfolio's."""
    rows = _bars(spark, d).join(adapter.daily_panel(spark, d).select("date", "symbol", "amount"), ["date", "symbol"])
    return rows.select("date", "symbol", normalise.ic_eligible(20000).alias("ic_eligible"), normalise.trade_candidate(20000).alias("trade_candidate"))


@query(BARS + """ SELECT count(*) AS n_rows, count(*) FILTER (is_suspended IS NULL) AS unknown_suspension, count(*) FILTER (NOT coalesce(is_suspended,
  false) AND (is_st IS NULL OR limit_up IS NULL OR limit_down IS NULL)) AS missing_constraint
  FROM bars""")
def tradable_constraints(spark: SparkSession, d: str) -> DataFrame:
    return normalise.contract_breaches(_bars(spark, d))


TEXTS = PANEL + """, raw AS (SELECT date, symbol, CASE n_rows % 9 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '1e999' WHEN 3 THEN '-' || CAST(n_rows AS VARCHAR)
  ELSE CAST(n_rows AS VARCHAR) || '.5' END AS close, CASE n_rows % 7 WHEN 0 THEN NULL WHEN 1 THEN '-3' WHEN 2 THEN '12,5'
  ELSE '+' || CAST(n_rows AS VARCHAR) END AS amount, CASE n_rows % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2
  THEN '' WHEN 3 THEN 'maybe' WHEN 4 THEN '1' ELSE NULL END AS is_st FROM panel)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    n, text = F.col("n_rows"), F.col("n_rows").cast("string")
    close = F.when(n % 9 == 0, "").when(n % 9 == 1, "n/a").when(n % 9 == 2, "1e999").when(n % 9 == 3, F.concat(F.lit("-"), text)).otherwise(F.concat(text, F.lit(".5")))
    amount = F.when(n % 7 == 1, "-3").when(n % 7 == 2, "12,5").when(n % 7 != 0, F.concat(F.lit("+"), text))
    flag = F.when(n % 6 == 0, "TRUE").when(n % 6 == 1, "false").when(n % 6 == 2, "").when(n % 6 == 3, "maybe").when(n % 6 == 4, "1")
    return adapter.daily_panel(spark, d).select("date", "symbol", "n_rows", close.alias("close"), amount.alias("amount"), flag.alias("is_st"))


@query(TEXTS + """ SELECT count(*) AS n_rows, count(*) FILTER (close = '') AS close_blank, count(*) FILTER (close = 'n/a') AS close_malformed,
  count(*) FILTER (close = '1e999') AS close_non_finite, count(*) FILTER (prefix(close, '-')) AS close_out_of_range,
  count(*) FILTER (amount IS NULL) AS amount_blank, count(*) FILTER (contains(amount, ',')) AS amount_malformed,
  CAST(0 AS BIGINT) AS amount_non_finite, count(*) FILTER (amount = '-3') AS amount_out_of_range, false AS verified
  FROM raw""")
def numeric_integrity(spark: SparkSession, d: str) -> DataFrame:
    return coverage.numeric_integrity(_texts(spark, d), ["close"], ["amount"])


@query(TEXTS + """ SELECT count(*) AS n_rows, count(*) FILTER (coalesce(is_st, '') = '') AS is_st_blank, count(*) FILTER (is_st = 'maybe') AS is_st_unknown,
  count(*) FILTER (is_st IN ('TRUE', '1')) AS is_st_set FROM raw""")
def boolean_integrity(spark: SparkSession, d: str) -> DataFrame:
    return coverage.boolean_integrity(_texts(spark, d), ["is_st"])


@query(TEXTS + """, typed AS (SELECT date, symbol, CASE WHEN abs(TRY_CAST(close AS DOUBLE)) < 'inf'::DOUBLE THEN TRY_CAST(close AS DOUBLE) END AS close,
  date_part('day', date) AS volume FROM raw) SELECT date, symbol, close, volume::DOUBLE AS volume, volume * close AS amount,
  false AS has_open FROM typed WHERE close IS NOT NULL""")
def market_column_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """No amount is delivered, so it is volume times close; rows without a close go."""
    raw = _texts(spark, d).select("date", "symbol", "close", F.lit(None).cast("string").alias("open"), F.dayofmonth("date").cast("string").alias("volume"))
    return normalise.market_columns(raw).select("date", "symbol", "close", "volume", "amount", "has_open")


ADJUSTED = PANEL + """, a AS (SELECT date, symbol, n_rows, CASE WHEN n_rows % 17 = 0 THEN NULL ELSE close END AS close_raw, 1 + symbol / 100.0::DOUBLE AS adjustment_factor,
  close * (1 + symbol / 100.0::DOUBLE) * CASE WHEN n_rows % 23 = 0 THEN 1.000001 ELSE 1.0 END AS close, CASE WHEN n_rows % 19 = 0
  THEN 'other' ELSE 'forward' END AS method, CASE WHEN n_rows % 13 = 0 THEN NULL ELSE 'CNY' END AS unit
  FROM panel)"""


@query(ADJUSTED + """ SELECT count(*) AS n_rows, count(*) FILTER (close_raw IS NULL) AS uncheckable, count(*) FILTER (close_raw IS NOT NULL
  AND n_rows % 23 = 0) AS mismatched, count(*) FILTER (method = 'other') AS other_method, count(*) FILTER (unit IS NULL) AS other_unit
  FROM a""")
def adjustment_integrity(spark: SparkSession, d: str) -> DataFrame:
    n, factor = F.col("n_rows"), 1 + F.col("symbol") / 100.0
    rows = adapter.daily_panel(spark, d).select(F.when(n % 17 != 0, F.col("close")).alias("close_raw"), factor.alias("adjustment_factor"), (F.col("close") * factor * F.when(n % 23 == 0, 1.000001).otherwise(1.0)).alias("close"), F.when(n % 19 == 0, "other").otherwise("forward").alias("method"), F.when(n % 13 != 0, "CNY").alias("unit"))
    return coverage.adjustment_integrity(rows, "forward", "CNY")


FACTS = """WITH raw AS (SELECT o_custkey % 100 + 1 AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS period,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) - 90 AS published FROM orders)"""


@query(FACTS + """ SELECT count(*) AS n_rows, count(*) FILTER (symbol % 10 <> 0) AS comparable, count(*) FILTER (symbol % 10 <> 0 AND published < period) AS published_before_end,
  median(published - period) FILTER (symbol % 10 <> 0)::DOUBLE AS median_delay FROM raw""")
def publication_order(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    rows = adapter.read(spark, d, "orders").select((F.pmod("o_custkey", F.lit(100)) + 1).alias("symbol"), F.date_sub(F.trunc(day, "quarter"), 1).alias("period"), F.date_sub(F.date_add(day, F.pmod("o_orderkey", F.lit(60)).cast("int")), 90).alias("published"))
    return coverage.publication_order(rows.withColumn("published", F.when(F.col("symbol") % 10 != 0, F.col("published"))))


COVERED = BARS + """, b AS (SELECT b.date, b.symbol, b.open, b.high, CASE WHEN p.n_rows % 21 = 0 THEN NULL ELSE p.low END AS low, b.close,
  p.volume, CASE WHEN p.n_rows % 25 = 0 THEN -p.amount ELSE p.amount END AS amount
  FROM bars b JOIN panel p USING (date, symbol)), twice AS (SELECT * FROM b UNION ALL SELECT *
  FROM b WHERE symbol % 50 = 3), marked AS (SELECT *, (low IS NULL OR open <= 0 OR high < low OR close > high * 1.000001
  OR close < low * 0.999999) AS bad FROM twice)"""


@query(COVERED + """, per AS (SELECT symbol, count(DISTINCT date) * 1.0::DOUBLE / (SELECT count(DISTINCT date)
  FROM twice) AS share FROM twice GROUP BY symbol), e AS (SELECT s_suppkey + 5 AS symbol
  FROM supplier)
SELECT (SELECT count(*) FROM marked) AS n_rows, (SELECT count(*) FROM per) AS unique_symbols, (SELECT count(*)
  FROM e) AS expected_symbols, (SELECT count(*) FROM per WHERE symbol IN (SELECT symbol
  FROM e)) AS covered, (SELECT count(*) FROM e WHERE symbol NOT IN (SELECT symbol FROM per)) AS missing, (SELECT
  count(*) FROM per WHERE symbol NOT IN (SELECT symbol FROM e)) AS extra, (SELECT count(DISTINCT date)
  FROM twice) AS trading_dates, """ + f"""(SELECT {_even('median(share)')} FROM per) AS median_date_share, (SELECT {_even('min(share)')}
  FROM per) AS min_date_share, (SELECT count(*) - count(DISTINCT (symbol, date)) FROM twice) AS repeated_keys, (SELECT
  count(*) FROM marked WHERE bad) AS bad_prices, (SELECT count(*) FROM marked WHERE amount < 0) AS negative_amounts,
  (SELECT min(date) FROM twice) AS min_date, (SELECT max(date) FROM twice) AS max_date""")
def quote_coverage(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_rows")
    more = adapter.daily_panel(spark, d).select("date", "symbol", F.when(n % 21 != 0, F.col("low")).alias("low"), "volume", F.when(n % 25 == 0, -F.col("amount")).otherwise(F.col("amount")).alias("amount"))
    rows = _bars(spark, d).select("date", "symbol", "open", "high", "close").join(more, ["date", "symbol"])
    expected = adapter.read(spark, d, "supplier").select((F.col("s_suppkey") + 5).alias("symbol"))
    return even(coverage.quote_coverage(rows.union(rows.filter("symbol % 50 = 3")), expected))


_FIELDS = ("pe", "pb", "roe", "dividend_yield")


@query(RAW + ", n AS (SELECT count(*) AS all_rows, count(DISTINCT symbol) AS s FROM f) " + " UNION ALL ".join(f"""SELECT '{c}' AS field, all_rows AS n_rows, count({c}) AS non_null, count(DISTINCT symbol) FILTER ({c} IS NOT NULL) AS symbols,
  {_even(f'count({c}) * 1.0::DOUBLE / all_rows')} AS coverage, {_even(f'count(DISTINCT symbol) FILTER ({c} IS NOT NULL) * 1.0::DOUBLE / s')} AS symbol_coverage
  FROM f, n GROUP BY all_rows, s""" for c in _FIELDS))
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    return even(coverage.field_coverage(fields(spark, d), list(_FIELDS)))


@query(RAW + """ SELECT count(*) AS n_rows, count(DISTINCT symbol) AS symbols, count(DISTINCT date) AS dates, min(date) AS first,
  max(date) AS last, count(*) - count(DISTINCT (symbol, date)) AS repeated_keys, count(main_net_inflow) AS n_main_net_inflow,
  count(margin_balance) AS n_margin_balance FROM f""")
def asset_metrics(spark: SparkSession, d: str) -> DataFrame:
    return coverage.asset_metrics(fields(spark, d), ["main_net_inflow", "margin_balance"])


@query(PANEL + """, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session FROM (SELECT DISTINCT date
  FROM panel)), months AS (SELECT min(date) AS date FROM cal GROUP BY date_trunc('month', date)), c AS (SELECT p.date,
  p.symbol, cal.session FROM panel p JOIN months USING (date) JOIN cal USING (date)), s AS (SELECT symbol, session
  FROM panel JOIN cal USING (date)), m AS (SELECT c.date, c.symbol, """ + ", ".join(f"max(CASE WHEN s.session = c.session + ({k}) THEN 1 ELSE 0 END) AS k{i}" for i, k in enumerate((0, -12, 4, 5))) + " FROM c JOIN s USING (symbol) GROUP BY 1, 2) SELECT date, count(*) AS candidates, count(*) FILTER (k0 + k1 + k2 + k3 = 4) AS with_all, sum(k0)::BIGINT AS at_0, sum(k1)::BIGINT AS \"at_-12\", sum(k2)::BIGINT AS at_4, sum(k3)::BIGINT AS at_5 FROM m GROUP BY date")
def session_offset_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many of each month's candidates are quoted on the sessions that features and returns need."""
    rows = adapter.daily_panel(spark, d).select("date", "symbol")
    calendar = adapter.calendar(spark, d)
    return coverage.offset_presence(rows, rows.join(P.first_sessions(calendar), "date", "left_semi"), joins.sessions(calendar), [0, -12, 4, 5])


@query(EVENTS + """, a AS (SELECT DISTINCT date, symbol FROM ev WHERE event_type = 'click'), b AS (SELECT DISTINCT date, symbol
  FROM ev WHERE event_type = 'purchase'), u AS (SELECT coalesce(a.date, b.date) AS date, (a.symbol IS NOT NULL)::INT AS x,
  (b.symbol IS NOT NULL)::INT AS y FROM a FULL JOIN b ON a.date = b.date AND a.symbol = b.symbol) SELECT date, sum(x)::BIGINT AS n_a,
  sum(y)::BIGINT AS n_b, sum(x * y)::BIGINT AS both, count(*) AS either, sum(x * (1 - y))::BIGINT AS only_a, sum(y * (1 - x))::BIGINT AS only_b,
  sum(abs(x - y))::BIGINT AS one_side FROM u GROUP BY date""")
def daily_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Users who click and users who buy, by day: intersection, union and differences."""
    ev = adapter.user_events(spark, d)
    return coverage.set_algebra(ev.filter("event_type = 'click'"), ev.filter("event_type = 'purchase'"), "symbol", "date")


@query(PANEL + """, k AS (SELECT date, symbol FROM panel), r AS (SELECT date, symbol FROM panel WHERE n_rows > 1), j AS (SELECT k.date,
  k.symbol FROM k JOIN r USING (date, symbol)) SELECT (SELECT count(*) FROM k) AS left_keys, (SELECT count(*)
  FROM r) AS right_keys, (SELECT count(*) FROM j) AS matched, CAST(0 AS BIGINT) AS left_repeated, CAST(0 AS BIGINT) AS right_repeated""")
def join_match_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d)
    return normalise.match_counts(rows, rows.filter("n_rows > 1"), ["date", "symbol"])


@query(BARS + " SELECT p.date, p.symbol, p.amount, b.is_suspended FROM panel p JOIN bars b USING (date, symbol)")
def one_to_one_join(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d).select("date", "symbol", "amount")
    return normalise.one_to_one(rows, _bars(spark, d).select("date", "symbol", "is_suspended"), ["date", "symbol"])


@query(PANEL + f" SELECT date, symbol, {_even('close * (1 + symbol / 100.0::DOUBLE)')} AS close FROM panel")
def exact_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every row needs its adjustment factor; one without raises."""
    rows = adapter.daily_panel(spark, d).select("date", "symbol", "close")
    factor = rows.select("symbol").distinct().withColumn("factor", 1 + F.col("symbol") / 100.0)
    out = normalise.exact_lookup(rows, factor, ["symbol"], "factor")
    return even(out.select("date", "symbol", (F.col("close") * F.col("factor")).alias("close")))


@query(PANEL + " SELECT date, symbol, CASE WHEN n_rows % 2 = 0 THEN 'own' WHEN symbol % 3 <> 0 THEN 'I' || CAST(symbol % 8 AS VARCHAR) END AS industry FROM panel")
def coalesce_fill_join(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d).select("date", "symbol", F.when(F.col("n_rows") % 2 == 0, "own").alias("industry"))
    lookup = adapter.stock_master(spark, d).filter("symbol % 3 <> 0").select("symbol", "industry")
    return normalise.fill_from(rows, F.broadcast(lookup), ["symbol"], ["industry"])


@query(PANEL + """, h AS (SELECT date, lag(n) OVER (ORDER BY date) AS listed_before FROM (SELECT date, count(*) AS n
  FROM panel GROUP BY date)) SELECT p.date, p.symbol, h.listed_before FROM panel p
  JOIN h USING (date)""")
def date_keyed_map(spark: SparkSession, d: str) -> DataFrame:
    """A market feature of the date before, mapped to every row of a date: one row a date is broadcast."""
    rows = adapter.daily_panel(spark, d).select("date", "symbol")
    market = rows.groupBy("date").agg(F.count("*").alias("n")).select("date", F.lag("n").over(P.Window.orderBy("date")).alias("listed_before"))
    return rows.join(F.broadcast(market), "date")


@query("""SELECT o_custkey AS symbol, arg_max(o_orderstatus, struct_pack(a := CAST(o_orderdate AS DATE), b := o_orderkey)) AS status,
  max(CAST(o_orderdate AS DATE)) AS date FROM orders GROUP BY 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.read(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return normalise.latest_per_key(rows, ["symbol"], [F.col("date"), F.col("k")]).select("symbol", "status", "date")


@query("""SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey AS symbol, bool_or(l_discount >= 0.1) AS is_limit_up,
  bool_or(l_discount <= 0) AS is_limit_down FROM lineitem GROUP BY 1, 2""")
def limit_flag_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.read(spark, d, "lineitem").select(adapter.week("l_shipdate").alias("date"), F.col("l_suppkey").alias("symbol"), (F.col("l_discount") >= 0.1).alias("is_limit_up"), (F.col("l_discount") <= 0).alias("is_limit_down"))
    return normalise.limit_flags(rows)


@query("""SELECT date FROM (SELECT CAST(l_shipdate AS DATE) AS date, bool_or(l_returnflag = 'A') AS a, bool_or(l_linestatus = 'F') AS f
  FROM lineitem GROUP BY 1) WHERE a AND f""")
def open_session_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Days on which both calendars say open."""
    rows = adapter.read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_returnflag", "l_linestatus")
    calendar = rows.select("date", F.lit("SSE").alias("exchange"), (F.col("l_returnflag") == "A").alias("is_open")).union(rows.select("date", F.lit("SZSE"), F.col("l_linestatus") == "F"))
    return normalise.open_sessions(calendar, ["SSE", "SZSE"])


# a customer's orders stand for a run: their number, spread and dates give its figures
RUNS = """WITH o AS (
  SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, max(CAST(o_totalprice AS DECIMAL(18,2))) AS top, min(CAST(o_totalprice AS DECIMAL(18,2))) AS low,
    max(CAST(o_orderdate AS DATE)) AS last, count(DISTINCT year(o_orderdate)) AS years, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS partly,
    count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS slow, count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS vague
  FROM orders GROUP BY o_custkey),
r AS (SELECT *, CAST(top AS DOUBLE) / CAST(total AS DOUBLE) AS weight, CAST(low AS DOUBLE) / CAST(top AS DOUBLE) AS evenness FROM customer LEFT JOIN o ON o_custkey = c_custkey),
runs AS (
  SELECT c_custkey AS run_id, c_mktsegment AS segment,
    CASE WHEN n IS NULL THEN 'sample' WHEN weight > 0.4 THEN 'other'
      ELSE 'historical_asset:x' || CASE WHEN n >= 4 THEN '+pit_liquidity_universe' ELSE '' END || CASE WHEN c_acctbal > 500 THEN '+pit_stock_master_filter' ELSE '' END END AS source,
    CASE WHEN slow >= 6 THEN 'empty' ELSE 'ok' END AS status, DATE '2001-08-05' - last AS age_days, n AS aligned_days, c_acctbal > 0 AS production_ready,
    0.6::DOUBLE + done / n::DOUBLE AS walk_positive, years / 1.0::DOUBLE AS walk_windows, CASE WHEN partly > 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS walk_failed,
    urgent / 1.0::DOUBLE AS supportive, CASE WHEN slow > 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS adverse,
    CASE WHEN vague >= 4 THEN 'bad' WHEN vague >= 2 THEN 'warn' ELSE 'ok' END AS bias_status, 100 * (1 - weight) AS bias_score,
    CASE WHEN vague >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bias_failed, -weight AS max_drawdown, n * 15.0::DOUBLE AS trade_count,
    CASE WHEN evenness < 0.02 THEN 'abandon' ELSE 'keep' END AS verdict, evenness - 0.05 AS annualized, evenness * 4 - 0.2 AS information_ratio,
    evenness * 3 AS sharpe, urgent / 2.0::DOUBLE AS best_t, weight AS top_weight, years * 1.5::DOUBLE AS data_points FROM r)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """A row for each customer, whose orders stand for a run: (run_id, segment, source and the figures that gates and scores ask for)."""
    price, one = F.col("o_totalprice").cast("decimal(18,2)"), lambda c, v: F.count_if(F.col(c) == v)
    own = adapter.read(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(price).cast("double").alias("total"), F.max(price).cast("double").alias("top"), F.min(price).cast("double").alias("low"),
        F.max(F.col("o_orderdate").cast("date")).alias("last"), F.count_distinct(F.year("o_orderdate")).alias("years"),
        one("o_orderstatus", "F").alias("done"), one("o_orderstatus", "P").alias("partly"), one("o_orderpriority", "1-URGENT").alias("urgent"),
        one("o_orderpriority", "5-LOW").alias("slow"), one("o_orderpriority", "4-NOT SPECIFIED").alias("vague"),
    )
    r = adapter.read(spark, d, "customer").join(own, F.col("o_custkey") == F.col("c_custkey"), "left")
    r = r.withColumns({"weight": F.col("top") / F.col("total"), "evenness": F.col("low") / F.col("top")})
    n, weight, evenness, flag = F.col("n"), F.col("weight"), F.col("evenness"), lambda x: F.when(x, 1.0).otherwise(0.0)
    asset = F.concat(F.lit("historical_asset:x"), F.when(n >= 4, "+pit_liquidity_universe").otherwise(""), F.when(F.col("c_acctbal") > 500, "+pit_stock_master_filter").otherwise(""))
    figures = {
        "run_id": F.col("c_custkey"), "segment": F.col("c_mktsegment"), "source": F.when(n.isNull(), "sample").when(weight > 0.4, "other").otherwise(asset),
        "status": F.when(F.col("slow") >= 6, "empty").otherwise("ok"), "age_days": F.datediff(F.lit("2001-08-05").cast("date"), "last"), "aligned_days": n, "production_ready": F.col("c_acctbal") > 0,
        "walk_positive": 0.6 + F.col("done") / n, "walk_windows": F.col("years") / 1.0, "walk_failed": flag(F.col("partly") > 4), "supportive": F.col("urgent") / 1.0, "adverse": flag(F.col("slow") > 3),
        "bias_status": F.when(F.col("vague") >= 4, "bad").when(F.col("vague") >= 2, "warn").otherwise("ok"), "bias_score": 100 * (1 - weight), "bias_failed": flag(F.col("vague") >= 5),
        "max_drawdown": -weight, "trade_count": n * 15.0, "verdict": F.when(evenness < 0.02, "abandon").otherwise("keep"), "annualized": evenness - 0.05, "information_ratio": evenness * 4 - 0.2,
        "sharpe": evenness * 3, "best_t": F.col("urgent") / 2.0, "top_weight": weight, "data_points": F.col("years") * 1.5,
    }
    return r.select(*(v.alias(c) for c, v in figures.items()))


FRESH = RUNS + """, fresh AS (SELECT *, CASE WHEN source = 'sample' THEN 'sample_only' WHEN source = 'other' THEN 'unknown_source'
  WHEN status = 'empty' THEN 'bad_data' WHEN age_days IS NULL THEN 'unknown_freshness' WHEN age_days > 365 THEN 'stale'
  WHEN aligned_days < 3 THEN 'benchmark_missing' ELSE 'fresh' END AS fresh_verdict
  FROM runs)"""


@query(FRESH + " SELECT run_id, fresh_verdict AS verdict, fresh_verdict = 'fresh' AS ok FROM fresh")
def freshness_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return coverage.freshness(_runs(spark, d), 365, 3).select("run_id", "verdict", "ok")


@query(FRESH + """, g AS (SELECT segment, arg_max(fresh_verdict, run_id) FILTER (prefix(source, 'historical')) AS verdict, count(*) FILTER (status = 'empty' AND segment <> 'BUILDING') AS failed_jobs,
  count(*) FILTER (aligned_days = 3 AND segment = 'MACHINERY') AS running_jobs
  FROM fresh GROUP BY segment) SELECT segment, failed_jobs, running_jobs, CASE WHEN verdict IS NULL THEN 'no_real_data'
  WHEN failed_jobs > 0 THEN 'job_failures' WHEN verdict = 'stale' THEN 'stale_data' WHEN verdict <> 'fresh' OR running_jobs > 0
  THEN 'degraded' ELSE 'ok' END AS state FROM g""")
def health_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of each segment's jobs and of its latest real run."""
    rows = coverage.freshness(_runs(spark, d), 365, 3)
    real = F.when(F.col("source").startswith("historical"), F.col("run_id"))
    failed = (F.col("status") == "empty") & (F.col("segment") != "BUILDING")
    running = (F.col("aligned_days") == 3) & (F.col("segment") == "MACHINERY")
    per = rows.groupBy("segment").agg(F.max_by("verdict", real).alias("verdict"), F.count_if(failed).alias("failed_jobs"), F.count_if(running).alias("running_jobs"))
    return coverage.health(per).select("segment", "failed_jobs", "running_jobs", "state")


# figures of customers without orders are missing, which counts as 0
_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("aligned_days", "walk_positive", "walk_windows", "walk_failed", "supportive", "adverse", "bias_score", "bias_failed", "max_drawdown", "trade_count", "annualized", "information_ratio", "sharpe", "best_t", "top_weight", "data_points"))
GATE = RUNS + f""", filled AS (SELECT * REPLACE ({_FILLED}) FROM runs),
gate AS (
  SELECT *, (prefix(source, 'historical'))::INT + contains(source, 'pit_liquidity_universe')::INT + contains(source, 'pit_stock_master_filter')::INT
    + production_ready::INT + (aligned_days > 0)::INT + (walk_positive >= 0.75 AND walk_failed = 0)::INT + (supportive >= 1 AND adverse = 0)::INT
    + (bias_status IN ('ok', 'warn') AND bias_score >= 70 AND bias_failed = 0)::INT + (max_drawdown >= -0.25)::INT + (trade_count >= 100)::INT
    + (verdict <> 'abandon')::INT AS passed
  FROM filled)"""


@query(GATE + " SELECT run_id, passed, 11 - passed AS failed, CASE WHEN passed = 11 THEN 'paper_candidate' ELSE 'research_only' END AS gate FROM gate")
def decision_gates(spark: SparkSession, d: str) -> DataFrame:
    return coverage.decision_gate(_runs(spark, d)).select("run_id", "passed", "failed", "gate")


_U = "least(greatest({}, 0.0), 1.0)".format
SCORE = GATE + f""", parts AS (SELECT *, {_U('coalesce(annualized, 0) / 0.30::DOUBLE')} * 12 + {_U('(0.30::DOUBLE + max_drawdown) / 0.25::DOUBLE')} * 12 +
  CASE WHEN information_ratio <> 0 THEN {_U('information_ratio / 1.5::DOUBLE')} * 14 ELSE {_U('sharpe / 1.5::DOUBLE')} * 8 END
 + CASE WHEN walk_windows > 0 THEN least(greatest({_U('walk_positive')} * 15 - least(walk_failed, walk_windows) / walk_windows * 6,
  0), 15) ELSE 0 END + least(greatest({_U('supportive / 2')} * 9 + {_U('best_t / 2')} * 4 - least(adverse, 3) * 2,
  0), 15) + {_U('trade_count / 200')} * 10
 + CASE WHEN top_weight > 0 THEN {_U('(0.45::DOUBLE - top_weight) / 0.30::DOUBLE')} * 8 ELSE 4 END + least(greatest(data_points,
  0), 10) + passed / 11.0::DOUBLE * 6 + CASE WHEN bias_failed > 0 THEN least({_U('bias_score / 100')} * 6, 2) ELSE {_U('bias_score / 100')} * 6 END AS points
  FROM gate),
total AS (SELECT *, CASE WHEN verdict = 'abandon' THEN least(points, 45) WHEN passed < 11 THEN least(points, 80)
  ELSE least(points, 100) END AS total FROM parts), scored AS (SELECT run_id, segment, floor(total * 100 + 0.5) / 100 AS score,
  CASE WHEN total >= 75 THEN 'strong_watch' WHEN total >= 60 THEN 'watch' WHEN total >= 45 THEN 'weak_watch' ELSE 'reject' END AS band
  FROM total)"""


def _scored_runs(spark: SparkSession, d: str) -> DataFrame:
    return coverage.research_score(coverage.decision_gate(_runs(spark, d)))


@query(SCORE + " SELECT run_id, score, band FROM scored")
def research_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored_runs(spark, d).select("run_id", "score", "band")


@query(SCORE + " SELECT segment, run_id, score, row_number() OVER (PARTITION BY segment ORDER BY score DESC, run_id) AS place FROM scored")
def run_board(spark: SparkSession, d: str) -> DataFrame:
    return coverage.board(_scored_runs(spark, d), "segment").select("segment", "run_id", "score", "place")


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.read(spark, d, "orders")
    return rows.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query(PANEL + f""" SELECT symbol, date_trunc('year', date)::DATE AS year, {_even('arg_max(close, date) / arg_min(close, date) - 1')} AS yearly_return
  FROM panel GROUP BY 1, 2""")
def yearly_returns(spark: SparkSession, d: str) -> DataFrame:
    """Last over first close of each year."""
    rows = adapter.daily_panel(spark, d).groupBy("symbol", F.trunc("date", "year").alias("year")).agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("yearly_return"))
    return even(rows)


@query(PANEL + f""", x AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS top
  FROM panel) SELECT date, symbol, {even_sql(('top',))}, {_even('close / top - 1')} AS drawdown
  FROM x""")
def running_drawdown(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d).select("date", "symbol", "close")
    top = F.max("close").over(P.series().rowsBetween(P.Window.unboundedPreceding, 0))
    return even(rows.select("date", "symbol", top.alias("top"), (F.col("close") / top - 1).alias("drawdown")))
