"""Queries of raw archives: typed assets, snapshot support, column profiles, rules over several tables, runs and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import profile, runs
from tidemark.plans.registry import PANEL, query
from tidemark.plans.study_queries import _unsigned, _unsigned_sql
from tidemark.sources import adapter, assets, scratch

# raw tables as an archive might hold them: texts, other names, odd dates and numbers, repeated rows
_CODE = "lpad(CAST(o_custkey % 900000 AS VARCHAR), 6, '0') || CASE WHEN o_custkey % 2 = 0 THEN '.SH' ELSE '.SZ' END"
_DAY = "CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN o_orderkey % 97 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END"
END = "1999-12-31"


def _code() -> Column:
    return F.concat(F.lpad((F.col("o_custkey") % 900000).cast("string"), 6, "0"), F.when(F.col("o_custkey") % 2 == 0, ".SH").otherwise(".SZ"))


def _day() -> Column:
    odd = F.when(F.col("o_orderkey") % 11 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 97 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
    return odd.otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return adapter.read(spark, d, "orders")


_KNOWN_DAY = f"o_orderkey % 97 <> 0 OR o_orderkey % 11 = 0) AND CAST(o_orderdate AS DATE) <= DATE '{END}'"


@query(f"""SELECT {_CODE} AS symbol, CAST(o_orderdate AS DATE) AS ex_date, o_totalprice AS cash, CAST(o_orderdate AS DATE) - 30 AS announced
FROM orders WHERE ({_KNOWN_DAY} AND o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0""")
def dividend_asset(spark: SparkSession, d: str) -> DataFrame:
    """Dividend events of a raw table: two spellings of dates, amounts that aren't numbers or not above 0."""
    cash = F.when(F.col("o_orderkey") % 13 == 0, "n/a").when(F.col("o_orderkey") % 5 == 0, "0.0").otherwise(F.col("o_totalprice").cast("string"))
    raw = _orders(spark, d).select(_code().alias("stockCode"), _day().alias("exDate"), cash.alias("cashDividendPerShare"), F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd").alias("latestAnnounceDate"))
    return assets.conform(raw, assets.DIVIDENDS, END).select("symbol", "ex_date", "cash", "announced")


@query(f"""WITH raw AS (
  SELECT {_CODE} AS symbol, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) END AS published,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS roe FROM orders
  WHERE ({_KNOWN_DAY}),
filled AS (SELECT *, coalesce(published, date) AS p FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY p DESC, roe DESC NULLS LAST) AS place
  FROM filled)
SELECT date, symbol, p AS published, roe FROM placed WHERE place = 1""")
def fundamental_asset(spark: SparkSession, d: str) -> DataFrame:
    """Fundamental factors: a missing publication date is the row's date, of a symbol's rows of a date the last published stays."""
    published = F.when(F.col("o_orderkey") % 3 != 0, F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60).cast("int")), "yyyy-MM-dd"))
    roe = F.when(F.col("o_orderkey") % 17 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string"))
    raw = _orders(spark, d).select(_code().alias("stockCode"), _day().alias("date"), published.alias("publishDate"), roe.alias("roe"))
    return assets.conform(raw, assets.FUNDAMENTAL_FACTORS, END).select("date", "symbol", "published", "roe")


@query(f"""WITH raw AS (SELECT {_CODE} AS symbol, CAST(o_orderdate AS DATE) AS date, 'notice ' || (o_orderkey % 4) AS title,
  CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE ({_KNOWN_DAY} AND o_orderkey % 19 <> 0)
SELECT symbol, date, title, max(id) AS id FROM raw GROUP BY 1, 2, 3""")
def announcement_asset(spark: SparkSession, d: str) -> DataFrame:
    """Announcements under other column names, blank titles left out; the last id of a repeated title stays."""
    title = F.when(F.col("o_orderkey") % 19 == 0, "  ").otherwise(F.concat(F.lit("notice "), (F.col("o_orderkey") % 4).cast("string")))
    raw = _orders(spark, d).select(_code().alias("stockCode"), _day().alias("announcementDate"), title.alias("announcementTitle"), F.col("o_orderkey").cast("string").alias("announcementId"))
    return assets.conform(raw, assets.ANNOUNCEMENTS, END).select("symbol", "date", "title", "id")


@query("""WITH raw AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, 'I' || (l_suppkey % 5) AS code, l_suppkey AS s
  FROM lineitem),
kept AS (SELECT DISTINCT CASE WHEN code = 'I3' THEN DATE '2001-10-01' ELSE date END AS date, code, s
  FROM raw)
SELECT code AS index_code, count(DISTINCT date) AS snapshots, count(*) AS rows, code IN ('I2', 'I3') AS all_latest,
  NOT (code IN ('I2', 'I3') AND count(DISTINCT date) <= 1) AS usable_history FROM kept
  GROUP BY code""")
def index_snapshot_support(spark: SparkSession, d: str) -> DataFrame:
    """Which indices' constituents have a history: one has a single latest-only snapshot."""
    rows = adapter.read(spark, d, "lineitem")
    code = F.concat(F.lit("I"), (F.col("l_suppkey") % 5).cast("string"))
    day = F.when(code == "I3", F.lit("2001-10-01")).otherwise(F.date_format(F.trunc("l_shipdate", "month"), "yyyy-MM-dd"))
    raw = rows.select(day.alias("date"), code.alias("indexCode"), F.concat(F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.lit(".SH")).alias("symbol"), F.lit("1.0").alias("weight"), code.isin("I2", "I3").cast("string").alias("isLatestOnly"))
    return assets.snapshot_support(assets.conform(raw, assets.INDEX, "2030-01-01"), ["index_code"])


@query(f"""WITH raw AS (SELECT {_DAY} AS day, o_orderkey, o_orderdate FROM orders),
ok AS (SELECT *, CASE WHEN o_orderkey % 97 <> 0 OR o_orderkey % 11 = 0 THEN CAST(o_orderdate AS DATE) END AS date
  FROM raw)
SELECT 'dividend_events' AS asset, true AS present, true AS required, count(*) AS n_rows, count(*) FILTER (date IS NOT NULL
  AND o_orderkey % 13 <> 0) AS usable, min(date) AS first, max(date) AS last, '' AS lacking, 'note' AS unknown
  FROM ok
UNION ALL SELECT 'margin_trades', true, false, count(*), 0, NULL, NULL, 'date', 'when'
  FROM orders
UNION ALL SELECT unnest(['fundamental_factors', 'daily_fund_flows', 'abnormal_list', 'announcements', 'industry',
  'index_constituents']), false, false, NULL, NULL, NULL, NULL, '', ''""")
def asset_inventory(spark: SparkSession, d: str) -> DataFrame:
    """What an archive holds: present tables, their rows, dates, lacking and unknown columns."""
    root, orders = scratch.new_path(spark, "archive"), _orders(spark, d)
    cash = F.when(F.col("o_orderkey") % 13 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    orders.select(_code().alias("stockCode"), _day().alias("exDate"), cash.alias("cashDividendPerShare"), F.lit("x").alias("note")).write.option("header", True).csv(f"{root}/dividend_events")
    orders.select(_code().alias("symbol"), _day().alias("when")).write.option("header", True).csv(f"{root}/margin_trades")
    return assets.inventory(spark, root, required=("dividend_events",))


_PROFILED = {"l_orderkey": "bigint", "l_suppkey": "bigint", "l_quantity": "double", "l_extendedprice": "double", "l_returnflag": "string", "l_shipdate": "timestamp"}
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count(v) AS missing, count(DISTINCT v) AS distinct_values, true AS distinct_in_bound, {'true' if c != 'l_returnflag' and c != 'l_shipdate' else 'CAST(NULL AS BOOLEAN)'} AS median_in_bound "
    f"FROM (SELECT CASE WHEN l_orderkey % 7 = 3 THEN NULL ELSE {c} END AS v FROM lineitem)" for c in _PROFILED
)


@query(_PROFILE_SQL)
def column_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles merged from one for each return flag, and whether their estimates are within bounds of exact figures."""
    df = adapter.read(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    rows = df.select(flag.alias("part"), *(F.when(F.col("l_orderkey") % 7 != 3, F.col(c)).alias(c) for c in _PROFILED))
    rows = scratch.materialize(rows, "profiled")
    got = profile.profile(profile.merged(profile.sketches(rows, ["part"])))
    numbers = [c for c in _PROFILED if c not in ("l_returnflag", "l_shipdate")]
    exact = rows.agg(*(F.count_distinct(c).alias(f"d_{c}") for c in _PROFILED))
    exact = exact.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("distinct_values")) for c in _PROFILED))).alias("x")).select("x.*")
    # where the estimated median stands among the values: the share below it and the share up to it hold one half between them
    medians = F.broadcast(got.groupBy().pivot("column", numbers).agg(F.first("q50")).select(*(F.col(c).alias(f"m_{c}") for c in numbers)))
    share = lambda c, test: F.count_if(test) / F.greatest(F.count(c), F.lit(1))
    stood = rows.crossJoin(medians).agg(*(x for c in numbers for x in (share(c, F.col(c) < F.col(f"m_{c}")).alias(f"a_{c}"), share(c, F.col(c) <= F.col(f"m_{c}")).alias(f"b_{c}"))))
    inside = lambda c: (F.col(f"a_{c}") <= 0.5 + profile.RANK_BOUND) & (F.col(f"b_{c}") >= 0.5 - profile.RANK_BOUND)
    stood = stood.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), inside(c).alias("median_in_bound")) for c in numbers))).alias("x")).select("x.*")
    near = F.abs(F.col("distinct") - F.col("distinct_values")) <= profile.DISTINCT_BOUND * F.col("distinct_values")
    return got.join(exact, "column").join(stood, "column", "left").select("column", "n_rows", "missing", "distinct_values", near.alias("distinct_in_bound"), "median_in_bound")


RULES = [
    profile.Check("positive_price", "orders", "o_totalprice > 0 AND o_custkey % 41 <> 0"),
    profile.Check("known_day", "orders", "o_orderdate IS NOT NULL"),
    profile.Check("shipped_after_start", "lineitem", "l_shipdate >= DATE '1995-02-01'"),
    profile.Check("discount_range", "lineitem", "l_discount BETWEEN 0 AND 1"),
    profile.Unique("order_key", "orders", ("o_orderkey",)),
    profile.Unique("customer_day", "orders", ("o_custkey", "o_orderdate")),
    profile.References("line_has_order", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    profile.References("order_has_rich_customer", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    profile.References("line_has_part", "lineitem", ("l_partkey",), "part", ("p_partkey",)),
    profile.AtLeast("enough_suppliers", "supplier", "count(DISTINCT s_suppkey)", 5),
    profile.AtLeast("enough_customers", "customer", "count(*)", 1e9),
]
_KEYS = {"orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "customer": ("c_custkey",), "part": ("p_partkey",), "supplier": ("s_suppkey",)}
_FAULTS = """WITH rich AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0), faults(rule, "table", key) AS (
  SELECT 'positive_price', 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT coalesce(o_totalprice > 0
  AND o_custkey % 41 <> 0, false)
  UNION ALL SELECT 'known_day', 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderdate IS NULL
  UNION ALL SELECT 'shipped_after_start', 'lineitem', l_orderkey || '|' || l_linenumber
  FROM lineitem WHERE NOT coalesce(l_shipdate >= DATE '1995-02-01', false)
  UNION ALL SELECT 'discount_range', 'lineitem', l_orderkey || '|' || l_linenumber
  FROM lineitem WHERE NOT coalesce(l_discount BETWEEN 0 AND 1, false)
  UNION ALL SELECT 'line_has_order', 'lineitem', CAST(l_orderkey AS VARCHAR) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'order_has_rich_customer', 'orders', CAST(o_custkey AS VARCHAR)
  FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM rich)
  UNION ALL SELECT 'line_has_part', 'lineitem', CAST(l_partkey AS VARCHAR) FROM lineitem
  WHERE l_partkey NOT IN (SELECT p_partkey FROM part)),
counted AS (SELECT rule, count(*) AS violations, min(key) AS sample FROM faults GROUP BY rule),
again AS (
  SELECT 'order_key' AS rule, coalesce(sum(n - 1), 0)::BIGINT AS violations FROM (SELECT count(*) AS n
  FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
  UNION ALL SELECT 'customer_day', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n
  FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)
  UNION ALL SELECT 'enough_suppliers', (count(DISTINCT s_suppkey) < 5)::BIGINT FROM supplier
  UNION ALL SELECT 'enough_customers', (count(*) < 1e9)::BIGINT FROM customer),
rules(rule, "table") AS (VALUES """ + ", ".join(f"('{r.name}', '{r.table}')" for r in RULES) + """),
found AS (SELECT r.rule, r."table", coalesce(c.violations, a.violations, 0) AS violations, c.sample
  FROM rules r LEFT JOIN counted c USING (rule) LEFT JOIN again a USING (rule))"""  # fmt: skip


def _bundle(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: adapter.read(spark, d, t) for t in _KEYS}
    tables["customer"] = tables["customer"].filter("c_acctbal > 0")
    return profile.validate(tables, RULES, _KEYS)


@query(_FAULTS + " SELECT rule, \"table\", violations, CASE WHEN rule IN ('positive_price', 'known_day', 'shipped_after_start', 'discount_range') THEN sample END AS sample FROM found WHERE rule <> 'enough_customers'")
def bundle_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules over five tables: conditions, keys, references and least sizes."""
    found = _bundle(spark, d).filter("rule <> 'enough_customers'")
    return found.withColumn("sample", F.when(F.col("rule").isin("positive_price", "known_day", "shipped_after_start", "discount_range"), F.col("sample")))


@query(_FAULTS + """ SELECT count(*) AS rules, count(*) FILTER (violations > 0) AS broken, count(*) FILTER (violations > 0 AND rule IN ('order_key',
  'line_has_order')) AS hard_failed,
  CASE WHEN count(*) FILTER (violations > 0 AND rule IN ('order_key', 'line_has_order')) > 0 THEN 'invalid' WHEN
  count(*) FILTER (violations > 0) > 0 THEN 'research_only' ELSE 'production_ready' END AS level
  FROM found""")
def bundle_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The bundle's level: invalid if a hard rule is broken, for research only if another is."""
    return profile.verdict(_bundle(spark, d), ["order_key", "line_has_order"])


_RUN_FIELDS = {"total_return": ("double", ("$.results.metrics.total_return", "$.metrics.ret")), "trades": ("bigint", ("$.results.trades", "$.trade_count")), "status": ("string", ("$.status",)), "first_tag": ("string", ("$.tags[0]",))}


@query("""WITH last AS (SELECT o_custkey, max(o_orderkey) AS k, count(*) AS versions FROM orders
  GROUP BY o_custkey)
SELECT CAST(l.o_custkey AS VARCHAR) AS run_id, versions, k % 29 <> 0 AS readable, CASE WHEN k % 29 <> 0 THEN round(o_totalprice,
  2) END AS total_return,
  CASE WHEN k % 29 <> 0 AND NOT (k % 2 = 0 AND k % 5 = 0) THEN k % 100 END AS trades, CASE WHEN k % 29 <> 0 THEN o_orderstatus END AS status,
  CASE WHEN k % 29 <> 0 AND k % 2 = 1 THEN o_orderpriority END AS first_tag
FROM last l JOIN orders o ON o.o_orderkey = l.k""")
def run_registry(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose records have two versions, appended to a registry and flattened by one set of rules."""
    k = F.col("o_orderkey")
    first = F.to_json(F.struct(F.struct(F.round("o_totalprice", 2).alias("ret")).alias("metrics"), F.when(k % 5 != 0, k % 100).alias("trade_count"), F.col("o_orderstatus").alias("status")))
    second = F.to_json(F.struct(F.struct(F.struct(F.round("o_totalprice", 2).alias("total_return")).alias("metrics"), (k % 100).alias("trades")).alias("results"), F.col("o_orderstatus").alias("status"), F.array("o_orderpriority").alias("tags")))
    text = F.when(k % 29 == 0, "{broken").when(k % 2 == 0, first).otherwise(second)
    raw = _orders(spark, d).select(F.col("o_custkey").cast("string").alias("run_id"), k.alias("created"), text.alias("record"))
    path = scratch.new_path(spark, "runs")
    rows = runs.parsed(raw)
    runs.append(spark, rows.filter("created % 2 = 0"), path)
    runs.append(spark, rows.filter("created % 2 <> 0"), path)
    return runs.flatten(runs.latest(spark.read.parquet(path)), _RUN_FIELDS).select("run_id", "versions", "readable", *_RUN_FIELDS)


# amounts come in units of a hundred from symbols of one source in one year, and of a thousand from another's
_SOURCES = "CAST(symbol % 3 AS INTEGER)"
_PLANTED = "amount * CASE WHEN symbol % 3 = 1 AND date >= DATE '1997-01-01' AND date < DATE '1998-01-01' THEN 100.0 WHEN symbol % 3 = 2 AND date >= DATE '1999-06-01' THEN 1000.0 ELSE 1.0 END"
_UNITS = ", ".join(f"({u!r}::DOUBLE)" for u in runs.UNITS)
_UNIT_SQL = PANEL + f""", q AS (SELECT {_SOURCES} AS source, CAST(date_trunc('month', date) AS DATE) AS month, log10({_PLANTED} / (volume * close)) AS x
  FROM panel),
m AS (SELECT source, month, count(x) AS n, median(x) AS l FROM q GROUP BY 1, 2), u(unit) AS (VALUES {_UNITS}),
units AS (SELECT source, month, any_value(n) AS n, any_value(l) AS l, arg_min(unit, abs(l - log10(unit))) AS unit,
  min(abs(l - log10(unit))) <= 0.25 AS verified FROM m, u GROUP BY source, month)"""


def _units(spark: SparkSession, d: str) -> DataFrame:
    panel = adapter.daily_panel(spark, d)
    year, late = F.year("date") == 1997, F.col("date") >= F.lit("1999-06-01").cast("date")
    factor = F.when((F.col("symbol") % 3 == 1) & year, 100.0).when((F.col("symbol") % 3 == 2) & late, 1000.0).otherwise(1.0)
    rows = panel.select((F.col("symbol") % 3).cast("int").alias("source"), F.trunc("date", "month").alias("month"), (F.col("amount") * factor).alias("amount"), "volume", "close")
    return runs.amount_units(rows, ["source", "month"])


@query(_UNIT_SQL + f" SELECT source, month, n, {_unsigned_sql('l', 4)} AS scale, unit, verified FROM units")
def amount_units(spark: SparkSession, d: str) -> DataFrame:
    """In what unit each source's amounts are, month by month (scale as a power of ten)."""
    return _units(spark, d).withColumn("scale", _unsigned(F.log10("scale"), 4))


@query(_UNIT_SQL + """, moved AS (SELECT source, lag(month) OVER w AS "from", month AS "to", lag(unit) OVER w AS unit_before, unit AS unit_after
  FROM units WINDOW w AS (PARTITION BY source ORDER BY month))
SELECT * FROM moved WHERE unit_before <> unit_after""")
def amount_unit_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Where a source's unit changes."""
    return runs.unit_breaks(_units(spark, d), "source", "month")
