"""Queries of the registered study: features between exact sessions, variants, cells, exposure, timing and inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import coverage, joins, lattice, study
from tidemark.plans.registry import FUNDAMENTALS, IC, NW, _even, _ics, _rank_sql, even, even_sql, query
from tidemark.sources import adapter, scratch

MOMENTUM, WIDTH, HORIZON, MINIMUM = 12, 8, 4, 40_000.0

PREPARED = FUNDAMENTALS + f""", cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session FROM (SELECT DISTINCT date
  FROM panel)),
s AS (SELECT p.date, p.symbol, p.close, p.amount, p.n_rows, p.n_r, c.session FROM panel p
  JOIN cal c USING (date)),
r AS (SELECT *, CASE WHEN session - lag(session) OVER w = 1 THEN close / lag(close) OVER w - 1 END AS return_1
  FROM s WINDOW w AS (PARTITION BY symbol ORDER BY session)),
g AS (SELECT *, CASE WHEN session - lag(session, {MOMENTUM}) OVER w = {MOMENTUM} THEN close / lag(close, {MOMENTUM}) OVER w - 1 END AS momentum,
  CASE WHEN session - lag(session, {WIDTH}) OVER w = {WIDTH} AND count(return_1) OVER k = {WIDTH} THEN -stddev_samp(return_1) OVER k END AS low_vol,
  CASE WHEN session - lag(session, {WIDTH - 1}) OVER w = {WIDTH - 1} AND count(amount) OVER k = {WIDTH} THEN avg(amount) OVER k END AS mean_amount
  FROM r WINDOW w AS (PARTITION BY symbol ORDER BY session), k AS (PARTITION BY symbol ORDER BY session ROWS {WIDTH - 1} PRECEDING)),
prepared AS (SELECT g.date, g.symbol, g.close, g.amount, g.n_rows, g.n_r, g.session, g.return_1, {_even('g.momentum')} AS momentum,
  {_even('g.low_vol')} AS low_vol, {_even('g.mean_amount')} AS mean_amount,
  {_even('h.close / g.close - 1')} AS future_same, CASE WHEN h.close IS NULL THEN 'MISSING_EXACT_FORWARD_EXIT' END AS future_same_reason,
  {_even('z.close / a.close - 1')} AS future_lagged, CASE WHEN a.close IS NULL THEN 'MISSING_EXACT_LAG_ENTRY' WHEN z.close IS NULL
  THEN 'MISSING_EXACT_LAG_EXIT' END AS future_lagged_reason
  FROM g LEFT JOIN s h ON h.symbol = g.symbol AND h.session = g.session + {HORIZON}
  LEFT JOIN s a ON a.symbol = g.symbol AND a.session = g.session + 1 LEFT JOIN s z ON z.symbol = g.symbol AND z.session = g.session + {HORIZON + 1})"""
_FEATURES = ("momentum", "low_vol", "mean_amount", "future_same", "future_lagged")


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d).select("date", "symbol", "close", "amount", "n_rows", "n_r")
    sessions = joins.sessions(adapter.calendar(spark, d))
    month = F.trunc("date", "month")
    sessions = sessions.withColumn("opens_month", ~month.eqNullSafe(F.lag(month).over(Window.orderBy("date"))))
    out = lattice.prepare(rows, sessions, MOMENTUM, WIDTH, HORIZON, adapter.lines(spark, d))
    # to millionths before anything is ranked or compared, so that engines agree
    return out.withColumns({c: adapter.micro(F.col(c)) for c in _FEATURES})


@query(PREPARED + " SELECT date, symbol, momentum, low_vol, mean_amount, future_same, future_same_reason, future_lagged, future_lagged_reason FROM prepared")
def session_guarded_features(spark: SparkSession, d: str) -> DataFrame:
    return _prepared(spark, d).select("date", "symbol", "momentum", "low_vol", "mean_amount", "future_same", "future_same_reason", "future_lagged", "future_lagged_reason")


# the stage's rule: of what is available (published before the date), the latest period of at most 18 months
LATEST = """SELECT {name}.period, {name}.published, {name}.value FROM facts {name}
  WHERE {name}.symbol = p.symbol AND {known} AND {name}.period >= p.date - INTERVAL 18 MONTH
  ORDER BY {name}.period DESC, {name}.published DESC LIMIT 1"""
# the early study's rule: the latest to become available by the date itself, whatever its period's age
LATEST_AVAILABLE = """SELECT {name}.period, {name}.published, {name}.value FROM facts {name}
  WHERE {name}.symbol = p.symbol AND {name}.{available} <= p.date
  ORDER BY {name}.{available} DESC, {name}.period DESC LIMIT 1"""


def _candidates_sql(report: str, publication: str) -> str:
    return PREPARED + f""", months AS (SELECT min(date) AS date FROM cal GROUP BY date_trunc('month', date)),
master AS (
  SELECT symbol, a + 28 AS list_date, CASE WHEN symbol % 7 = 0 THEN a + CAST(floor((b - a) * 2 / 3) AS INTEGER) END AS delist_date
  FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM panel GROUP BY symbol)),
cand AS (
  SELECT p.*, m.list_date <= p.date AND (m.delist_date IS NULL OR p.date <= m.delist_date) AS in_pit,
    m.list_date <= p.date AND (m.delist_date IS NULL OR m.delist_date > DATE '2001-06-01') AS in_final,
    m.delist_date IS NULL AS survives, p.n_r > 3 AS is_st, p.n_rows = 1 AS is_suspended,
    r.period AS period_report, r.published AS published_report, {_even('r.value / 1e5')} AS roe_report,
    u.period AS period_publication, {_even('u.value / 1e5')} AS roe_publication
  FROM prepared p JOIN months USING (date) JOIN master m USING (symbol)
  LEFT JOIN LATERAL ({report}) r ON true LEFT JOIN LATERAL ({publication}) u ON true)"""


CANDIDATES = _candidates_sql(LATEST.format(name="f1", known="f1.period <= p.date"), LATEST.format(name="f2", known="f2.published < p.date"))
LEGACY_CANDIDATES = _candidates_sql(LATEST_AVAILABLE.format(name="f1", available="period"), LATEST_AVAILABLE.format(name="f2", available="published"))
STAGE2_KNOWLEDGE = {
    "report": joins.Knowledge("period", ("period", "published"), stale_months=18),
    "publication": joins.Knowledge("published", ("period", "published"), strict=True, stale_months=18),
}
LEGACY_KNOWLEDGE = {
    "report": joins.Knowledge("period", ("period", "published")),
    "publication": joins.Knowledge("published", ("published", "period")),
}


def _candidates(spark: SparkSession, d: str, knowledge: dict[str, joins.Knowledge] = STAGE2_KNOWLEDGE) -> DataFrame:
    """The candidates of each month's first session, with lifecycle flags and the facts known by period end and by publication."""
    rows = _prepared(spark, d).filter("opens_month").drop("opens_month")
    listed, gone, day = F.col("list_date"), F.col("delist_date"), F.col("date")
    rows = rows.join(F.broadcast(adapter.stock_master(spark, d)), "symbol").withColumns({
        "in_pit": (listed <= day) & (gone.isNull() | (day <= gone)),
        "in_final": (listed <= day) & (gone.isNull() | (gone > F.lit("2001-06-01").cast("date"))),
        "survives": gone.isNull(), "is_st": F.col("n_r") > 3, "is_suspended": F.col("n_rows") == 1,
    })
    facts = adapter.fundamentals(spark, d).select("symbol", "period", "published", adapter.micro(F.col("value") / 1e5).alias("roe"))
    return joins.known_views(rows, facts, knowledge)


def _stage2(spark: SparkSession, d: str) -> tuple[DataFrame, int, DataFrame]:
    """Sections of the 18 variants, about how many rows they have, and the candidates, written once and counted."""
    rows = scratch.materialize(_candidates(spark, d), "candidates")
    size = rows.count()
    return lattice.stage2_cross_sections(rows, MINIMUM, size), size * len(STAGE2), rows


def _legacy_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = scratch.materialize(_candidates(spark, d, LEGACY_KNOWLEDGE), "candidates")
    size = rows.count()
    return lattice.cells(lattice.legacy_cross_sections(rows, MINIMUM, size), strict=False, size=size * len(LEGACY))


def _sections_sql(variants: list[tuple[str, str, str, str]]) -> str:
    parts = [f"""SELECT date, symbol, '{name}' AS variant, roe_{available} AS roe, momentum, low_vol, future_{kind} AS outcome, future_{kind}_reason AS reason,
  {str(kind == 'lagged').lower()} AS late FROM cand WHERE {where}""" for name, where, available, kind in variants]
    return ", sections AS (" + " UNION ALL ".join(parts) + ")"


_TESTS = {"exclude_st": "is_st = false", "exclude_suspended": "is_suspended = false", "minimum_amount": f"mean_amount >= {MINIMUM}"}
STAGE2 = [(v["variant"], " AND ".join(["in_final" if v["universe"] == "final" else "in_pit", *(t for c, t in _TESTS.items() if c in v["components"])]), v["available"], "lagged" if "one_session_lag" in v["components"] else "same") for v in lattice.variants()]
LEGACY = [("M0_naive", "survives", "report", "same"), ("M1_pit_universe", "in_pit", "report", "same"), ("M2_pit_publication", "in_pit", "publication", "same"), ("M3_audited_lag", f"in_pit AND NOT is_st AND NOT is_suspended AND mean_amount >= {MINIMUM}", "publication", "lagged")]
_BY = "date, variant, factor"


def _cells_sql(strict: bool) -> str:
    ok = "n >= 5 AND unresolved = 0" if strict else "n >= 5"
    return f""", ranked0 AS (SELECT *, round(0.5::DOUBLE * ({_rank_sql('roe', 'date, variant')}) + 0.3::DOUBLE * ({_rank_sql('momentum', 'date, variant')}) + 0.2::DOUBLE * ({_rank_sql('low_vol', 'date, variant')}),
  9) AS composite FROM sections),
long AS (SELECT date, variant, symbol, outcome, reason, late, u.factor, u.score FROM ranked0, LATERAL (VALUES ('roe',
  roe), ('momentum', momentum), ('low_vol', low_vol), ('composite', composite)) u(factor, score)),
whole AS (SELECT *, CASE WHEN outcome IS NOT NULL THEN score END AS sc, CASE WHEN score IS NOT NULL THEN outcome END AS oc
  FROM long),
ranked1 AS (SELECT *, {_rank_sql('sc', _BY)} AS x, {_rank_sql('oc', _BY)} AS y FROM whole),
cells0 AS (SELECT {_BY}, count(*) AS candidates, count(score) AS eligible, count(*) FILTER (score IS NOT NULL AND outcome IS NULL) AS unresolved,
  count(sc) AS n, CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END AS ic,
  sum(CAST(oc AS DECIMAL(28,12))) FILTER (x > 0.8)::DOUBLE / nullif(count(oc) FILTER (x > 0.8), 0) - sum(CAST(oc AS DECIMAL(28,12)))::DOUBLE / nullif(count(oc),
  0) AS spread FROM ranked1 GROUP BY {_BY}),
cells AS (SELECT {_BY}, candidates, eligible, unresolved, n, CASE WHEN {ok} THEN ic END AS ic, CASE WHEN {ok} THEN spread END AS spread
  FROM cells0)"""


def _unsigned(x: Column, digits: int) -> Column:
    """Rounded, and 0.0 where that is -0.0, as the sign of a rounded nothing isn't a result."""
    return F.when(F.round(x, digits) == 0, F.lit(0.0)).otherwise(F.round(x, digits))


def _unsigned_sql(x: str, digits: int) -> str:
    return f"CASE WHEN round({x}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({x}, {digits}) END"


_CELLS = f" SELECT {_BY}, candidates, eligible, unresolved, n, {_unsigned_sql('ic', 6)} AS ic, {_unsigned_sql('spread', 4)} AS spread FROM cells"


def _cell_rows(df: DataFrame) -> DataFrame:
    return df.withColumns({"ic": _unsigned(F.col("ic"), 6), "spread": _unsigned(F.col("spread"), 4)})


@query(LEGACY_CANDIDATES + _sections_sql(LEGACY) + _cells_sql(False) + _CELLS)
def legacy_variant_cells(spark: SparkSession, d: str) -> DataFrame:
    """M0 to M3: final survivors, point in time, publication dates, audited with a lag."""
    return _cell_rows(_legacy_cells(spark, d))


@query(CANDIDATES + _sections_sql(STAGE2) + _cells_sql(True) + _CELLS)
def stage2_variant_cells(spark: SparkSession, d: str) -> DataFrame:
    """The 18 variants times four factors, 72 cells a month."""
    sections, size, _ = _stage2(spark, d)
    return _cell_rows(lattice.cells(sections, size=size))


AGGREGATE = """, o AS (SELECT *, ic - avg(ic) OVER (PARTITION BY variant, factor) AS c FROM cells
  WHERE ic IS NOT NULL), g2 AS (SELECT *, c * lag(c, 1) OVER w AS g1, c * lag(c, 2) OVER w AS g2, c * lag(c, 3) OVER w AS g3
  FROM o WINDOW w AS (PARTITION BY variant, factor ORDER BY date)),
t AS (SELECT variant, factor, count(*) AS n_ic, avg(ic) AS mean_ic, sum(c * c) / count(*) + 2 * (0.75 * coalesce(sum(g1),
  0) + 0.5 * coalesce(sum(g2), 0) + 0.25 * coalesce(sum(g3), 0)) / count(*) AS v FROM g2
  GROUP BY 1, 2),
m AS (SELECT variant, factor, count(ic) AS observations, avg(spread) AS mean_spread, avg(n) AS mean_n
  FROM cells GROUP BY 1, 2)
SELECT m.variant, m.factor, m.observations, round(t.mean_ic, 5) AS mean_ic, round(CASE WHEN t.n_ic >= 3 AND t.v > 0
  THEN t.mean_ic / sqrt(t.v / t.n_ic) END, 4) AS t_stat, round(m.mean_spread, 5) AS mean_spread, round(m.mean_n,
  5) AS mean_n FROM m LEFT JOIN t USING (variant, factor)"""


@query(LEGACY_CANDIDATES + _sections_sql(LEGACY) + _cells_sql(False) + AGGREGATE)
def registered_cell_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Mean IC, its t statistic by the asked lag, mean spread and size of each variant and factor."""
    cells = scratch.materialize(_legacy_cells(spark, d), "cells")
    means = cells.groupBy("variant", "factor").agg(F.count("ic").alias("observations"), F.avg("spread").alias("mean_spread"), F.avg("n").alias("mean_n"))
    tested = study.newey_west(cells, ["variant", "factor"], "ic", "date", effective=False)
    out = means.join(tested.select("variant", "factor", F.col("mean").alias("mean_ic"), "t_stat"), ["variant", "factor"], "left")
    return out.select("variant", "factor", "observations", F.round("mean_ic", 5).alias("mean_ic"), F.round("t_stat", 4).alias("t_stat"), F.round("mean_spread", 5).alias("mean_spread"), F.round("mean_n", 5).alias("mean_n"))


ENDPOINTS = """ SELECT date, variant, factor,
  CASE WHEN outcome IS NOT NULL THEN 'RESOLVED' WHEN trim(reason) <> '' THEN reason WHEN late THEN 'MISSING_EXACT_LAG_ENTRY'
  ELSE 'MISSING_EXACT_FORWARD_EXIT' END AS resolution,
  count(*) AS n FROM long WHERE score IS NOT NULL GROUP BY 1, 2, 3, 4"""


@query(CANDIDATES + _sections_sql(STAGE2) + _cells_sql(True) + ENDPOINTS)
def endpoint_resolution(spark: SparkSession, d: str) -> DataFrame:
    """How the outcomes of each factor's signals were resolved, in each of the 18 variants."""
    return lattice.endpoint_records(_stage2(spark, d)[0])


@query(CANDIDATES + """ SELECT date, count(roe_report) AS report_signals, count(roe_publication) AS publication_signals, count(*) FILTER (roe_report IS NOT NULL
  AND roe_publication IS NOT NULL) AS common_signals, count(*) FILTER (roe_report IS NOT NULL AND roe_publication IS NULL) AS report_only,
  count(*) FILTER (roe_report IS NULL AND roe_publication IS NOT NULL) AS publication_only,
  count(*) FILTER (roe_report IS NOT NULL AND published_report >= date) AS premature, round(count(*) FILTER (roe_report IS NOT NULL
  AND published_report >= date) / nullif(count(roe_report), 0)::DOUBLE, 6) AS premature_share,
  count(*) FILTER (roe_report IS NOT NULL AND roe_publication IS NOT NULL AND period_report IS DISTINCT
  FROM period_publication) AS changed_period, round(count(*) FILTER (roe_report IS NOT NULL AND roe_publication IS NOT NULL
  AND period_report IS DISTINCT FROM period_publication) / nullif(count(*) FILTER (roe_report IS NOT NULL AND roe_publication IS NOT NULL),
  0)::DOUBLE, 6) AS changed_share,
  count(*) FILTER (roe_report IS NOT NULL AND published_report IS NULL) AS missing_publication, round(avg(published_report - period_report),
  6) AS mean_delay, quantile_cont(published_report - period_report, 0.25)::DOUBLE AS p25_delay, median(published_report - period_report)::DOUBLE AS median_delay,
  quantile_cont(published_report - period_report, 0.75)::DOUBLE AS p75_delay, max(published_report - period_report)::INTEGER AS max_delay
  FROM cand WHERE in_pit GROUP BY date""")
def publication_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Report-end signals against published ones, by dates alone."""
    out = lattice.publication_exposure(_candidates(spark, d).filter("in_pit"))
    return out.withColumns({c: F.round(c, 6) for c in ("premature_share", "changed_share", "mean_delay")})


_SIDES = {"r": ("CASE WHEN outcome IS NOT NULL THEN roe_report END", "r IS NOT NULL"), "p": ("CASE WHEN outcome IS NOT NULL THEN roe_publication END", "p IS NOT NULL"), "rc": ("CASE WHEN outcome IS NOT NULL AND roe_publication IS NOT NULL THEN roe_report END", "rc IS NOT NULL"), "pc": ("CASE WHEN outcome IS NOT NULL AND roe_report IS NOT NULL THEN roe_publication END", "pc IS NOT NULL")}
TIMING = """, t0 AS (SELECT date, symbol, roe_report, roe_publication, future_same AS outcome FROM cand
  WHERE in_pit AND (future_same IS NOT NULL OR date < DATE '1996-01-01')), t1 AS (SELECT *, """ + ", ".join(f"{x} AS {k}" for k, (x, _) in _SIDES.items()) + " FROM t0), t2 AS (SELECT *, " + ", ".join(f"CASE WHEN {ok} THEN outcome END AS o_{k}" for k, (_, ok) in _SIDES.items()) + " FROM t1), t3 AS (SELECT *, " + ", ".join(f"{_rank_sql(k)} AS x_{k}, {_rank_sql(f'o_{k}')} AS y_{k}" for k in _SIDES) + """ FROM t2), t4 AS (SELECT date, count(r) AS n_report, count(p) AS n_publication, count(rc) AS n_common, count(*) FILTER (outcome IS NULL
  AND (roe_report IS NOT NULL OR roe_publication IS NOT NULL)) AS unresolved, """ + ", ".join(f"CASE WHEN count({k}) >= 5 AND count(DISTINCT x_{k}) > 1 AND count(DISTINCT y_{k}) > 1 THEN covar_samp(x_{k}, y_{k}) / (stddev_samp(x_{k}) * stddev_samp(y_{k})) END AS ic_{k}" for k in _SIDES) + """ FROM t3 GROUP BY date), t5 AS (SELECT *, unresolved = 0 AND ic_r IS NOT NULL AND ic_p IS NOT NULL AND ic_rc IS NOT NULL
  AND ic_pc IS NOT NULL AS ok FROM t4)"""


_STEPS = {"report_support_restriction": "ic_rc - ic_r", "record_replacement": "ic_pc - ic_rc", "publication_extension": "ic_p - ic_pc", "total": "ic_p - ic_r"}
_STEPS_SQL = ", ".join(f"{_unsigned_sql(f'CASE WHEN ok THEN {x} END', 6)} AS {name}" for name, x in _STEPS.items())


@query(CANDIDATES + TIMING + f" SELECT date, n_report, n_publication, n_common, unresolved, {_STEPS_SQL} FROM t5")
def timing_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with an exact forward return, and before 1996 those without too, whose months have no figures."""
    rows = _candidates(spark, d).filter("in_pit AND (future_same IS NOT NULL OR date < DATE '1996-01-01')").withColumnRenamed("future_same", "outcome")
    out = lattice.timing_decomposition(rows)
    return out.select("date", "n_report", "n_publication", "n_common", "unresolved", *(_unsigned(F.col(c), 6).alias(c) for c in _STEPS))


_P = "1 - 2 / sqrt(pi()) * exp(-power(least(abs(t), 8.0) / sqrt(2), 2)) * list_sum([exp(n * ln(2) + (2 * n + 1) * ln(greatest(least(abs(t), 8.0) / sqrt(2), 1e-12)) - lgamma(2 * n + 2) + n * ln(2) + lgamma(n + 1)) for n in range(0, 161)])"


@query(IC + NW + """, e AS (SELECT *, least(3, n - 1) AS l FROM s), k AS (SELECT factor, horizon, n, mean, CASE WHEN n >= 3 THEN sqrt(greatest(v / n +
  CASE WHEN l >= 1 THEN 2 * (1 - 1.0 / (l + 1)) * g1 / n ELSE 0 END + CASE WHEN l >= 2 THEN 2 * (1 - 2.0 / (l + 1)) * g2 / n
  ELSE 0 END + CASE WHEN l >= 3 THEN 2 * (1 - 3.0 / (l + 1)) * g3 / n ELSE 0 END, 0) / n) END AS se
  FROM e), z AS (SELECT *, mean / nullif(se, 0) AS t FROM k) SELECT factor, horizon, n, round(mean, 5) AS mean, round(se,
  5) AS standard_error, round(t, 4) AS t_stat, """ + _unsigned_sql(_P, 5) + " AS p_value, round(mean - 1.959963984540054 * se, 5) AS ci_low, round(mean + 1.959963984540054 * se, 5) AS ci_high FROM z")
def newey_west_inference(spark: SparkSession, d: str) -> DataFrame:
    """Standard error, p-value and 95 % interval of the mean IC."""
    out = lattice.mean_inference(study.newey_west(_ics(spark, d), ["factor", "horizon"], "ic", "date"))
    return out.select("factor", "horizon", "n", F.round("mean", 5).alias("mean"), F.round("standard_error", 5).alias("standard_error"), F.round("t_stat", 4).alias("t_stat"), *(_unsigned(F.col(c), 5).alias(c) for c in ("p_value", "ci_low", "ci_high")))


STATUS = "CASE WHEN periods < 3 THEN 'low_period_count' WHEN mean_ic < -0.02 THEN 'adverse' WHEN abs(mean_ic) < 0.02 THEN 'weak' WHEN t >= 1.5 THEN 'supportive' ELSE 'positive_but_noisy' END"
SUMMARY = IC + f""", u AS (SELECT factor, horizon, count(ic) AS periods, round(avg(ic), 6) AS mean_ic, coalesce(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))),
  0) AS t FROM ics GROUP BY 1, 2), v AS (SELECT *, {STATUS} AS status FROM u)"""


def _summary(spark: SparkSession, d: str) -> DataFrame:
    rows = study.ic_summary(_ics(spark, d), ["factor", "horizon"]).withColumns({"mean_ic": F.round("mean_ic", 6), "t": F.coalesce("t_stat", F.lit(0.0))})
    return rows.withColumn("status", study.summary_status(F.col("periods"), F.col("mean_ic"), F.col("t")))


@query(SUMMARY + " SELECT factor, horizon, periods, mean_ic, status FROM v")
def ic_status(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).select("factor", "horizon", "periods", "mean_ic", "status")


@query(SUMMARY + """ SELECT count(*) AS summary_rows, arg_max(factor, mean_ic) AS best_factor, arg_max(horizon, mean_ic) AS best_horizon,
  max(mean_ic) AS best_mean_ic, count(*) FILTER (status = 'supportive') AS supportive, count(*) FILTER (status = 'adverse') AS adverse
  FROM v""")
def ic_best_and_adverse(spark: SparkSession, d: str) -> DataFrame:
    return study.best_and_adverse(_summary(spark, d))


@query(FUNDAMENTALS + f""" SELECT date_trunc('year', period)::DATE AS year, count(*) AS n, {_even('avg(published - period)')} AS mean, median(published - period)::DOUBLE AS
  median, quantile_cont(published - period, 0.25)::DOUBLE AS p25, quantile_cont(published - period, 0.75)::DOUBLE AS p75,
  max(published - period)::INTEGER AS maximum FROM facts GROUP BY 1""")
def delay_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.fundamentals(spark, d).select(F.trunc("period", "year").alias("year"), F.datediff("published", "period").alias("delay"))
    return even(coverage.distribution(rows, ["year"], "delay"))
