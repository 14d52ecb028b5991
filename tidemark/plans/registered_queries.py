"""Queries of the registered study's bundle: estimands, evidence, endpoint ledgers, snapshots and bitmap sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bitmaps, estimands, evidence, lattice, ledger
from tidemark.plans import study_queries as S
from tidemark.plans.registry import PANEL, query
from tidemark.sources import adapter, scratch, snapshots

LEAST_SYMBOLS, FIRST_MONTH, LAST_MONTH, COMPLETE_MONTHS = 5, "1995-01-01", "2001-10-01", 82
_STAGE2 = S.CANDIDATES + S._sections_sql(S.STAGE2) + S._cells_sql(True)

_EVIDENCE = f""", days AS (
  SELECT date, count(*) AS cells, count(*) FILTER (ic IS NOT NULL AND spread IS NOT NULL AND n >= {LEAST_SYMBOLS}) AS valid,
  sum(unresolved) AS unresolved, min(n) AS smallest
  FROM cells GROUP BY date),
wanted AS (SELECT unnest(generate_series(DATE '{FIRST_MONTH}', DATE '{LAST_MONTH}', INTERVAL 1 MONTH))::DATE AS month),
gaps AS (
  SELECT count(*) FILTER (w.month IS NULL OR s.month IS NULL) AS gaps
  FROM wanted w FULL JOIN (SELECT DISTINCT date_trunc('month', date)::DATE AS month
  FROM days) s ON w.month = s.month),
overall AS (
  SELECT count(*) AS dates, count(*) FILTER (cells = 72 AND valid = 72) AS complete_dates, count(*) FILTER (cells <> 72) AS wrong_size,
    coalesce(sum(unresolved), 0) AS unresolved, coalesce(min(smallest), 0) AS smallest_section
  FROM days),
judged AS (
  SELECT overall.*, array_to_string(list_filter([
    'SYNTHETIC_DATA', CASE WHEN unresolved > 0 THEN 'UNRESOLVED_FORWARD_ENDPOINTS' END, CASE WHEN gaps > 0 THEN 'MISSING_REGISTERED_REBALANCES' END,
    CASE WHEN complete_dates <> dates OR wrong_size > 0 THEN 'INCOMPLETE_REGISTERED_MONTHLY_CELLS' END,
    CASE WHEN complete_dates <> {COMPLETE_MONTHS} THEN 'INSUFFICIENT_COMPLETE_REGISTERED_REBALANCES' END], lambda x: x IS NOT NULL),
  ',') AS reasons
  FROM overall, gaps)"""


def _stage2_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells of the 18 variants, written once: contrasts, evidence and timing read them several times; and their candidates."""
    sections, size, rows = S._stage2(spark, d)
    return scratch.materialize(lattice.cells(sections, size=size), "cells"), rows


def _status(cells: DataFrame) -> DataFrame:
    spark = cells.sparkSession
    registry = spark.createDataFrame([(v["variant"], f) for v in lattice.variants() for f in lattice.FACTORS], "variant string, factor string")
    months = spark.sql(f"SELECT explode(sequence(DATE '{FIRST_MONTH}', DATE '{LAST_MONTH}', INTERVAL 1 MONTH)) AS month")
    return evidence.status(evidence.monthly_cells(cells, registry, LEAST_SYMBOLS), months, "synthetic", COMPLETE_MONTHS)


@query(_STAGE2 + _EVIDENCE + """ SELECT CASE WHEN reasons = '' THEN 'REAL_MARKET_REGISTERED_HISTORICAL_IC_CORE_STATISTICS' ELSE 'INSUFFICIENT_EVIDENCE' END AS code,
  reasons, reasons = '' AS passed, complete_dates, smallest_section FROM judged""")
def evidence_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether the registered months are whole enough for any claim, and what they lack."""
    return _status(_stage2_cells(spark, d)[0])


def _values(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    rows = candidates.filter("in_pit").withColumnRenamed("future_same", "outcome")
    steps = estimands.timing_values(lattice.timing_decomposition(rows, candidates.count()))
    return cells.select("date", "variant", "factor", F.col("ic").alias("value")).unionByName(steps)


_REGISTERED = estimands.registered()
_TERMS = ", ".join(f"('{e.name}', '{v}', '{f}', {w!r}::DOUBLE)" for e in _REGISTERED for (v, f), w in e.terms.items())
_LISTED = ", ".join(f"('{e.name}', '{e.family}', {len(e.terms)})" for e in _REGISTERED)
_TIMING_VALUES = " UNION ALL ".join(f"SELECT date, 'timing:{s}' AS variant, 'roe' AS factor, CASE WHEN ok THEN {S._STEPS[s]} END AS value FROM t5" for s in estimands.TIMING_STEPS)
_ALL_TIMING = S.TIMING.replace("AND (future_same IS NOT NULL OR date < DATE '1996-01-01')", "")
_CONTRASTS = _STAGE2 + _ALL_TIMING + f""", listed(estimand, family, terms) AS (VALUES {_LISTED}), w(estimand, variant, factor, weight) AS (VALUES {_TERMS}),
vals AS (SELECT date, variant, factor, ic AS value FROM cells UNION ALL {_TIMING_VALUES}),
con AS (
  SELECT estimand, date, CASE WHEN count(value) = any_value(terms) THEN round(sum(weight * value), 12) END AS value,
  count(*) AS r, count(value) AS known, any_value(terms) AS terms
  FROM vals JOIN w USING (variant, factor) JOIN listed USING (estimand) GROUP BY 1, 2)"""


@query(_CONTRASTS + f" SELECT estimand, date, known, {S._unsigned_sql('value', 6)} AS value FROM con")
def estimand_months(spark: SparkSession, d: str) -> DataFrame:
    """The monthly values of all 31 registered estimands."""
    months = estimands.contrasts(_values(*_stage2_cells(spark, d)), _REGISTERED)
    return months.select("estimand", "date", "known", S._unsigned(F.col("value"), 6).alias("value"))


_BUNDLE = _CONTRASTS + f""", o AS (SELECT *, value - avg(value) OVER (PARTITION BY estimand) AS c FROM con WHERE value IS NOT NULL),
lagged AS (SELECT *, c * lag(c, 1) OVER w1 AS g1, c * lag(c, 2) OVER w1 AS g2, c * lag(c, 3) OVER w1 AS g3
  FROM o WINDOW w1 AS (PARTITION BY estimand ORDER BY date)),
stat AS (
  SELECT estimand, count(*) AS n, avg(value) AS mean, sum(c * c) / count(*) AS v, coalesce(sum(g1), 0) / count(*) AS a1,
  coalesce(sum(g2), 0) / count(*) AS a2, coalesce(sum(g3), 0) / count(*) AS a3
  FROM lagged GROUP BY estimand),
e AS (SELECT *, least(3, n - 1) AS l FROM stat),
k AS (
  SELECT estimand, n, mean, CASE WHEN n >= 3 THEN mean / nullif(sqrt(greatest(
    v + CASE WHEN l >= 1 THEN 2 * (1 - 1.0::DOUBLE / (l + 1)) * a1 ELSE 0 END + CASE WHEN l >= 2 THEN 2 * (1 - 2.0::DOUBLE / (l + 1)) * a2
  ELSE 0 END
      + CASE WHEN l >= 3 THEN 2 * (1 - 3.0::DOUBLE / (l + 1)) * a3 ELSE 0 END, 0) / n), 0) END AS t
  FROM e),
p AS (SELECT *, CASE WHEN t <> 0 THEN mean / t END AS se, CASE WHEN t IS NOT NULL THEN greatest({S._P}, 0.0) END AS p_value
  FROM k),
counted AS (
  SELECT estimand, count(value) AS months, count(*) FILTER (known > 0 AND known < terms) AS unmatched, count(*) FILTER (r = terms
  AND value IS NULL) AS not_estimable, max(abs(value)) AS largest
  FROM con GROUP BY estimand),
joined AS (SELECT l.estimand, l.family, coalesce(c.months, 0) AS months, coalesce(c.unmatched, 0) AS unmatched, coalesce(c.not_estimable,
  0) AS not_estimable, c.largest, p.mean, p.se, p.t, p.p_value
  FROM listed l LEFT JOIN counted c USING (estimand) LEFT JOIN p USING (estimand)),
placed AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family, p_value IS NULL ORDER BY p_value,
  estimand) AS i FROM joined),
adjusted AS (
  SELECT *, CASE WHEN p_value IS NULL THEN NULL WHEN family = 'primary' THEN p_value WHEN family = 'secondary' THEN least(1.0::DOUBLE,
    min(m::DOUBLE / i * p_value) OVER (PARTITION BY family, p_value IS NULL ORDER BY p_value, estimand ROWS BETWEEN CURRENT ROW
  AND UNBOUNDED FOLLOWING)) END AS adjusted_p FROM placed)
SELECT estimand, family, months, unmatched, not_estimable, {S._unsigned_sql('mean', 6)} AS mean, {S._unsigned_sql('se', 5)} AS standard_error,
  {S._unsigned_sql('t', 3)} AS t_stat,
  {S._unsigned_sql('p_value', 5)} AS p_value, {S._unsigned_sql('mean - 1.959963984540054 * se', 5)} AS ci_low, {S._unsigned_sql('mean + 1.959963984540054 * se', 5)} AS ci_high,
  {S._unsigned_sql('adjusted_p', 5)} AS adjusted_p,
  CASE WHEN family = 'control' AND months > 0 THEN unmatched = 0 AND largest <= 1e-12 END AS isolated, family <> 'control'
  AND months >= {{claims}} AND p_value IS NOT NULL AND {{gate}} AS may_claim,
  family <> 'control' AND months >= {{claims}} AND p_value IS NOT NULL AND {{gate}} AND coalesce(adjusted_p <= CASE
  WHEN family = 'primary' THEN 0.05 ELSE 0.1 END, false) AS rejects
FROM adjusted"""
_CLAIM_MONTHS = 12
_DIGITS = {"mean": 6, "standard_error": 5, "t_stat": 3, "p_value": 5, "ci_low": 5, "ci_high": 5, "adjusted_p": 5}


@query(_BUNDLE.format(claims=_CLAIM_MONTHS, gate="true"))
def registered_estimands(spark: SparkSession, d: str) -> DataFrame:
    """All estimands with inference and multiplicity, as they would be claimed if the data were evidence."""
    cells, candidates = _stage2_cells(spark, d)
    months = scratch.materialize(estimands.contrasts(_values(cells, candidates), _REGISTERED), "contrasts")
    gate = spark.createDataFrame([(True,)], "passed boolean")
    out = estimands.summaries(months, _REGISTERED, gate, claim_months=_CLAIM_MONTHS)
    return out.withColumns({c: S._unsigned(F.col(c), k) for c, k in _DIGITS.items()})


@query(_BUNDLE.format(claims=_CLAIM_MONTHS, gate="false").replace("\nSELECT estimand,", f"{_EVIDENCE}\nSELECT reasons, estimand,").replace("FROM adjusted\"", "FROM adjusted").rstrip() + ", judged")
def gated_estimands(spark: SparkSession, d: str) -> DataFrame:
    """The same behind the evidence gate: synthetic tables allow no claim."""
    cells, candidates = _stage2_cells(spark, d)
    months = scratch.materialize(estimands.contrasts(_values(cells, candidates), _REGISTERED), "contrasts")
    status = scratch.materialize(_status(cells), "status")
    out = estimands.summaries(months, _REGISTERED, status, claim_months=_CLAIM_MONTHS).crossJoin(F.broadcast(status.select("reasons")))
    return out.withColumns({c: S._unsigned(F.col(c), k) for c, k in _DIGITS.items()})


_LEDGER_KEYS = ["date", "variant", "factor", "symbol"]
_CODE = S.ENDPOINTS[S.ENDPOINTS.index("CASE") : S.ENDPOINTS.index(" AS resolution")]
_RECORDS = _STAGE2 + f""", led AS (SELECT date, variant, factor, symbol, {_CODE} AS resolution FROM long WHERE score IS NOT NULL)"""
_BLOCKS = _RECORDS + f""", lines AS (
  SELECT row_number() OVER (ORDER BY date, variant, factor, symbol) - 1 AS number,
    '{{"date":"' || date || '","factor":"' || factor || '","resolution":"' || resolution || '","symbol":' || symbol || ',"variant":"' || variant || '"}}' AS record
  FROM led),
one AS (SELECT number // {ledger.BLOCK} AS block, count(*) AS records, sha256(string_agg(record, chr(10) ORDER BY number)) AS digest
  FROM lines GROUP BY 1)
SELECT 1 AS level, block, records, digest FROM one
UNION ALL SELECT 2, block // {ledger.BLOCK}, sum(records)::BIGINT, sha256(string_agg(digest, chr(10) ORDER BY block))
  FROM one GROUP BY 2"""


@query(_BLOCKS)
def endpoint_ledger_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the ledger of all endpoint records, two levels."""
    sections, size, _ = S._stage2(spark, d)
    # sampled for its ranges and then dealt out: written once, as is its number of rows
    rows = scratch.materialize(lattice.endpoint_codes(sections).select(*_LEDGER_KEYS, "resolution"), "endpoints")
    return ledger.blocks(rows, _LEDGER_KEYS, levels=2, size=rows.count())


@query(_RECORDS + """, kept AS (SELECT * FROM led WHERE symbol % 10 <> 7 OR resolution <> 'RESOLVED'),
found AS (SELECT date, variant, factor, count(*) AS k, count(*) FILTER (resolution = 'RESOLVED') AS done
  FROM kept GROUP BY 1, 2, 3),
b AS (SELECT c.*, coalesce(f.k, 0) AS k, coalesce(f.done, 0) AS done FROM cells c LEFT
  JOIN found f USING (date, variant, factor)),
j AS (SELECT date, variant, factor, list_filter([CASE WHEN eligible > candidates THEN 'ELIGIBLE_EXCEEDS_CANDIDATES' END,
  CASE WHEN k <> eligible THEN 'RECORDS_DIFFER_FROM_ELIGIBLE' END,
  CASE WHEN done <> n THEN 'RESOLVED_DIFFERS_FROM_ESTIMABLE' END, CASE WHEN n + unresolved <> eligible THEN 'COUNTS_DO_NOT_ADD_UP' END],
  lambda x: x IS NOT NULL) AS reasons FROM b)
SELECT date, variant, factor, array_to_string(reasons, ',') AS reasons FROM j WHERE len(reasons) > 0""")
def ledger_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Cells that a ledger which lost some resolved records no longer covers."""
    sections, size, _ = S._stage2(spark, d)
    kept = lattice.endpoint_codes(sections).filter("symbol % 10 <> 7 OR resolution <> 'RESOLVED'")
    found = ledger.coverage_faults(kept, lattice.cells(sections, size=size), ["date", "variant", "factor"], "resolution", "RESOLVED")
    return found.withColumn("reasons", F.array_join("reasons", ","))


_CUTOFF = "2000-06-30"
BARS = snapshots.Dataset({"date": "date", "symbol": "integer", "close": "number", "high": "number", "low": "number", "volume": "integer", "flagged": "boolean"}, ("date", "symbol"), "date", rules={"high_is_highest": "high >= close", "low_is_lowest": "low <= close", "traded": "volume >= 5"})
FACTS = snapshots.Dataset({"symbol": "integer", "period": "date", "published": "date", "value": "number"}, ("symbol", "period"), "published", frozenset({"published"}))
ORDERS = snapshots.Dataset({"customer": "integer", "day": "date", "price": "number", "clerk": "string"}, ("customer", "day"), "day")
_CONTRACTS = {"bars": BARS, "facts": FACTS, "orders": ORDERS}


def _bars(spark: SparkSession, d: str) -> DataFrame:
    rows = adapter.daily_panel(spark, d)
    return rows.select("date", "symbol", "close", "high", "low", F.col("volume").cast("bigint").alias("volume"), F.col("has_a").alias("flagged"))


def _published(spark: SparkSession, d: str) -> str:
    orders = adapter.read(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("price"), F.lit("clerk").alias("clerk"))
    root = scratch.new_path(spark, "snapshot")
    snapshots.publish({"bars": _bars(spark, d), "facts": adapter.fundamentals(spark, d), "orders": orders}, _CONTRACTS, root, _CUTOFF)
    return root


_FACTS_SQL = S.FUNDAMENTALS[len(PANEL) :] if S.FUNDAMENTALS.startswith(PANEL) else S.FUNDAMENTALS


@query(S.FUNDAMENTALS + f""", bad AS (
  SELECT 'bars' AS dataset, unnest(list_filter([CASE WHEN date > DATE '{_CUTOFF}' THEN 'after_cutoff' END, CASE WHEN NOT high >= close
  THEN 'high_is_highest' END,
    CASE WHEN NOT low <= close THEN 'low_is_lowest' END, CASE WHEN NOT volume >= 5 THEN 'traded' END], lambda x: x IS NOT NULL)) AS rule,
  date || '|' || symbol AS key FROM panel
  UNION ALL SELECT 'facts', 'after_cutoff', symbol || '|' || period FROM facts WHERE published > DATE '{_CUTOFF}'
  UNION ALL SELECT 'orders', 'after_cutoff', o_custkey || '|' || o_orderdate::DATE
  FROM orders WHERE o_orderdate::DATE > DATE '{_CUTOFF}'),
again AS (SELECT count(*) - 1 AS more, o_custkey || '|' || o_orderdate::DATE AS key
  FROM orders GROUP BY o_custkey, o_orderdate::DATE HAVING count(*) > 1)
SELECT dataset, rule, count(*) AS rows, min(key) AS first_key FROM bad GROUP BY 1, 2
UNION ALL SELECT 'orders', 'repeated_key', sum(more)::BIGINT, min(key) FROM again HAVING count(*) > 0""")
def snapshot_row_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the rows of a published snapshot: rows after its cutoff, prices out of order, repeated keys."""
    return snapshots.row_verdicts(spark, _published(spark, d), _CONTRACTS)


@query("SELECT unnest(['bars', 'facts', 'orders']) AS dataset, 'ok' AS verdict, true AS all_files")
def snapshot_file_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every file of a published snapshot hashed again and held against the manifest."""
    found = snapshots.file_verdicts(spark, _published(spark, d), _CONTRACTS).groupBy("dataset", "verdict").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(S.Window.partitionBy("dataset"))
    return found.withColumn("all_files", F.col("n") == whole).drop("n")


@query(PANEL + " SELECT symbol, count(*) AS rows, max(date) AS last, sum(CAST(close AS DECIMAL(28,6)))::DOUBLE AS closes FROM panel GROUP BY symbol")
def verified_scan(spark: SparkSession, d: str) -> DataFrame:
    """The panel read back from a snapshot of which manifest, files and rows were verified first."""
    bars = snapshots.Dataset(BARS.columns, BARS.key, "date")
    root = scratch.new_path(spark, "snapshot")
    snapshots.publish({"bars": _bars(spark, d)}, {"bars": bars}, root, "2030-01-01")
    got = snapshots.load(spark, root, {"bars": bars})["bars"]
    return got.groupBy("symbol").agg(F.count("*").alias("rows"), F.max("date").alias("last"), F.sum("close").cast("double").alias("closes"))


@query("""WITH ev AS (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS date, event_type
  FROM events WHERE event_type IN ('click', 'purchase')),
u AS (SELECT date, symbol, bool_or(event_type = 'click')::INT AS x, bool_or(event_type = 'purchase')::INT AS y
  FROM ev GROUP BY 1, 2)
SELECT date, sum(x)::BIGINT AS n_a, sum(y)::BIGINT AS n_b, sum(x * y)::BIGINT AS both, count(*) AS either, sum(x * (1 - y))::BIGINT AS only_a,
  sum(y * (1 - x))::BIGINT AS only_b, sum(abs(x - y))::BIGINT AS one_side FROM u GROUP BY date""")
def daily_bitmap_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Users who click and users who buy, by day, as bitmaps over a dictionary of users."""
    ev = adapter.user_events(spark, d)
    sets = bitmaps.build(ev, bitmaps.dictionary(ev, "symbol"), "symbol", ["date", "event_type"])
    return bitmaps.algebra(sets, ["date"], "event_type", "click", "purchase")
