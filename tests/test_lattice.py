"""The registered study's rules by hand: what counts as known, exact sessions, endpoint records, and how often tables are read."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, lattice, study
from tidemark.plans import study_queries

TINY = "/root/testdata/sf0.001"


def day(s):
    return F.to_date(F.lit(s))


def test_stage_and_early_rules_choose_other_facts(spark):
    quotes = spark.createDataFrame([("a", "2020-06-01"), ("a", "2020-06-30"), ("b", "2020-06-01")], "symbol string, date string").withColumn("date", F.to_date("date"))
    facts = spark.createDataFrame([
        ("a", "2020-03-31", "2020-04-20", 1.0),  # the newest period published before June
        ("a", "2019-12-31", "2020-05-20", 2.0),  # an older period published later
        ("a", "2020-04-30", "2020-06-01", 3.0),  # published on the day itself
        ("b", "2018-06-30", "2018-08-01", 4.0),  # older than 18 months
        ("b", None, None, 9.0),
    ], "symbol string, period string, published string, roe double").withColumns({c: F.to_date(c) for c in ("period", "published")})
    rows = lambda knowledge: {(r.symbol, str(r.date)): (r.roe_report, r.roe_publication) for r in joins.known_views(quotes, facts, knowledge).collect()}
    stage, early = rows(study_queries.STAGE2_KNOWLEDGE), rows(study_queries.LEGACY_KNOWLEDGE)
    # by period end April's figures are known in June, published or not; the stage takes only what was published before the day
    assert stage == {("a", "2020-06-01"): (3.0, 1.0), ("a", "2020-06-30"): (3.0, 3.0), ("b", "2020-06-01"): (None, None)}
    # the early study takes what was published last, on the day too, and whatever its age
    assert early == {("a", "2020-06-01"): (3.0, 3.0), ("a", "2020-06-30"): (3.0, 3.0), ("b", "2020-06-01"): (4.0, 4.0)}
    early_may = {r.symbol: r.roe_publication for r in joins.known_views(quotes.withColumn("date", day("2020-05-29")), facts, study_queries.LEGACY_KNOWLEDGE).collect()}
    assert early_may["a"] == 2.0


def test_views_equal_single_lookups(spark):
    quotes = spark.range(300).selectExpr("CAST(id % 7 AS STRING) AS symbol", "date_add(DATE '2020-01-01', CAST(id * 13 % 400 AS INT)) AS date").distinct()
    facts = spark.range(200).selectExpr("CAST(id % 8 AS STRING) AS symbol", "date_add(DATE '2019-01-01', CAST(id * 37 % 700 AS INT)) AS period", "date_add(DATE '2019-02-01', CAST(id * 53 % 700 AS INT)) AS published", "CAST(id AS DOUBLE) AS roe")
    got = joins.known_views(quotes, facts, study_queries.STAGE2_KNOWLEDGE).select("symbol", "date", "roe_report", "roe_publication")
    by = lambda available, strict: joins.latest_known(quotes, facts, ["period", "published"], available, strict=strict, stale_months=18)
    want = by("period", False).select("symbol", "date", F.col("roe").alias("roe_report")).join(by("published", True).select("symbol", "date", F.col("roe").alias("roe_publication")), ["symbol", "date"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("roe_report IS NOT NULL").count() > 50


def test_returns_between_exact_sessions(spark):
    calendar = spark.createDataFrame([(f"2020-01-{d:02d}", d) for d in range(1, 9)], "date string, session int")
    rows = [("a", f"2020-01-{d:02d}", float(d), 1.0) for d in (1, 2, 3, 5, 6)]
    got = {r.session: r for r in lattice.prepare(spark.createDataFrame(rows, "symbol string, date string, close double, amount double"), calendar, 2, 2, 2).collect()}
    assert got[1].future_same == 2.0 and got[1].future_same_reason is None
    assert got[2].future_same is None and got[2].future_same_reason == "MISSING_EXACT_FORWARD_EXIT"
    assert got[1].future_lagged is None and got[1].future_lagged_reason == "MISSING_EXACT_LAG_EXIT"
    assert got[2].future_lagged == 5 / 3 - 1 and got[3].future_lagged_reason == "MISSING_EXACT_LAG_ENTRY"
    assert got[3].momentum == 2.0 and got[5].momentum is None and got[6].momentum is None


def test_endpoint_records_are_those_of_a_factors_signals(spark):
    rows = [("d", "v", "a", 1.0, 1.0, 1.0, 0.5, None, False), ("d", "v", "b", None, 2.0, 1.0, None, "MISSING_EXACT_FORWARD_EXIT", False), ("d", "v", "c", 3.0, None, 1.0, None, " ", False), ("d", "w", "a", 1.0, 1.0, 1.0, None, None, True)]
    sections = spark.createDataFrame(rows, "date string, variant string, symbol string, roe double, momentum double, low_vol double, outcome double, reason string, late boolean")
    got = {(r.variant, r.factor, r.resolution): r.n for r in lattice.endpoint_records(sections).collect()}
    lacking, entry = "MISSING_EXACT_FORWARD_EXIT", "MISSING_EXACT_LAG_ENTRY"
    want = {("v", "roe", "RESOLVED"): 1, ("v", "roe", lacking): 1, ("v", "momentum", "RESOLVED"): 1, ("v", "momentum", lacking): 1, ("v", "low_vol", "RESOLVED"): 1, ("v", "low_vol", lacking): 2, ("v", "composite", "RESOLVED"): 1}
    assert got == want | {("w", f, entry): 1 for f in lattice.FACTORS}


def test_few_values_have_no_t(spark):
    rows = spark.createDataFrame([("x", i, float(i)) for i in range(2)] + [("y", i, float(i % 3)) for i in range(5)], "k string, i int, v double")
    for effective in (True, False):
        got = {r.k: r.t_stat for r in study.newey_west(rows, ["k"], "v", "i", effective=effective).collect()}
        assert got["x"] is None and got["y"] is not None


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")
def test_candidates_read_each_table_once_for_each_use(spark):
    plan = study_queries.stage2_variant_cells(spark, TINY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4
