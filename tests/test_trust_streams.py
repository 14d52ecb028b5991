"""Trust rules by hand, walk-forward statuses, alpha health; the streaming as-of join against the batch one."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import coverage, joins, trust
from tidemark.streaming.as_of import stream_as_of

D = datetime.date


def test_panel_quality_takes_the_first_status_that_applies(spark):
    rows = [("ok", "a", "2020-01-01", 1.0, 1.0)] * 1 + [("warn", "a", "2020-01-01", 1.0, 1.0)] * 2 + [("gap", "a", "2020-01-01", None, 1.0)] + [("old", "a", "2019-01-01", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, symbol string, date string, close double, amount double").withColumn("date", F.to_date("date"))
    whole = df.withColumns({c: F.col("close") for c in ("open", "high", "low")})
    got = {r.g: r for r in trust.panel_quality(whole, ["g"], "2020-01-06").collect()}
    assert {g: r.status for g, r in got.items()} == {"ok": "ok", "warn": "warn", "gap": "warn", "old": "stale"}
    assert got["warn"].repeated_keys == 1 and got["gap"].null_close == 1.0 and got["ok"].age_days == 5
    assert {r.status for r in trust.panel_quality(df, ["g"], "2020-01-06").collect()} == {"missing_columns"}
    assert trust.panel_quality(whole.limit(0), ["g"], "2020-01-06").count() == 0


def test_every_master_rule_breaks_by_itself(spark):
    good = [(f"{i:06d}.{'SH' if i % 2 else 'SZ'}", D(2000, 1, 1), D(2010, 1, 1) if i < 3 else None, "A") for i in range(20)]
    rules = trust.master_rules(20, 20, 3)

    def broken(rows):
        master = spark.createDataFrame(rows, "symbol string, list_date date, delist_date date, stock_type string")
        row = trust.master_status(trust.broken_rules(trust.master_measures(master, "2005-01-01", "2006-01-01"), rules)).first()
        return set(row.hard) | set(row.soft), row.status

    assert broken(good) == (set(), "production_ready")
    more = [(f"{i:06d}.SH", D(2000, 1, 1), None, "A") for i in range(100, 140)]
    assert broken(good[:19])[0] == {"row_coverage", "unique_symbol_coverage", "eligible_period_symbols"}
    assert broken(good + more + [("X", D(2000, 1, 1), None, "A")] * 1 + [("Y", D(2000, 1, 1), None, "A")])[0] == {"symbol_format"}
    assert broken(good + good[5:6])[0] == {"duplicate_symbols"}
    assert broken([(s, None if i < 2 else a, b, t) for i, (s, a, b, t) in enumerate(good)])[0] == {"list_date_coverage", "eligible_period_symbols"}
    assert broken([(s, a, None, t) for s, a, b, t in good])[0] == {"delisted_security_coverage"}
    assert broken([(s.replace("SZ", "SH"), a, b, t) for s, a, b, t in good])[0] == {"exchange_coverage"}
    assert broken(good + [("900123.SH", D(2000, 1, 1), None, "A")])[0] == {"a_share_rows_only"} and "a_share_rows_only" in broken(good + [("000999.SZ", D(2000, 1, 1), None, "B")])[0]
    assert broken([(s, a, b, None) for s, a, b, t in good]) == ({"a_share_type_coverage"}, "needs_review")
    assert broken([])[1] == "invalid"


def test_audit_verdicts(spark):
    fine = {"trades": 50, "max_drawdown": -0.1, "annualized": 0.2, "years": 5.0, "coverage": 0.95, "positive_years": 4, "n_years": 5, "stressed": 0.15, "turnover": 3.0}
    cases = {"fine": {}, "one": {"trades": 29}, "two": {"trades": 29, "max_drawdown": -0.31}, "warned": {"turnover": 25.0}, "short": {"years": 2.0}, "shorter": {"years": 0.5}, "thin": {"coverage": 0.8}, "thinner": {"coverage": 0.5}, "loss": {"annualized": 0.0, "stressed": -0.1}, "stressed": {"stressed": 0.09}, "bad_years": {"positive_years": 1}, "unknown": {"coverage": None}}
    rows = [{"case": k, **fine, **v} for k, v in cases.items()]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "case string, trades long, max_drawdown double, annualized double, years double, coverage double, positive_years long, n_years long, stressed double, turnover double")
    got = {r.case: (r.hard, r.soft, r.verdict) for r in trust.audit(df).collect()}
    assert got["fine"] == ([], [], "deploy_simulation") and got["one"] == (["trade_count"], [], "refine") and got["two"][2] == "abandon"
    assert got["warned"] == ([], ["turnover"], "refine") and got["short"] == ([], ["few_years"], "refine") and got["shorter"] == (["years_tested"], [], "refine")
    assert got["thin"] == ([], ["thin_factor"], "refine") and got["thinner"] == (["factor_coverage"], [], "refine")
    assert got["loss"][0] == ["annualized_return", "stress_positive"] and got["stressed"][0] == ["stress_half"] and got["bad_years"][0] == ["positive_years"] and got["unknown"][0] == ["factor_coverage"]


def test_window_statuses(spark):
    days = [D(2020, 1, 1) + datetime.timedelta(days=i) for i in range(40)]
    pools = {"ok": (0.01, 0.01, 1), "failed_oos": (0.01, -0.01, 1), "weak_oos": (0.01, 0.002, 1), "low_trade_sample": (0.01, 0.01, 0), "no_train": (None, 0.01, 1)}
    rows = [(p, d, x, n) for p, (a, b, n) in pools.items() for i, d in enumerate(days) if (x := a if i < 20 else b) is not None]
    windows = spark.createDataFrame([(0, days[0], days[20], D(2020, 3, 1))], "window_id int, train_start date, test_start date, test_end date")
    found = trust.window_results(spark.createDataFrame(rows, "pool string, date date, r double, trades long"), windows, ["pool"], 250)
    got = {r.pool: r for r in found.collect()}
    assert {p: r.status for p, r in got.items()} == {p: "error" if p == "no_train" else p for p in pools}
    assert math.isclose(got["ok"].train_annualized, 1.01**250 - 1, rel_tol=1e-9) and math.isclose(got["ok"].oos_ratio, 1, rel_tol=1e-9) and got["no_train"].oos_ratio is None
    summed = trust.walk_forward_summary(found.withColumn("all", F.lit(1)), ["all"]).first()
    assert (summed.windows, summed.positive_share, summed.failed) == (4, 0.75, 1)


def test_alpha_health_is_the_mean_of_what_is_known(spark):
    rows = [("2020-01-01", 0.1, None, 0.1, -0.1, 0.5), ("2020-01-01", -0.1, None, 0.1, -0.5, 0.7), ("2020-01-02", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "date string, momentum_12 double, momentum_24 double, mean_gap_12 double, drawdown_24 double, s double")
    a, b = trust.alpha_health(df, ("s",)).orderBy("date").collect()
    assert (a.breadth_12, a.breadth_24, a.above_mean, a.drawdown_ok, a.s_median) == (0.5, None, 1.0, 0.5, 0.6) and math.isclose(a.alpha_health, (0.5 + 1 + 0.5 + 0.6) / 4)
    assert b.alpha_health is None and math.isclose(b.alpha_health_lag1, a.alpha_health) and a.alpha_health_lag1 is None


@pytest.mark.parametrize("strict", [False, True])
def test_streamed_as_of_equals_the_batch_join(spark, tmp_path, strict):
    """Replayed in an order that is shuffled within the watermark, quotes get the facts that the batch join gives them."""
    rng = np.random.default_rng(11)
    start, rows = datetime.datetime(2020, 1, 1), []
    for i in range(160):
        rows.append((f"s{rng.integers(0, 4)}", start + datetime.timedelta(days=int(i // 2)), i if rng.random() < 0.6 else None, float(rng.integers(0, 50))))
    moved = sorted(rows, key=lambda r: r[1] + datetime.timedelta(days=float(rng.uniform(0, 4))))
    # a row far ahead moves the watermark past everything that is asked
    moved.append(("end", start + datetime.timedelta(days=400), None, 0.0))
    for k in range(0, len(moved), 20):
        spark.createDataFrame(moved[k : k + 20], "symbol string, ts timestamp, id long, value double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k:05d}")
    stream = spark.readStream.schema("symbol string, ts timestamp, id long, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    out = stream_as_of(stream.filter("id IS NOT NULL").select("symbol", "ts", "id"), stream.filter("id IS NULL").select("symbol", "ts", "value"), "6 days", strict)
    query = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    got = {r.id: (r.symbol, r.fact_ts, r.value) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, id long, value double").withColumnRenamed("ts", "date")
    facts = df.filter("id IS NULL").select("symbol", F.col("date").alias("event_date"), "value", F.col("date").alias("fact_ts"))
    want = {r.id: (r.symbol, r.fact_ts, r.value) for r in joins.as_of(df.filter("id IS NOT NULL").select("symbol", "date", "id"), facts, ["value", "fact_ts"], strict=strict).collect()}
    assert got == want and len(want) > 60 and sum(v[2] is not None for v in want.values()) > 40


def test_gate_and_score_by_hand(spark):
    best = {"source": "investoday:x+pit_liquidity_universe+pit_stock_master_filter", "production_ready": True, "aligned_days": 5, "walk_positive": 1.0, "walk_windows": 4.0, "walk_failed": 0.0, "supportive": 2.0, "adverse": 0.0, "bias_status": "ok", "bias_score": 100.0, "bias_failed": 0.0, "max_drawdown": -0.05, "trade_count": 200.0, "verdict": "keep", "annualized": 0.3, "information_ratio": 1.5, "sharpe": 9.0, "best_t": 2.0, "top_weight": 0.1, "data_points": 10.0}
    cases = {"best": {}, "sample": {"source": "sample"}, "abandoned": {"verdict": "abandon"}, "unknown": {"production_ready": None, "bias_status": None, "annualized": None, "max_drawdown": None}, "walk": {"walk_failed": 2.0}, "no_ir": {"information_ratio": 0.0, "sharpe": 0.75}, "biased": {"bias_failed": 1.0}, "spread": {"top_weight": 0.0}, "adverse": {"adverse": 9.0}}
    names = ["case", *best]
    kinds = {str: "string", bool: "boolean", int: "int", float: "double"}
    df = spark.createDataFrame([(k, *{**best, **v}.values()) for k, v in cases.items()], ", ".join(f"`{n}` {'string' if n == 'case' else kinds[type(best[n])]}" for n in names))
    got = {r.case: r for r in coverage.research_score(coverage.decision_gate(df)).collect()}
    assert (got["best"].passed, got["best"].gate, got["best"].score, got["best"].band) == (11, "paper_candidate", 100.0, "strong_watch")
    assert got["sample"].passed == 8 and got["sample"].score == 80.0 and (got["abandoned"].passed, got["abandoned"].score, got["abandoned"].band) == (10, 45.0, "weak_watch")
    # a missing figure is 0: no drawdown, no return; a missing answer fails
    assert got["unknown"].passed == 9 and got["unknown"].points_return == 0 and got["unknown"].points_drawdown == 12 and got["unknown"].annualized is None
    assert math.isclose(got["walk"].points_walk_forward, 12) and math.isclose(got["no_ir"].points_risk_adjusted, 4) and math.isclose(got["biased"].points_bias, 2)
    assert math.isclose(got["spread"].points_concentration, 4) and math.isclose(got["adverse"].points_factor_ic, 7) and got["adverse"].aligned_days == 5
