"""Typed assets, discovery, the history guard, the panel cache, profiles within their bounds, rules over tables, runs and units."""

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, runs
from tidemark.sources import assets

D = datetime.date


def test_aliases_fallbacks_and_which_row_stays(spark):
    raw = spark.createDataFrame([
        ("600000", "2020-01-05", None, "1.5", "x"), ("600000", "20200105", "2020-02-01", "2.5", "x"), ("600000", "2020-01-06", "bad", "inf", "x"),
        ("000001.SZ", "2020-01-05", None, "", "x"), (None, "2020-01-05", None, "1", "x"), ("600001", "05/01/2020", None, "1", "x"), ("600001", "2021-01-01", None, "1", "x"),
    ], "stockCode string, publishDate string, reportDate string, roe string, pe_extra string")
    got = {(r.symbol, r.date): r for r in assets.conform(raw, assets.FUNDAMENTAL_FACTORS, "2020-12-31").collect()}
    assert set(got) == {("600000.SH", D(2020, 1, 5)), ("600000.SH", D(2020, 1, 6)), ("000001.SZ", D(2020, 1, 5))}
    assert got["600000.SH", D(2020, 1, 5)].roe == 2.5 and got["600000.SH", D(2020, 1, 5)].period == D(2020, 2, 1)
    assert got["600000.SH", D(2020, 1, 6)].roe is None and got["600000.SH", D(2020, 1, 6)].period is None and got["600000.SH", D(2020, 1, 6)].published == D(2020, 1, 6)
    only = assets.conform(raw, assets.FUNDAMENTAL_FACTORS, "2020-12-31", spark.createDataFrame([("000001.SZ",), ("000001.SZ",)], "symbol string"))
    assert [r.symbol for r in only.collect()] == ["000001.SZ"]
    with pytest.raises(assets.AssetError, match="symbol"):
        assets.conform(raw.drop("stockCode"), assets.FUNDAMENTAL_FACTORS, "2020-12-31")
    assert assets.conform(raw.limit(0), assets.FUNDAMENTAL_FACTORS, "2020-12-31").count() == 0


def test_missing_and_empty_tables(spark, tmp_path):
    with pytest.raises(assets.AssetError, match="no table"):
        assets.load_asset(spark, f"file://{tmp_path}/none", assets.DIVIDENDS, "2020-01-01")
    (tmp_path / "d.csv").write_text("symbol,exDate,cashDividendPerShare\n600000,2021-01-01,1\n600000,2019-01-01,-1\n600000,2019-01-01,0.5\n")
    assert assets.load_asset(spark, f"file://{tmp_path}/d.csv", assets.DIVIDENDS, "2020-01-01").select("cash").collect() == [(0.5,)]
    with pytest.raises(assets.AssetError, match="no rows"):
        assets.load_asset(spark, f"file://{tmp_path}/d.csv", assets.DIVIDENDS, "2018-01-01")


def test_a_single_latest_snapshot_is_refused(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "date string, latest_only boolean")
    for refused in (rows(("2020-01-01", True)), rows(("2020-01-01", True), ("2020-01-01", True))):
        with pytest.raises(assets.AssetError, match="latest-only"):
            assets.require_history(refused)
    for fine in (rows(("2020-01-01", False)), rows(("2020-01-01", None)), rows(("2020-01-01", True), ("2020-02-01", True)), rows(("2020-01-01", True), ("2020-01-01", False)), rows().limit(0)):
        assert assets.require_history(fine) is fine


def test_panel_cache(spark, tmp_path):
    source, root, built = tmp_path / "in", f"file://{tmp_path}/cache", []
    source.mkdir()
    (source / "a.csv").write_text("1\n2\n")

    def build():
        built.append(1)
        return spark.read.schema("v int").csv(f"file://{source}")

    ask = lambda **k: assets.cached_panel(spark, root, "panel", 1, {"size": 5, **k}, [f"file://{source}"], build)
    assert ask().agg(F.sum("v")).first()[0] == 3 and len(built) == 1
    again = ask()
    assert len(built) == 1 and all(str(source) not in f for f in again.inputFiles()) and again.agg(F.sum("v")).first()[0] == 3
    assert ask(size=6).count() == 2 and len(built) == 2
    (source / "b.csv").write_text("7\n")
    assert ask().agg(F.sum("v")).first()[0] == 10 and len(built) == 3
    (source / "b.csv").unlink()
    os.utime(source / "a.csv", (1, 1))
    assert ask().count() == 2 and len(built) == 4
    assert not [f for f in os.listdir(tmp_path / "cache") if "making" in f]
    # two that make the same table: the second one's copy goes
    slow = assets.cached_panel(spark, root, "twice", 1, {}, [], lambda: (assets.cached_panel(spark, root, "twice", 1, {}, [], lambda: spark.range(3)), spark.range(4))[1])
    assert slow.count() == 3 and not [f for f in os.listdir(tmp_path / "cache") if "making" in f]


def test_profiles_of_parts_merge_within_their_bounds(spark):
    rng = np.random.default_rng(0)
    rows = [(int(p), int(k), float(x), f"t{k % 700}", None if k % 10 == 0 else bool(k % 2)) for p, k, x in zip(rng.integers(0, 5, 20_000), rng.integers(0, 9_000, 20_000), rng.lognormal(3, 2, 20_000))]
    df = spark.createDataFrame(rows, "part int, k int, x double, t string, b boolean").withColumn("none", F.lit(None).cast("double")).withColumn("a", F.array("k"))
    got = {r.column: r for r in profile.profile(profile.merged(profile.sketches(df, ["part"]))).collect()}
    want = {"k": [r[1] for r in rows], "x": [r[2] for r in rows], "t": [r[3] for r in rows], "b": [r[4] for r in rows if r[4] is not None]}
    for c, values in want.items():
        assert got[c].n_rows == 20_000 and got[c].missing == 20_000 - len(values)
        assert abs(got[c].distinct - len(set(values))) <= profile.DISTINCT_BOUND * len(set(values))
    for c in ("k", "x"):
        values = np.sort(want[c])
        for q in (25, 50, 75):
            at = getattr(got[c], f"q{q}")
            assert np.searchsorted(values, at, "left") / len(values) - profile.RANK_BOUND <= q / 100 <= np.searchsorted(values, at, "right") / len(values) + profile.RANK_BOUND
        assert float(got[c].least) == values[0] and float(got[c].greatest) == values[-1]
    assert got["none"].missing == 20_000 and got["none"].distinct is None and got["none"].q50 is None and got["a"].missing == 0 and got["a"].least is None
    whole = {r.column: r for r in profile.profile(profile.sketches(df.drop("part"))).collect()}
    assert whole["t"].distinct == got["t"].distinct and whole["k"].greatest == got["k"].greatest
    assert all(r.n_rows == 0 and r.distinct is None for r in profile.profile(profile.sketches(df.limit(0))).collect())


def test_rules_over_tables(spark):
    a = spark.createDataFrame([(1, 10, 5.0), (1, 10, None), (2, 11, -1.0), (3, None, 2.0)], "id int, ref int, v double")
    b = spark.createDataFrame([(10,), (12,)], "id int")
    rules = [profile.Check("v_positive", "a", "v > 0"), profile.Check("id_known", "a", "id IS NOT NULL"), profile.Unique("a_key", "a", ("id", "ref")), profile.References("a_b", "a", ("ref",), "b", ("id",)), profile.AtLeast("b_size", "b", "count(*)", 3), profile.AtLeast("b_any", "b", "max(id)", 12)]
    got = {r.rule: (r.table, r.violations, r["sample"]) for r in profile.validate({"a": a, "b": b}, rules, {"a": ("id", "ref"), "b": ("id",)}).collect()}
    assert got == {"v_positive": ("a", 2, "1|10"), "id_known": ("a", 0, None), "a_key": ("a", 1, "1|10"), "a_b": ("a", 1, "11"), "b_size": ("b", 1, "2.0"), "b_any": ("b", 0, "12.0")}
    found = profile.validate({"a": a, "b": b}, rules, {"a": ("id", "ref"), "b": ("id",)})
    assert tuple(profile.verdict(found, ["a_key"]).first()) == (6, 4, 1, "invalid") and profile.verdict(found, ["id_known"]).first().level == "research_only"
    assert profile.verdict(found.filter("violations = 0"), ["a_key"]).first().level == "production_ready"
    empty = {r.rule: r.violations for r in profile.validate({"a": a.limit(0), "b": b.limit(0)}, rules, {"a": ("id",), "b": ("id",)}).collect()}
    assert empty == {"v_positive": 0, "id_known": 0, "a_key": 0, "a_b": 0, "b_size": 1, "b_any": 1}


def test_two_record_versions_flatten_alike(spark, tmp_path):
    raw = [("a", 1, '{"metrics": {"ret": 0.5}, "n": 3}'), ("a", 2, '{"results": {"metrics": {"ret": 0.7}}, "n": "4"}'), ("b", 1, "{no"), ("c", 1, None), ("d", 1, '{"metrics": {"ret": "high"}, "n": 2.0, "more": [1]}')]
    rows = runs.parsed(spark.createDataFrame(raw, "run_id string, created int, record string"))
    for part in (rows.filter("run_id < 'b'"), rows.filter("run_id >= 'b'")):
        runs.append(spark, part, f"file://{tmp_path}/runs")
    kept = spark.read.parquet(f"file://{tmp_path}/runs")
    fields = {"ret": ("double", ("$.results.metrics.ret", "$.metrics.ret")), "n": ("bigint", ("$.n",))}
    got = {r.run_id: r for r in runs.flatten(runs.latest(kept), fields).collect()}
    assert (got["a"].ret, got["a"].n, got["a"].versions, got["a"].readable) == (0.7, 4, 2, True)
    assert (got["b"].ret, got["b"].readable) == (None, False) and (got["c"].ret, got["c"].readable) == (None, False) and (got["d"].ret, got["d"].n) == (None, 2)
    assert {(r.field, r.runs) for r in runs.unknown_fields(kept, ["metrics", "n"]).collect()} == {("results", 1), ("more", 1)}


def test_planted_units_are_found(spark):
    rng, rows = np.random.default_rng(2), []
    for month in range(1, 13):
        for k in range(40):
            close, volume = float(rng.lognormal(2, 1)), float(rng.integers(100, 9000))
            unit = {True: 100.0, False: 1.0}[4 <= month <= 6] if k % 2 else {True: 1000.0, False: 1.0}[month == 9]
            odd = 50.0 if k % 9 == 0 else 1.0
            rows.append((k % 2, month, close * volume * unit * odd * float(rng.uniform(0.95, 1.05)), volume, close))
    rows += [(2, 1, 5.0, 0.0, 1.0), (2, 1, None, 1.0, 1.0), (3, 1, 30.0, 1.0, 1.0)]
    units = runs.amount_units(spark.createDataFrame(rows, "source int, month int, amount double, volume double, close double"), ["source", "month"])
    got = {(r.source, r.month): (r.unit, r.verified) for r in units.collect()}
    for month in range(1, 13):
        assert got[1, month] == (100.0 if 4 <= month <= 6 else 1.0, True) and got[0, month] == (1000.0 if month == 9 else 1.0, True)
    assert got[2, 1] == (None, False) and got[3, 1][1] is False
    breaks = {(r.source, r["from"], r.to, r.unit_before, r.unit_after) for r in runs.unit_breaks(units.filter("verified"), "source", "month").collect()}
    assert breaks == {(1, 3, 4, 1.0, 100.0), (1, 6, 7, 100.0, 1.0), (0, 8, 9, 1.0, 1000.0), (0, 9, 10, 1000.0, 1.0)}
