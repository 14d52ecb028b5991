import pytest

from tidemark.functions.columns import pct_rank
from tidemark.operators import panel, study
from pyspark.sql import functions as F


def test_shapley_splits_the_interaction(spark):
    parts, worth = ["a", "b", "c", "d"], {"a": 1, "b": 2, "c": 3, "d": 4}
    rows = []
    for mask in range(16):
        s = [p for i, p in enumerate(parts) if mask >> i & 1]
        rows.append((1, "+".join(s) or "none", 10.0 + sum(worth[x] for x in s) + (5 if {"a", "b"} <= set(s) else 0)))
    got = {r.component: r.contribution for r in study.shapley(spark.createDataFrame(rows, "month int, variant string, value double"), parts, ["month"]).collect()}
    assert got == pytest.approx({"a": 3.5, "b": 4.5, "c": 3.0, "d": 4.0})
    assert study.shapley(spark.createDataFrame(rows[1:], "month int, variant string, value double"), parts, ["month"]).count() == 0


def test_multiplicity(spark):
    rows = [("f", "t1", 0.01), ("f", "t2", 0.04), ("f", "t3", 0.03), ("f", "t4", 0.2), ("g", "u1", 0.01), ("g", "u2", 0.04), ("h", "v1", 0.03), ("h", "v2", None)]
    got = {r.test: r for r in study.adjust_p(spark.createDataFrame(rows, "family string, test string, p_value double"), "family").collect()}
    assert [got[t].bh for t in ("t1", "t2", "t3", "t4")] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])
    assert [got["u1"].holm, got["u2"].holm, got["v1"].holm] == pytest.approx([0.02, 0.04, 0.06]) and got["v2"].holm is None


def test_average_tie_rank_and_constant_ic(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 2.0), (1, "b", 1.0, 3.0), (1, "c", 2.0, 1.0), (1, "d", None, 1.0)], "date int, symbol string, score double, outcome double")
    got = {r.symbol: r.p for r in rows.select("symbol", pct_rank(F.col("score"), "date").alias("p")).collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 1.0, "d": None}
    flat = rows.withColumn("score", F.lit(1.0))
    assert study.rank_ic(flat, ["date"], least=1).first().ic is None


def test_group_cap_backfills(spark):
    rows = [(1, s, g, x) for s, g, x in (("a", "x", 9.0), ("b", "x", 8.0), ("c", "x", 7.0), ("d", "y", 1.0))]
    got = panel.select_capped(spark.createDataFrame(rows, "date int, symbol string, g string, score double"), 3, "g", 0.34).orderBy("position")
    assert [r.symbol for r in got.collect()] == ["a", "d", "b"]


def test_two_sided_p_against_the_error_function(spark):
    import math

    from tidemark.operators.lattice import two_sided_p

    ts = [0.0, 0.1, -1.0, 1.959963984540054, -3.5, 6.0]
    got = [r.p for r in spark.createDataFrame([(t,) for t in ts], "t double").select("t", two_sided_p(F.col("t")).alias("p")).orderBy("t").collect()]
    want = [math.erfc(abs(t) / math.sqrt(2)) for t in sorted(ts)]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))
