"""Estimands against plain sums, the claim gate, evidence codes, bitmap sets against Python sets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitmaps, estimands, evidence, lattice

CELLS = "date string, variant string, factor string, value double"


def test_registry_has_one_primary_28_secondary_and_two_controls():
    families = [e.family for e in estimands.registered()]
    assert (families.count("primary"), families.count("secondary"), families.count("control")) == (1, 28, 2)
    shapley = [e for e in estimands.registered() if e.name.startswith("S_shapley_roe")]
    assert len(shapley) == 4 and all(len(e.terms) == 16 for e in shapley)
    # contributions add up to the full less the empty set
    total = {}
    for e in shapley:
        for k, w in e.terms.items():
            total[k] = total.get(k, 0) + w
    ends = {("A2_" + "+".join(lattice.COMPONENTS), "roe"): 1.0, ("A2_base", "roe"): -1.0}
    assert {k: round(w, 12) for k, w in total.items() if abs(w) > 1e-12} == ends


@pytest.fixture(scope="module")
def monthly():
    rng, rows = np.random.default_rng(4), []
    for month in range(80):
        for v in lattice.variants():
            for f in lattice.FACTORS:
                value = float(rng.normal(0.03 if v["variant"] == "A2_base" else 0.0, 0.05))
                if f in ("momentum", "low_vol") and v["variant"] in ("A2_base", "A1_pit_report_end"):
                    value = 0.01 * month
                rows.append((f"{2010 + month // 12}-{month % 12 + 1:02d}-01", v["variant"], f, None if month == 7 and v["variant"] == "A2_base" else value))
    rows += [(f"2010-{m:02d}-01", f"timing:{s}", "roe", 0.1 * m) for m in range(1, 6) for s in estimands.TIMING_STEPS]
    return rows


def test_contrasts_are_weighted_sums(spark, monthly):
    listed = estimands.registered()
    values = {(d, v, f): x for d, v, f, x in monthly}
    got = {(r.estimand, r.date): r.value for r in estimands.contrasts(spark.createDataFrame(monthly, CELLS), listed).collect()}
    for e in listed:
        for d in {x[0] for x in monthly}:
            terms = [values.get((d, v, f)) for v, f in e.terms]
            want = sum(w * x for w, x in zip(e.terms.values(), terms)) if None not in terms else None
            found = got.get((e.name, d))
            assert (found is None) == (want is None) and (want is None or math.isclose(found, want, abs_tol=1e-12))


def test_gate_and_families(spark, monthly):
    listed = estimands.registered()
    months = estimands.contrasts(spark.createDataFrame(monthly, CELLS), listed).cache()
    gate = lambda x: spark.createDataFrame([(x,)], "passed boolean")
    rows = {r.estimand: r for r in estimands.summaries(months, listed, gate(True)).collect()}
    assert len(rows) == 31 and rows["P1_roe_publication"].months == 79 and rows["P1_roe_publication"].unmatched == 1 and rows["P1_roe_publication"].not_estimable == 1
    assert rows["P1_roe_publication"].may_claim and rows["P1_roe_publication"].rejects and rows["P1_roe_publication"].adjusted_p == rows["P1_roe_publication"].p_value
    # the controls' differences are nothing, but one month lacks a side
    assert rows["C_isolation_momentum"].isolated is False
    assert not rows["C_isolation_momentum"].may_claim and rows["S_timing_record_replacement"].months == 5 and not rows["S_timing_record_replacement"].may_claim
    p = sorted((r.p_value, r.adjusted_p) for r in rows.values() if r.family == "secondary" and r.p_value is not None)
    assert p[0][1] <= 28 * p[0][0] + 1e-12 and all(a[1] <= b[1] + 1e-12 for a, b in zip(p, p[1:]))
    for shut in (False, None):
        assert not any(r.may_claim or r.rejects for r in estimands.summaries(months, listed, gate(shut)).collect())
    whole = estimands.contrasts(spark.createDataFrame([r for r in monthly if "2010-08" not in r[0]], CELLS), listed)
    assert all(r.isolated for r in estimands.summaries(whole, listed, gate(True)).filter("family = 'control'").collect())
    none = estimands.summaries(months.limit(0), listed, gate(True)).collect()
    assert len(none) == 31 and all(r.months == 0 and not r.may_claim and r.isolated is None for r in none)


REGISTRY = [("a", "x"), ("b", "x")]


def judged(spark, rows, months=("2020-01-01", "2020-02-01"), complete=2, kind="real_market_data"):
    cells = spark.createDataFrame(rows, "date string, variant string, factor string, ic double, spread double, n long, unresolved long").withColumn("date", F.to_date("date"))
    wanted = spark.createDataFrame([(m,) for m in months], "month string").withColumn("month", F.to_date("month"))
    days = evidence.monthly_cells(cells, spark.createDataFrame(REGISTRY, "variant string, factor string"), 5)
    return evidence.status(days, wanted, kind, complete).first()


def test_every_evidence_code_is_reached(spark):
    whole = [(f"2020-0{m}-03", v, "x", 0.1, 0.2, 9, 0) for m in (1, 2) for v in "ab"]
    good = judged(spark, whole)
    assert (good.code, good.reasons, good.passed, good.complete_dates, good.smallest_section) == ("REAL_MARKET_REGISTERED_HISTORICAL_IC_CORE_STATISTICS", "", True, 2, 9)
    assert judged(spark, whole, kind="synthetic").reasons == "SYNTHETIC_DATA"
    assert judged(spark, whole, months=("2020-01-01",)).reasons == "MISSING_REGISTERED_REBALANCES"
    assert judged(spark, whole, complete=3).reasons == "INSUFFICIENT_COMPLETE_REGISTERED_REBALANCES"
    assert judged(spark, whole[:3] + [("2020-02-03", "b", "x", 0.1, 0.2, 9, 1)]).reasons == "UNRESOLVED_FORWARD_ENDPOINTS"
    lacking = "INCOMPLETE_REGISTERED_MONTHLY_CELLS,INSUFFICIENT_COMPLETE_REGISTERED_REBALANCES"
    for last in ([], [("2020-02-03", "b", "x", None, 0.2, 9, 0)], [("2020-02-03", "b", "x", 0.1, 0.2, 4, 0)], [("2020-02-03", "c", "x", 0.1, 0.2, 9, 0)], [("2020-02-03", "a", "x", 0.1, 0.2, 9, 0)]):
        assert judged(spark, whole[:3] + last).reasons == lacking
    nothing = judged(spark, [])
    assert not nothing.passed and nothing.reasons == "MISSING_REGISTERED_REBALANCES,INSUFFICIENT_COMPLETE_REGISTERED_REBALANCES"
    early = spark.range(1).select(*(evidence.early_status(k, s, r, 10, 12).alias(k) for k, s, r in (("real_market_data", 10, 12), ("synthetic", 9, 11)))).first()
    assert early.real_market_data == "" and early.synthetic == "SYNTHETIC_DATA,INSUFFICIENT_SYMBOL_COVERAGE,INSUFFICIENT_OOS_REBALANCES"


def test_bitmap_sets_are_sets(spark):
    rng = np.random.default_rng(1)
    rows = [(int(d), side, int(k)) for d in range(4) for side in ("a", "b", "c") for k in rng.integers(0, 90_000, 300)] + [(9, "a", 5), (9, "a", 5), (8, "b", None)]
    df = spark.createDataFrame(rows, "date int, side string, symbol long")
    places = bitmaps.dictionary(spark.range(90_000).withColumnRenamed("id", "symbol"), "symbol")
    sets = bitmaps.build(df, places, "symbol", ["date", "side"]).cache()
    want = {}
    for d, side, k in rows:
        if k is not None:
            want.setdefault(d, {"a": set(), "b": set(), "c": set()})[side].add(k)
    for r in bitmaps.algebra(sets, ["date"], "side", "a", "b").collect():
        a, b = want[r.date]["a"], want[r.date]["b"]
        assert (r.n_a, r.n_b, r.both, r.either, r.only_a, r.only_b, r.one_side) == (len(a), len(b), len(a & b), len(a | b), len(a - b), len(b - a), len(a ^ b))
    back = {(r.date, r.side, r.symbol) for r in bitmaps.members(sets, places, "symbol", ["date", "side"]).collect()}
    assert back == {x for x in rows if x[2] is not None} and sets.count() > 12
    with pytest.raises(Exception, match="not in the dictionary"):
        bitmaps.build(df.withColumn("symbol", F.lit(-1)), places, "symbol", ["date"]).collect()
