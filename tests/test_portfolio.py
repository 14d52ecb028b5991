import datetime as dt

import pytest

from tidemark.operators import portfolio


def run(spark, rows, rules, positions=1, slippage=0.0):
    panel = spark.createDataFrame(rows, "date date, symbol long, open double, close double, buy_block string, sell_block string, rebalance boolean, target_rank int")
    cases = spark.createDataFrame([("base", positions, slippage)], "scenario string, positions int, slippage_bps double")
    return portfolio.simulate(panel, cases, rules)


def day(n):
    return dt.date(2024, 1, n)


def test_fills_at_the_next_open(spark):
    rows = [(day(1), 1, 9.0, 10.0, None, None, True, 1), (day(2), 1, 20.0, 21.0, None, None, False, None)]
    out = run(spark, rows, portfolio.Rules(cash=1000.0, commission=0.0, stamp_tax=0.0, lot=10)).collect()
    (order,) = [r for r in out if r.record == "order"]
    assert (order.date, order.price, order.shares, order.status, order.signal_date) == (day(2), 20.0, 50, "filled", day(1))
    assert [r.value for r in out if r.record == "equity"] == [1000.0, 1050.0]


def test_final_signal_stays_unfilled_and_blocks_hold(spark):
    rows = [(day(1), 1, 9.0, 10.0, None, None, True, 1), (day(2), 1, 10.0, 10.0, "blocked_limit_up", None, True, 1)]
    out = run(spark, rows, portfolio.Rules(cash=1000.0)).collect()
    assert sorted(r.status for r in out if r.record == "order") == ["blocked_limit_up", "unfilled_end"]


def test_stop_sells_and_metrics(spark):
    rows = [(day(1), 1, 10.0, 10.0, None, None, True, 1), (day(2), 1, 10.0, 5.0, None, None, False, None), (day(3), 1, 5.0, 5.0, None, None, False, None)]
    records = run(spark, rows, portfolio.Rules(cash=1000.0, commission=0.0, stamp_tax=0.0, stop_loss=-0.1))
    assert [r.side for r in records.filter("record = 'order'").orderBy("date").collect()] == ["buy", "sell"]
    row = portfolio.metrics(records).first()
    assert row.total_return == pytest.approx(-0.5) and row.fills == 2 and row.max_drawdown == pytest.approx(-0.5)
