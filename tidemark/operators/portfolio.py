"""Portfolio simulation: rule-based fills with frictions, one fold over the dates for each scenario.

All that doesn't depend on cash or positions (ranks, targets, block reasons,
limits) comes precomputed in the panel; the fold keeps cash, positions and
stops. Scenarios are independent groups, so they run side by side, and a group
holds only the symbols that are ever targets.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio


@dataclass(frozen=True)
class Rules:
    """Costs and limits of a simulation; scenarios may override ``positions`` and ``slippage_bps``."""

    cash: float = 1_000_000.0
    cash_yield: float = 0.0
    max_weight: float = 1.0
    commission: float = 0.0003
    stamp_tax: float = 0.0005
    lot: int = 1
    stop_loss: float | None = None
    cooldown_days: int = 0
    periods: float = 52.0


FOLD = "scenario string, record string, date date, symbol long, side string, status string, shares long, price double, value double, cash double, signal_date date"


class _Book:
    """Cash and holdings of one scenario, and the records they leave."""

    def __init__(self, scenario: str, rules: Rules, slippage: float):
        self.scenario, self.rules, self.slip = scenario, rules, slippage / 1e4
        self.cash, self.shares, self.entry, self.bought, self.until, self.out = rules.cash, {}, {}, {}, {}, []

    def note(self, record, date, symbol=None, side=None, status=None, shares=0, price=None, value=None, signal=None):
        self.out.append((self.scenario, record, date, symbol, side, status, shares, price, value, self.cash, signal))

    def sell(self, date, symbol, shares, bar, signal) -> None:
        blocked = "blocked_missing_price" if bar is None else bar["sell_block"]
        if blocked is None and self.bought.get(symbol) == date:
            blocked = "blocked_t_plus_one"
        if blocked:
            return self.note("order", date, symbol, "sell", blocked, shares, signal=signal)
        price = bar["open"] * (1 - self.slip)
        gross = price * shares
        self.cash += gross * (1 - self.rules.commission - self.rules.stamp_tax)
        self.shares[symbol] -= shares
        if not self.shares[symbol]:
            self.shares.pop(symbol), self.entry.pop(symbol)
        self.note("order", date, symbol, "sell", "filled", shares, price, gross, signal)

    def buy(self, date, symbol, wanted, bar, signal) -> None:
        blocked = "blocked_missing_price" if bar is None else bar["buy_block"]
        if blocked:
            return self.note("order", date, symbol, "buy", blocked, 0, signal=signal)
        price = bar["open"] * (1 + self.slip)
        lot = self.rules.lot
        shares = int(min(wanted, self.cash) / (price * (1 + self.rules.commission)) // lot) * lot
        if shares <= 0:
            return self.note("order", date, symbol, "buy", "too_small", 0, signal=signal)
        gross, held = price * shares, self.shares.get(symbol, 0)
        self.cash -= gross * (1 + self.rules.commission)
        self.entry[symbol] = (self.entry.get(symbol, 0.0) * held + gross) / (held + shares)
        self.shares[symbol], self.bought[symbol] = held + shares, date
        self.note("order", date, symbol, "buy", "filled", shares, price, gross, signal)


def fold(frame: pd.DataFrame, rules: Rules) -> list[tuple]:
    """Replay one scenario: orders decided at a close fill at the next session's open, sells first, then buys by rank."""
    first = frame.iloc[0]
    book, positions = _Book(first["scenario"], rules, float(first["slippage_bps"])), int(first["positions"])
    pending = stops = None
    daily = (1 + rules.cash_yield) ** (1 / rules.periods) - 1
    for number, (date, rows) in enumerate(frame.sort_values(["date", "symbol"]).groupby("date", sort=True)):
        bars = {r["symbol"]: {k: (None if pd.isna(v) else v) for k, v in r.items()} for r in rows.to_dict("records")}
        if number and book.cash > 0:
            book.cash *= 1 + daily
        left = {}
        for symbol, signal in (stops or {}).items():
            if symbol in book.shares:
                book.sell(date, symbol, book.shares[symbol], bars.get(symbol), signal)
                if symbol in book.shares:
                    left[symbol] = signal  # tried again until filled
                else:
                    book.until[symbol] = date + pd.Timedelta(days=rules.cooldown_days)
        stops = left
        if pending:
            targets, signal = pending
            nav = book.cash + sum(n * (bars[s]["open"] or 0.0) for s, n in book.shares.items() if s in bars)
            each = nav * min(1 / positions, rules.max_weight)
            for symbol in list(book.shares):
                price = bars[symbol]["open"] if symbol in bars else None
                surplus = book.shares[symbol] - (int(each / price // rules.lot) * rules.lot if symbol in targets and price else 0)
                if surplus > 0:
                    book.sell(date, symbol, surplus, bars.get(symbol), signal)
            for symbol in targets:
                bar = bars.get(symbol)
                held = book.shares.get(symbol, 0) * ((bar or {}).get("open") or 0.0)
                if each > held:
                    book.buy(date, symbol, each - held, bar, signal)
            pending = None
        value = sum(n * bars[s]["close"] for s, n in book.shares.items() if s in bars)  # absent today: worth nothing
        book.note("equity", date, value=book.cash + value, shares=len(book.shares))
        if rules.stop_loss is not None:
            for symbol in book.shares:
                if symbol in bars and bars[symbol]["close"] / book.entry[symbol] - 1 <= rules.stop_loss:
                    stops.setdefault(symbol, date)
        if rows["rebalance"].any():
            ranked = rows[(rows["target_rank"] <= positions)].sort_values("target_rank")["symbol"]
            pending = ([s for s in ranked if not (s in book.until and book.until[s] >= date)], date)
    if pending:
        for symbol in pending[0]:
            book.note("order", pending[1], symbol, "buy", "unfilled_end", 0, signal=pending[1])
    return book.out


def simulate(panel: DataFrame, scenarios: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Equity and order records per scenario.

    ``panel``: date, symbol, open, close, buy_block, sell_block, rebalance,
    target_rank. ``scenarios``: scenario, positions, slippage_bps (a few rows).
    """
    ever = panel.filter("target_rank IS NOT NULL").select("symbol").distinct()
    dates = panel.groupBy("date").agg(F.bool_or("rebalance").alias("rebalance"))
    rows = panel.drop("rebalance").join(ever, "symbol", "left_semi").join(dates, "date", "right")
    rows = rows.crossJoin(F.broadcast(scenarios))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(frame, rules), columns=[x.split()[0] for x in FOLD.split(", ")])

    return rows.groupBy("scenario").applyInPandas(run, FOLD)


def metrics(records: DataFrame, periods: float = 52.0) -> DataFrame:
    """Per scenario: return, annualised return, drawdown, volatility, Sharpe ratio, fills, turnover."""
    w = Window.partitionBy("scenario").orderBy("date")
    equity = records.filter("record = 'equity'").select("scenario", "date", "value")
    equity = equity.withColumns({"r": F.coalesce(ratio(F.col("value"), F.lag("value").over(w)) - 1, F.lit(0.0)), "peak": F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    years = F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1)) / 365.25
    base = equity.groupBy("scenario").agg((F.max_by("value", "date") / F.min_by("value", "date")).alias("growth"), years.alias("years"), F.min(F.col("value") / F.col("peak") - 1).alias("max_drawdown"), (F.stddev_samp("r") * periods**0.5).alias("volatility"), F.avg("value").alias("mean_equity"))
    orders = records.filter("record = 'order'").groupBy("scenario").agg(F.count_if(F.col("status") == "filled").alias("fills"), F.count_if(F.col("status").startswith("blocked")).alias("blocked"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("traded"))
    out = base.join(orders, "scenario", "left")
    annual = F.pow("growth", 1 / F.col("years")) - 1
    return out.select("scenario", (F.col("growth") - 1).alias("total_return"), annual.alias("annual_return"), "max_drawdown", "volatility", F.when(F.col("volatility") > 0, annual / F.col("volatility")).otherwise(0.0).alias("sharpe"), F.coalesce("fills", F.lit(0)).alias("fills"), F.coalesce("blocked", F.lit(0)).alias("blocked"), F.coalesce(F.col("traded") / F.col("mean_equity"), F.lit(0.0)).alias("turnover"))


def yearly_returns(records: DataFrame) -> DataFrame:
    """Last over first equity of each year, less one, per scenario."""
    rows = records.filter("record = 'equity'").groupBy("scenario", F.year("date").alias("year"))
    return rows.agg((F.max_by("value", "date") / F.min_by("value", "date") - 1).alias("return"))


def sensitivity_scenarios(spark, positions: int, slippage: float) -> DataFrame:
    """Base case, other numbers of positions, and double and triple slippage, each once."""
    cases = {"base": (positions, slippage), "fewer": (max(1, positions // 2), slippage), "more": (positions * 3 // 2, slippage), "slippage_x2": (positions, 2 * slippage), "slippage_x3": (positions, 3 * slippage)}
    return spark.createDataFrame([(k, *v) for k, v in cases.items()], "scenario string, positions int, slippage_bps double")


def walk_forward_windows(dates: DataFrame, train_months: int = 6, test_months: int = 3, step_months: int = 3) -> DataFrame:
    """(window_id, train_start, test_start, test_end): windows that fit between the first and the last date."""
    span = dates.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    count = F.greatest(F.floor((F.months_between("b", "a") - train_months - test_months) / step_months), F.lit(-1))
    rows = span.filter(count >= 0).select("a", "b", F.explode(F.sequence(F.lit(0), count.cast("int"))).alias("window_id"))
    start = F.add_months("a", F.col("window_id") * step_months)
    return rows.select("window_id", start.alias("train_start"), F.add_months(start, train_months).alias("test_start"), F.add_months(start, train_months + test_months).alias("test_end"))
