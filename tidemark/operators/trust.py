"""How far data and results can be trusted: quality of panels, validation of a master, audit of results, walk-forward windows.

Rules are rows of a table: a name, a measure and a test against a bound, so a
verdict is an aggregate, an array of broken rules and a look at it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import indicator, ratio, rolling

#: The form of a symbol, first digits of B shares by exchange, and names of the A share's type.
SYMBOL, B_SHARES, A_TYPES = r"^\d{6}\.(SH|SZ|BJ)$", r"^(900\d{3}\.SH|200\d{3}\.SZ)$", ("", "A", "A股", "ASHARE", "A-SHARE", "NAN", "NONE")


@dataclass(frozen=True)
class Rule:
    """``measure`` is an SQL expression over one row of measures; it has to be ``least`` or more, and ``most`` or less."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    hard: bool = True

    def broken(self) -> Column:
        """True where the measure is out of bounds or unknown."""
        x, ok = F.expr(self.measure), F.lit(True)
        if self.least is not None:
            ok = ok & (x >= self.least)
        if self.most is not None:
            ok = ok & (x <= self.most)
        return ~F.coalesce(ok, F.lit(False))


def broken_rules(measures: DataFrame, rules: list[Rule]) -> DataFrame:
    """``measures`` with ``hard`` and ``soft``, the names of broken rules of either kind in the rules' order."""
    names = lambda hard: F.array_compact(F.array(*(F.when(r.broken(), F.lit(r.name)) for r in rules if r.hard is hard)))
    return measures.withColumns({"hard": names(True), "soft": names(False)})


def panel_quality(panel: DataFrame, by: list[str], as_of: str, columns: tuple[str, ...] = ("date", "symbol", "open", "high", "low", "close", "amount")) -> DataFrame:
    """(by, n_rows, symbols, latest, age_days, null_close, null_amount, repeated_keys, status) of each group's panel.

    The status is the first that applies: empty, missing_columns (of
    ``columns``), stale (over five days at ``as_of``), warn (over 1 % of closes
    or 5 % of amounts missing, or a repeated key), ok.
    """
    lacking = [c for c in columns if c not in panel.columns]
    missing = lambda c: F.count_if(F.col(c).isNull()) if c in panel.columns else F.lit(None).cast("long")
    keys = panel.groupBy(*by, "symbol", "date").agg(F.count("*").alias("n"), missing("close").alias("c"), missing("amount").alias("a"))
    out = keys.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count_distinct("symbol").alias("symbols"), F.max("date").alias("latest"), ratio(F.sum("c"), F.sum("n")).alias("null_close"), ratio(F.sum("a"), F.sum("n")).alias("null_amount"), F.sum(F.col("n") - 1).alias("repeated_keys"))
    out = out.withColumn("age_days", F.datediff(F.lit(as_of).cast("date"), "latest"))
    warn = (F.col("null_close") > 0.01) | (F.col("null_amount") > 0.05) | (F.col("repeated_keys") > 0)
    status = F.when(F.col("n_rows") == 0, "empty").when(F.lit(bool(lacking)), "missing_columns").when(F.col("age_days") > 5, "stale").when(warn, "warn").otherwise("ok")
    return out.withColumn("status", status)


def master_rules(least_rows: int, least_symbols: int, least_delisted: int) -> list[Rule]:
    """Checks of a historical stock master; the last two are warnings."""
    return [
        Rule("row_coverage", "n_rows", least_rows), Rule("unique_symbol_coverage", "unique_symbols", least_symbols), Rule("symbol_format", "valid_rate", 0.98), Rule("duplicate_symbols", "duplicates", most=0),
        Rule("list_date_coverage", "list_date_rate", 0.95), Rule("delisted_security_coverage", "delisted", least_delisted), Rule("exchange_coverage", "least(in_sh, in_sz)", 1), Rule("a_share_rows_only", "other_shares", most=0),
        Rule("a_share_type_coverage", "typed_rate", 0.95, hard=False), Rule("eligible_period_symbols", "eligible", min(100, least_symbols), hard=False),
    ]


def master_measures(master: DataFrame, start: str, end: str) -> DataFrame:
    """One row of figures of a master (symbol, list_date, delist_date, stock_type); eligible ones were listed at some time from ``start`` to ``end``."""
    s, kind = F.coalesce("symbol", F.lit("")), F.upper(F.coalesce("stock_type", F.lit("")))
    valid = s.rlike(SYMBOL)
    alive = (F.col("list_date") <= F.lit(end).cast("date")) & (F.col("delist_date").isNull() | (F.col("delist_date") >= F.lit(start).cast("date")))
    per_symbol = master.groupBy(s.alias("symbol")).agg(
        F.count("*").alias("n"), F.count("list_date").alias("dated"), F.count("delist_date").alias("gone"), F.count_if(s.rlike(B_SHARES) | ~kind.isin(*A_TYPES)).alias("other"),
        F.count_if(kind.isin("A", "A股", "ASHARE", "A-SHARE")).alias("typed"), F.bool_or(F.coalesce(alive, F.lit(False))).alias("alive"),
    )
    good, code = F.col("symbol").rlike(SYMBOL), F.element_at(F.split("symbol", r"\."), -1)
    total = F.sum("n")
    rate = lambda x: F.when(total > 0, x / total).otherwise(0.0)
    return per_symbol.agg(
        F.coalesce(total, F.lit(0)).alias("n_rows"), F.count_if(good).alias("unique_symbols"), rate(F.sum(F.when(good, F.col("n")).otherwise(0))).alias("valid_rate"), F.coalesce(F.sum(F.when(F.col("symbol") != "", F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        rate(F.sum("dated")).alias("list_date_rate"), F.coalesce(F.sum("gone"), F.lit(0)).alias("delisted"), F.count_if(good & (code == "SH")).alias("in_sh"), F.count_if(good & (code == "SZ")).alias("in_sz"),
        F.coalesce(F.sum("other"), F.lit(0)).alias("other_shares"), rate(F.sum("typed")).alias("typed_rate"), F.count_if(good & F.col("alive")).alias("eligible"),
    )


def master_status(checked: DataFrame) -> DataFrame:
    """``status`` of ``broken_rules``: invalid with a hard rule broken, else needs_review with a soft one, else production_ready."""
    return checked.withColumn("status", F.when(F.size("hard") > 0, "invalid").when(F.size("soft") > 0, "needs_review").otherwise("production_ready"))


#: Red flags (hard) and warnings of a result; a warning's bound is looked at only where its red flag isn't raised.
AUDIT = [
    Rule("trade_count", "trades", 30), Rule("drawdown", "max_drawdown", -0.30), Rule("annualized_return", "-annualized", most=-1e-12), Rule("years_tested", "years", 0.75), Rule("factor_coverage", "coverage", 0.70),
    Rule("positive_years", "positive_years - greatest(1, n_years div 2)", 0), Rule("stress_half", "CASE WHEN annualized > 0 THEN stressed - annualized * 0.5 ELSE 0 END", 0), Rule("stress_positive", "-stressed", most=-1e-12),
    Rule("turnover", "turnover", most=24, hard=False), Rule("few_years", "CASE WHEN years < 0.75 THEN 3 ELSE years END", 3, hard=False), Rule("thin_factor", "CASE WHEN coverage < 0.70 THEN 1 ELSE coverage END", 0.90, hard=False),
]


def audit(results: DataFrame) -> DataFrame:
    """``results`` (a row each, with the measures of ``AUDIT``) with ``hard``, ``soft`` and ``verdict``: two red flags abandon, one or a warning refines."""
    out = broken_rules(results, AUDIT)
    verdict = F.when(F.size("hard") >= 2, "abandon").when((F.size("hard") == 1) | (F.size("soft") > 0), "refine").otherwise("deploy_simulation")
    return out.withColumn("verdict", verdict)


def window_results(returns: DataFrame, windows: DataFrame, by: list[str], year: float) -> DataFrame:
    """Each window's and group's train and test figures, out-of-sample ratio, decay and status.

    ``returns`` has (by, date, r, trades), ``windows`` the bounds of
    ``portfolio.walk_forward_windows``, a few rows. A row of returns falls into
    the windows that hold its date; sums of logarithms are combined before any
    shuffle. ``year`` is how many dates a year has.
    """
    held = returns.join(F.broadcast(windows), (F.col("date") >= F.col("train_start")) & (F.col("date") < F.col("test_end")))
    test = F.col("date") >= F.col("test_start")
    side = lambda name, ok: [F.sum(F.when(ok, F.log1p("r"))).alias(f"{name}_log"), F.count(F.when(ok, F.col("r"))).alias(f"{name}_n"), F.coalesce(F.sum(F.when(ok, F.col("trades"))), F.lit(0)).alias(f"{name}_trades")]
    out = held.groupBy(*by, "window_id").agg(*side("train", ~test), *side("test", test))
    annual = lambda name: F.when(F.col(f"{name}_n") > 0, F.exp(F.col(f"{name}_log") * year / F.col(f"{name}_n")) - 1)
    out = out.withColumns({"train_annualized": annual("train"), "test_annualized": annual("test")})
    train, tested = F.col("train_annualized"), F.col("test_annualized")
    status = F.when(train.isNull() | tested.isNull(), "error").when(tested <= 0, "failed_oos").when((train > 0) & (tested < train * 0.5), "weak_oos").when(F.col("test_trades") < 10, "low_trade_sample").otherwise("ok")
    return out.withColumns({"oos_ratio": F.when(train > 0, tested / train), "return_decay": tested - train, "status": status}).select(*by, "window_id", "train_n", "test_n", "test_trades", "train_annualized", "test_annualized", "oos_ratio", "return_decay", "status")


def walk_forward_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, windows, positive_share, failed, median_ratio) over the windows without errors."""
    fine = F.col("status") != "error"
    return results.groupBy(*by).agg(F.count_if(fine).alias("windows"), F.avg(F.when(fine, indicator(F.col("test_annualized") > 0))).alias("positive_share"), F.count_if(F.col("status") == "failed_oos").alias("failed"), F.median("oos_ratio").alias("median_ratio"))


def alpha_health(panel: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    """Per date: breadths over 12 and 24 rows, shares above the mean and of small drawdowns, medians of ``scores``, their mean clipped to 0..1, and all of them a date before."""
    share = lambda c, bound: F.avg(F.when(F.col(c).isNotNull(), indicator(F.col(c) > bound)))
    parts = {"breadth_12": share("momentum_12", 0.0), "breadth_24": share("momentum_24", 0.0), "above_mean": share("mean_gap_12", 0.0), "drawdown_ok": share("drawdown_24", -0.20)} | {f"{s}_median": F.median(s) for s in scores}
    days = panel.groupBy("date").agg(*(x.alias(c) for c, x in parts.items()))
    known = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in parts), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("int") for c in parts), F.lit(0))
    days = days.withColumn("alpha_health", F.when(count > 0, F.least(F.greatest(known / count, F.lit(0.0)), F.lit(1.0))))
    w = Window.orderBy("date")
    return days.withColumns({f"{c}_lag1": F.lag(c).over(w) for c in (*parts, "alpha_health")})


def regime_trends(index: DataFrame, means: tuple[tuple[int, int], ...] = ((24, 12), (40, 24)), changes: tuple[int, ...] = (4, 12, 24)) -> DataFrame:
    """An index's regime a date before: for each mean of (rows, least rows) whether it was above, and its changes; NULL where unknown."""
    w = Window.orderBy("date")
    close = F.col("close")
    named = {f"mean_{n}": rolling(F.avg, close, n, least, w) for n, least in means} | {f"momentum_{k}": ratio(close, F.lag(close, k).over(w)) - 1 for k in changes}
    out = index.withColumns(named)
    out = out.withColumns({f"{c}_lag1": F.lag(c).over(w) for c in ("close", *named)})
    above = lambda n: F.when(F.col("close_lag1").isNotNull() & F.col(f"mean_{n}_lag1").isNotNull(), indicator(F.col("close_lag1") > F.col(f"mean_{n}_lag1")))
    return out.select("date", *(above(n).alias(f"trend_{n}_lag1") for n, _ in means), *(f"mean_{n}_lag1" for n, _ in means), *(f"momentum_{k}_lag1" for k in changes))
