"""Coverage, integrity and quality counts of tables, and gates over one row for each run: all single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed form of a number: sign, digits with or without a fraction, exponent.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: What the source of real data holds, against samples (fixed values: an archive's tables, a vendor's).
REAL_SOURCES = ("historical_asset:", "investoday:")
_FROM_REAL = " OR ".join(f"contains(source, '{x}')" for x in REAL_SOURCES)
#: The gate's checks, as conditions on a run's figures (fixed values; a missing figure counts as 0, an unknown check as failed).
GATE_RULES = {
    "real_data": _FROM_REAL,
    "pit_universe": "contains(source, 'pit_liquidity_universe')",
    "stock_master": "contains(source, 'pit_stock_master_filter')",
    "production_data": "production_ready",
    "benchmark": "aligned_days > 0",
    "walk_forward": "walk_positive >= 0.75 AND walk_failed = 0",
    "factor_ic": "supportive >= 1 AND adverse = 0",
    "bias_diagnostics": "bias_status IN ('ok', 'warn') AND bias_score >= 70 AND bias_failed = 0",
    "drawdown": "max_drawdown >= -0.25",
    "trade_sample": "trade_count >= 100",
    "audit": "verdict IS DISTINCT FROM 'abandon'",
}
#: The score's parts: points, and the share of them that a run gets, cut to 0..1 (fixed values).
SCORE_PARTS = {
    "return": (12.0, "annualized / 0.30D"),
    "drawdown": (12.0, "(0.30D + max_drawdown) / 0.25D"),
    "risk_adjusted": (14.0, "IF(information_ratio <> 0, information_ratio / 1.5D, least(greatest(sharpe / 1.5D, 0D), 1D) * 8 / 14)"),
    "walk_forward": (15.0, "IF(walk_windows > 0, least(greatest(walk_positive, 0D), 1D) - least(walk_failed, walk_windows) / walk_windows * 6 / 15, 0D)"),
    "factor_ic": (15.0, "(least(greatest(supportive / 2, 0D), 1D) * 9 + least(greatest(best_t / 2, 0D), 1D) * 4 - least(adverse, 3D) * 2) / 15"),
    "sample_size": (10.0, "trade_count / 200"),
    "concentration": (8.0, "IF(top_weight > 0, (0.45D - top_weight) / 0.30D, 0.5D)"),
    "data_quality": (10.0, "data_points / 10"),
    "decision_gate": (6.0, "passed / (passed + failed)"),
    "bias": (6.0, "IF(bias_failed > 0, least(bias_score / 100, 2D / 6), bias_score / 100)"),
}
#: Most points of abandoned runs and of those that the gate holds back, and the bands from their least points on.
CAPS, BANDS = {"abandon": 45.0, "research_only": 80.0, "all": 100.0}, {"strong_watch": 75.0, "watch": 60.0, "weak_watch": 45.0}
_FIGURES = ("aligned_days", "walk_positive", "walk_windows", "walk_failed", "supportive", "adverse", "bias_score", "bias_failed", "max_drawdown", "trade_count", "annualized", "information_ratio", "sharpe", "best_t", "top_weight", "data_points")
SYMBOL = r"^[0-9]{6}\.(SH|SZ)$"


def bad_price() -> Column:
    """A price that is missing, not above 0, or outside of its day's range."""
    bad = F.col("high") < F.col("low")
    for c in ("open", "high", "low", "close"):
        bad = F.coalesce(bad, F.lit(False)) | F.col(c).isNull() | F.coalesce(F.col(c) <= 0, F.lit(False))
    outside = (F.col("close") > F.col("high") * 1.000001) | (F.col("close") < F.col("low") * 0.999999)
    return bad | F.coalesce(outside, F.lit(False))


def quote_coverage(quotes: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: expected symbols covered, missing and extra, shares of dates by symbol, bad and repeated rows."""
    per_key = quotes.groupBy("symbol", "date").agg(F.count("*").alias("n"), F.count_if(bad_price()).alias("bad"), F.count_if((F.col("volume") < 0) | (F.col("amount") < 0)).alias("negative"))
    per_symbol = per_key.groupBy("symbol").agg(F.count("date").alias("dates"), F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("bad").alias("bad"), F.sum("negative").alias("negative"), F.min("date").alias("a"), F.max("date").alias("b"))
    days = quotes.agg(F.count_distinct("date").alias("days"))
    both = per_symbol.join(expected.select("symbol", F.lit(True).alias("wanted")).distinct(), "symbol", "full").crossJoin(F.broadcast(days))
    seen, wanted = F.col("n").isNotNull(), F.col("wanted").isNotNull()
    share = F.when(seen, F.col("dates") / F.col("days"))
    return both.agg(
        F.sum("n").alias("n_rows"), F.count_if(seen).alias("unique_symbols"), F.count_if(wanted).alias("expected_symbols"), F.count_if(seen & wanted).alias("covered"), F.count_if(~seen & wanted).alias("missing"), F.count_if(seen & ~wanted).alias("extra"),
        F.max("days").alias("trading_dates"), F.median(share).alias("median_date_share"), F.min(share).alias("min_date_share"), F.sum("repeated").alias("repeated_keys"), F.sum("bad").alias("bad_prices"), F.sum("negative").alias("negative_amounts"), F.min("a").alias("min_date"), F.max("b").alias("max_date"),
    )


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_rows, non_null, symbols, coverage, symbol_coverage): one pass by symbol, then one row for each field."""
    per_symbol = rows.groupBy("symbol").agg(F.count("*").alias("n"), *(F.count(f).alias(f) for f in fields))
    total = per_symbol.agg(F.sum("n").alias("n_rows"), F.count("*").alias("_all"), *(F.sum(f).alias(f) for f in fields), *(F.count_if(F.col(f) > 0).alias(f"_{f}") for f in fields))
    named = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("non_null"), F.col(f"_{f}").alias("symbols")) for f in fields))).alias("x")
    return total.select("n_rows", "_all", named).select("x.field", "n_rows", "x.non_null", "x.symbols", (F.col("x.non_null") / F.col("n_rows")).alias("coverage"), (F.col("x.symbols") / F.col("_all")).alias("symbol_coverage"))


def asset_metrics(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row for an asset: rows, symbols, dates, first and last date, repeated keys, values of each field."""
    keys = rows.groupBy("symbol", "date").agg(F.count("*").alias("n"), *(F.count(f).alias(f) for f in fields))
    return keys.agg(F.sum("n").alias("n_rows"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("date").alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum(F.col("n") - 1).alias("repeated_keys"), *(F.sum(f).alias(f"n_{f}") for f in fields))


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, median, quartiles (by linear interpolation) and maximum of each key."""
    at = lambda q: F.percentile(value, q)
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), at(0.5).alias("median"), at(0.25).alias("p25"), at(0.75).alias("p75"), F.max(value).alias("maximum"))


def numeric_integrity(raw: DataFrame, positive: list[str], at_least_zero: list[str]) -> DataFrame:
    """One row: blank, malformed, non-finite and out-of-range texts of each field, and whether there are none."""
    parts, bad = [], F.lit(0)
    for f in [*positive, *at_least_zero]:
        text = F.coalesce(f, F.lit(""))
        fits, value = text.rlike(NUMBER), F.col(f).try_cast("double")
        checks = {"blank": text == "", "malformed": (text != "") & ~fits, "non_finite": fits & (F.abs(value) == float("inf")), "out_of_range": fits & (F.abs(value) != float("inf")) & ((value <= 0) if f in positive else (value < 0))}
        parts += [F.count_if(c).alias(f"{f}_{k}") for k, c in checks.items()]
        for c in checks.values():
            bad = bad + F.count_if(c)
    return raw.agg(F.count("*").alias("n_rows"), *parts, (bad == 0).alias("verified"))


def boolean_integrity(raw: DataFrame, fields: list[str]) -> DataFrame:
    """One row: blank and unknown tokens of each flag, and how many are set."""
    token = lambda f: F.lower(F.trim(F.coalesce(f, F.lit(""))))
    return raw.agg(F.count("*").alias("n_rows"), *(x for f in fields for x in (F.count_if(token(f) == "").alias(f"{f}_blank"), F.count_if(~token(f).isin("", "true", "false", "1", "0")).alias(f"{f}_unknown"), F.count_if(token(f).isin("true", "1")).alias(f"{f}_set"))))


def adjustment_integrity(rows: DataFrame, method: str, unit: str, tolerance: float = 1e-12) -> DataFrame:
    """One row: adjusted closes that aren't raw close times factor, other methods and units than the agreed ones."""
    expected = F.col("close_raw") * F.col("adjustment_factor")
    known = (F.col("close_raw") > 0) & (F.col("adjustment_factor") > 0) & (F.col("close") > 0)
    apart = F.abs(F.col("close") - expected) > F.greatest(tolerance * F.greatest(F.abs("close"), F.abs(expected)), F.lit(tolerance))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(known, F.lit(False))).alias("uncheckable"), F.count_if(known & apart).alias("mismatched"), F.count_if(~F.col("method").eqNullSafe(F.lit(method))).alias("other_method"), F.count_if(~F.col("unit").eqNullSafe(F.lit(unit))).alias("other_unit"))


def symbol_integrity(rows: DataFrame) -> DataFrame:
    """One row: blank symbols, such with blanks around them, and such of another form."""
    text = F.coalesce("symbol", F.lit(""))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.trim(text) == "").alias("blank"), F.count_if((text != F.trim(text)) & (F.trim(text) != "")).alias("padded"), F.count_if((F.trim(text) != "") & ~F.trim(text).rlike(SYMBOL)).alias("malformed"), F.count_distinct(F.when(text.rlike(SYMBOL), text)).alias("symbols"))


def lifecycle_integrity(master: DataFrame, cutoff: str) -> DataFrame:
    """One row: breaches of a master's lifecycle, its delisted symbols, and those that survive ``cutoff``."""
    a, b, gone = F.col("list_date"), F.col("delist_date"), F.upper(F.col("list_status")).isin("DELISTED", "D")
    here, last = F.upper(F.col("list_status")).isin("LISTED", "ACTIVE", "L"), F.lit(cutoff).cast("date")
    return master.agg(
        F.count("*").alias("n_rows"), F.count_if(a.isNull()).alias("missing_list_date"), F.count_if(gone & b.isNull()).alias("delisted_without_date"), F.count_if(here & b.isNotNull()).alias("listed_with_delist_date"), F.count_if(b < a).alias("delisted_before_listed"),
        F.count_if(~F.coalesce(gone | here, F.lit(False))).alias("unknown_status"), F.count_distinct(F.when(gone, F.col("symbol"))).alias("delisted_symbols"), F.count_distinct(F.when((a <= last) & (b.isNull() | (b > last)), F.col("symbol"))).alias("survivors"),
    )


def publication_order(facts: DataFrame) -> DataFrame:
    """One row: facts with both dates, those published before their period ended, and the delay in days."""
    known = F.col("published").isNotNull() & F.col("period").isNotNull()
    return facts.agg(F.count("*").alias("n_rows"), F.count_if(known).alias("comparable"), F.count_if(F.col("published") < F.col("period")).alias("published_before_end"), F.median(F.datediff("published", "period")).alias("median_delay"))


def offset_presence(quotes: DataFrame, signals: DataFrame, calendar: DataFrame, offsets: list[int]) -> DataFrame:
    """(date, candidates, with_all, one count an offset): of each signal date's symbols, those quoted at every session offset.

    ``signals`` has (date, symbol), ``calendar`` (date, session). Each candidate
    asks for its sessions in one join; what is there is counted.
    """
    at = quotes.join(F.broadcast(calendar), "date").select("symbol", "session").distinct()
    asked = signals.join(F.broadcast(calendar), "date").select("date", "symbol", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("session") + k).alias("session")) for k in offsets))).alias("x")).select("date", "symbol", "x.k", "x.session")
    met = asked.join(at.withColumn("there", F.lit(1)), ["symbol", "session"], "left")
    each = met.groupBy("date", "symbol").agg(F.count("there").alias("n"), *(F.max(F.when((F.col("k") == k) & F.col("there").isNotNull(), 1).otherwise(0)).alias(f"at_{k}") for k in offsets))
    return each.groupBy("date").agg(F.count("*").alias("candidates"), F.count_if(F.col("n") == len(offsets)).alias("with_all"), *(F.sum(f"at_{k}").alias(f"at_{k}") for k in offsets))


def set_algebra(a: DataFrame, b: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n_a, n_b, both, either, only_a, only_b, one_side) of the distinct keys of two tables: one union and one grouped pass."""
    side = lambda df, x, y: df.select(by, key, F.lit(x).alias("a"), F.lit(y).alias("b"))
    keys = side(a, 1, 0).union(side(b, 0, 1)).groupBy(by, key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return keys.groupBy(by).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("both"), F.count("*").alias("either"), F.sum(F.col("a") * (1 - F.col("b"))).alias("only_a"), F.sum(F.col("b") * (1 - F.col("a"))).alias("only_b"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("one_side"))


def freshness(rows: DataFrame, most_days: int, least_aligned: int) -> DataFrame:
    """``verdict`` of each run's data and whether it may be used, first reason first."""
    real = F.expr(_FROM_REAL)
    verdict = F.when(F.col("source") == "sample", "sample_only").when(~F.coalesce(real, F.lit(False)), "unknown_source").when(F.col("status").isin("empty", "missing_columns"), "bad_data").when(F.col("age_days").isNull(), "unknown_freshness")
    verdict = verdict.when(F.col("age_days") > most_days, "stale").when(F.col("aligned_days") < least_aligned, "benchmark_missing").otherwise("fresh")
    return rows.withColumn("verdict", verdict).withColumn("ok", F.col("verdict") == "fresh")


def health(rows: DataFrame) -> DataFrame:
    """``state`` of each group of jobs and runs from counts of failed and running jobs and the latest run's ``verdict``: the worst reason."""
    state = F.when(F.col("verdict").isNull(), "no_real_data").when(F.col("failed_jobs") > 0, "job_failures").when(F.col("verdict") == "stale", "stale_data").when((F.col("verdict") != "fresh") | (F.col("running_jobs") > 0), "degraded").otherwise("ok")
    return rows.withColumn("state", state)


def _filled(runs: DataFrame) -> DataFrame:
    """Missing figures as 0; the columns stay as they are beside them."""
    figures = F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in _FIGURES else F.col(c) for c in runs.columns)).alias("f")
    return runs.select(*(F.col(c).alias(f"_{c}") for c in runs.columns), figures).select(*(f"_{c}" for c in runs.columns), "f.*")


def _restored(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    return df.select(*(F.col(f"_{c}").alias(c) for c in columns), *added)


def decision_gate(runs: DataFrame) -> DataFrame:
    """The checks of ``GATE_RULES`` for each run, how many pass, and whether it is a candidate."""
    checks = {f"pass_{name}": F.coalesce(F.expr(rule), F.lit(False)) for name, rule in GATE_RULES.items()}
    out = _restored(_filled(runs).withColumns(checks), runs.columns, list(checks))
    out = out.withColumn("passed", sum((F.col(c).cast("int") for c in checks), F.lit(0)))
    return out.withColumn("failed", len(checks) - F.col("passed")).withColumn("gate", F.when(F.col("failed") == 0, "paper_candidate").otherwise("research_only"))


def research_score(runs: DataFrame) -> DataFrame:
    """The parts of ``SCORE_PARTS`` of each gated run (with ``data_points``, 0 to 10), their capped sum and its band."""
    parts = {f"points_{name}": F.least(F.greatest(F.expr(share), F.lit(0.0)), F.lit(1.0)) * points for name, (points, share) in SCORE_PARTS.items()}
    out = _restored(_filled(runs).withColumns(parts), runs.columns, list(parts))
    cap = F.when(F.coalesce("verdict", F.lit("")) == "abandon", CAPS["abandon"]).when(F.col("gate") != "paper_candidate", CAPS["research_only"]).otherwise(CAPS["all"])
    out = out.withColumn("_total", F.least(sum((F.col(c) for c in parts), F.lit(0.0)), cap))
    band = F.lit("reject")
    for name, least in sorted(BANDS.items(), key=lambda b: b[1]):
        band = F.when(F.col("_total") >= least, name).otherwise(band)
    return out.withColumns({"score": F.round("_total", 2), "band": band}).drop("_total")


def board(runs: DataFrame, group: str) -> DataFrame:
    """Runs of each group by falling score, ties by id."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "run_id")))
