"""Named event windows of a panel: dividends, abnormal-trading lists, announcements.

Quotes and events are united once for a symbol and aggregated over range frames
of days, so every window of a set shares one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _united(quotes: DataFrame, events: DataFrame) -> DataFrame:
    """Quotes (their columns in ``_quote``) and events in one table with ``_day``, the day number."""
    extra = [c for c in events.columns if c not in ("symbol", "date")]
    kinds = dict(events.dtypes)
    rows = quotes.select("symbol", "date", F.struct(*quotes.columns).alias("_quote"), *(F.lit(None).cast(kinds[c]).alias(c) for c in extra), F.lit(None).cast("date").alias("_event"))
    both = rows.unionByName(events.withColumn("_quote", F.lit(None).cast(dict(rows.dtypes)["_quote"])).withColumn("_event", F.col("date")))
    return both.withColumn("_day", F.datediff("date", F.lit("1970-01-01")))


def _windows(quotes: DataFrame, events: DataFrame, parts: dict[str, tuple[Column, int | None]], strict: bool) -> DataFrame:
    """Each part is an aggregate and its days back from the quote; None is from the first event on."""
    last = -1 if strict else 0
    frame = lambda days: Window.partitionBy("symbol").orderBy("_day").rangeBetween(Window.unboundedPreceding if days is None else -days, last)
    both = _united(quotes, events).withColumns({name: x.over(frame(days)) for name, (x, days) in parts.items()})
    return both.filter("_quote IS NOT NULL").select("_quote.*", *parts)


def _days_since(out: DataFrame, name: str) -> DataFrame:
    return out.withColumn(name, F.datediff("date", name).cast("double"))


def dividend_windows(quotes: DataFrame, dividends: DataFrame) -> DataFrame:
    """Count and cash of the 365 days up to and including each date, days since the last dividend and its cash.

    ``dividends`` has (symbol, date, cash); of several on a day the largest is the last.
    """
    cash = F.coalesce("cash", F.lit(0.0)).cast("decimal(28,6)")
    latest = F.max(F.when(F.col("_event").isNotNull(), F.struct("_event", "cash")))
    out = _windows(quotes, dividends, {"dividend_event_count_365d": (F.count("_event"), 365), "dividend_event_cash_365d": (F.sum(F.when(F.col("_event").isNotNull(), cash)), 365), "_last": (latest, None)}, strict=False)
    out = out.withColumn("dividend_event_cash_365d", F.coalesce(F.col("dividend_event_cash_365d").cast("double"), F.lit(0.0)))
    return out.withColumns({"dividend_event_days_since_last": F.datediff("date", F.col("_last")["_event"]).cast("double"), "dividend_event_last_cash": F.col("_last")["cash"]}).drop("_last")


def abnormal_list_windows(quotes: DataFrame, listed: DataFrame) -> DataFrame:
    """Count, amount and largest deviation of the 90 days before each date, and days since the last event (symbol, date, traded, deviation)."""
    out = _windows(quotes, listed, {"abnormal_count_90d": (F.count("_event"), 90), "abnormal_amount_90d": (F.sum(F.col("traded").cast("decimal(28,4)")), 90), "abnormal_max_deviation_90d": (F.max(F.abs("deviation")), 90), "abnormal_days_since_last": (F.max("_event"), None)}, strict=True)
    return _days_since(out.withColumn("abnormal_amount_90d", F.coalesce(F.col("abnormal_amount_90d").cast("double"), F.lit(0.0))), "abnormal_days_since_last")


#: Fixed keywords of the categories, looked for in the lower-cased title and type.
CATEGORIES = {
    "buyback": ("回购", "repurchase", "buyback"),
    "dividend": ("分红", "派息", "派发", "权益分派", "利润分配", "cash dividend", "dividend"),
    "financing": ("增发", "配股", "可转债", "公司债", "募集资金", "融资", "定向发行", "private placement", "convertible bond", "rights issue"),
    "reorg": ("重组", "并购", "收购", "资产置换", "重大资产", "merger", "acquisition", "restructuring"),
    "risk_alert": ("风险提示", "诉讼", "仲裁", "处罚", "违规", "立案", "问询函", "监管函", "退市", "债务逾期", "担保", "减持", "litigation", "penalty", "delisting", "shareholder reduction"),
    "report": ("年报", "季报", "半年报", "业绩预告", "业绩快报", "annual report", "quarterly report", "earnings forecast"),
}


def announcement_flags(announcements: DataFrame) -> DataFrame:
    """``is_`` columns of all categories from ``title`` and ``kind``."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("kind", F.lit(""))))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return announcements.withColumns({f"is_{name}": hit(words).cast("int") for name, words in CATEGORIES.items()})


def announcement_windows(quotes: DataFrame, announcements: DataFrame) -> DataFrame:
    """Counts of the days before each date by window and category, and days since the last; events carry ``announcement_flags``."""
    parts: dict[str, tuple[Column, int | None]] = {f"announcement_count_{d}d": (F.count("_event"), d) for d in (30, 90, 180, 365)}
    for name, days in (("buyback", 180), ("dividend", 365), ("financing", 365), ("reorg", 365), ("risk_alert", 365), ("report", 365)):
        parts[f"announcement_{name}_count_{days}d"] = (F.sum(f"is_{name}"), days)
    flags = [f"is_{name}" for name in CATEGORIES]
    parts["announcement_days_since_last"] = (F.max("_event"), None)
    out = _windows(quotes, announcements.select("symbol", "date", *flags), parts, strict=True)
    out = out.withColumns({k: F.coalesce(k, F.lit(0)).cast("long") for k in parts if k != "announcement_days_since_last"})
    return _days_since(out, "announcement_days_since_last")
