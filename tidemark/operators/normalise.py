"""Normalisation of symbols and columns, eligibility masks, and joins that check what they match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code prefixes of each exchange (all others are SZ), market names, stock types and statuses.
SH_PREFIXES, BJ_PREFIXES = ("600", "601", "603", "605", "688", "689"), ("4", "8", "9")
MARKETS = {"SH": ("SH", "SSE", "XSHG", "SHANGHAI"), "SZ": ("SZ", "SZSE", "XSHE", "SHENZHEN"), "BJ": ("BJ", "BSE", "XBEI", "BEIJING")}
A_SHARES = ("A股", "A", "ASHARE", "A-SHARE")
ACTIVE, DELISTED = ("ACTIVE", "LISTED", "L", "上市", "正常上市"), ("DELISTED", "TERMINATED", "D", "退市", "终止上市")


def symbol_code(x: Column) -> Column:
    """Trimmed upper-case text without the ``.0`` of a number; '' for NULL and words for missing."""
    text = F.upper(F.trim(F.coalesce(x.cast("string"), F.lit(""))))
    text = F.when(text.isin("NAN", "NONE", "NULL"), "").otherwise(text)
    return F.regexp_replace(text, r"^(\d+)\.0$", "$1")


def _padded(code: Column) -> Column:
    return F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)


def normal_symbol(x: Column) -> Column:
    """Six digits and an exchange: the one given after a dot, or the one that the prefix implies; '' for a missing code."""
    text = symbol_code(x)
    dotted, code = F.instr(text, ".") > 0, F.substring_index(text, ".", 1)
    full = _padded(text)
    starts = lambda prefixes: full.rlike("^(" + "|".join(prefixes) + ")")
    implied = F.when(starts(SH_PREFIXES), "SH").when(starts(BJ_PREFIXES), "BJ").otherwise("SZ")
    rest = F.regexp_extract(text, r"^[^.]*\.(.*)$", 1)
    given = F.when(symbol_code(code) == "", "").otherwise(F.concat_ws(".", _padded(symbol_code(code)), rest))
    return F.when(text == "", "").when(dotted, given).otherwise(F.concat_ws(".", full, implied))


def symbol_in_market(x: Column, market: Column) -> Column:
    """As ``normal_symbol``, with the exchange that a market's name stands for, where it is known."""
    code, name = symbol_code(x), F.upper(F.trim(F.coalesce(market, F.lit(""))))
    out = normal_symbol(_padded(code))
    for exchange, names in MARKETS.items():
        out = F.when(name.isin(*names), F.concat_ws(".", _padded(code), F.lit(exchange))).otherwise(out)
    return F.when(code == "", "").otherwise(out)


def is_b_share(symbol: Column) -> Column:
    return F.upper(F.coalesce(symbol, F.lit(""))).rlike(r"^(200\d{3}\.SZ|900\d{3}\.SH)$")


def eligible_symbols(master: DataFrame, start: str | None = None, end: str | None = None, include_bj: bool = False) -> DataFrame:
    """(symbol): A shares listed by ``end`` and not delisted by ``start``; a delisted one needs its date."""
    kind, status = (F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in ("stock_type", "list_status"))
    ok = kind.isin(*A_SHARES) & F.col("list_date").isNotNull() & ~is_b_share(F.col("symbol"))
    ok = ok & (status.isin(*ACTIVE) | (status.isin(*DELISTED) & F.col("delist_date").isNotNull()))
    if not include_bj:
        ok = ok & ~F.col("symbol").endswith(".BJ")
    if end:
        ok = ok & (F.col("list_date") <= F.lit(end).cast("date"))
    if start:
        ok = ok & (F.col("delist_date").isNull() | (F.col("delist_date") > F.lit(start).cast("date")))
    return master.filter(ok).select("symbol").distinct()


def ic_eligible(min_amount: float = 0.0) -> Column:
    """The diagnostics' mask: unknown flags count as not set, an unknown amount as 0."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = ~flag("is_st") & ~flag("is_suspended")
    return out & (F.coalesce("amount", F.lit(0.0)) >= min_amount) if min_amount > 0 else out


def trade_candidate(min_amount: float = 0.0) -> Column:
    """The portfolio's mask: all constraints must be known, and flags not set."""
    known = F.lit(True)
    for c in ("is_st", "is_suspended", "is_limit_up", "is_limit_down", "limit_up", "limit_down"):
        known = known & F.col(c).isNotNull()
    return F.coalesce(known & ~F.col("is_st") & ~F.col("is_suspended") & (F.col("amount") >= min_amount), F.lit(False))


def in_unit(df: DataFrame, column: str) -> DataFrame:
    """Shares given as per cent (anything over 1 in the whole column) divided by 100; the maximum is one row."""
    most = df.agg(F.max(F.abs(column)).alias("_most"))
    return df.crossJoin(F.broadcast(most)).withColumn(column, F.when(F.col("_most") > 1, F.col(column) / 100).otherwise(F.col(column))).drop("_most")


def market_columns(raw: DataFrame) -> DataFrame:
    """Typed bars: prices that parse, a volume of 0 where it is missing, volume x close where there is no amount, rows without close dropped.

    ``has_open``: whether an open price above 0 was delivered.
    """
    number = lambda c: F.when(F.abs(F.col(c).try_cast("double")) < float("inf"), F.col(c).try_cast("double"))
    out = raw.withColumns({c: number(c) for c in ("open", "high", "low", "close", "volume", "amount") if c in raw.columns})
    out = out.withColumn("volume", F.coalesce("volume", F.lit(0.0)) if "volume" in raw.columns else F.lit(0.0))
    out = out.withColumn("amount", F.coalesce("amount", F.lit(0.0)) if "amount" in raw.columns else F.col("volume") * F.col("close"))
    return out.withColumn("has_open", F.coalesce(F.col("open") > 0, F.lit(False))).filter("close IS NOT NULL AND date IS NOT NULL AND symbol IS NOT NULL")


def contract_breaches(bars: DataFrame) -> DataFrame:
    """One row of counts: unknown suspension, and tradable rows without their constraints."""
    missing = F.lit(False)
    for c in ("is_st", "is_limit_up", "is_limit_down", "limit_up", "limit_down"):
        missing = missing | F.col(c).isNull()
    return bars.agg(F.count("*").alias("n_rows"), F.count_if(F.col("is_suspended").isNull()).alias("unknown_suspension"), F.count_if(~F.coalesce("is_suspended", F.lit(False)) & missing).alias("missing_constraint"))


def match_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of each side, of both, and those that a side repeats."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(left, "_l").join(count(right, "_r"), keys, "full")
    n = lambda c: F.count_if(c)
    return both.agg(n(F.col("_l").isNotNull()).alias("left_keys"), n(F.col("_r").isNotNull()).alias("right_keys"), n(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"), n(F.col("_l") > 1).alias("left_repeated"), n(F.col("_r") > 1).alias("right_repeated"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that must be unique on both sides; a key that isn't raises when the rows are read."""
    width = Window.partitionBy(*keys)
    unique = F.assert_true(F.col("_n") == 1, F.lit("keys of a one-to-one join repeat"))
    mark = lambda df: df.withColumn("_n", F.count("*").over(width)).filter(unique.isNull()).drop("_n")
    return mark(left).join(mark(right), keys)


def exact_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left join on the whole key without any fill; a missing or NULL value raises when the rows are read."""
    out = rows.join(lookup.select(*keys, value), keys, "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.raise_error(F.lit(f"no {value} for a key")).cast(dict(lookup.dtypes)[value])))


def fill_from(rows: DataFrame, lookup: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left join in which what a row has wins over what the lookup says."""
    other = lookup.select(*keys, *(F.col(v).alias(f"_{v}") for v in values))
    out = rows.join(other, keys, "left")
    return out.withColumns({v: F.coalesce(F.col(v), F.col(f"_{v}")) if v in rows.columns else F.col(f"_{v}") for v in values}).drop(*(f"_{v}" for v in values))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in ``order``: a grouped maximum, so no key is sorted."""
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in names))


def limit_flags(marks: DataFrame) -> DataFrame:
    """Whether any record of a symbol's day says so."""
    return marks.groupBy("date", "symbol").agg(F.max("is_limit_up").alias("is_limit_up"), F.max("is_limit_down").alias("is_limit_down"))


def open_sessions(calendar: DataFrame, exchanges: list[str]) -> DataFrame:
    """(date): the days on which all ``exchanges`` are open (rows of exchange, date, is_open)."""
    wide = calendar.groupBy("date").pivot("exchange", exchanges).agg(F.max("is_open"))
    ok = F.lit(True)
    for e in exchanges:
        ok = ok & F.coalesce(F.col(e), F.lit(False))
    return wide.filter(ok).select("date")
