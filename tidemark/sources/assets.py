"""Typed loaders of an archive's tables: aliases, coercion, cutoffs and which of repeated rows stays; discovery; a panel cache.

An asset's rule says where each column comes from (the first of several names
that the raw table has, or the first of them with a value), what must be
there, and by what order one row of a key is kept. Raw tables are read as
texts, so nothing is lost before it is judged.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import finite
from tidemark.operators.normalise import normal_symbol
from tidemark.sources.readers import strict_date
from tidemark.sources.scratch import exists


class AssetError(ValueError):
    """A table that can't be used as the asset it is meant to be."""


@dataclass(frozen=True)
class Asset:
    """How a raw table becomes an asset.

    ``columns`` maps a column to its kind (symbol, date, number, text, flag);
    ``names`` gives the raw names it may have, in order (default: its own),
    ``fallback`` columns that fill it row by row. Rows lacking a ``required``
    value go, and so do those whose ``at`` date is after the cutoff or that
    don't fulfil ``keep``. Of rows of one ``key`` the last by ``latest`` stays.
    """

    name: str
    columns: dict[str, str]
    required: tuple[str, ...]
    at: str
    names: dict[str, tuple[str, ...]] = field(default_factory=dict)
    fallback: dict[str, tuple[str, ...]] = field(default_factory=dict)
    keep: str | None = None
    key: tuple[str, ...] = ()
    latest: tuple[str, ...] = ()


_SYMBOL = ("symbol", "stockCode")
FUNDAMENTAL_FACTORS = Asset(
    "fundamental_factors",
    {"date": "date", "symbol": "symbol", "roe": "number", "dividend_yield": "number", "pe": "number", "pb": "number", "published": "date", "period": "date", "source": "text"},
    ("date", "symbol"), "date",
    {"symbol": _SYMBOL, "date": ("date", "publishDate", "reportDate"), "published": ("publishDate",), "period": ("reportPeriodEnd", "reportDate")},
    {"published": ("date",)}, key=("symbol", "date"), latest=("published", "period"),
)
DIVIDENDS = Asset(
    "dividend_events",
    {"symbol": "symbol", "ex_date": "date", "cash": "number", "announced": "date", "planned": "date", "paid": "date"},
    ("symbol", "ex_date", "cash"), "ex_date",
    {"symbol": _SYMBOL, "ex_date": ("exDate",), "cash": ("cashDividendPerShare",), "announced": ("latestAnnounceDate",), "planned": ("planAnnounceDate",), "paid": ("cashPayDate",)}, keep="cash > 0",
)
CAPITAL_FLOWS = Asset("daily_fund_flows", {"date": "date", "symbol": "symbol", "main_net_inflow": "number", "large_net_inflow": "number", "amount": "number"}, ("date", "symbol"), "date", {"symbol": _SYMBOL, "main_net_inflow": ("mainNetInflow",), "large_net_inflow": ("largeNetInflow",)})
MARGIN = Asset("margin_trades", {"date": "date", "symbol": "symbol", "margin_balance": "number", "margin_buy": "number"}, ("date", "symbol"), "date", {"symbol": _SYMBOL, "date": ("date", "tradeDate"), "margin_balance": ("marginBalance",), "margin_buy": ("marginBuyAmount",)})
ABNORMAL = Asset("abnormal_list", {"date": "date", "symbol": "symbol", "net_amount": "number", "reason": "text"}, ("date", "symbol"), "date", {"symbol": _SYMBOL, "date": ("date", "tradeDate"), "net_amount": ("netAmount",)})
ANNOUNCEMENTS = Asset("announcements", {"date": "date", "symbol": "symbol", "id": "text", "title": "text"}, ("date", "symbol", "title"), "date", {"symbol": _SYMBOL, "date": ("date", "announcementDate", "publishDate"), "id": ("announcementId",), "title": ("title", "announcementTitle")}, key=("symbol", "date", "title"), latest=("id",))
INDUSTRY = Asset("industry", {"date": "date", "symbol": "symbol", "industry": "text", "latest_only": "flag"}, ("date", "symbol", "industry"), "date", {"symbol": _SYMBOL, "industry": ("industryCode", "industryName"), "latest_only": ("isLatestOnly",)}, key=("symbol", "date"), latest=("industry",))
INDEX = Asset("index_constituents", {"date": "date", "index_code": "text", "symbol": "symbol", "weight": "number", "latest_only": "flag"}, ("date", "symbol", "index_code"), "date", {"symbol": _SYMBOL, "index_code": ("indexCode",), "latest_only": ("isLatestOnly",)}, key=("date", "index_code", "symbol"), latest=("weight",))
ASSETS = {a.name: a for a in (FUNDAMENTAL_FACTORS, DIVIDENDS, CAPITAL_FLOWS, MARGIN, ABNORMAL, ANNOUNCEMENTS, INDUSTRY, INDEX)}


def sources(asset: Asset, present: list[str]) -> dict[str, str | None]:
    """Which raw column each of the asset's comes from, None if the raw table has none."""
    return {c: next((n for n in asset.names.get(c, (c,)) if n in present), None) for c in asset.columns}


def lacking(asset: Asset, present: list[str]) -> list[str]:
    """Required columns that the raw table has under none of their names."""
    found = sources(asset, present)
    return [c for c in asset.required if found[c] is None]


def _value(text: F.Column, kind: str) -> F.Column:
    text = F.nullif(F.trim(text), F.lit(""))
    if kind == "symbol":
        return F.nullif(normal_symbol(text), F.lit(""))
    if kind == "date":
        return strict_date(text)
    if kind == "number":
        return finite(text.try_cast("double"))
    if kind == "flag":
        return F.lower(text).isin("true", "1", "yes", "y", "t")
    return text


def conform(raw: DataFrame, asset: Asset, end: str, symbols: DataFrame | None = None) -> DataFrame:
    """The asset's rows up to ``end``, of ``symbols`` only if they are given: one pass, and a shuffle by key if it has one.

    Texts that don't parse are missing values. Rows of a key that agree in
    ``latest`` are told apart by their other columns, so the result doesn't
    depend on partitions.
    """
    without = lacking(asset, raw.columns)
    if without:
        raise AssetError(f"{asset.name} requires {', '.join(without)}")
    found = sources(asset, raw.columns)
    rows = raw.select(*((_value(F.col(f"`{found[c]}`").cast("string"), kind) if found[c] else _value(F.lit(None).cast("string"), kind)).alias(c) for c, kind in asset.columns.items()))
    rows = rows.withColumns({c: F.coalesce(c, *others) for c, others in asset.fallback.items()})
    good = F.col(asset.at) <= F.lit(end).cast("date")
    for c in asset.required:
        good = good & F.col(c).isNotNull()
    rows = rows.filter(good if asset.keep is None else good & F.expr(asset.keep))
    if symbols is not None:
        rows = rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    if asset.key:
        rest = [c for c in asset.columns if c not in asset.key]
        first = [*asset.latest, *(c for c in rest if c not in asset.latest)]
        rows = rows.groupBy(*asset.key).agg(F.max(F.struct(*first)).alias("_row")).select(*asset.key, *(F.col("_row")[c].alias(c) for c in rest))
    return rows.select(*asset.columns)


def read_texts(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A raw table with all columns as texts; AssetError where there is none."""
    if not exists(spark, path):
        raise AssetError(f"no table at {path}")
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return raw.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns))


def load_asset(spark: SparkSession, path: str, asset: Asset, end: str, symbols: DataFrame | None = None, fmt: str = "csv") -> DataFrame:
    """``conform`` of the table at ``path``; AssetError if it isn't there, lacks a column or has no row left."""
    rows = conform(read_texts(spark, path, fmt), asset, end, symbols)
    if not rows.limit(1).count():
        raise AssetError(f"{asset.name} has no rows up to {end}")
    return rows


def inventory(spark: SparkSession, root: str, required: tuple[str, ...] = ("fundamental_factors",), fmt: str = "csv") -> DataFrame:
    """(asset, present, required, n_rows, usable, first, last, lacking, unknown) of all assets below ``root``.

    ``usable`` counts rows with all required values. Each table is read once;
    what is counted stays on the executors until the result is asked for.
    """
    parts = []
    for name, asset in ASSETS.items():
        path = f"{root}/{name}"
        base = [F.lit(name).alias("asset"), F.lit(name in required).alias("required")]
        if not exists(spark, path):
            one = spark.range(1).select(*base, F.lit(False).alias("present"), *(F.lit(None).cast("long").alias(c) for c in ("n_rows", "usable")), *(F.lit(None).cast("date").alias(c) for c in ("first", "last")), F.lit("").alias("lacking"), F.lit("").alias("unknown"))
        else:
            raw = read_texts(spark, path, fmt)
            found, without = sources(asset, raw.columns), lacking(asset, raw.columns)
            known = {n for c in asset.columns for n in asset.names.get(c, (c,))}
            values = {c: _value(F.col(f"`{found[c]}`"), asset.columns[c]) for c in {*asset.required, asset.at} if found[c]}
            whole = F.lit(not without)
            for c in asset.required:
                whole = whole & values[c].isNotNull() if c in values else whole
            day = values.get(asset.at, F.lit(None).cast("date"))
            one = raw.agg(F.count("*").alias("n_rows"), F.count_if(whole).alias("usable"), F.min(day).alias("first"), F.max(day).alias("last"))
            one = one.select(*base, F.lit(True).alias("present"), "n_rows", "usable", "first", "last", F.lit(",".join(without)).alias("lacking"), F.lit(",".join(sorted(set(raw.columns) - known))).alias("unknown"))
        parts.append(one)
    return reduce(DataFrame.unionByName, parts).select("asset", "present", "required", "n_rows", "usable", "first", "last", "lacking", "unknown")


def snapshot_support(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, snapshots, rows, all_latest, usable_history): whether dated snapshots can tell what was known in the past.

    A group of which every row is marked as the latest state, with one date at
    most, can't.
    """
    out = rows.groupBy(*by).agg(F.count_distinct("date").alias("snapshots"), F.count("*").alias("rows"), F.bool_and(F.coalesce("latest_only", F.lit(False))).alias("all_latest"))
    return out.withColumn("usable_history", ~(F.col("all_latest") & (F.col("snapshots") <= 1)))


def require_history(rows: DataFrame) -> DataFrame:
    """``rows`` unless they are one latest-only snapshot; then AssetError."""
    seen = rows.agg(F.count("*").alias("rows"), F.count_distinct("date").alias("snapshots"), F.bool_and(F.coalesce("latest_only", F.lit(False))).alias("all_latest")).first()
    if seen.rows and seen.all_latest and seen.snapshots <= 1:
        raise AssetError("the only snapshot is marked latest-only and says nothing about the past")
    return rows


def fingerprint(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of all files below ``paths``, in order; a missing path has one entry of zeros."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in sorted(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            out.append((path, 0, 0))
            continue
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
                out.append((name, f.getLen(), f.getModificationTime()))
    return sorted(out)


def cached_panel(spark: SparkSession, root: str, name: str, version: int, parameters: dict, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes of ``inputs`` with ``parameters``, taken from ``root`` if it was made of the same before.

    The key is a hash of name, version, parameters and the inputs' files with
    sizes and times. A new table is written beside its place and renamed, so
    readers see a whole one or none; whoever comes second uses the first's.
    """
    told = json.dumps({"name": name, "version": version, "parameters": parameters, "inputs": fingerprint(spark, inputs)}, sort_keys=True, default=str)
    path = f"{root}/{name}-{hashlib.sha256(told.encode()).hexdigest()[:32]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        jvm = spark.sparkContext._jvm
        own, final = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.making-{hashlib.sha256(told.encode()).hexdigest()[:8]}-{jvm.java.util.UUID.randomUUID()}", path))
        build().write.option("compression", "zstd").parquet(own.toString())
        fs = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(final) or not fs.rename(own, final):
            fs.delete(own, True)
    return spark.read.parquet(path)
