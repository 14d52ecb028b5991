"""Contract-checked readers of CSV, JSON and Parquet tables, and writers of artifacts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import finite
from tidemark.operators.normalise import normal_symbol


@dataclass(frozen=True)
class Contract:
    """Columns with their types, the key, and columns that may be NULL."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...]
    nullable: frozenset[str] = frozenset()
    aliases: dict[str, str] = field(default_factory=dict)


QUOTES = Contract("daily_quotes", {"date": "date", "symbol": "string", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "amount": "double", "is_st": "boolean", "is_suspended": "boolean", "is_limit_up": "boolean", "is_limit_down": "boolean", "limit_up": "double", "limit_down": "double"}, ("date", "symbol"), frozenset({"open", "high", "low", "volume", "amount", "is_st", "is_suspended", "is_limit_up", "is_limit_down", "limit_up", "limit_down"}), {"trade_date": "date", "tradeDate": "date", "stockCode": "symbol", "code": "symbol"})
MASTER = Contract("stock_master", {"symbol": "string", "list_date": "date", "delist_date": "date", "list_status": "string", "stock_type": "string"}, ("symbol",), frozenset({"delist_date", "list_status", "stock_type"}), {"listDate": "list_date", "delistDate": "delist_date", "listStatus": "list_status", "stockType": "stock_type"})
FUNDAMENTALS = Contract("fundamentals", {"symbol": "string", "period": "date", "published": "date", "roe": "double"}, ("symbol", "period"), frozenset({"published", "roe"}), {"reportPeriodEnd": "period", "publishDate": "published", "roeDiluted": "roe"})


def strict_date(x: F.Column) -> F.Column:
    """Dates written YYYY-MM-DD or YYYYMMDD; anything else is NULL."""
    parts = F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date")).when(x.rlike(r"^\d{8}$"), parts.try_cast("date"))


def parse(raw: DataFrame, contract: Contract) -> DataFrame:
    """All-string columns to the contract's types; what doesn't parse is NULL, NaN and infinities too."""
    raw = raw.withColumnsRenamed({a: c for a, c in contract.aliases.items() if a in raw.columns})
    missing = [c for c in contract.columns if c not in raw.columns and c not in contract.nullable]
    if missing:
        raise ValueError(f"{contract.name}: missing required columns: {', '.join(missing)}")
    out = []
    for c, kind in contract.columns.items():
        x = F.col(c) if c in raw.columns else F.lit(None).cast("string")
        x = F.nullif(normal_symbol(x), F.lit("")) if c == "symbol" else x
        x = strict_date(x) if kind == "date" else finite(x.try_cast("double")) if kind == "double" else x if kind == "string" else x.try_cast(kind)
        out.append(x.alias(c))
    return raw.select(*out)


def violations(df: DataFrame, contract: Contract) -> dict[str, int]:
    """Rows, NULLs per required column and repeated keys, by one grouped pass."""
    need = [c for c in contract.columns if c not in contract.nullable]
    keys = df.groupBy(*contract.key).agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(need)))
    row = keys.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("repeated_keys"), *(F.sum(f"_{i}").alias(f"null_{c}") for i, c in enumerate(need))).first()
    return {k: int(v or 0) for k, v in row.asDict().items()}


def load(spark: SparkSession, path: str, contract: Contract, fmt: str = "csv") -> DataFrame:
    """Read, parse and check a table; any violation raises. CSV is read as strings, so symbols keep their zeros."""
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    df = parse(raw.select(*(F.col(c).cast("string") for c in raw.columns)), contract)
    bad = {k: v for k, v in violations(df, contract).items() if k != "rows" and v}
    if bad:
        raise ValueError(f"{contract.name}: {bad}")
    return df


def table_hash(df: DataFrame) -> tuple[int, int]:
    """(rows, hash) of a table whatever its order: a sum of row hashes."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def write_artifact(df: DataFrame, path: str, keys: list[str], fmt: str = "json") -> None:
    """Canonical artifact: columns by name, rows by key."""
    df.select(*sorted(df.columns)).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").format(fmt).save(path)
