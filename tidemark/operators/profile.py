"""Profiles of tables, column by column, and rules over several tables at once.

A profile is one aggregate over all columns: rows, missing values, extremes,
and mergeable sketches for distinct values and quantiles, so that profiles of
days or files can be kept and put together later without the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the distinct sketch's buckets: a standard error of about 1.6 %; the quantile sketch's size: ranks within about 1.7 %.
HLL_BITS, KLL_SIZE = 12, 200
DISTINCT_BOUND, RANK_BOUND = 0.05, 0.02
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _numeric(kind: str) -> bool:
    return kind in _NUMBERS or kind.startswith("decimal")


def _plain(kind: str) -> bool:
    return _numeric(kind) or kind in ("string", "date", "timestamp", "timestamp_ntz", "boolean")


def sketches(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, column, type, n_rows, missing, least, greatest, distinct_sketch, quantile_sketch): one pass over all columns.

    Every column is a set of aggregates of its own, so no row is repeated for a
    column. Nested columns have counts only, quantiles are for numbers.
    """
    by, parts, named = by or [], [F.count("*").alias("_n")], []
    columns = [(c, t) for c, t in df.dtypes if c not in by]
    for i, (c, kind) in enumerate(columns):
        x = F.col(f"`{c}`")
        parts.append(F.count(x).alias(f"_c{i}"))
        text = lambda v, k=kind: v.cast("string") if _plain(k) else F.lit(None).cast("string")
        least, greatest = (text(f(x)) if _plain(kind) else F.lit(None).cast("string") for f in (F.min, F.max))
        key = x if kind in ("int", "bigint", "string") else x.cast("string")
        distinct = F.hll_sketch_agg(key, HLL_BITS) if _plain(kind) else F.lit(None).cast("binary")
        number = x.cast("double")
        quantile = F.kll_sketch_agg_double(F.when(~F.isnan(number), number), KLL_SIZE) if _numeric(kind) else F.lit(None).cast("binary")
        parts += [least.alias(f"_l{i}"), greatest.alias(f"_g{i}"), distinct.alias(f"_d{i}"), quantile.alias(f"_q{i}")]
        named.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col("_n").alias("n_rows"), (F.col("_n") - F.col(f"_c{i}")).alias("missing"), F.col(f"_l{i}").alias("least"), F.col(f"_g{i}").alias("greatest"), F.col(f"_d{i}").alias("distinct_sketch"), F.col(f"_q{i}").alias("quantile_sketch")))
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(*parts).select(*by, F.explode(F.array(*named)).alias("p")).select(*by, "p.*")


def merged(parts: DataFrame) -> DataFrame:
    """One profile for each column of several (``sketches`` by day, file or source). Extremes of numbers are compared as numbers."""
    number = F.col("type").rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    size = lambda c: F.when(number, F.col(c).try_cast("double"))
    key = lambda c: F.struct(size(c).alias("number"), F.col(c).alias("text"))
    known = lambda c: F.when(F.col(c).isNotNull(), key(c))
    return parts.groupBy("column", "type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("missing").alias("missing"), F.min(known("least"))["text"].alias("least"), F.max(known("greatest"))["text"].alias("greatest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def profile(sketched: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Sketches read off: ``distinct`` and one column ``q<percent>`` for each quantile, NULL where a column has no values."""
    some = F.col("n_rows") > F.col("missing")
    at = lambda q: F.when(some & F.col("quantile_sketch").isNotNull() & (F.kll_sketch_get_n_double("quantile_sketch") > 0), F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q)))
    out = sketched.withColumn("distinct", F.when(some, F.hll_sketch_estimate("distinct_sketch")))
    return out.withColumns({f"q{round(100 * q)}": at(q) for q in quantiles}).drop("distinct_sketch", "quantile_sketch")


@dataclass(frozen=True)
class Check:
    """Every row of ``table`` fulfils ``condition`` (unknown counts as broken)."""

    name: str
    table: str
    condition: str


@dataclass(frozen=True)
class Unique:
    name: str
    table: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class References:
    """Every ``columns`` of ``table`` without missing parts is some row's ``key`` of ``other``."""

    name: str
    table: str
    columns: tuple[str, ...]
    other: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class AtLeast:
    """``measure``, an aggregate over ``table``, is at least ``bound``."""

    name: str
    table: str
    measure: str
    bound: float


def validate(tables: dict[str, DataFrame], rules: list[Check | Unique | References | AtLeast], keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """(rule, table, violations, sample) of all rules, 0 and NULL where none is broken.

    All checks and measures of a table are one aggregate over one read; a key
    is one grouped pass, a reference one anti-join on distinct keys. The sample
    is the smallest key (``keys`` by table) of a broken row, so it is the same
    on every run; for a measure it is the measure.
    """
    spelled = lambda columns, prefix="": F.concat_ws("|", *(F.coalesce(F.col(f"{prefix}{c}").cast("string"), F.lit("")) for c in columns))
    parts = []
    for name, df in tables.items():
        checks = [r for r in rules if isinstance(r, Check) and r.table == name]
        bounds = [r for r in rules if isinstance(r, AtLeast) and r.table == name]
        if checks:
            broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(r.condition), F.lit(False)), F.lit(r.name)) for r in checks)))
            found = df.select(F.explode(broken).alias("rule"), spelled(keys[name]).alias("key")).groupBy("rule").agg(F.count("*").alias("violations"), F.min("key").alias("sample"))
            parts.append(found.select("rule", F.lit(name).alias("table"), "violations", "sample"))
        if bounds:
            row = df.agg(*(F.expr(r.measure).cast("double").alias(f"_{i}") for i, r in enumerate(bounds)))
            each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.when(F.coalesce(F.col(f"_{i}") >= r.bound, F.lit(False)), 0).otherwise(1).cast("long").alias("violations"), F.col(f"_{i}").cast("string").alias("sample")) for i, r in enumerate(bounds)))).alias("x")
            parts.append(row.select(each).select("x.rule", F.lit(name).alias("table"), "x.violations", "x.sample"))
    for r in rules:
        if isinstance(r, Unique):
            again = tables[r.table].groupBy(*r.key).count().filter("count > 1").select((F.col("count") - 1).alias("n"), spelled(r.key).alias("key"))
        elif isinstance(r, References):
            left = tables[r.table].groupBy(*(F.col(c).alias(f"_{c}") for c in r.columns)).count().na.drop(subset=[f"_{c}" for c in r.columns])
            right = tables[r.other].select(*(F.col(k).alias(f"_{c}") for c, k in zip(r.columns, r.key))).distinct()
            again = left.join(right, [f"_{c}" for c in r.columns], "left_anti").select(F.col("count").alias("n"), spelled(r.columns, "_").alias("key"))
        else:
            continue
        parts.append(again.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"), F.min("key").alias("sample")).select(F.lit(r.name).alias("rule"), F.lit(r.table).alias("table"), "violations", "sample"))
    spark = next(iter(tables.values())).sparkSession
    listed = spark.createDataFrame([(i, r.name, r.table) for i, r in enumerate(rules)], "i int, rule string, table string")
    found = reduce(DataFrame.unionByName, parts)
    out = F.broadcast(listed).join(found, ["rule", "table"], "left")
    return out.select("rule", "table", F.coalesce("violations", F.lit(0)).alias("violations"), "sample")


def verdict(found: DataFrame, hard: list[str]) -> DataFrame:
    """One row: how many rules are broken, how many of the ``hard`` ones, and the bundle's level."""
    broken = F.col("violations") > 0
    out = found.agg(F.count("*").alias("rules"), F.count_if(broken).alias("broken"), F.count_if(broken & F.col("rule").isin(hard)).alias("hard_failed"))
    level = F.when(F.col("hard_failed") > 0, "invalid").when(F.col("broken") > 0, "research_only").otherwise("production_ready")
    return out.withColumn("level", level)
