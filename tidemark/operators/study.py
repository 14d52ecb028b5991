"""Factor studies: rank IC, spreads, registered cells, HAC inference, Shapley attribution, multiplicity."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import pct_rank, ratio
from tidemark.functions.dealing import dealt


def correlation(x: str, y: str) -> Column:
    """Pearson correlation from moment sums; NULL where a side doesn't vary (``corr`` would raise)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when((F.count_distinct(a) > 1) & (F.count_distinct(b) > 1), F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)))


def rank_ic(cells: DataFrame, keys: list[str], score: str = "score", outcome: str = "outcome", least: int = 20, size: int | None = None) -> DataFrame:
    """Per cell: observations, Spearman IC, top minus bottom fifth; cells below ``least`` observations go.

    Ranks are windows by the cell's keys, then one grouped aggregation.
    ``size``: about so many rows of ``cells``, dealt out accordingly.
    """
    rows = dealt(cells.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull()), size, *keys)
    known = Window.partitionBy(*keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(score, "symbol")) / F.count(F.lit(1)).over(known)
    rows = rows.withColumns({"_x": pct_rank(F.col(score), *keys), "_y": pct_rank(F.col(outcome), *keys), "_share": first})
    top, bottom = F.avg(F.when(F.col("_share") > 0.8, F.col(outcome))), F.avg(F.when(F.col("_share") <= 0.2, F.col(outcome)))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), correlation("_x", "_y").alias("ic"), F.coalesce(top - bottom, F.lit(0.0)).alias("spread"))
    return out.filter(F.col("n") >= least)


def ic_summary(ics: DataFrame, keys: list[str]) -> DataFrame:
    mean, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    t = F.when((n > 1) & (sd > 0), mean / (sd / F.sqrt(n)))
    return ics.groupBy(*keys).agg(n.alias("periods"), mean.alias("mean_ic"), F.median("ic").alias("median_ic"), sd.alias("sd_ic"), t.alias("t_stat"), F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("positive_share"), F.avg("spread").alias("mean_spread"))


def summary_status(periods: Column, mean: Column, t: Column) -> Column:
    return F.when(periods < 3, "low_period_count").when(mean < -0.02, "adverse").when(F.abs(mean) < 0.02, "weak").when(t >= 1.5, "supportive").otherwise("positive_but_noisy")


def best_and_adverse(summary: DataFrame) -> DataFrame:
    """One row: the cell of the highest mean IC (ties by t), and how many are supportive and adverse."""
    best = F.struct("mean_ic", "t")
    return summary.agg(F.count("*").alias("summary_rows"), F.max_by("factor", best).alias("best_factor"), F.max_by("horizon", best).alias("best_horizon"), F.max("mean_ic").alias("best_mean_ic"), F.count_if(F.col("status") == "supportive").alias("supportive"), F.count_if(F.col("status") == "adverse").alias("adverse"))


def newey_west(values: DataFrame, keys: list[str], value: str, order: str, lags: int = 3, effective: bool = True) -> DataFrame:
    """Mean, HAC t statistic and count per key: Bartlett weights, autocovariances over n.

    ``effective``: the lag is cut to n - 1 in the weights too, a negative
    variance counts as 0; else the weights keep the asked lag and a variance
    that isn't positive gives NULL. Fewer than 3 values give NULL either way.
    """
    rows = values.filter(F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_c", F.col(value) - F.avg(value).over(w))
    by = w.orderBy(order)
    rows = rows.withColumns({f"_g{k}": F.col("_c") * F.lag("_c", k).over(by) for k in range(1, lags + 1)})
    n = F.count("*")
    out = rows.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.sum(F.col("_c") * F.col("_c")).alias("_v"), *(F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"_g{k}") for k in range(1, lags + 1)))
    used = F.least(F.lit(lags), F.col("n") - 1) if effective else F.lit(lags)
    variance = F.col("_v") / F.col("n")
    for k in range(1, lags + 1):
        variance = variance + F.when(used >= k, 2 * (1 - k / (used + 1)) * F.col(f"_g{k}") / F.col("n")).otherwise(0.0)
    if effective:
        se = F.when(F.col("n") >= 3, F.sqrt(F.greatest(variance, F.lit(0.0)) / F.col("n")))
    else:
        se = F.when((F.col("n") >= 3) & (variance > 0), F.sqrt(F.greatest(variance, F.lit(0.0)) / F.col("n")))
    return out.withColumn("t_stat", F.try_divide(F.col("mean"), se)).select(*keys, "n", "mean", "t_stat")


def shapley_weights(components: list[str]) -> list[tuple[str, str, str, float]]:
    """(component, subset without it, subset with it, weight) of the exact Shapley value."""
    m, out = len(components), []
    name = lambda s: "+".join(sorted(s)) or "none"
    for c in components:
        rest = [x for x in components if x != c]
        for size in range(m):
            for s in combinations(rest, size):
                out.append((c, name(s), name((*s, c)), math.factorial(size) * math.factorial(m - 1 - size) / math.factorial(m)))
    return out


def shapley(values: DataFrame, components: list[str], keys: list[str], variant: str = "variant", value: str = "value") -> DataFrame:
    """Each component's Shapley value per key, over keys that have all subsets; the table of weights is fixed and small."""
    spark = values.sparkSession
    weights = F.broadcast(spark.createDataFrame(shapley_weights(components), "component string, without string, `with` string, weight double"))
    whole = values.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(variant).alias("_n")).filter(F.col("_n") == 2 ** len(components)).drop("_n")
    rows = values.join(whole, keys, "left_semi")
    sides = rows.join(weights, F.col(variant) == F.col("with")).select(*keys, "component", (F.col("weight") * F.col(value)).alias("_v"))
    sides = sides.unionByName(rows.join(weights, F.col(variant) == F.col("without")).select(*keys, "component", (-F.col("weight") * F.col(value)).alias("_v")))
    return sides.groupBy(*keys, "component").agg(F.sum("_v").alias("contribution"))


def adjust_p(tests: DataFrame, family: str, p: str = "p_value", name: str = "test") -> DataFrame:
    """Holm and Benjamini-Hochberg p-values per family; missing ones stay NULL but count in its size."""
    known = [family, F.col(p).isNull()]
    m = F.count(F.lit(1)).over(Window.partitionBy(family))
    up = Window.partitionBy(*known).orderBy(p, name)
    rank = F.row_number().over(up)
    out = tests.withColumns({"_m": m, "_rank": rank})
    holm = F.max((F.col("_m") - F.col("_rank") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    # from the last rank up, so that the minimum runs along; a frame to the end would be gone through anew for every row
    down = Window.partitionBy(*known).orderBy(F.desc("_rank"))
    bh = F.min(F.col("_m") / F.col("_rank") * F.col(p)).over(down.rowsBetween(Window.unboundedPreceding, 0))
    one = F.lit(1.0)
    return out.withColumns({"holm": F.when(F.col(p).isNotNull(), F.least(holm, one)), "bh": F.when(F.col(p).isNotNull(), F.least(bh, one))}).drop("_m", "_rank")


def paired_difference(values: DataFrame, left: str, right: str, keys: list[str], variant: str = "variant", value: str = "value") -> DataFrame:
    """Differences of two variants over the keys that both have, and how many only one has."""
    a = values.filter(F.col(variant) == left).select(*keys, F.col(value).alias("_a"))
    b = values.filter(F.col(variant) == right).select(*keys, F.col(value).alias("_b"))
    both = a.join(b, keys, "full_outer")
    d = F.col("_a") - F.col("_b")
    return both.agg(F.count(d).alias("matched"), F.count_if(d.isNull()).alias("unmatched"), F.avg(d).alias("mean_difference"), F.max(F.abs(d)).alias("max_difference"))


def comparison_metrics(returns: DataFrame, periods: float) -> DataFrame:
    """Tracking error, information ratio, correlation and drawdowns of a strategy against an index, aligned by date."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    active = F.col("strategy") - F.col("index")
    growth = lambda c: F.exp(F.sum(F.log1p(c)).over(w))
    rows = returns.withColumns({"_s": growth("strategy"), "_i": growth("index"), "_d": active})
    rows = rows.withColumns({"_sd": F.col("_s") / F.greatest(F.max("_s").over(w), F.lit(1.0)) - 1, "_id": F.col("_i") / F.greatest(F.max("_i").over(w), F.lit(1.0)) - 1})
    te = F.stddev_samp("_d") * math.sqrt(periods)
    return rows.agg(F.count("*").alias("n"), te.alias("tracking_error"), ratio(F.avg("_d") * periods, te).alias("information_ratio"), correlation("strategy", "index").alias("correlation"), F.min("_sd").alias("strategy_drawdown"), F.min("_id").alias("index_drawdown"))
