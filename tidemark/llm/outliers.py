"""Quality rules (operator 6): robust multivariate outliers by minimum covariance determinant.

Each text gives a vector of transformed statistics. For every group (language
and source) the location and scatter of the tightest ``COVERAGE`` of its
vectors are found by concentration steps from a start of medians and quartiles:
distances under the present estimate, then mean and covariance of the nearest
``COVERAGE`` of the group, in whole bins of distance and stretched by the share
that these bins hold. A group takes steps as long as they lower the determinant
of that scatter, and keeps the estimate of the lowest. All vectors of the groups
that still move take part in a step, as one aggregation by (group, distance bin)
of counts, sums and products; only those sums are shuffled, so a hot group costs
no more than any other. Vectors are held in whole 1/256ths, which makes the
sums exact and reruns identical.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_tag, table
from tidemark.llm.text_stats import with_rule_stats

SCALE = 256
COVERAGE = 0.75
#: Groups converge within about ten steps; one that hasn't after these keeps the best of them.
MAX_STEPS = 30
#: A rejected vector lies beyond this quantile of chi-squared, stretched where a group's median distance is over that of normal vectors.
QUANTILE = 0.999
#: Groups with fewer rows are pooled with the other small ones of their language; a pool below it rejects nothing.
MIN_ROWS = 50
#: Least standard deviation of each component, for groups that hardly vary: the last three are such that one symbol, one
#: repeated line or one repeated window alone is within the cut in the shortest texts that pass the base rule.
FLOORS = (0.05, 0.02, 0.032, 0.063, 0.077)
D = len(FLOORS)


def chi2_cdf(x: float, d: int) -> float:
    """Chi-squared distribution function by the series of the incomplete gamma function."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return (low + high) / 2


def consistency(coverage: float, d: int) -> float:
    """Factor that makes the scatter of the central share of normal vectors that of all."""
    return coverage / chi2_cdf(chi2_quantile(coverage, d), d + 2)


def vector() -> list[Column]:
    """The transformed statistics, in whole 1/256ths: log length, log mean word length, and roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    parts = (
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.least(F.col("n_dup_lines") / n * 4, F.lit(16.0))),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(parts)]


def reject_outliers(docs: DataFrame, tag: str | None = None) -> DataFrame:
    """(doc_id, lang, source, statistics, base_failed, distance, kept) for every row of ``docs``.

    ``base_failed``: fewer than 50 words, or repeated windows cover over half of
    them; such rows are not kept and take no part in the estimates. Others are
    kept unless their squared Mahalanobis ``distance`` from their group's
    estimate passes the group's cut. Null languages and sources are groups of their
    own; null and empty texts have no words and fail the base rule; repeated
    rows count repeatedly. ``distance`` is null where no estimate applies.
    """
    tag = tag or new_tag("outliers")
    stats = table(with_rule_stats(docs.select("doc_id", "lang", "source", "text")), tag)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    sizes = stats.filter("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("_rows"))
    groups = sizes.withColumn("_own", F.col("_rows") >= MIN_ROWS)
    groups = groups.select("lang", "source", F.sha2(F.to_json(F.struct("lang", F.when(F.col("_own"), F.col("source")), "_own"), {"ignoreNullFields": "false"}), 256).alias("g"))
    groups = table(groups, tag)
    keyed = stats.alias("s").join(groups.alias("g"), F.col("s.lang").eqNullSafe(F.col("g.lang")) & F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", "g.g", *vector())
    keyed = table(keyed, tag)
    fitted = estimate(keyed.filter("NOT base_failed").select("g", *(f"x{i}" for i in range(D))), tag)
    out = keyed.join(fitted, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    # a row for each group: as tables their size is known, so Spark broadcasts them while they are small and a hot group stays dealt
    out = out.join(table(_cuts(out.filter("distance IS NOT NULL")), tag), "g", "left")
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= F.col("cut")))
    return out.withColumn("kept", kept).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def _cuts(rows: DataFrame) -> DataFrame:
    """(g, cut): the cut of each group of ``rows`` (g, distance), from its median distance in bins of a 16th of a doubling."""
    bins = rows.groupBy("g", F.floor(16 * F.log2(F.col("distance") + 0.01)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("g")
    bins = bins.withColumn("_upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("_all", F.sum("n").over(whole))
    median = bins.filter(2 * F.col("_upto") >= F.col("_all")).groupBy("g").agg(F.pow(F.lit(2.0), (F.min("bin") + 1) / 16).alias("median"))
    return median.select("g", (F.greatest(F.col("median") / chi2_quantile(0.5, D), F.lit(1.0)) * chi2_quantile(QUANTILE, D)).alias("cut"))


def estimate(rows: DataFrame, tag: str) -> DataFrame:
    """(g, center, inverse): location and inverse scatter of each group of ``rows`` (g, x0, x1, ...)."""
    now = table(_start(rows), tag)
    steps = [now]
    for _ in range(MAX_STEPS):
        binned = rows.join(now, "g").withColumn("bin", F.floor(16 * F.log2(_distance() + 0.01)).cast("int"))
        products = [(i, j) for i in range(D) for j in range(i, D)]
        sums = binned.groupBy("g", "bin").agg(F.count("*").alias("n"), F.max("logdet").alias("was"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(D)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in products))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("bin")) - F.col("n")
        near = sums.withColumn("_below", upto).withColumn("_all", F.sum("n").over(Window.partitionBy("g"))).filter(F.col("_below") < COVERAGE * F.col("_all"))
        held = near.groupBy("g").agg(F.first("_all").alias("rows"), F.max("was").alias("was"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums.columns if c[0] in "sp"))
        now = table(held.mapInPandas(_solve, "g string, center array<double>, inverse array<double>, logdet double"), tag)
        if now.isEmpty():
            break
        steps.append(now)
    found = reduce(DataFrame.union, steps).groupBy("g").agg(F.min_by(F.struct("center", "inverse"), "logdet").alias("_best"))
    return table(found.select("g", "_best.*"), tag)


def _distance() -> Column:
    """Squared Mahalanobis distance of x0, x1, ... from ``center`` by the row-major ``inverse``."""
    z = [F.col(f"x{i}") / float(SCALE) - F.element_at("center", i + 1) for i in range(D)]
    parts = [(1.0 if i == j else 2.0) * z[i] * z[j] * F.element_at("inverse", i * D + j + 1) for i in range(D) for j in range(i, D)]
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return F.greatest(total, F.lit(0.0))


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and a diagonal scatter from quartiles, by exact counts of the whole-number values."""
    cells = rows.select("g", F.posexplode(F.array(*(f"x{i}" for i in range(D)))).alias("i", "v")).groupBy("g", "i", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("g", "i").orderBy("v")
    cells = cells.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("g", "i")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v"))) / float(SCALE)
    marks = cells.groupBy("g", "i").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"), F.max("all").alias("rows"))
    marks = marks.filter(F.col("rows") >= MIN_ROWS)
    floors = F.array(*map(F.lit, FLOORS))
    marks = marks.withColumn("sd", F.greatest((F.col("high") - F.col("low")) / 1.349, F.element_at(floors, F.col("i") + 1)))
    gathered = marks.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "mid", "sd"))).alias("m"))
    inverse = [F.when(F.lit(i == j), 1 / F.pow(F.col("m")[i]["sd"], 2)).otherwise(0.0) for i in range(D) for j in range(D)]
    return gathered.select("g", F.col("m.mid").alias("center"), F.array(*inverse).alias("inverse"), F.lit(float("inf")).alias("logdet"))


def _solve(frames):
    """Mean and inverse covariance from each group's sums, with the floors added to the variances, if its determinant falls."""
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            n = row["n"]
            mean = np.array([row[f"s{i}"] / n for i in range(D)]) / SCALE
            cov = np.zeros((D, D))
            for i in range(D):
                for j in range(i, D):
                    cov[i, j] = cov[j, i] = (int(row[f"p{i}_{j}"]) * int(n) - int(row[f"s{i}"]) * int(row[f"s{j}"])) / n / n / SCALE**2
            scatter = cov * consistency(n / row["rows"], D) + np.diag(np.square(FLOORS))
            logdet = float(np.linalg.slogdet(scatter)[1])
            if logdet < row["was"] - 1e-9:
                out.append((row["g"], mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), logdet))
        yield pd.DataFrame(out, columns=["g", "center", "inverse", "logdet"])
