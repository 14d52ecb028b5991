"""The registered factor study: session-guarded features, variants of universe and availability, cells, timing and exposure.

A variant is a row of a small table; every cross-section is taken once with
flags, and exploded to the variants whose conditions it meets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import pct_rank, ratio, steady_mean
from tidemark.functions.dealing import dealt
from tidemark.operators.study import correlation

COMPONENTS = ("exclude_st", "exclude_suspended", "minimum_amount", "one_session_lag")
FACTORS, WEIGHTS = ("roe", "momentum", "low_vol", "composite"), {"roe": 0.5, "momentum": 0.3, "low_vol": 0.2}
LEAST = 5


def prepare(quotes: DataFrame, calendar: DataFrame, momentum: int = 60, width: int = 20, horizon: int = 20, size: int | None = None) -> DataFrame:
    """Features that hold only if the symbol was quoted on all sessions between, and returns between exact sessions.

    ``quotes`` has (symbol, date, close, amount), one row for each of both,
    ``calendar`` (date, session) and whatever else it knows of a date. Forward
    returns are between exact sessions; where an end is missing a reason says
    which. One shuffle by symbol serves features and returns; ``size``, about
    so many quotes, bounds the rows of its tasks.
    """
    rows = dealt(quotes.join(F.broadcast(calendar), "date"), size, "symbol")
    w = Window.partitionBy("symbol").orderBy("session")
    back = lambda c, k: F.lag(c, k).over(w)
    guarded = lambda k, x: F.when(F.col("session") - back("session", k) == k, x)
    rows = rows.withColumn("return_1", guarded(1, ratio(F.col("close"), back("close", 1)) - 1))
    last = w.rowsBetween(-(width - 1), 0)
    full = lambda x: F.count(x).over(last) == width
    rows = rows.withColumns({
        "momentum": guarded(momentum, ratio(F.col("close"), back("close", momentum)) - 1), "low_vol": guarded(width, F.when(full("return_1"), -F.stddev_samp("return_1").over(last))),
        "mean_amount": guarded(width - 1, F.when(full("amount"), F.avg("amount").over(last))),
    })
    # a range frame over session numbers holds the row of exactly that session or none: no shuffle beside the features' own
    near, far, late = (F.first("close").over(w.rangeBetween(k, k)) for k in (1, horizon, horizon + 1))
    rows = rows.withColumns({"_near": near, "_far": far, "_late": late})
    near, far, late = F.col("_near"), F.col("_far"), F.col("_late")
    out = rows.withColumns({
        "future_same": ratio(far, F.col("close")) - 1,
        "future_same_reason": F.when(far.isNull(), "MISSING_EXACT_FORWARD_EXIT"),
        "future_lagged": ratio(late, near) - 1,
        "future_lagged_reason": F.when(near.isNull(), "MISSING_EXACT_LAG_ENTRY").when(late.isNull(), "MISSING_EXACT_LAG_EXIT"),
    })
    return out.drop("_near", "_far", "_late")


def variants() -> list[dict]:
    """Final survivors, point in time, and the latter by publication with each of the 16 sets of components."""
    plain = [{"variant": "A0_final_report_end", "universe": "final", "available": "report", "components": ()}, {"variant": "A1_pit_report_end", "universe": "pit", "available": "report", "components": ()}]
    sets = [c for size in range(len(COMPONENTS) + 1) for c in combinations(COMPONENTS, size)]
    return plain + [{"variant": "A2_" + ("+".join(c) or "base"), "universe": "pit", "available": "publication", "components": c} for c in sets]


def stage2_cross_sections(rows: DataFrame, minimum: float, size: int | None = None) -> DataFrame:
    """(date, symbol, variant, factors, outcome, reason) of all variants.

    ``rows`` has one row for each candidate: features, both outcomes, ``in_final``,
    ``in_pit``, ``is_st``, ``is_suspended``, and ``roe_report`` and
    ``roe_publication``. Variants are told apart by conditions on the row, so
    the table is read once. ``size``, the number of candidates, bounds the
    rows of a task here and in what takes the sections.
    """
    tests = {"exclude_st": F.col("is_st") == F.lit(False), "exclude_suspended": F.col("is_suspended") == F.lit(False), "minimum_amount": F.col("mean_amount") >= minimum}
    chosen = {}
    for v in variants():
        ok = F.col("in_final" if v["universe"] == "final" else "in_pit")
        for c in v["components"]:
            ok = ok & tests.get(c, F.lit(True))
        chosen[v["variant"]] = (ok, v["available"], "one_session_lag" in v["components"])
    return _sections(rows, chosen, size)


def legacy_cross_sections(rows: DataFrame, minimum: float, size: int | None = None) -> DataFrame:
    """The same of the four early variants: final survivors, point in time, with publication dates, and audited with a lag."""
    audited = F.col("in_pit") & ~F.col("is_st") & ~F.col("is_suspended") & (F.col("mean_amount") >= minimum)
    chosen = {
        "M0_naive": (F.col("survives"), "report", False),
        "M1_pit_universe": (F.col("in_pit"), "report", False),
        "M2_pit_publication": (F.col("in_pit"), "publication", False),
        "M3_audited_lag": (audited, "publication", True),
    }
    return _sections(rows, chosen, size)


def _sections(rows: DataFrame, chosen: dict[str, tuple[Column, str, bool]], size: int | None) -> DataFrame:
    """One row for each variant whose condition a row meets; each has a ROE by availability and a return, lagged or not."""
    options = []
    for name, (ok, available, late) in chosen.items():
        kind = "lagged" if late else "same"
        option = F.struct(
            F.lit(name).alias("variant"), F.col(f"roe_{available}").alias("roe"), F.col(f"future_{kind}").alias("outcome"),
            F.col(f"future_{kind}_reason").alias("reason"), F.lit(late).alias("late"),
        )
        options.append(F.when(ok, option))
    met = F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("v")
    most = None if size is None else size * len(chosen)
    out = dealt(rows, most, "symbol").select("date", "symbol", "momentum", "low_vol", met).select("date", "symbol", "v.variant", "v.roe", "momentum", "low_vol", "v.outcome", "v.reason", "v.late")
    return dealt(out, most, "date", "variant")


def factor_rows(sections: DataFrame) -> DataFrame:
    """(date, variant, symbol, outcome, reason, late, factor, score) of all factors.

    The composite is a weighted sum of ranks over the whole section, missing if one is.
    """
    total = F.lit(0.0)
    for f, weight in WEIGHTS.items():
        total = total + weight * pct_rank(F.col(f), "date", "variant")
    scores = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("score")) for f in FACTORS))).alias("x")
    kept = ["date", "variant", "symbol", "outcome", "reason", "late"]
    return sections.withColumn("composite", F.round(total, 9)).select(*kept, scores).select(*kept, "x.*")


def cells(sections: DataFrame, strict: bool = True, size: int | None = None) -> DataFrame:
    """(date, variant, factor, candidates, eligible, unresolved, n, ic, spread) of each cell.

    Below five complete cases there is no figure; ``strict``: nor where an
    eligible symbol's outcome is missing. ``size``: about so many rows of
    ``sections``; factors of a section are ranked in tasks of their own then.
    """
    long = factor_rows(sections)
    whole = F.col("score").isNotNull() & F.col("outcome").isNotNull()
    both = long.withColumns({"_s": F.when(whole, F.col("score")), "_o": F.when(whole, F.col("outcome"))})
    by = ["date", "variant", "factor"]
    both = dealt(both.select(*by, "score", "outcome", "_s", "_o"), None if size is None else size * len(FACTORS), *by)
    both = both.withColumns({"_x": pct_rank(F.col("_s"), *by), "_y": pct_rank(F.col("_o"), *by)})
    out = both.groupBy(*by).agg(
        F.count("*").alias("candidates"), F.count("score").alias("eligible"), F.count_if(F.col("score").isNotNull() & F.col("outcome").isNull()).alias("unresolved"), F.count("_s").alias("n"),
        correlation("_x", "_y").alias("ic"), (steady_mean(F.when(F.col("_x") > 0.8, F.col("_o"))) - steady_mean(F.col("_o"))).alias("spread"),
    )
    ok = (F.col("n") >= LEAST) & (F.col("unresolved") == 0) if strict else F.col("n") >= LEAST
    return out.withColumns({"ic": F.when(ok, F.col("ic")), "spread": F.when(ok, F.col("spread"))})


def endpoint_codes(sections: DataFrame) -> DataFrame:
    """``factor_rows`` of the symbols that have a factor's signal, with ``resolution``: how the outcome was resolved.

    A missing outcome without a reason counts as its return's first missing
    end: the entry of a lagged return, the exit of another.
    """
    fallback = F.when(F.col("late"), "MISSING_EXACT_LAG_ENTRY").otherwise("MISSING_EXACT_FORWARD_EXIT")
    stated = F.when(F.trim("reason") != "", F.col("reason"))
    code = F.when(F.col("outcome").isNotNull(), "RESOLVED").otherwise(F.coalesce(stated, fallback))
    return factor_rows(sections).filter(F.col("score").isNotNull()).withColumn("resolution", code)


def endpoint_records(sections: DataFrame) -> DataFrame:
    """(date, variant, factor, resolution, n): how many of a factor's signals were resolved how."""
    return endpoint_codes(sections).groupBy("date", "variant", "factor", "resolution").agg(F.count("*").alias("n"))


def publication_exposure(rows: DataFrame) -> DataFrame:
    """By date: support of report-end and publication signals, premature records, changed periods and delays; no outcomes.

    ``rows`` has (date, symbol, roe_report, period_report, published_report, roe_publication, period_publication).
    """
    r, p = F.col("roe_report").isNotNull(), F.col("roe_publication").isNotNull()
    premature = F.count_if(r & (F.col("published_report") >= F.col("date")))
    changed = F.count_if(r & p & ~F.col("period_report").eqNullSafe(F.col("period_publication")))
    delay = F.when(r, F.datediff("published_report", "period_report"))
    return rows.groupBy("date").agg(
        F.count_if(r).alias("report_signals"), F.count_if(p).alias("publication_signals"), F.count_if(r & p).alias("common_signals"), F.count_if(r & ~p).alias("report_only"), F.count_if(p & ~r).alias("publication_only"), premature.alias("premature"), ratio(premature, F.count_if(r)).alias("premature_share"),
        changed.alias("changed_period"), ratio(changed, F.count_if(r & p)).alias("changed_share"), F.count_if(r & F.col("published_report").isNull()).alias("missing_publication"), F.avg(delay).alias("mean_delay"), F.percentile(delay, 0.25).alias("p25_delay"), F.median(delay).alias("median_delay"), F.percentile(delay, 0.75).alias("p75_delay"), F.max(delay).alias("max_delay"),
    )


def timing_decomposition(rows: DataFrame, size: int | None = None) -> DataFrame:
    """By date: the IC of publication signals less that of report-end ones, in three steps over their common support.

    ``rows`` has (date, symbol, roe_report, roe_publication, outcome); dates with
    an unresolved outcome or fewer than five cases in a step have no figures.
    """
    whole = F.col("outcome").isNotNull()
    r, p = F.when(whole, F.col("roe_report")), F.when(whole, F.col("roe_publication"))
    both = whole & F.col("roe_report").isNotNull() & F.col("roe_publication").isNotNull()
    sides = {"r": (r, r.isNotNull()), "p": (p, p.isNotNull()), "rc": (F.when(both, r), both), "pc": (F.when(both, p), both)}
    kept = dealt(rows.select("date", "roe_report", "roe_publication", "outcome"), size, "date")
    ranked = kept.withColumns({f"_{k}": x for k, (x, _) in sides.items()} | {f"_o_{k}": F.when(ok, F.col("outcome")) for k, (_, ok) in sides.items()})
    ranked = ranked.withColumns({f"_x_{k}": pct_rank(F.col(f"_{k}"), "date") for k in sides} | {f"_y_{k}": pct_rank(F.col(f"_o_{k}"), "date") for k in sides})
    lost = F.count_if(~whole & (F.col("roe_report").isNotNull() | F.col("roe_publication").isNotNull()))
    out = ranked.groupBy("date").agg(F.count("_r").alias("n_report"), F.count("_p").alias("n_publication"), F.count("_rc").alias("n_common"), lost.alias("unresolved"), *(F.when(F.count(f"_{k}") >= LEAST, correlation(f"_x_{k}", f"_y_{k}")).alias(f"ic_{k}") for k in sides))
    ok = (F.col("unresolved") == 0) & F.col("ic_r").isNotNull() & F.col("ic_p").isNotNull() & F.col("ic_rc").isNotNull() & F.col("ic_pc").isNotNull()
    step = lambda a, b: F.when(ok, F.col(f"ic_{a}") - F.col(f"ic_{b}"))
    return out.select("date", "n_report", "n_publication", "n_common", "unresolved", step("rc", "r").alias("report_support_restriction"), step("pc", "rc").alias("record_replacement"), step("p", "pc").alias("publication_extension"), step("p", "r").alias("total"))


def two_sided_p(t: Column) -> Column:
    """Probability of a normal value further from 0 than ``t`` (NULL for NULL), by the series of the error function (all of whose terms are positive)."""
    x = F.least(F.abs(t), F.lit(8.0)) / F.lit(2.0**0.5)
    start = F.struct(x.alias("term"), x.alias("sum"))
    grown = lambda a, n: F.struct((a["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * x * x / (2 * n + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, grown, lambda a: a["sum"])
    return F.when(t.isNotNull(), F.greatest(1 - 2 / F.lit(3.141592653589793**0.5) * F.exp(-x * x) * series, F.lit(0.0)))


def mean_inference(tested: DataFrame) -> DataFrame:
    """``study.newey_west`` results with standard error, two-sided p-value and the 95 % interval."""
    se = F.when(F.col("t_stat") != 0, F.col("mean") / F.col("t_stat"))
    return tested.withColumn("standard_error", se).withColumns({"p_value": two_sided_p(F.col("t_stat")), "ci_low": F.col("mean") - 1.959963984540054 * F.col("standard_error"), "ci_high": F.col("mean") + 1.959963984540054 * F.col("standard_error")})
