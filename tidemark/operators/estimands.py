"""Registered estimands: a table of contrasts drives all differences over the study's cells in one pass.

An estimand is a weighted sum of monthly values, each of a variant and factor:
a paired difference has two terms, a Shapley value one for each set of
components, a step of the timing decomposition one. A month counts if all of
its terms have a value. Means, HAC inference, multiplicity by family and the
gate on claims follow for all estimands alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lattice, study

#: Fixed values of the registered plan: months that a claim needs, levels of the families, tolerance of the controls, steps of the timing change.
CLAIM_MONTHS, PRIMARY_ALPHA, SECONDARY_FDR, ISOLATION_TOLERANCE = 60, 0.05, 0.10, 1e-12
TIMING_STEPS = ("report_support_restriction", "record_replacement", "publication_extension")


@dataclass(frozen=True)
class Estimand:
    """``terms`` maps (variant, factor) to a weight."""

    name: str
    family: str
    terms: dict[tuple[str, str], float]


def _paired(name: str, family: str, factor: str, minuend: str, subtrahend: str) -> Estimand:
    return Estimand(name, family, {(minuend, factor): 1.0, (subtrahend, factor): -1.0})


def registered() -> list[Estimand]:
    """One primary estimand, 28 secondary ones and two controls."""
    final, report, publication = "A0_final_report_end", "A1_pit_report_end", "A2_base"
    variant = lambda s: "A2_" + ("+".join(c for c in lattice.COMPONENTS if c in s) or "base")
    full = variant(lattice.COMPONENTS)
    out = [_paired("P1_roe_publication", "primary", "roe", publication, report), _paired("S_composite_publication", "secondary", "composite", publication, report)]
    out += [_paired(f"C_isolation_{f}", "control", f, publication, report) for f in ("momentum", "low_vol")]
    for f in lattice.FACTORS:
        out += [_paired(f"S_membership_{f}", "secondary", f, report, final), _paired(f"S_implementation_{f}", "secondary", f, full, publication)]
    out += [Estimand(f"S_timing_{step}", "secondary", {(f"timing:{step}", "roe"): 1.0}) for step in TIMING_STEPS]
    weights: dict[str, dict[str, float]] = {}
    for component, without, within, weight in study.shapley_weights(list(lattice.COMPONENTS)):
        own = weights.setdefault(component, {})
        for names, sign in ((within, 1), (without, -1)):
            key = variant(set() if names == "none" else set(names.split("+")))
            own[key] = own.get(key, 0.0) + sign * weight
    out += [Estimand(f"S_shapley_{f}_{c}", "secondary", {(v, f): w for v, w in own.items()}) for f in lattice.FACTORS for c, own in weights.items()]
    return out


def timing_values(decomposed: DataFrame) -> DataFrame:
    """(date, variant, factor, value) of the steps of ``lattice.timing_decomposition``."""
    steps = F.array(*(F.struct(F.lit(f"timing:{s}").alias("variant"), F.col(s).alias("value")) for s in TIMING_STEPS))
    return decomposed.select("date", F.explode(steps).alias("x")).select("date", "x.variant", F.lit("roe").alias("factor"), "x.value")


def contrasts(values: DataFrame, estimands: list[Estimand]) -> DataFrame:
    """(estimand, date, value, terms, known): months in which an estimand has a value, and those in which terms lack.

    ``values`` has (date, variant, factor, value), a row for each of the first
    three. The table of terms is fixed and small and meets every value once.
    Values are taken to 12 places, so that the noise of floating sums, whose
    order varies, isn't taken for a difference.
    """
    spark: SparkSession = values.sparkSession
    terms = [(e.name, v, f, w) for e in estimands for (v, f), w in e.terms.items()]
    size = spark.createDataFrame([(e.name, len(e.terms)) for e in estimands], "estimand string, terms long")
    met = values.join(F.broadcast(spark.createDataFrame(terms, "estimand string, variant string, factor string, weight double")), ["variant", "factor"])
    months = met.groupBy("estimand", "date").agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.count("*").alias("rows"), F.count("value").alias("known"))
    months = months.join(F.broadcast(size), "estimand")
    return months.select("estimand", "date", F.when(F.col("known") == F.col("terms"), F.round("value", 12)).alias("value"), "terms", "rows", "known")


def summaries(months: DataFrame, estimands: list[Estimand], gate: DataFrame, lags: int = 3, claim_months: int = CLAIM_MONTHS) -> DataFrame:
    """One row for each estimand: months, mean, inference, adjusted p, and whether it may be claimed and rejects.

    ``gate`` is one row with ``passed``; unless that is true nothing may be
    claimed. Secondary p-values are adjusted together (Benjamini-Hochberg,
    missing ones count); controls say if their differences are nothing.
    """
    spark = months.sparkSession
    listed = spark.createDataFrame([(e.name, e.family) for e in estimands], "estimand string, family string")
    counted = months.groupBy("estimand").agg(
        F.count("value").alias("months"), F.count_if((F.col("known") > 0) & (F.col("known") < F.col("terms"))).alias("unmatched"),
        F.count_if((F.col("rows") == F.col("terms")) & F.col("value").isNull()).alias("not_estimable"), F.max(F.abs("value")).alias("largest"),
    )
    tested = lattice.mean_inference(study.newey_west(months, ["estimand"], "value", "date", lags)).drop("n")
    rows = F.broadcast(listed).join(counted, "estimand", "left").join(tested, "estimand", "left").na.fill(0, ["months", "unmatched", "not_estimable"])
    rows = study.adjust_p(rows, "family", "p_value", "estimand").drop("holm")
    adjusted = F.when(F.col("family") == "primary", F.col("p_value")).when(F.col("family") == "secondary", F.col("bh"))
    level = F.when(F.col("family") == "primary", PRIMARY_ALPHA).otherwise(SECONDARY_FDR)
    rows = rows.crossJoin(F.broadcast(gate.select(F.coalesce("passed", F.lit(False)).alias("passed"))))
    claim = F.col("passed") & (F.col("family") != "control") & (F.col("months") >= claim_months) & F.col("p_value").isNotNull()
    isolated = F.when((F.col("family") == "control") & (F.col("months") > 0), (F.col("unmatched") == 0) & (F.col("largest") <= ISOLATION_TOLERANCE))
    out = rows.withColumns({"adjusted_p": adjusted, "may_claim": claim, "isolated": isolated})
    rejects = F.col("may_claim") & F.coalesce(F.col("adjusted_p") <= level, F.lit(False))
    return out.select("estimand", "family", "months", "unmatched", "not_estimable", "mean", "standard_error", "t_stat", "p_value", "ci_low", "ci_high", "adjusted_p", "isolated", "may_claim", rejects.alias("rejects"))
