"""Steps that must not go through their rows again and again."""

from tidemark.operators import study
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def test_adjusted_p_of_a_large_family_takes_one_pass(spark):
    rows = spark.range(40_000).selectExpr("'f' AS family", "id AS test", "CAST(id * 7919 % 40009 AS double) / 40009 AS p_value")
    out = study.adjust_p(rows, "family")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing" not in plan.lower()
    got = out.toPandas().sort_values("p_value")
    m, p = len(got), got.p_value.to_numpy()
    want, least = [0.0] * m, 1.0
    for i in range(m - 1, -1, -1):
        least = min(least, m / (i + 1) * p[i])
        want[i] = least
    assert abs(got.bh.to_numpy() - want).max() < 1e-12


def test_portfolio_is_simulated_once(spark):
    plan = registry.portfolio_metrics(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
