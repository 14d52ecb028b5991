"""Tasks of big steps grow in number with the rows, and results stay the same."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.dealing import dealt, tasks
from tidemark.operators import lattice, ledger, panel, study

VARIED = "CAST(id * 7919 % 1013 AS double) / 1013"


def _tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def _candidates(spark):
    same = f"CASE WHEN id % 11 <> 0 THEN {VARIED} - 0.4 END"
    return spark.range(600).selectExpr(
        "date_add(DATE'2000-01-01', CAST(id % 6 AS int) * 31) AS date", "id AS symbol", f"{VARIED} AS momentum", "CAST(id * 31 % 97 AS double) AS low_vol", "CAST(id % 9 AS double) * 1e4 AS mean_amount",
        f"{same} AS future_same", "CAST(NULL AS string) AS future_same_reason", f"{same} AS future_lagged", "CAST(NULL AS string) AS future_lagged_reason",
        "id % 3 <> 0 AS in_final", "id % 4 <> 0 AS in_pit", "id % 2 <> 0 AS survives", "id % 5 = 0 AS is_st", "id % 7 = 0 AS is_suspended", "CAST(id % 13 AS double) AS roe_report", "CAST(id % 17 AS double) AS roe_publication",
    )


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.na.fill(-9).na.fill("").collect())


def test_tasks():
    assert [tasks(n, 10) for n in (0, 1, 10, 11, 95)] == [1, 1, 1, 2, 10]


def test_dealt_is_not_merged(spark):
    rows = spark.range(2000).withColumn("k", F.col("id") % 100)
    assert _tasks(dealt(rows, 2000, "k", per_task=200)) == 10
    assert dealt(rows, None, "k") is rows


@pytest.mark.parametrize("take, strict, variants", [(lattice.stage2_cross_sections, True, 18), (lattice.legacy_cross_sections, False, 4)])
def test_cells_of_dealt_sections(spark, take, strict, variants):
    rows = _candidates(spark)
    size = 500_000 // variants
    sections = take(rows, 4e4, size)
    assert _tasks(sections) >= 4
    assert _rows(lattice.cells(sections, strict, size * variants)) == _rows(lattice.cells(take(rows, 4e4), strict))


def test_rank_ic_and_panels_are_dealt(spark):
    quotes = spark.range(900).selectExpr("date_add(DATE'2000-01-01', CAST(id DIV 60 AS int)) AS date", "id % 60 AS symbol", f"100 + {VARIED} AS close", "1.0D AS amount", "1.0D AS volume")
    dense = panel.densify(quotes, size=1_000_000)
    assert _tasks(dense) > 4 and _rows(dense) == _rows(panel.densify(quotes))
    cells = quotes.selectExpr("date", "symbol", "close AS score", "CAST(symbol * 37 % 11 AS double) AS outcome")
    assert _rows(study.rank_ic(cells, ["date"], size=600_000)) == _rows(study.rank_ic(cells, ["date"]))


def test_ledger_is_the_same_at_any_size(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS x")
    whole = _rows(ledger.blocks(rows, ["id"], block=16))
    assert whole == _rows(ledger.blocks(rows, ["id"], block=16, size=900_000))


def test_panel_is_dealt_by_its_lines(spark, monkeypatch):
    from tidemark.sources import adapter

    at = "/root/testdata/sf0.001"
    usual = _rows(adapter.daily_panel(spark, at).selectExpr("date", "symbol", "amount", "n_rows"))
    monkeypatch.setattr(adapter, "lines", lambda spark, d: 600_000)
    many = adapter.daily_panel(spark, at).selectExpr("date", "symbol", "amount", "n_rows")
    assert _tasks(many) == 6 and _rows(many) == usual
