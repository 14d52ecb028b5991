"""Quote and master scans, prepared panels, synthetic quotes, canonical artifacts."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import panels, readers
from tidemark.sources.assets import AssetError

D = datetime.date


def test_quotes_by_dates_and_symbols(spark, tmp_path):
    (tmp_path / "q.csv").write_text("trade_date,code,close,amount,volume\n2024-01-02,000001.SZ,1.5,,\n20240103,000001,2,5,1\n2024-01-03,000001.SZ,2,5,\n2024-01-04,000002.SZ,x,1,1\n,000002.SZ,1,1,1\n2024-02-01,000002.SZ,3,1,1\n")
    at = f"file://{tmp_path}/q.csv"
    got = panels.scan_quotes(spark, at, "2024-01-01", "2024-01-31").orderBy("date").collect()
    assert [(r.date, r.symbol, r.close, r.amount, r.volume) for r in got] == [(D(2024, 1, 2), "000001.SZ", 1.5, None, None), (D(2024, 1, 3), "000001.SZ", 2.0, 5.0, 1.0)]
    only = spark.createDataFrame([("000002.SZ",)], "symbol string")
    assert panels.scan_quotes(spark, at, "2024-01-01", "2024-02-28", only).select("close").collect() == [(3.0,)]
    with pytest.raises(AssetError):
        panels.scan_quotes(spark, at, "2025-01-01", "2025-02-28")


def test_master_has_a_row_for_each_symbol(spark, tmp_path):
    (tmp_path / "m.csv").write_text("symbol,listDate,delistDate,listStatus\n000001.SZ,2001-01-01,2010-01-01,delisted\n000001.SZ,2000-01-01,2011-01-01,\n000002.SZ,2002-01-01,,listed\n000002.SZ,2002-01-01,2003-01-01,\n,2002-01-01,,\n")
    got = {r.symbol: (r.list_date, r.delist_date, r.list_status) for r in panels.scan_master(spark, f"file://{tmp_path}/m.csv").collect()}
    assert got == {"000001.SZ": (D(2000, 1, 1), D(2011, 1, 1), "delisted"), "000002.SZ": (D(2002, 1, 1), None, "listed")}


def test_prepared_panel_checks_its_keys(spark):
    quotes = panels.synthetic_quotes(spark, 3, 40)
    rows = panels.prepared_panel(quotes.filter("date <> DATE '2020-01-10' OR symbol <> '000001.SH'"))
    assert rows.count() == 120 and rows.filter("is_suspended").select("symbol", "date").collect() == [("000001.SH", D(2020, 1, 10))]
    assert rows.filter("momentum_24 IS NOT NULL").count() == 3 * 16
    for bad in (quotes.unionByName(quotes.limit(1)), quotes.withColumn("date", F.when(F.col("symbol") != "000001.SH", F.col("date")))):
        with pytest.raises(ValueError, match="can't be prepared"):
            panels.prepared_panel(bad)
    with pytest.raises(ValueError, match="missing required"):
        panels.prepared_panel(quotes.drop("amount"))


def test_synthetic_quotes_are_the_same_on_every_run(spark):
    one, two = (panels.synthetic_quotes(spark, 5, 30, seed=3).repartition(n) for n in (1, 9))
    assert readers.table_hash(one) == readers.table_hash(two) != readers.table_hash(panels.synthetic_quotes(spark, 5, 30, seed=4))
    assert one.count() == 150 and one.filter("NOT (low <= close AND close <= high AND close > 0 AND volume >= 1000)").count() == 0


def test_artifacts_are_in_key_order(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string").repartition(3)
    readers.write_artifact(df, f"file://{tmp_path}/out", ["k"])
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"k":1,"v":"a"}', '{"k":2,"v":"b"}', '{"k":3,"v":"c"}']
    with pytest.raises(Exception, match="already exists"):
        readers.write_artifact(df, f"file://{tmp_path}/out", ["k"])
