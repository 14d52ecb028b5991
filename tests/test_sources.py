import pytest
from pyspark.sql import functions as F

from tidemark.operators.panel import densify, technical_features
from tidemark.sources import readers
from tidemark.streaming import replay


def test_contract_load(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("trade_date,code,close\n2024-01-02,000001.SZ,1.5\n20240103,000001.SZ,nan\n2024-1-4,000002.SZ,2\n")
    with pytest.raises(ValueError, match="null_date"):
        readers.load(spark, str(good), readers.QUOTES)
    good.write_text("trade_date,code,close\n2024-01-02,000001.SZ,1.5\n20240103,000001.SZ,2\n")
    df = readers.load(spark, str(good), readers.QUOTES)
    assert df.count() == 2 and readers.table_hash(df) == readers.table_hash(df.orderBy(F.desc("date")))
    good.write_text("trade_date,code,close\n2024-01-02,000001.SZ,1.5\n2024-01-02,000001.SZ,2\n")
    with pytest.raises(ValueError, match="repeated_keys"):
        readers.load(spark, str(good), readers.QUOTES)


def test_symbols(spark):
    rows = spark.createDataFrame([("1",), ("600519",), ("430001.bj",)], "s string")
    assert [r[0] for r in rows.select(readers.normal_symbol(F.col("s"))).collect()] == ["000001.SZ", "600519.SH", "430001.BJ"]


def test_densify_and_empty(spark):
    rows = spark.createDataFrame([("2024-01-01", 1, 5.0, 1.0, 2.0), ("2024-01-08", 2, 6.0, 1.0, 3.0)], "date string, symbol long, amount double, volume double, close double").withColumn("date", F.col("date").cast("date"))
    got = densify(rows).orderBy("symbol", "date").collect()
    assert [(r.symbol, r.close, r.is_suspended) for r in got] == [(1, 2.0, False), (1, 2.0, True), (2, 3.0, False)]
    assert technical_features(densify(rows.limit(0))).count() == 0


def test_streaming_totals(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-09 00:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = replay.windowed_totals(replay.event_stream(spark, str(tmp_path / "in"), rows.schema, 10))
    run = stream.writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.n, r.value) for r in spark.table("totals").collect()} == {(2, 3.0)}
