import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import joins


def day(n):
    return dt.date(2024, 1, n)


def quotes(spark):
    return spark.createDataFrame([("a", day(1)), ("a", day(3)), ("a", day(5)), ("b", day(3))], "symbol string, date date")


def test_as_of_takes_the_whole_latest_row(spark):
    events = spark.createDataFrame([("a", day(2), 1.0), ("a", day(3), None), ("c", day(1), 9.0)], "symbol string, event_date date, v double")
    got = {(r.symbol, r.date): r.v for r in joins.as_of(quotes(spark), events, ["v"]).collect()}
    assert got == {("a", day(1)): None, ("a", day(3)): None, ("a", day(5)): None, ("b", day(3)): None}
    strict = {(r.symbol, r.date): r.v for r in joins.as_of(quotes(spark), events, ["v"], strict=True).collect()}
    assert strict[("a", day(3))] == 1.0 and strict[("a", day(5))] is None


def test_lifecycle_ends(spark):
    master = spark.createDataFrame([("a", day(1), day(5)), ("b", day(4), None)], "symbol string, list_date date, delist_date date")
    assert joins.within_lifecycle(quotes(spark), master).count() == 2
    assert joins.within_lifecycle(quotes(spark), master, closed=True).count() == 3


def test_event_window_edges(spark):
    events = spark.createDataFrame([("a", day(1)), ("a", day(3))], "symbol string, date date").withColumn("at", F.col("date"))
    count = {"n": F.count("at")}
    strict = {(r.symbol, r.date): r.n for r in joins.event_window(quotes(spark), events, 2, count).collect()}
    assert strict == {("a", day(1)): 0, ("a", day(3)): 1, ("a", day(5)): 1, ("b", day(3)): 0}
    whole = {(r.symbol, r.date): r.n for r in joins.event_window(quotes(spark), events, 2, count, strict=False).collect()}
    assert whole[("a", day(3))] == 2 and whole[("a", day(5))] == 1


def test_bitemporal_latest_prefers_the_period(spark):
    facts = spark.createDataFrame([("a", day(1), day(2), 1.0), ("a", dt.date(2023, 12, 1), day(4), 2.0), ("a", day(2), None, 3.0)], "symbol string, period date, published date, v double")
    got = {r.date: r.v for r in joins.latest_known(quotes(spark).filter("symbol = 'a'"), facts, ["period"], "published", strict=True).collect()}
    assert got == {day(1): None, day(3): 1.0, day(5): 1.0}


def test_snapshot_absence_is_not_membership(spark):
    snaps = spark.createDataFrame([("a", day(1), 5), ("b", day(4), 6)], "symbol string, taken date, w int")
    got = {(r.symbol, r.date): r.w for r in joins.snapshot_as_of(quotes(spark), snaps, "taken", ["w"]).collect()}
    assert got == {("a", day(1)): 5, ("a", day(3)): 5, ("a", day(5)): None, ("b", day(3)): None}
