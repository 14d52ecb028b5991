"""Snapshots with one byte, file, row or key changed; ledgers against one sequential pass; row numbers."""

import datetime
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions.numbering import numbered
from tidemark.operators import ledger
from tidemark.sources import scratch, snapshots

BARS = snapshots.Dataset({"date": "date", "symbol": "string", "close": "number", "volume": "integer", "known": "date"}, ("date", "symbol"), "known", frozenset({"volume"}), {"close_positive": "close > 0"})
MASTER = snapshots.Dataset({"symbol": "string", "listed": "boolean"}, ("symbol",))
CONTRACTS = {"bars": BARS, "master": MASTER}


@pytest.fixture
def root(spark, tmp_path):
    bars = spark.range(500).selectExpr("date_add(DATE '2020-01-01', CAST(id % 50 AS INT)) AS date", "concat('s', id div 50) AS symbol", "CAST(1.5 + id / 8 AS DECIMAL(18,4)) AS close", "IF(id % 3 = 0, NULL, id) AS volume", "DATE '2020-03-01' AS known")
    master = spark.range(10).selectExpr("concat('s', id) AS symbol", "id > 2 AS listed")
    snapshots.publish({"bars": bars, "master": master}, CONTRACTS, f"file://{tmp_path}/snap", "2020-06-30")
    return tmp_path / "snap"


def files(root, name):
    return sorted(p for p in (root / name).glob("*.csv") if p.stat().st_size > 80)


def load(spark, root):
    # a file changed on disk has an old checksum beside it, as a local file system keeps one
    for crc in root.glob("*/.*.crc"):
        crc.unlink()
    return snapshots.load(spark, f"file://{root}", CONTRACTS)


def test_whole_snapshot_loads(spark, root):
    got = load(spark, root)
    assert got["bars"].count() == 500 and got["bars"].agg(F.sum("volume")).first()[0] == sum(i for i in range(500) if i % 3)
    assert dict(got["bars"].dtypes)["close"] == "decimal(38,6)" and got["master"].filter("listed").count() == 7
    assert {r.verdict for r in snapshots.file_verdicts(spark, f"file://{root}", CONTRACTS).collect()} == {"ok"}


def test_one_byte_one_file_or_one_line_is_found(spark, root):
    one = files(root, "bars")[0]
    whole = one.read_bytes()
    at = whole.index(b"2020-03-01")
    one.write_bytes(whole[: at + 9] + b"2" + whole[at + 10 :])
    with pytest.raises(snapshots.SnapshotError, match=f"bars/{one.name}: hash"):
        load(spark, root)
    one.write_bytes(whole + b"\n")
    with pytest.raises(snapshots.SnapshotError, match="size"):
        load(spark, root)
    one.unlink()
    with pytest.raises(snapshots.SnapshotError, match="missing"):
        load(spark, root)
    one.write_bytes(whole)
    (root / "bars" / "part-x.csv").write_bytes(whole)
    with pytest.raises(snapshots.SnapshotError, match="unlisted"):
        load(spark, root)


def test_manifest_must_agree_with_itself_and_the_contract(spark, root):
    for part in (root / "manifest").glob("*.json"):
        rows = [json.loads(x) for x in part.read_text().splitlines()]
        for r in rows:
            r["cutoff"] = "2021-01-01"
        part.write_text("".join(json.dumps(r) + "\n" for r in rows))
    with pytest.raises(snapshots.SnapshotError, match="manifest: id"):
        load(spark, root)
    with pytest.raises(snapshots.SnapshotError, match="contract of master"):
        snapshots.load(spark, f"file://{root}", {"bars": BARS, "master": snapshots.Dataset({"symbol": "string"}, ("symbol",))})


def test_every_rule_of_a_row(spark):
    rows = [("2020-01-01", "a", "1.50", "1", "2020-01-01"), ("20200102", "a", "1.5", "01", "2020-01-01"), ("2020-01-03", None, "-1", None, "2020-12-31"), ("2020-01-04", "b", None, "x", None), ("2020-01-05", "c", "2", None, "2020-06-30")]
    raw = spark.createDataFrame(rows, "date string, symbol string, close string, volume string, known string")
    got = sorted((r.rule, r.key) for r in snapshots.broken_rules(raw, BARS, "2020-06-30").collect())
    assert got == sorted([
        ("spelling_close", "2020-01-01|a"), ("spelling_date", "20200102|a"), ("spelling_volume", "20200102|a"), ("missing_symbol", "2020-01-03|"), ("close_positive", "2020-01-03|"), ("after_cutoff", "2020-01-03|"),
        ("missing_close", "2020-01-04|b"), ("close_positive", "2020-01-04|b"), ("spelling_volume", "2020-01-04|b"), ("missing_known", "2020-01-04|b"),
    ])


def test_repeated_keys_and_empty_tables(spark, tmp_path):
    master = spark.createDataFrame([("a", True), ("a", True), ("a", False), ("b", None)], "symbol string, listed boolean")
    snapshots.publish({"master": master}, {"master": MASTER}, f"file://{tmp_path}/m", "2020-01-01")
    got = {(r.rule, r.rows, r.first_key) for r in snapshots.row_verdicts(spark, f"file://{tmp_path}/m", {"master": MASTER}).collect()}
    assert got == {("repeated_key", 2, "a"), ("missing_listed", 1, "b")}
    snapshots.publish({"master": master.limit(0)}, {"master": MASTER}, f"file://{tmp_path}/e", "2020-01-01")
    with pytest.raises(snapshots.SnapshotError):
        snapshots.load(spark, f"file://{tmp_path}/e", {"master": MASTER})


def plain_digest(lines, block):
    sha = lambda part: hashlib.sha256("\n".join(part).encode()).hexdigest()
    while True:
        lines = [sha(lines[i : i + block]) for i in range(0, len(lines), block)]
        if len(lines) < 2:
            return lines[0] if lines else hashlib.sha256().hexdigest()


@pytest.mark.parametrize("partitions", [1, 64])
def test_digest_is_that_of_one_sequential_pass(spark, partitions):
    rows = sorted((datetime.date(2020, 1, 1 + i * 7 % 28), f"s{i % 9}", float(i % 5)) for i in range(700))
    df = spark.createDataFrame(rows, "date date, symbol string, v double").withColumn("empty", F.lit(None).cast("string")).repartition(partitions)
    lines = sorted((d, s, json.dumps({"date": str(d), "symbol": s, "v": v}, separators=(",", ":"))) for d, s, v in rows)
    n, got = ledger.digest(df, ["date", "symbol"], block=16)
    assert (n, got) == (700, plain_digest([x for _, _, x in lines], 16))
    assert ledger.digest(df.limit(0), ["date"]) == (0, plain_digest([], 16))
    changed = df.withColumn("v", F.when((F.col("symbol") == "s3") & (F.col("date") == "2020-01-08"), F.col("v") + 1).otherwise(F.col("v")))
    assert ledger.digest(changed, ["date", "symbol"], block=16)[1] != got
    moved = ledger.changed_blocks(ledger.blocks(df, ["date", "symbol"], 16), ledger.blocks(changed, ["date", "symbol"], 16)).count()
    assert 1 <= moved <= 5


def test_coverage_faults_reach_every_code(spark):
    ledger_rows = spark.createDataFrame([("a", "RESOLVED")] * 3 + [("a", "M")] + [("b", "RESOLVED")] + [("x", "M")], "cell string, code string")
    cells = spark.createDataFrame([("a", 5, 4, 1, 3), ("b", 1, 2, 0, 1), ("c", 0, 0, 0, 0)], "cell string, candidates long, eligible long, unresolved long, n long")
    got = {r.cell: set(r.reasons) for r in ledger.coverage_faults(ledger_rows, cells, ["cell"], "code", "RESOLVED").collect()}
    assert got == {"b": {"ELIGIBLE_EXCEEDS_CANDIDATES", "RECORDS_DIFFER_FROM_ELIGIBLE", "COUNTS_DO_NOT_ADD_UP"}, "x": {"CELL_UNKNOWN", "RECORDS_DIFFER_FROM_ELIGIBLE"}}
    more = spark.createDataFrame([("a", 5, 4, 2, 2)], "cell string, candidates long, eligible long, unresolved long, n long")
    assert {r.cell: r.reasons for r in ledger.coverage_faults(ledger_rows.filter("cell = 'a'"), more, ["cell"], "code", "RESOLVED").collect()} == {"a": ["RESOLVED_DIFFERS_FROM_ESTIMABLE"]}


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r.number for r in numbered(df, ["k"]).collect())
    assert numbered(df.limit(0), ["k"]).count() == 0 and scratch.exists(spark, scratch.folder(spark)) and Path(scratch.folder(spark).removeprefix("file://")).is_dir()
