"""Frozen snapshots: canonical CSV files with a manifest of their hashes, verified in full before a row is used.

``publish`` writes each table as CSV files, rows in key order, every value in
its one canonical spelling, and beside them a manifest with each file's size
and SHA-256 and the snapshot's id, the ledger digest of the manifest.
``file_verdicts`` hashes the files again on the executors and holds them
against the manifest; ``row_verdicts`` holds every row against its contract:
spelling, required values, keys, the cutoff and the contract's own rules.
``load`` gives the tables only if neither finds anything.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ledger


class SnapshotError(ValueError):
    """A snapshot that doesn't hold what its manifest or contract says."""


@dataclass(frozen=True)
class Dataset:
    """Columns with their kinds (string, date, integer, number, boolean), the key, and what good rows fulfil.

    ``available`` is a date column that may not be after the snapshot's cutoff;
    ``rules`` are SQL conditions over the typed columns, by name.
    """

    columns: dict[str, str]
    key: tuple[str, ...]
    available: str | None = None
    nullable: frozenset[str] = frozenset()
    rules: dict[str, str] = field(default_factory=dict)


_TYPES = {"string": "string", "date": "date", "integer": "bigint", "number": "decimal(38,6)", "boolean": "boolean"}


def spelled(x: Column, kind: str) -> Column:
    """A typed value in its canonical spelling: plain decimals without zeros at the end, ISO dates, true and false."""
    text = x.cast(_TYPES[kind]).cast("string")
    if kind == "number":
        text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when(text == "-0", "0").otherwise(text)
    return text


def typed(x: Column, kind: str) -> Column:
    """The value of a spelling, NULL if it has none."""
    return x if kind == "string" else x.try_cast(_TYPES[kind])


def publish(tables: dict[str, DataFrame], contracts: dict[str, Dataset], root: str, cutoff: str) -> str:
    """Write a snapshot below ``root`` and return its id. Rows aren't checked here; a reader does that."""
    spark = next(iter(tables.values())).sparkSession
    for name, contract in contracts.items():
        rows = tables[name].repartitionByRange(*contract.key).sortWithinPartitions(*contract.key)
        rows.select(*(spelled(F.col(c), kind).alias(c) for c, kind in contract.columns.items())).write.option("header", True).csv(f"{root}/{name}")
    listed = _files(spark, root, contracts)
    described = [(name, ",".join(f"{c}:{k}" for c, k in contract.columns.items()), ",".join(contract.key), cutoff) for name, contract in contracts.items()]
    described = spark.createDataFrame(described, "dataset string, columns string, key string, cutoff string")
    manifest = listed.join(F.broadcast(described), "dataset")
    _, snapshot = ledger.digest(manifest, ["dataset", "file"])
    manifest.withColumn("snapshot", F.lit(snapshot)).write.json(f"{root}/manifest")
    return snapshot


_MANIFEST = "dataset string, file string, bytes bigint, sha256 string, columns string, key string, cutoff string, snapshot string"


def _files(spark: SparkSession, root: str, contracts: dict[str, Dataset]) -> DataFrame:
    """(dataset, file, bytes, sha256) of all files there are, hashed where they are read."""
    parts = []
    for name in contracts:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{root}/{name}")
        parts.append(found.select(F.lit(name).alias("dataset"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))
    return reduce(DataFrame.unionByName, parts)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{root}/manifest")


def file_verdicts(spark: SparkSession, root: str, contracts: dict[str, Dataset]) -> DataFrame:
    """(dataset, file, verdict) of every file that is there or listed: ok, missing, unlisted, size or hash."""
    listed = manifest(spark, root).select("dataset", "file", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    both = _files(spark, root, contracts).join(listed, ["dataset", "file"], "full_outer")
    verdict = F.when(F.col("bytes").isNull(), "missing").when(F.col("_bytes").isNull(), "unlisted").when(F.col("bytes") != F.col("_bytes"), "size").when(F.col("sha256") != F.col("_sha256"), "hash").otherwise("ok")
    return both.select("dataset", "file", verdict.alias("verdict"))


def manifest_faults(spark: SparkSession, root: str, contracts: dict[str, Dataset]) -> list[str]:
    """What is wrong with the manifest itself: its id, the datasets it lists, their columns and keys, its cutoff."""
    rows = manifest(spark, root)
    heads = {r.dataset: r for r in rows.groupBy("dataset").agg(*(F.min(c).alias(c) for c in ("columns", "key", "cutoff", "snapshot")), *(F.count_distinct(c).alias(f"n_{c}") for c in ("columns", "key", "cutoff", "snapshot"))).limit(len(contracts) + 1).collect()}
    faults = [] if heads.keys() == contracts.keys() else ["datasets"]
    for name in heads.keys() & contracts.keys():
        head, contract = heads[name], contracts[name]
        want = (",".join(f"{c}:{k}" for c, k in contract.columns.items()), ",".join(contract.key))
        if (head.columns, head.key) != want or max(head.n_columns, head.n_key) > 1:
            faults.append(f"contract of {name}")
    if len({(r.cutoff, r.snapshot) for r in heads.values()}) != 1 or any(max(r.n_cutoff, r.n_snapshot) > 1 for r in heads.values()):
        faults.append("cutoff or id")
    elif ledger.digest(rows.drop("snapshot"), ["dataset", "file"])[1] != next(iter(heads.values())).snapshot:
        faults.append("id")
    return faults


def _raw(spark: SparkSession, root: str, name: str, contract: Dataset) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in contract.columns)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(f"{root}/{name}")


def broken_rules(rows: DataFrame, contract: Dataset, cutoff: str) -> DataFrame:
    """(rule, key) of every rule that a row of texts breaks."""
    kinds = contract.columns
    rows = rows.select(*(F.col(c).alias(f"_{c}") for c in kinds), *(typed(F.col(c), k).alias(c) for c, k in kinds.items()))
    broken = {}
    for c, kind in kinds.items():
        broken[f"spelling_{c}"] = F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(spelled(F.col(c), kind))
        if c not in contract.nullable:
            broken[f"missing_{c}"] = F.col(f"_{c}").isNull()
    if contract.available:
        broken["after_cutoff"] = F.col(contract.available) > F.lit(cutoff).cast("date")
    for name, rule in contract.rules.items():
        broken[name] = ~F.coalesce(F.expr(rule), F.lit(False))
    names = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in broken.items())))
    return rows.select(F.explode(names).alias("rule"), F.concat_ws("|", *(F.coalesce(F.col(f"_{c}"), F.lit("")) for c in contract.key)).alias("key"))


def row_verdicts(spark: SparkSession, root: str, contracts: dict[str, Dataset], cutoff: str | None = None) -> DataFrame:
    """(dataset, rule, rows, first_key) of every broken rule; rows that repeat a key count under repeated_key.

    ``cutoff`` is the manifest's if none is given. Each table is read twice:
    once for the rules of a row, once grouped by its key.
    """
    if cutoff is None:
        head = manifest(spark, root).select("cutoff").first()
        cutoff = head.cutoff if head else None
    parts = []
    for name, contract in contracts.items():
        raw = _raw(spark, root, name, contract)
        found = broken_rules(raw, contract, cutoff).groupBy("rule").agg(F.count("*").alias("rows"), F.min("key").alias("first_key"))
        keys = raw.groupBy(*contract.key).count().filter("count > 1")
        again = keys.select(F.col("count"), F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in contract.key)).alias("key"))
        again = again.agg(F.sum(F.col("count") - 1).alias("rows"), F.min("key").alias("first_key")).filter("rows > 0").select(F.lit("repeated_key").alias("rule"), "rows", "first_key")
        parts.append(found.unionByName(again).select(F.lit(name).alias("dataset"), "rule", "rows", "first_key"))
    return reduce(DataFrame.unionByName, parts)


def load(spark: SparkSession, root: str, contracts: dict[str, Dataset]) -> dict[str, DataFrame]:
    """The typed tables of a snapshot of which manifest, files and rows hold; else SnapshotError says what doesn't."""
    faults = [f"manifest: {x}" for x in manifest_faults(spark, root, contracts)]
    if not faults:
        faults = [f"{r.dataset}/{r.file}: {r.verdict}" for r in file_verdicts(spark, root, contracts).filter("verdict <> 'ok'").orderBy("dataset", "file").limit(20).collect()]
    if not faults:
        faults = [f"{r.dataset}: {r.rule} ({r.rows} rows, first {r.first_key})" for r in row_verdicts(spark, root, contracts).orderBy("dataset", "rule").collect()]
    for name, contract in contracts.items():
        if not faults and not _raw(spark, root, name, contract).limit(1).count():
            faults.append(f"{name}: no rows")
    if faults:
        raise SnapshotError("; ".join(faults))
    return {name: _raw(spark, root, name, contract).select(*(typed(F.col(c), k).alias(c) for c, k in contract.columns.items())) for name, contract in contracts.items()}
