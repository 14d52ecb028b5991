"""Ledgers: tables in one canonical order with a digest that any change of a record, or of their order, changes.

A record is a row as JSON, columns by name. Records in key order are cut into
blocks of ``BLOCK``, a block's digest is the SHA-256 of its records, one a
line; block digests are cut and hashed in the same way, level by level, until
one is left. So the digest doesn't depend on partitions, no task sees more
than a block, and two ledgers that differ can be compared block by block.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dealing import dealt
from tidemark.functions.numbering import numbered
from tidemark.sources.scratch import materialize

BLOCK = 256


def records(df: DataFrame) -> DataFrame:
    """``df`` with ``record``: the row as canonical JSON (columns by name, missing values left out)."""
    return df.withColumn("record", F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))))


def _level(parts: DataFrame, level: int, block: int, size: int | None = None) -> DataFrame:
    """(level, block, records, digest) of (number, part, size)."""
    cut = dealt(parts.withColumn("block", F.floor(F.col("number") / block).cast("long")), size, "block").groupBy("block")
    out = cut.agg(F.sum("size").alias("records"), F.array_sort(F.collect_list(F.struct("number", "part"))).alias("parts"))
    lines = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
    return out.select(F.lit(level).alias("level"), "block", "records", F.sha2(lines.cast("binary"), 256).alias("digest"))


def blocks(df: DataFrame, keys: list[str], block: int = BLOCK, levels: int | None = None, size: int | None = None) -> DataFrame:
    """(level, block, records, digest): the digests of all levels, or of the first ``levels``; none for an empty table.

    Rows that agree in all keys are ordered by their records, so that repeated
    rows have one order too. ``size``, about so many rows, bounds those of a task.
    """
    rows = numbered(records(df).select(*keys, "record"), [*keys, "record"], size=size)
    parts, out, level = rows.select("number", F.col("record").alias("part"), F.lit(1).cast("long").alias("size")), None, 1
    while True:
        now = materialize(_level(parts, level, block, size), "ledger")
        size = None if size is None else -(-size // block)
        out = now if out is None else out.unionByName(now)
        if level == levels or now.limit(2).count() < 2:
            return out
        parts, level = now.select(F.col("block").alias("number"), F.col("digest").alias("part"), F.col("records").alias("size")), level + 1


def digest(df: DataFrame, keys: list[str], block: int = BLOCK) -> tuple[int, str]:
    """(records, digest) of the whole table; (0, SHA-256 of nothing) for an empty one."""
    top = blocks(df, keys, block).orderBy(F.desc("level"), "block").first()
    return (top.records, top.digest) if top else (0, hashlib.sha256().hexdigest())


def changed_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """(block, left_records, right_records) of first-level blocks that two ledgers (as ``blocks`` gives them) don't share."""
    side = lambda df, name: df.filter("level = 1").select("block", F.col("records").alias(f"{name}_records"), F.col("digest").alias(f"{name}_digest"))
    both = side(left, "left").join(side(right, "right"), "block", "full_outer")
    return both.filter(~F.col("left_digest").eqNullSafe(F.col("right_digest"))).select("block", "left_records", "right_records")


def coverage_faults(ledger: DataFrame, cells: DataFrame, keys: list[str], code: str, resolved: str) -> DataFrame:
    """Cells whose ledger doesn't have exactly the records that the cell counts: (keys, reasons).

    ``ledger`` has a row for each record with ``keys`` and ``code``, ``cells``
    one row with ``keys``, ``candidates``, ``eligible``, ``unresolved``, ``n``.
    Rules are those of exact denominators; a cell may break several.
    """
    found = ledger.groupBy(*keys).agg(F.count("*").alias("_records"), F.count_if(F.col(code) == resolved).alias("_resolved"))
    both = cells.join(found, keys, "full_outer")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = {
        "CELL_UNKNOWN": F.col("candidates").isNull(),
        "ELIGIBLE_EXCEEDS_CANDIDATES": F.col("eligible") > F.col("candidates"),
        "RECORDS_DIFFER_FROM_ELIGIBLE": count("_records") != count("eligible"),
        "RESOLVED_DIFFERS_FROM_ESTIMABLE": count("_resolved") != count("n"),
        "COUNTS_DO_NOT_ADD_UP": F.col("n") + F.col("unresolved") != F.col("eligible"),
    }
    reasons = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    return both.select(*keys, reasons.alias("reasons")).filter(F.size("reasons") > 0)
