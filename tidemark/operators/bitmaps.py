"""Sets of symbols by date as bitmaps over a dense dictionary: unions, intersections and differences without joins of rows.

A symbol's place in the dictionary is its number in symbol order. Places are
held in buckets of 32,768 bits, so a date's set is a row for each bucket that
it touches, and sets of any size are combined bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbering import numbered

BITS = 32_768


def dictionary(keys: DataFrame, key: str) -> DataFrame:
    """(key, place): the distinct non-null keys, numbered from 0 in their order."""
    return numbered(keys.select(key).filter(F.col(key).isNotNull()).distinct(), [key], "place")


def build(rows: DataFrame, places: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by, bucket, bits): the set of each group's keys; keys that the dictionary lacks are an error.

    Repeated rows set a bit once. Bitmaps are made on the map side, so a group
    of very many rows is combined before it is shuffled.
    """
    at = F.coalesce(F.col("place"), F.raise_error(F.concat(F.lit("not in the dictionary: "), F.col(key).cast("string"))).cast("long"))
    placed = rows.filter(F.col(key).isNotNull()).select(*by, key).join(places, key, "left").withColumn("place", at)
    # bucket numbers count from 1 in Spark's functions
    return placed.groupBy(*by, F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))


def algebra(sets: DataFrame, by: list[str], side: str, a: str, b: str) -> DataFrame:
    """(by, n_a, n_b, both, either, only_a, only_b, one_side) of the sets ``a`` and ``b`` of each group.

    ``sets`` is ``build`` of both with ``side`` among its groups. Of a bucket's
    two bitmaps the union and the counts are taken in one grouped pass; the
    rest follows, as |A and B| = |A| + |B| - |A or B|.
    """
    two = sets.filter(F.col(side).isin(a, b))
    size = lambda s: F.coalesce(F.max(F.when(F.col(side) == s, F.bitmap_count("bits"))), F.lit(0))
    each = two.groupBy(*by, "bucket").agg(size(a).alias("x"), size(b).alias("y"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("u"))
    n_a, n_b, either = F.sum("x"), F.sum("y"), F.sum("u")
    return each.groupBy(*by).agg(
        n_a.alias("n_a"), n_b.alias("n_b"), (n_a + n_b - either).alias("both"), either.alias("either"), (either - n_b).alias("only_a"), (either - n_a).alias("only_b"), (2 * either - n_a - n_b).alias("one_side"),
    )


def members(sets: DataFrame, places: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by, key): the keys of each set again, bit by bit of the bytes that aren't zero."""
    byte = F.expr("transform(sequence(0, octet_length(bits) - 1), i -> struct(i AS at, conv(hex(substring(bits, i + 1, 1)), 16, 10) AS value))")
    filled = sets.select(*by, "bucket", F.explode(F.filter(byte, lambda x: x["value"] != "0")).alias("x"))
    bits = F.expr("explode(filter(sequence(0, 7), k -> (shiftright(int(x.value), k) & 1) = 1))").alias("k")
    at = (F.col("bucket") - 1) * BITS + F.col("x.at") * 8 + F.col("k")
    return filled.select(*by, "bucket", "x", bits).select(*by, at.cast("long").alias("place")).join(places, "place").select(*by, key)
