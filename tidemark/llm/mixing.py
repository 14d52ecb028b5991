"""Mixing sources to target weights (operator 1): capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_tag, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Sources of one seeded order are cut at one of this many hash ranges; only that range is sorted.
RANGES = 4096


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def sized(docs: DataFrame, tag: str | None = None) -> DataFrame:
    """(doc_id, source, size) as a scratch table: the texts are read once, the mix works on these rows."""
    return table(docs.select("doc_id", "source", word_count("text").alias("size")), tag or new_tag("mixing"))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    Targets are proportional to the weights and make up ``share`` of all sizes.
    Those above ``max_epochs`` times their source's size are clamped there and
    the excess is dealt to the others by weight, until none is above; if all
    are clamped they stay below the share. Each round is one aggregate of the
    sources; a level only rises, so it ends after as many rounds as there are
    sources at most. Null and non-positive weights get a target of 0.
    """
    now = sources.withColumn("weight", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = share * (now.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        full = (F.col("weight") * F.lit(level) > cap) if clamped >= 0 else F.lit(False)
        row = now.agg(F.count_if(full), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if row[0] == clamped or not row[2]:
            break
        clamped, level = row[0], (total - row[1]) / row[2]
    return now.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap) if clamped >= 0 else F.lit(0.0))


def mix(docs: DataFrame, weights: DataFrame, size: str = "size", share: float = 1.0, max_epochs: int = 2, seed: int = 7, tag: str | None = None) -> DataFrame:
    """``docs`` (with doc_id, source and a long column ``size``) with source_size, target, ``copies`` and ``taken``.

    ``weights`` has (source, weight); a source without weight gets none. A
    source of rate r = target / source_size takes every document floor(r)
    times. For the rest of the target, documents are ordered by a seeded hash
    and taken once more from the start, up to the one whose middle passes the
    rest: a uniform sample without replacement that misses the target by half
    a document at most. ``taken`` is copies times size. The hash is of seed and
    doc_id, so reruns agree; equal and null doc_ids follow each other by size,
    and rows that agree in both are interchangeable. Null sources are a source
    of their own, null sizes count as 0, and a table without words takes
    nothing. Columns named like the results are replaced; all others are kept,
    whatever their names.

    Only the hash range that holds a source's cut is sorted, a 4096th of the
    source, and what is before or after is decided from summed ranges; a hot
    source is therefore not gathered anywhere.
    """
    results = ("source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in results]
    words = F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # the input's columns travel as one struct, so that none of them can clash with those of the mix
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), "doc_id", "source", words.alias("words"), digest.alias("hash"))
    rows = rows.withColumn("range", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"))
    plan = _plan(rows, weights, share, max_epochs, tag or new_tag("mixing"))
    ranges = rows.groupBy("source", "range").agg(F.sum("words").alias("in_range"))
    before = F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")
    ranges = ranges.withColumn("before", before)
    cut = ranges.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    cut = cut.filter("r.before < p.extra AND r.before + r.in_range >= p.extra").groupBy("p.source").agg(F.min("r.range").alias("cut"), F.min_by("r.before", "r.range").alias("before"))
    plan = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", F.coalesce("c.cut", F.when(F.col("p.extra") > 0, F.lit(RANGES)).otherwise(-1)).alias("cut"), F.coalesce("c.before", F.lit(0)).alias("before"))
    rows = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.source_size", "p.target", "p.whole", "p.extra", "p.cut", "p.before")
    order = Window.partitionBy("source").orderBy("hash", "doc_id", "words").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.filter("range = cut").withColumn("middle", F.col("before") + F.sum("words").over(order) - F.col("words") / 2)
    inside = inside.withColumn("copies", F.col("whole") + (F.col("middle") < F.col("extra")).cast("int")).drop("middle")
    outside = rows.filter("range <> cut").withColumn("copies", F.col("whole") + (F.col("range") < F.col("cut")).cast("int"))
    both = inside.unionByName(outside)
    return both.select(*(F.col("doc")[c].alias(c) for c in kept), "source_size", "target", "copies", (F.col("copies") * F.col("words")).alias("taken"))


def _plan(rows: DataFrame, weights: DataFrame, share: float, max_epochs: int, tag: str) -> DataFrame:
    """A row for each source: source_size, target, whole repetitions and the words of the fractional one."""
    sources = rows.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    weighted = sources.alias("s").join(weights.select("source", "weight").alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left").select("s.*", "w.weight")
    filled = water_fill(table(weighted, tag), share, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")
    return table(filled.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), tag)


def cyclic_weights(docs: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, weight): the sources by code point, null last, weigh as ``cycle`` says, repeating."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))
    return docs.select("source").distinct().select("source", F.element_at(F.array(*map(F.lit, cycle)), at + 1).alias("weight"))
