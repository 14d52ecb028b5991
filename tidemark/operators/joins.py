"""Point-in-time joins. All run on equi-keys: one shuffle by symbol, no range join over whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(quotes: DataFrame, events: DataFrame, values: list[str], event_date: str = "event_date", strict: bool = False) -> DataFrame:
    """Each quote with the latest event of its symbol on or before (``strict``: before) its date.

    Quotes and events are united and the last event is carried forward as one
    struct, so that a NULL in the latest event isn't filled from an older one.
    Of several events on a day the one with the greatest values wins.
    """
    events = events.groupBy("symbol", F.col(event_date).alias("date")).agg(F.max(F.struct(*values)).alias("_event"))
    rows = quotes.select("symbol", "date", F.struct(*quotes.columns).alias("_quote"), F.lit(None).cast(dict(events.dtypes)["_event"]).alias("_event"))
    both = rows.unionByName(events.withColumn("_quote", F.lit(None).cast(dict(rows.dtypes)["_quote"])))
    turn = F.col("_quote").isNull() if strict else F.col("_quote").isNotNull()
    order = Window.partitionBy("symbol").orderBy("date", turn).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_event", ignorenulls=True).over(order)).filter("_quote IS NOT NULL").select("_quote.*", *(F.col("_last")[v].alias(v) for v in values))


def snapshot_as_of(quotes: DataFrame, snapshots: DataFrame, snapshot_date: str, values: list[str]) -> DataFrame:
    """Each quote with its symbol's row in the latest snapshot on or before the date; absent from it: NULL."""
    taken = snapshots.select(F.col(snapshot_date).alias("_taken")).distinct()
    dates = quotes.select("date").distinct()
    marks = dates.select("date", F.lit(None).cast("date").alias("_taken")).union(taken.select(F.col("_taken").alias("date"), "_taken"))
    # one row per date of the calendar: its latest snapshot
    order = Window.orderBy("date", F.col("_taken").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    latest = marks.withColumn("_latest", F.last("_taken", ignorenulls=True).over(order)).filter("_taken IS NULL").select("date", "_latest")
    rows = snapshots.select("symbol", F.col(snapshot_date).alias("_latest"), *values)
    return quotes.join(latest, "date", "left").join(rows, ["symbol", "_latest"], "left").drop("_latest")


def within_lifecycle(quotes: DataFrame, master: DataFrame, closed: bool = False) -> DataFrame:
    """Quotes of listed symbols: list_date <= date < delist_date (``closed``: <=); an open end is NULL."""
    end = F.col("date") <= F.col("delist_date") if closed else F.col("date") < F.col("delist_date")
    return quotes.join(master.select("symbol", "list_date", "delist_date"), "symbol").filter((F.col("list_date") <= F.col("date")) & (F.col("delist_date").isNull() | end))


def latest_known(quotes: DataFrame, facts: DataFrame, order: list[str], available: str, strict: bool = False, stale_months: int | None = None) -> DataFrame:
    """Bitemporal latest: of the facts available by each quote's date, the greatest by the columns ``order``.

    Quotes and facts are united, and the greatest fact so far is carried along
    each symbol's dates, so a symbol with very many facts costs a sort and not
    all pairs. ``stale_months`` drops facts whose first order column, a date,
    is earlier than that: the greatest one is then the last to go.
    """
    names = [c for c in facts.columns if c != "symbol"]
    fact = F.struct(*order, *(c for c in names if c not in order))
    known = facts.filter(F.col(available).isNotNull()).select("symbol", F.col(available).cast("date").alias("date"), fact.alias("_fact"))
    rows = quotes.select("symbol", "date", F.struct(*quotes.columns).alias("_quote"), F.lit(None).cast(dict(known.dtypes)["_fact"]).alias("_fact"))
    both = rows.unionByName(known.withColumn("_quote", F.lit(None).cast(dict(rows.dtypes)["_quote"])))
    turn = F.col("_quote").isNull() if strict else F.col("_quote").isNotNull()
    so_far = Window.partitionBy("symbol").orderBy("date", turn).rowsBetween(Window.unboundedPreceding, 0)
    best = both.withColumn("_best", F.max("_fact").over(so_far)).filter("_quote IS NOT NULL")
    if stale_months is not None:
        best = best.withColumn("_best", F.when(F.col("_best")[order[0]] >= F.add_months("date", -stale_months), F.col("_best")))
    return best.select("_quote.*", *(F.col("_best")[c].alias(c) for c in names))


@dataclass(frozen=True)
class Knowledge:
    """What is known of facts by a date: those available by then, of which the greatest by ``order`` counts."""

    available: str
    order: tuple[str, ...]
    strict: bool = False
    stale_months: int | None = None


def known_views(quotes: DataFrame, facts: DataFrame, views: dict[str, Knowledge]) -> DataFrame:
    """``latest_known`` of several kinds of knowledge at once, with one shuffle; the fact columns end in ``_<view>``.

    A fact enters a symbol's line of dates once for each view, before the
    quotes of its date or (strict) after them. ``stale_months`` is counted on
    the column "period", so that has to come first in the order.
    """
    names = [c for c in facts.columns if c != "symbol"]
    ordered = lambda k: F.struct(*k.order, *(c for c in names if c not in k.order))
    entered = []
    for view, k in views.items():
        own = F.struct(*(F.when(F.lit(v == view), ordered(o)).alias(v) for v, o in views.items()))
        entered.append(F.struct(F.col(k.available).cast("date").alias("date"), F.lit(2 if k.strict else 0).alias("turn"), own.alias("facts")))
    known = facts.select("symbol", F.explode(F.array(*entered)).alias("e")).select("symbol", "e.*").filter("date IS NOT NULL")
    rows = quotes.select("symbol", "date", F.lit(1).alias("turn"), F.struct(*quotes.columns).alias("_quote"))
    both = rows.unionByName(known, allowMissingColumns=True)
    so_far = Window.partitionBy("symbol").orderBy("date", "turn").rowsBetween(Window.unboundedPreceding, 0)
    best = both.select("_quote", "date", *(F.max(F.col("facts")[v]).over(so_far).alias(f"_{v}") for v in views)).filter("_quote IS NOT NULL")
    out = []
    for view, k in views.items():
        fact = F.col(f"_{view}")
        if k.stale_months is not None:
            fact = F.when(fact[k.order[0]] >= F.add_months("date", -k.stale_months), fact)
        out += [fact[c].alias(f"{c}_{view}") for c in names]
    return best.select("_quote.*", *out)


def at_session_offset(panel: DataFrame, value: str, offset: int, name: str) -> DataFrame:
    """``value`` of the same symbol exactly ``offset`` sessions of the calendar later, NULL if it has none then."""
    ahead = panel.select("symbol", (F.col("session") - offset).alias("session"), F.col(value).alias(name))
    return panel.join(ahead, ["symbol", "session"], "left")


def sessions(panel: DataFrame) -> DataFrame:
    """(date, session): the calendar, numbered from 0; one row per date."""
    return panel.select("date").distinct().withColumn("session", F.row_number().over(Window.orderBy("date")) - 1)


def event_window(quotes: DataFrame, events: DataFrame, days: int, aggregates: dict[str, Column], strict: bool = True) -> DataFrame:
    """Aggregates of a symbol's events in [date - days, date) of each quote (not ``strict``: up to the date itself).

    Quotes and events are united and aggregated over a range frame of days;
    ``aggregates`` refer to the events' columns, which are NULL on quotes.
    """
    extra = [c for c in events.columns if c not in ("symbol", "date")]
    rows = quotes.select("symbol", "date", F.struct(*quotes.columns).alias("_quote"), *(F.lit(None).cast(dict(events.dtypes)[c]).alias(c) for c in extra))
    both = rows.unionByName(events.withColumn("_quote", F.lit(None).cast(dict(rows.dtypes)["_quote"])))
    both = both.withColumn("_day", F.datediff("date", F.lit("1970-01-01")))
    frame = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-days, -1 if strict else 0)
    return both.withColumns({k: v.over(frame) for k, v in aggregates.items()}).filter("_quote IS NOT NULL").select("_quote.*", *aggregates)
