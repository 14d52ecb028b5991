"""As-of joins of a stream: each quote with the latest fact of its symbol that is known for its time, late rows included.

A quote is answered when the watermark has passed its time, so that facts that
come late, but not later than the watermark allows, still count. Until then it
waits in its symbol's state. Of the facts only the last one before the
watermark and all after it can still be asked for; the others go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "symbol string, ts timestamp, id long, fact_ts timestamp, value double"
_STATE = "fact_ts array<long>, fact_value array<double>, quote_ts array<long>, quote_id array<long>"


def stream_as_of(quotes: DataFrame, facts: DataFrame, late: str = "10 days", strict: bool = False) -> DataFrame:
    """(symbol, ts, id, fact_ts, value) of every quote, once the watermark is past it; no fact gives NULLs.

    ``quotes`` is a stream of (symbol, ts, id), ``facts`` one of (symbol, ts,
    value). Of facts of one time the greatest value counts, as in the batch
    join. Rows older than the watermark are dropped, and so are null symbols
    and times. Batch by batch the answers are those that ``joins.as_of`` gives
    over all rows that weren't dropped.
    """
    asked = quotes.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("asked"))
    known = facts.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("id"), F.col("value").cast("double").alias("value"), F.lit(False).alias("asked"))
    rows = asked.unionByName(known).filter("symbol IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)

    def answer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [])
        facts = list(zip(held[0], held[1]))
        waiting = list(zip(held[2], held[3]))
        for frame in frames:
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            for asked, ts, id_, value in zip(frame["asked"], at, frame["id"], frame["value"]):
                if asked:
                    waiting.append((int(ts), None if pd.isna(id_) else int(id_)))
                else:
                    facts.append((int(ts), None if pd.isna(value) else float(value)))
        mark = state.getCurrentWatermarkMs() * 1000
        facts.sort(key=lambda f: (f[0], f[1] is not None, f[1] or 0.0))
        done = sorted((q for q in waiting if q[0] < mark), key=lambda q: q[0])
        waiting = [q for q in waiting if q[0] >= mark]
        out, k = [], 0
        for ts, id_ in done:
            while k < len(facts) and (facts[k][0] < ts if strict else facts[k][0] <= ts):
                k += 1
            out.append((key[0], ts, id_, *(facts[k - 1] if k else (None, None))))
        # the last fact before the watermark answers what comes right after it
        old = [f for f in facts if f[0] < mark]
        facts = old[-1:] + facts[len(old) :]
        if facts or waiting:
            state.update(tuple(list(x) for x in ([f[0] for f in facts], [f[1] for f in facts], [q[0] for q in waiting], [q[1] for q in waiting])))
            if waiting:
                state.setTimeoutTimestamp(max(min(q[0] for q in waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["symbol", "ts", "id", "fact_ts", "value"])
            for c in ("ts", "fact_ts"):
                frame[c] = pd.to_datetime(frame[c], unit="us")
            frame["id"] = frame["id"].astype("Int64")
            yield frame

    return rows.groupBy("symbol").applyInPandasWithState(answer, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
