"""Dealing rows out to as many tasks as there are rows for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: About so many rows meet in a task.
TASK_ROWS = 100_000


def tasks(rows: int, per_task: int = TASK_ROWS) -> int:
    return max(1, -(-rows // per_task))


def dealt(df: DataFrame, rows: int | None, *keys: str, per_task: int = TASK_ROWS) -> DataFrame:
    """``df`` by hash of ``keys`` in a task for every ``per_task`` of about ``rows`` rows; as it is if ``rows`` is None.

    Windows and groups by these keys (and more) take this exchange instead of
    one of their own, whose number of tasks is fixed or merged by compressed
    bytes, so that the memory of a task would grow with the input.
    """
    return df if rows is None else df.repartition(tasks(rows, per_task), *keys)
