"""Helpers shared by the training-data operators: scratch tables, Arrow maps, words.

Words are maximal runs of characters other than the six ASCII white-space
characters (space, tab, line feed, vertical tab, form feed, carriage return).
``bytes.split()`` and ``bytes.strip()`` use exactly that set, and
``bytes.lower()`` changes only A-Z, so texts are handled as UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"
#: A Python function sees at most this much of an Arrow batch at once (or one row), so that long texts fit in a worker.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1000
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder of its own; a
    cluster raises, since its machines share no temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_DIR[app]


def new_tag(name: str) -> str:
    """A tag for one call's scratch tables: two runs never share one."""
    return f"{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{tag}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, tag: str) -> None:
    """Delete the scratch tables written under ``tag``; their DataFrames can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{tag}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most so many rows and, unless it's a single row, about so many bytes."""
    pieces = max(1, -(-batch.get_total_buffer_size() // most_bytes), -(-batch.num_rows // most_rows))
    step, at = max(1, batch.num_rows // pieces), 0
    while at < batch.num_rows:
        piece = batch.slice(at, step)
        if piece.num_rows > 1 and piece.nbytes > 2 * most_bytes:
            yield from slices(piece.take(pa.array(range(piece.num_rows))), most_bytes, most_rows)
        else:
            yield piece
        at += step


def hand_back() -> None:
    """Give a Python worker's unused memory back to the machine: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    for value in column:
        yield b"" if not value.is_valid else value.as_buffer().to_pybytes()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one slice of a batch."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                out = fn(piece)
                if out is not None:
                    yield out
        hand_back()

    return df.mapInArrow(run, schema)


def free_name(base: str, columns: list[str]) -> str:
    """``base`` with as many underscores before it as it takes to differ from all ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def bounded(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that many plus one."""
    return df.limit(rows + 1).count() <= rows
