"""Written intermediates and Arrow batches that the operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barline.session import work_dir

#: Most rows, and about the most bytes, of one slice of an Arrow batch; bounds what a task holds beside its input.
SLICE, SLICE_BYTES = 2000, 8 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (``spark.checkpoint.dir``; a local one in tests only)."""
    base = work_dir(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(base, "barline-llm", f"{name}-{uuid.uuid4().hex}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends, lost executors lose nothing."""
    return _saved(df, shared_path(df.sparkSession, name))


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``saved`` whose folders go at the end of the block: what is read from them must be written by then."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(shared_path(spark, name))
        return _saved(df, paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """What a Python worker has freed goes back to the system: workers live on from stage to stage beside their executor."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
