"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from busline.session import landed, scratch_dir

__all__ = ["arrow_map", "discard", "landed", "open_fs", "read_table", "scratch_dir", "slices"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, rows: int = 1024, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice has at most ``rows`` rows and about ``size`` bytes of ``column`` (one row at least)."""
    lengths = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    ends = lengths.buffers()[1]
    import numpy as np

    offsets = np.frombuffer(ends, dtype=np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
    at = 0
    while at < len(lengths):
        upto = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        upto = max(at + 1, min(upto, at + rows, len(lengths)))
        yield batch.slice(at, upto - at)
        at = upto


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", rows: int = 1024, after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over bounded slices, so that a batch of very long texts is not turned into Python objects at once.

    ``after`` runs when a task ends, to free what its worker, which serves other tasks too, need not keep.
    """

    def run(batches):
        try:
            for batch in batches:
                for part in slices(batch, column, rows):
                    yield fn(part)
        finally:
            if after is not None:
                after()

    return df.mapInArrow(run, schema)


def discard(*tables: DataFrame) -> None:
    """Delete stage tables of ``landed`` that nothing reads any more: all that was made from them is itself written."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            fs, path = open_fs(folder)
            fs.delete_dir(path)


def open_fs(uri: str):
    """File system and path of a folder that all executors share (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)
