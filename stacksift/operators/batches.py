"""Arrow batches of long texts, worked on in small runs, so that a Python worker's memory does not follow its input."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Sets Arrow batches of at most so many rows, so that batches of long texts stay small on both sides.

    A setting of the job: queries and pipeline stages call this, operators leave the session as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which its Python worker, which Spark keeps for other tasks, gives free memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 19, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Runs of at most `rows` rows with about `most` bytes of text, so that a batch of long texts needs no more memory."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (total + n > most or i - start == rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
