"""Arrow batches in small pieces, so that a worker's memory does not follow the batch size."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text in a piece, but for single texts that are longer.
PIECE = 4_000_000


def pieces_of(batches, column: str, most: int = PIECE):
    """Each batch as slices of consecutive rows that hold about ``most`` bytes of a text column; empty batches give none."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        lo = 0
        while lo < len(sizes):
            hi, size = lo + 1, sizes[lo]
            while hi < len(sizes) and size + sizes[hi] <= most:
                size += sizes[hi]
                hi += 1
            yield batch.slice(lo, hi - lo)
            lo = hi


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Queries that are run within this block hand workers at most so many rows at once; the session's own number comes back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
