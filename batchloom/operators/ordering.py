"""Positions and running totals over a whole table without one sorting task.

A window without partitions sorts everything in one task. Here the table is
range-partitioned by its order, each partition is numbered or summed on its
own, and one number per partition, the sum of those before it, is added.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

_PART = "_part"


_KEPT: ContextVar[list | None] = ContextVar("kept", default=None)


@contextmanager
def released():
    """Ranges that are kept within this block, by the functions below, are given up at its end."""
    outer = _KEPT.set([])
    try:
        yield
    finally:
        for df in _KEPT.get():
            df.unpersist()
        _KEPT.reset(outer)


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Sorted ranges; kept, so that every read sees the same borders, until :func:`released`."""
    kept = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_PART, F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    if _KEPT.get() is not None:
        _KEPT.get().append(kept)
    return kept


def _offsets(sums: DataFrame, names: list[str]) -> DataFrame:
    """For each partition the sums over all before it; there are as many rows as partitions."""
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(_PART, *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(f"_before_{n}") for n in names])


def number_rows(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with the 0-based place of each row by ``order``, which must be unique."""
    ranged = _ranged(df, order)
    offsets = _offsets(ranged.groupBy(_PART).agg(F.count("*").alias("n")), ["n"])
    # The low 33 bits number the rows of a partition, which are sorted.
    local = ranged.withColumn(name, F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)))
    return local.join(F.broadcast(offsets), _PART).withColumn(name, F.col(name) + F.col("_before_n")).drop(_PART, "_before_n")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums of integer columns by ``order``, which must be unique."""
    valued = df
    for name, value in totals.items():
        valued = valued.withColumn(name, F.coalesce(value.cast("long"), F.lit(0)))
    ranged = _ranged(valued, order)
    offsets = _offsets(ranged.groupBy(_PART).agg(*[F.sum(n).alias(n) for n in totals]), list(totals))
    upto = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({n: F.sum(n).over(upto) for n in totals}).join(F.broadcast(offsets), _PART)
    return out.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in totals}).drop(_PART, *[f"_before_{n}" for n in totals])
