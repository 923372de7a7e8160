"""Chunk boundaries and counters of a step, as set-oriented queries.

A chunk is full after ``size`` successful reads. Read errors that are skipped
take no place: each belongs to the chunk that the next successful read goes to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.operators.ordering import number_rows, running_totals
from batchloom.session import table

SIZE = 100


def assign_chunks(df: DataFrame, order: list[str], size: int = SIZE) -> DataFrame:
    """``df`` with ``chunk_id`` from 0."""
    return number_rows(df, order).withColumn("chunk_id", F.expr(f"pos div {size}")).drop("pos")


def fill_chunks(df: DataFrame, order: list[str], bad: Column, size: int = SIZE) -> DataFrame:
    """``df`` with ``chunk_id`` and ``bad``, where bad rows are skipped reads."""
    marked = df.withColumn("bad", F.coalesce(bad, F.lit(False)))
    counted = running_totals(marked, order, {"_good": (~F.col("bad")).cast("int")})
    return counted.withColumn("chunk_id", F.expr(f"(_good - if(bad, 0, 1)) div {size}")).drop("_good")


def chunk_counters(filled: DataFrame, kept: Column, key: str) -> DataFrame:
    """Counters per chunk of :func:`fill_chunks` rows, chunks of skips only and empty ones included."""
    good = ~F.col("bad")
    return filled.groupBy("chunk_id").agg(
        F.count_if(good).alias("read"), F.count_if(good & kept).alias("written"), F.count_if(good & ~kept).alias("filtered"),
        F.min(F.when(good, F.col(key))).alias("first_key"), F.max(F.when(good, F.col(key))).alias("last_key"), F.count_if("bad").alias("read_skips"))


def commits(df: DataFrame, order: str, bad: Column, size: int = SIZE) -> DataFrame:
    """``valid, skips, commit_count``: a last chunk of skips alone commits, an empty one does not."""
    bad = F.coalesce(bad, F.lit(False))
    found = df.agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("skips"), F.max(F.when(~bad, F.col(order))).alias("last"), F.max(F.when(bad, F.col(order))).alias("last_bad"))
    tail = (F.col("valid") % size == 0) & (F.col("last_bad").isNotNull()) & (F.col("last").isNull() | (F.col("last_bad") > F.col("last")))
    return found.select("valid", "skips", (F.ceil(F.col("valid") / size) + tail.cast("int")).cast("long").alias("commit_count"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _filled(spark, sf):
    return fill_chunks(_orders(spark, sf), ["o_orderkey"], F.col("o_orderpriority") == "4-NOT SPECIFIED")


def chunk_assign(spark, sf):
    return assign_chunks(_orders(spark, sf).select("o_orderkey"), ["o_orderkey"])


def chunk_counts(spark, sf):
    return chunk_counters(_filled(spark, sf), F.col("o_orderstatus") != "P", "o_orderkey")


def chunk_running_totals(spark, sf):
    sums = {f"total_{c}": F.col(c) for c in ("read", "written", "filtered", "read_skips")}
    return running_totals(chunk_counts(spark, sf), ["chunk_id"], sums).select("chunk_id", *sums)


def chunk_fill_with_skips(spark, sf):
    return _filled(spark, sf).select("o_orderkey", "chunk_id", F.when(F.col("bad"), "skipped").otherwise("read").alias("outcome"))


def chunk_commit_count(spark, sf):
    return commits(_orders(spark, sf), "o_orderkey", F.col("o_orderpriority") == "4-NOT SPECIFIED")


def chunk_all_filtered(spark, sf):
    """A chunk whose items are all filtered still commits: here late orders are all filtered."""
    counted = chunk_counters(_filled(spark, sf), F.col("o_orderkey") % 40000 < 9000, "o_orderkey")
    return counted.select("chunk_id", "read", "written", "filtered")


QUERIES = {f.__name__: f for f in (chunk_assign, chunk_counts, chunk_running_totals, chunk_fill_with_skips, chunk_commit_count, chunk_all_filtered)}

_FILLED = f"""(SELECT o_orderkey, o_orderstatus, bad, (good - CASE WHEN bad THEN 0 ELSE 1 END) // {SIZE} AS chunk_id FROM (
    SELECT *, o_orderpriority = '4-NOT SPECIFIED' AS bad, CAST(sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0 ELSE 1 END) OVER (ORDER BY o_orderkey) AS BIGINT) AS good FROM orders))"""
_COUNTS = f"""SELECT chunk_id, count(*) FILTER (NOT bad) AS read, count(*) FILTER (NOT bad AND o_orderstatus <> 'P') AS written, count(*) FILTER (NOT bad AND o_orderstatus = 'P') AS filtered,
    min(o_orderkey) FILTER (NOT bad) AS first_key, max(o_orderkey) FILTER (NOT bad) AS last_key, count(*) FILTER (bad) AS read_skips FROM {_FILLED} GROUP BY chunk_id"""

ORACLES = {
    "chunk_assign": f"SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // {SIZE} AS chunk_id FROM orders",
    "chunk_counts": _COUNTS,
    "chunk_running_totals": "SELECT chunk_id, " + ", ".join(f"CAST(sum({c}) OVER (ORDER BY chunk_id) AS BIGINT) AS total_{c}" for c in ("read", "written", "filtered", "read_skips")) + f" FROM ({_COUNTS})",
    "chunk_fill_with_skips": f"SELECT o_orderkey, chunk_id, CASE WHEN bad THEN 'skipped' ELSE 'read' END AS outcome FROM {_FILLED}",
    "chunk_commit_count": f"""SELECT valid, skips, CAST((valid + {SIZE - 1}) // {SIZE} + CASE WHEN valid % {SIZE} = 0 AND last_bad IS NOT NULL AND (last IS NULL OR last_bad > last) THEN 1 ELSE 0 END AS BIGINT) AS commit_count
        FROM (SELECT count(*) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS valid, count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS skips,
        max(o_orderkey) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS last, max(o_orderkey) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS last_bad FROM orders)""",
    "chunk_all_filtered": f"""SELECT chunk_id, count(*) FILTER (NOT bad) AS read, count(*) FILTER (NOT bad AND o_orderkey % 40000 < 9000) AS written,
        count(*) FILTER (NOT bad AND o_orderkey % 40000 >= 9000) AS filtered FROM {_FILLED} GROUP BY chunk_id""",
}
