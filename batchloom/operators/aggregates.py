"""Groups of consecutive items, and one item of lookahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators.ordering import number_rows
from batchloom.session import table


def bounded_groups(df: DataFrame, order: list[str], bound: int, **aggregates: Column) -> DataFrame:
    """One row per ``bound`` consecutive items, the last group partial; no items, no groups."""
    placed = number_rows(df, order).withColumn("gid", F.expr(f"pos div {bound}"))
    return placed.groupBy("gid").agg(*[c.alias(n) for n, c in aggregates.items()])


def peek(df: DataFrame, partition: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """``df`` with the next item's ``column``, null at the end."""
    return df.withColumn(name, F.lead(column).over(Window.partitionBy(*partition).orderBy(*order)))


def agg_bounded_group(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return bounded_groups(events, ["event_id"], 7, n=F.count("*"), first_id=F.min("event_id"), last_id=F.max("event_id"), sum_cents=F.sum("cents"))


def agg_peek_lead(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return peek(turns, ["conv_id"], ["turn"], "role", "next_role")


QUERIES = {f.__name__: f for f in (agg_bounded_group, agg_peek_lead)}

ORACLES = {
    "agg_bounded_group": """SELECT gid, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, CAST(sum(cents) AS BIGINT) AS sum_cents
        FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents, (row_number() OVER (ORDER BY event_id) - 1) // 7 AS gid FROM events) GROUP BY gid""",
    "agg_peek_lead": "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations",
}
