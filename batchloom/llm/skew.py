"""Joins of rows with one fact per key where a key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than 1/HOT_KEYS of all counted rows; there are fewer than HOT_KEYS of them.
HOT_KEYS = 1000


def row_numbers(df: DataFrame, name: str) -> DataFrame:
    """A number for each row of a stored table, the same whenever it is read."""
    return df.withColumn(name, F.monotonically_increasing_id())


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with the one row of stored ``facts`` that has their (non-null) keys.

    ``facts[count]`` is how many rows have the key. Keys with more than a
    thousandth of the counted rows number under a thousand whatever the data,
    so their facts are broadcast; the rows that found theirs so are dealt by
    ``spread`` instead of their key in the join that serves the others. That
    is a merge join at every size, so what it moves grows with the rows.
    """
    total = facts.agg(F.sum(count).alias("n")).first()["n"] or 0
    line = max(total // HOT_KEYS, 64)
    values = [c for c in facts.columns if c not in keys]
    hot = facts.filter(F.col(count) > line).select(*keys, F.struct(*values).alias("_hot"))
    cold = facts.filter(F.col(count) <= line).select(
        *[F.col(k).alias(f"_cold_{k}") for k in keys], F.lit(0).cast("long").alias("_cold_spread"), F.struct(*values).alias("_cold"))
    found = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_spread", F.when(F.col("_hot").isNotNull(), F.abs(F.xxhash64(spread) % F.lit(2**40)) + 1).otherwise(F.lit(0).cast("long")))
    on = (F.col("_spread") == F.col("_cold_spread"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_cold_{k}"))
    joined = found.join(cold.hint("merge"), on, "left").withColumn("_fact", F.coalesce("_hot", "_cold"))
    if how == "inner":
        joined = joined.filter(F.col("_fact").isNotNull())
    return joined.select(*rows.columns, *[F.col(f"_fact.{v}").alias(v) for v in values])


def attach_large(rows: DataFrame, facts: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` joined (inner) with one row of ``facts`` per key, which may be too large to broadcast.

    Facts of keys that hold over a thousandth of the rows are copied, once for
    each thousandth that they serve; only those keys, under a thousand, and
    their numbers of copies are broadcast. ``rows`` should be stored.
    """
    line = max(rows.count() // HOT_KEYS, 64)
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > line).select(key, F.ceil(F.col("_n") / F.lit(line)).cast("int").alias("_copies"))
    copies = F.coalesce("_copies", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_copy", F.pmod(F.xxhash64(spread), copies).cast("int"))
    copied = facts.join(F.broadcast(hot), key, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.drop("_copies").join(copied.drop("_copies").hint("merge"), [key, "_copy"]).drop("_copy")
