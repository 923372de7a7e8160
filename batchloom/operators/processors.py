"""Item processors as column expressions with a kept, filtered or failed outcome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.session import table

Stage = tuple[str, Callable[[], Column]]


def keep(predicate: Column) -> Column:
    """A filter is two-valued: what is neither true nor false is filtered."""
    return F.coalesce(predicate, F.lit(False))


def filter_items(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and one row of ``read, kept, filtered`` counters."""
    counts = df.agg(F.count("*").alias("read"), F.count_if(keep(predicate)).alias("kept"), F.count_if(~keep(predicate)).alias("filtered"))
    return df.filter(keep(predicate)), counts


def validate_items(df: DataFrame, rule: Column, fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid rows and violations. With ``fail`` the first violation fails the job instead."""
    if fail:
        checked = df.withColumn("_ok", F.when(keep(rule), True).otherwise(F.raise_error(F.lit("item violates its rule")).cast("boolean")))
        return checked.filter("_ok").drop("_ok"), df.limit(0)
    return df.filter(keep(rule)), df.filter(~keep(rule))


def chain(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stages in order; what one filters, the next never sees."""
    for stage in stages:
        df = stage(df)
    return df


def classify(key: Column, routes: dict, otherwise: str = "no processor for this class") -> Column:
    """The expression of the item's class; an unknown class fails."""
    out = None
    for name, value in routes.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"{otherwise}: "), F.coalesce(key, F.lit("null")))).cast("long"))


def proc_map(spark, sf):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", net.alias("net_cents"))


def proc_identity(spark, sf):
    return table(spark, sf, "region")


def proc_filter(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    kept, counts = filter_items(orders, F.col("o_orderstatus") != "P")
    return kept.select("o_orderkey").crossJoin(F.broadcast(counts))


def proc_validate(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "n_chars")
    valid, bad = validate_items(documents, F.col("n_chars") <= 20000)
    return valid.select("doc_id", F.lit("valid").alias("outcome")).unionByName(bad.select("doc_id", F.lit("violation").alias("outcome")))


def proc_chain(spark, sf):
    cents = lambda df: df.withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    paid = lambda df: df.filter(keep(F.col("cents") > 1000))
    fee = lambda df: df.withColumn("out", F.col("cents") + 7)
    return chain(table(spark, sf, "events"), cents, paid, fee).select("event_id", "out")


def proc_classify(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long")
    out = classify(F.col("event_type"), {"click": cents, "view": cents * 2, "purchase": cents * 3, "signup": F.lit(1).cast("long"), "error": -cents})
    return table(spark, sf, "events").select("event_id", out.alias("out"))


QUERIES = {f.__name__: f for f in (proc_map, proc_identity, proc_filter, proc_validate, proc_chain, proc_classify)}

ORACLES = {
    "proc_map": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS net_cents FROM lineitem",
    "proc_identity": "SELECT r_regionkey, r_name FROM region",
    "proc_filter": """SELECT o_orderkey, c.read, c.kept, c.filtered FROM orders,
        (SELECT count(*) AS read, count(*) FILTER (o_orderstatus <> 'P') AS kept, count(*) FILTER (o_orderstatus = 'P') AS filtered FROM orders) c
        WHERE o_orderstatus <> 'P'""",
    "proc_validate": "SELECT doc_id, CASE WHEN n_chars <= 20000 THEN 'valid' ELSE 'violation' END AS outcome FROM documents",
    "proc_chain": "SELECT event_id, CAST(round(value * 100) AS BIGINT) + 7 AS out FROM events WHERE CAST(round(value * 100) AS BIGINT) > 1000",
    "proc_classify": """SELECT event_id, CASE event_type WHEN 'click' THEN c WHEN 'view' THEN c * 2 WHEN 'purchase' THEN c * 3 WHEN 'signup' THEN 1 ELSE -c END AS out
        FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)""",
}
