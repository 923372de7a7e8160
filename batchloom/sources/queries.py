"""Source and sink queries: tables rendered to files, read back, and held against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.operators.chunking import assign_chunks
from batchloom.session import folder, table
from batchloom.sources import sinks
from batchloom.sources.flat import Dialect, Field, Layout, composite, delimited, delimited_flexible, fixed_width, items, resumed_range


def _text(spark, lines: DataFrame) -> str:
    path = folder(spark)
    lines.write.text(path)
    return path


def src_iter(spark, sf):
    return items(spark, ["alpha", "beta", "gamma", "delta"])


def _nation(spark, sf, dialect: Dialect):
    path = folder(spark)
    table(spark, sf, "nation").select(*[F.col(c).cast("string") for c in ("n_nationkey", "n_name", "n_regionkey")]).write.options(**dialect.options()).csv(path)
    good, _ = delimited(spark, path, ["n_nationkey", "n_name", "n_regionkey"], dialect)
    return good.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


def src_delimited(spark, sf):
    return _nation(spark, sf, Dialect())


def src_dialect(spark, sf):
    return _nation(spark, sf, Dialect(delimiter="|"))


def src_header(spark, sf):
    return _nation(spark, sf, Dialect(header=True))


def _part_lines(spark, sf):
    part = table(spark, sf, "part")
    whole = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit('"')), F.col("p_size").cast("string"))
    return _text(spark, part.select(F.when(F.col("p_partkey") % 97 == 0, F.col("p_partkey").cast("string")).otherwise(whole)))


def src_malformed(spark, sf):
    good, _ = delimited(spark, _part_lines(spark, sf), ["p_partkey", "p_name", "p_size"])
    return good.select(F.col("p_partkey").cast("long"))


def src_flexible(spark, sf):
    found = delimited_flexible(spark, _part_lines(spark, sf))
    return found.select(F.col("fields")[0].cast("long").alias("line_no"), F.size("fields").cast("long").alias("n_fields"))


def src_fixed_width(spark, sf):
    lines = table(spark, sf, "nation").select(F.concat(F.rpad(F.col("n_nationkey").cast("string"), 4, " "), F.rpad("n_name", 20, " "), F.rpad(F.col("n_regionkey").cast("string"), 3, " ")))
    good, _ = fixed_width(spark, _text(spark, lines), Layout((Field(4, "n_nationkey"), Field(20, "n_name"), Field(3, "n_regionkey"))))
    return good.select(F.rtrim("n_nationkey").cast("int").alias("n_nationkey"), F.rtrim("n_name").alias("n_name"), F.rtrim("n_regionkey").cast("int").alias("n_regionkey"))


def _region(spark, sf, end: str):
    lines = table(spark, sf, "region").select(F.concat(F.rpad(F.col("r_regionkey").cast("string"), 3, " "), F.rpad("r_name", 12, " "), F.lit(end)))
    good, _ = fixed_width(spark, _text(spark, lines), Layout((Field(3), Field(12, "r_name"))))
    return good.select(F.rtrim("f0").cast("int").alias("r_regionkey"), F.rtrim("r_name").alias("r_name"))


def src_fixed_layout(spark, sf):
    return _region(spark, sf, "")


def src_fixed_crlf(spark, sf):
    return _region(spark, sf, "\r")


def src_composite(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"))
    region = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("name"))
    return composite(nation, region)


def src_range_restart(spark, sf):
    return resumed_range(spark, 1, 1001, 400)


def sink_delimited_bytes(spark, sf):
    orders = assign_chunks(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 1000)
    path = folder(spark)
    sinks.write_chunks(orders, path, "job", lambda w, p: w.options(**Dialect().options()).csv(p))
    good, _ = delimited(spark, sinks.committed_paths(spark, path, "job"), ["o_orderkey", "o_custkey", "o_orderstatus"])
    return good.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus")


def sink_fixed_width(spark, sf):
    layout = Layout((Field(4), Field(20)))
    lines = sinks.fixed_lines(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.rpad(F.col("n_nationkey").cast("string"), 4, " ").alias("a"), F.rpad("n_name", 20, " ").alias("b")), ["a", "b"], layout)
    return lines.select("pos", "line")


def sink_fan_out(spark, sf):
    supplier = table(spark, sf, "supplier")
    paths = [folder(spark), folder(spark)]
    sinks.fan_out(supplier, [lambda df, p=p: df.write.parquet(p) for p in paths])
    counted = [spark.read.schema(supplier.schema).parquet(p).agg(F.lit(f"sink{k}").alias("sink"), F.count("*").alias("count"), F.sum("s_suppkey").alias("sum_key")) for k, p in enumerate(paths)]
    return counted[0].unionByName(counted[1])


def sink_classify(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    path = folder(spark)
    sinks.classified(events, "event_type", ["click", "error", "purchase", "signup", "view"], path)
    back = spark.read.schema("event_id long, event_type string").parquet(path)
    return back.groupBy("event_type").agg(F.count("*").alias("count"), F.min("event_id").alias("min_id"), F.max("event_id").alias("max_id"))


def sink_enlisted_counts(spark, sf):
    chunks = assign_chunks(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"]).groupBy("chunk_id").agg(F.count("*").alias("rows"))
    return sinks.ledger_rows(chunks)


QUERIES = {f.__name__: f for f in (src_iter, src_delimited, src_dialect, src_header, src_malformed, src_flexible, src_fixed_width, src_fixed_layout, src_fixed_crlf, src_composite, src_range_restart,
                                   sink_delimited_bytes, sink_fixed_width, sink_fan_out, sink_classify, sink_enlisted_counts)}

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_REGION = "SELECT r_regionkey, r_name FROM region"
ORACLES = {
    "src_iter": "SELECT CAST(pos AS BIGINT) AS pos, value FROM (VALUES (0, 'alpha'), (1, 'beta'), (2, 'gamma'), (3, 'delta')) t(pos, value)",
    "src_delimited": _NATION, "src_dialect": _NATION, "src_header": _NATION, "src_fixed_width": _NATION,
    "src_fixed_layout": _REGION, "src_fixed_crlf": _REGION,
    "src_malformed": "SELECT p_partkey FROM part WHERE p_partkey % 97 <> 0",
    "src_flexible": "SELECT p_partkey AS line_no, CAST(CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 3 END AS BIGINT) AS n_fields FROM part",
    "src_composite": "SELECT CAST(0 AS BIGINT) AS source_ordinal, CAST(n_nationkey AS BIGINT) AS pos, n_name AS name FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region",
    "src_range_restart": "SELECT n FROM range(401, 1001) t(n)",
    "sink_delimited_bytes": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "sink_fixed_width": "SELECT CAST(n_nationkey AS BIGINT) AS pos, rpad(CAST(n_nationkey AS VARCHAR), 4, ' ') || rpad(n_name, 20, ' ') AS line FROM nation",
    "sink_fan_out": "SELECT sink, count(*) AS count, CAST(sum(s_suppkey) AS BIGINT) AS sum_key FROM supplier, (VALUES ('sink0'), ('sink1')) s(sink) GROUP BY sink",
    "sink_classify": "SELECT event_type, count(*) AS count, min(event_id) AS min_id, max(event_id) AS max_id FROM events GROUP BY event_type",
    "sink_enlisted_counts": """SELECT chunk_id, rows, CAST(sum(rows) OVER (ORDER BY chunk_id) AS BIGINT) AS cumulative_rows FROM (
    SELECT chunk_id, count(*) AS rows FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS chunk_id FROM orders) GROUP BY chunk_id)""",
}
