"""Exact duplicates by distributed most-significant-byte-first radix partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.scratch import Scratch
from batchloom.llm.skew import attach, row_numbers

#: Bytes of text that the first level reads, and how much wider each next level is.
FIRST_BYTES = 64
WIDEN = 4


def normalised(text: Column) -> Column:
    """Text without the white space of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[ \\t-\\r]+", "")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its group of equal normalised texts.

    Each level reads the next bytes of the texts that are still in one group
    with another text. A group of one row is finished. A group whose bytes
    ended before the level's width is finished too: its texts are equal, which
    no digest has to tell. All others go to the next, wider level. Only slices
    and counts are shuffled to find the groups, combined before the shuffle,
    and groups are handed back to their rows by a join that spreads keys with
    many rows, so a group may hold any share of the table.

    ``docs`` must be a stored table (its rows are numbered as they are read).

    Columns: ``row`` (number in the table), ``doc_id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``. The row of a group with the most
    code points in its original text stays; then the smallest doc_id, a null
    doc_id last; of rows that are alike in both, the first in the table.
    Null text counts as empty, and empty texts are equal to each other. Other
    columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "radix")
    level = row_numbers(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "row").select(
        "row", "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"), F.encode(normalised(F.col("text")), "utf-8").alias("rest"), F.lit(0).cast("long").alias("grp"))
    level = level.withColumn("sha", F.sha2("rest", 256))
    single = lambda df: df.select("row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    results, ended, width = [], [], FIRST_BYTES
    while True:
        cut = level.withColumn("slice", F.substring("rest", 1, width))
        found = cut.groupBy("grp", "slice").agg(F.count("*").alias("size")).filter("size > 1")
        groups = scratch.keep(found.select("grp", "slice", "size", F.monotonically_increasing_id().alias("next")), "groups")
        joined = attach(cut, groups, ["grp", "slice"], "size", F.col("row"), "left")
        done = F.octet_length("slice") < width
        state = F.when(F.col("size").isNull(), "alone").when(done, "ended").otherwise("open")
        rest = F.when(state == "open", F.expr(f"substring(rest, {width + 1}, octet_length(rest))"))
        level = scratch.keep(joined.select("row", "doc_id", "n", "sha", F.col("next").alias("grp"), "size", state.alias("state"), rest.alias("rest")), "level")
        results.append(single(level.filter("state = 'alone'")))
        ended.append(level.filter("state = 'ended'").select("row", "doc_id", "n", "sha", F.struct(F.lit(width).alias("level"), "grp").alias("grp")))
        level = level.filter("state = 'open'").drop("state", "size")
        if level.isEmpty():
            break
        width *= WIDEN
    rows = ended[0]
    for more in ended[1:]:
        rows = rows.unionByName(more)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    facts = scratch.keep(rows.groupBy("grp").agg(F.count("*").alias("group_size"), best), "kept")
    out = attach(rows, facts, ["grp"], "group_size", F.col("row")).select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"))
    for more in results:
        out = out.unionByName(more)
    return out


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of stored ``docs`` that :func:`exact_groups` keeps, all columns.

    Null texts are equal to empty ones and to such as have only white space,
    so one of them stays; of repeated rows one stays; an empty table stays
    empty.
    """
    kept = exact_groups(docs, text, doc_id).filter("kept").select(F.col("row").alias("_row"))
    return row_numbers(docs, "_row").join(kept, "_row", "left_semi").drop("_row")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).drop("row")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, row_number() OVER (ORDER BY doc_id) AS r,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id, r) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id, r) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""
