"""Sinks that commit chunk by chunk, fan out, or route by class."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from batchloom.operators.ordering import running_totals
from batchloom.sources.flat import Layout


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _exists(spark: SparkSession, path: str) -> bool:
    fs, jvm = _fs(spark, path)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path))


def write_chunks(df: DataFrame, path: str, attempt: str, write: Callable, per_folder: int = 1000) -> None:
    """Data with ``chunk_id`` into one folder per ``per_folder`` chunks, then the manifest that commits them.

    One distributed write puts every chunk under ``data-<attempt>``; the
    manifest names the chunks, their folders, rows and bytes, and is put in
    place last, if as many rows were written as it counts. What is there
    without its manifest was never committed, and the next attempt of the name
    removes it; a committed folder that is gone or changed fails the restart.
    """
    spark = df.sparkSession
    fs, jvm = _fs(spark, path)
    data, manifest = f"{path}/data-{attempt}", f"{path}/manifest-{attempt}"
    if _exists(spark, f"{manifest}/_SUCCESS"):
        verify(spark, path, attempt)
        return
    pending = f"{manifest}-pending"
    for leftover in (data, manifest, pending):
        fs.delete(jvm.org.apache.hadoop.fs.Path(leftover), True)
    batched = df.withColumn("batch", F.expr(f"chunk_id div {per_folder}"))
    seen = Observation()
    write(batched.observe(seen, F.count(F.lit(1)).alias("rows")).drop("chunk_id").write.partitionBy("batch"), data)
    bytes_ = spark.createDataFrame(list(_bytes(spark, data).items()), "batch long, bytes long")
    batched.groupBy("batch", "chunk_id").agg(F.count("*").alias("rows")).join(bytes_, "batch").write.parquet(pending)
    counted = spark.read.parquet(pending).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    if counted != seen.get["rows"]:
        raise RuntimeError(f"{seen.get['rows']} rows were written and {counted} counted: the input changed meanwhile")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(pending), jvm.org.apache.hadoop.fs.Path(manifest)):
        raise RuntimeError("the manifest could not be put in place")


def _bytes(spark: SparkSession, data: str) -> dict[int, int]:
    """Bytes of each committed folder."""
    fs, jvm = _fs(spark, data)
    root = jvm.org.apache.hadoop.fs.Path(data)
    found = fs.listStatus(root) if fs.exists(root) else []
    return {int(str(s.getPath().getName())[6:]): fs.getContentSummary(s.getPath()).getLength() for s in found if str(s.getPath().getName()).startswith("batch=")}


def verify(spark: SparkSession, path: str, attempt: str) -> DataFrame:
    """The committed chunks; fails if a folder of theirs is missing or has not the bytes it was committed with."""
    chunks = spark.read.schema("batch long, chunk_id long, rows long, bytes long").parquet(f"{path}/manifest-{attempt}")
    there = _bytes(spark, f"{path}/data-{attempt}")
    for r in chunks.select("batch", "bytes").distinct().toLocalIterator():
        if there.get(r["batch"]) != r["bytes"]:
            raise RuntimeError(f"committed batch {r['batch']} is missing or was changed")
    return chunks.drop("bytes")


def committed_paths(spark: SparkSession, path: str, attempt: str) -> str:
    """Where committed data is; fails if the attempt never committed."""
    if not _exists(spark, f"{path}/manifest-{attempt}/_SUCCESS"):
        raise RuntimeError("the attempt has not committed")
    return f"{path}/data-{attempt}/*"


def fixed_lines(df: DataFrame, fields: list[str], layout: Layout) -> DataFrame:
    """``df`` with ``line``; a field whose bytes are not just its width fails."""
    parts = [F.when(F.octet_length(c) == f.width, F.col(c)).otherwise(F.raise_error(F.lit(f"field {c} has not {f.width} bytes")).cast("string")) for c, f in zip(fields, layout.fields)]
    return df.withColumn("line", F.concat(*parts))


def fan_out(df: DataFrame, writers: list[Callable[[DataFrame], None]]) -> None:
    """The whole batch to every writer, in order; the first failure stops the rest."""
    kept = df.persist()
    try:
        for write in writers:
            write(kept)
    finally:
        kept.unpersist()


def classified(df: DataFrame, key: str, registered: list[str], path: str) -> None:
    """Each item to its class's folder; an unknown class fails before anything is committed."""
    known = F.when(F.col(key).isin(*registered), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no writer for class "), F.coalesce(key, F.lit("null")))).cast("string"))
    df.withColumn(key, known).write.partitionBy(key).parquet(path)


class Synchronized:
    """A delegate that is not safe for several callers at once, called by one at a time; within a process, as tasks are apart."""

    def __init__(self, delegate: Callable):
        self.delegate, self.lock = delegate, threading.Lock()

    def __call__(self, *args, **kwargs):
        with self.lock:
            return self.delegate(*args, **kwargs)


def one_writer(df: DataFrame, write: Callable) -> None:
    """For a sink that takes one connection: bounded rows of each partition go to ``write``, one partition after the other, in order."""
    kept = df.persist()
    try:
        for part in range(kept.rdd.getNumPartitions()):
            write(kept.filter(F.spark_partition_id() == part))
    finally:
        kept.unpersist()


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def ledger_rows(chunks: DataFrame) -> DataFrame:
    """``chunk_id, rows`` with the running total that commits along with each."""
    return running_totals(chunks, ["chunk_id"], {"cumulative_rows": F.col("rows")})
