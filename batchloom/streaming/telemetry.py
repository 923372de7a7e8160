"""Bounded telemetry over event tables and streams."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchloom.session import table

#: Series of a metric family, events of an execution and of all, records of the export queue.
MAX_SERIES, MAX_PER_EXECUTION, MAX_EVENTS, MAX_QUEUE = 200, 200, 4096, 65536


def fold_series(events: DataFrame, family: str, series: str, order: str, limit: int = MAX_SERIES) -> DataFrame:
    """``family, series, n``: the series seen first keep their name, all beyond the bound count as one.

    Series are counted before they are ranked, and each task sends on no more
    than ``limit`` of a family to be ranked with those of others.
    """
    counted = events.groupBy(family, series).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(family).orderBy("first"))
    named = counted.withColumn("_rank", rank).filter(F.col("_rank") < limit).select(family, series, "n")
    rest = counted.groupBy(family).agg(F.sum("n").alias("all")).join(named.groupBy(family).agg(F.sum("n").alias("of_named")), family, "left")
    other = rest.select(F.col(family).alias("family"), F.lit("__other__").alias("series"), (F.col("all") - F.coalesce("of_named", F.lit(0))).alias("n")).filter("n > 0")
    return named.select(F.col(family).alias("family"), F.col(series).cast("string").alias("series"), "n").unionByName(other)


def last_events(events: DataFrame, key: str, order: list[str], each: int, total: int = MAX_EVENTS) -> DataFrame:
    """The last ``each`` events per key among the last ``total`` of all."""
    recent = events.orderBy(*[F.desc(o) for o in order]).limit(total)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    return recent.withColumn("_rank", rank).filter(F.col("_rank") <= each).drop("_rank")


def metric_cardinality(spark, sf):
    return fold_series(table(spark, sf, "events"), "event_type", "user_id", "event_id", 100)


def incident_last_n(spark, sf):
    return last_events(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id")


def export_queue_drop(spark, sf, bound: int = 64):
    """A flush empties the queue daily; what comes beyond the bound is dropped, and each flush with a drop reports once."""
    flushes = table(spark, sf, "events").groupBy(F.date_trunc("DAY", "ts").alias("flush")).agg(F.count("*").alias("n"))
    dropped = F.greatest(F.col("n") - bound, F.lit(0))
    return flushes.agg(F.sum(F.col("n") - dropped).alias("accepted"), F.sum(dropped).alias("dropped"), F.count_if(dropped > 0).alias("reports_due"))


class Exporter:
    """A bounded queue of records before a sink; what comes while it is full is dropped and counted, never waited for.

    ``flush`` hands on all that is queued at its start, in batches, and says
    how much was written, dropped since the last flush, and left because the
    sink failed or the deadline passed; a failing sink loses nothing that is
    queued. A window with drops is reported once.
    """

    def __init__(self, sink: Callable[[list[dict]], None], bound: int = MAX_QUEUE, batch: int = 512, clock: Callable[[], float] = time.monotonic):
        if not 1 <= bound <= MAX_QUEUE:
            raise ValueError("the queue holds 1 to 65,536 records")
        self.sink, self.bound, self.batch, self.clock = sink, bound, batch, clock
        self.queue: deque[dict] = deque()
        self.lock, self.flushing = threading.Lock(), threading.Lock()
        self.dropped = self.reports = 0

    def offer(self, record: dict) -> bool:
        with self.lock:
            if len(self.queue) >= self.bound:
                self.dropped += 1
                return False
            self.queue.append(record)
            return True

    def flush(self, deadline: float = 30.0) -> dict:
        end, written, failure = self.clock() + deadline, 0, None
        with self.flushing:
            with self.lock:
                left, dropped, self.dropped = len(self.queue), self.dropped, 0
                self.reports += dropped > 0
            while left and failure is None and self.clock() < end:
                with self.lock:
                    part = [self.queue[i] for i in range(min(left, self.batch))]
                try:
                    self.sink(part)
                except Exception as e:
                    failure = type(e).__name__
                    break
                with self.lock:
                    for _ in part:
                        self.queue.popleft()
                left, written = left - len(part), written + len(part)
        return {"written": written, "dropped": dropped, "left": left, "failure": failure}


#: Growth vectors: samples of a warm-up and of the measured window.
VECTORS = {
    "constant-leak": ([100, 200, 300, 400, 500], [1000 + 100 * i for i in range(12)]),
    "settling": ([100, 200, 300, 400, 500], [500, 506, 510, 512, 513, 514, 514, 514, 514, 514, 514, 514]),
    "flat": ([300, 300, 300], [300, 300, 300, 300]),
    "rising-after-flat": ([300, 300, 300], [300, 301, 302]),
}


def rate_verdict(spark, sf):
    """Mean growth per interval in millionths; measured growth must be at most a quarter of the warm-up's."""
    rows = [(name, window, i, v) for name, windows in VECTORS.items() for window, samples in zip(("warmup", "measured"), windows) for i, v in enumerate(samples)]
    samples = spark.createDataFrame(rows, "vector string, window string, i long, value long")
    rate = F.expr("(max_by(value, i) - min_by(value, i)) * 1000000 div (count(*) - 1)")
    wide = samples.groupBy("vector").pivot("window", ["warmup", "measured"]).agg(rate)
    passes = F.when(F.col("warmup") > 0, F.col("measured") * 100 <= F.col("warmup") * 25).otherwise(F.col("measured") <= 0)
    return wide.select("vector", F.col("warmup").alias("warmup_rate_micro"), F.col("measured").alias("measured_rate_micro"), passes.alias("passes"))


QUERIES = {f.__name__: f for f in (metric_cardinality, incident_last_n, export_queue_drop, rate_verdict)}

_V = ", ".join(f"('{n}', {list(w)}, {list(m)})" for n, (w, m) in VECTORS.items())
ORACLES = {
    "metric_cardinality": """SELECT family, CASE WHEN r < 100 THEN CAST(user_id AS VARCHAR) ELSE '__other__' END AS series, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT event_type AS family, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY min(event_id)) AS r FROM events GROUP BY 1, 2) GROUP BY 1, 2""",
    "incident_last_n": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT user_id, event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 4096)) WHERE r <= 5",
    "export_queue_drop": """SELECT CAST(sum(least(n, 64)) AS BIGINT) AS accepted, CAST(sum(greatest(n - 64, 0)) AS BIGINT) AS dropped, count(*) FILTER (n > 64) AS reports_due FROM (SELECT date_trunc('day', ts) AS f, count(*) AS n FROM events GROUP BY 1)""",
    "rate_verdict": f"""SELECT vector, w AS warmup_rate_micro, m AS measured_rate_micro, CASE WHEN w > 0 THEN m * 100 <= w * 25 ELSE m <= 0 END AS passes FROM (
        SELECT vector, CAST((a[-1] - a[1]) * 1000000 // (len(a) - 1) AS BIGINT) AS w, CAST((b[-1] - b[1]) * 1000000 // (len(b) - 1) AS BIGINT) AS m FROM (VALUES {_V}) t(vector, a, b))""",
}
