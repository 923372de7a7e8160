"""Restartable chunk steps: an exact batch driver, and one over a bounded stream.

The ledger of a step is a folder of small commit records, one per chunk batch,
each written after the data it commits. It decides what is committed: data
without a record is removed by the next attempt, a record without its data
fails the restart.
"""

from __future__ import annotations

import functools
import json
import os
import re
import shutil
import uuid
from array import array
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from batchloom.functions.state import Codec, Envelope
from batchloom.operators.chunking import SIZE, fill_chunks
from batchloom.operators.fault import FaultPolicy, fault_counters, first_end, resolve
from batchloom.operators.ordering import released
from batchloom.operators.processors import keep
from batchloom.session import folder, table
from batchloom.streaming.listeners import Listeners


class StepFailed(RuntimeError):
    """A fault ended the step, or the skip limit was passed; batches before that of the failing chunk stay committed."""


class Conflict(RuntimeError):
    """Another attempt committed a record of this name."""


class OutcomeUnknown(RuntimeError):
    """It can't be told whether a record was committed; nothing may be tried again before someone looks."""


@functools.cache
def _default_scheme(spark: SparkSession) -> str:
    return str(spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).getScheme())


class Ledger:
    """Commit records of one step under ``path``, in any file system Spark can write.

    Files of the driver's own file system are reached without the JVM, whose
    every call takes longer than they do.
    """

    #: Fixed value: records that are written aside at the same time.
    WRITERS = 4

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._ahead: dict[str, tuple[dict, str, Future]] = {}
        scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
        self.local = (scheme[1] if scheme else _default_scheme(spark)) == "file"

    @functools.cached_property
    def jvm(self):
        return self.spark.sparkContext._jvm

    @functools.cached_property
    def conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    @functools.cached_property
    def fs(self):
        return self._path(self.path).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    @staticmethod
    def _own(name: str) -> str:
        return re.sub(r"^file:(//(?=/))?", "", name)

    def exists(self, name: str) -> bool:
        return os.path.exists(self._own(name)) if self.local else self.fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        if not self.local:
            self.fs.delete(self._path(name), True)
        elif os.path.isdir(self._own(name)):
            shutil.rmtree(self._own(name))
        elif self.exists(name):
            os.remove(self._own(name))

    def names(self, folder: str) -> list[str]:
        if self.local:
            return sorted(os.listdir(self._own(folder))) if os.path.isdir(self._own(folder)) else []
        if not self.exists(folder):
            return []
        return sorted(str(s.getPath().getName()) for s in self.fs.listStatus(self._path(folder)))

    def read(self, name: str) -> dict:
        return json.loads(self.bytes(name))

    def bytes(self, name: str) -> bytes:
        if self.local:
            with open(self._own(name), "rb") as file:
                return file.read()
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def publish(self, name: str, data: bytes) -> None:
        """A file whose name says what it holds: it does not matter who of several puts it there."""
        aside = f"{self.path}/.{uuid.uuid4().hex}"
        try:
            self._publish(aside, name, data)
        except Exception:
            if not self.exists(name):
                raise
        finally:
            if self.exists(aside):
                self.delete(aside)

    def _write(self, name: str, data: bytes) -> None:
        if self.local:
            try:
                self._write_own(self._own(name), data)
            except FileNotFoundError:
                os.makedirs(self._own(self.path), exist_ok=True)
                self._write_own(self._own(name), data)
            return
        stream = self.fs.create(self._path(name), False)
        stream.write(bytearray(data))
        stream.close()

    @staticmethod
    def _write_own(name: str, data: bytes) -> None:
        with open(name, "xb", buffering=0) as file:
            file.write(data)
            os.fsync(file.fileno())

    def _publish(self, aside: str, target: str, data: bytes | None) -> None:
        """Make ``target`` whole in one step that fails if it is there: a link, a rename that replaces nothing, or an exclusive put. Without ``data``, ``aside`` is there."""
        if self.local:
            if data is not None:
                self._write(aside, data)
            self._link(aside, target)
        elif str(self.fs.getUri().getScheme()) in ("hdfs", "viewfs"):
            self._write(aside, data)
            self._rename(aside, target)
        else:
            self._write(target, data)

    def _link(self, aside: str, target: str) -> None:
        os.link(self._own(aside), self._own(target))

    def _rename(self, aside: str, target: str) -> None:
        """Without the option to overwrite; only this call of the file system's refuses a target that is there."""
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._path(aside), self._path(target), options)

    @staticmethod
    def _encoded(record: dict, token: str) -> bytes:
        return json.dumps(record | {"_token": token}, sort_keys=True).encode()

    @contextmanager
    def ahead(self, records: dict[str, dict]):
        """Within this block these records are written aside, and their commits, if they are of the same record, only publish them.

        So they reach the disk while other work, as that of writing the data,
        goes on. What is not committed is removed at the end. Elsewhere than in
        the driver's own file system nothing is written ahead.
        """
        with ThreadPoolExecutor(self.WRITERS) as threads:
            for name, record in records.items() if self.local else ():
                token = uuid.uuid4().hex
                self._ahead[name] = record, token, threads.submit(self._write, f"{self.path}/.{name}-{token}", self._encoded(record, token))
            try:
                yield
            finally:
                threads.shutdown(cancel_futures=True)
                for name, (_, token, _) in self._ahead.items():
                    if self.exists(aside := f"{self.path}/.{name}-{token}"):
                        self.delete(aside)
                self._ahead = {}

    def commit(self, name: str, record: dict) -> None:
        """A record is there whole or not at all, and never replaced: of two commits at once one is a :class:`Conflict`."""
        ahead = self._ahead[name] if name in self._ahead and self._ahead[name][0] == record else None
        token = ahead[1] if ahead else uuid.uuid4().hex
        target, aside = f"{self.path}/{name}.json", f"{self.path}/.{name}-{token}"
        if self.exists(target):
            raise Conflict(f"{name} was committed by another attempt")
        failed = None
        try:
            if ahead:
                ahead[2].result()
            self._publish(aside, target, None if ahead else self._encoded(record, token))
        except Exception as e:  # who won is read from the record itself
            failed = e
        try:
            if self.exists(aside):
                self.delete(aside)
            there = self.read(target)["_token"] if failed is not None else token
        except Exception:
            raise OutcomeUnknown(f"the outcome of committing {name} is unknown") from failed
        if there != token:
            raise Conflict(f"{name} was committed by another attempt") from failed

    def get(self, name: str) -> dict:
        record = self.read(f"{self.path}/{name}")
        record.pop("_token", None)
        return record

    def records(self) -> list[dict]:
        return [self.get(n) for n in self.names(self.path) if n.endswith(".json")]


_COUNTS = ("read", "written", "filtered", "read_skips", "process_skips", "write_skips", "rolled_back_chunks", "rollback_count", "no_rollback_count", "commits")


@dataclass
class Counters:
    read: int = 0
    written: int = 0
    filtered: int = 0
    read_skips: int = 0
    process_skips: int = 0
    write_skips: int = 0
    rolled_back_chunks: int = 0
    rollback_count: int = 0
    no_rollback_count: int = 0
    commits: int = 0

    def add(self, record: dict) -> None:
        for name in _COUNTS:
            setattr(self, name, getattr(self, name) + record[name])


class ItemStream:
    """State that goes along with a step: opened before anything is read, told at each commit, closed at the end."""

    def __init__(self, name: str, codec: Codec):
        self.name, self.codec = name, codec

    def open(self, state: dict | None) -> None: ...

    def update(self, record: dict) -> dict:
        """The state as of a batch that is about to be committed."""
        return {}

    def close(self) -> None: ...


class _Streams:
    """Open in order, close in reverse; a failing close never hides another failure, and the rest are closed."""

    def __init__(self, streams: list[ItemStream], last: dict | None):
        self.streams, self.last, self.opened = streams, last or {}, []

    def __enter__(self):
        try:
            for s in self.streams:
                kept = self.last.get(s.name)
                value = s.codec.open(Envelope(**kept | {"payload": kept["payload"].encode()}))[0] if kept else None
                self.opened.append(s)
                s.open(value)
        except Exception as e:
            self.__exit__(type(e), e, None)
            raise
        return self

    def states(self, record: dict) -> dict:
        found = {}
        for s in self.streams:
            kept = asdict(Envelope.of(s.name, s.codec.schema, s.codec.version, s.update(record)))
            found[s.name] = kept | {"payload": kept["payload"].decode()}
        return found

    def __exit__(self, kind, error, trace):
        failures = []
        for s in reversed(self.opened):
            try:
                s.close()
            except Exception as e:
                failures.append(e)
        if failures and error is None:
            raise failures[0]
        return False


class _Waves:
    """The items of a step, stored by wave, so that a wave reads its own items and no others."""

    def __init__(self, ledger: Ledger, items: DataFrame, path: str, wave: int):
        self.spark, self.schema, self.path, self.wave = ledger.spark, items.schema, path, wave
        items.withColumn("_wave", F.expr(f"_batch div {wave}")).write.partitionBy("_wave").parquet(path)
        self.there = {int(n[6:]) for n in ledger.names(path) if n.startswith("_wave=")}

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def between(self, first: int, last: int) -> DataFrame:
        """Items of the batches from ``first`` to ``last``."""
        names = [f"{self.path}/_wave={w}" for w in range(first // self.wave, last // self.wave + 1) if w in self.there]
        return self.spark.read.schema(self.schema).parquet(*names).filter(F.col("_batch").between(first, last))


#: Types that workers write as Spark does; tables with others are left to Spark's writer.
_PLAIN = re.compile(r"boolean|tinyint|smallint|int|bigint|float|double|decimal\(.*\)|string|binary")


def _is_plain(schema: StructType) -> bool:
    names = {f.name.lower() for f in schema} - {"batch"}
    return len(names) == len(schema) > 1 and schema["_batch"].dataType.simpleString() == "bigint" and all(_PLAIN.fullmatch(f.dataType.simpleString()) for f in schema)


def _filed(aside: str) -> Callable:
    """A task's rows, sorted by ``_batch``, as one file for each batch in a folder of the attempt's own; what it wrote."""
    def run(batches):
        mine = f"{aside}/{uuid.uuid4().hex}"
        os.mkdir(mine)  # fails once the job is over and ``aside`` is gone
        found, writer = [], None
        for rows in batches:
            runs = pc.run_end_encode(rows.column("_batch"))
            rest, lo = rows.drop_columns(["_batch"]), 0
            for batch, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if not found or found[-1] != batch:
                    if writer is not None:
                        writer.close()
                    writer = pq.ParquetWriter(f"{mine}/{batch}", rest.schema, store_schema=False)
                    found.append(batch)
                writer.write_batch(rest.slice(lo, hi - lo))
                lo = hi
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_pydict({"batch": pa.array(found, pa.int64()), "folder": pa.array([mine] * len(found), pa.string())})

    return run


def _write_files(out: DataFrame, data: str) -> None:
    """The rows of ``out`` in folders by ``_batch``, as Spark's writer lays them out, in a file system that the driver and workers share.

    Without Hadoop's native library, Spark's writer starts two processes for
    each file, to set its mode. As with Spark's, files are moved to their place
    by the driver, and only those of attempts that count.
    """
    aside = f"{data}/.write-{uuid.uuid4().hex}"
    os.makedirs(aside)
    try:
        for row in out.sortWithinPartitions("_batch").mapInArrow(_filed(aside), "batch long, folder string").collect():
            place = f"{data}/batch={row['batch']}"
            os.makedirs(place, exist_ok=True)
            os.rename(f"{row['folder']}/{row['batch']}", f"{place}/part-{os.path.basename(row['folder'])}.snappy.parquet")
    finally:
        shutil.rmtree(aside, ignore_errors=True)


@dataclass
class ChunkStep:
    """Read, process and write in chunks of ``size``, ``per_commit`` of them with one record, ``wave`` records with one job.

    ``bad`` marks malformed reads, which are skipped up to ``skip_limit`` in
    all; ``process`` maps a batch and may filter by leaving rows out; ``kept``
    says which rows it keeps, for the counters. ``faults`` gives, for a phase
    and the number of retries before, the category of an item's fault, or null;
    what follows from it is up to ``policy``, item by item, and its skips count
    toward the same limit. An item that is skipped in processing or writing
    keeps its place in its chunk.

    ``listeners`` of the families ``chunk``, ``read``, ``process`` and
    ``write`` are called with the batch, around its commit and around the parts
    of it. ``in_flight`` says what a stop does to the batches of a wave that is
    written: FINISH commits them, ROLLBACK leaves them to the next attempt.
    ``completed`` is told of each record after its commit and may ask to stop.
    Writes that raise one of ``retryable`` are tried again as often as
    ``retries`` (durable, so that a restart goes on counting) allows.
    """

    name: str
    order: list[str]
    bad: Column
    kept: Column
    process: Callable[[DataFrame], DataFrame]
    skip_limit: int = 0
    size: int = SIZE
    per_commit: int = 1000
    before_commit: Callable[[int], None] = field(default=lambda batch: None)
    wave: int = 1000
    policy: FaultPolicy = field(default_factory=FaultPolicy)
    faults: dict[str, Callable[[int], Column]] = field(default_factory=dict)
    listeners: dict[str, Listeners] = field(default_factory=dict)
    streams: list[ItemStream] = field(default_factory=list)
    in_flight: str = "FINISH"
    retries: object = None
    retryable: tuple[type[Exception], ...] = ()
    completed: Callable[[dict], bool] = field(default=lambda record: False)

    def resolved(self, items: DataFrame) -> DataFrame:
        """``items`` with their chunk, batch, and what became of each: ``_skip`` (a phase), ``_retries``, ``_rolled``, ``_end``."""
        marked = resolve(items, self.faults, self.policy)
        bad = F.coalesce(self.bad, F.lit(False)) | F.coalesce(F.col("_skip") == "read", F.lit(False))
        filled = fill_chunks(marked, self.order, bad, self.size).withColumn("_skip", F.when(F.col("bad"), "read").otherwise(F.col("_skip")))
        return filled.withColumn("_batch", F.expr(f"chunk_id div {self.per_commit}"))

    def run(self, spark: SparkSession, items: DataFrame, path: str, stop: Callable[[], bool] = lambda: False) -> tuple[str, Counters]:
        """Commit what is not committed yet: ``(status, counters)`` over all attempts."""
        ledger = Ledger(spark, f"{path}/ledger")
        done = {r["batch"]: r for r in ledger.records()}
        there = set(ledger.names(f"{path}/data"))
        for batch, record in done.items():
            if record["written"] and f"batch={batch}" not in there:
                raise RuntimeError(f"the data of committed batch {batch} is missing")
        for name in there:
            if name.startswith(".write-") or (name.startswith("batch=") and int(name[6:]) not in done):
                ledger.delete(f"{path}/data/{name}")
        for name in ledger.names(path):
            if name.startswith("waves-"):
                ledger.delete(f"{path}/{name}")
        counters = Counters()
        for batch in sorted(done):
            counters.add(done[batch])
        last = done[max(done)].get("state") if done else None
        with released(), _Streams(self.streams, last) as streams:
            staged = f"{path}/waves-{uuid.uuid4().hex}"
            try:
                with released():  # the ranges are not needed once their rows are stored
                    waves = _Waves(ledger, self.resolved(items), staged, self.wave)
                return self._run(ledger, waves, path, stop, done, counters, streams), counters
            except OutcomeUnknown:
                return "UNKNOWN", counters
            finally:
                ledger.delete(staged)

    def _run(self, ledger: Ledger, waves: _Waves, path: str, stop, done: dict, counters: Counters, streams: _Streams) -> str:
        filled = waves.all()
        end = first_end(filled, self.order, self.skip_limit)
        good = ~F.col("bad") & F.col("_skip").isNull()
        kept = keep(self.kept)
        plan = filled.groupBy("_batch").agg(
            F.count_if(~F.col("bad")).alias("read"), F.count_if(good & kept).alias("written"), F.count_if(good & ~kept).alias("filtered"), *fault_counters(),
            F.count_distinct("chunk_id").alias("commits"), F.max("chunk_id").alias("last")).orderBy("_batch")
        ahead = iter(plan.toLocalIterator())
        failing = end and end["chunk_id"]
        while True:
            rows = []
            while len(rows) < self.wave and (row := next(ahead, None)) is not None:
                if failing is not None and row["last"] >= failing:
                    break
                if row["_batch"] not in done:
                    rows.append(row)
            if rows:
                if stop():
                    return "STOPPED"
                first, last = rows[0]["_batch"], rows[-1]["_batch"]
                part = waves.between(first, last).filter(good).drop("bad", "_skip", "_retries", "_rolled", "_end")
                if among := [b for b in range(first, last + 1) if b in done]:
                    part = part.filter(~F.col("_batch").isin(among))
                if len(rows) >= (cores := ledger.spark.sparkContext.defaultParallelism):  # a wave's items are next to each other, in one or two tasks
                    part = part.repartition(cores, "_batch")
                part = part.sortWithinPartitions("_batch", *self.order)
                records = [{k: row[k] for k in _COUNTS} | {"batch": row["_batch"]} for row in rows]
                with ledger.ahead({} if self.streams else {f"{r['batch']:012d}": r for r in records}):  # streams tell their state only at the commit
                    self._write_again(ledger, part, [row["_batch"] for row in rows], path)
                    for record in records:
                        if self.in_flight == "ROLLBACK" and stop():
                            return "STOPPED"
                        self._commit(ledger, record, streams)
                        counters.add(record)
                        if self.completed(record):
                            return "STOPPED"
            if len(rows) < self.wave:
                break
        if end is None:
            return "COMPLETED"
        if end["kind"] in ("STOP", "UNKNOWN"):
            return {"STOP": "STOPPED", "UNKNOWN": "UNKNOWN"}[end["kind"]]
        raise StepFailed(f"{self.name}: chunk {failing} failed" if end["kind"] == "FAIL" else f"{self.name}: more than {self.skip_limit} skips")

    def _write_again(self, ledger: Ledger, part: DataFrame, batches: list[int], path: str) -> None:
        def work() -> None:
            for batch in batches:
                if ledger.exists(f"{path}/data/batch={batch}"):
                    ledger.delete(f"{path}/data/batch={batch}")
            self._write(ledger, part, batches, path)

        if self.retries is None:
            self._write(ledger, part, batches, path)
        else:
            self.retries.run(self.retries.key("", self.name, "write", str(batches[0]).encode(), 0), work, self.retryable)

    def _write(self, ledger: Ledger, part: DataFrame, batches: list[int], path: str) -> None:
        """All batches with one job where ``process`` leaves the column ``_batch`` in place, else with one for each."""
        out = self.process(part)
        if "_batch" in out.columns:
            if ledger.local and _is_plain(out.schema):
                _write_files(out, ledger._own(f"{path}/data"))
                return
            out.withColumnRenamed("_batch", "batch").write.mode("append").partitionBy("batch").parquet(f"{path}/data")
            return
        for batch in batches:
            self.process(part.filter(F.col("_batch") == batch).drop("_batch")).write.mode("append").parquet(f"{path}/data/batch={batch}")

    def _commit(self, ledger: Ledger, record: dict, streams: _Streams) -> None:
        around = lambda family, work: self.listeners[family].around(work, record["batch"]) if family in self.listeners else work(record["batch"])

        def commit(batch: int) -> None:
            self.before_commit(batch)
            state = streams.states(record)
            ledger.commit(f"{batch:012d}", record | ({"state": state} if state else {}))

        def phases(_: int) -> None:
            around("read", lambda batch: None)
            around("process", lambda batch: None)
            around("write", commit)

        around("chunk", phases)


def run_stream(spark: SparkSession, source: str, schema: str, path: str, process: Callable[[DataFrame], DataFrame], files_per_batch: int = 1) -> list[dict]:
    """New files of a folder as bounded micro-batches, each committed once; the ledger's records.

    A micro-batch that is delivered again after a failure finds its record, or
    replaces data that never got one.
    """
    ledger = Ledger(spark, f"{path}/ledger")

    def write(df: DataFrame, batch: int) -> None:
        if ledger.exists(f"{ledger.path}/{batch:012d}.json"):
            return
        ledger.delete(f"{path}/data/batch={batch}")
        process(df).write.parquet(f"{path}/data/batch={batch}")
        ledger.commit(f"{batch:012d}", {"batch": batch, "written": spark.read.parquet(f"{path}/data/batch={batch}").count()})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return ledger.records()


class _Told:
    """What listeners are told, in order; kept in small parts, which go to ``path``."""

    #: Fixed value: calls of a part.
    MOST = 1_000_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.n, self.phases = spark, path, 0, {}
        self.batches, self.codes = array("q"), array("q")

    def of(self, phase: str) -> Callable[[int], None]:
        code = self.phases.setdefault(phase, len(self.phases))

        def tell(batch: int) -> None:
            self.batches.append(batch)
            self.codes.append(code)
            if len(self.codes) >= self.MOST:
                self.flush()

        return tell

    def flush(self) -> None:
        names = pa.array(list(self.phases), pa.string())
        part = pa.table({"n": pa.array(range(self.n, self.n + len(self.codes)), pa.int64()), "chunk_id": pa.array(self.batches, pa.int64()), "phase": names.take(pa.array(self.codes, pa.int64()))})
        self.spark.createDataFrame(part).write.mode("append").parquet(self.path)
        self.n += len(self.codes)
        self.batches, self.codes = array("q"), array("q")

    def rows(self) -> DataFrame:
        """``n, chunk_id, phase``, where ``n`` tells the order of all calls."""
        self.flush()
        return self.spark.read.schema("n long, chunk_id long, phase string").parquet(self.path)


def listener_event_order(spark, sf):
    """What listeners of a step over all orders are told, in order: two of chunks, one of each phase."""
    path = folder(spark)
    told = _Told(spark, f"{path}/told")

    def pair(name: str) -> tuple[Callable, Callable]:
        return told.of(f"before-{name}"), told.of(f"after-{name}")

    listeners = {"chunk": Listeners(pair("1"), pair("2"))} | {f: Listeners(pair(f)) for f in ("read", "process", "write")}
    step = ChunkStep("orders", ["o_orderkey"], F.lit(False), F.lit(True), lambda df: df, per_commit=1, listeners=listeners)
    step.run(spark, table(spark, sf, "orders").select("o_orderkey"), path)
    seq = F.row_number().over(Window.partitionBy("chunk_id").orderBy("n")).cast("long")
    return told.rows().select("chunk_id", seq.alias("seq"), "phase")


QUERIES = {"listener_event_order": listener_event_order}

ORACLES = {
    "listener_event_order": f"""SELECT chunk_id, CAST(seq AS BIGINT) AS seq, p[seq] AS phase FROM (SELECT DISTINCT (row_number() OVER (ORDER BY o_orderkey) - 1) // {SIZE} AS chunk_id FROM orders),
        (SELECT ['before-1', 'before-2', 'before-read', 'after-read', 'before-process', 'after-process', 'before-write', 'after-write', 'after-2', 'after-1'] AS p), range(1, 11) r(seq)""",
}
