import threading
import time

import pytest
from pyspark.sql import functions as F

from batchloom.functions.state import Codec, Envelope, StateError, encode
from batchloom.operators.ordering import number_rows, released
from batchloom.plans.flow import PlanError, run_split
from batchloom.plans.partitioned import Retries, run_partitioned
from batchloom.streaming.listeners import ListenerError, Listeners, Shutdown
from batchloom.streaming.steps import ChunkStep
from batchloom.streaming.telemetry import Exporter


def test_state_upgrades_and_checks():
    codec = Codec("rows", 3, {1: (2, lambda v: v | {"b": 1}), 2: (3, lambda v: v | {"c": v["b"] + 1})})
    old = Envelope.of("reader", "rows", 1, {"a": "é"})
    value, kept = codec.open(old)
    assert value == {"a": "é", "b": 1, "c": 2} and kept.schema_version == 3 and codec.open(kept) == (value, kept)
    for bad in (Envelope.of("reader", "rows", 4, {}), Envelope.of("reader", "other", 3, {}), Envelope.of("reader", "rows", 3, {}, codec_version=2), Envelope("reader", "rows", 3, "json", 1, b"{}", "0")):
        with pytest.raises(StateError):
            codec.open(bad)
    with pytest.raises(StateError):
        Codec("rows", 3, {1: (4, dict)}).open(old)
    with pytest.raises(StateError):
        Codec("rows", 3, {1: (1, dict)}).open(old)


def test_state_bounds():
    deep = {}
    for _ in range(70):
        deep = {"d": deep}
    for bad in (deep, {"x": "y" * (1 << 20)}, {"x": float("nan")}, []):
        with pytest.raises((StateError, ValueError)):
            encode(bad)


def test_listeners_nest():
    seen = []
    pair = lambda n, fail=None: (lambda: seen.append(f"+{n}") or fail and 1 / 0, lambda: seen.append(f"-{n}"))
    Listeners(pair(1), pair(2)).around(lambda: seen.append("work"))
    assert seen == ["+1", "+2", "work", "-2", "-1"]
    seen.clear()
    with pytest.raises(ListenerError):
        Listeners(pair(1), pair(2, fail=True), pair(3)).around(lambda: seen.append("work"))
    assert seen == ["+1", "+2", "-1"]


@pytest.mark.parametrize("workers", [1, 4])
def test_partitions_restart(spark, tmp_path, workers):
    plan = {f"k{i}": {"n": i} for i in range(6)}
    bad = {"k2", "k4"}
    work = lambda key, c: {"status": "FAILED" if key in bad else "COMPLETED", "exit": f"E-{key}", "read": spark.range(c["n"]).count(), "written": c["n"]}
    first = run_partitioned(spark, str(tmp_path), plan, work, workers, 8)
    assert (first["status"], first["exit"], first["read"], first["ran"]) == ("FAILED", "E-k2", 15, 6)
    bad.clear()
    again = run_partitioned(spark, str(tmp_path), plan, work, workers, 8, attempt=2)
    assert (again["status"], again["exit"], again["read"], again["ran"]) == ("COMPLETED", "E-k0", 15, 2)
    with pytest.raises(PlanError):
        run_partitioned(spark, str(tmp_path), plan, work, 8, 8)


def test_retries_are_counted_over_restarts(spark, tmp_path):
    calls, key = [], Retries.key("d", "import", "write", b"7", 0)

    def work():
        calls.append(1)
        raise TimeoutError

    retries = Retries(spark, str(tmp_path), 3, sleep=lambda s: None)
    with pytest.raises(TimeoutError):
        retries.run(key, work, (TimeoutError,))
    assert len(calls) == 4
    with pytest.raises(TimeoutError):
        Retries(spark, str(tmp_path), 3, sleep=lambda s: None).run(key, work, (TimeoutError,))
    assert len(calls) == 5
    retries.clear(key)
    assert retries.run(key, lambda: "done", (TimeoutError,)) == "done"


def test_shutdown_drains_and_escalates(spark):
    done = threading.Event()
    shutdown = Shutdown(spark, 20)
    shutdown.spawn("quick", lambda: spark.range(10).count() and done.set())
    report = shutdown.stop(persist=lambda: None, flush=lambda: 1 / 0, close=lambda: None)
    assert done.is_set() and report == {"cancelled": [], "unjoined": [], "persist": "OK", "flush": "ZeroDivisionError", "close": "OK"}
    with pytest.raises(RuntimeError):
        shutdown.ensure_accepting()
    assert shutdown.request() == "ESCALATED"
    with pytest.raises(ValueError):
        Shutdown(spark, 0)


def test_split_policies(spark):
    def fail():
        raise OSError

    ran = []
    step = lambda n: lambda: ran.append(n) or ("COMPLETED", f"E{n}")
    assert run_split([("a", [fail, step(1)]), ("b", [step(2), step(3)])], 2, 3) == ("FAILED", "OSError") and sorted(ran) == [2, 3]
    ran.clear()
    blocked = threading.Event()

    def wait():
        blocked.set()
        list(spark.range(2).repartition(2).toDF("n").mapInArrow(_sleep, "n long").toLocalIterator())
        return "COMPLETED", "COMPLETED"

    def fail_then():
        blocked.wait(20)
        time.sleep(1)
        raise OSError

    began = time.monotonic()
    assert run_split([("a", [wait, step(1)]), ("b", [fail_then]), ("c", step(4))], 3, 4, "CANCEL", spark) == ("FAILED", "OSError")
    assert ran == [4] and time.monotonic() - began < 40
    for bad in (dict(branches=[("a", fail)]), dict(branches=[("a", fail), ("a", fail)]), dict(branches=[("a", [fail] * 9), ("b", fail)]), dict(policy="OTHER"), dict(pool=2)):
        with pytest.raises(PlanError):
            run_split(**{"branches": [("a", fail), ("b", fail)], "workers": 2, "pool": 3} | bad)


def _sleep(batches):
    time.sleep(60)
    yield from batches


def test_exporter_drops_and_flushes():
    wrote, down = [], []

    def sink(records):
        if down:
            raise OSError
        wrote.extend(records)

    exporter = Exporter(sink, 5, batch=2)
    assert [exporter.offer({"n": n}) for n in range(7)] == [True] * 5 + [False] * 2
    down.append(1)
    assert exporter.flush() == {"written": 0, "dropped": 2, "left": 5, "failure": "OSError"}
    down.clear()
    assert exporter.flush() == {"written": 5, "dropped": 0, "left": 0, "failure": None} and exporter.reports == 1
    assert [r["n"] for r in wrote] == list(range(5)) and exporter.flush()["written"] == 0
    exporter.offer({})
    assert exporter.flush(deadline=0)["left"] == 1
    with pytest.raises(ValueError):
        Exporter(sink, 0)


def test_writes_are_tried_again(spark, tmp_path):
    tries = []

    def process(df):
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return df

    def step(limit, name):
        return ChunkStep("import", ["id"], F.lit(False), F.lit(True), process, size=2, per_commit=1, retries=Retries(spark, str(tmp_path / name), limit, sleep=lambda s: None), retryable=(TimeoutError,))

    with pytest.raises(TimeoutError):
        step(1, "r").run(spark, spark.range(5), str(tmp_path / "job"))
    assert step(2, "r").run(spark, spark.range(5), str(tmp_path / "job"))[1].commits == 3 and len(tries) == 3
    assert spark.read.parquet(str(tmp_path / "job/data")).count() == 5


def test_ranges_are_released(spark):
    count = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = count()
    with released():
        assert number_rows(spark.range(9), ["id"]).count() == 9 and count() > before
    assert count() == before
