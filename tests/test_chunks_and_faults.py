import threading

import pytest
from pyspark.sql import functions as F

from batchloom.operators.aggregates import bounded_groups
from batchloom.operators.chunking import chunk_counters, commits, fill_chunks
from batchloom.operators.fault import Backoff, classified, until_skip_limit
from batchloom.operators.ordering import number_rows, running_totals
from batchloom.operators.processors import classify, filter_items, validate_items
from batchloom.functions.state import Codec
from batchloom.operators.fault import FaultPolicy, fault_counters, resolve
from batchloom.streaming.listeners import Listeners
from batchloom.streaming.steps import ChunkStep, Conflict, Counters, ItemStream, Ledger, OutcomeUnknown, StepFailed, _Told, run_stream


def table(spark, flags):
    return spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "id long, bad boolean").repartition(7)


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k")).repartition(13)
    assert sorted((r["k"], r["pos"]) for r in number_rows(df, ["k"]).collect()) == [(3 * i, i) for i in range(1000)]
    sums = running_totals(df, ["k"], {"s": F.col("k")}).orderBy("k").collect()
    assert [r["s"] for r in sums][:4] == [0, 3, 9, 18] and sums[-1]["s"] == 3 * 999 * 500


def test_empty_table(spark):
    empty = spark.range(0).select(F.col("id").alias("k"))
    assert number_rows(empty, ["k"]).count() == 0
    assert bounded_groups(empty, ["k"], 7, n=F.count("*")).count() == 0


@pytest.mark.parametrize(("flags", "expected"), [
    ([False] * 6, 2), ([False] * 7, 3), ([], 0), ([False] * 6 + [True], 3), ([False] * 5 + [True], 2), ([True, True], 1), ([True] + [False] * 3, 1)])
def test_commit_counts(spark, flags, expected):
    assert commits(table(spark, flags), "id", F.col("bad"), 3).first()["commit_count"] == expected


def test_skips_take_no_place(spark):
    filled = fill_chunks(table(spark, [False, True, False, False, True, False, True]), ["id"], F.col("bad"), 3)
    assert [(r["id"], r["chunk_id"]) for r in filled.orderBy("id").collect()] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1)]
    counted = chunk_counters(filled, F.col("id") != 5, "id").orderBy("chunk_id").collect()
    assert [(r["read"], r["written"], r["filtered"], r["read_skips"]) for r in counted] == [(3, 3, 0, 1), (1, 0, 1, 2)]


def test_filters_are_two_valued(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v long")
    kept, counts = filter_items(df, F.col("v") > 1)
    assert kept.count() == 1 and tuple(counts.first()) == (3, 1, 2)
    good, bad = validate_items(df, F.col("v") > 1)
    assert (good.count(), bad.count()) == (1, 2)
    with pytest.raises(Exception, match="violates"):
        validate_items(df, F.col("v") > 1, fail=True)[0].collect()


def test_unknown_class_fails(spark):
    df = spark.createDataFrame([("x",)], "k string")
    with pytest.raises(Exception, match="no processor"):
        df.select(classify(F.col("k"), {"a": F.lit(1)})).collect()


def test_two_rules_for_one_fault_fail(spark):
    faults = spark.createDataFrame([("read", "PARSE")], "phase string, category string")
    rules = spark.createDataFrame([("read", "PARSE", "SKIP"), ("read", "PARSE", "RETRY")], "phase string, category string, action string")
    with pytest.raises(Exception, match="two rules"):
        classified(faults, rules).collect()


def test_backoff_vector(spark):
    delays = spark.range(1, 10).select(Backoff(50, 2, 5000).delay(F.col("id")).alias("d")).collect()
    assert [r["d"] for r in delays] == [50, 100, 200, 400, 800, 1600, 3200, 5000, 5000]


def test_skip_limit_counts_over_all_chunks(spark):
    assert until_skip_limit(table(spark, [True, False, True, False, True, False]), ["id"], F.col("bad"), 2).count() == 4


def step(limit=1, **more):
    return ChunkStep("import", ["id"], F.col("bad"), F.col("id") % 2 == 0, lambda df: df.filter("id % 2 = 0").select("id"), limit, 3, 1, **more)


def test_step_restarts_after_a_lost_commit(spark, tmp_path):
    path, items = str(tmp_path / "job"), table(spark, [False, False, True, False, False, False, False])

    def lose(batch):
        if batch == 1:
            raise ConnectionError("lost before the commit")

    with pytest.raises(ConnectionError):
        step(before_commit=lose).run(spark, items, path)
    assert [r["batch"] for r in Ledger(spark, f"{path}/ledger").records()] == [0]
    status, counters = step().run(spark, items, path)
    assert status == "COMPLETED" and (counters.read, counters.written, counters.filtered, counters.read_skips, counters.commits) == (6, 3, 3, 1, 2)
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/data").select("id").collect()) == [0, 4, 6]
    assert step().run(spark, items, path) == (status, counters)
    import shutil

    shutil.rmtree(f"{path}/data/batch=1")
    with pytest.raises(RuntimeError, match="missing"):
        step().run(spark, items, path)


def test_step_stops_and_fails(spark, tmp_path):
    items = table(spark, [False, False, False, True, True, False])
    with pytest.raises(StepFailed):
        step(1).run(spark, items, str(tmp_path / "a"))
    assert [r["batch"] for r in Ledger(spark, str(tmp_path / "a/ledger")).records()] == [0]
    assert step(2).run(spark, items, str(tmp_path / "b"), stop=lambda: True)[0] == "STOPPED"


def test_a_record_is_never_replaced(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.commit("0", {"a": 1})
    with pytest.raises(Conflict, match="another attempt"):
        ledger.commit("0", {"a": 2})
    assert ledger.records() == [{"a": 1}]


def test_of_two_commits_at_once_one_wins(spark, tmp_path, monkeypatch):
    """Both attempts see no record before they write theirs."""
    ledgers = [Ledger(spark, str(tmp_path)) for _ in range(2)]
    monkeypatch.setattr(Ledger, "exists", lambda self, name: "/." in name)
    barrier, won = threading.Barrier(2), []

    def commit(k):
        for n in range(20):
            barrier.wait()
            try:
                ledgers[k].commit(f"{n:03d}", {"by": k})
                won.append((n, k))
            except Conflict:
                pass

    threads = [threading.Thread(target=commit, args=(k,)) for k in range(2)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    monkeypatch.undo()
    assert sorted(n for n, _ in won) == list(range(20)) and [r["by"] for r in ledgers[0].records()] == [k for _, k in sorted(won)]
    assert len(ledgers[0].names(str(tmp_path))) == 20  # nothing is left beside the records


@pytest.mark.parametrize("way", ["_link", "_rename", "put"])
def test_ways_to_publish_replace_nothing(spark, tmp_path, monkeypatch, way):
    ledger = Ledger(spark, str(tmp_path / way))
    if way == "_rename":
        monkeypatch.setattr(Ledger, "_link", Ledger._rename)
    if way == "put":
        monkeypatch.setattr(Ledger, "_publish", lambda self, aside, target, data: self._write(target, data))
    ledger.commit("0", {"a": 1})
    monkeypatch.setattr(Ledger, "exists", lambda self, name: "/." in name and (tmp_path / way / name.rsplit("/", 1)[1]).exists())
    with pytest.raises(Conflict):
        ledger.commit("0", {"a": 2})
    monkeypatch.undo()
    assert ledger.records() == [{"a": 1}] and ledger.names(ledger.path) == ["0.json"]


def test_an_unknown_outcome_ends_the_step(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Ledger, "_publish", lambda *a: 1 / 0)
    with pytest.raises(OutcomeUnknown):
        Ledger(spark, str(tmp_path / "l")).commit("0", {})
    assert step().run(spark, table(spark, [False]), str(tmp_path / "job"))[0] == "UNKNOWN"


POLICY = FaultPolicy((("process", "TIMEOUT", "RETRY"), ("process", "PARSE", "SKIP"), ("write", "CONFLICT", "RETRY_THEN_SKIP"), ("read", "TIMEOUT", "RETRY")), 2, frozenset({("process", "PARSE")}))


def faulty(spark, kinds):
    """Items with a fault each: the phase, category, and how many tries it lasts."""
    return spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "id long, phase string, category string, lasts long").repartition(5)


FAULTS = {p: (lambda retries, p=p: F.when((F.col("phase") == p) & (F.col("lasts") > retries), F.col("category"))) for p in ("read", "process", "write")}
NONE, SLOW, STUCK, TORN, BUSY, DEAD = (None, None, 0), ("process", "TIMEOUT", 2), ("process", "TIMEOUT", 3), ("process", "PARSE", 1), ("write", "CONFLICT", 9), ("write", "CONFLICT", 1)


def fault_step(limit, **more):
    return ChunkStep("import", ["id"], F.lit(False), F.lit(True), lambda df: df.select("id", "_batch"), limit, 2, 1, policy=POLICY, faults=FAULTS, **more)


def test_faults_are_retried_and_skipped(spark, tmp_path):
    items = faulty(spark, [NONE, SLOW, TORN, BUSY, DEAD, NONE, ("read", "TIMEOUT", 1)])
    found = {r["id"]: (r["_skip"], r["_retries"], r["_rolled"], r["_end"]) for r in resolve(items, FAULTS, POLICY).collect()}
    assert found == {0: (None, 0, 0, None), 1: (None, 2, 2, None), 2: ("process", 0, 0, None), 3: ("write", 2, 3, None), 4: (None, 1, 1, None), 5: (None, 0, 0, None), 6: (None, 1, 1, None)}
    status, c = fault_step(2).run(spark, items, str(tmp_path / "a"))
    assert status == "COMPLETED" and (c.read, c.written, c.process_skips, c.write_skips, c.rolled_back_chunks, c.rollback_count, c.no_rollback_count, c.commits) == (7, 5, 1, 1, 7, 6, 1, 4)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "a/data")).collect()) == [0, 1, 4, 5, 6]
    assert resolve(spark.range(0).select("id", F.lit("x").alias("phase"), F.lit("x").alias("category"), F.lit(1).alias("lasts")), FAULTS, POLICY).withColumn("bad", F.lit(False)).agg(*fault_counters()).count() == 1


def test_skips_of_all_phases_share_a_limit_and_a_fault_ends_the_step(spark, tmp_path):
    items = faulty(spark, [NONE, TORN, NONE, BUSY, NONE])
    with pytest.raises(StepFailed, match="more than 1 skips"):
        fault_step(1).run(spark, items, str(tmp_path / "a"))
    assert [r["batch"] for r in Ledger(spark, str(tmp_path / "a/ledger")).records()] == [0]
    with pytest.raises(StepFailed, match="chunk 1 failed"):
        fault_step(9).run(spark, faulty(spark, [NONE, NONE, STUCK, NONE]), str(tmp_path / "b"))
    # The fault is gone: the next attempt goes on behind what was committed.
    status, c = fault_step(9).run(spark, faulty(spark, [NONE] * 4), str(tmp_path / "b"))
    assert (status, c.read, c.commits) == ("COMPLETED", 4, 2) and spark.read.parquet(str(tmp_path / "b/data")).count() == 4
    for category, status in (("CANCELLED", "STOPPED"), ("UNKNOWN_COMMIT", "UNKNOWN")):
        assert fault_step(9).run(spark, faulty(spark, [NONE, NONE, ("write", category, 1)]), str(tmp_path / category))[0] == status
    for bad in (dict(rules=(("read", "A", "SKIP"), ("read", "A", "FAIL"))), dict(rules=(("no", "A", "SKIP"),)), dict(safe=frozenset({("write", "A")})), dict(retry_limit=99)):
        with pytest.raises(ValueError):
            FaultPolicy(**bad)


def test_stops_and_hooks_around_a_commit(spark, tmp_path):
    items, told = faulty(spark, [NONE] * 8), []
    asked = iter([False, False, True])
    pair = (lambda b: told.append(f"+{b}")), (lambda b: told.append(f"-{b}"))
    status, c = fault_step(0, listeners={"chunk": Listeners(pair)}, in_flight="ROLLBACK").run(spark, items, str(tmp_path / "a"), stop=lambda: next(asked))
    assert (status, c.commits, told) == ("STOPPED", 1, ["+0", "-0"])
    status, c = fault_step(0, completed=lambda record: record["batch"] == 2).run(spark, items, str(tmp_path / "a"))
    assert (status, c.commits) == ("STOPPED", 3)
    status, c = fault_step(0, wave=1).run(spark, items, str(tmp_path / "a"))
    assert (status, c.commits) == ("COMPLETED", 4) and spark.read.parquet(str(tmp_path / "a/data")).count() == 8


def test_a_wave_reads_its_own_items_and_is_dealt_over_all_cores(spark, tmp_path):
    """Not the whole table again for each wave, in the one or two tasks that its neighbouring items came from."""
    files, path = [], str(tmp_path / "a")

    def process(df):
        files.append({name.split("_wave=")[-1].split("/")[0] for name in df.inputFiles()})
        return df.withColumn("task", F.spark_partition_id())

    step = ChunkStep("import", ["id"], F.lit(False), F.lit(True), process, size=3, per_commit=1, wave=40)
    assert step.run(spark, spark.range(300), path)[1].commits == 100
    assert files == [{"0"}, {"1"}, {"2"}]
    out = spark.read.parquet(f"{path}/data")
    tasks = {r["w"]: r["n"] for r in out.groupBy(F.expr("batch div 40").alias("w")).agg(F.count_distinct("task").alias("n")).collect()}
    assert tasks == {w: spark.sparkContext.defaultParallelism for w in range(3)}
    assert all(r["ids"] == [3 * r["batch"] + k for k in range(3)] for r in out.groupBy("batch").agg(F.collect_list("id").alias("ids")).collect())
    assert sorted(n.name for n in (tmp_path / "a").iterdir()) == ["data", "ledger"] and not list((tmp_path / "a/data").glob(".write-*"))


@pytest.mark.parametrize("plain", [True, False])
def test_data_is_written_whole_by_either_writer(spark, tmp_path, plain):
    """Columns of simple types go through workers' files, all others through Spark's writer."""
    items = spark.range(50).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("ü"), "id")).alias("s"), (F.col("id") / 7).cast("decimal(20,6)").alias("d"), F.lit(b"\0").alias("b"),
                                   F.when(F.col("id") % 2 > 0, F.col("id") / 7).alias("f"), F.col("id").cast("tinyint").alias("t"))
    if not plain:
        items = items.withColumns({"at": F.timestamp_seconds("id"), "l": F.array("id"), "day": F.date_from_unix_date(F.col("id").cast("int"))})
    path = str(tmp_path / "a")
    assert ChunkStep("import", ["id"], F.lit(False), F.lit(True), lambda df: df, size=4, per_commit=1).run(spark, items, path)[0] == "COMPLETED"
    out = spark.read.parquet(f"{path}/data")
    assert out.drop("batch", "chunk_id").dtypes == items.dtypes and out.filter("batch <> chunk_id").count() == 0
    out = out.select(*items.columns)
    assert out.exceptAll(items).count() == 0 == items.exceptAll(out).count()


def test_what_an_attempt_left_is_removed(spark, tmp_path):
    items, path = table(spark, [False] * 9), tmp_path / "job"
    for name in ("waves-0", "data/.write-0", "data/batch=1"):
        (path / name).mkdir(parents=True)
        (path / name / "x").write_text("")
    assert step().run(spark, items, str(path))[0] == "COMPLETED"
    assert sorted(n.name for n in path.iterdir()) == ["data", "ledger"] and not list(path.glob("data/.write-*")) and not (path / "data/batch=1/x").exists()
    assert step().run(spark, items.limit(0), str(tmp_path / "none")) == ("COMPLETED", Counters())


def test_records_written_ahead_are_no_commits(spark, tmp_path):
    ledger, other = Ledger(spark, str(tmp_path)), Ledger(spark, str(tmp_path))
    with pytest.raises(Conflict), ledger.ahead({str(n): {"n": n} for n in range(4)}):
        assert other.records() == []
        ledger.commit("0", {"n": 0})
        ledger.commit("1", {"n": 1, "state": 1})  # another record than the one written ahead
        assert other.records() == [{"n": 0}, {"n": 1, "state": 1}]
        other.commit("2", {"n": 9})
        ledger.commit("2", {"n": 2})
    assert ledger.names(ledger.path) == ["0.json", "1.json", "2.json"] and ledger.records()[2] == {"n": 9}


def test_what_listeners_are_told_leaves_the_driver_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_Told, "MOST", 4)
    told = _Told(spark, str(tmp_path / "told"))
    for batch in range(5):
        for phase in ("before", "after"):
            told.of(phase)(batch)
        assert len(told.codes) < 4
    rows = told.rows().orderBy("n").collect()
    assert [tuple(r) for r in rows] == [(2 * b + k, b, ("before", "after")[k]) for b in range(5) for k in range(2)]
    assert _Told(spark, str(tmp_path / "none")).rows().count() == 0


class Position(ItemStream):
    def __init__(self, name, events, fail=False):
        super().__init__(name, Codec("position", 1))
        self.events, self.fail, self.read = events, fail, 0

    def open(self, state):
        self.events.append(("open", self.name, state))
        self.read = (state or {"read": 0})["read"]

    def update(self, record):
        self.read += record["read"]
        return {"read": self.read}

    def close(self):
        self.events.append(("close", self.name))
        if self.fail:
            raise OSError("close")


def test_streams_are_restored_and_closed_in_reverse(spark, tmp_path):
    items, events = faulty(spark, [NONE] * 4), []

    def lose(batch):
        if batch == 1:
            raise ConnectionError

    with pytest.raises(ConnectionError):  # a failing close does not hide it
        fault_step(0, streams=[Position("a", events), Position("b", events, fail=True)], before_commit=lose).run(spark, items, str(tmp_path / "a"))
    assert events == [("open", "a", None), ("open", "b", None), ("close", "b"), ("close", "a")]
    events.clear()
    with pytest.raises(OSError):
        fault_step(0, streams=[Position("a", events), Position("b", events, fail=True)]).run(spark, items, str(tmp_path / "a"))
    assert events == [("open", "a", {"read": 2}), ("open", "b", {"read": 2}), ("close", "b"), ("close", "a")]
    events.clear()
    fault_step(0, streams=[Position("a", events)]).run(spark, items, str(tmp_path / "a"))
    assert events[0] == ("open", "a", {"read": 4})


def test_stream_commits_each_file_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).coalesce(1).write.parquet(source)
    assert [r["written"] for r in run_stream(spark, source, "id long", path, lambda df: df)] == [10]
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(source)
    assert [r["written"] for r in run_stream(spark, source, "id long", path, lambda df: df)] == [10, 5]
    assert spark.read.parquet(f"{path}/data").count() == 15
