import json
import os
import threading

import pytest

from batchloom.cli import CONFIRM, CONFLICT, GUARD, NOT_FOUND, SUCCESS, UNKNOWN, USAGE, resolve, run
from batchloom.functions.state import StateError
from batchloom.plans.flow import FlowGraph
from batchloom.plans.store import CAPABILITIES, Conflict, JobLauncher, JobRepository, Rejected, StateStore, TaskletPool
from batchloom.streaming.steps import Ledger

DAY = {"day": ("string", "2024-01-01")}


class Clock:
    now = 1_700_000_000.0

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    return JobRepository(spark, str(tmp_path / "ledger"), Clock(), "here")


def test_attempts_and_eligibility(store):
    first = store.launch("import", DAY)
    with pytest.raises(Rejected, match="EXECUTION_ACTIVE"):
        store.launch("import", DAY)
    failed = store.move(store.move(first, "STARTED"), "FAILED", failure="TIMEOUT")
    second = store.launch("import", DAY)
    assert (failed["version"], second["attempt"]) == (3, 2)
    store.move(store.move(second, "STARTED"), "COMPLETED")
    with pytest.raises(Rejected, match="INSTANCE_COMPLETED"):
        store.launch("import", DAY)
    assert store.launch("import", {"day": ("string", "2024-01-02")})["attempt"] == 1
    assert store.table("execution").groupBy("status").count().count() == 3


def test_outdated_versions_conflict(store):
    first = store.launch("import", DAY)
    store.move(first, "STARTED")
    with pytest.raises(Conflict):
        store.move(first, "STOPPING")
    with pytest.raises(Rejected, match="ILLEGAL"):
        store.move(first | {"status": "COMPLETED"}, "STARTED")


def test_requests_are_idempotent(store):
    started = store.move(store.launch("import", DAY), "STARTED")
    assert store.request("STOP", "1", started["id"])["outcome"] == "APPLIED"
    assert store.request("STOP", "1", started["id"])["outcome"] == "REPLAYED"
    with pytest.raises(Rejected, match="OPERATION_CONFLICT"):
        store.request("STOP", "1", "another")
    assert store.request("ABANDON", "1", started["id"])["result"] == "ILLEGAL_TRANSITION"
    assert store.get("execution", started["id"])["stop_requested"]


def test_a_request_acts_once(store, spark):
    """Two at once, and one whose process dies between acting and recording."""
    started = store.move(store.launch("import", DAY), "STARTED")
    acted, outcomes = [], []

    class Counting(JobRepository):
        def _do_stop(self, target):
            acted.append(target)
            if target == "dies":
                raise KeyboardInterrupt
            return super()._do_stop(target)

    def ask():
        try:
            outcomes.append(Counting(spark, store.root, store.clock, "here").request("STOP", "7", started["id"])["outcome"])
        except Rejected as e:
            outcomes.append(e.code)

    threads = [threading.Thread(target=ask) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert acted == [started["id"]] and outcomes.count("APPLIED") == 1 and set(outcomes) <= {"APPLIED", "REPLAYED", "IN_PROGRESS"}
    dying = Counting(spark, store.root, store.clock, "here")
    with pytest.raises(KeyboardInterrupt):
        dying.request("STOP", "8", "dies")
    with pytest.raises(Rejected, match="IN_PROGRESS"):
        dying.request("STOP", "8", "dies")
    assert acted.count("dies") == 1 and store.settle("STOP", "8", "REJECTED", "NOT_FOUND")["outcome"] == "REJECTED"
    assert store.request("STOP", "8", "dies")["outcome"] == "REPLAYED"


def test_owners_are_claimed(store, spark):
    left = store.move(store.launch("import", DAY), "STARTED")
    there, third = (JobRepository(spark, store.root, store.clock, p) for p in ("there", "third"))
    assert (store.control(left), there.control(left)) == ("GO", "LOST")
    there.claim(left)
    with pytest.raises(Conflict):
        third.claim(left)
    assert (store.control(left), there.control(left)) == ("LOST", "GO")
    store.request("STOP", "1", left["id"])
    assert there.control(left) == "STOP"


def test_a_launch_reads_its_own_instance_only(store, monkeypatch):
    for day in range(12):
        store.move(store.move(store.launch("import", {"day": ("i64", day)}), "STARTED"), "COMPLETED")
    reads, read = [], Ledger.read
    monkeypatch.setattr(Ledger, "read", lambda self, name: reads.append(name) or read(self, name))
    store.launch("import", {"day": ("i64", 99)})
    with pytest.raises(Rejected, match="INSTANCE_COMPLETED"):
        store.launch("import", {"day": ("i64", 3)})
    assert len(reads) <= 2


def test_recovery_needs_idle_strangers(store, spark):
    left = store.move(store.launch("import", DAY), "STARTED")
    other = JobRepository(spark, store.root, store.clock, "there")
    assert other.request("RECOVER", "1", left["id"], expected=2)["result"] == "NOT_RECOVERABLE"
    store.clock.now += 16 * 60
    assert store.request("RECOVER", "2", left["id"], expected=2)["result"] == "NOT_RECOVERABLE"
    assert other.request("RECOVER", "3", left["id"], expected=1)["result"] == "STALE_EVIDENCE"
    assert other.request("RECOVER", "4", left["id"], expected=2)["outcome"] == "APPLIED"
    assert store.get("execution", left["id"])["failure"] == "STALE_RECOVERED"


def test_purge_keeps_held_and_unresolved(store):
    ids = []
    for day in range(4):
        run_ = store.launch("import", {"day": ("i64", day)})
        ids.append(run_["instance_id"])
        store.move(store.move(run_, "STARTED"), "COMPLETED" if day < 3 else "UNKNOWN")
    store.request("HOLD", "1", ids[0], actor="me")
    store.clock.now += 7200
    digest, plan = store.purge_plan("import", 3600)
    assert {r["instance_id"] for r in plan.collect()} == {ids[1], ids[2]}
    with pytest.raises(Rejected, match="STALE_PLAN"):
        store.purge("import", 3600, "other")
    assert store.purge("import", 3600, digest) == 2
    assert {r["id"] for r in store.rows("instance")} == {ids[0], ids[3]}


def test_flow_reuses_completed_steps(store):
    plan = FlowGraph("load", ["load", "report"]).sequence("load", "report").sequence("report", "COMPLETE").compile()
    ran, outcomes = [], {"report": "FAILED"}
    steps = {n: (lambda n=n: ran.append(n) or outcomes.get(n, "COMPLETED")) for n in ("load", "report")}
    launcher = JobLauncher(store)
    end, failed = launcher.run_flow("import", DAY, plan, steps)
    assert (end, failed["status"]) == ("FAIL", "FAILED")
    outcomes.clear()
    end, done = launcher.run_flow("import", DAY, plan, steps)
    assert (end, done["status"], ran) == ("COMPLETE", "COMPLETED", ["load", "report", "report"])
    assert [d["step_status"] for d in store.rows("decision")] == ["COMPLETED", "FAILED", "REUSED", "COMPLETED"]


def test_start_limit_counts_all_attempts(store):
    plan = FlowGraph("load", ["load"]).sequence("load", "COMPLETE").compile()
    launcher = JobLauncher(store)
    for _ in range(2):
        launcher.run_flow("import", DAY, plan, {"load": lambda: "FAILED"})
    _, third = launcher.run_flow("import", DAY, plan, {"load": lambda: "COMPLETED"}, start_limit={"load": 2})
    assert third["failure"] == "START_LIMIT"


def test_tasklets(store):
    launcher = JobLauncher(store)
    assert launcher.run("a", DAY, lambda stop: "PARTIAL")["exit"] == "PARTIAL"
    assert launcher.run("b", DAY, lambda stop: "UNKNOWN")["status"] == "UNKNOWN"
    assert launcher.run("c", DAY, lambda stop: 1 / 0)["failure"] == "ZeroDivisionError"


def test_commands(store, spark):
    root = ["--root", store.root]
    started = store.move(store.launch("import", DAY), "STARTED")
    assert run(["job", "list", *root], spark)[1]["data"]["rows"] == ["import"]
    code, out = run(["execution", "list", *root, "--page-size", "1"], spark)
    assert code == SUCCESS and run(["execution", "list", *root, "--page-size", "1", "--cursor", out["data"]["next"]], spark)[1]["data"]["rows"] == []
    assert run(["execution", "list", *root, "--page-size", "2", "--cursor", out["data"]["next"]], spark)[0] == USAGE
    assert run(["execution", "show", *root, "--execution", "none"], spark)[0] == NOT_FOUND
    assert run(["execution", "abandon", *root, "--execution", started["id"]], spark)[0] == CONFIRM
    assert run(["execution", "abandon", *root, "--execution", started["id"], "--confirm"], spark)[0] == GUARD
    assert run(["execution", "stop", *root, "--execution", started["id"], "--operation-id", "x"], spark)[0] == SUCCESS
    assert run(["no", "such"], spark)[0] == USAGE and run(["job", "list", "--dry-run"], spark)[0] == USAGE and CONFLICT == 5
    assert set(run(["diagnostics", "bundle", *root], spark)[1]["data"]) == {"instance", "execution", "decision", "request"}


def test_precedence():
    found = resolve({"root": "a"}, {"BATCHLOOM_ROOT": "b", "BATCHLOOM_PAGE_SIZE": "7"}, {"root": "c"})
    assert found == {"root": ("a", "option"), "page_size": ("7", "env")}
    assert resolve({}, {}, {})["page_size"] == ("100", "default")


JOBS = {"import": lambda launcher, parameters: launcher.run("import", parameters, lambda stop: FAILING.pop() if FAILING else "COMPLETED"),
        "flow": lambda launcher, parameters: launcher.run_flow("flow", parameters, FlowGraph("load", ["load"]).sequence("load", "COMPLETE").compile(), {"load": lambda: "COMPLETED"})}
FAILING: list[str] = []


def test_launch_and_restart_by_command(store, spark, monkeypatch):
    monkeypatch.syspath_prepend(os.path.dirname(__file__))
    root = ["--root", store.root, "--jobs", "test_store:JOBS"]
    import test_store as here

    here.FAILING.append("STOPPED")
    day = ["--job", "import", "--param", "day=string:2024-01-01", "--param", "n=i64:7", "--param", "full=bool:true"]
    assert run(["launch", *root, *day, "--dry-run"], spark)[1]["data"]["attempts"] == 0
    code, out = run(["launch", *root, *day], spark)
    assert (code, out["data"]["status"]) == (SUCCESS, "STOPPED")
    code, out = run(["execution", "restart", *root, "--execution", out["data"]["id"]], spark)
    assert (code, out["data"]["status"], out["data"]["attempt"]) == (SUCCESS, "COMPLETED", 2)
    assert run(["execution", "restart", *root, "--execution", out["data"]["id"]], spark) == (GUARD, {"error": "INSTANCE_COMPLETED"})
    here.FAILING.append("UNKNOWN")
    assert run(["launch", *root, "--job", "import", "--param", "day=string:x"], spark)[0] == UNKNOWN
    assert run(["launch", *root, "--job", "flow"], spark)[1]["data"]["status"] == "COMPLETED"
    assert run(["launch", *root, "--job", "none"], spark)[0] == NOT_FOUND
    for bad in (["--param", "day"], ["--param", "n=i64:x"], ["--param", "f=bool:yes"], ["--param", "a=other:1"]):
        assert run(["launch", *root, "--job", "import", *bad], spark)[0] == USAGE
    assert run(["launch", "--root", store.root, "--job", "import"], spark)[0] == USAGE
    for words in (["diagnostics", "bundle"], ["instance", "list"]):
        shown = json.dumps(run([*words, "--root", store.root], spark)[1])
        assert "2024-01-01" not in shown and "<redacted>" in shown and "i64" in shown


def test_capabilities(store):
    class Plain(JobRepository):
        purge = None

    assert store.missing(frozenset(CAPABILITIES)) == [] and store.missing(frozenset({"teleport"})) == ["teleport"]
    with pytest.raises(Rejected, match="CAPABILITY_MISSING"):
        Plain(store.spark, store.root).require(frozenset({"retention purge"}))


def test_external_states_are_checked(store, spark, tmp_path):
    states = StateStore(spark, str(tmp_path / "states"))
    data = bytes(range(256)) * 9
    reference = states.put(data)
    assert states.put(data) == reference and states.get(reference) == data and len(os.listdir(tmp_path / "states")) == 1
    (tmp_path / "states" / reference.sha256).write_bytes(data[:-1])
    with pytest.raises(StateError, match="not the one"):
        states.get(reference)
    with pytest.raises(StateError, match="gone"):
        states.get(StateStore(spark, str(tmp_path / "other")).put(b"x"))


def test_blocking_tasklets_are_bounded():
    pool, go = TaskletPool(2), threading.Event()
    running = [pool.submit(go.wait) for _ in range(2)]
    with pytest.raises(Rejected, match="TASKLET_CAPACITY"):
        pool.submit(go.wait)
    go.set()
    assert all(r.result() for r in running)
    assert pool.submit(lambda: 3).result() == 3
    pool.close()
