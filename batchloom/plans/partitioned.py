"""Partitioned steps, and retries that are counted, bounded and durable."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from batchloom.plans.flow import SEVERITY, PlanError
from batchloom.streaming.steps import Ledger

#: Partitions and workers of a step, bytes of a partition's context, unresolved retry keys.
MAX_PARTITIONS, MAX_WORKERS, MAX_CONTEXT, MAX_KEYS = 1024, 64, 4096, 256


def run_partitioned(spark: SparkSession, path: str, plan: dict[str, dict], work: Callable[[str, dict], dict], workers: int, pool: int, attempt: int = 1) -> dict:
    """Each partition as Spark jobs of its own, ``workers`` at a time; partitions completed by an earlier attempt are kept.

    ``work`` gives ``{"status", "exit", "read", "written"}``. The worst status
    of all, the exit of the first key by its bytes that has it, and sums;
    an unknown outcome blocks the aggregation.
    """
    if not 1 <= len(plan) <= MAX_PARTITIONS or not 1 <= workers <= MAX_WORKERS or workers + 1 > pool:
        raise PlanError("a step has 1 to 1,024 partitions, 1 to 64 workers, and a pool with one more")
    if any(len(json.dumps(c).encode()) > MAX_CONTEXT for c in plan.values()):
        raise PlanError("a partition's context is too large")
    ledger = Ledger(spark, path)
    newest: dict[str, dict] = {}
    for record in ledger.records():
        if record["attempt"] >= newest.get(record["key"], record)["attempt"]:
            newest[record["key"]] = record
    if newest and set(newest) - set(plan):
        raise PlanError("the plan changed between attempts")
    pending = [k for k in sorted(plan, key=str.encode) if newest.get(k, {}).get("status") != "COMPLETED"]

    def run(key: str) -> dict:
        spark.sparkContext.setJobGroup(f"partition-{key}", key, interruptOnCancel=True)
        try:
            result = work(key, plan[key])
        except Exception as e:
            result = {"status": "FAILED", "exit": type(e).__name__, "read": 0, "written": 0}
        record = result | {"key": key, "attempt": attempt}
        ledger.commit(f"{hashlib.sha256(key.encode()).hexdigest()[:24]}-{attempt:06d}", record)
        return record

    with ThreadPoolExecutor(workers) as threads:
        newest |= {r["key"]: r for r in threads.map(run, pending)}
    rows = [newest[k] for k in sorted(plan, key=str.encode)]
    worst = max((r["status"] for r in rows), key=SEVERITY.index)
    if worst == "UNKNOWN":
        return {"status": "UNKNOWN", "exit": None, "ran": len(pending)}
    chosen = next(r for r in rows if r["status"] == worst)
    return {"status": worst, "exit": chosen["exit"], "read": sum(r["read"] for r in rows), "written": sum(r["written"] for r in rows), "ran": len(pending)}


class Retries:
    """Attempts at one place of the input, reserved before they are made, so that a restart goes on counting."""

    def __init__(self, spark: SparkSession, path: str, limit: int, delay: Callable[[int], float] = lambda ordinal: 0.0, sleep: Callable[[float], None] = time.sleep):
        self.ledger, self.limit, self.delay, self.sleep = Ledger(spark, path), limit, delay, sleep

    @staticmethod
    def key(definition: str, step: str, phase: str, checkpoint: bytes, ordinal: int) -> str:
        data = b"retry/v1" + definition.encode() + len(step.encode()).to_bytes(4, "big") + step.encode() + phase.encode() + b"\0" + checkpoint + ordinal.to_bytes(4, "big")
        return hashlib.sha256(data).hexdigest()

    def used(self, key: str) -> int:
        return sum(n.startswith(key) for n in self.ledger.names(self.ledger.path))

    def run(self, key: str, work: Callable, retryable: tuple[type[Exception], ...]):
        """``work`` until it succeeds, fails otherwise, or has been retried ``limit`` times in all."""
        while True:
            try:
                result = work()
            except retryable:
                ordinal = self.used(key) + 1
                if ordinal > self.limit:
                    raise
                if len({n[:64] for n in self.ledger.names(self.ledger.path)} | {key}) > MAX_KEYS:
                    raise PlanError("too many unresolved retries") from None
                self.ledger.commit(f"{key}.{ordinal:06d}", {"key": key, "ordinal": ordinal})
                self.sleep(self.delay(ordinal))
                continue
            self.clear(key)
            return result

    def clear(self, key: str) -> None:
        """Forget a place once what lies beyond it is committed."""
        for name in self.ledger.names(self.ledger.path):
            if name.startswith(key):
                self.ledger.delete(f"{self.ledger.path}/{name}")
