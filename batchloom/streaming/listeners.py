"""Listeners around chunks, and shutdown in phases."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Listeners of a family, and bounds of a shutdown deadline in seconds.
MAX_LISTENERS, MIN_DEADLINE, MAX_DEADLINE, DEFAULT_DEADLINE = 32, 1, 3600, 30


class ListenerError(RuntimeError):
    """A listener failed; ``failures`` has all of them."""

    def __init__(self, failures: list[Exception]):
        super().__init__("; ".join(map(str, failures)))
        self.failures = failures


class Listeners:
    """Before-calls in order up to the first failure; after-calls of those entered, in reverse, all of them."""

    def __init__(self, *pairs: tuple[Callable, Callable]):
        if len(pairs) > MAX_LISTENERS:
            raise ValueError("too many listeners")
        self.pairs = pairs

    def around(self, work: Callable, *args):
        entered, failures, result, failed = [], [], None, None
        for before, after in self.pairs:
            try:
                before(*args)
            except Exception as e:
                failures.append(e)
                break
            entered.append(after)
        if not failures:
            try:
                result = work(*args)
            except Exception as e:
                failed = e
        for after in reversed(entered):
            try:
                after(*args)
            except Exception as e:
                failures.append(e)
        if failed is not None:
            raise failed
        if failures:
            raise ListenerError(failures)
        return result


class Shutdown:
    """Stops a process's Spark work: no new work, running queries drained, then what is left is cancelled.

    The first request drains; a second one cancels at once. Hooks run after the
    work has ended, in the order persist, flush, close, and each failure is
    reported without hiding another.
    """

    def __init__(self, spark: SparkSession, deadline: float = DEFAULT_DEADLINE):
        if not MIN_DEADLINE <= deadline <= MAX_DEADLINE:
            raise ValueError("a deadline lies between a second and an hour")
        self.spark, self.deadline = spark, deadline
        self.requests = 0
        self.groups: list[tuple[str, threading.Thread]] = []

    def ensure_accepting(self) -> None:
        if self.requests:
            raise RuntimeError("shutting down")

    def spawn(self, group: str, work: Callable[[], None]) -> threading.Thread:
        """Work in a job group of its own."""
        self.ensure_accepting()

        def run():
            self.spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
            work()

        thread = threading.Thread(target=run, daemon=True)
        self.groups.append((group, thread))
        thread.start()
        return thread

    def request(self) -> str:
        self.requests += 1
        return "DRAIN" if self.requests == 1 else "ESCALATED"

    def stop(self, **hooks: Callable[[], None]) -> dict:
        if not self.requests:
            self.request()
        end = time.monotonic() + (0 if self.requests > 1 else self.deadline)
        for query in self.spark.streams.active:
            query.stop()
        cancelled = []
        for group, thread in self.groups:
            thread.join(max(0.0, end - time.monotonic()))
            if thread.is_alive():
                self.spark.sparkContext.cancelJobGroup(group)
                cancelled.append(group)
        for group, thread in self.groups:
            thread.join(MIN_DEADLINE)
        report = {"cancelled": cancelled, "unjoined": [g for g, t in self.groups if t.is_alive()]}
        for name in ("persist", "flush", "close"):
            if name in hooks:
                try:
                    hooks[name]()
                    report[name] = "OK"
                except Exception as e:
                    report[name] = type(e).__name__
        return report
