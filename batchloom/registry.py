"""Every query of the engine itself, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from batchloom.functions import digest
from batchloom.operators import aggregates, chunking, fault, processors
from batchloom.plans import flow, ledger, operations
from batchloom.sources import queries as sources
from batchloom.streaming import steps, telemetry

_MODULES = (sources, processors, aggregates, chunking, fault, digest, flow, ledger, operations, telemetry, steps)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in _MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in _MODULES:
        found.update(module.ORACLES)
    return found
