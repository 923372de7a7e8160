"""Canonical binary framing and SHA-256, inside whole-stage code generation."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.session import table

#: Type tags of a parameter in an instance key.
TAGS = {"string": 1, "i64": 2, "u64": 3, "bool": 4}


def text(value: Column | str) -> Column:
    return F.encode(F.lit(value) if isinstance(value, str) else value, "utf-8")


def u32(value: Column) -> Column:
    """Big-endian, four bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))


def u64(value: Column) -> Column:
    """Big-endian, eight bytes; also of a negative number, as two's complement."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def byte(value: int) -> Column:
    return F.unhex(F.lit(f"{value:02x}"))


def framed(value: Column) -> Column:
    """Length as u32, then the bytes."""
    return F.concat(u32(F.octet_length(value)), value)


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def instance_key(job: str, parameters: dict[str, tuple[str, object]]) -> str:
    """Digest of a job name and its identifying parameters, on the driver.

    Version byte 1; the framed job name; then for each parameter, by name: the
    framed name, its type's tag and its value (text framed, numbers in eight
    bytes, a truth value in one).
    """
    frame = lambda b: len(b).to_bytes(4, "big") + b
    out = b"\x01" + frame(job.encode())
    for name, (kind, value) in sorted(parameters.items(), key=lambda p: p[0].encode()):
        body = {"string": lambda v: frame(v.encode()), "i64": lambda v: v.to_bytes(8, "big", signed=True), "u64": lambda v: v.to_bytes(8, "big"), "bool": lambda v: bytes([v])}[kind](value)
        out += frame(name.encode()) + bytes([TAGS[kind]]) + body
    return hashlib.sha256(out).hexdigest()


def manifest(graph: dict) -> str:
    """Digest of a definition, whatever the order its parts were declared in."""
    return hashlib.sha256(json.dumps(graph, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def digest_retry_key(spark, sf):
    key = sha256(text("retry/v1"), text(F.col("o_orderstatus")), framed(text("import")), text("write"), byte(0), u64(F.col("o_custkey")), u32(F.col("o_orderkey") % 1000))
    return table(spark, sf, "orders").select("o_orderkey", key.alias("digest"))


def digest_instance_key(spark, sf):
    key = sha256(byte(1), framed(text(F.col("c_mktsegment"))), framed(text("customer")), byte(TAGS["i64"]), u64(F.col("c_custkey")), framed(text("name")), byte(TAGS["string"]), framed(text(F.col("c_name"))))
    return table(spark, sf, "customer").select("c_custkey", key.alias("digest"))


EDGES = [("load", "COMPLETED", "report"), ("load", "PARTIAL", "report"), ("load", "FAILED", "FAIL"), ("report", "*", "COMPLETE")]


def digest_manifest(spark, sf):
    edges = spark.createDataFrame(EDGES, "source string, pattern string, target string")
    line = F.concat_ws("|", "source", "pattern", "target")
    return edges.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("digest"))


def rec_digest(spark, sf):
    evidence = sha256(framed(text("recovery/v1")), u64(F.col("o_orderkey")), u64(F.col("o_custkey")), framed(text(F.col("o_orderstatus"))), u64(F.unix_micros(F.col("o_orderdate").cast("timestamp"))))
    return table(spark, sf, "orders").select("o_orderkey", evidence.alias("digest"))


def state_checksum(spark, sf):
    """Stored against recomputed checksums; every 13th stored one is corrupt."""
    stored = F.when(F.col("event_id") % 13 == 0, F.sha2(F.lit("corrupt"), 256)).otherwise(F.sha2(F.col("props"), 256))
    return table(spark, sf, "events").select("event_id", (stored == F.sha2(text(F.col("props")), 256)).alias("ok"))


QUERIES = {f.__name__: f for f in (digest_retry_key, digest_instance_key, digest_manifest, rec_digest, state_checksum)}


def _hex(expr: str, width: int) -> str:
    return f"printf('%0{width}x', {expr})"


def _text(expr: str) -> str:
    return f"lower(hex(encode({expr})))"


def _framed(expr: str) -> str:
    return f"{_hex(f'octet_length(encode({expr}))', 8)} || {_text(expr)}"


_SHA = "sha256(unhex({}))"

ORACLES = {
    "digest_retry_key": "SELECT o_orderkey, " + _SHA.format(" || ".join([_text("'retry/v1'"), _text("o_orderstatus"), _framed("'import'"), _text("'write'"), "'00'", _hex("o_custkey", 16), _hex("o_orderkey % 1000", 8)])) + " AS digest FROM orders",
    "digest_instance_key": "SELECT c_custkey, " + _SHA.format(" || ".join(["'01'", _framed("c_mktsegment"), _framed("'customer'"), "'02'", _hex("c_custkey", 16), _framed("'name'"), "'01'", _framed("c_name")])) + " AS digest FROM customer",
    "digest_manifest": "SELECT sha256(string_agg(l, chr(10) ORDER BY l)) AS digest FROM (VALUES " + ", ".join(f"('{'|'.join(e)}')" for e in EDGES) + ") t(l)",
    "rec_digest": "SELECT o_orderkey, " + _SHA.format(" || ".join([_framed("'recovery/v1'"), _hex("o_orderkey", 16), _hex("o_custkey", 16), _framed("o_orderstatus"), _hex("epoch_us(o_orderdate)", 16)])) + " AS digest FROM orders",
    "state_checksum": "SELECT event_id, event_id % 13 <> 0 AS ok FROM events",
}
