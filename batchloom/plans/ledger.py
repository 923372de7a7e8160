"""The execution ledger as tables, its pages, and the rules that guard it."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.operators.ordering import running_totals
from batchloom.session import table

#: Statuses of an execution, and what follows from them.
ACTIVE = ("STARTING", "STARTED", "STOPPING")
UNRESOLVED = (*ACTIVE, "UNKNOWN")
FINISHED = ("STOPPED", "FAILED", "COMPLETED", "ABANDONED")
LEGAL = {
    "STARTING": ("STARTED", "STOPPING", "FAILED", "UNKNOWN"),
    "STARTED": ("STOPPING", "STOPPED", "FAILED", "COMPLETED", "UNKNOWN"),
    "STOPPING": ("STOPPED", "FAILED", "UNKNOWN"),
    "STOPPED": ("ABANDONED",), "FAILED": ("ABANDONED",), "UNKNOWN": ("ABANDONED", "FAILED"),
}
MAX_PAGE_ROWS, MAX_PAGE_BYTES = 500, 256 * 1024

_STATUS = """CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 8 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'STOPPED' WHEN 2 THEN 'ABANDONED' ELSE 'COMPLETED' END
    WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 8 WHEN 0 THEN 'STARTING' WHEN 1 THEN 'STARTED' WHEN 2 THEN 'STOPPING' WHEN 3 THEN 'UNKNOWN' ELSE 'COMPLETED' END ELSE 'UNKNOWN' END"""
_PART_STATUS = "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'UNKNOWN' WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_linestatus = 'O' AND l_returnflag = 'N' AND l_linenumber % 3 = 0 THEN 'STOPPED' ELSE 'COMPLETED' END"
_PART_KEY = "lpad(CAST(l_partkey AS {s}), 8, '0') || '-' || lpad(CAST(l_suppkey AS {s}), 6, '0') || '-' || CAST(l_linenumber AS {s})"


def instances(spark, sf) -> DataFrame:
    """Customers as job instances; every 17th is held."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("job_name"), (F.col("c_custkey") % 17 == 0).alias("held"))


def executions(spark, sf, of: DataFrame | None = None) -> DataFrame:
    """Orders as attempts of their customer's instance; only those of the instances ``of`` (``instance_id``), where given, are numbered."""
    attempt = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    orders = table(spark, sf, "orders")
    if of is not None:
        orders = orders.join(of.select(F.col("instance_id").alias("o_custkey")), "o_custkey", "left_semi")
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("instance_id"), attempt.alias("attempt"), F.expr(_STATUS).alias("status"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderkey") % 5 + 1).alias("version"))


def partitions(spark, sf) -> DataFrame:
    """Lines as partitions of their order's step."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pid"), F.expr(_PART_KEY.format(s="STRING")).alias("key"), F.expr(_PART_STATUS).alias("status"), F.concat(F.lit("EXIT-"), "l_returnflag", F.col("l_linenumber").cast("string")).alias("exit"),
        F.col("l_quantity").cast("long").alias("read"), (F.col("l_quantity").cast("long") - F.col("l_linenumber") % 2).alias("written"))


# Pages.


def page(df: DataFrame, order: list[Column], after: Column | None, ceiling: Column | None, size: int) -> DataFrame:
    """One keyset page: rows beyond the cursor, at most ``ceiling``, in order. Sorting keeps only ``size`` rows a task."""
    if not 1 <= size <= MAX_PAGE_ROWS:
        raise ValueError("a page has 1 to 500 rows")
    for condition in (after, ceiling):
        if condition is not None:
            df = df.filter(condition)
    return df.orderBy(*order).limit(size)


def seal(rows: DataFrame, order: list[str], size: Column, bound: int = MAX_PAGE_BYTES) -> DataFrame:
    """The rows of a page (already limited) up to ``bound`` encoded bytes, with the running ``cum_bytes``."""
    return running_totals(rows, order, {"cum_bytes": size}).filter(F.col("cum_bytes") <= bound)


def cursor(query: str, filters: dict, size: int, position: list) -> str:
    """An opaque cursor; it only opens for the query, filters and page size it was made for."""
    bound = hashlib.sha256(json.dumps([query, filters, size], sort_keys=True).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps([bound, position]).encode()).decode()


def open_cursor(text: str, query: str, filters: dict, size: int) -> list:
    try:
        bound, position = json.loads(base64.urlsafe_b64decode(text.encode()))
    except Exception as e:
        raise ValueError("no cursor") from e
    if bound != hashlib.sha256(json.dumps([query, filters, size], sort_keys=True).encode()).hexdigest()[:16]:
        raise ValueError("the cursor is for another query")
    return position


def exp_job_names(spark, sf):
    return page(instances(spark, sf).select("job_name").distinct(), [F.asc("job_name")], F.col("job_name") > "AUTOMOBILE", None, 3)


def exp_instances_page(spark, sf):
    return page(instances(spark, sf).select("id", "job_name"), [F.desc("id")], F.col("id") < 1200, F.col("id") <= 1400, 50)


def exp_executions_page(spark, sf):
    building = instances(spark, sf).filter("job_name = 'BUILDING'").select(F.col("id").alias("instance_id"))
    return page(executions(spark, sf, building).select("id", "instance_id", "attempt", "status"), [F.desc("attempt"), F.desc("id")], F.expr("struct(attempt, id) < struct(9L, 9000L)"), F.col("id") <= 14000, 40)


def exp_execution(spark, sf):
    mine = table(spark, sf, "orders").filter("o_orderkey = 77").select(F.col("o_custkey").alias("instance_id"))
    joined = executions(spark, sf, mine).filter("id = 77").join(instances(spark, sf).select(F.col("id").alias("instance_id"), "job_name"), "instance_id")
    return joined.select("id", "job_name", "attempt", "status", "version")


def exp_steps_page(spark, sf):
    steps = partitions(spark, sf).select("pid", "key", "status")
    return page(steps, [F.asc("pid"), F.asc("key")], F.expr("struct(pid, key) > struct(200L, '')"), None, 60)


CLOCK = "1998-06-01 00:00:00"


def exp_unresolved(spark, sf):
    stale = F.col("updated_at") < F.expr(f"CAST('{CLOCK}' AS TIMESTAMP_NTZ) - INTERVAL 30 DAYS")
    rows = executions(spark, sf).filter(F.col("status").isin(*UNRESOLVED) & stale).select("id", "status")
    return page(rows, [F.asc("id")], F.col("id") > 500, None, 100)


def exp_recovery(spark, sf):
    recovered = executions(spark, sf).filter("status = 'ABANDONED'").select("id", "version")
    return page(recovered, [F.asc("id"), F.asc("version")], F.expr("struct(id, version) > struct(1000L, 2L)"), None, 50)


def exp_flow_decisions(spark, sf):
    decisions = table(spark, sf, "events").filter("user_id = 3").select(F.col("event_id").alias("id"), F.expr("event_id div 10").alias("sequence"), F.col("event_type").alias("node"))
    return page(decisions, [F.asc("sequence"), F.asc("id")], F.expr("struct(sequence, id) > struct(100L, 1003L)"), None, 50)


def exp_partitions(spark, sf):
    return page(partitions(spark, sf).filter("pid = 40 OR pid = 41").select("pid", "key", "status"), [F.asc("pid"), F.asc("key")], None, None, 100)


def exp_operator_requests(spark, sf):
    requests = table(spark, sf, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("target"))
    return page(requests, [F.desc("id")], F.col("id") < 8000, None, 50)


def exp_page_bytes(spark, sf):
    first = page(instances(spark, sf).select("id", "job_name"), [F.asc("id")], None, None, 500)
    return seal(first, ["id"], F.octet_length("job_name") + 8, 4096).select("id", "cum_bytes")


def exp_ceiling(spark, sf):
    top = lambda df, name, column: df.agg(F.lit(name).alias("ledger"), F.max(column).alias("ceiling"))
    return top(instances(spark, sf), "job_instance", "id").unionByName(top(executions(spark, sf), "job_execution", "id")).unionByName(top(partitions(spark, sf), "step_partition", "pid"))


# Rules.


def led_select_or_create(spark, sf):
    """Of the wanted keys, those without an instance yet."""
    wanted = spark.range(1400, 1700).select(F.col("id"))
    return wanted.join(instances(spark, sf).select("id"), "id", "left_anti")


def led_next_attempt(spark, sf):
    latest = executions(spark, sf).groupBy("instance_id").agg(F.max("attempt").alias("latest"))
    return instances(spark, sf).select(F.col("id").alias("instance_id")).join(latest, "instance_id", "left").select("instance_id", (F.coalesce("latest", F.lit(0)) + 1).cast("long").alias("next_attempt"))


def eligibility(status: Column) -> Column:
    return (F.when(status.isin("STOPPED", "FAILED"), "LAUNCH").when(status == "COMPLETED", "REJECT_COMPLETED").when(status == "ABANDONED", "REJECT_ABANDONED").otherwise("REJECT_ACTIVE"))


def led_launch_eligibility(spark, sf):
    latest = executions(spark, sf).groupBy("instance_id").agg(F.max_by("status", "attempt").alias("status"))
    return latest.select("instance_id", eligibility(F.col("status")).alias("verdict"))


def led_latest_step(spark, sf):
    """The newest attempt's partition rows: for each instance and line number the last order's."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("step"))
    joined = lines.join(executions(spark, sf).select("id", "instance_id", "attempt"), "id")
    return joined.groupBy("instance_id", "step").agg(F.max_by("id", F.struct("attempt", "id")).alias("id"))


def provenance(reused: DataFrame, decisions: DataFrame) -> DataFrame:
    """``reused`` decisions that an earlier one of their instance stands behind.

    It has the same node, outcome, target and terminal kind and the same input
    digest, null like null. Only the first of such decisions matters, so each
    key comes down to one row before it is compared.
    """
    keys = ["instance_id", "node", "outcome", "target", "terminal", "digest"]
    first = decisions.groupBy(*[F.col(k).alias(f"s_{k}") for k in keys]).agg(F.min("seq").alias("s_seq"))
    same = F.col("seq") > F.col("s_seq")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    return reused.join(first, same, "left_semi")


def led_decision_provenance(spark, sf):
    """Views as reused decisions, purchases as those made; a user is an instance, and the id tells the rest."""
    at = F.col("event_id")
    made = table(spark, sf, "events").select(at.alias("seq"), F.col("user_id").alias("instance_id"), "event_type", (at % 2).alias("outcome"), (at % 3).alias("target"), F.when(at % 3 == 0, "COMPLETE").alias("terminal"), F.when(at % 4 != 0, at % 6).alias("digest"))
    made = made.withColumn("node", F.lit("load"))
    found = provenance(made.filter("event_type = 'view'"), made.filter("event_type = 'purchase'"))
    return found.select(F.col("seq").alias("event_id"), F.col("instance_id").alias("user_id"))


def led_invariant_unresolved(spark, sf):
    open_ = executions(spark, sf).filter(F.col("status").isin(*UNRESOLVED))
    return open_.groupBy("instance_id").agg(F.count("*").alias("unresolved")).filter("unresolved > 1")


def led_cas_conflicts(spark, sf):
    """Proposed updates whose expected version is not the stored one."""
    proposed = executions(spark, sf).select("id", (F.col("id") % 3 + 1).alias("expected"))
    return proposed.join(executions(spark, sf).select("id", F.col("version").alias("stored")), "id").filter("expected <> stored")


# State and restart.


def latest(df: DataFrame, keys: list[str], version: str, *columns: str) -> DataFrame:
    """The newest version's row per key, by an aggregate that combines before the shuffle."""
    best = F.max_by(F.struct(version, *columns), F.col(version)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*")


def state_latest(spark, sf):
    envelopes = table(spark, sf, "events").select(F.col("user_id").alias("step"), F.col("event_type").alias("namespace"), F.col("event_id").alias("version"), F.col("props").alias("payload"))
    return latest(envelopes, ["step", "namespace"], "version", "payload")


UPGRADES = [(1, 2), (2, 4), (4, 5), (3, 5), (6, 7)]


def upgrade_chain(edges: dict[int, int], start: int, current: int) -> int | None:
    """Hops from a recorded version to the current one along the single edge out of each; None if there is no way."""
    hops, at = 0, start
    while at != current:
        if at not in edges or hops >= 64:
            return None
        at, hops = edges[at], hops + 1
        if at > current:
            return None
    return hops


def state_upgrade_chain(spark, sf):
    edges = dict(UPGRADES)
    found = [(v, 5, hops) for v in range(1, 8) if (hops := upgrade_chain(edges, v, 5)) is not None]
    return spark.createDataFrame(found, "start long, end long, hops long")


def restart_inherit(spark, sf):
    """What the next attempt starts from: counters of the last committed chunk of each failed or stopped execution."""
    chunks = partitions(spark, sf).filter("status = 'COMPLETED'")
    done = chunks.groupBy(F.col("pid").alias("id")).agg(F.max_by(F.struct("read", "written"), "key").alias("last"))
    ended = executions(spark, sf).filter("status IN ('FAILED', 'STOPPED')")
    return ended.join(done, "id").select("instance_id", "attempt", "last.read", "last.written")


# Partitions.


def severity(status: Column) -> Column:
    return F.when(status == "UNKNOWN", 3).when(status == "FAILED", 2).when(status == "STOPPED", 1).otherwise(0)


def aggregate_partitions(parts: DataFrame, by: str, order: str) -> DataFrame:
    """Per parent the worst status, the exit of the first partition in ``order`` that has it, and sums.

    The least of (severity descending, key) picks both at once, so the parents'
    partitions are combined before the shuffle.
    """
    worst = F.min(F.struct((-severity(F.col("status"))).alias("s"), F.col(order).alias("k"), "status", "exit")).alias("w")
    return parts.groupBy(by).agg(worst, F.sum("read").alias("total_read"), F.sum("written").alias("total_written"), F.count("*").alias("parts")).select(
        by, F.col("w.status").alias("status"), F.col("w.k").alias("sel_key"), F.col("w.exit").alias("exit"), "total_read", "total_written", "parts")


def part_aggregate(spark, sf):
    return aggregate_partitions(partitions(spark, sf), "pid", "key")


def split_aggregate(spark, sf):
    branches = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(severity(F.expr(_PART_STATUS))).alias("s"), F.sum(F.col("l_quantity").cast("long")).alias("read"))
    status = F.element_at(F.array(*map(F.lit, ("COMPLETED", "STOPPED", "FAILED", "UNKNOWN"))), F.col("s") + 1)
    rows = branches.select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("branch"), status.alias("status"), F.concat(F.lit("B"), F.col("l_linenumber").cast("string")).alias("exit"), "read", F.col("read").alias("written"))
    return aggregate_partitions(rows, "pid", "branch").select("pid", "status", F.col("sel_key").alias("branch"), "exit", "total_read")


def part_pending_on_restart(spark, sf):
    return partitions(spark, sf).filter("status <> 'COMPLETED'").select("pid", "key")


def part_restart_guard(spark, sf):
    """One source and one target execution, each a single row, side by side."""
    one = lambda i, name: executions(spark, sf).filter(F.col("id") == i).select(F.col("id").alias(f"{name}_id"), F.col("status").alias(f"{name}_status"), F.col("status").isin(*UNRESOLVED).alias(f"{name}_open"))
    return one(8, "source").crossJoin(F.broadcast(one(17, "target")))


def life_illegal(spark, sf):
    """Consecutive statuses of an instance that no legal transition joins."""
    before = F.lag("status").over(Window.partitionBy("instance_id").orderBy("attempt"))
    pairs = executions(spark, sf).withColumn("from_status", before).filter("from_status is not null")
    legal = spark.createDataFrame([(a, b) for a, to in LEGAL.items() for b in to], "from_status string, status string")
    return pairs.join(F.broadcast(legal), ["from_status", "status"], "left_anti").select("id", "from_status", F.col("status").alias("to_status"))


_FUNCTIONS = (exp_job_names, exp_instances_page, exp_executions_page, exp_execution, exp_steps_page, exp_unresolved, exp_recovery, exp_flow_decisions, exp_partitions, exp_operator_requests, exp_page_bytes, exp_ceiling,
              led_select_or_create, led_next_attempt, led_launch_eligibility, led_latest_step, led_decision_provenance, led_invariant_unresolved, led_cas_conflicts,
              state_latest, state_upgrade_chain, restart_inherit, part_aggregate, split_aggregate, part_pending_on_restart, part_restart_guard, life_illegal)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

SQL_I = "(SELECT c_custkey AS id, c_mktsegment AS job_name, c_custkey % 17 = 0 AS held FROM customer)"
SQL_E = f"(SELECT o_orderkey AS id, o_custkey AS instance_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS attempt, {_STATUS} AS status, o_orderdate AS updated_at, o_orderkey % 5 + 1 AS version FROM orders)"
SQL_P = f"""(SELECT l_orderkey AS pid, {_PART_KEY.format(s='VARCHAR')} AS key, {_PART_STATUS} AS status, 'EXIT-' || l_returnflag || CAST(l_linenumber AS VARCHAR) AS exit,
    CAST(l_quantity AS BIGINT) AS read, CAST(l_quantity AS BIGINT) - l_linenumber % 2 AS written FROM lineitem)"""
_OPEN = "('STARTING', 'STARTED', 'STOPPING', 'UNKNOWN')"
_SEV = "CASE status WHEN 'UNKNOWN' THEN 3 WHEN 'FAILED' THEN 2 WHEN 'STOPPED' THEN 1 ELSE 0 END"
ORACLES = {
    "exp_job_names": f"SELECT DISTINCT job_name FROM {SQL_I} WHERE job_name > 'AUTOMOBILE' ORDER BY job_name LIMIT 3",
    "exp_instances_page": f"SELECT id, job_name FROM {SQL_I} WHERE id < 1200 AND id <= 1400 ORDER BY id DESC LIMIT 50",
    "exp_executions_page": f"SELECT e.id, instance_id, attempt, status FROM {SQL_E} e JOIN {SQL_I} i ON i.id = instance_id WHERE job_name = 'BUILDING' AND (attempt, e.id) < (9, 9000) AND e.id <= 14000 ORDER BY attempt DESC, e.id DESC LIMIT 40",
    "exp_execution": f"SELECT e.id, job_name, attempt, status, version FROM {SQL_E} e JOIN {SQL_I} i ON i.id = instance_id WHERE e.id = 77",
    "exp_steps_page": f"SELECT pid, key, status FROM {SQL_P} WHERE (pid, key) > (200, '') ORDER BY pid, key LIMIT 60",
    "exp_unresolved": f"SELECT id, status FROM {SQL_E} WHERE status IN {_OPEN} AND updated_at < TIMESTAMP '{CLOCK}' - INTERVAL 30 DAYS AND id > 500 ORDER BY id LIMIT 100",
    "exp_recovery": f"SELECT id, version FROM {SQL_E} WHERE status = 'ABANDONED' AND (id, version) > (1000, 2) ORDER BY id, version LIMIT 50",
    "exp_flow_decisions": "SELECT event_id AS id, event_id // 10 AS sequence, event_type AS node FROM events WHERE user_id = 3 AND (event_id // 10, event_id) > (100, 1003) ORDER BY 2, 1 LIMIT 50",
    "exp_partitions": f"SELECT pid, key, status FROM {SQL_P} WHERE pid IN (40, 41) ORDER BY pid, key LIMIT 100",
    "exp_operator_requests": "SELECT event_id AS id, user_id AS target FROM events WHERE event_type = 'signup' AND event_id < 8000 ORDER BY id DESC LIMIT 50",
    "exp_page_bytes": f"SELECT id, cum_bytes FROM (SELECT id, CAST(sum(octet_length(encode(job_name)) + 8) OVER (ORDER BY id) AS BIGINT) AS cum_bytes FROM (SELECT * FROM {SQL_I} ORDER BY id LIMIT 500)) WHERE cum_bytes <= 4096",
    "exp_ceiling": "SELECT 'job_instance' AS ledger, max(c_custkey) AS ceiling FROM customer UNION ALL SELECT 'job_execution', max(o_orderkey) FROM orders UNION ALL SELECT 'step_partition', max(l_orderkey) FROM lineitem",
    "led_select_or_create": "SELECT id FROM range(1400, 1700) r(id) WHERE id NOT IN (SELECT c_custkey FROM customer)",
    "led_next_attempt": "SELECT c_custkey AS instance_id, CAST(coalesce(n, 0) + 1 AS BIGINT) AS next_attempt FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "led_launch_eligibility": f"SELECT instance_id, CASE WHEN s IN ('STOPPED', 'FAILED') THEN 'LAUNCH' WHEN s = 'COMPLETED' THEN 'REJECT_COMPLETED' WHEN s = 'ABANDONED' THEN 'REJECT_ABANDONED' ELSE 'REJECT_ACTIVE' END AS verdict FROM (SELECT instance_id, arg_max(status, attempt) AS s FROM {SQL_E} GROUP BY 1)",
    "led_latest_step": f"SELECT instance_id, step, id FROM (SELECT instance_id, l_linenumber AS step, e.id, row_number() OVER (PARTITION BY instance_id, l_linenumber ORDER BY attempt DESC, e.id DESC) AS r FROM lineitem JOIN {SQL_E} e ON e.id = l_orderkey) WHERE r = 1",
    "led_decision_provenance": """WITH d AS (SELECT event_id, user_id, event_type, event_id % 2 AS outcome, event_id % 3 AS target, CASE WHEN event_id % 3 = 0 THEN 'COMPLETE' END AS terminal,
        CASE WHEN event_id % 4 <> 0 THEN event_id % 6 END AS digest FROM events)
        SELECT event_id, user_id FROM d WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM d s WHERE s.event_type = 'purchase' AND s.event_id < d.event_id AND s.user_id = d.user_id AND s.outcome = d.outcome
        AND s.target = d.target AND s.terminal IS NOT DISTINCT FROM d.terminal AND s.digest IS NOT DISTINCT FROM d.digest)""",
    "led_invariant_unresolved": f"SELECT instance_id, count(*) AS unresolved FROM {SQL_E} WHERE status IN {_OPEN} GROUP BY 1 HAVING count(*) > 1",
    "led_cas_conflicts": f"SELECT id, id % 3 + 1 AS expected, version AS stored FROM {SQL_E} WHERE id % 3 + 1 <> version",
    "state_latest": "SELECT user_id AS step, event_type AS namespace, max(event_id) AS version, arg_max(props, event_id) AS payload FROM events GROUP BY 1, 2",
    "state_upgrade_chain": """WITH RECURSIVE e(a, b) AS (VALUES (1, 2), (2, 4), (4, 5), (3, 5), (6, 7)), w(s, p, hops) AS (SELECT v, v, 0 FROM range(1, 8) r(v) UNION ALL SELECT s, b, hops + 1 FROM w JOIN e ON a = p)
        SELECT CAST(s AS BIGINT) AS start, CAST(5 AS BIGINT) AS "end", CAST(hops AS BIGINT) AS hops FROM w WHERE p = 5""",
    "restart_inherit": f"SELECT instance_id, attempt, read, written FROM {SQL_E} e JOIN (SELECT pid, arg_max(read, key) AS read, arg_max(written, key) AS written FROM {SQL_P} WHERE status = 'COMPLETED' GROUP BY 1) ON pid = e.id WHERE status IN ('FAILED', 'STOPPED')",
    "part_aggregate": f"""SELECT pid, status, key AS sel_key, exit, total_read, total_written, parts FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY {_SEV} DESC, key, status, exit) AS r, CAST(sum(read) OVER (PARTITION BY pid) AS BIGINT) AS total_read,
        CAST(sum(written) OVER (PARTITION BY pid) AS BIGINT) AS total_written, count(*) OVER (PARTITION BY pid) AS parts FROM {SQL_P}) WHERE r = 1""",
    "split_aggregate": f"""WITH b AS (SELECT l_orderkey AS pid, l_linenumber AS branch, max({_SEV.replace('status', '(' + _PART_STATUS + ')')}) AS s, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS read FROM lineitem GROUP BY 1, 2)
        SELECT pid, (['COMPLETED', 'STOPPED', 'FAILED', 'UNKNOWN'])[s + 1] AS status, branch, 'B' || CAST(branch AS VARCHAR) AS exit, total_read FROM (
        SELECT *, row_number() OVER (PARTITION BY pid ORDER BY s DESC, branch) AS r, CAST(sum(read) OVER (PARTITION BY pid) AS BIGINT) AS total_read FROM b) WHERE r = 1""",
    "part_pending_on_restart": f"SELECT pid, key FROM {SQL_P} WHERE status <> 'COMPLETED'",
    "part_restart_guard": f"""SELECT s.id AS source_id, s.status AS source_status, s.status IN {_OPEN} AS source_open, t.id AS target_id, t.status AS target_status, t.status IN {_OPEN} AS target_open
        FROM {SQL_E} s CROSS JOIN {SQL_E} t WHERE s.id = 8 AND t.id = 17""",
    "life_illegal": f"""SELECT id, f AS from_status, status AS to_status FROM (SELECT id, status, lag(status) OVER (PARTITION BY instance_id ORDER BY attempt) AS f FROM {SQL_E})
        WHERE f IS NOT NULL AND (f, status) NOT IN (""" + ", ".join(f"('{a}', '{b}')" for a, to in LEGAL.items() for b in to) + ")",
}
