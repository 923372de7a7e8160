"""Recovery, retention, operator requests and the command surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.plans.ledger import _OPEN, CLOCK, SQL_E, SQL_I, SQL_P, UNRESOLVED, executions, instances, partitions
from batchloom.plans.store import CAPABILITIES, JobLauncher, JobRepository
from batchloom.session import folder, table

#: Bounds of recovery and retention.
RECOVERY_MINUTES, MIN_PURGE_AGE_HOURS, MAX_PURGE_BATCH = 15, 1, 1000

#: Command, class, dry run, paginated.
COMMANDS = [
    ("job list", "READ", False, True), ("job show", "READ", False, False), ("instance list", "READ", False, True), ("instance show", "READ", False, False),
    ("execution list", "READ", False, True), ("execution show", "READ", False, False), ("execution steps", "READ", False, True), ("execution partitions", "READ", False, True),
    ("execution history", "READ", False, True), ("execution stop", "LIFECYCLE", False, False), ("execution restart", "LIFECYCLE", True, False),
    ("execution abandon", "DESTRUCTIVE", False, False), ("execution recover", "DESTRUCTIVE", True, False), ("launch", "LIFECYCLE", True, False),
    ("retention plan", "READ", False, False), ("retention apply", "DESTRUCTIVE", True, False), ("retention hold", "DESTRUCTIVE", False, False), ("retention release", "DESTRUCTIVE", False, False),
    ("config show", "READ", False, False), ("schema status", "READ", False, False), ("diagnostics bundle", "READ", False, False),
]

def _now() -> Column:
    return F.expr(f"CAST('{CLOCK}' AS TIMESTAMP_NTZ)")


def snapshot(unresolved: DataFrame, steps: DataFrame) -> DataFrame:
    """Each unresolved execution with its latest step and what speaks for or against recovery."""
    newest = steps.groupBy(F.col("pid").alias("id")).agg(F.max_by("status", "key").alias("step_status"), F.max("key").alias("step_key"), F.max((F.col("status") == "COMPLETED").cast("int")).alias("_done"))
    joined = unresolved.join(newest, "id", "left")
    return joined.select("id", "status", "step_key", "step_status", (F.coalesce("_done", F.lit(0)) == 1).alias("completed_partition"),
                         ((F.col("status") == "UNKNOWN") | F.coalesce(F.col("step_status") == "UNKNOWN", F.lit(False))).alias("unknown_commit"))


def rec_snapshot(spark, sf):
    return snapshot(executions(spark, sf).filter(F.col("status").isin(*UNRESOLVED)), partitions(spark, sf))


def candidates(rows: DataFrame, now: Column, owned: Column, minutes: int = RECOVERY_MINUTES) -> DataFrame:
    """What may be recovered: unknown outcomes, and active executions of others that were idle for longer than ``minutes``."""
    idle = F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes))
    future = F.col("updated_at") > now + F.make_dt_interval(secs=F.lit(5))
    kind = (F.when(F.col("status") == "UNKNOWN", "UNKNOWN_OUTCOME").when(owned, "OWNED").when(future, "CLOCK_SKEW").when(idle, "STALE").otherwise("ACTIVE"))
    return rows.filter(F.col("status").isin(*UNRESOLVED)).select("id", kind.alias("classification"))


def rec_candidates(spark, sf):
    return candidates(executions(spark, sf), _now(), F.col("id") % 10 == 0)


def purge_survey(spark, sf, job: str = "MACHINERY", batch: int = 200) -> DataFrame:
    """Finished executions of a job that are older than the age, not held, and have no unresolved sibling."""
    if not 1 <= batch <= MAX_PURGE_BATCH:
        raise ValueError("a purge takes 1 to 1,000 executions")
    every = executions(spark, sf)
    open_ = every.filter(F.col("status").isin(*UNRESOLVED)).select("instance_id").distinct()
    free = instances(spark, sf).filter((F.col("job_name") == job) & ~F.col("held")).select(F.col("id").alias("instance_id"))
    old = every.filter(F.col("status").isin("COMPLETED", "ABANDONED") & (F.col("updated_at") < _now() - F.expr("INTERVAL 30 DAYS")))
    return old.join(free, "instance_id").join(open_, "instance_id", "left_anti").orderBy("instance_id", "id").limit(batch).select("instance_id", "id", "version")


def ret_survey(spark, sf):
    return purge_survey(spark, sf).select("instance_id", "id")


def ret_apply_remaining(spark, sf):
    """Rows left in each table once the surveyed executions and their children are gone."""
    plan = purge_survey(spark, sf).select("id")
    left = executions(spark, sf).join(plan, "id", "left_anti")
    children = partitions(spark, sf).join(plan.withColumnRenamed("id", "pid"), "pid", "left_anti")
    kept = instances(spark, sf).join(left.select(F.col("instance_id").alias("id")).distinct(), "id", "left_semi")
    n = lambda df, name: df.agg(F.lit(name).alias("ledger"), F.count("*").alias("n"))
    return n(left, "job_execution").unionByName(n(children, "step_partition")).unionByName(n(kept, "job_instance_with_executions"))


def ret_stale_plan(spark, sf):
    """A plan's candidates, and those whose version is still the one planned."""
    plan = purge_survey(spark, sf).withColumn("planned", F.when(F.col("id") % 7 == 0, F.col("version") + 1).otherwise(F.col("version")))
    return plan.agg(F.count("*").alias("candidates"), F.count_if(F.col("planned") == F.col("version")).alias("confirmed"))


def ret_holds(spark, sf):
    return instances(spark, sf).filter("held").select("id")


def retention_counts(spark, sf):
    """Children of the candidates, by table and status."""
    plan = purge_survey(spark, sf).select(F.col("id").alias("pid"))
    return partitions(spark, sf).join(plan, "pid", "left_semi").groupBy("status").agg(F.count("*").alias("n"))


def op_idempotency(spark, sf):
    """Requests by first arrival: the first applies, the same again is a replay, another digest under its id a conflict."""
    requests = table(spark, sf, "events").select("event_id", F.col("event_type").alias("action"), (F.col("event_id") % 500).alias("operation_id"), (F.expr("event_id div 2000") % 2).alias("digest"))
    first = requests.groupBy("action", "operation_id").agg(F.min(F.struct("event_id", "digest")).alias("first"))
    outcome = F.when(F.col("event_id") == F.col("first.event_id"), "APPLIED").when(F.col("digest") == F.col("first.digest"), "REPLAYED").otherwise("CONFLICT")
    return requests.join(first, ["action", "operation_id"]).select("event_id", "action", "operation_id", outcome.alias("outcome"))


def op_command_class(spark, sf):
    rows = [(c, k, k == "DESTRUCTIVE", d, p) for c, k, d, p in COMMANDS]
    return spark.createDataFrame(rows, "command string, class string, confirm boolean, dry_run boolean, paginated boolean")


SETTINGS = [("pool", "16", "8", None, "4"), ("timeout", None, "30", "60", "10"), ("batch", None, None, "200", "100"), ("color", None, None, None, "auto")]


def resolved(settings: DataFrame) -> DataFrame:
    """A value per key: option, then environment, then file, then default, and which it was."""
    source = F.when(F.col("option").isNotNull(), "option").when(F.col("env").isNotNull(), "env").when(F.col("file").isNotNull(), "file").otherwise("default")
    return settings.select("key", F.coalesce("option", "env", "file", "default").alias("value"), source.alias("source"))


def cfg_precedence(spark, sf):
    return resolved(spark.createDataFrame(SETTINGS, "key string, option string, env string, file string, default string"))


def cap_missing(spark, sf):
    """Capabilities that a repository without holds and purging lacks, as it says itself."""

    class Plain(JobRepository):
        _do_hold = _do_release = purge = None

    missing = Plain(spark, folder(spark)).missing(frozenset(CAPABILITIES))
    return spark.createDataFrame([(c,) for c in missing], "capability string")


OUTCOMES = [("Completed", "COMPLETED", "COMPLETED"), ("CompletedWith", "COMPLETED", "PARTIAL"), ("Stopped", "STOPPED", "STOPPED"), ("Unknown", "UNKNOWN", "UNKNOWN"), ("Error", "FAILED", "FAILED")]


def tasklet_status(spark, sf):
    """What a launcher records for each way in which a tasklet can end."""

    def fail(stop):
        raise RuntimeError

    launcher = JobLauncher(JobRepository(spark, folder(spark)))
    works = {"Completed": lambda stop: "COMPLETED", "CompletedWith": lambda stop: "PARTIAL", "Stopped": lambda stop: "STOPPED", "Unknown": lambda stop: "UNKNOWN", "Error": fail}
    ended = [(name, launcher.run(name, {}, work)) for name, work in works.items()]
    return spark.createDataFrame([(name, e["status"], e["exit"]) for name, e in ended], "outcome string, status string, exit string")


_FUNCTIONS = (rec_snapshot, rec_candidates, ret_survey, ret_apply_remaining, ret_stale_plan, ret_holds, retention_counts, op_idempotency, op_command_class, cfg_precedence, cap_missing, tasklet_status)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_NOW = f"TIMESTAMP '{CLOCK}'"
_PLAN = f"""(SELECT instance_id, e.id, version FROM {SQL_E} e JOIN {SQL_I} i ON i.id = instance_id WHERE job_name = 'MACHINERY' AND NOT held AND status IN ('COMPLETED', 'ABANDONED')
    AND updated_at < {_NOW} - INTERVAL 30 DAYS AND NOT EXISTS (SELECT 1 FROM {SQL_E} s WHERE s.instance_id = e.instance_id AND s.status IN {_OPEN}) ORDER BY instance_id, e.id LIMIT 200)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" for v in r) + ")" for r in rows)


ORACLES = {
    "rec_snapshot": f"""SELECT e.id, e.status, step_key, step_status, coalesce(done, false) AS completed_partition, e.status = 'UNKNOWN' OR coalesce(step_status = 'UNKNOWN', false) AS unknown_commit
        FROM {SQL_E} e LEFT JOIN (SELECT pid, max(key) AS step_key, arg_max(status, key) AS step_status, bool_or(status = 'COMPLETED') AS done FROM {SQL_P} GROUP BY 1) ON pid = e.id WHERE e.status IN {_OPEN}""",
    "rec_candidates": f"""SELECT id, CASE WHEN status = 'UNKNOWN' THEN 'UNKNOWN_OUTCOME' WHEN id % 10 = 0 THEN 'OWNED' WHEN updated_at > {_NOW} + INTERVAL 5 SECONDS THEN 'CLOCK_SKEW'
        WHEN updated_at < {_NOW} - INTERVAL 15 MINUTES THEN 'STALE' ELSE 'ACTIVE' END AS classification FROM {SQL_E} WHERE status IN {_OPEN}""",
    "ret_survey": f"SELECT instance_id, id FROM {_PLAN}",
    "ret_apply_remaining": f"""WITH p AS (SELECT id FROM {_PLAN}), l AS (SELECT * FROM {SQL_E} WHERE id NOT IN (SELECT id FROM p))
        SELECT 'job_execution' AS ledger, count(*) AS n FROM l UNION ALL SELECT 'step_partition', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM p)
        UNION ALL SELECT 'job_instance_with_executions', count(*) FROM customer WHERE c_custkey IN (SELECT instance_id FROM l)""",
    "ret_stale_plan": f"SELECT count(*) AS candidates, count(*) FILTER (id % 7 <> 0) AS confirmed FROM {_PLAN}",
    "ret_holds": "SELECT c_custkey AS id FROM customer WHERE c_custkey % 17 = 0",
    "retention_counts": f"SELECT status, count(*) AS n FROM {SQL_P} WHERE pid IN (SELECT id FROM {_PLAN}) GROUP BY 1",
    "op_idempotency": """SELECT event_id, action, operation_id, CASE WHEN r = 1 THEN 'APPLIED' WHEN digest = f THEN 'REPLAYED' ELSE 'CONFLICT' END AS outcome FROM (
        SELECT *, row_number() OVER w AS r, first_value(digest) OVER w AS f FROM (SELECT event_id, event_type AS action, event_id % 500 AS operation_id, event_id // 2000 % 2 AS digest FROM events) WINDOW w AS (PARTITION BY action, operation_id ORDER BY event_id))""",
    "op_command_class": "SELECT * FROM (VALUES " + _values([(c, k, k == "DESTRUCTIVE", d, p) for c, k, d, p in COMMANDS]) + ") t(command, class, confirm, dry_run, paginated)",
    "cfg_precedence": """SELECT key, coalesce(o, e, f, d) AS value, CASE WHEN o IS NOT NULL THEN 'option' WHEN e IS NOT NULL THEN 'env' WHEN f IS NOT NULL THEN 'file' ELSE 'default' END AS source
        FROM (VALUES """ + _values(SETTINGS) + ") t(key, o, e, f, d)",
    "cap_missing": "SELECT capability FROM (VALUES ('instance holds'), ('retention purge')) t(capability)",
    "tasklet_status": "SELECT * FROM (VALUES " + _values(OUTCOMES) + ") t(outcome, status, exit)",
}
