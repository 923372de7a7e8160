"""Fault policy as pure column functions over a table of faults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.operators.chunking import fill_chunks
from batchloom.operators.ordering import running_totals
from batchloom.session import table

#: Phases of an item fault, and actions of a rule.
PHASES = ("read", "process", "write", "transaction", "checkpoint", "listener", "backoff")
ACTIONS = ("FAIL", "RETRY", "SKIP", "RETRY_THEN_SKIP")
MAX_DELAY_MS = 24 * 3600 * 1000
#: Retries of a phase that one expression can hold, and rules of a table.
MAX_RETRIES, MAX_RULES = 16, 4096


@dataclass(frozen=True)
class Backoff:
    """Delay before retry r: initial * multiplier ** (r - 1), at most ``most``, never over a day."""

    initial_ms: int = 0
    multiplier: int = 1
    most_ms: int = MAX_DELAY_MS

    def delay(self, ordinal: Column) -> Column:
        grown = F.lit(float(self.initial_ms)) * F.pow(F.lit(float(self.multiplier)), ordinal - 1)
        return F.least(F.lit(float(min(self.most_ms, MAX_DELAY_MS))), grown).cast("long")


def classified(faults: DataFrame, rules: DataFrame) -> DataFrame:
    """``faults`` with the ``action`` of the one rule for their phase and category, or FAIL.

    Rules are a configuration table of at most MAX_RULES rows, which is checked
    before they are broadcast; two rules for one pair fail.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError("too many rules")
    twice = F.count("*") > 1
    checked = rules.groupBy("phase", "category").agg(F.when(twice, F.raise_error(F.lit("two rules for one fault"))).otherwise(F.first("action")).alias("action"))
    return faults.join(F.broadcast(checked), ["phase", "category"], "left").withColumn("action", F.coalesce("action", F.lit("FAIL")))


def decide(action: Column, category: Column, ordinal: Column, retry_limit: int, skips: Column, skip_limit: int, located: Column) -> Column:
    """What happens after a fault: Unknown, Stop, Retry, Skip or Fail, in that precedence."""
    may_retry = action.isin("RETRY", "RETRY_THEN_SKIP") & (ordinal + 1 <= retry_limit)
    may_skip = action.isin("SKIP", "RETRY_THEN_SKIP") & located & (skips + 1 <= skip_limit)
    return (F.when(category == "UNKNOWN_COMMIT", "UNKNOWN").when(category == "CANCELLED", "STOP")
            .when(may_retry, "RETRY").when(may_skip, "SKIP").otherwise("FAIL"))


@dataclass(frozen=True)
class FaultPolicy:
    """What follows from a fault: rules ``(phase, category, action)``, limits, and skips after which the chunk's other work may be kept.

    ``safe`` names the ``(phase, category)`` of those skips, in reading or
    processing; every other skip, and each retry, rolls the chunk back.
    """

    rules: tuple[tuple[str, str, str], ...] = ()
    retry_limit: int = 0
    safe: frozenset[tuple[str, str]] = frozenset()
    backoff: Backoff = Backoff()

    def __post_init__(self):
        if len({r[:2] for r in self.rules}) < len(self.rules):
            raise ValueError("two rules for one fault")
        if any(p not in PHASES or a not in ACTIONS for p, _, a in self.rules):
            raise ValueError("no such phase or action")
        if any(p not in ("read", "process") for p, _ in self.safe):
            raise ValueError("a skip in writing always rolls back")
        if not 0 <= self.retry_limit <= MAX_RETRIES:
            raise ValueError("too many retries")

    def action(self, phase: str, category: Column) -> Column:
        found = F.when(F.lit(False), "FAIL")
        for p, c, a in self.rules:
            if p == phase:
                found = found.when(category == c, a)
        return found.otherwise("FAIL")


def resolve(items: DataFrame, faults: dict[str, Callable[[int], Column]], policy: FaultPolicy) -> DataFrame:
    """``items`` with what their faults lead to: ``_skip`` (a phase), ``_retries``, ``_rolled``, ``_end``.

    ``faults`` gives for a phase and the number of retries before the category
    of an item's fault, or null. Each phase is tried until it succeeds, is
    skipped, or ends the step (``_end``: FAIL, STOP or UNKNOWN); later phases
    are not tried then. ``_rolled`` counts how often the item's chunk is rolled
    back for it. All of it is one expression of the item's columns.
    """
    state = F.struct(F.lit("OK").alias("what"), F.lit(0).alias("retries"), F.lit(0).alias("rolled"), F.lit(None).cast("string").alias("phase"))
    out = items.withColumn("_state", state)
    for phase in ("read", "process", "write"):
        if phase not in faults:
            continue
        tried = F.struct(F.lit("FAIL").alias("what"), F.lit(policy.retry_limit).alias("retries"), F.lit(1).alias("rolled"))
        for ordinal in range(policy.retry_limit, -1, -1):
            category = faults[phase](ordinal)
            what = decide(policy.action(phase, category), category, F.lit(ordinal), policy.retry_limit, F.lit(0), 1, F.lit(True))
            safe = F.lit(False)
            for p, c in policy.safe:
                safe = safe | ((category == c) if p == phase else F.lit(False))
            rolled = F.lit(ordinal) + F.when((what == "SKIP") & ~safe, 1).otherwise(0)
            here = F.struct(F.when(category.isNull(), "OK").otherwise(what).alias("what"), F.lit(ordinal).alias("retries"), F.when(category.isNull(), F.lit(ordinal)).otherwise(rolled).alias("rolled"))
            tried = F.when(category.isNotNull() & (what == "RETRY"), tried).otherwise(here)
        out = out.withColumn("_tried", tried)
        before = F.col("_state")
        after = F.struct(F.col("_tried.what").alias("what"), (before["retries"] + F.col("_tried.retries")).alias("retries"), (before["rolled"] + F.col("_tried.rolled")).alias("rolled"),
                         F.when(F.col("_tried.what") == "SKIP", phase).alias("phase"))
        out = out.withColumn("_state", F.when(before["what"] == "OK", after).otherwise(before)).drop("_tried")
    state = F.col("_state")
    return out.withColumns({"_skip": F.when(state["what"] == "SKIP", state["phase"]), "_retries": state["retries"], "_rolled": state["rolled"],
                            "_end": F.when(~state["what"].isin("OK", "SKIP"), state["what"])}).drop("_state")


def fault_counters() -> list[Column]:
    """Sums over :func:`resolve` rows with ``bad`` reads, by chunk or batch."""
    skipped = F.col("_skip").isNotNull()
    return [F.count_if(F.coalesce(F.col("_skip") == "read", F.lit(False))).alias("read_skips"), F.count_if(F.col("_skip") == "process").alias("process_skips"), F.count_if(F.col("_skip") == "write").alias("write_skips"),
            F.sum("_rolled").cast("long").alias("rolled_back_chunks"), F.sum("_retries").cast("long").alias("rollback_count"), F.count_if(skipped & (F.col("_rolled") == F.col("_retries"))).alias("no_rollback_count")]


def first_end(resolved: DataFrame, order: list[str], skip_limit: int) -> dict | None:
    """The chunk and kind of the first item that ends the step, or takes the skips over their limit (LIMIT); None if none does."""
    found = resolved.agg(F.count_if(F.col("_skip").isNotNull()).alias("skips"), F.count_if(F.col("_end").isNotNull()).alias("ends")).first()
    if found["skips"] <= skip_limit and not found["ends"]:
        return None
    counted = running_totals(resolved, order, {"_skips": F.col("_skip").isNotNull().cast("int")})
    over = counted.filter(F.col("_end").isNotNull() | (F.col("_skips") > skip_limit)).orderBy(*order).select("chunk_id", F.coalesce("_end", F.lit("LIMIT")).alias("kind")).first()
    return over.asDict()


def until_skip_limit(df: DataFrame, order: list[str], skip: Column, limit: int) -> DataFrame:
    """Items before the first that takes the running number of skips over ``limit``."""
    return running_totals(df, order, {"_skips": skip.cast("int")}).filter(F.col("_skips") <= limit).drop("_skips")


RULES = [("read", "TIMEOUT", "RETRY"), ("read", "PARSE", "SKIP"), ("process", "TIMEOUT", "RETRY_THEN_SKIP"), ("process", "VALIDATION", "SKIP"), ("write", "TIMEOUT", "RETRY"), ("write", "CONFLICT", "RETRY_THEN_SKIP")]
_CATEGORIES = ["TIMEOUT", "PARSE", "VALIDATION", "CONFLICT", "UNKNOWN_COMMIT", "CANCELLED"]


def _faults(spark, sf):
    kind = F.col("event_type")
    phase = F.when(kind == "click", "read").when(kind == "view", "process").when(kind == "purchase", "write").when(kind == "signup", "listener").otherwise("transaction")
    category = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("event_id") % 6 + 1).cast("int"))
    ordinal = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) % 5
    return table(spark, sf, "events").select("event_id", phase.alias("phase"), category.alias("category"), ordinal.alias("ordinal"))


def _rules(spark):
    return spark.createDataFrame(RULES, "phase string, category string, action string")


def fault_classify(spark, sf):
    return classified(_faults(spark, sf), _rules(spark)).select("event_id", "action")


def fault_decide(spark, sf):
    faults = classified(_faults(spark, sf), _rules(spark))
    decision = decide(F.col("action"), F.col("category"), F.col("ordinal"), 3, F.col("event_id") % 4, 3, F.col("phase").isin("read", "process", "write"))
    decided = faults.withColumn("decision", decision)
    again = F.col("decision") == "RETRY"
    return decided.select("event_id", "decision", F.when(again, F.col("ordinal") + 1).alias("next_ordinal"), F.when(again, Backoff(50, 2, 5000).delay(F.col("ordinal") + 1)).alias("delay_ms"))


def fault_skip_limit(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    done = until_skip_limit(events, ["event_id"], F.col("event_type") == "error", 100)
    return done.agg(F.count("*").alias("items_before_failure"), F.max("event_id").alias("last_id"))


def fault_rollback_counts(spark, sf):
    """Retries and write skips roll their chunk back; read and process skips may be safe to commit."""
    policy = FaultPolicy((("process", "TIMEOUT", "RETRY"), ("process", "VALIDATION", "SKIP"), ("process", "PARSE", "SKIP"), ("write", "CONFLICT", "SKIP")), 1, frozenset({("process", "PARSE")}))
    at = F.col("event_id") % 50
    faults = {"process": lambda retries: F.when((at == 3) & F.lit(retries == 0), "TIMEOUT").when(at == 11, "VALIDATION").when(at == 13, "PARSE"), "write": lambda retries: F.when(at == 7, "CONFLICT")}
    filled = fill_chunks(resolve(table(spark, sf, "events").select("event_id"), faults, policy), ["event_id"], F.coalesce(F.col("_skip") == "read", F.lit(False)))
    return filled.groupBy("chunk_id").agg(*fault_counters()).select("chunk_id", "rolled_back_chunks", "rollback_count", "no_rollback_count")


def fault_backoff(spark, sf):
    policies = {"none": Backoff(), "fixed": Backoff(250), "exponential": Backoff(50, 2, 5000)}
    ordinals = spark.range(1, 21).select(F.col("id").alias("ordinal"))
    out = None
    for name, policy in policies.items():
        one = ordinals.select(F.lit(name).alias("policy"), "ordinal", policy.delay(F.col("ordinal")).alias("delay_ms"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (fault_classify, fault_decide, fault_skip_limit, fault_rollback_counts, fault_backoff)}

_F = f"""(SELECT event_id, CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'process' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'listener' ELSE 'transaction' END AS phase,
    (['{"', '".join(_CATEGORIES)}'])[event_id % 6 + 1] AS category, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 5 AS ordinal FROM events)"""
_R = "(VALUES " + ", ".join(f"('{p}', '{c}', '{a}')" for p, c, a in RULES) + ") r(phase, category, action)"
_C = f"(SELECT f.*, coalesce(action, 'FAIL') AS action FROM {_F} f LEFT JOIN {_R} USING (phase, category))"

ORACLES = {
    "fault_classify": f"SELECT event_id, action FROM {_C}",
    "fault_decide": f"""SELECT event_id, decision, CASE WHEN decision = 'RETRY' THEN ordinal + 1 END AS next_ordinal,
        CASE WHEN decision = 'RETRY' THEN CAST(least(5000, 50 * pow(2, ordinal)) AS BIGINT) END AS delay_ms FROM (
        SELECT *, CASE WHEN category = 'UNKNOWN_COMMIT' THEN 'UNKNOWN' WHEN category = 'CANCELLED' THEN 'STOP'
        WHEN action IN ('RETRY', 'RETRY_THEN_SKIP') AND ordinal + 1 <= 3 THEN 'RETRY'
        WHEN action IN ('SKIP', 'RETRY_THEN_SKIP') AND phase IN ('read', 'process', 'write') AND event_id % 4 + 1 <= 3 THEN 'SKIP' ELSE 'FAIL' END AS decision FROM {_C})""",
    "fault_skip_limit": """SELECT count(*) AS items_before_failure, max(event_id) AS last_id FROM (
        SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS skips FROM events) WHERE skips <= 100""",
    "fault_rollback_counts": """SELECT event_id // 100 AS chunk_id, count(*) FILTER (event_id % 50 IN (3, 7, 11)) AS rolled_back_chunks,
        count(*) FILTER (event_id % 50 = 3) AS rollback_count, count(*) FILTER (event_id % 50 = 13) AS no_rollback_count FROM events GROUP BY 1""",
    "fault_backoff": """SELECT policy, ordinal, CAST(least(cap, initial * pow(mult, ordinal - 1)) AS BIGINT) AS delay_ms FROM range(1, 21) r(ordinal),
        (VALUES ('none', 0, 1, 86400000), ('fixed', 250, 1, 86400000), ('exponential', 50, 2, 5000)) p(policy, initial, mult, cap)""",
}
