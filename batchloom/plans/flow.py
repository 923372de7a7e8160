"""Job flows: exit patterns, a graph compiled once, and a walker on the driver.

Graphs are small (1,024 nodes at most) and live on the driver. Where many exits
or decisions have to be judged at once, the same rules are column functions.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions.digest import manifest
from batchloom.session import table

#: Bounds of a graph.
MAX_NODES, MAX_EDGES, MAX_OUT, MAX_PATTERN_BYTES = 1024, 4096, 64, 64
TERMINALS = ("COMPLETE", "FAIL", "STOP")


class PlanError(ValueError):
    """A definition that cannot be compiled or an exit that leads nowhere."""


@dataclass(frozen=True)
class Pattern:
    """``*`` stands for any run of characters, ``?`` for just one."""

    text: str

    def __post_init__(self):
        t = self.text
        if not t or len(t.encode()) > MAX_PATTERN_BYTES or t != t.strip() or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in t):
            raise PlanError(f"invalid pattern {t!r}")

    def regex(self) -> str:
        return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in self.text) + r"\z"

    def matches(self, code: str) -> bool:
        return re.match(self.regex().replace(r"\z", r"\Z"), code) is not None

    @property
    def specificity(self) -> tuple[int, int, int]:
        """Greater goes first: more literals, then fewer wildcards, then more bytes."""
        wild = sum(c in "*?" for c in self.text)
        return len(self.text) - wild, -wild, len(self.text.encode())

    def intersects(self, other: Pattern) -> bool:
        """Whether some code matches both: reachable ends of the product of the two automata."""
        a, b = self.text, other.text
        seen, todo = set(), [(0, 0)]
        while todo:
            i, j = todo.pop()
            if (i, j) in seen:
                continue
            seen.add((i, j))
            if i == len(a) and j == len(b):
                return True
            x, y = a[i : i + 1], b[j : j + 1]
            if x == "*":
                todo.append((i + 1, j))
            if y == "*":
                todo.append((i, j + 1))
            if x and y and (x in "*?" or y in "*?" or x == y):
                todo.append((i + (x != "*"), j + (y != "*")))
        return False


@dataclass
class FlowGraph:
    """Nodes, and edges ``(source, pattern, target)``; a target may be a terminal."""

    entry: str
    nodes: list[str] = field(default_factory=list)
    edges: list[tuple[str, str, str]] = field(default_factory=list)

    def node(self, *names: str) -> FlowGraph:
        self.nodes += names
        return self

    def edge(self, source: str, pattern: str, target: str) -> FlowGraph:
        self.edges.append((source, pattern, target))
        return self

    def sequence(self, source: str, then: str) -> FlowGraph:
        """FAILED fails the job, everything else goes on."""
        return self.edge(source, "FAILED", "FAIL").edge(source, "*", then)

    def compile(self) -> CompiledPlan:
        known = set(self.nodes)
        if len(known) != len(self.nodes):
            raise PlanError("a node is declared twice")
        if self.entry not in known:
            raise PlanError("the entry is no node")
        if len(self.nodes) > MAX_NODES or len(self.edges) > MAX_EDGES:
            raise PlanError("the graph is too large")
        out: dict[str, list[tuple[Pattern, str]]] = {n: [] for n in self.nodes}
        for source, pattern, target in self.edges:
            if source not in known or target not in known and target not in TERMINALS:
                raise PlanError(f"an edge names an undefined node: {source} to {target}")
            out[source].append((Pattern(pattern), target))
        for name, ways in out.items():
            if not ways:
                raise PlanError(f"{name} has no transition")
            if len(ways) > MAX_OUT:
                raise PlanError(f"{name} has too many transitions")
            ways.sort(key=lambda w: (tuple(-x for x in w[0].specificity), w[0].text))
            for k, (p, _) in enumerate(ways):
                for q, _ in ways[k + 1 :]:
                    if p.specificity == q.specificity and p.intersects(q):
                        raise PlanError(f"{name}: {p.text} and {q.text} are equally specific and overlap")
        done: set[str] = set()
        open_: set[str] = set()

        def visit(name: str) -> None:
            stack = [(name, iter(out[name]))]
            open_.add(name)
            while stack:
                at, ways = stack[-1]
                for _, target in ways:
                    if target in TERMINALS or target in done:
                        continue
                    if target in open_:
                        raise PlanError(f"{target} can be reached from itself")
                    open_.add(target)
                    stack.append((target, iter(out[target])))
                    break
                else:
                    stack.pop()
                    open_.discard(at)
                    done.add(at)

        visit(self.entry)
        if done != known:
            raise PlanError(f"unreachable: {sorted(known - done)}")
        return CompiledPlan(self.entry, out, manifest({"entry": self.entry, "nodes": sorted(self.nodes), "edges": sorted(map(list, self.edges))}))


@dataclass
class CompiledPlan:
    entry: str
    ways: dict[str, list[tuple[Pattern, str]]]
    fingerprint: str

    def target(self, node: str, code: str) -> str:
        """The first way, the most specific first, that fits; there is no default."""
        for pattern, target in self.ways[node]:
            if pattern.matches(code):
                return target
        raise PlanError(f"{node} ended with {code}, which no transition maps")

    def walk(self, steps: dict[str, Callable[[], str]], completed: dict[str, str] | None = None, again: frozenset[str] = frozenset()) -> tuple[str, list[tuple[int, str, str, str]]]:
        """Run nodes from the entry to a terminal; the terminal and the decisions ``(seq, node, outcome, target)``.

        Steps completed by an earlier attempt are not run again unless named in
        ``again``; their recorded outcome decides.
        """
        node, decisions = self.entry, []
        while node not in TERMINALS:
            reused = (completed or {}).get(node) if node not in again else None
            outcome = reused if reused is not None else steps[node]()
            target = self.target(node, outcome)
            decisions.append((len(decisions) + 1, node, outcome, target))
            node = target
        return node, decisions


#: Statuses from least to most severe, as a branch or partition hands them on.
SEVERITY = ("COMPLETED", "STOPPED", "FAILED", "UNKNOWN")


#: Branches of a split, and steps of a branch.
MAX_BRANCHES, MAX_BRANCH_STEPS = 8, 8


def run_split(branches: list[tuple[str, Callable | list[Callable]]], workers: int, pool: int, policy: str = "DRAIN", spark: SparkSession | None = None) -> tuple[str, str]:
    """Branches side by side, each of one to eight steps that give a status and an exit; all are joined, whatever happens to one.

    A branch ends with its first step that is not COMPLETED; a step that raises
    has FAILED. Under DRAIN the other branches go on to their end; under CANCEL
    a branch that fails, or whose outcome is unknown, stops them: their running
    Spark jobs are cancelled and no further step begins. The result is the
    worst status of all, and the exit of the first branch, as declared, that
    has it.
    """
    steps = [(name, work if isinstance(work, list) else [work]) for name, work in branches]
    if not 2 <= len(branches) <= MAX_BRANCHES or any(not 1 <= len(w) <= MAX_BRANCH_STEPS for _, w in steps) or len({n for n, _ in steps}) < len(steps):
        raise PlanError("a split has two to eight branches of one to eight steps, and names them apart")
    if workers + 1 > pool:
        raise PlanError("the pool is too small for the split")
    if policy not in ("DRAIN", "CANCEL"):
        raise PlanError("no such policy")
    run_id, ended = uuid.uuid4().hex, threading.Event()

    def cancel(by: str) -> None:
        ended.set()
        for name, _ in steps if spark is not None else ():
            if name != by:
                spark.sparkContext.cancelJobGroup(f"{run_id}-{name}")

    def run(name: str, work: list[Callable]) -> tuple[str, str]:
        if spark is not None:
            spark.sparkContext.setJobGroup(f"{run_id}-{name}", name, interruptOnCancel=True)
        status, code = "COMPLETED", "COMPLETED"
        for step in work:
            if ended.is_set():
                return "STOPPED", "STOPPED"
            try:
                status, code = step()
            except Exception as e:
                status, code = ("STOPPED", "STOPPED") if ended.is_set() else ("FAILED", type(e).__name__)
            if status != "COMPLETED":
                break
        if policy == "CANCEL" and status in ("FAILED", "UNKNOWN"):
            cancel(name)
        return status, code

    with ThreadPoolExecutor(workers) as threads:
        done = [f.result() for f in [threads.submit(run, name, work) for name, work in steps]]
    worst = max((s for s, _ in done), key=SEVERITY.index)
    return worst, next(e for s, e in done if s == worst)


def specificity(pattern: Column) -> Column:
    """The order of :attr:`Pattern.specificity` as a sortable struct."""
    wild = F.char_length(F.regexp_replace(pattern, "[^*?]", ""))
    return F.struct((F.char_length(pattern) - wild).alias("literals"), (-wild).alias("wild"), F.octet_length(pattern).alias("bytes"))


def pattern_regex(pattern: Column) -> Column:
    """A regular expression for a column of patterns."""
    escaped = F.regexp_replace(pattern, r"([\\.\[\]{}()+|^$\-])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))


def select_targets(exits: DataFrame, edges: DataFrame) -> DataFrame:
    """``code, pattern, target`` of the most specific edge that fits each code. ``edges`` is a graph's: at most MAX_EDGES, and broadcast."""
    if edges.limit(MAX_EDGES + 1).count() > MAX_EDGES:
        raise PlanError("too many edges")
    fits = exits.join(F.broadcast(edges), F.expr("code rlike regex"))
    best = F.max_by(F.struct("pattern", "target"), F.struct(specificity(F.col("pattern")), "pattern")).alias("best")
    return fits.groupBy("code").agg(best).select("code", "best.pattern", "best.target")


def reachable(edges: DataFrame, entry: str) -> DataFrame:
    """Nodes from ``entry`` on, by breadth; a graph's edges, so few rounds and rows."""
    seen = edges.sparkSession.createDataFrame([(entry,)], "node string")
    front = seen
    for _ in range(MAX_NODES):
        front = front.join(edges, front["node"] == edges["source"]).select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    return seen


PATTERNS = [("1-*", "expedite"), ("2-HIGH", "expedite"), ("?-MEDIUM", "queue"), ("3-*", "hold"), ("5-L?W", "queue"), ("*-LOW", "hold")]
EDGES = [("start", "load"), ("load", "check"), ("check", "report"), ("check", "repair"), ("repair", "report"), ("orphan", "report"), ("island", "orphan")]


def _edges(spark):
    return spark.createDataFrame(PATTERNS, "pattern string, target string").withColumn("regex", pattern_regex(F.col("pattern")))


def _exits(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("code")).distinct()


def flow_pattern_match(spark, sf):
    return _exits(spark, sf).join(F.broadcast(_edges(spark)), F.expr("code rlike regex")).select("code", "pattern")


def flow_select_target(spark, sf):
    chosen = select_targets(_exits(spark, sf), _edges(spark))
    missing = _exits(spark, sf).join(chosen, "code", "left_anti").select("code", F.lit(None).cast("string").alias("pattern"), F.lit("UNMAPPED").alias("target"))
    return chosen.unionByName(missing)


def flow_reachability(spark, sf):
    return reachable(spark.createDataFrame(EDGES, "source string, target string"), "start")


def flow_sequence(spark, sf):
    graph = FlowGraph("load", ["load", "check", "report"]).sequence("load", "check").sequence("check", "report").edge("report", "*", "COMPLETE")
    return spark.createDataFrame(graph.edges, "source string, pattern string, target string")


def flow_trace(spark, sf):
    graph = FlowGraph("load", ["load", "check", "repair", "report"]).sequence("load", "check").edge("check", "CLEAN", "report").edge("check", "DIRTY*", "repair").edge("repair", "*", "report").sequence("report", "COMPLETE")
    outcomes = {"load": "COMPLETED", "check": "DIRTY-3", "repair": "COMPLETED", "report": "COMPLETED"}
    _, decisions = graph.compile().walk({n: (lambda o=o: o) for n, o in outcomes.items()})
    return spark.createDataFrame(decisions, "seq long, node string, outcome string, target string")


def _decisions(spark, sf):
    """Flow decisions from events: a user is an instance, an event type a node, the value's parity the input digest."""
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("instance_id"), F.col("event_type").alias("node"), (cents % 3).alias("digest"), (cents % 7).alias("outcome"))


def flow_reuse_latest(spark, sf):
    newest = F.max_by("outcome", "event_id").alias("outcome")
    return _decisions(spark, sf).groupBy("instance_id", "node", "digest").agg(F.max("event_id").alias("event_id"), newest)


def flow_start_limit(spark, sf, limit: int = 15):
    starts = _decisions(spark, sf).groupBy("instance_id", "node").agg(F.count("*").alias("starts"))
    return starts.withColumn("exceeded", F.col("starts") >= limit)


def definition_step_mapping(spark, sf):
    """The steps of an upgrade's mapping, read from its JSON, joined to those that ran."""
    upgrade = spark.createDataFrame([('{"import": "load", "reconcile": "check"}',)], "mapping string")
    pairs = upgrade.select(F.explode(F.from_json("mapping", "map<string,string>")).alias("step", "renamed"))
    step = F.when(F.col("l_linenumber") == 1, "import").when(F.col("l_linenumber") == 2, "reconcile").otherwise("other")
    ran = table(spark, sf, "lineitem").select(step.alias("step")).groupBy("step").agg(F.count("*").alias("executions"))
    return ran.join(F.broadcast(pairs), "step")


QUERIES = {f.__name__: f for f in (flow_pattern_match, flow_select_target, flow_reachability, flow_sequence, flow_trace, flow_reuse_latest, flow_start_limit, definition_step_mapping)}

_P = "(VALUES " + ", ".join("('{}', '{}', '{}')".format(p, t, "(?s)" + re.escape(p).replace(r"\*", ".*").replace(r"\?", ".")) for p, t in PATTERNS) + ") e(pattern, target, regex)"
_M = f"(SELECT DISTINCT o_orderpriority AS code FROM orders) c JOIN {_P} ON regexp_full_match(code, regex)"
_D = "(SELECT event_id, user_id AS instance_id, event_type AS node, CAST(round(value * 100) AS BIGINT) % 3 AS digest, CAST(round(value * 100) AS BIGINT) % 7 AS outcome FROM events)"
_WILD = "length(regexp_replace(pattern, '[^*?]', '', 'g'))"
ORACLES = {
    "flow_pattern_match": f"SELECT code, pattern FROM {_M}",
    "flow_select_target": f"""WITH m AS (SELECT code, pattern, target, row_number() OVER (PARTITION BY code ORDER BY length(pattern) - {_WILD} DESC, {_WILD}, length(pattern) DESC, pattern DESC) AS r FROM {_M})
        SELECT code, pattern, target FROM m WHERE r = 1 UNION ALL SELECT DISTINCT o_orderpriority, NULL, 'UNMAPPED' FROM orders WHERE o_orderpriority NOT IN (SELECT code FROM m)""",
    "flow_reachability": "WITH RECURSIVE e(source, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + "), r AS (SELECT 'start' AS node UNION SELECT target FROM r JOIN e ON source = node) SELECT node FROM r",
    "flow_sequence": "SELECT * FROM (VALUES ('load', 'FAILED', 'FAIL'), ('load', '*', 'check'), ('check', 'FAILED', 'FAIL'), ('check', '*', 'report'), ('report', '*', 'COMPLETE')) t(source, pattern, target)",
    "flow_trace": "SELECT CAST(seq AS BIGINT) AS seq, node, outcome, target FROM (VALUES (1, 'load', 'COMPLETED', 'check'), (2, 'check', 'DIRTY-3', 'repair'), (3, 'repair', 'COMPLETED', 'report'), (4, 'report', 'COMPLETED', 'COMPLETE')) t(seq, node, outcome, target)",
    "flow_reuse_latest": f"SELECT instance_id, node, digest, max(event_id) AS event_id, arg_max(outcome, event_id) AS outcome FROM {_D} GROUP BY 1, 2, 3",
    "flow_start_limit": f"SELECT instance_id, node, count(*) AS starts, count(*) >= 15 AS exceeded FROM {_D} GROUP BY 1, 2",
    "definition_step_mapping": """SELECT step, executions, renamed FROM (SELECT CASE l_linenumber WHEN 1 THEN 'import' WHEN 2 THEN 'reconcile' ELSE 'other' END AS step, count(*) AS executions FROM lineitem GROUP BY 1)
        JOIN (VALUES ('import', 'load'), ('reconcile', 'check')) m(step, renamed) USING (step)""",
}
