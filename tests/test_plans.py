import itertools

import pytest

from batchloom.functions import digest
from batchloom.plans.flow import FlowGraph, Pattern, PlanError, run_split
from batchloom.plans.ledger import cursor, open_cursor, upgrade_chain


def plain_match(pattern, text):
    if not pattern:
        return not text
    if pattern[0] == "*":
        return any(plain_match(pattern[1:], text[k:]) for k in range(len(text) + 1))
    return bool(text) and pattern[0] in ("?", text[0]) and plain_match(pattern[1:], text[1:])


def test_patterns_by_enumeration():
    patterns = ["".join(p) for n in (1, 2, 3) for p in itertools.product("ab*?", repeat=n)]
    texts = ["".join(t) for n in range(4) for t in itertools.product("ab", repeat=n)]
    for p in patterns:
        assert [Pattern(p).matches(t) for t in texts] == [plain_match(p, t) for t in texts]
    longer = ["".join(t) for n in range(7) for t in itertools.product("ab", repeat=n)]
    for p, q in itertools.combinations(patterns[:40], 2):
        assert Pattern(p).intersects(Pattern(q)) == any(plain_match(p, t) and plain_match(q, t) for t in longer)


def test_invalid_patterns():
    for text in ("", " a", "a\n", "x" * 65):
        with pytest.raises(PlanError):
            Pattern(text)


def graph():
    return FlowGraph("load", ["load", "report"]).edge("load", "COMPLETED", "report").edge("load", "PARTIAL", "report").edge("load", "FAILED", "FAIL").edge("report", "*", "COMPLETE")


def test_compile_and_walk():
    plan = graph().compile()
    end, decisions = plan.walk({"load": lambda: "PARTIAL", "report": lambda: "COMPLETED"})
    assert end == "COMPLETE" and [d[1:] for d in decisions] == [("load", "PARTIAL", "report"), ("report", "COMPLETED", "COMPLETE")]
    with pytest.raises(PlanError, match="no transition maps"):
        plan.target("load", "ODD")
    ran = []
    plan.walk({"load": lambda: ran.append("load") or "COMPLETED", "report": lambda: ran.append("report") or "COMPLETED"}, {"load": "COMPLETED"})
    assert ran == ["report"]


def test_fingerprint_does_not_depend_on_declaration_order():
    other = graph()
    other.nodes.reverse()
    other.edges.reverse()
    assert other.compile().fingerprint == graph().compile().fingerprint


@pytest.mark.parametrize("change", [
    lambda g: g.node("load"), lambda g: g.node("alone").edge("alone", "*", "COMPLETE"), lambda g: g.edge("report", "X", "load"), lambda g: g.edge("load", "X", "nowhere"),
    lambda g: g.edge("load", "C?MPLETED", "report").edge("load", "CO?PLETED", "FAIL"), lambda g: g.node("stuck").edge("load", "S", "stuck")])
def test_bad_graphs(change):
    g = graph()
    change(g)
    with pytest.raises(PlanError):
        g.compile()


def test_equally_specific_but_disjoint_patterns():
    assert graph().edge("load", "A?", "report").edge("load", "B?", "FAIL").compile()


def test_split_takes_the_first_worst_branch():
    branches = [("a", lambda: ("COMPLETED", "A")), ("b", lambda: ("FAILED", "B")), ("c", lambda: ("FAILED", "C"))]
    assert run_split(branches, 2, 3) == ("FAILED", "B")
    with pytest.raises(PlanError):
        run_split(branches, 3, 3)


def test_golden_instance_key():
    parameters = {"active": ("bool", True), "count": ("i64", -2), "limit": ("u64", 2**63), "region": ("string", "서울")}
    assert digest.instance_key("golden_job", parameters) == "71f12db9e3887de2cf92e93bb63fd4e9e7c536df8fa202212445d18bf2e43604"


def test_cursors_are_bound_to_their_query():
    text = cursor("instances", {"job": "a"}, 50, [7])
    assert open_cursor(text, "instances", {"job": "a"}, 50) == [7]
    for query, filters, size in (("steps", {"job": "a"}, 50), ("instances", {"job": "b"}, 50), ("instances", {"job": "a"}, 60)):
        with pytest.raises(ValueError):
            open_cursor(text, query, filters, size)


def test_upgrade_chain():
    assert upgrade_chain({1: 2, 2: 4, 4: 5}, 1, 5) == 3
    assert upgrade_chain({1: 2}, 1, 5) is None
    assert upgrade_chain({1: 9}, 1, 5) is None
