import hashlib
import random

from batchloom.llm.components import components
from batchloom.llm.scratch import Scratch


def key(i):
    return hashlib.md5(str(i).encode()).hexdigest()


def test_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000)] + [(3000 + rng.randrange(60), 3000 + rng.randrange(60)) for _ in range(50)]
    above = {}

    def root(x):
        while x in above:
            x = above[x]
        return x

    for a, b in edges:
        if root(a) != root(b):
            above[root(a)] = root(b)
    rows = [(key(a), key(b)) for a, b in edges]
    rng.shuffle(rows)
    found = {r.node: r.label for r in components(spark.createDataFrame(rows, "a string, b string"), Scratch(spark, "test")).collect()}
    nodes = {n for e in edges for n in e}
    assert len(found) == len(nodes)
    groups = {}
    for n in nodes:
        groups.setdefault(found[key(n)], set()).add(root(n))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({root(n) for n in nodes})


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string"), Scratch(spark, "test")).count() == 0
