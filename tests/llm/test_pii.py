import random
import re

from batchloom.llm.pii import KINDS, believe, discover
from batchloom.llm.scratch import Scratch

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
DOCS = "doc_id long, text string, row string, kind string, value string"


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def counts(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain_spans(text):
    return {(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text) if counts(k, m.group())}


def stored(spark, tmp_path, texts, name="t"):
    path = str(tmp_path / name)
    spark.createDataFrame([(i, t, "r", "k", "v") for i, t in texts], DOCS).write.parquet(path)
    return spark.read.parquet(path)


def spans(docs):
    rows, found = discover(docs)
    ids = {r.row: r.doc_id for r in rows.collect()}
    out = {i: {} for i in ids.values()}
    for r in found.collect():
        out[ids[r.row]].setdefault(r.seed, set()).add((r.kind, r.start, r.end))
    return out


def test_seeds_equal_the_plain_expressions(spark, tmp_path):
    rng = random.Random(8)
    texts = ["a@b.c_d@e.f a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "5 4539 1488 0343 6467 4539148803436467", "4539-1488-0343-6467-1", "+1 (743) 555-3824. +44 20 7946 0958-", "é😀 x@y.org", "+1" * 50, "1" * 4000 + ".1.1.1", "@@@...", ""]
    texts += ["".join(rng.choice("ab@.-+ 0123459()é😀") for _ in range(60)) for _ in range(400)]
    found = spans(stored(spark, tmp_path, [*enumerate(texts), (1000, None)]))
    for i, text in enumerate(texts):
        assert found[i].get(True, set()) == plain_spans(text), text
    assert not found[1000]


def test_contexts_discover_unseen_identifiers(spark, tmp_path):
    rng = random.Random(2)
    number = lambda: f"{rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}"
    seeds = [(i, f"Please call me at +1 {number()} or later {rng.random()}"[:50]) for i in range(40)]
    unseen = [(100 + i, f"so call me at {number()} tomorrow") for i in range(5)]
    other = [(200 + i, f"order number {rng.randrange(10**9, 10**10)} shipped") for i in range(10)]
    found = spans(stored(spark, tmp_path, seeds + unseen + other))
    for i, text in unseen:
        at = text.index("at ") + 3
        assert found[i].get(False) == {("phone", at, at + 12)}
    assert not any(found[i] for i, _ in other)


def test_chains_of_contexts_and_long_words(spark, tmp_path):
    """Each round's finds make the next context believed; contexts are whole words, however long, and so are addresses."""
    rng = random.Random(3)
    long = "w" * 300
    number = lambda: f"{rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}"
    base, before = [number() for _ in range(10)], []
    texts = [f"dial0 +1 {number()}" for _ in range(300)] + [f"dial0 {n}" for n in base]
    for k in "abcdefg":  # what is new in one context is what the next one needs to be believed
        new = [number() for _ in range(2)]
        texts += [f"dial{k} {n}" for n in base + before + new]
        before = new
    texts += [f"{long} write a{i}@example.org" for i in range(20)] + [f"{long} write {'x' * 90}{i} [at] example [dot] org" for i in range(3)]
    found = spans(stored(spark, tmp_path, [*enumerate(texts)]))
    missed = [t for i, t in enumerate(texts) if not found[i]]
    assert not missed


def test_scores_by_force(spark, tmp_path):
    rng = random.Random(12)
    values = [(f"{rng.randrange(100, 999)} 555 {rng.randrange(1000, 9999)}", rng.choice(["phone", "", "", ""])) for _ in range(60)] + [(f"a{i} [at] b", rng.choice(["", "email"])) for i in range(20)]
    edges = {}
    for p in range(14):
        for value, kind in rng.sample(values, rng.randrange(3, 16)):
            if rng.random() < 0.8 or kind == "":
                edges[f"p{p}", kind, value] = rng.randrange(1, 4)
    digits = lambda v: len(re.sub("[^0-9]", "", v))
    shape = lambda k, v: ("@" in v or "[at" in v) if k == "email" else "[at" not in v and k == "phone" and 7 <= digits(v) <= 15
    score, before = {}, None
    while score != before:
        before, patterns = score, {}
        for p in {e[0] for e in edges}:
            own = {e: n for e, n in edges.items() if e[0] == p}
            for k in KINDS:
                worth = {e: float(e[1] == k) if e[1] else score.get((e[2], k), 0.0) for e in own if e[1] in ("", k)}
                mean = sum(own[e] * w for e, w in worth.items()) / sum(own.values())
                if sum(w >= 0.8 for w in worth.values()) >= 5 and mean >= 0.8:
                    patterns[p, k] = round(mean, 9)
        score = {}
        for (p, k), mean in patterns.items():
            for q, kind, value in edges:
                if q == p and kind == "" and shape(k, value):
                    score[value, k] = max(score.get((value, k), 0.0), int(mean * 1000 + 1e-6) / 1000)
    table = spark.createDataFrame([(*e, n) for e, n in edges.items()], "pattern string, kind string, value string, n long")
    found = believe(table, Scratch(spark, "test"))
    assert {(r["pattern"], r["as"]): round(r["score"], 9) for r in found.collect()} == patterns


def test_empty_table(spark, tmp_path):
    rows, found = discover(stored(spark, tmp_path, []))
    assert rows.count() == found.count() == 0
