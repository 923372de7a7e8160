import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchloom.llm import langid, lm
from batchloom.llm.langid import Network, identify


def stored(spark, tmp_path, rows, schema, name="t"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


LM = "doc_id long, text string, train boolean, block string, word string"


def by_force(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), 0]
    counts = [collections.Counter() for _ in range(3)]
    texts = sum(train for _, _, train in rows)
    for _, text, train in rows:
        seq = [1, *tokens(text)]
        for i in range(1, len(seq)) if train else ():
            for k in range(3):
                if i - k >= (1 if k == 0 else 0):
                    counts[k][tuple(seq[i - k : i + 1])] += 1
    one, two, three = counts
    total, distinct = sum(one.values()), len(one)
    masses = []
    for of, lower in ((two, one), (three, two)):
        states, uses = np.zeros(lm.GROUPS), np.zeros(lm.GROUPS)
        for n in lower.values():
            g = min(int(lm.FINE * np.log2(n)), lm.GROUPS - 1)
            states[g] += 1
            uses[g] += n
        masses.append(lm.mass(sum(n == 1 for n in of.values()), sum(of.values()), states, uses))
    context = lambda s: texts if s == (1,) else counts[len(s) - 1][s]

    def p(s):
        if len(s) == 1:
            return (one[s] + 0.5) / (total + 0.5 * (distinct + 1))
        m, c = masses[len(s) - 2], context(s[:-1])
        return (counts[len(s) - 1][s] + m * p(s[1:])) / (c + m)

    out = []
    for i, text, train in rows:
        seq = [1, *tokens(text)]
        base = sum(math.log10(p((w,))) for w in seq[1:])
        score = sum(math.log10(p(tuple(seq[max(0, k - 2) : k + 1]))) for k in range(1, len(seq)))
        out.append((i or 0, not train, len(seq) - 1, sum(one[(w,)] > 0 for w in seq[1:]), total, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("train_share", [0.8, 0.0])
def test_scores_by_force(spark, tmp_path, monkeypatch, train_share):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 400)
    monkeypatch.setattr(lm, "BUCKET_CHARS", 3000)
    monkeypatch.setattr(lm, "LANE", 16)
    rng = random.Random(7)
    words = ["the", "The", "of", *(f"w{i}" for i in range(60))]
    rows = [(i if i else None, " ".join(rng.choice(words[: rng.randrange(2, 60)]) for _ in range(rng.randrange(80))), rng.random() < train_share) for i in range(150)]
    rows += [(510, "w1 " + "the of " * 900 + "w2", train_share > 0), (511, " " * 900 + "w1 " + " " * 900 + "of", train_share > 0), (512, "x" * 3000 + " of the " + "y" * 2000, False)]
    rows += [(500, None, train_share > 0), (501, "", False), (502, "é é \x0b x", train_share > 0), (7, rows[7][1], rows[7][2])]
    docs = stored(spark, tmp_path, [(*r, "x", "y") for r in rows], LM)
    found = lm.score(docs, F.col("train")).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found) == by_force(rows)


def test_lm_empty_table(spark, tmp_path):
    assert lm.score(stored(spark, tmp_path, [], LM), F.col("train")).count() == 0


def test_gradients_are_those_of_the_loss():
    network = Network.fresh(["a", "b", "c"])
    for name in ("gates", "turn", "out"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    found, _ = network.gradients(x, y)
    for name, grad in zip(("gates", "turn", "out"), found):
        weights = getattr(network, name)
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            if name == "gates":
                at = (at[0], int(x.ravel()[rng.integers(0, x.size)]), at[2])
            kept, step = weights[at], 1e-3
            weights[at] = kept + step
            up = network.gradients(x, y)[1]
            weights[at] = kept - step
            down = network.gradients(x, y)[1]
            weights[at] = kept
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3


LANG = "doc_id long, text string, lang string, source string, lang_pred string"


def test_learns_what_is_labelled(spark, tmp_path):
    rng = random.Random(3)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "äöüßé"}
    rows = []
    for i in range(240):
        lang = rng.choice(list(letters))
        rows.append((i, " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(40)), lang, "s", "p"))
    odd = [(300, None, "aa", "s", "p"), (301, "", "aa", "s", "p"), (302, "123 !?", "bb", "s", "p"), (None, "abcde abcde abcde", None, "s", "p"), (303, "fghij " * 20_000, None, "s", "p"), (5, *rows[5][1:])]
    found = identify(stored(spark, tmp_path, rows + odd, LANG)).collect()
    assert len(found) == len(rows) + len(odd)
    held = [(r.lang_pred, next(x[2] for x in rows if x[0] == r.doc_id)) for r in found if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and by[300].score == 0
    assert by[None].lang_pred == "aa" and not by[None].held_out and by[303].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in found)


def test_nothing_to_learn_from(spark, tmp_path):
    assert identify(stored(spark, tmp_path, [], LANG)).count() == 0
    found = identify(stored(spark, tmp_path / "u", [(1, "text", None, "s", "p")], LANG)).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]


def test_stage_keeps_what_is_in_a_language(spark, tmp_path):
    docs = stored(spark, tmp_path, [(i, t, "aa", "s", "p") for i, t in enumerate(["abc", None, "12", "é", "½ ²", ""])], LANG)
    kept = langid.drop_unknown(docs, langid.fit(docs))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3] and kept.columns == docs.columns
    assert langid.drop_unknown(docs, None).count() == 0


def test_stage_goes_by_the_network(spark, tmp_path):
    """A text on which the network is no better than chance goes, though it has letters."""
    network = Network.fresh(["aa", "bb"])
    network.out[:] = 0
    network.gates[:] = 0
    network.turn[:] = 0
    network.gates[:, ord("x"), 16:] = 3.0  # after an x the states are positive, after anything else 0
    network.out[:8, 1] = 1.0
    docs = stored(spark, tmp_path, [(1, "xx", "l", "s", "p"), (2, "abc", "l", "s", "p")], LANG)
    assert [r.doc_id for r in langid.drop_unknown(docs, network).collect()] == [1]
    assert sorted(r.doc_id for r in langid.drop_unknown(docs, network, floor=1.0).collect()) == [1, 2]


def test_letters():
    assert all(map(langid.has_letter, ["a", "1é", "ª", "中", "\U00010400"]))
    assert not any(map(langid.has_letter, ["", "½", "²", "1_2", "Ⅷ", "\u0301", "①"]))


def random_network(languages, seed=5):
    network = Network.fresh(languages, seed)
    network.gates *= 2
    network.out *= 3
    return network


def test_runs_follow_a_single_pass(monkeypatch):
    """Texts of up to a run give just what one pass gives; longer ones what it gives but for what the margin forgets."""
    network = random_network(["a", "b", "c"])
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (1, 2, 63, 64, 100, 511, 512, 513, 1300, 5000, 3)] + [b""]
    pool = lambda m: np.exp(m) / np.exp(m).sum()
    want = np.array([pool(network.label(np.frombuffer(t, np.uint8)[:, None]).mean(axis=(0, 1)) if t else np.zeros(3)) for t in texts])
    for window, margin, lanes in ((512, 64, 512), (64, 64, 3), (32, 40, 7)):
        monkeypatch.setattr(langid, "WINDOW", window)
        monkeypatch.setattr(langid, "MARGIN", margin)
        monkeypatch.setattr(langid, "LANES", lanes)
        found = network.pooled(texts)
        assert np.abs(found - want).max() < 2e-3
        short = [i for i, t in enumerate(texts) if len(t) <= window]
        assert np.abs(found[short] - want[short]).max() < 1e-5


def test_ties_and_clashing_names(spark, tmp_path):
    network = Network.fresh(["bb", "aa"])
    network.out[:] = 0
    docs = stored(spark, tmp_path, [(1, "abc", "l", "body text", "p"), (2, "x", "l", None, "p")], LANG)
    found = sorted(langid.predict(docs, network, text="source").collect(), key=lambda r: r.doc_id)
    assert [(r.lang_pred, round(r.score, 6), r.text) for r in found] == [("bb", 0.5, "abc"), ("und", 0.0, "x")]
