import itertools
import random

import numpy as np
import pytest

from batchloom.llm import minhash
from batchloom.llm.minhash import WordHashes, near_groups, shingles


def components_by_force(texts):
    sets = [set(shingles(None if t is None else t.encode(), WordHashes()).tolist()) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return [root(i) for i in range(len(texts))]


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def stored(spark, tmp_path, rows):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, key string, label string, row string").write.parquet(path)
    return spark.read.parquet(path)


def test_group_of_edited_copies(spark, tmp_path, monkeypatch):
    """One large group around the threshold: some copies are linked, most pairs are just below."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    other = [f"v{rng.randrange(5000)}" for _ in range(80)]
    texts = [edited(base, rng.randrange(1, 7), rng) for _ in range(120)] + [edited(other, rng.randrange(0, 3), rng) for _ in range(20)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)] + [texts[3]] * 15
    rng.shuffle(texts)
    want = components_by_force(texts)
    found = {r.doc_id: r for r in near_groups(stored(spark, tmp_path, [(i, t, "k", "l", "r") for i, t in enumerate(texts)])).collect()}
    assert [found[i].component_id for i in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) == r.first for r in found.values())


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "One  two"), (5, "one two"), (None, "one two"), (None, "lonely words here"), (7, long), (8, long + " tail"), (9, "a b c d e")]
    found = near_groups(stored(spark, tmp_path, [(i, t, None, None, None) for i, t in rows])).collect()
    by = {(r.doc_id, r.n_shingles): r for r in found}
    assert len(found) == len(rows)
    assert [by[i, 0].component_id for i in (1, 2, 3)] == [1, 2, 3] and all(by[i, 0].kept for i in (1, 2, 3))
    assert {r.component_id for r in found if r.n_shingles == 1 and r.doc_id in (4, 5)} == {4}
    assert by[7, 39_996].component_id == by[8, 39_997].component_id == 7
    assert [r.component_id for r in found if r.doc_id is None] in ([4, None], [None, 4])
    assert sum(r.first for r in found) == 7


def test_empty_table(spark, tmp_path):
    assert near_groups(stored(spark, tmp_path, [])).count() == 0


def test_pairs_at_the_threshold_are_candidates():
    """Of pairs that are just similar enough, all pass the estimate and share a band, as the formula says."""
    rng = np.random.default_rng(3)
    power = minhash._M ** np.arange(1, minhash.ROWS + 1, dtype=np.uint64)
    passed = met = 0
    for _ in range(1500):
        both = int(rng.integers(30, 300)) // 3 * 3
        apart = both // 3  # both / (both + apart) = 0.75
        own = int(rng.integers(0, apart + 1))
        x = rng.integers(0, 2**63, both + apart, dtype=np.uint64)
        one, other = np.unique(x[: both + own]), np.unique(np.concatenate([x[:both], x[both + own :]]))
        least = [minhash.minima(s) for s in (one, other)]
        low = [(m >> np.uint64(32)) & np.uint64(2**minhash.BITS - 1) for m in least]
        passed += int((low[0] == low[1]).sum()) >= minhash.least_matches()
        bands = [(m.reshape(minhash.BANDS, minhash.ROWS) * power).sum(axis=1) for m in least]
        met += bool((bands[0] == bands[1]).any())
    assert passed == met == 1500



@pytest.mark.parametrize("text", [b"", b"a", b"a b c d e f"])
def test_shingle_counts(text):
    n = len(text.split())
    assert len(shingles(text, WordHashes())) == (0 if n == 0 else max(1, n - 4))
