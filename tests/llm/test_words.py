import random

import numpy as np
import pytest

from batchloom.llm import words as w


@pytest.mark.parametrize("slice_", [1, 7, 64, 1 << 18])
def test_words_by_force(monkeypatch, slice_):
    """Equal words get equal hashes, different ones different, wherever they stand and however the text is sliced."""
    monkeypatch.setattr(w, "SLICE", slice_)
    rng = random.Random(slice_)
    for _ in range(60):
        text = "".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "\0", "xyz" * rng.randrange(40)]) for _ in range(rng.randrange(80))).encode()
        starts, hashes = w.words(text)
        want = text.lower().split()
        assert len(starts) == len(want) and all(text.lower()[s : s + len(x)] == x for s, x in zip(starts, want))
        assert [h == g for h in hashes for g in hashes] == [x == y for x in want for y in want]
    alone = w.words(b"word")[1][0]
    assert w.words(b"some other\tWORD\n")[1][2] == alone


def test_pack():
    rng = np.random.default_rng(1)
    arrays = [np.sort(rng.integers(0, 2**63, 50).astype(np.uint64)), np.empty(0, np.uint32), np.arange(7, dtype=np.int64)]
    kinds = [a.dtype for a in arrays]
    assert all((a == b).all() for a, b in zip(arrays, w.unpack(w.pack(*arrays), *kinds)))
    assert (np.cumsum(w.steps(arrays[0]), dtype=np.uint64) == arrays[0]).all()
