import functools
import random

import pytest
import sentencepiece
from pyspark.sql import types as T

from batchloom.llm.pieces import MODEL, SPACE, Lattice, Vocabulary, encode_decode, product

VOCABULARY = Vocabulary.load()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def stored(spark, tmp_path, rows, schema="doc_id long, text string, ids string, row string"):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_words_equal_the_library():
    lattice = Lattice(VOCABULARY)
    random.seed(3)
    for _ in range(2000):
        text = "".join(random.choice(" ▁ab\nthe①中文é\t<0x0A>😀　") for _ in range(random.randint(0, 40)))
        ids = lattice.encode(text).tolist()
        assert ids == LIBRARY.encode(text)
        assert lattice.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("chunk", [5, 64])
def test_chunks_equal_the_library(spark, tmp_path, chunk):
    random.seed(4)
    texts = ["", None, "a", " " * 300, "aaaa" * 200, "the " * 100, "no_space_at_all" * 50, "中文①\n" * 40]
    texts += ["".join(random.choice("ab the\n é") for _ in range(300)) for _ in range(5)]
    rows = [(i if i else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(2, "a", None, None)]
    found = encode_decode(stored(spark, tmp_path, rows), giant=chunk, chunk=chunk).collect()
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in found) == sorted((i or 0, tuple(LIBRARY.encode(t or ""))) for i, t, *_ in rows)
    assert all(r.round_trip for r in found)


def test_products_are_associative():
    """However the chunks of a text are grouped, their product is the matrix of the whole."""
    lattice = Lattice(VOCABULARY)
    random.seed(6)
    for _ in range(20):
        text = SPACE + "".join(random.choice("ab▁the") for _ in range(60))
        cuts = [0, *sorted(random.sample(range(1, 60), 4)), len(text)]
        parts = [lattice.transfer(text, lo, hi) for lo, hi in zip(cuts, cuts[1:])]
        left = functools.reduce(product, parts)
        right = functools.reduce(lambda b, a: product(a, b), reversed(parts))
        assert (left == right).all() and (left == product(product(parts[0], parts[1]), product(parts[2], product(parts[3], parts[4])))).all()
        assert (left == lattice.transfer(text, 0, len(text))).all()


def test_empty_table(spark, tmp_path):
    assert encode_decode(stored(spark, tmp_path, [])).schema["ids"].dataType == T.ArrayType(T.IntegerType())
    assert encode_decode(stored(spark, tmp_path / "x", [])).count() == 0
