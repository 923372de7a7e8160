"""The pipeline against plain versions of its stages, on planted documents."""

import random

import pytest
import sentencepiece

import corpus_pipeline
from batchloom.llm import queries
from batchloom.llm.pieces import MODEL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n, letters="etaoinshr": " ".join("".join(rng.choices(letters, k=rng.randrange(2, 9))) for _ in range(n))
    items = [(i, prose(40)) for i in range(5)]
    base = prose(300)
    near = base.replace(base.split()[50], "changed", 1)
    clean = [(i, prose(rng.randrange(5, 200))) for i in range(40)]
    rows = clean + [(100, base), (101, "  ".join(base.split(" "))), (102, near), (103, base), (104, None), (105, "12 34"), (106, ""), (107, prose(90) + " " + items[2][1]), (108, prose(20) + items[4][1] + prose(20)), (3, clean[3][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), dict(rows)


def test_run(spark, folder):
    path, texts = folder
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert sorted(found) == [*range(40), 101]  # 101 has the most code points of the equal texts, and 102 is near it
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(found[i].ids == library.encode(texts[i]) and found[i].n_tokens == len(found[i].ids) and found[i].round_trip for i in found)


def test_stages_keep_the_columns_of_documents(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, path)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(f"{path}/stage-{k}")
        docs = spark.read.parquet(f"{path}/stage-{k}")
        counts.append(docs.count())
    assert counts == [47, 44, 43, 41]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{n}" for n in range(1, 11)} and list(corpus_pipeline.queries()) == ["pipeline"]
    assert set(queries.oracle_sql()) <= set(queries.queries())
