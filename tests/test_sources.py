import random
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from batchloom.sources import sinks
from batchloom.sources.flat import Dialect, Field, Layout, composite, delimited, delimited_flexible, fixed_width, items


def write(tmp_path, data: bytes, name="in.txt") -> str:
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_basic_records(spark, tmp_path):
    good, bad = delimited(spark, write(tmp_path, b"a,b,c\nd,e,f\n"), ["x", "y", "z"])
    assert rows(good) == [("a", "b", "c"), ("d", "e", "f")]
    assert bad.count() == 0


@pytest.mark.parametrize(("delimiter", "names", "expected"), [(",", ["x", "y"], ("a;b", "c")), (";", ["x", "y"], ("a", "b,c"))])
def test_delimiter_moves_the_borders(spark, tmp_path, delimiter, names, expected):
    good, _ = delimited(spark, write(tmp_path, b"a;b,c\n"), names, Dialect(delimiter=delimiter))
    assert rows(good) == [expected]


def test_header_is_no_item(spark, tmp_path):
    good, _ = delimited(spark, write(tmp_path, b"name,age\nAlice,30\n"), ["name", "age"], Dialect(header=True))
    assert [r["age"] for r in good.collect()] == ["30"]


def test_quotes(spark, tmp_path):
    good, _ = delimited(spark, write(tmp_path, b'"a,b","say ""hi"""\n"two\nlines",x\n'), ["x", "y"])
    assert rows(good) == [("a,b", 'say "hi"'), ("two\nlines", "x")]


def test_ragged_and_broken_records_are_malformed(spark, tmp_path):
    good, bad = delimited(spark, write(tmp_path, b"1,a\n2,b\nBAD\n3,c\n4,d,e\n5,\xff\n"), ["id", "v"])
    assert rows(good) == [("1", "a"), ("2", "b"), ("3", "c")]
    assert bad.count() == 3


def test_record_bound_is_in_bytes(spark, tmp_path):
    good, bad = delimited(spark, write(tmp_path, "é,é\na,b\n".encode()), ["x", "y"], Dialect(max_record_bytes=4))
    assert rows(good) == [("a", "b")] and bad.count() == 1


def test_flexible_keeps_ragged_records(spark, tmp_path):
    found = delimited_flexible(spark, write(tmp_path, b'a,"b,c"\r\nd\n'))
    assert [r["fields"] for r in found.collect()] == [["a", "b,c"], ["d"]]


def test_fixed_width_is_in_bytes(spark, tmp_path):
    layout = Layout((Field(1, "id"), Field(1, "v")))
    good, bad = fixed_width(spark, write(tmp_path, b"1a\n2b\nBAD\n3c\r\n4d"), layout)
    assert rows(good) == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")]
    assert bad.count() == 1
    cut, broken = fixed_width(spark, write(tmp_path, "aé\n".encode(), "cut.txt"), Layout((Field(2), Field(1))))
    assert cut.count() == 0 and broken.count() == 1


def test_positions_and_restarts_do_not_depend_on_splits(spark, tmp_path):
    lines = [f'{i},"v{i}' + ("\nmore" * (i % 3) if i % 5 == 0 else "") + '"' for i in range(400)]
    for k in range(2):
        write(tmp_path, ("id,v\n" + "\n".join(lines[k * 200 : k * 200 + 200]) + "\n").encode(), f"part-{k}.csv")
    want = [(str(i), f"v{i}" + ("\nmore" * (i % 3) if i % 5 == 0 else "")) for i in range(400)]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    places = []
    try:
        for size in ("700b", kept):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            good, bad = delimited(spark, f"{tmp_path}/part-*.csv", ["id", "v"], Dialect(header=True), position=True)
            found = good.orderBy("pos").collect()
            assert [(r["id"], r["v"]) for r in found] == want and bad.count() == 0
            places.append([r["pos"] for r in found])
            again, _ = delimited(spark, f"{tmp_path}/part-*.csv", ["id", "v"], Dialect(header=True), start=found[150]["pos"], position=True)
            assert [r["id"] for r in again.orderBy("pos").collect()] == [str(i) for i in range(150, 400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert places[0] == places[1]
    good, bad = fixed_width(spark, write(tmp_path, b"ab\n\ncd\nx\nef", "f.txt"), Layout((Field(1), Field(1))), start=1, position=True)
    assert [(r["pos"], r["f0"]) for r in good.orderBy("pos").collect()] == [(2, "c"), (4, "e")]
    assert [(r["pos"], bytes(r["record"])) for r in bad.orderBy("pos").collect()] == [(1, b""), (3, b"x")]


def test_valid_replacement_characters_are_no_faults(spark, tmp_path):
    good, bad = delimited(spark, write(tmp_path, "\ufffd,b\n".encode() + b"\xff,b\n"), ["x", "y"])
    assert rows(good) == [("\ufffd", "b")] and bad.count() == 1


def test_a_quote_left_open_is_bounded(spark, tmp_path):
    text = b'a,b\n"open,c\n' + b"x,y\n" * 500
    good, bad = delimited(spark, write(tmp_path, text), ["x", "y"], Dialect(max_record_bytes=100))
    assert rows(good) == [("a", "b")] and rows(bad) == [(None,)]
    good, bad = delimited(spark, write(tmp_path, text), ["x", "y"], Dialect(quoted_line_ends=False))
    assert good.count() == 501 and rows(bad) == [('"open,c',)]


def test_many_quoted_fields(spark, tmp_path):
    for n in (1, 2000, 100_000):
        found = delimited_flexible(spark, write(tmp_path, (",".join(['"a,""b"'] * n) + ',"x"y,,\n').encode())).first()
        assert found["fields"] == ['a,"b'] * n + ['"x"y', "", ""]
    assert rows(delimited_flexible(spark, write(tmp_path, b"\n|\n"), Dialect(delimiter="|")).select("fields")) == [([""],), (["", ""],)]


def test_layouts_and_dialects_are_checked():
    with pytest.raises(ValueError):
        Layout(())
    with pytest.raises(ValueError):
        Dialect(delimiter='"')


def test_composite_keeps_declared_order(spark):
    both = composite(items(spark, ["a", "b"]), items(spark, ["c"])).orderBy("source_ordinal", "pos")
    assert [r["value"] for r in both.collect()] == ["a", "b", "c"]


def test_committed_chunks_and_restart(spark, tmp_path):
    path = str(tmp_path / "sink")
    df = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "chunk_id long, v string")
    write_csv = lambda w, p: w.csv(p)
    with pytest.raises(RuntimeError):
        sinks.committed_paths(spark, path, "one")

    def broken(w, p):
        w.csv(p)
        raise RuntimeError("lost before the manifest")

    with pytest.raises(RuntimeError, match="lost"):
        sinks.write_chunks(df, path, "one", broken, 1)
    sinks.write_chunks(df, path, "one", write_csv, 1)
    assert spark.read.csv(sinks.committed_paths(spark, path, "one")).count() == 3
    sinks.write_chunks(df, path, "one", broken)  # committed already: nothing is written
    import shutil

    shutil.rmtree(f"{path}/data-one/batch=1")
    with pytest.raises(RuntimeError, match="missing"):
        sinks.write_chunks(df, path, "one", write_csv)


def test_a_changed_input_or_folder_is_no_commit(spark, tmp_path):
    path = str(tmp_path / "sink")
    drawn = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    moving = spark.range(5000).withColumn("chunk_id", F.col("id") % 3).filter(drawn() < 0.5)
    with pytest.raises(RuntimeError, match="changed meanwhile"):
        sinks.write_chunks(moving, path, "one", lambda w, p: w.csv(p), 1)
    with pytest.raises(RuntimeError):
        sinks.committed_paths(spark, path, "one")
    steady = spark.range(9).withColumn("chunk_id", F.col("id") % 3)
    sinks.write_chunks(steady, path, "one", lambda w, p: w.csv(p), 1)
    assert sinks.verify(spark, path, "one").count() == 3
    (tmp_path / "sink/data-one/batch=1/part-more.csv").write_bytes(b"x")
    with pytest.raises(RuntimeError, match="was changed"):
        sinks.verify(spark, path, "one")


def test_delegates_are_called_by_one_at_a_time(spark):
    inside, most, got = [], [], []

    def delegate(x):
        inside.append(x)
        most.append(len(inside))
        time.sleep(0.001)
        inside.remove(x)
        return x

    one = sinks.Synchronized(delegate)
    with ThreadPoolExecutor(8) as threads:
        assert sorted(threads.map(one, range(40))) == list(range(40))
    assert max(most) == 1
    sinks.one_writer(spark.range(100).repartition(4), lambda part: got.append(part.count()))
    assert len(got) == 4 and sum(got) == 100
    sinks.discard(spark.range(10).withColumn("n", F.assert_true(F.col("id") < 10)))
    with pytest.raises(Exception):
        sinks.discard(spark.range(10).withColumn("n", F.assert_true(F.col("id") < 9)))


def test_unknown_class_fails(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("z", 2)], "k string, v long")
    with pytest.raises(Exception, match="no writer for class z"):
        sinks.classified(df, "k", ["a", "b"], str(tmp_path / "out"))


def test_fixed_lines_never_pad(spark):
    df = spark.createDataFrame([("ab", "c")], "a string, b string")
    assert sinks.fixed_lines(df, ["a", "b"], Layout((Field(2), Field(1)))).first()["line"] == "abc"
    with pytest.raises(Exception, match="has not 3 bytes"):
        sinks.fixed_lines(df, ["a", "b"], Layout((Field(3), Field(1)))).collect()
