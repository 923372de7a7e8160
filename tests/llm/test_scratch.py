import os

import pytest

from batchloom.llm.scratch import Scratch, working


def there(table):
    return os.path.exists(table._batchloom_path.removeprefix("file://"))


def test_tables_go_with_their_block(spark):
    outer = Scratch(spark, "outer")
    with working():
        inner = Scratch(spark, "inner").keep(spark.range(5), "a")
        kept = outer.keep(inner.filter("id > 2"), "b")
        dropped = outer.keep(spark.range(3), "c")
        outer.drop(dropped)
        assert there(inner) and there(kept) and not there(dropped)
    assert not there(inner) and kept.count() == 2
    with pytest.raises(ZeroDivisionError), working():
        lost = Scratch(spark, "inner").keep(spark.range(5), "a")
        1 / 0
    assert not there(lost)
    outer.close()
    assert not there(kept)
