import os

import pytest

from millrace.llm.staging import discard, fresh_name, shared_dir, stage, temporary


def files(df):
    return os.path.exists(df._staged_at.removeprefix("file://"))


def test_temporary_tables_are_deleted_but_for_what_is_kept(spark):
    with temporary(spark) as tables:
        a, b = stage(spark.range(3), "a"), tables.keep(stage(spark.range(4), "b"))
        with temporary(spark):
            c = stage(spark.range(5), "c")
        assert files(a) and not files(c)
    assert not files(a) and files(b) and b.count() == 4
    with pytest.raises(RuntimeError), temporary(spark):
        d = stage(spark.range(3), "d")
        raise RuntimeError
    assert not files(d)
    discard(b)
    assert not files(b)


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`__Hash` int, `__hash_` int")
    assert fresh_name(df, "hash") == "__hash__" and fresh_name(df, "key") == "__key"
    assert shared_dir(spark).startswith("file:")
