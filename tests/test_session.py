import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from locusmill import session


def test_written_tables(spark):
    df = spark.range(10).select("id", F.when(F.col("id") > 3, "x").alias("c"))
    one = session.cut(df)
    two = session.cut(one.where("id > 5"), after=one)
    path = two.written.removeprefix("file:")
    assert not os.path.exists(one.written.removeprefix("file:")) and os.path.exists(path)
    assert sorted(map(tuple, two.collect())) == [(i, "x") for i in range(6, 10)] and two.schema["c"].dataType.simpleString() == "string"
    assert session.cut(df.limit(0)).count() == 0
    session.remove(df)  # no table of its own: nothing happens
    session.remove_all(spark)
    assert not os.path.exists(path)


def test_broadcasts_are_checked_in_rows_and_bytes(spark):
    df = spark.range(1000)
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(session.broadcast_if_small(df)) and not hinted(session.broadcast_if_small(df, max_rows=999)) and not hinted(session.broadcast_if_small(df, max_bytes=10))
    kept = session.cut(df)
    assert session.broadcast_if_small(kept, max_rows=1) is kept
    session.remove_all(spark)


def test_a_cluster_must_name_its_folder():
    def fake(master):
        context = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=lambda f: None)
        return SimpleNamespace(sparkContext=context)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_folder(fake("local-cluster[3,2,3000]"))
    assert session.shared_folder(fake("local[4]"))
