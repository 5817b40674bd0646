import os

import pytest
from pyspark.sql import functions as F

from millrace.plans import session


def test_lookup(spark, monkeypatch):
    """A key that most rows have, one that few have, one without a partner, and null."""
    monkeypatch.setattr(session, "HOT", 1)
    rows = spark.createDataFrame([("a", i % 3, i) for i in range(90)] + [("b", 1, 200), ("b", 1, 201), ("c", 1, 300), (None, 1, 400)], "k string, l int, id int")
    table = spark.createDataFrame([("a", 0, 30, "x", 1), ("a", 1, 30, "y", 2), ("b", 1, 2, "z", None), ("d", 1, 9, "w", 4)], "k string, l int, n int, v string, u int")
    got = session.lookup(rows, table, ["k", "l"], "n", ["id"])
    told = rows.join(table.drop("n"), ["k", "l"], "left").select(*got.columns)
    assert got.columns == ["k", "l", "id", "v", "u"]
    assert sorted(map(str, got.collect())) == sorted(map(str, told.collect()))
    assert session.lookup(rows, table.limit(0), ["k", "l"], "n", ["id"]).filter("v is not null").count() == 0
    assert session.lookup(rows.limit(0), table, ["k", "l"], "n", ["id"]).count() == 0


def test_scratch_is_removed(spark):
    folder = session.scratch_folder(spark)
    with session.scratch(spark):
        kept = session.materialize(spark.range(5), "some")
        assert kept.count() == 5
        with session.scratch(spark):
            session.materialize(spark.range(3), "inner")
        assert not [f for f in os.listdir(folder) if f.startswith("inner-")]
        assert kept.agg(F.sum("id")).first()[0] == 10
    assert not [f for f in os.listdir(folder) if f.startswith("some-")]
    assert session.materialize(spark.range(2), "later").count() == 2


def test_cluster_needs_a_shared_folder(spark):
    assert session.shared_folder(spark)
    with pytest.raises(ValueError):
        class Context:
            master = "local-cluster[1,1,512]"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        class Conf:
            get = staticmethod(lambda *_: None)

        class Session:
            conf, sparkContext = Conf, Context  # noqa: N815

        session.shared_folder(Session)
