"""Session helpers."""

import pytest

from tallyspark.plans import session


@pytest.mark.parametrize(("given", "want"), [("64m", "4194304"), ("67108864b", "4194304"), ("1m", "1m"), ("1024", "1024")])
def test_batches_are_bounded(spark, given, want):
    old = spark.conf.get(session.BATCH_CONF)
    spark.conf.set(session.BATCH_CONF, given)
    try:
        session.bound_batches(spark)
        assert int(spark.conf.get(session.BATCH_CONF).rstrip("bm")) == int(want.rstrip("m"))
    finally:
        spark.conf.set(session.BATCH_CONF, old)


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = session.materialize(spark.range(5), "test")
    assert df.count() == 5 and df.dtypes == [("id", "bigint")]
    plain = lambda uri: uri.replace("file:///", "file:/")
    assert plain(df.inputFiles()[0]).startswith(plain(session.shared_dir(spark)))
    base = session.workspace(spark, "x")
    assert not session.exists(spark, base)
    spark.range(1).write.parquet(base)
    assert session.exists(spark, base)
    session.remove(spark, base)
    assert not session.exists(spark, base)


def test_code_is_shipped_once(spark):
    session.ship_code(spark)
    before = set(session._SHIPPED)
    session.ship_code(spark)
    assert set(session._SHIPPED) == before
