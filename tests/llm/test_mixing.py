"""The weighted mix against its SQL and against the rules that it must keep."""

import duckdb
import pytest
from conftest_rows import SCHEMA

from tallyspark.llm import mixing

SF = "/root/testdata/sf0.001"


def by_sql(folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet" + ("/*.parquet')" if folder != SF else "')"))
    cursor = db.execute(mixing.SQL)
    return [d[0] for d in cursor.description], cursor.fetchall()


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("ranges", [20_000, 7])
def test_equals_sql(spark, tables, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    for folder in (SF, tables["odd"]):
        names, want = by_sql(folder)
        got = mixing.query(spark, folder)
        assert sorted(got.columns) == sorted(names)
        assert order(tuple(r) for r in got.select(*names).collect()) == order(want)


def plain_targets(sizes, weights, most):
    """Shares by weight; what is above the most goes to the others, until none is above."""
    total, left, target = sum(sizes), set(range(len(sizes))), {}
    while True:
        room = total - sum(target.values())
        weight = sum(weights[i] for i in left)
        above = {i for i in left if room * weights[i] / weight > most * sizes[i]} if left else set()
        if not above:
            return [target.get(i, room * weights[i] / weight if weight else 0) for i in range(len(sizes))]
        left -= above
        target |= {i: most * sizes[i] for i in above}


@pytest.mark.parametrize("sizes", [[5, 1000, 7, 400, 90, 2], [10, 10, 10], [1, 0, 10_000], [3], [0, 0]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"0{k}", s) for k, s in enumerate(sizes)], "key string, source_size bigint")
    got = [r.target for r in mixing.targets(rows).orderBy("key").collect()]
    weights = [k % 3 + 1 for k in range(len(sizes))]
    assert got == pytest.approx(plain_targets(sizes, weights, 3))


def documents(spark):
    """A source of a third of the rows, one of a single very long document, one of hardly any words, a null one."""
    rows = [(k, "w " * (k % 40 + 1), "hot") for k in range(300)]
    rows += [(1000, "v " * 60_000, "long"), (1001, "v v", "long")]
    rows += [(2000 + k, "u", "small") for k in range(9)]
    rows += [(3000 + k, "t " * 25, None) for k in range(200)] + [(None, None, "hot"), (None, "", None)]
    return spark.createDataFrame([(i, t, "en", s, 0, *["clash"] * (len(SCHEMA.split(",")) - 5)) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("ranges", [20_000, 11])
def test_each_source_comes_near_its_target(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    docs = documents(spark)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    assert sum(r.taken for r in rows) == total
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(mixing.LEAST_PACKET, own[0].target / 1000)
    assert all(r.taken == 3 * r["size"] for r in rows if r.source in ("small",))
    assert order(tuple(r) for r in mixing.mixed(docs.repartition(7)).collect()) == order(tuple(r) for r in rows)


def test_the_sequence_follows_virtual_time(spark):
    queued = mixing.queues(documents(spark), mixing.n_words(mixing.F.col("text")))
    rows = mixing.sequence(queued, budget=30_000).orderBy("at").collect()
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    ends = 0
    for r in rows:  # no gap and no overlap
        assert r.at == ends
        ends += r.taken
    assert ends == 30_000
    half = [r for r in rows if r.at < 15_000]  # sources advance together
    for key in {r.key for r in rows}:
        assert sum(r.taken for r in half if r.key == key) == pytest.approx(sum(r.taken for r in rows if r.key == key) / 2, abs=600)


def test_no_python_runs(spark):
    plan = mixing.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
