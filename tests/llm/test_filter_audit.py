"""The audit of filters against its SQL, and the inversion of parity sums against plain counts."""

import random
from collections import Counter

import duckdb
import pytest

from tallyspark.llm import filter_audit as audit

SF = "/root/testdata/sf0.001"


def by_sql(folder):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet" + ("/*.parquet')" if folder != SF else "')"))
    cursor = db.execute(audit.SQL)
    return [d[0] for d in cursor.description], sorted(cursor.fetchall())


def test_equals_sql(spark, tables):
    for folder in (SF, tables["odd"]):
        names, want = by_sql(folder)
        got = audit.query(spark, folder)
        assert sorted(got.columns) == sorted(names)
        rows = sorted(tuple(r) for r in got.select(*names).collect())
        assert rows == want and len(rows) % 600 == 0


@pytest.fixture(scope="module")
def drawn(spark):
    r = random.Random(5)
    rows = [(r.choice(["", "p", "hot", "hot", "hot"]), r.choice([0, 0, r.randrange(32), 31]), r.random() < 0.4, r.random() < 0.1) for _ in range(3000)]
    return rows, spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")


def test_parity_sums_give_the_cells_back(drawn):
    rows, masked = drawn
    want = {p: [[0] * 32 for _ in range(3)] for p, *_ in rows}
    for part, m, good, toxic in rows:
        for k, on in enumerate((True, good, toxic)):
            want[part][k][m] += on
    got = {r.part: [r.n, r.good, r.toxic] for r in audit.cells(audit.parity_sums(masked)).collect()}
    assert got == want


def test_steps_equal_filtering_in_order(drawn):
    rows, masked = drawn
    shapley, want = Counter(), {}
    for name in audit.ORDERS:
        left = {p: [r for r in rows if r[0] == p] for p in {r[0] for r in rows}}
        for step, f in enumerate(name, 1):
            bit = 1 << "ABCDE".index(f)
            for p, here in left.items():
                own = [r for r in rows if r[0] == p]
                gone = [r for r in here if r[1] & bit]
                left[p] = [r for r in here if not r[1] & bit]
                failing = sum(1 for r in own if r[1] & bit)
                want[p, name, step] = [len(left[p]), len(gone), failing - len(gone), sum(r[1] == bit for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                shapley[p, f] += len(gone)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.steps(audit.cells(audit.parity_sums(masked))).collect()}
    assert got == {k: [*v[:6], shapley[k[0], v[6]]] for k, v in want.items()}


def test_copies_count_from_the_least_id(spark):
    docs = spark.createDataFrame([(7, "x", "a"), (3, "x", "b"), (3, "x", "b"), (None, "x", "b"), (9, None, "b"), (8, "", "b"), (None, "z", None)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = sorted((r.part, r.mask >> 4) for r in audit.masks(docs, labels).collect())
    assert rows == [("", 0), ("a", 1), ("b", 0), ("b", 0), ("b", 0), ("b", 0), ("b", 1)]
