"""Spelling variants against a plain version, and the keys against the strings that they stand for."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import docs_rows
from pyspark.sql import functions as F

from tallyspark.llm import spelling

SF = "/root/testdata/sf0.001"
LOWER = {ord(a): a.lower() for a in spelling.UPPER}


def plain_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    """Whether one letter more, less or other makes the one the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    form, others = {}, {w: [v for v in counts if abs(len(v) - len(w)) < 2 and v != w and near(v, w)] for w in counts}
    for w, found in others.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(others[w]), counts.get(form[w])))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_equals_plain_version_on_documents(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows(spelling.query(spark, SF))
    assert got == plain(plain_counts(docs)) and any(r[1] for r in got)
    assert rows(spelling.query(spark, tables["odd"])) == plain(plain_counts([(r[0], r[1]) for r in docs_rows()]))


def variants(seed, size):
    """Words of few letters, many near each other, with counts of many sizes and ties."""
    r = random.Random(seed)
    words = {"".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(size)}
    return {w: r.choice([5, 5, 26, 130, 131, 700, 3500, 20_000]) for w in words} | {"z" * 7: 5, "z" * 8: 25, "z" * 9: 125, "z" * 10: 700, "z" * 12: 5}


def table_of(spark, counts):
    return spark.createDataFrame([(k, w, n) for k, (w, n) in enumerate(sorted(counts.items()))], "id bigint, word string, n bigint")


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_plain_version(spark, seed):
    counts = variants(seed, 400)
    got = rows(spelling.group(table_of(spark, counts)))
    assert got == plain(counts)
    assert next(r for r in got if r[0] == "z" * 7)[1:3] == ("z" * 8, "z" * 10)  # a chain


def test_colliding_keys_do_not_count(spark, monkeypatch):
    counts = variants(3, 60)

    def every(words):
        return words.mapInArrow(spelling._keys, spelling.KEYS).withColumn("key", F.lit(7).cast("long"))

    want = plain(counts)
    monkeypatch.setattr(spelling, "candidates", every)  # all keys are equal: only texts tell words apart
    assert rows(spelling.group(table_of(spark, counts))) == want


def test_keys_are_those_of_the_strings():
    words = ["abcdef", "aabbbbcc", "éééééé", "x" * 5000]
    key, ids, kind, at = spelling.deletion_keys(pa.array(words), np.arange(4))

    def whole(s):
        return spelling.deletion_keys(pa.array([s]), np.array([0]))[0][0]

    assert all(key[i] == whole(words[i]) for i in range(4))
    for k, i, d, p in list(zip(key, ids, kind, at, strict=True))[4:400]:
        if d == spelling.SHORTER:
            assert k == whole(words[i][:p] + words[i][p + 1 :])
    shorter = Counter(int(i) for i, d in zip(ids, kind, strict=True) if d == spelling.SHORTER)
    assert shorter == {0: 6, 1: 3, 2: 1, 3: 1}
    assert len(set(key[kind == spelling.PLACED].tolist())) == int((kind == spelling.PLACED).sum())


def test_runs_cross_batches():
    keys = sorted([1, 2, 2, 2, 3, 5, 5, 9])
    batches = [spelling._table(np.array([k]), np.array([i]), np.array([0], dtype=np.int8), np.array([0], dtype=np.int32)) for i, k in enumerate(keys)]
    assert [k for b in spelling._runs(iter(batches)) for k in b.column("key").to_pylist()] == [2, 2, 2, 5, 5]


def test_empty(spark):
    assert rows(spelling.group(spark.createDataFrame([], "id bigint, word string, n bigint"))) == []
