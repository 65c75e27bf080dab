import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_rows import PAGES, SCHEMA, docs_rows, page_rows, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(docs_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory, odd_docs, no_docs):
    """Folders of tables: ``odd`` with rows of every kind, ``none`` with empty tables."""
    out = {}
    bench = [(1, " ".join(prose(3, 30_000).split()[100:130])), (2, prose(77, 20)), (3, None), (4, ""), (5, "two words"), (1, " ".join(prose(3, 30_000).split()[100:130]))]
    labels = [(1, 1, 0), (2, 0, 1), (3, 0, 0), (9, None, None), (8, 0, None)]
    pages = [(*p, *["clash"] * 5) for p in page_rows()]
    for name, frames in {
        "odd": (odd_docs, spark.createDataFrame(bench, "item_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), spark.createDataFrame(pages, PAGES)),
        "none": (no_docs, *[spark.createDataFrame([], s) for s in ("item_id bigint, text string", "doc_id bigint, quality int, toxic int", PAGES)]),
    }.items():
        path = tmp_path_factory.mktemp(name)
        for table, frame in zip(("documents", "benchmark", "labels", "pages"), frames, strict=True):
            frame.write.parquet(f"{path}/{table}.parquet")
        out[name] = str(path)
    return out
