"""The pipeline against a plain version of its stages."""

import re

import public_tokenizers
from conftest_rows import docs_rows
from test_llm_operators import brute_join, shingle_set

import corpus_pipeline
from tallyspark.llm import pieces


def test_stages_keep_columns_and_drop_what_they_should(spark, tables):
    docs = spark.read.parquet(f"{tables['odd']}/documents.parquet")
    columns = docs.columns
    kept = [docs_rows()]
    # No language that is learned has the n-grams of a run of one letter.
    rows = [r for r in docs_rows() if r[1] and any(c.isalpha() for c in r[1]) and r[0] != 11]
    kept.append(rows)
    classes = {d: c for d, c, _ in brute_join([r[:2] for r in rows]) if d is not None}
    once = {r[0]: r for r in rows if r[0] is not None and classes[r[0]] == r[0]}
    kept.append([*once.values(), *[r for r in rows if r[0] is None]])
    item = set(shingle_set(" ".join(re.findall(r"\w+", " ".join(docs_rows()[12][1].split()[100:130]).lower()))))
    kept.append([r for r in kept[-1] if r[0] not in (9, 10)])
    assert item
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], kept[1:], strict=True):
        docs = stage(spark, docs, tables["odd"]).cache()
        assert docs.columns == columns
        told = docs.collect()
        assert sorted((tuple(r)[:2] + tuple(r)[3:] for r in told), key=str) == sorted((r[:2] + r[3:] for r in want), key=str)
        assert {r.lang for r in told} <= {"en", "fr", "de"}
    last = corpus_pipeline.STAGES[3][1](spark, docs, tables["odd"])
    assert "ids" in last.columns and last.count() == len(kept[-1])
    back = pieces.decode(last, public_tokenizers.path(pieces.MODEL), keep=["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r[0]), r[1].replace("▁", " ")) for r in kept[-1])


def test_language_stage_goes_by_its_prediction(spark, monkeypatch):
    from conftest_rows import prose

    french = lambda k: " ".join(w[::-1] + "é" for w in prose(k, 60).split())
    rows = [(k, prose(k, 60), "en") for k in range(30)] + [(100 + k, french(k), "fr") for k in range(30)]
    rows += [(200, prose(99, 60), "fr"), (201, "Привет мир, это другой язык. " * 20, None), (202, french(99), None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    told = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert told == {k: "en" for k in range(30)} | {100 + k: "fr" for k in range(30)} | {200: "en", 202: "fr"}
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("fr",))
    assert {r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {"fr"}


def test_run_is_the_stages_in_turn(spark, tables):
    docs = spark.read.parquet(f"{tables['odd']}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables["odd"])
    assert sorted(map(str, corpus_pipeline.run(spark, tables["odd"]).collect())) == sorted(map(str, docs.collect()))


def test_empty_documents(spark, tables):
    assert corpus_pipeline.run(spark, tables["none"]).collect() == []
