"""Corpus pipeline: language identification, near-duplicate removal, decontamination, tokenization.

Every stage takes the documents that its predecessor kept, whole, and returns the columns of
documents; the last one returns each document's piece ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontam, langid, pieces, simjoin
from tallyspark.plans.session import materialize
from tallyspark.plans.tables import table

#: Languages whose documents stay (None: all that are learned), and the least share of a document's
#: n-grams that its language must have; less is a language that nothing was learned of.
LANGUAGES: tuple[str, ...] | None = None
MIN_FIT = 0.25
#: Ids of documents to drop are broadcast up to this count (8 bytes each), else joined by shuffle.
BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """The rows whose doc_id isn't among ``ids``; rows without an id stay."""
    ids = materialize(ids, label)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are told to be in one of ``LANGUAGES``; lang becomes the language told.

    Rejected are texts that are null or have no letter, texts of other languages, and texts whose
    n-grams the learned languages hardly have (``MIN_FIT``). Repeated rows stay or go together; null
    ids don't matter; an empty table gives no row. Without any labelled text nothing can be learned:
    then every text with a letter stays as it is.
    """
    model = langid.learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = ("__language", "__score", "__fit")
    told = langid.predict(docs, model, to=names).where((F.col("__language") != langid.UNKNOWN) & (F.col("__fit") >= MIN_FIT))
    if LANGUAGES is not None:
        told = told.where(F.col("__language").isin(*LANGUAGES))
    return told.withColumn("lang", F.col("__language")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group that links of 0.8 or more connect.

    Of rows that repeat a doc_id one stays. Rows without a doc_id can't be named and stay.
    """
    found = materialize(simjoin.join(docs), "near-duplicates")
    by_id = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("class_id")).cast("int")).alias("kept"), F.count("*").alias("n"))
    kept = _without(docs, by_id.where("coalesce(kept, 0) = 0").select("doc_id"), "near-duplicate-ids")
    if by_id.where("n > 1").isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(kept.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item to 0.8 or more.

    Rows that repeat an id go together, by the worst of them. Rows without an id can't be named and
    stay. Empty tables on either side drop nothing.
    """
    found = decontam.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("doc_id IS NOT NULL").select("doc_id").distinct(), "contaminated-ids")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and ids of each document. Repeated rows and null ids stay rows of their own; an empty table gives none."""
    return pieces.encode(docs, public_tokenizers.path(pieces.MODEL), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: A Bloom filter and a Viterbi search are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
