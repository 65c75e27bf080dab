"""Spelling variants: words that differ by one letter, grouped under their most frequent form.

Two words of one length differ in one letter at place i if and only if they are alike without it, and
a word is another one with a letter more if leaving out that letter gives it. So that every word gives
hashes of itself and of what is left without each of its letters: rolling hashes of what comes before
and after the letter, added, for all words and places of a batch by a few array operations. Keys
(integers) are dealt by their first bits and sorted; runs of equal keys name words that may be near.
Only these get their strings back, and what is left of them is compared as text, so that collisions of
hashes count nowhere.

Within a run every word learns the number of the others and the best of them, never all pairs. A run
holds words that differ in one place, so that it is no longer than the alphabet (times the word's
length, for words with a letter more).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.textvec import mix
from tallyspark.plans.session import materialize, ship_code
from tallyspark.plans.tables import table

#: Letters of a run, and those that are lower-cased.
LETTERS = "[a-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of so many runs of a document loses a letter.
NOISE = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: Letters that one pass of array operations takes at most; a longer word is a pass of its own.
PASS_LETTERS = 1 << 18
#: Keys of a task, about, and the bits of a key that deal it.
TASK_KEYS = 2_000_000
RADIX_BITS = 16
#: Chains of forms are followed by doubling; each form occurs RATIO times as often as the one before.
MAX_ROUNDS = 6
#: Links of words to forms up to this count are broadcast (two numbers each), else joined by shuffle.
BROADCAST_ROWS = 200_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = np.uint64(0xC2B2AE3D27D4EB4F)
#: What a key stands for: the word itself, the word without a letter, or that and the letter's place.
WHOLE, SHORTER, PLACED = 0, 1, 2
KEYS = "key bigint, id bigint, kind tinyint, at int"


def noisy_runs(docs: DataFrame) -> DataFrame:
    """word: each run of letters, lower-cased from A to Z, some of them without a letter, of ``LEAST_LENGTH`` letters or more.

    Null texts have none; a null id is written as nothing.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    each = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("name"), F.explode(runs).alias("run"))
    n = F.char_length("run")
    drawn = each.where(n >= LEAST_LENGTH).withColumn("h", F.crc32(F.concat("name", "run")))
    at = (F.col("h") % n).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return drawn.select(F.when(F.col("h") % NOISE == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_LENGTH)


def frequent(runs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """id, word, n of the words that occur often enough; ids are kept by the table that this writes."""
    counted = runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return materialize(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")


def deletion_keys(words: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, kind, place) of words in Latin letters: of each whole, without each letter, and without each letter of its place.

    Of a run of one letter only the last is left out for words of another length, since the others
    give the same.
    """
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    letters = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(letters)) - starts[row]
    powers = np.ones(int(sizes.max(initial=0)), dtype=np.uint64)
    powers[1:] = _BASE
    np.multiply.accumulate(powers, out=powers)
    terms = letters * powers[at]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
    before = sums[:-1] - sums[starts[row]]  # the hash of what comes before the letter
    after = (sums[ends[row]] - sums[1:]) * _INVERSE  # of what comes after, moved up by one place
    rest = before + after
    left = sizes[row] - 1
    whole = mix((sums[ends] - sums[starts]) ^ mix(sizes.astype(np.uint64)))
    shorter = mix(rest ^ mix(left.astype(np.uint64)))
    placed = mix(shorter + (at.astype(np.uint64) + np.uint64(1)) * _PLACE)
    last = np.ones(len(letters), dtype=bool)
    last[:-1] = (letters[1:] != letters[:-1]) | (at[1:] == 0)
    key = np.concatenate([whole, shorter[last], placed])
    kind = np.repeat(np.array([WHOLE, SHORTER, PLACED], dtype=np.int8), [len(whole), int(last.sum()), len(placed)])
    place = np.concatenate([np.zeros(len(whole), dtype=np.int64), at[last], at]).astype(np.int32)
    return key.view(np.int64), np.concatenate([ids, ids[row[last]], ids[row]]), kind, place


def _table(key, ids, kind, place) -> pa.RecordBatch:
    return pa.record_batch([pa.array(key), pa.array(ids), pa.array(kind), pa.array(place)], names=["key", "id", "kind", "at"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids = batch.column("word"), batch.column("id").to_numpy()
        sizes = np.cumsum(np.fromiter((len(w) for w in words.to_pylist()), dtype=np.int64, count=len(words)))
        row = 0
        while row < len(words):
            end = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + PASS_LETTERS, "right")))
            yield _table(*deletion_keys(words.slice(row, end - row), ids[row:end]))
            row = end


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key has company; the last run of a batch waits for the next one."""
    held = None
    for batch in batches:
        rows = [batch.column(k).to_numpy() for k in range(4)]
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
        key = rows[0]
        if not len(key):
            continue
        firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cut = firsts[-1]
        held = [c[cut:] for c in rows]
        sizes = np.diff(firsts)
        keep = np.repeat(sizes > 1, sizes)
        if keep.any():
            yield _table(*[c[:cut][keep] for c in rows])
    if held is not None and len(held[0]) > 1:
        yield _table(*held)


def candidates(words: DataFrame) -> DataFrame:
    """key, id, kind, at of the keys that more than one word or place has: radix-partitioned, sorted, and read in runs."""
    spark = words.sparkSession
    ship_code(spark)
    letters = words.agg(F.coalesce(F.sum(F.char_length("word")), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-2 * letters // TASK_KEYS))
    keys = words.select("id", "word").mapInArrow(_keys, KEYS)
    dealt = keys.repartition(tasks, F.shiftrightunsigned("key", 64 - RADIX_BITS)) if tasks <= 1 << (RADIX_BITS - 4) else keys.repartition(tasks, "key")
    return dealt.sortWithinPartitions("key").mapInArrow(_runs, KEYS)


def _best(n: str, word: str) -> Column:
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"), F.col("id").alias("id"))


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near and best (less: minus its n, word, id) of the words that have near words.

    Candidates are compared as texts: rows meet by what is left of the word, and those of one length
    by the place too.
    """
    found = materialize(candidates(words), "spelling-candidates")
    named = found.join(words, "id")
    rest = F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(F.concat(F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2)))
    checked = named.select("key", "id", "kind", F.when(F.col("kind") == PLACED, F.col("at")).otherwise(-1).alias("at"), rest.alias("rest"), "n", _best("n", "word").alias("own"))
    run = W.partitionBy("key", "at", "rest")
    whole, shorter, placed = (F.col("kind") == k for k in (WHOLE, SHORTER, PLACED))
    ranked = checked.withColumn("size", F.count("*").over(run)).where("size > 1").withColumns({
        "of_whole": F.min(F.when(whole, F.col("own"))).over(run),
        "of_longer": F.min(F.when(shorter, F.col("own"))).over(run),
        "n_longer": F.sum(shorter.cast("long")).over(run),
        "order": F.row_number().over(run.orderBy("own")),
        "first": F.min("own").over(run),
    })
    ranked = ranked.withColumn("next", F.min(F.when(F.col("order") == 2, F.col("own"))).over(run))
    other = F.when(placed, F.when(F.col("order") == 1, F.col("next")).otherwise(F.col("first"))).when(whole, F.col("of_longer")).otherwise(F.col("of_whole"))
    number = F.when(placed, F.col("size") - 1).when(whole, F.col("n_longer")).otherwise(F.when(F.col("of_whole").isNotNull(), 1).otherwise(0))
    told = ranked.select("id", other.alias("best"), number.cast("long").alias("n_near")).where("best IS NOT NULL")
    return told.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _followed(links: DataFrame) -> DataFrame:
    """id and tip (a row's last form) from links id, tip to the next one, by pointer doubling."""
    tips = links
    for _ in range(MAX_ROUNDS):
        further = tips.select(F.col("id").alias("tip"), F.col("tip").alias("beyond"))
        further = F.broadcast(further) if tips.count() <= BROADCAST_ROWS else further
        joined = materialize(tips.join(further, "tip", "left"), "spelling-tips")
        if joined.where("beyond IS NOT NULL").isEmpty():
            break
        tips = joined.select("id", F.coalesce("beyond", "tip").alias("tip"))
    return tips


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words (id, word, n).

    A word's form is its near word of largest n, the first in code-point order of equal ones, if that
    is at least ``ratio`` times the word's n; root is the last form that following forms gives, the
    word itself if it has none. An empty table gives no row.
    """
    if ratio < 2:
        raise ValueError("forms must occur at least twice as often as their variants")
    best = F.struct(F.col("best.word").alias("word"), (-F.col("best.less")).alias("n"), F.col("best.id").alias("id"))
    near = words.join(neighbours(words).select("id", "n_near", best.alias("b")), "id", "left")
    formed = materialize(near.withColumn("form", F.when(F.col("b.n") >= ratio * F.col("n"), F.col("b"))).select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form"), "spelling-forms")
    tips = _followed(formed.where("form IS NOT NULL").select("id", F.col("form.id").alias("tip")))
    names = formed.select(F.col("id").alias("tip"), F.col("word").alias("root"))
    roots = tips.join(names, "tip").select("id", "root")
    return formed.join(roots, "id", "left").select("word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(frequent(noisy_runs(table(spark, sf_dir, "documents"))))
