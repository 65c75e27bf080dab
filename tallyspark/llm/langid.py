"""Language identification: language-bitmask n-gram filters on bit-sliced Bloom filters.

Every learned language has a set of byte n-grams (of the text in lower case, white space as one
kind). All sets lie in one bit-sliced Bloom filter: a slot holds a bit per language, in as many
numbers as the languages need, so ``k`` lookups and a bitwise AND return all languages that contain
an n-gram. The number of slots follows the largest set, so that false positives stay below ``FALSE``. A text's count for a
language is the popcount of that language's bits over its n-grams, corrected for the filter's
false positives: ``(hits - n f) / (1 - f)`` with ``f = fill ** k``. The greatest count decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.textvec import CHUNK_BYTES, LOWER, SPACE, chunks, utf8
from tallyspark.plans.session import materialize, ship_code
from tallyspark.plans.tables import table

#: Expected training texts of a language at most: a sample by hash, of whole texts.
SAMPLE_DOCS = 4000
LENGTHS = (3, 4)
#: A language has an n-gram if its relative frequency there is at least this part of the greatest.
RATIO = 0.3
MIN_COUNT = 5
HASHES = 3
#: False positives of a language at most, and the least number of slots (a power of two).
FALSE = 0.01
SLOT_BITS = 18
#: Languages up to which their sizes go to all executors; more are joined by shuffle.
BROADCAST_ROWS = 100_000
UNKNOWN = "und"
#: N-grams that a text counts as known beforehand, so that short texts aren't told foreign.
FIT_PRIOR = 50
LETTER = re.compile(r"[^\W\d_]")

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the fold that nothing is learned from; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def gram_codes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of the ``n``-grams of bytes within each row. ``n`` is 4 at most; codes of other lengths differ."""
    folded = LOWER[data]
    folded[SPACE[data]] = 32
    m = len(folded) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = np.full(m, 0 if n == 4 else 0xFF << 8 * n & 0xFFFFFFFF, dtype=np.uint32)  # 255 is no byte of UTF-8
    for k in range(n):
        code |= folded[k : k + m].astype(np.uint32) << np.uint32(8 * k)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    inside = np.arange(m) + n <= offsets[1:][rows]
    return code[inside], rows[inside]


@dataclass
class LanguageFilter:
    """A bit-sliced Bloom filter over the languages' n-grams. ``slots``: words x slots, a bit per language."""

    languages: list[str]
    slots: np.ndarray
    fill: np.ndarray
    lengths: tuple[int, ...] = LENGTHS
    hashes: int = HASHES

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], slot_bits: int | None = None, hashes: int = HASHES) -> LanguageFilter:
        """A filter of any number of languages; without ``slot_bits`` as large as ``FALSE`` asks for."""
        languages = sorted(grams)
        if slot_bits is None:
            most = max(map(len, grams.values()))
            slot_bits = max(SLOT_BITS, int(np.ceil(np.log2(max(1, most) * hashes / -np.log1p(-(FALSE ** (1 / hashes)))))))
        kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
        width = np.dtype(kind).itemsize * 8
        slots = np.zeros((-(-len(languages) // width), 1 << slot_bits), dtype=kind)
        for k, lang in enumerate(languages):
            for at in cls._places(grams[lang], slot_bits, hashes):
                slots[k // width, at] |= kind(1 << k % width)
        fill = np.array([np.count_nonzero(slots[k // width] & kind(1 << k % width)) for k in range(len(languages))]) / (1 << slot_bits)
        return cls(languages, slots, fill, hashes=hashes)

    @staticmethod
    def _places(codes: np.ndarray, slot_bits: int, hashes: int) -> Iterator[np.ndarray]:
        spread = codes ^ (codes >> np.uint32(15))
        for multiplier in _MULTIPLIERS[:hashes]:
            yield (spread * multiplier) >> np.uint32(32 - slot_bits)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """Words x n-grams: of each n-gram the bits of all languages that contain it, false positives included."""
        out = None
        for at in self._places(codes, int(self.slots.shape[1]).bit_length() - 1, self.hashes):
            found = self.slots[:, at]
            out = found if out is None else out & found
        return out

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages: n-grams that the language contains, false positives included; rows: all n-grams).

        A text beyond ``CHUNK_BYTES`` is read in parts that overlap by an n-gram.
        """
        rows_n, width = len(offsets) - 1, self.slots.dtype.itemsize * 8
        hits, total = np.zeros((rows_n, len(self.languages))), np.zeros(rows_n)
        for n in self.lengths:
            for row, end, part, cuts in chunks(data, offsets):
                for at in range(0, len(part), CHUNK_BYTES):  # more than one step for one long row only
                    own = part[at : at + CHUNK_BYTES + n - 1] if end == row + 1 else part
                    codes, rows = gram_codes(own, np.array([0, len(own)]) if end == row + 1 else cuts, n)
                    if not len(codes):
                        continue
                    masks, one = self.masks(codes), self.slots.dtype.type(1)
                    total[row:end] += np.bincount(rows, minlength=end - row)
                    for k in range(len(self.languages)):
                        bits = (masks[k // width] >> self.slots.dtype.type(k % width)) & one
                        hits[row:end, k] += np.bincount(rows, weights=bits, minlength=end - row)
        return hits, total

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages: n-grams that the language contains, corrected for false positives; rows: all n-grams)."""
        hits, total = self.hits(data, offsets)
        wrong = self.fill**self.hashes
        return (hits - total[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), total


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, ratio: float = RATIO, min_count: int = MIN_COUNT) -> LanguageFilter | None:
    """A filter from the rows of ``docs`` with a text and a lang that are not held out; None if there are none.

    Of each language a sample of about ``sample_docs`` whole texts is read, chosen by a hash of id
    and text, and all of them where there are fewer. All n-grams that occur ``min_count`` times in
    the sample of a language, at ``ratio`` of the greatest frequency at least, are its own; they come
    to the driver, which the size of the sample bounds. A language, however many there are, is
    learned if it has such n-grams, so that stray labels don't count. Repeated rows count as often.
    """
    spark = docs.sparkSession
    ship_code(spark)
    train = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = materialize(train.groupBy("lang").agg(F.count("*").alias("size")), "languages")
    few = F.broadcast if sizes.count() <= BROADCAST_ROWS else (lambda d: d)
    rate = F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("size"))
    sample = train.join(few(sizes), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < rate * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            data, offsets = utf8(batch.column("text"))
            for row, end, part, cuts in chunks(data, offsets):
                for n in LENGTHS:
                    codes, rows = gram_codes(part, cuts, n)
                    of = langs[row:end][rows]
                    for lang in np.unique(of):
                        values, counts = np.unique(codes[of == lang], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([str(lang)] * len(values)), pa.array(np.full(len(values), n, np.int32)), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))],
                            names=["lang", "width", "code", "c"],
                        )

    grams = sample.mapInArrow(count, "lang string, width int, code bigint, c bigint").groupBy("lang", "width", "code").agg(F.sum("c").alias("c"))
    grams = materialize(grams, "language-grams")
    totals = grams.groupBy("lang", "width").agg(F.sum("c").alias("n"))
    share = grams.where(F.col("c") >= min_count).join(few(totals), ["lang", "width"]).select("lang", "width", "code", (F.col("c") / F.col("n")).alias("p"))
    top = share.groupBy("width", "code").agg(F.max("p").alias("top"))
    chosen = share.join(top, ["width", "code"]).where(F.col("p") >= ratio * F.col("top")).select("lang", "code").toPandas()
    return LanguageFilter.build({k: g["code"].to_numpy().astype(np.uint32) for k, g in chosen.groupby("lang")}) if len(chosen) else None


def predict(
    docs: DataFrame, model: LanguageFilter | None, text: str = "text", keep: list[str] | None = None, to: tuple[str, str, str] = ("lang_pred", "score", "fit")
) -> DataFrame:
    """``docs``, or its columns ``keep``, with lang_pred, score and fit (0 to 1) in place of columns of these names, or of the names ``to``.

    Null texts and texts without a letter are ``und`` with score 0, and so is all if the model is
    None. Otherwise the language of the greatest corrected count is taken, the first by name in a
    tie; score is its share of the two greatest counts, 0 if both are 0. fit is the share of the text's
    n-grams that the language contains, ``FIT_PRIOR`` more counted as contained: a long text in none
    of the learned languages has a small one. Repeated rows get equal results; an empty
    table gives none. Whole texts are read, long ones a part at a time.
    """
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)  # a bit per slot and language; slots follow the sample of learn()
    keep = [c for c in (docs.columns if keep is None else keep) if c not in to]
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = docs.select(*keep).schema.add(to[0], "string").add(to[1], "double").add(to[2], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            names, scores, fits = [], [], []
            data, offsets = utf8(column)
            for row, end, part, cuts in chunks(data, offsets):
                worth = np.array([bool(t and LETTER.search(t)) for t in column.slice(row, end - row).to_pylist()])
                if filters is None:
                    names += [UNKNOWN] * (end - row)
                    scores.append(np.zeros(end - row))
                    fits.append(np.zeros(end - row))
                    continue
                counts, total = filters.counts(part, cuts)
                counts = np.maximum(counts, 0.0)
                first = counts.argmax(axis=1)
                best = counts.max(axis=1)
                second = np.sort(counts, axis=1)[:, -2] if counts.shape[1] > 1 else np.zeros(len(counts))
                share = np.divide(best, best + second, out=np.zeros(len(best)), where=best > 0)
                names += [filters.languages[k] if w else UNKNOWN for k, w in zip(first, worth, strict=True)]
                scores.append(np.where(worth, share, 0.0))
                fits.append(np.where(worth, (best + FIT_PRIOR) / (total + FIT_PRIOR), 0.0))
            columns = [pa.array(np.concatenate([*x, np.zeros(0)])) for x in (scores, fits)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs), keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
