"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary weight all segmentations of a word; a forward recursion in log
space sums them to the word's marginal probability, ``lattice(w)``. The weights start from the
vocabulary's own scores and are fitted to the corpus by expectation maximisation over its distinct
words. A document's marginal under the lattice alone is the column ``lattice_score``:

    P(document) = p (1 - p)^n  product over its n words of lattice(w),   p the share of ends

The model's ``score`` has the corpus' own words as further arcs of the lattice, with absolute
discounting at two levels,

    P(w)     = (max(c(w) - d, 0)   + d V   lattice(w)) / N
    P(w | z) = (max(c(w,z) - d, 0) + d V_z P(w))       / N_z

for latent classes ``z`` of documents: training rows by a hash of their language. Words that a
document has used come back in it: given ``z`` they are drawn from a Polya urn of weight ``URN``
about P(w | z), so that a word that is there n times adds the product over i < n of
(URN P(w | z) + i). The score sums over ``z``; a document's own language is not looked at. All of it
is a proper distribution over texts, up to letter case and white space.

Word counts come from all training rows. Frequent words, a bounded number, go to the executors as
arrays; the others are joined by shuffle, one row for each document and distinct word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.lattice import Lattice, vocabulary
from tallyspark.llm.langid import held_out
from tallyspark.llm.textvec import LOWER, chunks, span_hashes, utf8, word_spans
from tallyspark.plans.session import materialize, ship_code
from tallyspark.plans.tables import table

MODEL = "piece_bpe_32k.model"
FOLDS, FOLD = 7, 2
DISCOUNT = 0.75
#: Rounds of expectation maximisation.
ROUNDS = 2
#: Pseudo-counts that the vocabulary's own scores get, and the share of single bytes in them.
PRIOR, BYTE_SHARE = 50.0, 0.1
#: Words that are sent to the executors at most, the most frequent ones.
HEAD_WORDS = 300_000
#: Languages are dealt over this many classes by a hash of their names; classes without training rows fall away.
CLASSES = 32
#: Weight of the urn that a document's words are drawn from, in words.
URN = 3000.0
#: Bytes of text whose words are counted together.
COUNT_BYTES = 1 << 23


@dataclass
class Model:
    """``words``: word, c0.., lat of every word of the corpus; counts are of training rows."""

    words: DataFrame
    docs: list[int]
    tokens: list[int]
    types: list[int]
    all_types: int
    head: tuple = field(repr=False, default=())

    @property
    def n(self) -> int:
        return sum(self.tokens)


def _rows_of(docs: DataFrame) -> tuple[Column, int, list[int]]:
    """An expression for a row's class, the number of classes, and training rows by class."""
    part = F.pmod(F.crc32(F.coalesce("lang", F.lit("")).cast("binary")), F.lit(CLASSES))
    sizes = docs.where(~held_out(F.col("doc_id"), FOLDS, FOLD)).groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # CLASSES rows at most
    of = F.lit(0)
    for k, r in enumerate(sizes):
        of = F.when(part == r.part, k).otherwise(of)
    return of, max(1, len(sizes)), [r.n for r in sizes] or [0]


def _count_words(docs: DataFrame, of: Column, classes: int) -> DataFrame:
    """word, c0.., held for every word of all rows: counts of training rows by class, and of held-out rows."""
    source = docs.select("text", F.when(held_out(F.col("doc_id"), FOLDS, FOLD), classes).otherwise(of).cast("int").alias("z"))
    names = [*[f"c{k}" for k in range(classes)], "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.column(0).nbytes
            if size >= COUNT_BYTES:
                yield from count(waiting)
                waiting, size = [], 0
        if waiting:
            yield from count(waiting)

    def count(waiting):
        batch = pa.Table.from_batches(waiting).combine_chunks()
        data, offsets = utf8(batch.column(0).combine_chunks() if batch.num_rows else pa.array([], pa.string()))
        z = batch.column(1).to_numpy()
        keys, words, of_row, raws, base = [], [], [], [], 0
        for row, _, part, cuts in chunks(data, offsets):
            part = LOWER[part]
            starts, ends, rows = word_spans(part, cuts)
            keys.append(span_hashes(part, starts, ends))
            words.append(np.stack([starts + base, ends + base], axis=1))
            of_row.append(z[rows + row])
            raws.append(part.tobytes())
            base += len(part)
        if not keys:
            return
        keys, words, of_row, raw = np.concatenate(keys), np.concatenate(words), np.concatenate(of_row), b"".join(raws)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(inverse * (classes + 1) + of_row, minlength=len(distinct) * (classes + 1)).reshape(-1, classes + 1)
        spans = words[first].tolist()
        for at in range(0, len(spans), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([raw[s:e] for s, e in spans[part]], pa.binary()), *[pa.array(counts[part, k]) for k in range(classes + 1)]], names=["word", *names]
            )

    schema = "word binary, " + ", ".join(f"{c} bigint" for c in names)
    return source.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in names])


def _marked(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a space before each: (bytes, starts, ends)."""
    data, offsets = utf8(words)
    data = np.insert(data, offsets[:-1], 0x20)
    offsets = offsets + np.arange(len(offsets))
    return data, offsets[:-1], offsets[1:]


def _prior(model_file: str) -> np.ndarray:
    known = vocabulary(model_file)
    return np.concatenate([np.exp(known.zipf()) * (1 - BYTE_SHARE), np.full(256, BYTE_SHARE / 256)])


def _maximise(words: DataFrame, model_file: str, weights: np.ndarray) -> np.ndarray:
    """New log weights after one round over the distinct words that training has seen."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(model_file).texts, shared.value, bytes_too=True)
        out = np.zeros(len(shared.value))
        for batch in batches:
            data, starts, ends = _marked(batch.column(0))
            for _, group in lattice.groups(data, starts, ends):
                lattice.expected_counts(group, np.ones(len(group)), out)
        used = np.flatnonzero(out > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(out[used])], names=["arc", "n"])

    found = words.mapInArrow(run, "arc int, n double").groupBy("arc").agg(F.sum("n").alias("n")).collect()  # a row per piece
    counts = PRIOR * _prior(model_file)
    for r in found:
        counts[r.arc] += r.n
    return np.log(counts / counts.sum())


def fit(docs: DataFrame, model_file: str, rounds: int = ROUNDS, head_words: int = HEAD_WORDS) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) that aren't held out.

    Null texts count as empty documents, null languages as a language. Words of held-out rows get
    a lattice probability but no count.
    """
    spark = docs.sparkSession
    ship_code(spark)
    of, classes, rows = _rows_of(docs)
    names = [f"c{k}" for k in range(classes)]
    counted = materialize(_count_words(docs, of, classes), "lm-counts")
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    stats = counted.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in names],
        *[F.count_if(F.col(c) > 0).alias(f"v_{c}") for c in names],
        F.count_if(total > 0).alias("v"),
    ).first()
    weights = np.log(_prior(model_file))
    seen = counted.where(total > 0).select("word")
    for _ in range(rounds):
        weights = _maximise(seen, model_file, weights)
    shared = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(model_file).texts, shared.value, bytes_too=True)
        for batch in batches:
            data, starts, ends = _marked(batch.column(0))
            lat = np.empty(batch.num_rows)
            for own, group in lattice.groups(data, starts, ends):
                lat[own] = lattice.marginal(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lat)], names=[*batch.schema.names, "lat"])

    words = materialize(counted.mapInArrow(score, "word binary, " + ", ".join(f"{c} bigint" for c in [*names, "held"]) + ", lat double"), "lm-words")
    some = int(sum(rows) > 0)
    model = Model(
        words,
        rows,
        [int(stats[f"n_{c}"]) + n for c, n in zip(names, rows, strict=True)],
        [int(stats[f"v_{c}"]) + (n > 0) for c, n in zip(names, rows, strict=True)],
        int(stats["v"]) + some,
    )
    model.head = _head(words, total + F.col("held"), head_words)
    return model


def _head(words: DataFrame, total: Column, head_words: int) -> tuple:
    """The words above the least number of occurrences that at most ``head_words`` words reach: (sorted keys, counts by class, lattice)."""
    level = F.floor(F.log2(total.cast("double")) * 16).cast("int")
    sizes = words.where(total > 0).groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # up to 16 rows for a power of two
    least, room = None, head_words
    for r in sizes:
        if r.n > room:
            break
        least, room = r.level, room - r.n
    found = words.where(F.lit(False) if least is None else level >= least).toArrow().combine_chunks()
    data, offsets = utf8(found.column(0).combine_chunks() if found.num_rows else pa.array([], pa.binary()))
    keys = span_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(keys)
    counts = np.stack([found.column(k).to_numpy() for k in range(1, found.num_columns - 2)], axis=1)[order].astype(np.float64)
    return keys[order], counts, found.column(found.num_columns - 1).to_numpy()[order]


def _log_probabilities(model: Model, counts: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(natural log of P(w | z) by class, log10 of the base) of words with these counts by class and logs of lattice marginals.

    Where no count is left the sum is its second term, whose log is taken by parts: a long word's
    probability may be too small for a number.
    """
    c = counts.sum(axis=1)
    n, v, d = model.n, model.all_types, DISCOUNT
    base = np.log10((c + 1) / (n + v + 1))
    if not n:
        return np.repeat(lat[:, None], counts.shape[1], axis=1), base
    part = lambda count, weight, log: np.where(count > d, np.log(np.maximum(count - d, 1e-9) + weight * np.exp(log)), math.log(weight) + log)
    whole = part(c, d * v, lat) - math.log(n)
    each = [part(counts[:, k], d * model.types[k], whole) - math.log(model.tokens[k]) for k in range(counts.shape[1])]
    return np.stack(each, axis=1), base


def _log_column(model: Model, k: int, total: Column) -> Column:
    """The same of class ``k`` for the columns of ``model.words``."""
    if not model.n:
        return F.col("lat")
    d = DISCOUNT
    part = lambda count, weight, log: F.when(count > d, F.log(count - d + F.lit(weight) * F.exp(log))).otherwise(log + math.log(weight))
    whole = part(total, d * model.all_types, F.col("lat")) - math.log(model.n)
    return part(F.col(f"c{k}").cast("double"), d * model.types[k], whole) - math.log(model.tokens[k])


def _urn(log: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logs of the products over i < n of (URN p + i); rows of ``log``, the logs of p, are words, columns classes."""
    x = URN * np.exp(log)
    out = math.log(URN) + log
    for i in range(1, int(min(n.max(initial=1), 16))):
        more = np.flatnonzero(n > i)
        out[more] += np.log(x[more] + i)
    for k in np.flatnonzero(n > 16).tolist():
        out[k] += [math.lgamma(v + n[k]) - math.lgamma(v + 16) for v in x[k]]
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and lattice_score of every row of ``docs``.

    Null texts are empty: their only token is the end. Rows that are alike stay as many rows; doc_ids
    are taken as 64-bit integers, other columns than doc_id and text are ignored. Texts are worked on
    in passes of whole rows; a long one is a pass of its own.
    """
    spark = docs.sparkSession
    ship_code(spark)
    classes = len(model.docs)
    train = sum(model.docs)
    end_log, end_base = _log_probabilities(model, np.array([model.docs], np.float64), np.array([-np.inf if model.n else math.log(0.5)]))
    # An end is drawn for itself, all words from the urn of the rest.
    share = train / model.n if model.n else 0.5
    end_lattice, word_lattice = math.log(share), math.log(1 - share) if share < 1 else math.log(0.5)
    keys, counts, lat = model.head
    head_log, head_base = _log_probabilities(model, counts, lat)
    shared = spark.sparkContext.broadcast((keys, head_log, head_base, counts.sum(axis=1) > 0, lat))  # 8 (4 + classes) bytes a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, bases, known, lattices = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for row, end, part, cuts in chunks(data, offsets):
                part = LOWER[part]
                n = end - row
                starts, stops, rows = word_spans(part, cuts)
                own = span_hashes(part, starts, stops)
                distinct, first, inverse = np.unique(own, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, distinct), max(0, len(keys) - 1))
                found = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
                # A document's word and how often it is there.
                pair, times = np.unique(rows * max(1, len(distinct)) + inverse, return_counts=True)
                of, word = pair // max(1, len(distinct)), pair % max(1, len(distinct))
                inside = found[word]
                place, to, often = at[word][inside], of[inside], times[inside]
                size = np.bincount(rows, minlength=n).astype(float)
                total = lambda weights, to=to, n=n: np.bincount(to, weights=weights, minlength=n)
                sums = [size + 1.0, total(often * known[place]) + float(train > 0), total(often * bases[place]) + end_base[0], total(often * lattices[place]) + size * word_lattice + end_lattice]
                urns = _urn(logs[place], often)
                drawn = np.array([math.lgamma(URN) - math.lgamma(URN + x) for x in size])
                sums += [total(urns[:, k]) + drawn + end_log[0, k] for k in range(classes)]
                flat = np.stack([*sums, np.ones(n)], axis=1)
                ids, texts = batch.column(0).slice(row, n), batch.column(1).slice(row, n)
                # No word has a space: this key finds no word and spreads the rows evenly.
                marks = pa.array([b" %d %d" % (t, i) for i, t in enumerate(texts.to_pylist())], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([marks, ids, texts, pa.array(np.zeros(n, np.int64)), lists], names=names)
                rest = ~inside
                if not rest.any():
                    continue
                raw, pick = part.tobytes(), first[word[rest]]
                words = pa.array([raw[s:e] for s, e in zip(starts[pick].tolist(), stops[pick].tolist(), strict=True)], pa.binary())
                to = pa.array(of[rest])
                yield pa.RecordBatch.from_arrays([words, ids.take(to), texts.take(to), pa.array(times[rest]), pa.nulls(len(pick), pa.list_(pa.float64()))], names=names)

    names = ["word", "doc_id", "text_key", "times", "sums"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    scanned = source.mapInArrow(run, "word binary, doc_id bigint, text_key bigint, times bigint, sums array<double>")
    c = [F.col(f"c{k}").cast("double") for k in range(classes)]
    total = sum(c[1:], c[0])
    n, v = model.n, model.all_types
    parts = [F.lit(0.0), F.when(total > 0, F.col("times").cast("double")).otherwise(0.0), F.col("times") * F.log10((total + 1) / float(n + v + 1)), F.col("times") * F.col("lat")]
    joined = scanned.join(model.words, "word", "left")
    ready = joined.select("doc_id", "text_key", "times", "sums", *[p.alias(f"p{k}") for k, p in enumerate(parts)], *[_log_column(model, k, total).alias(f"x{k}") for k in range(classes)])
    turns = F.sequence(F.lit(1).cast("long"), F.col("times") - 1)
    urn = lambda x: x + math.log(URN) + F.when(F.col("times") > 1, F.aggregate(turns, F.lit(0.0), lambda acc, i: acc + F.log(F.exp(x) * URN + i))).otherwise(0.0)
    drawn = [urn(F.col(f"x{k}")) for k in range(classes)]
    every = [*[F.col(f"p{k}") for k in range(len(parts))], *drawn, F.lit(0.0)]
    fields = [F.coalesce(F.get("sums", F.lit(k)), p).alias(f"s{k}") for k, p in enumerate(every)]
    last = len(every) - 1
    summed = ready.select("doc_id", "text_key", *fields).groupBy("doc_id", "text_key").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(last + 1)])
    copies = F.col(f"s{last}")
    mixed = [F.col(f"s{len(parts) + k}") / copies + (float(np.log(model.docs[k] / train)) if train else 0.0) for k in range(classes)]
    top = F.greatest(*mixed) if classes > 1 else mixed[0]
    score_log = top + F.log(sum((F.exp(m - top) for m in mixed[1:]), F.exp(mixed[0] - top)))
    one = summed.select(
        "doc_id",
        F.round(F.col("s0") / copies).cast("long").alias("n_tokens"),
        F.round(F.col("s1") / copies).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("s2") / copies).alias("base_score"),
        (score_log / float(np.log(10))).alias("score"),
        (F.col("s3") / copies / float(np.log(10))).alias("lattice_score"),
        F.sequence(F.lit(1), F.round(copies).cast("int")).alias("each"),
    )
    return one.withColumn("each", F.explode("each")).drop("each")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = score(docs, fit(docs, public_tokenizers.path(MODEL)))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
