"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (lower case, words split at ASCII white space). Equal word
sequences are one class; classes are linked if their Jaccard similarity is at least the threshold.

1. One pass makes each document's key (128 bits of its word sequence) and 150 MinHash values of
   16 bits. Copies fold into classes before anything is compared.
2. Classes that agree in a band of five values meet in a bucket. Buckets are cut into units: blocks
   of bounded size, and pairs of blocks, so that no task holds a large bucket.
3. Within a unit, pairs compare their values 25 at a time and drop out as soon as the posterior
   probability that their similarity reaches the threshold is below ``TOLERANCE``. A pair is worked
   on only in the first band in which it agrees. Only classes with pairs left go on.
4. Their shingle sets are read, and the remaining pairs verified exactly. A unit gives sums and
   spanning edges per class, never pairs, so that groups of many near copies stay linear in rows.
5. Connected components of the links give the groups.

Rows that pass a shuffle are those of classes times bands, and in a bucket of S > ``BLOCK`` classes once
for each of its blocks. Blocks grow with the square root of S, so that these rows grow with S to the
power of 1.5 and a unit's with its root; comparisons are those of pairs, which exact numbers of links ask for. A pair of similarity 0.8 is missed with a probability below 1e-5 (no band agrees), at 0.85 below 1e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.store import tasks_for
from tallyspark.llm.textvec import _PAD, LOWER, chunks, mix, shingles, span_hashes, utf8, word_spans
from tallyspark.plans.session import materialize, ship_code
from tallyspark.plans.tables import table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
STEP = 25
TOLERANCE = 1e-8
#: Rows of a block, about: ``BLOCK``, or ``SPREAD`` times the root of the bucket's size if that is more.
BLOCK, SPREAD = 256, 16
#: Ids of documents whose texts are read again go to the executors up to this count (32 bytes each), else by shuffle.
BROADCAST_ROWS = 300_000
#: Rows of one class that meet what is known of it in one part, about; a class of more rows is dealt over several.
#: It is above the number of bands, so that only classes of buckets of several blocks are dealt.
HOT_ROWS = 64
#: Pairs that are compared together, and bits of the shingle table that verifies them.
PAIRS = 1 << 17
TABLE_BITS = 1 << 15

_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def keys_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 2 numbers that stand for the row's word sequence, number of words)."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    place = (np.arange(len(words)) - first[rows]).astype(np.uint64)
    out = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(counts)
    for k in range(2):
        h = mix(words + mix(place * np.uint64(2) + np.uint64(k)) * _PAD)
        if len(full):
            out[full, k] = np.add.reduceat(h, first[full])
    return out, counts


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 150 MinHash values, number of shingles with repeats) of texts; rows without a word have zeros."""
    h, rows = shingles(data, offsets, SHINGLE)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    out = np.zeros((n, BANDS * ROWS), np.uint16)
    full = np.flatnonzero(counts)
    if not len(full):
        return out, counts
    first = (np.cumsum(counts) - counts)[full]
    x = (h >> np.uint64(32)).astype(np.uint32)
    buffer = np.empty_like(x)
    for k in range(BANDS * ROWS):
        np.multiply(x, _MULTIPLY[k], out=buffer)
        np.add(buffer, _ADD[k], out=buffer)
        least = np.minimum.reduceat(buffer, first)
        out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out, counts


def bucket_keys(values: np.ndarray) -> np.ndarray:
    """Rows x bands: a number for the values of each band."""
    parts = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)[None, :] * _PAD + np.zeros((len(values), 1), np.uint64)
    for k in range(ROWS):
        h = mix(h ^ parts[:, :, k])
    return h.view(np.int64)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of compared values, the least matches with a posterior probability of reaching the threshold of ``tolerance``.

    With a uniform prior the posterior is a Beta distribution, and its tail a binomial sum.
    """
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _blobs(values: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = values.shape[1] * values.itemsize
    ends = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key, words, signature of each row with a word."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for row, end, part, cuts in chunks(data, offsets):
                keys, counts = keys_of(part, cuts)
                values, _ = signatures(part, cuts)
                own = np.flatnonzero(counts)
                ids = batch.column(0).slice(row, end - row).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([ids, _blobs(keys[own]), pa.array(counts[own]), _blobs(values[own])], names=["doc_id", "key", "words", "signature"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id bigint, key binary, words bigint, signature binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, band, key of each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(1), np.uint16, BANDS * ROWS)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket_keys(values).ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), batch.column(0).take(pa.array(np.repeat(np.arange(n), BANDS)))],
                names=["bucket", "band", "key"],
            )

    return classes.select("key", "signature").mapInArrow(run, "bucket bigint, band int, key binary")


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    data, _ = utf8(column)
    return np.frombuffer(data.tobytes(), kind).reshape(len(column), width)


def _units(buckets: DataFrame) -> DataFrame:
    """unit, side, band, key: the rows of buckets of two at least, in blocks and pairs of blocks.

    side is 0 or 1 for the two blocks of a pair, whose rows are compared across, and 2 for a block by itself.
    """
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    rows = buckets.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("size") / F.greatest(F.lit(float(BLOCK)), SPREAD * F.sqrt("size"))).cast("int"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = rows.withColumn("block", block).select("bucket", "band", "key", "block", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return paired.select(F.xxhash64("bucket", low, high).alias("unit"), side.alias("side"), "band", "key")


def _with_classes(rows: DataFrame, *sides: DataFrame) -> DataFrame:
    """Rows of units (unit, side, band, key) with what the ``sides`` say of their keys.

    A class amid very many near copies is in up to ``BANDS`` buckets and as many units as these have
    blocks. A class of more than ``HOT_ROWS`` rows is dealt over as many salts as it has times these
    rows, and the sides have a row for each salt: they grow by less than a row for ``HOT_ROWS`` / 2 rows.
    """
    parts = F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts")
    hot = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("key", parts), "join-hot")
    few = F.broadcast if hot.count() <= BROADCAST_ROWS else (lambda d: d)
    salt = F.pmod(F.xxhash64("unit", "side", "band"), F.coalesce("parts", F.lit(1))).cast("int")
    out = rows.join(few(hot), "key", "left").withColumn("salt", salt).drop("parts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    for side in sides:
        out = out.join(side.join(few(hot), "key", "left").withColumn("salt", each).drop("parts"), ["key", "salt"])
    return out.drop("salt")


def _whole_units(batches: Iterator[pa.RecordBatch], rows: int = 4 * BLOCK) -> Iterator[pa.Table]:
    """Tables of whole units, of ``rows`` rows at least but for the last."""
    waiting, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            waiting.append(part)
            count += part.num_rows
            if count < rows:
                continue
            table_ = pa.Table.from_batches(waiting)
            unit = table_.column(0).to_numpy()
            cut = int(np.searchsorted(unit, unit[-1], "left"))
            if cut:
                yield table_.slice(0, cut)
                waiting = table_.slice(cut).to_batches()
                count = table_.num_rows - cut
    if count:
        yield pa.Table.from_batches(waiting)


def _pairs(unit: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one unit that are to be compared, ``PAIRS`` at a time, about; ``unit`` is sorted."""
    starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    sizes = np.diff(np.append(starts, len(unit)))
    for m in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == m]
        if m > BLOCK:
            for start in own.tolist():
                yield from _pairs_of_large(np.arange(start, start + m), side[start : start + m])
            continue
        first, second = np.triu_indices(m, 1)
        step = max(1, PAIRS // len(first))
        for at in range(0, len(own), step):
            base = own[at : at + step, None]
            a, b = (base + first).ravel(), (base + second).ravel()
            keep = (side[a] == 2) | (side[a] != side[b])
            yield a[keep], b[keep]


def _pairs_of_large(rows: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_pairs`` of one unit: a block's rows with each other, or those of one block with the other's."""
    within = side[0] == 2
    left, right = (rows, rows) if within else (rows[side == 0], rows[side == 1])
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        a, b = np.repeat(some, len(right)), np.tile(right, len(some))
        if within:
            keep = a < b
            a, b = a[keep], b[keep]
        yield a, b


class _Pruner:
    """Candidates among pairs, by the posterior of their similarity."""

    def __init__(self, threshold: float):
        self.least = least_matches(threshold)

    def candidates(self, values: np.ndarray, band: np.ndarray, unit: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in _pairs(unit, side):
            matches = np.zeros(len(a), np.int32)
            for n, least in self.least.items():
                part = slice(n - STEP, n)
                matches = matches + (values[a, part] == values[b, part]).sum(axis=1)
                keep = matches >= least
                a, b, matches = a[keep], b[keep], matches[keep]
            if not len(a):
                continue
            agree = (values[a] == values[b]).reshape(len(a), BANDS, ROWS).all(axis=2)
            owned = agree.any(axis=1) & (agree.argmax(axis=1) == band[a])
            if owned.any():
                yield a[owned], b[owned]


def _columns(table_: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    values = _matrix(table_.column("signature").combine_chunks(), np.uint16, BANDS * ROWS)
    return table_.column("unit").to_numpy(), table_.column("side").to_numpy(), table_.column("band").to_numpy(), values


def _promising(units: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """Rows of units that have a pair left after pruning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pruner = _Pruner(threshold)
        for table_ in _whole_units(batches):
            unit, side, band, values = _columns(table_)
            used = np.zeros(len(unit), bool)
            for a, b in pruner.candidates(values, band, unit, side):
                used[a] = used[b] = True
            if used.any():
                yield from table_.select(["unit", "side", "band", "key"]).take(pa.array(np.flatnonzero(used))).combine_chunks().to_batches()

    return _by_unit(units.select("unit", "side", "band", "key", "signature"), tasks).mapInArrow(run, "unit bigint, side int, band int, key binary")


def _by_unit(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, "unit").sortWithinPartitions("unit")


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, by bit tables over their shingles."""
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    sizes = np.array([len(sets[i]) for i in used])
    flat = np.concatenate([sets[i] for i in used])
    row = np.repeat(np.arange(len(used)), sizes)
    distinct, code = np.unique(flat, return_inverse=True)
    shared = np.bincount(code) > 1  # a shingle of one set is in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[code]
    row, code = row[keep], number[code[keep]]
    out = np.zeros(len(a), np.int64)
    total = int(shared.sum())
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for at in range(0, total, TABLE_BITS):
        lo, hi = np.searchsorted(code, [at, at + TABLE_BITS])
        width = min(TABLE_BITS, -(-(total - at) // 64) * 64)
        bits = np.zeros((len(used), width // 8), np.uint8)
        c = code[lo:hi] - at
        np.bitwise_or.at(bits, (row[lo:hi], c >> 3), (1 << (c & 7)).astype(np.uint8))
        words = bits.view(np.uint64)
        for k in range(0, len(a), 4096):
            part = slice(k, k + 4096)
            out[part] += np.bitwise_count(words[a[part]] & words[b[part]]).sum(axis=1, dtype=np.int64)
    return out


def _verified(units: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """key, links, root: for each row of a unit the documents of the classes it is linked to, and the least key of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pruner = _Pruner(threshold)
        for table_ in _whole_units(batches):
            unit, side, band, values = _columns(table_)
            sets = [np.frombuffer(x, np.uint64) for x in table_.column("shingles").to_pylist()]
            lengths = np.array([len(x) for x in sets])
            size = table_.column("size").to_numpy()
            keys = table_.column("key").to_pylist()
            links = np.zeros(len(unit), np.int64)
            parent = np.arange(len(unit))
            for a, b in pruner.candidates(values, band, unit, side):
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                for at in range(0, len(a), PAIRS // 8):
                    x, y = a[at : at + PAIRS // 8], b[at : at + PAIRS // 8]
                    common = overlaps(sets, x, y)
                    good = common >= threshold * (lengths[x] + lengths[y] - common) - 1e-9
                    x, y = x[good], y[good]
                    np.add.at(links, x, size[y])
                    np.add.at(links, y, size[x])
                    parent = _joined(parent, x, y)
            used = np.flatnonzero(links)
            if not len(used):
                continue
            least: dict[int, bytes] = {}
            for i in used.tolist():
                root = int(parent[i])
                least[root] = min(least.get(root, keys[i]), keys[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in used], pa.binary()), pa.array(links[used]), pa.array([least[int(parent[i])] for i in used], pa.binary())],
                names=["key", "links", "root"],
            )

    columns = units.select("unit", "side", "band", "key", "signature", "size", "shingles")
    return _by_unit(columns, tasks).mapInArrow(run, "key binary, links bigint, root binary")


def _joined(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after the rows of pairs are put together; a label is the least row of its part."""
    parent = parent.copy()
    while len(x):
        low = np.minimum(parent[x], parent[y])
        before = parent.copy()
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        np.minimum.at(parent, x, low)
        np.minimum.at(parent, y, low)
        while True:
            nearer = parent[parent]
            if (nearer == parent).all():
                break
            parent = nearer
        if (before == parent).all():
            break
    return parent


def components(edges: DataFrame) -> DataFrame:
    """key, root: every key of the edges (key, root) with the least key that it is connected to.

    Large-star and small-star steps alternate; each is written to the shared folder, so that a lost
    executor costs a step. Nothing is gathered by key: minima are partial sums, and a key with very
    many edges is split by the join.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("root", "key")) if large else pairs
        least = both.groupBy("key").agg(F.min("root").alias("m")).withColumn("m", F.least("m", "key"))
        joined_ = both.join(least, "key")
        if large:
            out = joined_.where(F.col("root") > F.col("key")).select(F.col("root").alias("key"), F.col("m").alias("root"))
        else:
            out = joined_.select(F.col("root").alias("key"), F.col("m").alias("root")).union(least.select("key", F.col("m").alias("root")))
        return out.where(F.col("key") != F.col("root")).distinct()

    now = materialize(
        edges.where("key <> root").select(F.greatest("key", "root").alias("key"), F.least("key", "root").alias("root")).distinct(), "edges"
    )
    last = None
    while True:
        now = materialize(star(star(now, True), False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("key", "root").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = now.select(F.col("root").alias("key"), "root").distinct()
    return now.union(roots)


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; others are ignored): doc_id, class_id, copy_of, n_links.

    copy_of is the least doc_id with the same words; class_id the least doc_id of the group of
    documents that links connect; n_links the number of other rows whose similarity is at least
    ``threshold``, copies included. Texts without a word, null ones too, are linked to nothing.
    Texts of one to four words are one shingle. Rows that repeat an id count as documents of their
    own; null ids are never the least, so that class_id and copy_of are null where all are.
    """
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks_for(docs))
    sign = materialize(signed(docs), "join-signed")
    classes = materialize(
        sign.groupBy("key").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("size"), F.min("signature").alias("signature")), "join-classes"
    )
    units = materialize(_units(_buckets(classes)), "join-units")
    promising = materialize(_promising(_with_classes(units, classes.select("key", "signature")), threshold, tasks), "join-promising")
    needed = classes.join(promising.select("key").distinct(), "key", "left_semi").select(F.col("copy_of").alias("doc_id")).distinct()
    needed = materialize(needed, "join-needed")
    few = needed.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("d").join(
        (F.broadcast(needed) if few else needed).alias("n"), F.expr("d.doc_id <=> n.doc_id"), "left_semi"
    )
    sets = _sets(texts).groupBy("key").agg(F.first("shingles").alias("shingles"))
    full = _with_classes(promising, classes.select("key", "signature", "size"), sets)
    linked = materialize(_verified(full, threshold, tasks), "join-linked")
    roots = components(linked.select("key", "root"))
    sums = linked.groupBy("key").agg(F.sum("links").alias("links"))
    # Only linked classes have a group beyond themselves. A group's least id is a partial minimum; it
    # goes back to the group's classes by broadcast, or by a join whose large groups can be split.
    linked_classes = materialize(classes.join(sums, "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).drop("signature"), "join-groups")
    groups = materialize(linked_classes.groupBy("root").agg(F.min("copy_of").alias("class_id")), "join-group-ids")
    in_groups = linked_classes.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "root")
    copies = classes.where("size > 1").join(linked_classes.select("key"), "key", "left_anti")
    odd = in_groups.select("key", "class_id", "copy_of", (F.col("links") + F.col("size") - 1).alias("n_links")).union(
        copies.select("key", F.col("copy_of").alias("class_id"), "copy_of", F.col("size") - 1)
    )
    ids = sign.select("doc_id", "key")
    worded = ids.join(odd, "key", "left").select(
        "doc_id",
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
    return worded.union(_wordless(docs))


def _wordless(docs: DataFrame) -> DataFrame:
    none = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[ \t\n\r\f\x0B]*$")
    own = F.col("doc_id").cast("long")
    return docs.where(none).select(own.alias("doc_id"), own.alias("class_id"), own.alias("copy_of"), F.lit(0).cast("long").alias("n_links"))


def _sets(texts: DataFrame) -> DataFrame:
    """key and the sorted distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for _, _, part, cuts in chunks(data, offsets):
                keys, counts = keys_of(part, cuts)
                h, rows = shingles(part, cuts, SHINGLE)
                ends = np.cumsum(np.bincount(rows, minlength=len(counts)))
                own = np.flatnonzero(counts)
                sets = [np.unique(h[(ends[i - 1] if i else 0) : ends[i]]).tobytes() for i in own]
                yield pa.RecordBatch.from_arrays([_blobs(keys[own]), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return texts.select("text").mapInArrow(run, "key binary, shingles binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda w: w <> '') AS raw FROM documents),
w AS (SELECT doc_id, list_transform(raw, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM d WHERE len(raw) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) AS copy_of FROM w),
m AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT t.doc_id, k.class_id, coalesce(c.copy_of, t.doc_id) AS copy_of, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links
FROM documents t JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
