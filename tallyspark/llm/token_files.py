"""Token ids as Arrow stream files: fixed-size lists, so that any sequence is a view of the mapped file.

A shard ``part-N.arrows`` is an Arrow IPC stream; each row is one sequence of ``length`` ids and a
mask of the same length (false: padding, which only the last row of a shard has). Ids take 16 bits
where the vocabulary allows, masks one. ``part-N.batches`` has the places of the record batches, so
that of a shard in a remote store only the batches asked for are read; ``part-N.docs`` has doc_id,
start (within the shard) and n_tokens. Shards follow each other in ascending doc_id order.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import store
from tallyspark.llm.store import located, opened, tasks_for, written
from tallyspark.llm.textvec import LOWER, SpanCache, chunks, joined, utf8, word_chunks, word_spans
from tallyspark.plans.session import ship_code, workspace
from tallyspark.plans.tables import table

LENGTH = 1024
#: Sequences of a record batch.
BATCH_ROWS = 512
END_ID = 2
#: Words that a worker remembers (about 40 bytes each); when they are more, it starts anew.
CACHE_WORDS = 600_000
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 20
#: A word that stands between words when they go through the library together.
MARK = b"\x01"
#: Kinds of ASCII characters: 1 digits, 2 letters, 3 punctuation; 0 apostrophe, control and all other bytes.
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = 3
KINDS[48:58] = 1
KINDS[65:91] = KINDS[97:123] = 2
KINDS[39] = 0
DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
BATCH_SCHEMA = pa.schema([("offset", pa.int64()), ("bytes", pa.int64()), ("sequences", pa.int64())])
#: Record batches of a remote shard that are held at most.
HELD_BATCHES = 8
MANIFEST = "shard int, path string, docs bigint, tokens bigint, sequences bigint"


class WordEncoder:
    """Encodes columns of text by a tokenizer that drops white space and works on each pre-token alone.

    Each distinct run of characters without white space goes through the library once and its ids
    are copied from then on. With ``fold``, for lower-casing tokenizers that keep letters, digits
    and other characters apart, ASCII letters are lowered first and runs are cut where an ASCII
    letter, digit or punctuation mark meets one of another kind; not at apostrophes or beside
    other characters, which contractions or composition may join, nor where a text may hold the
    name of a special token.
    """

    def __init__(self, tokenizer_file: str, fold: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.fold = fold
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.cache = SpanCache(self._spans, self.kind, CACHE_WORDS)

    def _spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        return self._encode([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word). Many words make one text, with a mark between them that is one id."""
        odd = [k for k, w in enumerate(words) if MARK in w]
        if odd or len(self.mark) != 1:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for each in ids for x in each), self.kind, int(sizes.sum())), sizes
        between = b" " + MARK + b" "
        texts = [(between.join(words[k : k + 512]) + between).decode("utf-8", "replace") for k in range(0, len(words), 512)]
        parts = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([*parts, np.zeros(0, self.kind)])
        marks = np.flatnonzero(flat == self.mark[0])
        if len(marks) != len(words):
            raise ValueError("the tokenizer doesn't keep words apart")
        return flat[flat != self.mark[0]], np.diff(marks, prepend=-1) - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, number of ids of each row), each row with ``end_id`` after it."""
        rows_n = len(offsets) - 1
        parts, counts = [], np.zeros(rows_n, np.int64)
        for row, end, part, cuts, last in word_chunks(data, offsets, ENCODE_BYTES):
            ids, n = self._encode_part(part, cuts, end_id if last else None)
            parts.append(ids)
            counts[row:end] += n
        return np.concatenate([*parts, np.zeros(0, self.kind)]) if len(parts) != 1 else parts[0], counts

    def _encode_part(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        fold = self.fold and b"<|" not in data.tobytes()
        if fold:
            data = LOWER[data]
        starts, ends, rows = word_spans(data, offsets, KINDS if fold else None)
        pool, where, size = self.cache.resolve(data, starts, ends)
        extra = 0 if end_id is None else 1
        counts = np.bincount(rows, weights=size, minlength=len(offsets) - 1).astype(np.int64) + extra
        out = np.empty(int(counts.sum()), self.kind)
        body = joined(pool, where, size)
        if extra:
            last = np.cumsum(counts) - 1
            inner = np.ones(len(out), bool)
            inner[last] = False
            out[last] = end_id
            out[inner] = body
        else:
            out[:] = body
        return out, counts


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(tokenizer_file)


class SequenceWriter:
    """Packs ids into rows of ``length`` and writes them as record batches of an Arrow stream.

    ``batches`` has (offset, bytes, sequences) of each batch when the writer is closed.
    """

    def __init__(self, out, length: int, kind):
        self.out, self.length, self.kind = out, length, np.dtype(kind)
        ids = pa.list_(pa.from_numpy_dtype(self.kind), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_stream(out, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.sequences = 0
        self.batches: list[tuple[int, int, int]] = []

    def add(self, ids: np.ndarray):
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        size = self.length * BATCH_ROWS
        if self.held >= size:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // size * size
            for at in range(0, whole, size):
                self._write(flat[at : at + size], size)
            self.waiting, self.held = [flat[whole:].copy()], len(flat) - whole

    def _write(self, flat: np.ndarray, valid: int):
        mask = np.ones(len(flat), bool)
        mask[valid:] = False
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in ((flat, self.schema.field(0).type), (mask, self.schema.field(1).type))]
        batch = pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.writer.write_batch(batch)
        rows, size = len(flat) // self.length, pa.ipc.get_record_batch_size(batch)
        self.batches.append((self.out.tell() - size, size, rows))
        self.sequences += rows

    def close(self):
        flat = np.concatenate([*self.waiting, np.zeros(0, self.kind)])
        if len(flat):
            rows = -(-len(flat) // self.length)
            padded = np.zeros(rows * self.length, self.kind)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()

    def write_places(self, out):
        """The places of the batches as an Arrow stream; the length is in its schema."""
        schema = BATCH_SCHEMA.with_metadata({"length": str(self.length), "ids": self.kind.name})
        with pa.ipc.new_stream(out, schema) as listed:
            listed.write_batch(pa.RecordBatch.from_arrays([pa.array([b[k] for b in self.batches], pa.int64()) for k in range(3)], schema=schema))


class SequenceFile:
    """Random access to the shard ``base``. Ids and masks are views of the batch's memory, nothing is copied.

    Of a local file that memory is the mapped file's; of a remote one the batch's byte range is read,
    and the last ``HELD_BATCHES`` are held.
    """

    def __init__(self, base: str):
        with opened(f"{base}.batches") as f:
            places = pa.ipc.open_stream(f).read_all()
        meta = places.schema.metadata
        self.length, self.kind = int(meta[b"length"]), np.dtype(meta[b"ids"].decode())
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), self.length)), ("mask", pa.list_(pa.bool_(), self.length))])
        self.places = [places.column(k).to_numpy() for k in range(2)]
        self.ends = np.cumsum(places.column(2).to_numpy()) * self.length
        store_, path = located(f"{base}.arrows")
        self.local = isinstance(store_, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if self.local else store_.open_input_file(path)
        self.held: dict[int, pa.RecordBatch] = {}

    def __len__(self) -> int:
        return int(self.ends[-1]) // self.length if len(self.ends) else 0

    def close(self):
        self.held.clear()
        self.source.close()

    def batch(self, k: int) -> pa.RecordBatch:
        if k not in self.held:
            if not self.local and len(self.held) >= HELD_BATCHES:
                self.held.pop(next(iter(self.held)))
            self.source.seek(int(self.places[0][k]))
            buffer = self.source.read_buffer(int(self.places[1][k]))
            self.held[k] = pa.ipc.read_record_batch(pa.ipc.read_message(buffer), self.schema)
        return self.held[k]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence ``i``, both views. Bits have no type in numpy, so that the mask is an Arrow array."""
        k = int(np.searchsorted(self.ends, i * self.length, "right"))
        at = i * self.length - (int(self.ends[k - 1]) if k else 0)
        ids, mask = (c.values.slice(at, self.length) for c in self.batch(k).columns)
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on: a view, or a copy where they lie in more than one batch."""
        k = int(np.searchsorted(self.ends, start, "right"))
        parts = []
        while n > 0:
            base = int(self.ends[k - 1]) if k else 0
            part = self.batch(k).column(0).values.to_numpy(zero_copy_only=True)[start - base : start - base + n]
            parts.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, self.kind)])


class _Shard:
    """The three files of a shard while they are written."""

    def __init__(self, base: str, attempt: int, length: int, kind):
        self.base, self.attempt = base, attempt
        self.files = ExitStack()
        self.sequences = SequenceWriter(self.files.enter_context(written(f"{base}.arrows", attempt)), length, kind)
        self.listed = self.files.enter_context(pa.ipc.new_stream(self.files.enter_context(written(f"{base}.docs", attempt)), DOC_SCHEMA))
        self.docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray):
        starts = self.sequences.tokens + np.cumsum(counts) - counts
        self.sequences.add(ids)
        self.listed.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(counts)], schema=DOC_SCHEMA))
        self.docs += len(counts)

    def close(self) -> tuple:
        self.sequences.close()
        with written(f"{self.base}.batches", self.attempt) as out:
            self.sequences.write_places(out)
        self.files.close()
        return self.base, self.docs, self.sequences.tokens, self.sequences.sequences


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, length: int = LENGTH, file_bytes: int = store.FILE_BYTES) -> DataFrame:
    """Encodes the whole text of every row and writes shards to ``path``; returns the manifest in shard order.

    Null texts are empty: they have the end id only. Null doc_ids come first; rows that share an id
    follow each other in the order of a hash of their texts. Ids are taken as 64-bit integers; columns
    other than doc_id and text are ignored. An empty table has no shard. The number of tasks follows
    the bytes of the input, and a task begins another shard after about ``file_bytes``. A long text
    is encoded a part at a time; its ids are held until it ends.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ranged = rows.repartitionByRange(tasks_for(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        words = encoder(tokenizer_file)
        done, now = [], None
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for row, end, part, cuts in chunks(data, offsets, ENCODE_BYTES):
                if now is not None and now.sequences.tokens * words.kind().itemsize >= file_bytes:
                    done.append(now.close())
                    now = None
                now = now or _Shard(f"{path}/part-{task:06d}-{len(done):04d}", attempt, length, words.kind)
                now.add(batch.column(0).slice(row, end - row), *words.encode(part, cuts, end_id))
        if now is not None:
            done.append(now.close())
        if done:
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*((task, *x) for x in done), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "path", "docs", "tokens", "sequences"])

    found = sorted(ranged.mapInArrow(run, MANIFEST).collect(), key=lambda r: r.path)  # a row per shard
    return spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(found)], MANIFEST)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all shards), n_tokens and ids_crc32 of every document, from the files. No shard gives no row."""
    spark = manifest.sparkSession
    ship_code(spark)
    shards = manifest.select("shard", "path", "tokens").orderBy("shard").collect()  # a row per shard
    base, bases = 0, []
    for s in shards:
        bases.append((s.shard, s.path, base))
        base += s.tokens
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    listed = spark.createDataFrame(bases, "shard int, path string, base bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sequences = SequenceFile(row["path"])
                with opened(f"{row['path']}.docs") as f:
                    for docs in pa.ipc.open_stream(f):
                        spans = zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True)
                        crcs = [zlib.crc32(sequences.tokens(s, n).astype("<u4").tobytes()) for s, n in spans]
                        starts = docs.column(1).to_numpy() + row["base"]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts), docs.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                sequences.close()

    return listed.repartition(max(1, len(bases)), "shard").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read(write(table(spark, sf_dir, "documents"), workspace(spark, "token-files"), tokenizer))
