"""SentencePiece encoding and decoding by batched Viterbi over a unigram vocabulary.

The vocabulary is a public model file. Its scores are merge ranks; as unigram log probabilities
they follow Zipf's law (``Vocabulary.zipf``). The ids are those of the library for a unigram model
of these pieces and weights, but for ties: spaces become word marks, a mark is put before the text,
characters without a piece fall back to bytes. Decoding gives every text back, except that a
literal word mark comes back as a space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.lattice import MARK, Lattice, vocabulary
from tallyspark.llm.textvec import SpanCache, chunks, joined, utf8
from tallyspark.plans.session import ship_code
from tallyspark.plans.tables import table

MODEL = "piece_bpe_32k.model"
SPACE_BYTE = 0x20


class PieceCodec:
    """Encodes and decodes whole columns."""

    def __init__(self, model_file: str):
        self.vocabulary = vocabulary(model_file)
        self.lattice = Lattice(self.vocabulary.texts, self.vocabulary.zipf())
        self.cache = SpanCache(self._spans, np.int32)
        # Bytes of each id, one after the other, for decoding.
        texts = [b""] * self.vocabulary.size
        for i, t in zip(self.vocabulary.ids.tolist(), self.vocabulary.texts, strict=True):
            texts[i] = t
        for b, i in enumerate(self.vocabulary.byte_ids.tolist()):
            if i >= 0:
                texts[i] = bytes([b])
        self.text_sizes = np.array([len(t) for t in texts], np.int64)
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.text_pool = np.frombuffer(b"".join(texts), np.uint8)

    def _spans(self, data, starts, ends):
        sizes = np.zeros(len(starts), np.int64)
        parts = []
        to_id = np.append(self.vocabulary.ids, -1)
        for own, words in self.lattice.groups(data, starts, ends):
            pieces, _ = self.lattice.best(words)
            ids = np.where(pieces == self.lattice.unknown, self.vocabulary.byte_ids[words], to_id[np.minimum(pieces, len(to_id) - 1)])
            used = pieces >= 0
            sizes[own] = used.sum(axis=1)
            parts.append((own, ids[used]))
        if not parts:
            return np.zeros(0, np.int32), sizes
        flat = np.concatenate([p for _, p in parts]).astype(np.int32)
        order = np.concatenate([o for o, _ in parts])
        own_sizes = sizes[order]
        places = np.empty(len(sizes), np.int64)
        places[order] = np.cumsum(own_sizes) - own_sizes
        return joined(flat, places, sizes), sizes

    def prepared(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a space before each that isn't empty, and spaces for word marks."""
        mark = MARK.encode()
        if mark in data.tobytes():
            raw = data.tobytes()
            texts = [raw[a:b].replace(mark, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            data = np.frombuffer(b"".join(texts), np.uint8)
        if not self.vocabulary.dummy_prefix:
            return data, offsets
        full = offsets[:-1] < offsets[1:]
        data = np.insert(data, offsets[:-1][full], SPACE_BYTE)
        return data, offsets + np.concatenate([[0], np.cumsum(full)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, number of ids of each row)."""
        data, offsets = self.prepared(data, offsets)
        starts, ends, rows = self.lattice.spans(data, offsets)
        pool, where, size = self.cache.resolve(data, starts, ends)
        counts = np.bincount(rows, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        return joined(pool, where, size), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows one after the other, number of bytes of each row). Ids of control pieces are left out."""
        where, size = self.text_starts[ids], self.text_sizes[ids]
        data = joined(self.text_pool, where, size)
        row = np.repeat(np.arange(len(counts)), counts)
        sizes = np.bincount(row, weights=size, minlength=len(counts)).astype(np.int64)
        if self.vocabulary.dummy_prefix:
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            first = starts[data[starts] == SPACE_BYTE]
            keep = np.ones(len(data), bool)
            keep[first] = False
            cut = np.zeros(len(counts), np.int64)
            cut[np.searchsorted(np.cumsum(sizes), first, "right")] = 1
            return data[keep], sizes - cut
        return data, sizes


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """One codec for all tasks of a worker."""
    return PieceCodec(model_file)


def _fields(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)


def encode(docs: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), n_pieces and ids of each row, in place of columns of these names. Null or empty texts have no ids."""
    ship_code(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_pieces", "ids")]
    source = docs.select(*keep, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            for row, end, part, cuts in chunks(data, offsets):
                ids, counts = codec(model_file).encode(part, cuts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                own = [c.slice(row, end - row) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts), lists], names=[*keep, "n_pieces", "ids"])

    return source.mapInArrow(run, f"{_fields(docs, keep)}n_pieces bigint, ids array<int>")


def decode(encoded: DataFrame, model_file: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but ids by default) and text. Null ids give an empty text; ids that aren't in the vocabulary fail."""
    ship_code(encoded.sparkSession)
    keep = [c for c in (encoded.columns if keep is None else keep) if c not in ("ids", "text")]
    source = encoded.select(*keep, encoded["ids"].alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and not 0 <= ids.min() <= ids.max() < codec(model_file).vocabulary.size:
                raise ValueError("an id isn't in the vocabulary")
            counts = np.array([len(x) if x is not None else 0 for x in column], np.int64)
            data, sizes = codec(model_file).decode(ids, counts)
            raw, ends = data.tobytes(), np.cumsum(sizes)
            texts = [raw[e - s : e].decode("utf-8", "replace") for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, f"{_fields(encoded, keep)}text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes, ids_crc32 (of little-endian 32-bit ids), text_crc32 of the decoded text, same (decoded is the text)."""
    ship_code(docs.sparkSession)
    schema = "doc_id bigint, n_pieces bigint, n_bytes bigint, ids_crc32 bigint, text_crc32 bigint, same boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for row, end, part, cuts in chunks(data, offsets):
                ids, counts = codec(model_file).encode(part, cuts)
                back, sizes = codec(model_file).decode(ids, counts)
                ids_raw, text_raw, raw = ids.astype("<i4").tobytes(), back.tobytes(), part.tobytes()
                a, b = np.cumsum(counts), np.cumsum(sizes)
                ids_crc = [zlib.crc32(ids_raw[4 * (e - n) : 4 * e]) for e, n in zip(a.tolist(), counts.tolist(), strict=True)]
                texts = [text_raw[e - n : e] for e, n in zip(b.tolist(), sizes.tolist(), strict=True)]
                same = [t == raw[x:y] for t, x, y in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                columns = [pa.array(counts), pa.array(np.diff(cuts)), pa.array(ids_crc, pa.int64()), pa.array(map(zlib.crc32, texts), pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
