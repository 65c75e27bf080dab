"""WARC archives with a two-level capture index.

Records are sorted by their reversed-host URL key and written shard by shard, each record as a
gzip member of its own. The first index level has a line per record (key, page, offset, length,
type), in sorted blocks that are compressed one by one; the second is a sparse directory with the
first key and page, offset and length of each block. A lookup bisects the shards' first keys, then
the directory of the shard, reads and bisects one block, and then reads the record's byte range.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import store
from tallyspark.llm.store import opened, tasks_for, written
from tallyspark.plans.session import materialize, ship_code, workspace
from tallyspark.plans.tables import table

#: Payloads from this size on are stored once.
DEDUP_BYTES = 1000
BLOCK_LINES = 512
#: Digests stored once are broadcast up to this count (about 60 bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000
SALTS = 64
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "shard int, path string, first_key string, first_page bigint, last_key string, last_page bigint, records bigint, bytes bigint"


_ARROW_MANIFEST = pa.schema(
    [("shard", pa.int32()), ("path", pa.string()), ("first_key", pa.string()), ("first_page", pa.int64()), ("last_key", pa.string()), ("last_page", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64())]
)


def url_key(url):
    """The reversed-host key of a URL column: ``org,example)/path``; scheme, user, port and ``www.`` fall away. Null: empty."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")), r"^www\.", "")
    path = F.substr(rest, F.length(authority) + 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))


def captures(pages: DataFrame, dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """page_id, url, payload, key, digest, record_type, refers_to of every row; nothing else of ``pages``.

    Of rows whose payloads are equal and of ``dedup_bytes`` at least, that with the greatest page_id
    is a response and the others revisit it; rows that repeat that id are responses too. Null html
    is an empty payload; a null page_id counts as least.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), url_key(F.col("url")).alias("key")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length(payload) >= dedup_bytes
    keepers = materialize(
        pages.where(large).select("page_id", F.sha1(payload).alias("digest"))
        .groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper"),
        "warc-keepers",
    )
    if keepers.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(keepers), "digest", "left")
    else:
        salted = keepers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, ["digest", "salt"], "left").drop("salt")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        "page_id", "url", "payload", "key", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return b"".join(["\r\n".join(head).encode(), b"\r\n\r\n", http, payload, b"\r\n\r\n"])


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record; raises ValueError where lengths or the digest don't fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response":
        if "sha1:" + hashlib.sha1(payload).hexdigest() != headers["WARC-Payload-Digest"]:
            raise ValueError("the payload's digest is wrong")
        if len(payload) != int(headers["WARC-Payload-Length"]):
            raise ValueError("the payload's length is wrong")
    return headers, payload


def _zip(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _line(key: str, *rest) -> str:
    return json.dumps([key, *rest], ensure_ascii=True, separators=(",", ":"))


def _place(key: str, page: int | None) -> tuple:
    """What captures are sorted by: key, then page, those without a page first."""
    return (key, page is not None, page or 0)


class _ShardWriter:
    """Archive, index and directory of one shard, closed in this order."""

    def __init__(self, base: str, attempt: int, block_lines: int):
        self.base, self.attempt, self.block_lines = base, attempt, block_lines
        self.files = ExitStack()
        self.archive = self.files.enter_context(written(f"{base}.warc.gz", attempt))
        self.index = self.files.enter_context(written(f"{base}.cdx.gz", attempt))
        self.directory: list[str] = []
        self.block: list[tuple] = []
        self.first = self.last = None
        self.records = self.at = self.index_at = 0

    def add(self, r: dict):
        packed = _zip(record(r["page_id"], r["url"], r["payload"], r["digest"], r["record_type"], r["refers_to"]))
        self.archive.write(packed)
        self.last = (r["key"], r["page_id"])
        self.first = self.first or self.last
        self.block.append((*self.last, self.at, len(packed), r["record_type"]))
        self.at, self.records = self.at + len(packed), self.records + 1
        if len(self.block) >= self.block_lines:
            self._close_block()

    def _close_block(self):
        packed = _zip("\n".join(_line(*x) for x in self.block).encode(), 6)
        self.index.write(packed)
        self.directory.append(_line(*self.block[0][:2], self.index_at, len(packed)))
        self.index_at += len(packed)
        self.block = []

    def close(self) -> tuple:
        """The manifest's row but for the shard's number."""
        if self.block:
            self._close_block()
        self.files.close()
        with written(f"{self.base}.dir", self.attempt) as out:
            out.write("\n".join(self.directory).encode())
        return (self.base, *self.first, *self.last, self.records, self.at)


def write(rows: DataFrame, path: str, block_lines: int = BLOCK_LINES, shards: int | None = None, file_bytes: int = store.FILE_BYTES) -> DataFrame:
    """Writes :func:`captures` to ``path``, ordered by key over all shards; returns the manifest, a row per shard.

    The sort key ends with page and digest, so that a URL with very many captures is spread over
    shards. A task begins another shard after ``file_bytes``; the number of tasks follows the bytes
    of the input. Rows that are alike are records of their own. An empty table has no shard.
    """
    spark = rows.sparkSession
    ship_code(spark)
    order = ("key", "page_id", "digest")
    ranged = rows.repartitionByRange(shards or tasks_for(rows), *order).sortWithinPartitions(*order)
    names = [x.split()[0] for x in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.taskAttemptId()
        done, now = [], None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # payloads of few rows at a time
                for r in batch.slice(start, 64).to_pylist():
                    if now is not None and now.at >= file_bytes:
                        done.append(now.close())
                        now = None
                    now = now or _ShardWriter(f"{path}/part-{task:06d}-{len(done):04d}", attempt, block_lines)
                    now.add(r)
        if now is not None:
            done.append(now.close())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (task, *x), strict=True)) for x in done], schema=_ARROW_MANIFEST)

    found = sorted(ranged.mapInArrow(run, MANIFEST).collect(), key=lambda r: r.path)  # a row per shard
    return spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(found)], MANIFEST)


def _directory(base: str) -> list[list]:
    with opened(f"{base}.dir") as f:
        return [json.loads(x) for x in f.read().decode().split("\n") if x]


def _block(index, offset: int, length: int) -> list[list]:
    index.seek(offset)
    return [json.loads(x) for x in zlib.decompress(index.read(length), 31).decode().split("\n")]


def _record(archive, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    archive.seek(offset)
    return parse(zlib.decompress(archive.read(length), 31))


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


class Archive:
    """Lookups in shards. ``shards``: (path, first key, first page, last key, last page) of the manifest, in its order.

    The directory of one shard and one block of its index are kept; lookups in order read each once.
    """

    def __init__(self, shards: list[tuple]):
        self.paths = [s[0] for s in shards]
        self.firsts = [_place(s[1], s[2]) for s in shards]
        self.lasts = [_place(s[3], s[4]) for s in shards]
        self.files = ExitStack()
        self.shard = self.block_no = None

    def _open(self, shard: int):
        if shard != self.shard:
            self.files.close()
            base, self.shard, self.block_no = self.paths[shard], shard, None
            self.index = self.files.enter_context(opened(f"{base}.cdx.gz"))
            self.archive = self.files.enter_context(opened(f"{base}.warc.gz"))
            self.directory = _directory(base)

    def _lines(self, block: int) -> list[list]:
        if block != self.block_no:
            self.lines, self.block_no = _block(self.index, *self.directory[block][2:]), block
        return self.lines

    def find(self, low: tuple, high: tuple) -> Iterator[tuple[list, dict[str, str], bytes]]:
        """(index line, headers, payload) of the captures from place ``low`` to ``high``."""
        at = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while at < len(self.paths) and self.firsts[at] <= high:
            if self.lasts[at] >= low:
                self._open(at)
                block = max(0, bisect.bisect_left(self.directory, low, key=lambda x: _place(*x[:2])) - 1)
                while block < len(self.directory) and _place(*self.directory[block][:2]) <= high:
                    lines = self._lines(block)
                    for line in lines[bisect.bisect_left(lines, low, key=lambda x: _place(*x[:2])) :]:
                        if _place(*line[:2]) > high:
                            return
                        yield (line, *_record(self.archive, line[2], line[3]))
                    block += 1
            at += 1

    def close(self):
        self.files.close()


def read(manifest: DataFrame, wanted: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the captures (key, page_id) that ``wanted`` names, each found by bisection: headers, and with ``payloads`` the payload (null for revisits).

    A capture that is named twice is read once; of captures that are stored twice both records come
    back; what isn't stored gives no row. Lookups are dealt in key order, so that a task reads
    neighbouring blocks, and keys of very many captures are spread over tasks by page.
    """
    spark = manifest.sparkSession
    ship_code(spark)
    schema = READ + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    shards = [tuple(r) for r in manifest.orderBy("shard").select("path", "first_key", "first_page", "last_key", "last_page").collect()]  # a row per shard
    shared = spark.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(shared.value)
        try:
            for batch in batches:
                rows = []
                for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    place = _place(key, page_id)
                    for line, h, payload in archive.find(place, place):
                        if (h["WARC-Type"], _page(h["WARC-Record-ID"])) != (line[4], line[1]):
                            raise ValueError("the index points to another record")
                        response = h["WARC-Type"] == "response"
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")  # of a response it has been verified
                        rows.append((page_id, h["WARC-Target-URI"], int(h["WARC-Payload-Length"]), digest, h["WARC-Type"], _page(h.get("WARC-Refers-To")), payload if response else None))
                        if len(rows) >= 64:
                            yield _rows(rows, names)
                            rows = []
                if rows:
                    yield _rows(rows, names)
        finally:
            archive.close()

    keys = wanted.select("key", "page_id").distinct()
    return keys.repartitionByRange(tasks_for(wanted), "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, schema)


_TYPES = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _TYPES[c]) for k, c in enumerate(names)], names=names)


def lookup(archive: Archive, key: str) -> list[tuple[dict[str, str], bytes]]:
    """All records of a URL key."""
    return [(h, payload) for _, h, payload in archive.find((key, False, 0), (key, True, float("inf")))]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, then finds every page's records through the index."""
    pages = table(spark, sf_dir, "pages")
    manifest = write(captures(pages), workspace(spark, "warc"))
    wanted = pages.select("page_id", url_key(F.col("url")).alias("key"))
    return read(manifest, wanted).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM m
"""
