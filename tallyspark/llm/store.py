"""Files that executors write to and read from the shared folder, and how many of them.

Hadoop's names of stores are mapped to those of pyarrow; stores that pyarrow doesn't know go through
fsspec where that is installed, or through a function registered in ``STORES``.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame

#: Bytes after which a task begins another file, and bytes of input that a task takes, about.
FILE_BYTES = 256 << 20
TASK_BYTES = 256 << 20

#: Functions from an address to (store, path), by scheme; they go before all else.
STORES: dict[str, Callable[[str], tuple[pafs.FileSystem, str]]] = {}
#: Hadoop's names of stores that pyarrow has under another one.
RENAMED = {"s3a": "s3", "s3n": "s3"}


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of an address and the path in it; ``file:/path`` and plain paths are local, ``dbfs:/path`` is the mount of that name."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        scheme, rest = "file", uri
    if scheme in STORES:
        return STORES[scheme](uri)
    if scheme in ("file", "dbfs"):
        path = "/" + rest.lstrip("/")
        return pafs.LocalFileSystem(), path if scheme == "file" else f"/dbfs{path}"
    scheme = RENAMED.get(scheme, scheme)
    if scheme in ("hdfs", "viewfs"):
        authority, _, path = rest.removeprefix("//").partition("/")
        return pafs.HadoopFileSystem(f"{scheme}://{authority}" if authority else "default"), "/" + path
    try:
        return pafs.FileSystem.from_uri(f"{scheme}:{rest}")
    except ValueError:
        import fsspec

        store, path = fsspec.core.url_to_fs(uri)
        return pafs.PyFileSystem(pafs.FSSpecHandler(store)), path


@contextmanager
def written(uri: str, attempt: int):
    """A stream to ``uri`` that appears there only when it is complete; a second attempt replaces it by equal bytes.

    Where the work fails, what has been written is taken away again.
    """
    store, path = located(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{attempt}.part"
    try:
        with store.open_output_stream(part) as out:
            yield out
    except BaseException:
        store.delete_file(part)
        raise
    store.move(part, path)


def opened(uri: str):
    """A file to read at any place."""
    store, path = located(uri)
    return store.open_input_file(path)


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` reads, as the optimizer knows them; None where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if all(s < 1 << 60 for s in sizes) else None


def tasks_for(df: DataFrame) -> int:
    """How many tasks write or exchange the rows of ``df``: one for each ``TASK_BYTES``, and all cores busy; the session's number where sizes aren't known."""
    spark = df.sparkSession
    size = input_bytes(df)
    if size is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
