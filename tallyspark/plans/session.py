"""Session helpers shared by every operator: shared storage and code shipping."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
_OWN: dict[str, str] = {}
_SHIPPED: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, a laptop) a folder of this machine is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base:
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        base = _OWN[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    p, fs = store_of(spark, base)
    return fs.makeQualified(p).toString().rstrip("/")  # a path without a scheme is one of the default store


def workspace(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tallyspark/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def store_of(spark: SparkSession, path: str):
    """(path, file system) of Hadoop for an address."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = store_of(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, path: str) -> None:
    try:
        p, fs = store_of(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may have ended already
        return


def claim(spark: SparkSession, path: str, content: bytes) -> bool:
    """Makes the file unless there is one: whether it is this writer's. No reader sees it half written.

    Exclusive on local and HDFS-like stores; on stores whose rename replaces files there must be one writer only.
    """
    final, fs = store_of(spark, path)
    part = store_of(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.part")[0]
    out = fs.create(part, True)
    try:
        out.write(content)
    finally:
        out.close()
    if fs.getUri().getScheme() == "file":  # a link is made at once or not at all
        source, target = (p.toUri().getPath() for p in (part, final))
        try:
            os.link(source, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, final, options)
        return True
    except Exception:
        if not fs.exists(final):
            raise
        fs.delete(part, False)
        return False


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends in files that survive executors."""
    spark = df.sparkSession
    path = f"{workspace(spark, label)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to a few MB, so that a Python worker's memory doesn't depend on the length of texts."""
    number, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(BATCH_CONF).strip().lower()).groups()
    size = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def ship_code(spark: SparkSession) -> None:
    """Gives executors this package, whatever their Python path is, and bounds what goes to Python at once."""
    bound_batches(spark)
    root = Path(__file__).resolve().parents[1]
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    key = (spark.sparkContext.applicationId, digest)
    if key in _SHIPPED:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for f in files:
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = Path(tempfile.mkdtemp(prefix="tallyspark-code-")) / f"tallyspark-{digest}.zip"
    path.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(key)
