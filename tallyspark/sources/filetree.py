"""A Spark data source of file trees: every entry, hidden ones too, links recorded and not followed.

``spark.read.format("filetree").load(root)`` or ``option("roots", JSON list)``. Rows have root,
path (relative), depth, kind (file, dir, symlink or other), mode (octal), size, sha256 of files and
target of links. Each root is listed on the driver to one level; the entries found there are the
partitions, so that trees are walked and hashed by the executors. Roots must be visible to them.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyspark.functions import hashing
from tallyspark.plans.session import ship_code

SCHEMA = "root string, path string, depth int, kind string, mode string, size bigint, sha256 string, target string"
BLOCK = 1 << 20


def sha256_of(path: str) -> str:
    state = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            state.update(block)
    return state.hexdigest()


class _Part(InputPartition):
    def __init__(self, root: str, path: str, deep: bool):
        super().__init__(None)
        self.root, self.path, self.deep = root, path, deep


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], hashed: bool):
        self.roots, self.hashed = roots, hashed

    def partitions(self):
        return [_Part(root, name, True) for root in self.roots for name in sorted(os.listdir(root))] or [_Part("", "", False)]

    def read(self, part: _Part) -> Iterator[tuple]:
        if part.deep:
            yield from self._under(part.root, part.path)

    def _under(self, root: str, path: str) -> Iterator[tuple]:
        full = os.path.join(root, path)
        info = os.lstat(full)
        kind = {stat.S_IFREG: "file", stat.S_IFDIR: "dir", stat.S_IFLNK: "symlink"}.get(stat.S_IFMT(info.st_mode), "other")
        sha = sha256_of(full) if kind == "file" and self.hashed else None
        yield root, path, path.count("/") + 1, kind, oct(stat.S_IMODE(info.st_mode)), info.st_size, sha, os.readlink(full) if kind == "symlink" else None
        if kind == "dir":
            for name in sorted(os.listdir(full)):
                yield from self._under(root, f"{path}/{name}")


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        roots = json.loads(self.options["roots"]) if "roots" in self.options else [self.options["path"]]
        return _Reader([os.path.abspath(r) for r in roots], self.options.get("hashes", "true").lower() == "true")


def read(spark: SparkSession, *roots: str, hashes: bool = True) -> DataFrame:
    ship_code(spark)
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("roots", json.dumps(list(roots))).option("hashes", str(hashes).lower()).load()


def write(entries: DataFrame, base: str) -> str:
    """Writes files (path, content) and links (path, target) below ``base``; the plain path of ``base``.

    Executors write them, each under a name of its own outside the tree and renamed, so that a second
    attempt replaces an entry by an equal one. ``base`` must be an address of files (links need paths);
    a path that leaves ``base`` fails. Null content is an empty file.
    """
    scheme, colon, rest = base.partition(":")
    if colon and "/" not in scheme and scheme != "file":
        raise ValueError(f"a tree of files and links needs a folder with paths, not {base}")
    top = "/" + (rest if colon and "/" not in scheme else base).lstrip("/")
    ship_code(entries.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = 0
        for frame in frames:
            for path, content, target in frame.itertuples(index=False):
                _put(top, path, content, target)
                done += 1
        yield pd.DataFrame({"n": [done]})

    entries.select("path", "content", "target").mapInPandas(run, "n bigint").agg(F.sum("n")).collect()
    return f"{top}/tree"


def _put(top: str, path: str, content: str | None, target: str | None) -> None:
    full = os.path.normpath(f"{top}/tree/{path}")
    if not full.startswith(f"{top}/tree/"):
        raise ValueError(f"a path leaves its tree: {path}")
    part = f"{top}/parts/{uuid.uuid4().hex}"
    for folder in (os.path.dirname(full), os.path.dirname(part)):
        os.makedirs(folder, exist_ok=True)
    if target is not None:
        os.symlink(target, part)
    else:
        with open(part, "w", encoding="utf-8", newline="") as f:
            f.write(content or "")
        os.chmod(part, 0o644)
    os.replace(part, full)


def with_ending(tree: DataFrame, *endings: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Files with one of the endings (any case) that lie in none of the skipped folders."""
    name = F.lower("path")
    end = F.lit(False)
    for e in endings:
        end = end | name.endswith(e.lower())
    folders = F.slice(F.split("path", "/"), 1, F.col("depth") - 1)
    return tree.where((F.col("kind") == "file") & end & ~F.arrays_overlap(folders, F.array(*map(F.lit, skipped)) if skipped else F.array().cast("array<string>")))


def level(tree: DataFrame, depth: int = 1) -> DataFrame:
    return tree.where(F.col("depth") == depth)


def fingerprints(tree: DataFrame) -> DataFrame:
    """root, fingerprint: one hash of all files and links of each root by path, kind, mode and content or target.

    Folders don't count. Sorted by path, each entry is a line of JSON. Other kinds of entries fail.
    Hashing is sequential by definition: a root's entries are sorted in one task and hashed as they come.
    """
    bad = F.raise_error(F.concat(F.lit("neither file nor link: "), F.col("path")))
    own = tree.where("kind <> 'dir'").withColumn("kind", F.when(F.col("kind").isin("file", "symlink"), F.col("kind")).otherwise(bad))
    line = hashing.entry_json(F.col("kind"), F.col("mode"), F.col("path"), F.col("sha256"), F.col("target"))
    ordered = own.select("root", "path", line.alias("line")).repartition("root").sortWithinPartitions("root", "path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, state = None, None
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.root != root:
                    if root is not None:
                        yield pd.DataFrame([(root, state.hexdigest())], columns=["root", "fingerprint"])
                    root, state = r.root, hashlib.sha256()
                state.update(r.line.encode() + b"\n")
        if root is not None:
            yield pd.DataFrame([(root, state.hexdigest())], columns=["root", "fingerprint"])

    return ordered.select("root", "line").mapInPandas(run, "root string, fingerprint string")
