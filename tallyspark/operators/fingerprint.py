"""Fingerprints of groups of any size: hashes of bounded runs of entries, then hashes of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import hashing


def of_groups(rows: DataFrame, group: str, number: str, entry: Column, run: int = 1000, levels: int = 2) -> DataFrame:
    """group, fingerprint, entries. Entries are ordered by ``number``; at each level ``run`` numbers in a row are folded into one.

    What is left after ``levels`` foldings is folded last. No task holds more than a run, and the
    last one as many runs as ``levels`` leave.
    """
    now = rows.select(group, F.col(number).cast("long").alias("k"), entry.alias("e"), F.lit(1).cast("long").alias("n"))
    for _ in range(levels):
        now = _fold(now.withColumn("run", F.floor(F.col("k") / run)), [group, "run"]).select(group, F.col("run").alias("k"), F.col("e"), "n")
    return _fold(now, [group]).select(group, F.col("e").alias("fingerprint"), F.col("n").alias("entries"))


def _fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("all"), F.sum("n").alias("n"))
    return packed.select(*keys, hashing.folded(F.transform("all", lambda x: x.e)).alias("e"), "n")
