"""Reconciling two sets or lists: what is missing, extra, repeated, changed or out of order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def missing(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys that are expected and not there. Null keys equal each other."""
    keys = list(keys)
    return expected.select(*keys).distinct().alias("e").join(actual.select(*keys).alias("a"), _same("e", "a", keys), "left_anti")


def covered(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys that are expected and there."""
    keys = list(keys)
    return expected.select(*keys).distinct().alias("e").join(actual.select(*keys).alias("a"), _same("e", "a", keys), "left_semi")


def undeclared(found: DataFrame, declared: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are found and neither declared nor excluded."""
    return missing(found, declared.select(key).union(excluded.select(key)), key)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row, and how many they have."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def has_repeats(rows: DataFrame, *keys: str) -> DataFrame:
    """One row: whether some key has more than one row."""
    return rows.agg((F.count("*") != F.count_distinct(F.struct(*keys))).alias("repeated"))


def audit(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row: counts of records, expected and covered keys, and of missing, extra and repeated ones.

    Both sides are first brought to a row per key, so that one shuffle of partial sums serves all counts.
    """
    sides = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(key, F.lit(0).alias("e"), F.lit(1).alias("a")))
    by_key = sides.groupBy(key).agg(F.max("e").alias("e"), F.sum("a").alias("a"))
    count = lambda when, name: F.count_if(when).alias(name)
    return by_key.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("records"),
        count(F.col("e") == 1, "expected"),
        count((F.col("e") == 1) & (F.col("a") > 0), "covered"),
        count((F.col("e") == 1) & (F.col("a") == 0), "missing"),
        count((F.col("e") == 0) & (F.col("a") > 0), "extra"),
        count(F.col("a") > 1, "repeated"),
    )


def drifted(recorded: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """key, recorded and actual value where both sides have the key and the values differ; null values are equal."""
    both = recorded.select(key, F.col(value).alias("recorded")).join(actual.select(key, F.col(value).alias("actual")), key)
    return both.where(~F.col("recorded").eqNullSafe(F.col("actual")))


def compared(local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """key and state (missing, equal or different) of every local row; rows only remote has are ignored."""
    there = remote.select(key, F.col(value).alias("other"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col(value).eqNullSafe(F.col("other")), "equal").otherwise("different")
    return local.select(key, value).join(there, key, "left").select(key, state.alias("state"))


def numbered(rows: DataFrame, order: str, run: int = 10_000) -> DataFrame:
    """``rows`` with ``order``, distinct numbers from 0 on with gaps, replaced by places without gaps.

    Places are counted within runs of numbers and added up over runs, so that no task has all rows.
    """
    at = rows.withColumn("__run", F.floor(F.col(order) / run))
    sizes = at.groupBy("__run").agg(F.count("*").alias("n"))
    before = sizes.select("__run", (F.sum("n").over(W.orderBy("__run").rowsBetween(W.unboundedPreceding, -1))).alias("__before"))
    inner = at.withColumn("__place", F.row_number().over(W.partitionBy("__run").orderBy(order)) - 1)
    return inner.join(before, "__run").withColumn(order, F.coalesce("__before", F.lit(0)) + F.col("__place")).select(*rows.columns)


def lists_differ(first: DataFrame, second: DataFrame, place: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Places at which two ordered lists differ, or one has ended: ``by``, place and the two values as structs."""
    keys = [*(by or []), place]
    a = first.select(*keys, F.struct(*columns).alias("first"), F.lit(True).alias("in_first"))
    b = second.select(*keys, F.struct(*columns).alias("second"), F.lit(True).alias("in_second"))
    both = a.join(b, keys, "full_outer")
    same = F.col("in_first").isNotNull() & F.col("in_second").isNotNull() & F.col("first").eqNullSafe(F.col("second"))
    return both.where(~same).drop("in_first", "in_second")


def same_lists(first: DataFrame, second: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """One row: whether the lists are equal."""
    return lists_differ(first, second, place, columns).agg((F.count("*") == 0).alias("equal"))


def changed_fields(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """Of two one-row tables the fields whose values differ; null equals null."""
    a, b = before.select(F.struct(*fields).alias("a")), after.select(F.struct(*fields).alias("b"))
    changed = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]
    return a.join(F.broadcast(b)).select(F.explode(F.array_compact(F.array(*changed))).alias("field"))


def required(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and field of every field that is null or empty."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(key, F.inline(pairs)).where("value IS NULL OR value = ''").select(key, "field")


def exclusive(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that don't have exactly one owner, and how many they have."""
    return rows.groupBy(key).agg(F.count_distinct(owner).alias("owners")).where("owners <> 1")


def lookup_failures(rows: DataFrame, files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """The rows whose key is null or no path of ``files``."""
    return rows.join(files.select(F.col(path).alias(key)).distinct(), key, "left_anti")


def sorted_distinct(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct().orderBy(column)


def disjoint(parts: Column, excluded: list[str]) -> Column:
    """Whether an array has none of the excluded values."""
    return ~F.arrays_overlap(parts, F.array(*map(F.lit, excluded)))
