"""Findings of checks as rows, and what is made of them.

A finding has check, severity (PASS, WARN or FAIL), subject and detail. A check that finds nothing
has no rows; checks never stop each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "check string, severity string, subject string, detail string"


def findings(rows: DataFrame, check: str, subject: Column, detail: Column | str = "", severity: str = "FAIL") -> DataFrame:
    """A finding for each row."""
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def flagged(rows: DataFrame, *checks: tuple) -> DataFrame:
    """The findings of several checks in one pass over ``rows``.

    A check is (name, condition, subject) with, if wanted, a detail and a severity; a row has a
    finding of each check whose condition holds.
    """
    parts = []
    for name, when, subject, *rest in checks:
        detail, severity = (*rest, *("", "FAIL")[len(rest) :])
        detail = F.lit(detail) if isinstance(detail, str) else detail
        found = F.struct(
            F.lit(name).alias("check"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")
        )
        parts.append(F.when(when, found))
    return rows.select(F.inline(F.array_compact(F.array(*parts))))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def level(severity: Column) -> Column:
    """2 for FAIL, 1 for WARN, 0 for anything else."""
    return F.when(severity == "FAIL", 2).when(severity == "WARN", 1).otherwise(0)


def rollup(rows: DataFrame, *by: str) -> DataFrame:
    """The greatest level and the number of findings of each severity, overall or ``by`` columns."""
    return rows.groupBy(*by).agg(
        F.coalesce(F.max(level(F.col("severity"))), F.lit(0)).alias("level"),
        F.count_if(F.col("severity") == "FAIL").alias("n_fail"),
        F.count_if(F.col("severity") == "WARN").alias("n_warn"),
        F.count_if(F.col("severity") == "PASS").alias("n_pass"),
    )


def verdict(rows: DataFrame) -> DataFrame:
    """One row: status (PASS or FAIL) and exit_code (0 or 1)."""
    failed = F.count_if(F.col("severity") == "FAIL") > 0
    return rows.agg(F.when(failed, "FAIL").otherwise("PASS").alias("status"), F.when(failed, 1).otherwise(0).alias("exit_code"))


def preview(values: Column, first: int = 10) -> Column:
    """The first items of an array as text, and how many there are more."""
    more = F.size(values) - first
    return F.concat(F.array_join(F.slice(values, 1, first), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit("")))


def as_json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def summary_json(rows: DataFrame, pretty: bool = True) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("value"))


def write_tsv(rows: DataFrame, path: str, *order: str) -> None:
    """Tab-separated without a header, sorted over all files."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").csv(path, sep="\t", emptyValue="", nullValue="", quote="")


def write_report(rows: DataFrame, path: str) -> None:
    """A report that must not be there yet."""
    rows.write.mode("errorifexists").json(path)
