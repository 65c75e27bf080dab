"""Page-status ledgers: one final status for every page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import text, variant
from tallyspark.operators import reconcile, report

# Statuses that leave a page open, and names of the page's key in their order.
OPEN_STATUSES = ("open", "pending", "unresolved", "needs-review", "needs_review")
PAGE_KEYS = ("page", "source_page", "page_number")


def records(files: DataFrame) -> DataFrame:
    """path, record_no (from 1), record (variant) and error of whole files (path, content).

    A file is a JSON list, an object with a list ``records``, or else JSON lines with blank lines
    between. One object alone is an object without ``records``, and so an error, as is an empty file.
    """
    trimmed = text.trim(F.col("content"))
    whole = files.select("path", trimmed.alias("content"), variant.parsed(trimmed).alias("v"))
    listed = F.when(variant.kind(F.col("v")) == "ARRAY", variant.items(F.col("v"))).when(
        (variant.kind(F.col("v")) == "OBJECT") & (variant.kind(variant.at(F.col("v"), "records")) == "ARRAY"), variant.items(variant.at(F.col("v"), "records"))
    )
    whole = whole.withColumn("listed", listed)
    empty = whole.where("content = ''").select("path", F.lit(None).cast("int").alias("record_no"), F.lit(None).cast("variant").alias("record"), F.lit("empty").alias("error"))
    wrong = whole.where("content <> '' AND v IS NOT NULL AND listed IS NULL").select(
        "path", F.lit(None).cast("int").alias("record_no"), F.lit(None).cast("variant").alias("record"), F.lit("no list of records").alias("error")
    )
    from_json = whole.where("listed IS NOT NULL").select("path", F.posexplode("listed").alias("pos", "record"))
    from_json = from_json.select("path", (F.col("pos") + 1).alias("record_no"), "record")
    from_lines = whole.where("content <> '' AND v IS NULL").select("path", F.posexplode(text.lines(F.col("content"), text.ANY_NEWLINE)).alias("pos", "line"))
    from_lines = from_lines.where(~text.is_blank(F.col("line"))).select("path", (F.col("pos") + 1).alias("record_no"), variant.parsed(F.col("line")).alias("record"))
    both = from_json.unionByName(from_lines)
    error = F.when(F.col("record").isNull(), "invalid JSON").when(variant.kind(F.col("record")) != "OBJECT", "not an object")
    return both.select("path", "record_no", "record", error.alias("error")).unionByName(empty).unionByName(wrong)


def page_of(record: Column) -> Column:
    """The integer under the first page key that is there; null if none is or its value is no integer."""
    return variant.as_integer(variant.first_present(record, PAGE_KEYS))


def pages(read: DataFrame) -> DataFrame:
    """path, record_no, page, status and error of ledger records."""
    r = F.col("record")
    there = F.array_max(F.array(*[variant.has(r, key) for key in PAGE_KEYS]))
    picked = read.select("path", "record_no", "error", there.alias("there"), variant.first_present(r, PAGE_KEYS).alias("value"), variant.at(r, "status", "string").alias("status"))
    own = picked.withColumn("page", variant.as_integer(F.col("value")))
    error = F.coalesce("error", F.when(~F.col("there"), "no page key"), F.when(F.col("page").isNull(), "page is no integer"))
    return own.select("path", "record_no", "page", "status", error.alias("error"))


def is_open(status: Column) -> Column:
    return text.folded(status).isin(*OPEN_STATUSES)


def findings(spark: SparkSession, ledger: DataFrame, page_count: int, allow_open: bool = False) -> DataFrame:
    """Findings on a ledger (page, status) of ``page_count`` pages: missing, repeated, extra and open pages."""
    if page_count < 1:
        raise ValueError("page_count must be positive")
    expected = spark.range(1, page_count + 1).select(F.col("id").alias("page"))
    own = ledger.select(F.col("page").cast("long").alias("page"), "status")
    return report.all_of(
        [
            report.findings(reconcile.missing(expected, own, "page"), "missing page", F.col("page")),
            report.findings(own.select("page").distinct().where(~F.col("page").between(1, page_count)), "page out of range", F.col("page")),
            report.findings(reconcile.repeated(own, "page"), "repeated page", F.col("page"), F.col("n")),
            report.findings(own.where(is_open(F.col("status"))), "open page", F.col("page"), F.col("status"), "WARN" if allow_open else "FAIL"),
        ]
    )


def gaps(ledger: DataFrame, by: str, place: str, first: int = 0) -> DataFrame:
    """by, records, missing, repeated of groups whose places, from ``first`` to the last one that is there, aren't each there once.

    Rows are first brought to one for each place by partial sums, so that a large group isn't one task.
    """
    places = ledger.groupBy(by, place).agg(F.count("*").alias("n"))
    found = places.groupBy(by).agg(
        F.sum("n").alias("records"), (F.max(place) + 1 - first - F.count("*")).cast("long").alias("missing"), F.count_if(F.col("n") > 1).alias("repeated")
    )
    return found.where("missing > 0 OR repeated > 0")


def missing_intervals(ledger: DataFrame, spans: DataFrame, by: str, place: str) -> DataFrame:
    """by, first, last, n: the runs of places that aren't there, within each group's span (by, low, high); groups without any place too.

    A run begins after a place that is there, or at the span's start, and ends before one, or at its
    end: both are found by joins, and only these ends are put in order within a group.
    """
    own = ledger.select(by, F.col(place).cast("long").alias("at")).join(spans.select(by, "low", "high"), by).where(F.col("at").between(F.col("low"), F.col("high"))).select(by, "at").distinct()
    edges = spans.select(by, F.explode(F.array((F.col("low") - 1).cast("long"), (F.col("high") + 1).cast("long"))).alias("at"))
    every = own.unionByName(edges)
    after = every.select(by, (F.col("at") + 1).alias("at")).join(every, [by, "at"], "left_anti").select(by, "at", F.lit(0).alias("end"))
    before = every.select(by, (F.col("at") - 1).alias("at")).join(every, [by, "at"], "left_anti").select(by, "at", F.lit(1).alias("end"))
    ends = after.unionByName(before).join(spans.select(by, "low", "high"), by).where(F.col("at").between(F.col("low"), F.col("high")))
    paired = ends.withColumn("last", F.lead("at").over(W.partitionBy(by).orderBy("at", "end")))
    return paired.where("end = 0").select(by, F.col("at").alias("first"), "last", (F.col("last") - F.col("at") + 1).alias("n"))


def summary(spark: SparkSession, ledger: DataFrame, page_count: int) -> DataFrame:
    """One row: records, expected_pages, covered_pages, and sorted lists of missing, repeated, extra and open pages.

    For ledgers whose lists fit into a row; :func:`missing_intervals` has a row for each run of missing ones.
    """
    found = findings(spark, ledger, page_count)
    pages_of = lambda check: F.array_sort(F.collect_list(F.when(F.col("check") == check, F.col("subject").cast("long"))))
    lists = found.agg(
        pages_of("missing page").alias("missing_pages"),
        pages_of("repeated page").alias("duplicate_pages"),
        pages_of("page out of range").alias("out_of_range_pages"),
        pages_of("open page").alias("unresolved_pages"),
    )
    counts = ledger.agg(
        F.count("*").alias("records"), F.lit(page_count).alias("expected_pages"), F.count_distinct(F.when(F.col("page").between(1, page_count), F.col("page"))).alias("covered_pages")
    )
    return counts.join(F.broadcast(lists))
