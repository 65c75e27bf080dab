"""Corrections, candidates, notes and editions: rules that hold between two ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import reconcile, report

CLOSED = ("applied", "closed", "rejected")


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` is in ``text`` without overlap; an empty part never is."""
    gone = F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))
    return F.when(F.char_length(part) > 0, (gone / F.char_length(part)).cast("int")).otherwise(0)


def applicable(corrections: DataFrame, pages: DataFrame) -> DataFrame:
    """id, page, found, applicable: a correction applies where its page has its text exactly once."""
    both = corrections.join(pages.select("page", "text"), "page", "left")
    found = F.coalesce(occurrences(F.col("text"), F.col("before")), F.lit(0))
    return both.select("id", "page", found.alias("found"), (found == 1).alias("applicable"))


def placed(corrections: DataFrame, pages: DataFrame) -> DataFrame:
    """id, page, at, size, after, overlaps: where each applicable accepted correction stands in the page's own text.

    at counts characters from 1. Corrections of one page that overlap are both marked: neither can be put in.
    """
    asked = corrections.where("status = 'accepted'").groupBy("page").agg(F.collect_list(F.struct("id", "before", "after")).alias("asked"))
    both = asked.join(pages.select("page", "text"), "page")  # a text goes to its corrections once, not once for each
    text = F.col("text")
    places = F.transform("asked", lambda c: F.struct(c.id.alias("id"), F.instr(text, c.before).alias("at"), F.char_length(c.before).alias("size"), F.coalesce(c.after, F.lit("")).alias("after"), occurrences(text, c.before).alias("n")))
    found = both.select("page", F.inline(F.filter(places, lambda c: c.n == 1))).drop("n").select("id", "page", "at", "size", "after")
    order = W.partitionBy("page").orderBy("at", "size", "id")
    reach = F.max(F.col("at") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("overlaps", F.coalesce(reach > F.col("at"), F.lit(False)) | F.coalesce(F.lead("at").over(order) < F.col("at") + F.col("size"), F.lit(False)))


def applied(corrections: DataFrame, pages: DataFrame) -> DataFrame:
    """page, text of the pages after all applicable accepted corrections, each put in at its own place of the original text.

    What one correction writes is never taken for another's text; corrections that overlap are left out.
    """
    own = placed(corrections, pages).where("NOT overlaps").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "size", "after"))).alias("all"))
    both = pages.join(own, "page", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    splice = lambda s, c: F.struct(F.concat(s.out, F.substr("text", s.at, c.at - s.at), c.after).alias("out"), (c.at + c.size).alias("at"))
    text = F.aggregate("all", start, splice, lambda s: F.concat(s.out, F.substr("text", s.at)))
    return both.select("page", F.when(F.col("all").isNull(), F.col("text")).otherwise(text).alias("text"))


def unsettled(corrections: DataFrame) -> DataFrame:
    """Accepted corrections that aren't settled exactly once (rows: id, status)."""
    closed = F.count_if(F.col("status").isin(*CLOSED))
    return corrections.groupBy("id").agg(F.bool_or(F.col("status") == "accepted").alias("accepted"), closed.alias("n")).where("accepted AND n <> 1").select("id", "n")


def reference_findings(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """Findings on pages (page, correction_ids) and corrections (id, page): ids that don't exist, corrections that no page has."""
    named = ledger.select("page", F.explode("correction_ids").alias("id"))
    return report.all_of(
        [
            report.findings(named.join(corrections.select("id"), "id", "left_anti"), "no such correction", F.col("id"), F.col("page")),
            report.findings(corrections.join(named.select("id"), "id", "left_anti"), "correction of no page", F.col("id")),
            report.findings(reconcile.repeated(ledger, "page"), "more than one final status", F.col("page"), F.col("n")),
        ]
    )


def orphans(records: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Records whose parent isn't there."""
    return records.where(F.col(parent).isNotNull()).join(records.select(F.col(key).alias(parent)).distinct(), parent, "left_anti").select(*records.columns)


def unresolved_parents(records: DataFrame, resolved: str = "resolved") -> DataFrame:
    """Parents with a child that isn't in the resolved state."""
    children = records.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count_if(~F.col("status").eqNullSafe(F.lit(resolved))).alias("open"))
    return children.where("open > 0")


def code_runs(lines: DataFrame, signals: list[str], least: int = 2) -> DataFrame:
    """page, first, last, n: runs of consecutive lines each with ``least`` of the signal columns, two lines at least."""
    score = sum((F.col(s).cast("int") for s in signals[1:]), F.col(signals[0]).cast("int"))
    hits = lines.where(score >= least)
    island = F.col("line") - F.row_number().over(W.partitionBy("page").orderBy("line"))
    runs = hits.withColumn("island", island).groupBy("page", "island").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n"))
    return runs.where("n >= 2").drop("island")


def agreement(accepted: DataFrame, emitted: DataFrame, key: str = "id", attributes: list[str] | None = None) -> DataFrame:
    """key, problem of all keys that both sides don't have exactly once each, or whose attributes differ."""
    attributes = attributes or []
    value = F.min(F.struct(*[F.col(a) for a in attributes])) if attributes else F.min(F.lit(1))
    a = accepted.groupBy(key).agg(F.count("*").alias("n_a"), value.alias("v_a"))
    e = emitted.groupBy(key).agg(F.count("*").alias("n_e"), value.alias("v_e"))
    both = a.join(e, key, "full_outer")
    problem = (
        F.when(F.col("n_e").isNull(), "not emitted")
        .when(F.col("n_a").isNull(), "not accepted")
        .when(F.col("n_a") > 1, "accepted more than once")
        .when(F.col("n_e") > 1, "emitted more than once")
        .when(~F.col("v_a").eqNullSafe(F.col("v_e")), "differs")
    )
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def outcomes(annotations: DataFrame, migrated: DataFrame, key: str = "id") -> DataFrame:
    """key, outcomes of annotations that don't have exactly one outcome."""
    n = migrated.groupBy(key).agg(F.count("*").alias("outcomes"))
    return annotations.select(key).distinct().join(n, key, "left").select(key, F.coalesce("outcomes", F.lit(0)).alias("outcomes")).where("outcomes <> 1")


def edition_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Places at which two editions' assets (pos, asset) differ."""
    return reconcile.lists_differ(first, second, "pos", ["asset"])


def title_sequence(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Places at which the chapters' titles (pos, title) differ."""
    return reconcile.lists_differ(expected, actual, "pos", ["title"])


def contents_failures(links: DataFrame, destinations: DataFrame) -> DataFrame:
    """label, problem of contents links (label, target, page) without a destination (target, page) or with another page number."""
    d = destinations.select("target", F.col("page").alias("real"))
    both = links.join(d, "target", "left")
    problem = F.when(F.col("real").isNull(), "no destination").when(F.col("real") != F.col("page"), "page differs")
    return both.select("label", problem.alias("problem")).where("problem IS NOT NULL")


def works(found: DataFrame) -> DataFrame:
    """One row for each canonical address (url, title, date, theme): the earliest dated, then the first title; by theme and date, undated last."""
    order = W.partitionBy("url").orderBy(F.col("date").asc_nulls_last(), "title")
    one = found.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
    return one.orderBy("theme", F.col("date").asc_nulls_last(), "url")


def theme_findings(found: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """A finding if the number of themes isn't between ``least`` and ``most``."""
    n = found.agg(F.count_distinct("theme").alias("n")).where(~F.col("n").between(least, most))
    return report.findings(n, "number of themes", F.lit("themes"), F.col("n"))


def mapping_edges(edges: DataFrame) -> DataFrame:
    """source, output, n: distinct edges of a mapping in which sources and outputs may repeat."""
    return edges.groupBy("source", "output").agg(F.count("*").alias("n"))


def pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """element, problem of bilingual elements (element, pos, parent): missing, repeated, elsewhere in the hierarchy, or out of order.

    Elements are paired by their id only, never by being side by side.
    """
    counted = agreement(first, second, "element", ["parent"])
    place = lambda d: d.groupBy("element", "parent").agg(F.min("pos").alias("pos"))
    both = place(first).alias("a").join(place(second).alias("b"), ["element", "parent"]).select("element", "parent", F.col("a.pos").alias("pa"), F.col("b.pos").alias("pb"))
    by_first, by_second = W.partitionBy("parent").orderBy("pa", "element"), W.partitionBy("parent").orderBy("pb", "element")
    moved = both.withColumn("ra", F.row_number().over(by_first)).withColumn("rb", F.row_number().over(by_second)).where("ra <> rb")
    return counted.unionByName(moved.select("element", F.lit("out of order").alias("problem")))
