"""Checks of laid-out pages over tables of documents, pages, words, fonts, spans, drawings and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import hashing, text
from tallyspark.operators import report

# Marks of fixtures, font names for other scripts, tolerances in points.
FIXTURE_MARK = "NOT FOR RELEASE"
CJK_FONTS = "cjk|sourcehan|simsun|simhei"
TRIM_TOLERANCE, BOUNDS_TOLERANCE = 0.2, 0.5
BODY_FROM = 3


def _subject() -> Column:
    return F.concat_ws(" p. ", "doc", "page")


def readability(pages: DataFrame) -> DataFrame:
    """doc, pages, pages_with_text, text_characters and whether any text was found."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    return pages.groupBy("doc").agg(F.count("*").alias("pages"), F.count_if(n > 0).alias("pages_with_text"), F.sum(n).alias("text_characters"), F.bool_or(n > 0).alias("searchable"))


def _off_bounds(pages: DataFrame, words: DataFrame, low: float, high: float) -> DataFrame:
    out = words.join(pages.select("doc", "page", "width", "height"), ["doc", "page"]).where(
        (F.col("x0") < -low) | (F.col("y0") < -low) | (F.col("x1") > F.col("width") + high) | (F.col("y1") > F.col("height") + high)
    )
    return out.select("doc", "page").distinct()


def page_findings(docs: DataFrame, pages: DataFrame, words: DataFrame, fonts: DataFrame, size_mm: tuple[float, float] = (176, 250)) -> DataFrame:
    """Findings on documents: password, repair, number of pages, trim size, fixtures, words out of bounds, fonts, searchable text.

    A document that needs a password has only that finding. A font counts once, on its first page.
    """
    open_docs = docs.where("NOT needs_pass")
    own = lambda rows: rows.join(open_docs.select("doc"), "doc", "left_semi")
    pages, words, fonts = own(pages), own(words), own(fonts)
    trim = [F.abs(F.col(c) - text.in_points(mm)) > TRIM_TOLERANCE for c, mm in zip(("width", "height"), size_mm, strict=True)]
    counts = open_docs.join(pages.groupBy("doc").agg(F.count("*").alias("n")), "doc", "left").where("coalesce(n, 0) < 2")
    bodies = pages.where((F.col("page") >= BODY_FROM) & ~text.is_blank(F.col("text"))).select("doc").distinct()
    loose = fonts.groupBy("doc", "xref").agg(F.min_by(F.struct("page", "name", "embedded"), "page").alias("f"))
    loose = loose.select("doc", "xref", "f.*").where((F.col("xref") == 0) | ~F.coalesce("embedded", F.lit(False)))
    return report.all_of(
        [
            report.findings(docs.where("needs_pass"), "needs a password", F.col("doc")),
            report.findings(open_docs.where("repaired"), "needed repair", F.col("doc")),
            report.findings(counts, "fewer than two pages", F.col("doc")),
            report.findings(pages.where(trim[0] | trim[1]), "unexpected trim", _subject()),
            report.findings(pages.where(F.col("text").contains(FIXTURE_MARK)), "fixture artwork", _subject()),
            report.findings(_off_bounds(pages, words, BOUNDS_TOLERANCE, BOUNDS_TOLERANCE), "text out of bounds", _subject()),
            report.findings(loose, "font not embedded", _subject(), F.col("name")),
            report.findings(open_docs.join(bodies, "doc", "left_anti"), "no searchable body", F.col("doc")),
        ]
    )


def template_findings(pages: DataFrame, words: DataFrame, drawings: DataFrame, size_mm: tuple[float, float] = (176, 250)) -> DataFrame:
    """Stricter findings on compiled templates: bounds, odd chapter starts, blank pages, folios and rules of body pages.

    drawings: doc, page, x0, y0, x1, y1. Chapter pages have CHAPTER or PART in their text; the
    running head lies above 22 mm, 19 mm from the binding and 16 mm from the edge.
    """
    mm = lambda n: text.in_points(n)
    odd = F.col("page") % 2 == 1
    blank = text.is_blank(F.col("text"))
    starts = pages.where(F.col("text").rlike(r"CHAPTER|PART I") & ~odd)
    by_doc = W.partitionBy("doc").orderBy("page")
    verso = pages.withColumn("blank_before", F.lag(blank).over(by_doc)).where(F.col("text").contains("PART I") & ~F.coalesce("blank_before", F.lit(False)))
    drawn = drawings.select("doc", "page").distinct()
    furnished = pages.where(blank).join(drawn, ["doc", "page"], "left_semi")
    trim = [F.abs(F.col(c) - text.in_points(n)) >= 0.1 for c, n in zip(("width", "height"), size_mm, strict=True)]
    heads = words.where((F.col("page") >= BODY_FROM) & (F.col("y1") < mm(22))).join(pages.select("doc", "page", "width"), ["doc", "page"])
    left = F.when(odd, mm(19)).otherwise(mm(16))
    right = F.col("width") - F.when(odd, mm(16)).otherwise(mm(19))
    outside = F.when(odd, F.abs(F.col("x1") - right) < 1).otherwise(F.abs(F.col("x0") - left) < 1)
    is_folio = F.col("word") == F.col("page").cast("string")
    folios = heads.groupBy("doc", "page").agg(F.count_if(is_folio).alias("n"), F.count_if(is_folio & outside).alias("placed"), F.first("width").alias("width"))
    rules = drawings.where((F.col("y1") < mm(22)) & (F.col("x1") - F.col("x0") > 300)).join(folios.select("doc", "page", "width"), ["doc", "page"])
    ruled = rules.where((F.abs(F.col("x0") - left) < 0.2) & (F.abs(F.col("x1") - right) < 0.2)).select("doc", "page").distinct()
    sides = folios.groupBy("doc").agg(F.count_distinct(odd).alias("sides")).where("sides < 2")
    return report.all_of(
        [
            report.findings(pages.where(trim[0] | trim[1]), "unexpected trim", _subject()),
            report.findings(_off_bounds(pages, words, 0.0, 0.1), "text out of bounds", _subject()),
            report.findings(starts, "chapter on an even page", _subject()),
            report.findings(verso, "page before a part is not blank", _subject()),
            report.findings(furnished, "drawing on a blank page", _subject()),
            report.findings(pages.where((F.col("page") == BODY_FROM) & blank), "blank page before the first chapter", _subject()),
            report.findings(folios.where("n <> 1"), "not one folio", _subject(), F.col("n")),
            report.findings(folios.where("n = 1 AND placed <> 1"), "folio is not outside", _subject()),
            report.findings(folios.join(ruled, ["doc", "page"], "left_anti"), "no mirrored rule", _subject()),
            report.findings(sides, "only one side of body pages", F.col("doc")),
        ]
    )


def latin_by_font(spans: DataFrame) -> DataFrame:
    """doc, font and how many Latin letters and digits it sets (spans: doc, page, font, size, bbox, chars)."""
    n = hashing.latin_named(F.array_join("chars", ""))
    return spans.select("doc", "font", n.alias("n")).where("n > 0").groupBy("doc", "font").agg(F.sum("n").alias("latin"))


def mixed_fonts(spans: DataFrame) -> DataFrame:
    """Spans that set Latin letters or digits in a font for another script."""
    n = hashing.latin_named(F.array_join("chars", ""))
    cjk = F.lower("font").rlike(CJK_FONTS)
    return spans.where(cjk).withColumn("latin", n).where("latin > 0").select("doc", "page", "font", text.half_even(F.col("size"), 3).alias("size"), F.array_join("chars", "").alias("text"), "latin", "bbox")


def roles(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """doc, page, role, running: of the last mark at or before each page; an opener's following pages are body.

    Marks (doc, page, seq, role, running) are few against pages; the fill is one ordered pass of each document.
    """
    last = marks.groupBy("doc", "page").agg(F.max_by(F.struct("role", "running", "page"), "seq").alias("mark"))
    filled = pages.select("doc", "page").distinct().join(last, ["doc", "page"], "full_outer")
    order = W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    at = filled.withColumn("m", F.last("mark", ignorenulls=True).over(order)).join(pages.select("doc", "page").distinct(), ["doc", "page"], "left_semi")
    role = F.when(F.col("m").isNull(), "front").when((F.col("m.role") == "opener") & (F.col("m.page") < F.col("page")), "body").otherwise(F.col("m.role"))
    return at.select("doc", "page", role.alias("role"), F.col("m.running").alias("running"))


def is_latin(char: Column) -> Column:
    return char.rlike(r"^(?:[0-9]|\p{IsLatin})$")
