"""Release records and lists of visual samples, held against the file that they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import variant
from tallyspark.operators import reconcile, report

# Names of fields, and how code samples may have been treated.
ALIASES = {"sha256": ("pdf_sha256", "sha256"), "page_count": ("pages", "pdf_pages")}
TIMESTAMPS = ("creation_timestamp", "time_strategy", "timestamp_policy")
TREATMENTS = ("confirmed-raw", "retained-ordinary-text")
SAMPLE_FIELDS = ("filename", "output_page", "semantic_class")


def record_value(v: Column, name: str) -> Column:
    """The field of the nested file object if it is there, else the first alias that is."""
    nested = variant.at(v, f"pdf.{name}")
    there = (variant.kind(variant.at(v, "pdf")) == "OBJECT") & (nested.isNotNull() | F.is_variant_null(nested))
    return F.when(F.coalesce(there, F.lit(False)), nested).otherwise(variant.first_present(v, ALIASES[name]))


def record_fields(records: DataFrame) -> DataFrame:
    """path, sha256, page_count, typst_version, build_command, timestamp of records (path, v); and which of them are missing."""
    v = F.col("v")
    values = {
        "sha256": record_value(v, "sha256"),
        "page_count": record_value(v, "page_count"),
        "typst_version": variant.at(v, "typst_version"),
        "build_command": variant.at(v, "build_command"),
        "timestamp": variant.first_present(v, TIMESTAMPS),
    }
    picked = records.select("path", *[x.alias(k) for k, x in values.items()])  # each value is worked out once
    gaps = F.array_compact(F.array(*[F.when(variant.is_missing(F.col(k)), F.lit(k)) for k in values]))
    as_text = lambda k: F.try_variant_get(k, "$", "string").alias(k)
    return picked.select(
        "path", as_text("sha256"), variant.as_integer(F.col("page_count")).alias("page_count"), *map(as_text, ("typst_version", "build_command", "timestamp")), gaps.alias("missing")
    )


def record_findings(records: DataFrame, actual: DataFrame) -> DataFrame:
    """Findings on records against files (path, sha256, page_count): both sides meet once and are looked at in one pass."""
    own = record_fields(records).select("path", F.col("sha256").alias("r_sha"), F.col("page_count").alias("r_pages"), "missing")
    files = actual.select("path", F.col("sha256").alias("a_sha"), F.col("page_count").alias("a_pages"), F.lit(True).alias("has_file"))
    both = own.join(files, "path", "full_outer")
    path, there = F.col("path"), F.coalesce("has_file", F.lit(False))
    rows = both.withColumn("field", F.explode_outer("missing")).withColumn("first", F.col("field").eqNullSafe(F.get("missing", F.lit(0))))
    return report.flagged(
        rows,
        ("field missing", F.col("field").isNotNull(), path, F.col("field")),
        ("hash differs", F.col("first") & there & (F.col("r_sha") != "") & (F.col("r_sha") != F.col("a_sha")), path, F.col("a_sha")),
        ("page count differs", F.col("first") & there & (F.col("r_pages") != F.col("a_pages")), path, F.col("a_pages")),
        ("no pages", F.col("first") & there & (F.coalesce("a_pages", F.lit(0)) < 1), path),
        ("record missing", there & F.col("missing").isNull(), path),
    )


def samples(lists: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, pos, filename, output_page (0 if it is no integer), semantic_class, code_treatment and missing fields of a list (v)."""
    x = F.col("x")
    each = lists.select(*keep, F.posexplode(variant.items(F.col("v"))).alias("pos", "x"))
    fields = ("filename", "semantic_class", "code_treatment")
    there = [variant.has(x, k).alias(f"has_{k}") for k in (*SAMPLE_FIELDS, "code_treatment")]
    texts = [variant.at(x, k, "string").alias(k) for k in fields]
    picked = each.where(variant.kind(x) == "OBJECT").select(*keep, "pos", variant.first_present(x, ("output_page", "page")).alias("page"), *there, *texts)
    page = F.coalesce(variant.as_integer(F.col("page")), F.lit(0).cast("long"))
    own = [F.when(F.col(f"has_{k}"), F.coalesce(F.col(k), F.lit("None"))).otherwise("").alias(k) for k in fields]
    gaps = F.array_compact(F.array(*[F.when(~F.col(f"has_{k}"), F.lit(k)) for k in SAMPLE_FIELDS]))
    return picked.select(*keep, "pos", own[0], page.alias("output_page"), own[1], own[2], gaps.alias("missing"))


SAMPLE_KEY = ["filename", "output_page", "semantic_class", "code_treatment"]


def sample_findings(manifest: DataFrame, files: DataFrame, page_count: int, reported: DataFrame | None = None) -> DataFrame:
    """Findings on samples (as :func:`samples` gives them): fields, files, pages, treatment, repeats, classes, and the report's list."""
    whole = manifest.where(F.size("missing") == 0)
    name, page, is_whole = F.col("filename"), F.col("output_page"), F.size("missing") == 0
    both = manifest.join(files.select(F.col("path").alias("filename"), F.lit(True).alias("has_file")).distinct(), "filename", "left")
    untreated = F.lower("semantic_class").contains("code") & ~F.coalesce(F.col("code_treatment").isin(*TREATMENTS), F.lit(False))
    by_sample = report.flagged(
        both,
        ("sample field missing", ~is_whole, F.col("pos"), F.array_join("missing", ", ")),
        ("sample file missing", is_whole & F.col("has_file").isNull(), name),
        ("page below 1", is_whole & (page < 1), name),
        ("page beyond the end", is_whole & (page > page_count), name),
        ("code sample without treatment", is_whole & untreated, name),
    )
    any_of = lambda words: F.coalesce(F.bool_or(is_whole & F.lower("semantic_class").rlike(words)), F.lit(False))
    classes = manifest.agg(any_of("cover|title").alias("cover"), any_of("code|dense|technical").alias("dense"), F.count_if(is_whole).alias("n"))
    by_list = report.flagged(
        classes,
        ("no samples", F.col("n") == 0, F.lit("manifest")),
        ("no cover or title sample", ~F.col("cover"), F.lit("manifest")),
        ("no code or dense sample", ~F.col("dense"), F.lit("manifest")),
    )
    parts = [by_sample, by_list, report.findings(reconcile.repeated(whole, *SAMPLE_KEY), "repeated sample", name, F.col("n"))]
    if reported is not None:
        place = lambda rows: reconcile.numbered(rows.select("pos", *SAMPLE_KEY), "pos")
        parts.append(report.findings(reconcile.lists_differ(place(whole), place(reported), "pos", SAMPLE_KEY), "report differs from manifest", F.col("pos")))
    return report.all_of(parts)
