"""Source manifests of a book, its generated files and its compile log.

Manifests come as whole files (path, content) or one variant ``v``; file trees as rows
(path, kind, sha256) with paths relative to the folder that is meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import hashing, text, variant
from tallyspark.operators import reconcile, report

#: The mark of places that are still to be resolved, unless the caller has another one.
UNRESOLVED = "UNRESOLVED"
SKIPPED_FOLDERS = ["output", "build", "dist"]


def objects(files: DataFrame) -> DataFrame:
    """path, v and error of files that should hold one JSON object."""
    v = variant.parsed(F.col("content"))
    error = F.when(F.col("content").isNull(), "missing").when(v.isNull(), "cannot be read").when(variant.kind(v) != "OBJECT", "not an object")
    return files.select("path", F.when(error.isNull(), v).alias("v"), error.alias("error"))


def _list(name: str) -> Column:
    return F.coalesce(variant.items(variant.at(F.col("v"), name)), F.array().cast("array<variant>"))


def _texts(manifest: DataFrame, name: str) -> DataFrame:
    return manifest.select(F.explode(_list(name)).alias("x")).where(variant.kind(F.col("x")) == "STRING").select(F.try_variant_get("x", "$", "string").alias("path"))


def chapters(manifest: DataFrame) -> DataFrame:
    """pos (from 1), source, output, source_sha256 (null unless texts) and whether the entry is an object."""
    each = manifest.select(F.posexplode(_list("chapters")).alias("pos", "x"))
    field = lambda k: F.when(variant.kind(variant.at(F.col("x"), k)) == "STRING", F.nullif(variant.at(F.col("x"), k, "string"), F.lit("")))
    return each.select((F.col("pos") + 1).alias("pos"), (variant.kind(F.col("x")) == "OBJECT").alias("is_object"), *[field(k).alias(k) for k in ("source", "output", "source_sha256")])


def images(manifest: DataFrame) -> DataFrame:
    """pos, asset, width, height (null unless integers) and whether the entry is an object."""
    each = manifest.select(F.posexplode(_list("images")).alias("pos", "x"))
    size = lambda k: F.when(variant.is_integer(variant.at(F.col("x"), k)), variant.as_integer(variant.at(F.col("x"), k)))
    asset = F.when(variant.kind(variant.at(F.col("x"), "asset")) == "STRING", F.nullif(variant.at(F.col("x"), "asset", "string"), F.lit("")))
    return each.select((F.col("pos") + 1).alias("pos"), (variant.kind(F.col("x")) == "OBJECT").alias("is_object"), asset.alias("asset"), size("width").alias("width"), size("height").alias("height"))


def _by_path(*sides: tuple[str, DataFrame]) -> DataFrame:
    """path and for each side whether it has the path, from one shuffle of all sides' paths."""
    names = [name for name, _ in sides]
    both = report.all_of([side.select("path", *[F.lit(name == own).alias(name) for name in names]) for own, side in sides])
    return both.groupBy("path").agg(*[F.bool_or(name).alias(name) for name in names])


def chapter_findings(manifest: DataFrame, sources: DataFrame, outputs: DataFrame, extensions: tuple[str, ...] = (".md",)) -> DataFrame:
    """Findings on chapters against the source folder's and the book folder's files. Sources and outputs may repeat.

    Chapters meet the two folders once each and are then looked at in one pass.
    """
    own = chapters(manifest)
    files = sources.where("kind = 'file'")
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    wanted = files.where(ending.isin(*extensions)).select("path")
    declared = own.where("is_object AND source IS NOT NULL").select(F.col("source").alias("path"))
    hashes = files.groupBy(F.col("path").alias("source")).agg(F.max("sha256").alias("actual"), F.lit(True).alias("has_source"))
    places = outputs.where("kind = 'file'").select(F.col("path").alias("output"), F.lit(True).alias("has_output")).distinct()
    both = own.join(hashes, "source", "left").join(places, "output", "left")
    is_object, named = F.col("is_object"), F.col("is_object") & F.col("source").isNotNull()
    well_formed = hashing.is_sha256(F.col("source_sha256"))
    by_chapter = report.flagged(
        both,
        ("chapter is no object", ~is_object, F.col("pos")),
        ("chapter without source", is_object & F.col("source").isNull(), F.col("pos")),
        ("source file missing", named & F.col("has_source").isNull(), F.col("source")),
        ("source hash missing or malformed", named & ~well_formed, F.col("source")),
        ("source hash differs", named & well_formed & F.col("has_source").isNotNull() & ~F.col("source_sha256").eqNullSafe(F.col("actual")), F.col("source"), F.col("actual")),
        ("chapter without output", is_object & F.col("output").isNull(), F.col("pos")),
        ("output file missing", is_object & F.col("output").isNotNull() & F.col("has_output").isNull(), F.col("output")),
    )
    sides = _by_path(("wanted", wanted), ("declared", declared), ("excluded", _texts(manifest, "excluded_sources")))
    asked = F.col("wanted") & ~F.col("excluded")
    by_source = report.flagged(
        sides,
        ("source not in manifest", asked & ~F.col("declared"), F.col("path")),
        ("manifest names a file that is no source", F.col("declared") & ~asked, F.col("path")),
    )
    none = report.findings(manifest.where(F.size(_list("chapters")) == 0), "no chapters", F.lit("manifest"))
    return report.all_of([by_chapter, by_source, none])


def image_findings(manifest: DataFrame, book: DataFrame, figures: str = "assets/figures/") -> DataFrame:
    """Findings on images against the book folder's files; figures must be declared or excluded."""
    own = images(manifest)
    files = book.where("kind = 'file'").select("path").distinct()
    both = own.join(files.select(F.col("path").alias("asset"), F.lit(True).alias("has_asset")), "asset", "left")
    is_object, named = F.col("is_object"), F.col("is_object") & F.col("asset").isNotNull()
    by_image = report.flagged(
        both,
        ("image is no object", ~is_object, F.col("pos")),
        ("image without asset", is_object & F.col("asset").isNull(), F.col("pos")),
        ("image file missing", named & F.col("has_asset").isNull(), F.col("asset")),
        ("image without integer size", named & (F.col("width").isNull() | F.col("height").isNull()), F.col("asset")),
        ("image of no size", named & ((F.col("width") <= 0) | (F.col("height") <= 0)), F.col("asset"), F.concat_ws("x", "width", "height")),
    )
    excluded = _texts(manifest, "excluded_assets")
    found = files.where(F.col("path").startswith(figures))
    declared = own.where("is_object AND asset IS NOT NULL").select(F.col("asset").alias("path"))
    sides = _by_path(("found", found), ("declared", declared), ("excluded", excluded))
    by_figure = report.flagged(sides, ("figure not in manifest", F.col("found") & ~F.col("declared") & ~F.col("excluded"), F.col("path")))
    return report.all_of([by_image, by_figure, report.findings(excluded.where(~F.col("path").startswith(figures)), "excluded asset is no figure", F.col("path"))])


def text_findings(files: DataFrame, ending: str = ".typ", mark: str = UNRESOLVED) -> DataFrame:
    """Findings on generated texts (path, content): marks (a whole word) that remain; folders of builds are left out."""
    parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    own = files.where(F.col("path").endswith(ending) & reconcile.disjoint(parts, SKIPPED_FOLDERS))
    none = own.agg(F.count("*").alias("n")).where("n = 0")
    return report.findings(own.where(F.col("content").rlike(rf"\b\Q{mark}\E\b")), "unresolved mark", F.col("path")).unionByName(report.findings(none, "no generated text", F.lit("book")))


def log_findings(logs: DataFrame) -> DataFrame:
    """Findings on compile logs (path, content): a log must be there and have no line that isn't blank."""
    each = logs.select("path", F.explode(text.lines(F.coalesce("content", F.lit("")), text.ANY_NEWLINE)).alias("line")).where(~text.is_blank(F.col("line")))
    counted = each.groupBy("path").agg(F.count("*").alias("n"))
    return report.findings(counted, "compile diagnostics", F.col("path"), F.col("n")).unionByName(report.findings(logs.where("content IS NULL"), "log missing", F.col("path")))
