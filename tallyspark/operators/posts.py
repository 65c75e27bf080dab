"""Posts and articles: reading them from files, writing new ones and updating old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import text, urls


def posts(files: DataFrame) -> DataFrame:
    """id, file, title, pub_datetime, body, raw of files (path, content) named ``<digits>/index.md`` or ``.mdx``, sorted by id; the first kind goes before."""
    own = files.select("path", "content", F.regexp_extract("path", r"(?:^|/)(\d+)/index\.mdx?$", 1).alias("id")).where("id <> ''")
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.col("path").endswith(".mdx"), "path"))).where("rank = 1")
    block = text.front_matter(F.col("content"))
    return ranked.select(
        "id",
        F.col("path").alias("file"),
        F.coalesce(text.scalar(block, "title"), F.lit("(no title)")).alias("title"),
        F.coalesce(text.scalar(block, "pubDatetime"), F.lit("")).alias("pub_datetime"),
        text.body(F.col("content")).alias("body"),
        F.col("content").alias("raw"),
    ).orderBy("id")


def articles(files: DataFrame) -> DataFrame:
    """file, title, body, area, tags, description of Markdown files; the first heading or the file's name stands in for a title."""
    block = text.front_matter(F.col("content"))
    body = text.body(F.col("content"))
    given, heading = text.scalar(block, "title"), text.first_heading(body)
    from_heading = given.isNull() & heading.isNotNull()
    name = F.regexp_replace(urls.basename(F.col("path")), r"(?i)\.mdx?$", "")
    return files.where(urls.is_markdown(F.col("path"))).select(
        F.col("path").alias("file"),
        F.coalesce(given, heading, name).alias("title"),
        F.when(from_heading, text.without_first_heading(body)).otherwise(body).alias("body"),
        text.scalar(block, "area").alias("area"),
        text.tag_list(block).alias("tags"),
        text.scalar(block, "description").alias("description"),
    )


def asset_collisions(refs: DataFrame) -> DataFrame:
    """file, base: basenames that stand for more than one source path (refs: file, ref, resolved)."""
    base = urls.basename(F.col("ref")).alias("base")
    return refs.select("file", base, "resolved").groupBy("file", "base").agg(F.count_distinct("resolved").alias("sources")).where("sources > 1")


def asset_refs(rows: DataFrame, key: str = "file", body: str = "body") -> DataFrame:
    """key, ref: local assets that each text refers to."""
    return rows.select(key, F.explode(urls.local_assets(F.col(body))).alias("ref")).distinct()


def _unindented(body: Column) -> Column:
    return F.regexp_replace(body, r"\A\s+", "")


def rendered(rows: DataFrame, post_id: Column, moment: Column, draft: bool = False) -> DataFrame:
    """file, id, content of new posts: front matter and the body with flat assets. ``moment`` is a UTC timestamp."""
    tag_lines = F.transform(F.coalesce("tags", F.array(F.lit("others"))), lambda t: F.concat(F.lit("  - "), text.quoted(t)))
    summary = text.description(F.col("description"), F.col("body"), F.col("title"))
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        F.lit('lang: "zh-CN"'),
        F.concat(F.lit("pubDatetime: "), text.zoned_iso(moment)),
        F.lit('timezone: "Asia/Shanghai"'),
        F.concat(F.lit("title: "), text.quoted(F.col("title"))),
        F.concat(F.lit("area: "), text.quoted(F.col("area"))),
        F.lit("featured: false"),
        F.lit(f"draft: {str(draft).lower()}"),
        F.lit("tags:"),
        F.array_join(tag_lines, "\n"),
        F.concat(F.lit("description: "), text.quoted(summary)),
        F.lit("---"),
        F.lit(""),
    )
    return rows.where("area IS NOT NULL").select("file", post_id.alias("id"), F.concat(head, _unindented(urls.with_flat_assets(F.col("body")))).alias("content"))


def _set_line(lines: Column, key: str, value: Column, also: Column) -> Column:
    """Lines with the value of ``key`` put in where ``also`` holds."""
    return F.transform(lines, lambda x: F.when(x.startswith(f"{key}:") & also, F.concat(F.lit(f"{key}: "), text.quoted(value))).otherwise(x))


def _after(lines: Column, key: str, line: Column) -> Column:
    """Lines with ``line`` after the first of ``key``, at the start if there is none."""
    at = F.coalesce(F.array_position(F.transform(lines, lambda x: x.startswith(f"{key}:")), True), F.lit(0)).cast("int")
    return F.concat(F.slice(lines, 1, at), F.array(line), F.slice(lines, at + 1, F.size(lines)))


def updated(pairs: DataFrame, moment: Column) -> DataFrame:
    """post, content of posts after an article's update (post, raw; title, has_title, area, description, body of the article)."""
    block = text.front_matter(F.col("raw"))
    lines = F.filter(text.lines(block), lambda x: ~x.startswith("modDatetime:"))
    lines = _set_line(lines, "title", F.col("title"), F.col("has_title"))
    lines = _set_line(lines, "area", F.col("area"), F.col("area").isNotNull())
    lines = _set_line(lines, "description", F.col("description"), F.col("description").isNotNull())
    no_area = F.col("area").isNotNull() & ~F.exists(lines, lambda x: x.startswith("area:"))
    lines = F.when(no_area, _after(lines, "title", F.concat(F.lit("area: "), text.quoted(F.col("area"))))).otherwise(lines)
    lines = _after(lines, "pubDatetime", F.concat(F.lit("modDatetime: "), text.zoned_iso(moment)))
    content = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), _unindented(urls.with_flat_assets(F.col("body"))))
    return pairs.select("post", content.alias("content"))


def with_draft(raw: Column, draft: bool) -> Column:
    """The text with its ``draft`` line set."""
    return F.regexp_replace(raw, r"(?m)^draft:[^\r\n]*", f"draft: {str(draft).lower()}")
