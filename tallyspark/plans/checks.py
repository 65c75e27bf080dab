"""Queries for checks of records, templates, fonts and written posts, over the driver tables as they are.

The SQL applies each check's rule to the same rows; where an input is built, both sides build it from
the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text, urls
from tallyspark.operators import layout, ledger, manifest, match, notes, posts, queue, reconcile, report
from tallyspark.plans import built
from tallyspark.plans.tables import table
from tallyspark.streaming import queue as stream

CHECKS: list[tuple[str, str, Callable[[SparkSession, str], DataFrame]]] = []


def _check(name: str, sql: str):
    def keep(build):
        CHECKS.append((name, sql, build))
        return build

    return keep


# Templates and fonts

_PAGES = """
WITH d AS (SELECT doc_id AS i, coalesce(text, '') AS raw, length(coalesce(text, '')) AS n FROM documents),
p AS (SELECT 'd' || i // 10 AS doc, CAST(i % 10 + 1 AS INTEGER) AS page, n, 176 * 72 / 25.4::DOUBLE + CASE WHEN n % 7 = 0 THEN 0.5 ELSE 0.0 END AS width, 250 * 72 / 25.4::DOUBLE AS height,
  CASE WHEN n % 6 = 0 THEN ' ' WHEN n % 6 = 1 THEN 'CHAPTER ' || n WHEN n % 6 = 2 THEN 'PART I' ELSE raw END AS text FROM d),
q AS (SELECT *, page % 2 = 1 AS odd, CASE WHEN page % 2 = 1 THEN 19 ELSE 16 END * 72 / 25.4::DOUBLE AS l, width - CASE WHEN page % 2 = 1 THEN 16 ELSE 19 END * 72 / 25.4::DOUBLE AS r, trim(text, ' ' || chr(10)) = '' AS blank FROM p),
w AS (
  SELECT doc, page, CASE WHEN n % 5 = 0 THEN 'x' ELSE CAST(page AS VARCHAR) END AS word, CASE WHEN odd THEN r - 10 ELSE l END + CASE WHEN n % 4 = 0 THEN 3 ELSE 0 END AS x0, CASE WHEN odd THEN r ELSE l + 10 END + CASE WHEN n % 4 = 0 THEN 3 ELSE 0 END AS x1, 40.0 AS y0, 50.0 AS y1 FROM q
  UNION ALL SELECT doc, page, 'body', 100.0, CASE WHEN n % 11 = 0 THEN width + 0.2 ELSE 200.0 END, 300.0, 310.0 FROM q),
g AS (SELECT doc, page, l + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS x0, r AS x1, 55.0 AS y0, 56.0 AS y1 FROM q WHERE n % 8 <> 0)
"""


@_check(
    "q50_template_pages",
    _PAGES
    + """, h AS (SELECT w.*, width, odd, l, r, word = CAST(page AS VARCHAR) AS folio, CASE WHEN odd THEN abs(x1 - r) < 1 ELSE abs(x0 - l) < 1 END AS outside FROM w JOIN q USING (doc, page) WHERE page >= 3 AND y1 < 22 * 72 / 25.4::DOUBLE),
f AS (SELECT doc, page, odd, l, r, count(*) FILTER (folio) AS n, count(*) FILTER (folio AND outside) AS placed FROM h GROUP BY doc, page, odd, l, r),
ruled AS (SELECT DISTINCT doc, page FROM g JOIN f USING (doc, page) WHERE g.x1 - g.x0 > 300 AND abs(g.x0 - l) < 0.2 AND abs(g.x1 - r) < 0.2),
prior AS (SELECT *, lag(blank) OVER (PARTITION BY doc ORDER BY page) AS blank_before FROM q),
a AS (
  SELECT 'unexpected trim' AS "check", doc, page, '' AS detail FROM q WHERE abs(width - 176 * 72 / 25.4::DOUBLE) >= 0.1
  UNION ALL SELECT DISTINCT 'text out of bounds', doc, page, '' FROM w JOIN q USING (doc, page) WHERE x0 < 0 OR y0 < 0 OR x1 > width + 0.1 OR y1 > height + 0.1
  UNION ALL SELECT 'chapter on an even page', doc, page, '' FROM q WHERE NOT odd AND (contains(text, 'CHAPTER') OR contains(text, 'PART I'))
  UNION ALL SELECT 'page before a part is not blank', doc, page, '' FROM prior WHERE contains(text, 'PART I') AND NOT coalesce(blank_before, false)
  UNION ALL SELECT 'drawing on a blank page', doc, page, '' FROM q WHERE blank AND (doc, page) IN (SELECT (doc, page) FROM g)
  UNION ALL SELECT 'blank page before the first chapter', doc, page, '' FROM q WHERE page = 3 AND blank
  UNION ALL SELECT 'not one folio', doc, page, CAST(n AS VARCHAR) FROM f WHERE n <> 1
  UNION ALL SELECT 'folio is not outside', doc, page, '' FROM f WHERE n = 1 AND placed <> 1
  UNION ALL SELECT 'no mirrored rule', doc, page, '' FROM f WHERE (doc, page) NOT IN (SELECT (doc, page) FROM ruled))
SELECT "check", 'FAIL' AS severity, doc || ' p. ' || page AS subject, detail FROM a
UNION ALL SELECT 'only one side of body pages', 'FAIL', doc, '' FROM f GROUP BY doc HAVING count(DISTINCT odd) < 2""",
)
def template_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on ten documents at a time as the pages of a template; places follow from the texts' lengths."""
    n, odd = F.col("n"), F.col("page") % 2 == 1
    mm = lambda k: text.in_points(k)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw")).withColumn("n", F.char_length("raw"))
    said = F.when(n % 6 == 0, " ").when(n % 6 == 1, F.format_string("CHAPTER %d", n)).when(n % 6 == 2, "PART I").otherwise(F.col("raw"))
    pages = docs.select(
        F.concat(F.lit("d"), F.expr("doc_id div 10")).alias("doc"), (F.col("doc_id") % 10 + 1).cast("int").alias("page"), "n",
        (mm(176) + F.when(n % 7 == 0, 0.5).otherwise(0.0)).alias("width"), mm(250).alias("height"), said.alias("text"),
    )
    left = F.when(odd, mm(19)).otherwise(mm(16))
    right = F.col("width") - F.when(odd, mm(16)).otherwise(mm(19))
    off = F.when(n % 4 == 0, 3).otherwise(0)
    folio = F.when(n % 5 == 0, "x").otherwise(F.col("page").cast("string"))
    heads = pages.select("doc", "page", folio.alias("word"), (F.when(odd, right - 10).otherwise(left) + off).alias("x0"), (F.when(odd, right).otherwise(left + 10) + off).alias("x1"), F.lit(40.0).alias("y0"), F.lit(50.0).alias("y1"))
    bodies = pages.select("doc", "page", F.lit("body").alias("word"), F.lit(100.0).alias("x0"), F.when(n % 11 == 0, F.col("width") + 0.2).otherwise(200.0).alias("x1"), F.lit(300.0).alias("y0"), F.lit(310.0).alias("y1"))
    rules = pages.where(n % 8 != 0).select("doc", "page", (left + F.when(n % 3 == 0, 1).otherwise(0)).alias("x0"), right.alias("x1"), F.lit(55.0).alias("y0"), F.lit(56.0).alias("y1"))
    return layout.template_findings(pages.drop("n"), heads.unionByName(bodies), rules)


@_check(
    "q51_mixed_fonts",
    r"""SELECT doc_id AS doc, 1 AS page, font, round_even(length(text) / 7.0::DOUBLE, 3) AS size, length(regexp_replace(text, '[^0-9\p{Latin}]', '', 'g')) AS latin, md5(text) AS digest
FROM (SELECT doc_id, coalesce(text, '') AS text, CASE source WHEN 'src1' THEN 'SourceHanSerif' WHEN 'src2' THEN 'SIMSUN-x' WHEN 'src3' THEN 'NotoCJK' ELSE coalesce(source, 'none') END AS font FROM documents)
WHERE regexp_matches(lower(font), 'cjk|sourcehan|simsun|simhei') AND regexp_matches(text, '[0-9\p{Latin}]')""",
)
def mixed_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with Latin letters or digits that some sources set in a font for another script."""
    font = F.coalesce(F.when(F.col("source") == "src1", "SourceHanSerif").when(F.col("source") == "src2", "SIMSUN-x").when(F.col("source") == "src3", "NotoCJK").otherwise(F.col("source")), F.lit("none"))
    body = F.coalesce("text", F.lit(""))
    spans = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), font.alias("font"), (F.char_length(body) / 7.0).alias("size"), F.array(F.lit(0.0)).alias("bbox"), F.split(body, "").alias("chars"))
    return layout.mixed_fonts(spans).select("doc", "page", "font", "size", "latin", F.md5("text").alias("digest"))


# Posts

_STAMP = "strftime(make_timestamp((1700000000 + doc_id + 8 * 3600) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+08:00'"


@_check(
    "q52_new_posts",
    rf"""SELECT 'a' || doc_id || '.md' AS file, lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS id,
  '---' || chr(10) || 'lang: "zh-CN"' || chr(10) || 'pubDatetime: ' || {_STAMP} || chr(10) || 'timezone: "Asia/Shanghai"' || chr(10) || 'title: "A \"fine\" one ' || doc_id || '"' || chr(10) || 'area: "' || source || '"' || chr(10)
  || 'featured: false' || chr(10) || 'draft: false' || chr(10) || 'tags:' || chr(10) || CASE WHEN lang IS NULL THEN '  - "others"' ELSE '  - "' || lang || '"' || chr(10) || '  - "t' || doc_id % 5 || '"' END || chr(10)
  || 'description: "' || CASE WHEN doc_id % 3 = 0 THEN 'A \"fine\" one ' || doc_id || ' - 笔记' WHEN doc_id % 3 = 1 THEN repeat('long ', 21) || 'lo...' ELSE 'About number ' || doc_id END || '"' || chr(10) || '---' || chr(10)
  || '![x](./p' || doc_id || '.png) and ' || coalesce(text, '') AS content FROM documents WHERE source IS NOT NULL""",
)
def new_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts written from documents: front matter with tags and descriptions of each kind, flat assets."""
    i = F.col("doc_id")
    given = F.when(i % 3 == 0, "short").when(i % 3 == 1, F.repeat(F.lit("long "), 60)).otherwise(F.format_string("About number %d", i))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.format_string("a%d.md", i).alias("file"), F.format_string('A "fine" one %d', i).alias("title"), F.col("source").alias("area"),
        F.when(F.col("lang").isNotNull(), F.array(F.col("lang"), F.format_string("t%d", i % 5))).alias("tags"), given.alias("description"),
        F.concat(F.format_string("\n \n![x](img/deep/p%d.png) and ", i), F.coalesce("text", F.lit(""))).alias("body"),
    )
    return posts.rendered(rows, text.left_padded(i), F.timestamp_seconds(i + 1_700_000_000))


@_check(
    "q53_updated_posts",
    rf"""SELECT doc_id AS post, '---' || chr(10) || 'pubDatetime: then' || chr(10) || 'modDatetime: ' || {_STAMP} || chr(10) || 'title: "' || CASE WHEN doc_id % 4 = 1 THEN 'old' ELSE 'New ' || doc_id END || '"' || chr(10)
  || CASE WHEN source IS NOT NULL THEN 'area: "' || source || '"' || chr(10) WHEN doc_id % 2 = 0 THEN 'area: "a"' || chr(10) ELSE '' END || 'description: "' || CASE WHEN doc_id % 5 = 2 THEN 'x' ELSE 'says \"so\"' END || '"' || chr(10)
  || 'draft: true' || chr(10) || '---' || chr(10) || chr(10) || 'Now: ' || coalesce(text, '') AS content FROM documents""",
)
def updated_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts after an update by documents: title, area and description where the document gives them, one time of change."""
    i = F.col("doc_id")
    raw = F.concat(F.lit("---\npubDatetime: then\n"), F.when(i % 3 == 0, "modDatetime: once\n").otherwise(""), F.lit('title: "old"\n'), F.when(i % 2 == 0, 'area: "a"\n').otherwise(""), F.lit('description: "x"\ndraft: false\n---\n\nold text'))
    pairs = table(spark, sf_dir, "documents").select(
        i.alias("post"), posts.with_draft(raw, True).alias("raw"), F.format_string("New %d", i).alias("title"), (i % 4 != 1).alias("has_title"), F.col("source").alias("area"),
        F.when(i % 5 != 2, 'says "so"').alias("description"), F.concat(F.lit("  \nNow: "), F.coalesce("text", F.lit(""))).alias("body"), "doc_id",
    )
    return posts.updated(pairs, F.timestamp_seconds(i + 1_700_000_000))


@_check("q54_placed_elsewhere", f"SELECT * FROM ({built.MATCH_SQL}) WHERE post IS NOT NULL")
def placed_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that some post of the other site matches, by title or lines."""
    return match.placed_elsewhere(*built.match_sides(spark, sf_dir))


# Records of notes, corrections and editions


@_check(
    "q55_reference_findings",
    """WITH l AS (SELECT o_custkey AS page, o_orderkey // 4 AS id FROM orders), c AS (SELECT c_custkey AS id FROM customer)
SELECT 'no such correction' AS check, 'FAIL' AS severity, CAST(id AS VARCHAR) AS subject, CAST(page AS VARCHAR) AS detail FROM l WHERE id NOT IN (SELECT id FROM c)
UNION ALL SELECT 'correction of no page', 'FAIL', CAST(id AS VARCHAR), '' FROM c WHERE id NOT IN (SELECT id FROM l)
UNION ALL SELECT 'more than one final status', 'FAIL', CAST(page AS VARCHAR), CAST(count(*) AS VARCHAR) FROM l GROUP BY page HAVING count(*) > 1""",
)
def reference_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger of customers' pages, each naming a correction by a quarter of its key; customers as corrections."""
    ledger = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.array(F.expr("o_orderkey div 4")).alias("correction_ids"))
    return notes.reference_findings(ledger, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


_TURNS = "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id, role AS status FROM conversations WHERE length(text) % 5 <> 0"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where(F.char_length("text") % 5 != 0)
    key = F.col("conv_id") * 1000 + F.col("turn")
    return turns.select(key.alias("id"), F.when(F.col("turn") > 0, key - 1).alias("parent_id"), F.col("role").alias("status"))


@_check("q56_orphans", f"WITH r AS ({_TURNS}) SELECT * FROM r WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM r)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose turn before isn't there."""
    return notes.orphans(_turns(spark, sf_dir))


@_check("q57_unresolved_parents", f"WITH r AS ({_TURNS}) SELECT parent_id AS id, count(*) AS open FROM r WHERE parent_id IS NOT NULL AND status IS DISTINCT FROM 'assistant' GROUP BY parent_id")
def unresolved_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with an answer that isn't the assistant's."""
    return notes.unresolved_parents(_turns(spark, sf_dir), "assistant")


@_check("q58_migration_outcomes", "SELECT c_custkey AS id, count(o_orderkey) AS outcomes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <> 1")
def migration_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, as annotations, that don't have exactly one order, as outcome."""
    return notes.outcomes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@_check(
    "q59_editions",
    """SELECT 'asset' AS kind, pos, a.p_brand AS first, b.p_brand AS second FROM (SELECT p_partkey AS pos, p_brand FROM part) a FULL JOIN (SELECT p_partkey // 2 AS pos, p_brand FROM part WHERE p_partkey % 2 = 0) b USING (pos) WHERE a.p_brand IS DISTINCT FROM b.p_brand
UNION ALL SELECT 'title', pos, a.p_type, b.p_type FROM (SELECT p_partkey AS pos, p_type FROM part) a FULL JOIN (SELECT p_partkey - 10 AS pos, p_type FROM part WHERE p_partkey > 9) b USING (pos) WHERE a.p_type IS DISTINCT FROM b.p_type""",
)
def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which two lists of parts differ by brand, as assets of editions, and by type, as titles."""
    part = table(spark, sf_dir, "part")
    at = lambda rows, pos, column, name: rows.select(pos.alias("pos"), F.col(column).alias(name))
    assets = notes.edition_differences(at(part, F.col("p_partkey"), "p_brand", "asset"), at(part.where("p_partkey % 2 = 0"), F.expr("p_partkey div 2"), "p_brand", "asset"))
    titles = notes.title_sequence(at(part, F.col("p_partkey"), "p_type", "title"), at(part.where("p_partkey > 9"), F.col("p_partkey") - 10, "p_type", "title"))
    told = lambda rows, kind, field: rows.select(F.lit(kind).alias("kind"), "pos", F.col(f"first.{field}").alias("first"), F.col(f"second.{field}").alias("second"))
    return told(assets, "asset", "asset").unionByName(told(titles, "title", "title"))


@_check(
    "q60_contents_links",
    """SELECT o_orderkey AS label, CASE WHEN c_custkey IS NULL THEN 'no destination' ELSE 'page differs' END AS problem FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey
WHERE c_custkey IS NULL OR c_nationkey <> o_orderkey % 25""",
)
def contents_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contents links to their customers, whose nations are the pages; customers in debt are no destination."""
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("label"), F.col("o_custkey").alias("target"), (F.col("o_orderkey") % 25).alias("page"))
    return notes.contents_failures(links, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("target"), F.col("c_nationkey").alias("page")))


_WORKS = r"SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS url, 'T' || page_id AS title, CASE WHEN length(html) % 3 > 0 THEN length(html) END AS date, length(url) % 4 AS theme FROM pages"


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.char_length("html")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select(host.alias("url"), F.format_string("T%d", F.col("page_id")).alias("title"), F.when(size % 3 > 0, size).alias("date"), (F.char_length("url") % 4).alias("theme"))


@_check("q61_works", f"SELECT url, title, date, theme FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY date ASC NULLS LAST, title) AS rank FROM ({_WORKS})) WHERE rank = 1")
def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each host's pages the earliest work."""
    return notes.works(_works(spark, sf_dir))


@_check("q62_themes", f"SELECT 'number of themes' AS check, 'FAIL' AS severity, 'themes' AS subject, CAST(count(DISTINCT theme) AS VARCHAR) AS detail FROM ({_WORKS}) HAVING count(DISTINCT theme) NOT BETWEEN 5 AND 8")
def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the works have five to eight themes."""
    return notes.theme_findings(_works(spark, sf_dir), 5, 8)


@_check("q63_mapping_edges", "SELECT l_partkey AS source, l_suppkey AS output, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey")
def mapping_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that line items bring together, and how often."""
    return notes.mapping_edges(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("output")))


@_check(
    "q64_bilingual_pairs",
    """WITH a AS (SELECT o_orderkey AS element, o_custkey AS parent, o_orderkey AS pos FROM orders WHERE o_orderpriority <> '1-URGENT'),
b AS (SELECT o_orderkey AS element, o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS parent, o_totalprice AS pos FROM orders WHERE o_orderpriority <> '2-HIGH'
  UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 77 = 0 AND o_orderpriority <> '2-HIGH'),
x AS (SELECT element, count(*) AS n, min(parent) AS v FROM a GROUP BY element), y AS (SELECT element, count(*) AS n, min(parent) AS v FROM b GROUP BY element),
k AS (SELECT element, CASE WHEN y.n IS NULL THEN 'not emitted' WHEN x.n IS NULL THEN 'not accepted' WHEN x.n > 1 THEN 'accepted more than once' WHEN y.n > 1 THEN 'emitted more than once' WHEN x.v <> y.v THEN 'differs' END AS problem FROM x FULL JOIN y USING (element)),
m AS (SELECT element, parent, row_number() OVER (PARTITION BY parent ORDER BY p, element) AS ra, row_number() OVER (PARTITION BY parent ORDER BY q, element) AS rb
  FROM (SELECT element, parent, min(pos) AS p FROM a GROUP BY ALL) JOIN (SELECT element, parent, min(pos) AS q FROM b GROUP BY ALL) USING (element, parent))
SELECT element, problem FROM k WHERE problem IS NOT NULL UNION ALL SELECT element, 'out of order' FROM m WHERE ra <> rb""",
)
def bilingual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders below their customers in two editions, by key and by price; some are only in one, some twice, some elsewhere."""
    orders = table(spark, sf_dir, "orders")
    element, parent = F.col("o_orderkey").alias("element"), F.col("o_custkey")
    first = orders.where("o_orderpriority <> '1-URGENT'").select(element, parent.alias("parent"), F.col("o_orderkey").alias("pos"))
    other = orders.where("o_orderpriority <> '2-HIGH'")
    moved = other.select(element, (parent + F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)).alias("parent"), F.col("o_totalprice").alias("pos"))
    again = other.where("o_orderkey % 77 = 0").select(element, parent.alias("parent"), F.col("o_totalprice").alias("pos"))
    return notes.pairs(first, moved.unionByName(again))


@_check(
    "q65_moments",
    r"""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS local, strftime(ts, '%Y-%m-%d') AS day, event_type || '/' || 'r' || user_id AS repository,
  [1, CAST(user_id AS INTEGER), CAST(event_id % 9 AS INTEGER)] AS version, (1, user_id, event_id % 9) >= (1, 10, 3) AS new_enough, event_type || ' x' AS spaced, regexp_matches(props, '^[\x20-\x7E]*$') AS plain FROM events""",
)
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local times, days, repositories from addresses, versions and whether they are new enough, one-spaced and plain texts of events."""
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    remote = F.when(event % 2 == 0, F.format_string("git@host.org:%s/r%d.git", kind, user)).otherwise(F.format_string("https://host.org/%s/r%d/", kind, user))
    version = F.format_string("v1.%d.%d", user, event % 9)
    return table(spark, sf_dir, "events").select(
        "event_id", text.zoned_iso(F.col("ts")).alias("local"), text.date_part(F.col("ts").cast("string")).alias("day"), text.owner_and_name(remote).alias("repository"),
        text.version_of(version).alias("version"), text.satisfies(version, F.lit(">=1.10.3")).alias("new_enough"),
        text.one_spaced(F.concat(F.lit("\t "), kind, F.lit(" \n　 x "))).alias("spaced"), text.printable_ascii(F.col("props")).alias("plain"),
    )


# Ledgers, generated texts, logs and reports


@_check(
    "q66_missing_intervals",
    """WITH s AS (SELECT DISTINCT o_custkey // 10 AS g FROM orders), e AS (SELECT g, unnest(range(0, 40)) AS spot FROM s),
m AS (SELECT g, spot FROM e WHERE (g, spot) NOT IN (SELECT (o_custkey // 10, o_orderkey % 40) FROM orders)),
i AS (SELECT g, spot, spot - row_number() OVER (PARTITION BY g ORDER BY spot) AS island FROM m)
SELECT g AS book, min(spot) AS first, max(spot) AS last, max(spot) - min(spot) + 1 AS n FROM i GROUP BY g, island""",
)
def missing_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the numbers 0 to 39 that no order of ten customers has."""
    rows = table(spark, sf_dir, "orders").select(F.expr("o_custkey div 10").alias("book"), (F.col("o_orderkey") % 40).alias("page"))
    return ledger.missing_intervals(rows, rows.select("book", F.lit(0).alias("low"), F.lit(39).alias("high")).distinct(), "book", "page")


@_check(
    "q67_generated_texts",
    r"""WITH f AS (SELECT coalesce(source, 'none') || CASE WHEN doc_id % 10 = 0 THEN '/build/' ELSE '/' END || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.typ' END AS path, text FROM documents)
SELECT 'unresolved mark' AS "check", 'FAIL' AS severity, path AS subject, '' AS detail FROM f WHERE path LIKE '%.typ' AND path NOT LIKE '%/build/%' AND regexp_matches(text, '\bthat\b')""",
)
def generated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which a word remains that stands for what isn't settled; folders of builds are left out."""
    i = F.col("doc_id")
    path = F.concat(F.coalesce("source", F.lit("none")), F.when(i % 10 == 0, "/build/").otherwise("/"), i.cast("string"), F.when(i % 3 == 0, ".md").otherwise(".typ"))
    return manifest.text_findings(table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content")), ".typ", "that")


@_check(
    "q68_compile_logs",
    r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]')) AS line FROM documents WHERE doc_id % 11 <> 0)
SELECT 'compile diagnostics' AS "check", 'FAIL' AS severity, CAST(doc_id AS VARCHAR) AS subject, CAST(count(*) AS VARCHAR) AS detail FROM l WHERE regexp_matches(line, '[^\s\x0B\x{85}\p{Z}]') GROUP BY doc_id
UNION ALL SELECT 'log missing', 'FAIL', CAST(doc_id AS VARCHAR), '' FROM documents WHERE doc_id % 11 = 0 OR text IS NULL""",
)
def compile_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs of compilers: lines that aren't blank, and logs that are missing."""
    return manifest.log_findings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("content")))


@_check(
    "q69_json_lines",
    """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS value FROM customer
UNION ALL SELECT '{' || chr(10) || '  "o_orderkey" : ' || o_orderkey || ',' || chr(10) || '  "status" : ' || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE '"' || o_orderstatus || '"' END || chr(10) || '}' FROM orders""",
)
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON lines, and orders as summaries on several lines with their nulls."""
    lines = report.as_json_lines(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"))
    return lines.unionByName(report.summary_json(table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))))


@_check(
    "q70_readability",
    """SELECT source AS doc, count(*) AS pages, count(*) FILTER (length(text) > 0) AS pages_with_text, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS text_characters, bool_or(length(coalesce(text, '')) > 0) AS searchable FROM documents GROUP BY source""",
)
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sources, as books of their documents' pages, have any text."""
    return layout.readability(table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "text"))


@_check(
    "q71_references",
    r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS ref FROM pages)
SELECT page_id, regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(ref, '/') OR starts_with(ref, '#') AS external, regexp_matches(ref || CASE WHEN page_id % 4 = 0 THEN '.MDX' ELSE '' END, '(?i)\.mdx?$') AS markdown,
  page_id % 2 = 0 AS stamped, CASE WHEN page_id % 3 = 0 THEN ['img/' || page_id || '.png', 'deep/er/' || page_id || '.gif'] ELSE ['img/' || page_id || '.png'] END AS assets, 'Text' || chr(10) AS body FROM p""",
)
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether addresses are external or Markdown files and stamps are complete; local assets of a text, and it without its heading."""
    i = F.col("page_id")
    ref = F.when(i % 3 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    stamp = F.concat(F.date_format(F.timestamp_seconds(i * 1000), "yyyy-MM-dd HH:mm:ss"), F.when(i % 2 == 0, " UTC").otherwise(" CET"))
    image = F.when(i % 3 == 0, F.format_string('<IMG alt="" src="deep/er/%d.gif">', i)).otherwise(F.concat(F.lit('<img src="'), F.col("url"), F.lit('">')))
    body = F.concat(image, F.format_string(" ![a](img/%d.png) ![b](https://a.org/x.png) ![c](/root.png)", i))
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.is_external(ref).alias("external"), urls.is_markdown(F.concat(ref, F.when(i % 4 == 0, ".MDX").otherwise(""))).alias("markdown"), text.is_utc_stamp(stamp).alias("stamped"),
        urls.local_assets(body).alias("assets"), text.without_first_heading(F.concat(F.lit("\n# "), F.col("url"), F.lit("\nText\n"))).alias("body"),
    )


@_check(
    "q72_changed_fields",
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS b FROM orders), x AS (SELECT * FROM o WHERE a = 1), y AS (SELECT * FROM o WHERE b = 1)
SELECT unnest(list_filter([CASE WHEN x.o_custkey IS DISTINCT FROM y.o_custkey THEN 'o_custkey' END, CASE WHEN x.o_orderstatus IS DISTINCT FROM y.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN x.o_orderpriority IS DISTINCT FROM y.o_orderpriority THEN 'o_orderpriority' END,
  CASE WHEN x.o_orderdate IS DISTINCT FROM y.o_orderdate THEN 'o_orderdate' END], lambda f: f IS NOT NULL)) AS field FROM x, y""",
)
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which the last order differs from the first, as a binding that is checked again."""
    fields = ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
    orders = table(spark, sf_dir, "orders")
    end = lambda pick: orders.agg(pick(F.struct(*fields), "o_orderkey").alias("x")).select("x.*")
    return reconcile.changed_fields(end(F.min_by), end(F.max_by), fields)


@_check("q73_sorted_distinct", "SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def sorted_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts of all pages, once each."""
    return reconcile.sorted_distinct(table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host")), "host")


@_check("q74_after", "SELECT event_id AS seq, event_type AS event, user_id AS actor FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the events, from a position on."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("user_id").alias("actor"))
    last = events.agg(F.max("seq")).first()[0]
    return queue.after(events, -1 if last is None else last // 2)


@_check("q75_required_fields", "SELECT doc_id, field FROM (SELECT doc_id, 'text' AS field, text AS v FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents UNION ALL SELECT doc_id, 'source', nullif(source, 'src1') FROM documents) WHERE v IS NULL OR v = ''")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that documents lack; one source counts as none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.when(F.col("source") != "src1", F.col("source")).alias("source"))
    return reconcile.required(docs, "doc_id", ["text", "lang", "source"])


# Polled jobs, event lines, versions and addresses of repositories


@_check(
    "q76_job_results",
    """WITH b AS (SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN '{"data": [' || j || ']}' WHEN 1 THEN '{"data": ' || j || '}' ELSE j END AS body FROM (SELECT o_orderkey, CASE o_orderstatus
  WHEN 'F' THEN '{"task_id": "t' || o_custkey || '", "status": "completed", "result": {"images": [{"url": ["http://i/' || o_orderkey || '"]}, {"url": "http://j/' || o_orderkey || '"}, {}]}}'
  WHEN 'P' THEN '{"id": "t' || o_custkey || '", "status": "failed", "error": {"message": "' || o_orderpriority || '"}}'
  ELSE '{"task_id": "t' || o_custkey || '", "status": "running"}' END AS j FROM orders)),
d AS (SELECT seq, CASE WHEN json_type(body, '$.data') = 'ARRAY' THEN json_extract(body, '$.data[0]') WHEN json_type(body, '$.data') = 'OBJECT' THEN json_extract(body, '$.data') ELSE CAST(body AS JSON) END AS one FROM b),
s AS (SELECT coalesce(one->>'$.task_id', one->>'$.id') AS task_id, seq, one->>'$.status' AS state, one->>'$.error.message' AS error,
  CASE WHEN json_exists(one, '$.result.images') THEN list_filter([coalesce(one->>'$.result.images[0].url[0]', one->>'$.result.images[0].url'), one->>'$.result.images[1].url'], lambda u: u IS NOT NULL) END AS images FROM d)
SELECT task_id, seq, state, images, error FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY state IN ('completed', 'failed') DESC, CASE WHEN state IN ('completed', 'failed') THEN seq ELSE -seq END) AS r FROM s) WHERE r = 1""",
)
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of each customer's job; its orders are the answers polled, in the three forms that answers have."""
    key = F.col("o_orderkey").cast("string")
    task = F.concat(F.lit('"t'), F.col("o_custkey").cast("string"), F.lit('", '))
    done = F.concat(F.lit('{"task_id": '), task, F.lit('"status": "completed", "result": {"images": [{"url": ["http://i/'), key, F.lit('"]}, {"url": "http://j/'), key, F.lit('"}, {}]}}'))
    failed = F.concat(F.lit('{"id": '), task, F.lit('"status": "failed", "error": {"message": "'), F.col("o_orderpriority"), F.lit('"}}'))
    job = F.when(F.col("o_orderstatus") == "F", done).when(F.col("o_orderstatus") == "P", failed).otherwise(F.concat(F.lit('{"task_id": '), task, F.lit('"status": "running"}')))
    form = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"data": ['), job, F.lit("]}"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"data": '), job, F.lit("}"))).otherwise(job)
    return stream.job_results(stream.job_states(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), form.alias("body"))))


@_check(
    "q77_cli_events",
    """WITH l AS (SELECT event_id AS seq, CASE WHEN event_id % 13 = 0 THEN '  ' WHEN event_id % 11 = 0 THEN '["' || event_type || '"]' ELSE left('{"type": "' || event_type || '", "user": ' || user_id || '}', 34 + CAST(event_id % 7 AS INTEGER)) END AS value FROM events)
SELECT seq, CASE WHEN json_valid(value) AND json_type(value) = 'OBJECT' THEN value->>'$.type' END AS type,
  CASE WHEN NOT json_valid(value) THEN 'no JSON, perhaps cut off' WHEN json_type(value) <> 'OBJECT' THEN 'not an object' END AS problem FROM l WHERE trim(value) <> ''""",
)
def cli_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines, some of them cut off, blank or no objects."""
    i = F.col("event_id")
    line = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "user": '), F.col("user_id").cast("string"), F.lit("}"))
    value = F.when(i % 13 == 0, "  ").when(i % 11 == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('"]'))).otherwise(F.substring(line, F.lit(1), (34 + i % 7).cast("int")))
    return stream.cli_events(table(spark, sf_dir, "events").select(i.alias("seq"), value.alias("value"))).select("seq", "type", "problem")


@_check(
    "q78_versions",
    r"""WITH p AS (SELECT p_partkey AS k, 'v' || p_size || '.' || p_partkey % 12 || '.' || p_partkey % 5 || CASE WHEN p_partkey % 9 = 0 THEN '-rc1' ELSE '' END AS given, '>=25.' || p_partkey % 7 || '.2' AS least,
  CASE p_partkey % 4 WHEN 0 THEN 'git@h.org:' || p_brand || '/p' || p_partkey || '.git' WHEN 1 THEN 'https://h.org/' || p_brand || '/p' || p_partkey || '/' WHEN 2 THEN 'https://h.org/' || p_brand || '/p' || p_partkey || '.git' ELSE p_brand END AS remote FROM part),
v AS (SELECT k, remote, list_transform(regexp_extract_all(given, '\d+')[:3], lambda x: CAST(x AS INTEGER)) AS has, list_transform(regexp_extract_all(least, '\d+'), lambda x: CAST(x AS INTEGER)) AS wants FROM p)
SELECT k, has, has >= wants AS fits, nullif(regexp_extract(regexp_replace(remote, '/$', ''), '[:/]([^:/]+/[^/]+?)(\.git)?$', 1), '') AS repository FROM v""",
)
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that parts have, whether they are new enough, and owner and name of their repositories."""
    k = F.col("p_partkey")
    own = lambda x: F.concat(F.col("p_brand"), F.lit("/p"), k.cast("string"), F.lit(x))
    given = F.concat(F.format_string("v%d.%d.%d", F.col("p_size"), k % 12, k % 5), F.when(k % 9 == 0, "-rc1").otherwise(""))
    remote = F.when(k % 4 == 0, F.concat(F.lit("git@h.org:"), own(".git"))).when(k % 4 == 1, F.concat(F.lit("https://h.org/"), own("/"))).when(k % 4 == 2, F.concat(F.lit("https://h.org/"), own(".git"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(k.alias("k"), text.version_of(given).alias("has"), text.satisfies(given, F.format_string(">=25.%d.2", k % 7)).alias("fits"), text.owner_and_name(remote).alias("repository"))
