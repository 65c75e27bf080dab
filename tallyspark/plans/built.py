"""Queries whose inputs (files, manifests, trees, commands) are built from the driver tables by expressions.

Damage is dealt by key, so that every finding has rows; the SQL says what must be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import hashing, text, variant
from tallyspark.operators import discover, layout, ledger, manifest as books, match, notes, posts, queue, reconcile, release as releases, report, workspace as spaces
from tallyspark.plans.session import materialize, workspace as shared
from tallyspark.plans.tables import table
from tallyspark.sources import filetree, xmlfeeds
from tallyspark.streaming import queue as stream

def _id() -> Column:
    return F.col("doc_id")


def _say(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def _pick(number: Column, cases: dict[int, Column], other: Column | None = None) -> Column:
    out = other if other is not None else F.lit(None)
    for k, value in cases.items():
        out = F.when(number == k, value).otherwise(out)
    return out


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("xx")).alias("lang"))


def _packed(rows: DataFrame, by: Column, item: Column, order: str = "doc_id", sep: str = ", ") -> DataFrame:
    """g, body: the items of each bounded group in order, as one text."""
    packed = rows.groupBy(by.alias("g")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))).alias("all"))
    return packed.select("g", F.array_join(F.transform("all", lambda r: r.x), sep).alias("body"))


# Posts and feeds

_TRIM = r"^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$"
FRONT_MATTER_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'xx') AS lang, doc_id % 5 AS k FROM documents),
l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_replace(x, '{_TRIM}', '', 'g')),
  lambda x: x <> '' AND NOT regexp_matches(x, '^(#{{1,6}}\s|!?\[|[>|`-])') AND NOT regexp_matches(x, '^<[^>]+>$')) AS prose FROM d)
SELECT printf('%04d', doc_id) AS id, printf('%04d', doc_id) || CASE WHEN k = 3 THEN '/index.mdx' ELSE '/index.md' END AS file,
  CASE WHEN k IN (0, 1, 4) THEN 'Doc ' || doc_id ELSE '(no title)' END AS title, CASE WHEN k = 0 THEN '2024-01-02' ELSE '' END AS pub_datetime,
  CASE WHEN k = 0 THEN lang || ',b' END AS tags, coalesce(prose[1], '') AS first FROM l
"""


def _post_files(docs: DataFrame) -> DataFrame:
    """Documents as files of posts: quoted titles, carriage returns, no front matter, no title, and two files under one id."""
    body = F.col("text")
    number = _say("%04d", _id())
    head = _pick(
        _id() % 5,
        {
            0: _say('---\ntitle: "Doc %d"\npubDatetime: 2024-01-02\ntags:\n  - "%s"\n  - b\n---\n\n', _id(), F.col("lang")),
            1: _say("---\r\ntitle: 'Doc %d'\r\n---\r\n", _id()),
            3: F.lit("---\narea: x\n---\n"),
            4: _say("---\ntitle: Doc %d\n---\n", _id()),
        },
        F.lit(""),
    )
    first = F.struct(F.concat(number, F.when(_id() % 5 == 3, "/index.mdx").otherwise("/index.md")).alias("path"), F.concat(head, body).alias("content"))
    second = F.struct(F.when(_id() % 5 == 4, F.concat(number, F.lit("/index.mdx"))).otherwise(F.concat(F.lit("about-"), number, F.lit("/index.md"))).alias("path"), F.lit("---\ntitle: Other\n---\n").alias("content"))
    return docs.select(F.inline(F.array(first, second)))


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, titles, dates, tags and first lines of posts, one for each id."""
    own = posts.posts(_post_files(_docs(spark, sf_dir)))
    tags = F.array_join(text.tag_list(text.front_matter(F.col("raw"))), ",")
    return own.select("id", "file", "title", "pub_datetime", tags.alias("tags"), text.first_prose_line(F.col("body")).alias("first"))


XML_SQL = """
WITH p AS (SELECT page_id, url, page_id // 10 AS g, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS pos FROM pages)
SELECT 'f' || g AS name, CAST(pos AS INTEGER) AS pos, url AS link, CASE WHEN g % 4 = 0 THEN '' ELSE 'T ' || page_id END AS title FROM p WHERE g % 4 < 3
"""


def xml_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of sitemaps, RSS and Atom feeds of ten pages each; every fourth file is cut off and has none."""
    own = table(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u"), F.expr("page_id div 10").alias("f"))
    kind = F.col("f") % 4
    item = _pick(
        kind,
        {
            0: _say("<url><loc> %s </loc></url>", F.col("u")),
            2: _say('<entry><link rel="self" href="x"/><link href="%s"/><title>T %d</title></entry>', F.col("u"), F.col("page_id")),
        },
        _say("<item><link>%s</link><title> T %d </title></item>", F.col("u"), F.col("page_id")),
    )
    files = _packed(own, F.col("f"), item, "page_id", "")
    k = F.col("g") % 4
    around = [{0: '<s:urlset xmlns:s="http://x/">', 1: "<rss><channel>", 2: '<feed xmlns="http://www.w3.org/2005/Atom">', 3: "<rss>"}, {0: "</s:urlset>", 1: "</channel></rss>", 2: "</feed>", 3: "<cut"}]
    inner = F.when(k == 0, F.regexp_replace("body", "<(/?)(url|loc)>", "<$1s:$2>")).otherwise(F.col("body"))
    ends = [_pick(k, {n: F.lit(x) for n, x in part.items()}) for part in around]
    rows = files.select(F.concat(F.lit("f"), F.col("g")).alias("name"), k.alias("k"), F.concat(ends[0], inner, ends[1]).alias("body"))
    maps = xmlfeeds.sitemap_entries(rows.where("k IN (0, 3)"), ["name"]).select("name", "pos", F.col("loc").alias("link"), F.lit("").alias("title"))
    return maps.unionByName(xmlfeeds.feed_entries(rows.where("k > 0"), ["name"]))


# File trees

_TREE_SQL = """
n AS (SELECT r_name AS root, n_name AS folder, s_name || '.md' AS file, s_name || chr(10) || s_suppkey || chr(10) AS content
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (
  SELECT DISTINCT root, folder AS path, 1 AS depth, 'dir' AS kind, NULL AS sha256, NULL AS target FROM n
  UNION ALL SELECT root, folder || '/' || file, 2, 'file', sha256(content), NULL FROM n
  UNION ALL SELECT root, folder || '/latest', 2, 'symlink', NULL, max(file) FROM n GROUP BY root, folder
  UNION ALL SELECT DISTINCT root, '.hidden', 1, 'file', sha256(root), NULL FROM n)
"""
TREE_SQL = f"WITH {_TREE_SQL} SELECT root, path, depth, kind, sha256, target FROM t"
TREE_HASH_SQL = f"""WITH {_TREE_SQL},
j AS (SELECT root, path, CASE kind WHEN 'file' THEN '{{"kind":"file","mode":"0o644","path":"' || path || '","sha256":"' || sha256 || '"}}'
  ELSE '{{"kind":"symlink","mode":"0o777","path":"' || path || '","target":"' || target || '"}}' END || chr(10) AS line FROM t WHERE kind <> 'dir')
SELECT root, sha256(string_agg(line, '' ORDER BY path)) AS fingerprint FROM j GROUP BY root"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each region, a folder for each nation in it, a file for each supplier and a link to the last; executors write them."""
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("s_nationkey = n_nationkey"))  # 25 nations
    own = suppliers.join(F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
    folder = F.concat_ws("/", "r_name", "n_name")
    files = own.select(F.concat(folder, F.lit("/"), "s_name", F.lit(".md")).alias("path"), F.concat_ws("\n", "s_name", "s_suppkey", F.lit("")).alias("content"), F.lit(None).cast("string").alias("target"))
    links = own.groupBy(F.concat(folder, F.lit("/latest")).alias("path")).agg(F.max("s_name").alias("last"))
    hidden = own.select("r_name").distinct().select(F.concat("r_name", F.lit("/.hidden")), "r_name", F.lit(None).cast("string"))
    entries = files.union(hidden).union(links.select("path", F.lit(None).cast("string"), F.concat("last", F.lit(".md"))))
    base = filetree.write(entries, shared(spark, "tree"))
    roots = [r.r_name for r in own.select("r_name").distinct().collect()]  # five regions at any scale
    return filetree.read(spark, *[f"{base}/{name}" for name in roots]).withColumn("root", F.regexp_extract("root", "[^/]+$", 0))


def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of trees: hidden and linked ones too."""
    return _tree(spark, sf_dir).select("root", "path", "depth", "kind", "sha256", "target")


def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of each tree."""
    return filetree.fingerprints(_tree(spark, sf_dir)).select("root", "fingerprint")


# Ledgers

LEDGER_SQL = """
WITH d AS (SELECT doc_id AS d, doc_id // 40 AS f, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY doc_id // 40) AS n FROM documents),
r AS (
  SELECT 'f' || f AS path, CASE WHEN f % 5 = 2 AND i > 1 THEN i + 1 ELSE i END AS record_no, CASE WHEN d % 16 = 15 THEN 99 ELSE d % 8 END AS k, d FROM d WHERE f % 5 < 3),
v AS (
  SELECT path, record_no, CASE WHEN k IN (0, 1, 2, 4) THEN d WHEN k = 3 THEN 1 END AS page, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN ' Needs-Review ' END AS status,
    CASE WHEN k IN (5, 6) THEN 'page is no integer' WHEN k = 7 THEN 'no page key' WHEN k = 99 THEN 'not an object' END AS error FROM r
  UNION ALL SELECT 'f' || f, max(n) + 2, NULL, NULL, 'invalid JSON' FROM d WHERE f % 5 = 2 GROUP BY f
  UNION ALL SELECT DISTINCT 'f' || f, NULL, NULL, NULL, CASE f % 5 WHEN 3 THEN 'no list of records' ELSE 'empty' END FROM d WHERE f % 5 > 2)
SELECT path, CAST(record_no AS INTEGER) AS record_no, CAST(page AS BIGINT) AS page, status, error FROM v
"""


def page_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ledgers in all their forms, right and wrong ones."""
    d = F.col("doc_id")
    record = _pick(
        d % 8,
        {
            0: _say('{"page": %d, "status": "ok"}', d), 1: _say('{"page": "%d", "status": " Needs-Review "}', d), 2: _say('{"page": %d.9}', d),
            3: F.lit('{"source_page": true, "status": null}'), 4: _say('{"page_number": " %d "}', d), 5: F.lit('{"page": null, "source_page": 3}'),
            6: F.lit('{"page": "3.7"}'), 7: F.lit('{"other": 1}'),
        },
    )
    own = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 16 == 15, "7").otherwise(record).alias("r"), F.expr("doc_id div 40").alias("f"))
    packed = own.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("doc_id", "r"))).alias("all")).select("f", F.transform("all", lambda x: x.r).alias("all"))
    listed = F.array_join("all", ", ")
    by_line = F.concat(F.element_at("all", 1), F.lit("\n\n"), F.array_join(F.slice("all", 2, F.size("all")), "\n"), F.when(F.size("all") > 1, "\n").otherwise(""), F.lit("not json"))
    body = _pick(F.col("f") % 5, {0: _say("[%s]", listed), 1: _say('{"records": [%s]}', listed), 2: by_line, 3: F.lit('{"page": 1}'), 4: F.lit(" \n")})
    files = packed.select(F.concat(F.lit("f"), "f").alias("path"), body.alias("content"))
    return ledger.pages(ledger.records(files))


LEDGER_FINDINGS_SQL = """
WITH n AS (SELECT count(*) AS n FROM documents),
o AS (
  SELECT unnest(CASE WHEN doc_id % 13 = 5 THEN [1, 2] ELSE [1] END) AS copy, doc_id + 1 + CASE WHEN doc_id % 17 = 2 THEN 1000000000 ELSE 0 END AS page,
    CASE doc_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN ' OPEN ' WHEN 2 THEN 'needs_review' END AS status FROM documents WHERE doc_id % 11 <> 3)
SELECT 'missing page' AS "check", 'FAIL' AS severity, CAST(i AS VARCHAR) AS subject, '' AS detail FROM (SELECT unnest(range(1, n + 1)) AS i FROM n) WHERE i NOT IN (SELECT page FROM o)
UNION ALL SELECT DISTINCT 'page out of range', 'FAIL', CAST(page AS VARCHAR), '' FROM o, n WHERE page > n
UNION ALL SELECT 'repeated page', 'FAIL', CAST(page AS VARCHAR), CAST(count(*) AS VARCHAR) FROM o GROUP BY page HAVING count(*) > 1
UNION ALL SELECT 'open page', 'WARN', CAST(page AS VARCHAR), status FROM o WHERE status IN (' OPEN ', 'needs_review')
"""


def ledger_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on a ledger of as many pages as there are documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    page = _id() + 1 + F.when(_id() % 17 == 2, F.lit(10**9)).otherwise(0)
    status = _pick(_id() % 5, {0: F.lit("done"), 1: F.lit(" OPEN "), 2: F.lit("needs_review")})
    copies = F.explode(F.when(_id() % 13 == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    own = docs.where("doc_id % 11 <> 3").select(page.alias("page"), status.alias("status"), copies.alias("copy")).drop("copy")
    return ledger.findings(spark, own, docs.count(), allow_open=True)


# Manifests

_CHAPTERS = """
d AS (SELECT doc_id AS d, sha256(coalesce(text, '')) AS h, doc_id % 10 AS k, doc_id % 6 AS m, (doc_id // 40) % 7 = 6 AS bare,
  CAST(row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) AS VARCHAR) AS pos FROM documents),
c AS (SELECT *, CASE WHEN k = 9 THEN 'gone' || d || '.md' WHEN k NOT IN (6, 8) THEN 's' || d || '.md' END AS source FROM d WHERE NOT bare)
"""
MANIFEST_SQL = f"""
WITH {_CHAPTERS},
f AS (
  SELECT 'no chapters' AS "check", 'manifest' AS subject, '' AS detail FROM (SELECT DISTINCT doc_id // 40 AS g FROM documents) WHERE g % 7 = 6
  UNION ALL SELECT 'chapter is no object', pos, '' FROM c WHERE k = 8
  UNION ALL SELECT 'chapter without source', pos, '' FROM c WHERE k = 6
  UNION ALL SELECT 'source file missing', source, '' FROM c WHERE k = 9
  UNION ALL SELECT 'source hash missing or malformed', source, '' FROM c WHERE k = 5
  UNION ALL SELECT 'source hash differs', source, h FROM c WHERE k = 4
  UNION ALL SELECT 'chapter without output', pos, '' FROM c WHERE k = 7
  UNION ALL SELECT 'output file missing', 'none' || d || '.typ', '' FROM c WHERE k = 9
  UNION ALL SELECT 'source not in manifest', 's' || d || '.md', '' FROM d WHERE (bare OR k IN (6, 8, 9)) AND d % 20 <> 6
  UNION ALL SELECT 'manifest names a file that is no source', source, '' FROM c WHERE k = 9
  UNION ALL SELECT 'image is no object', pos, '' FROM d WHERE m = 4
  UNION ALL SELECT 'image without asset', pos, '' FROM d WHERE m = 3
  UNION ALL SELECT 'image file missing', 'assets/figures/no' || d || '.png', '' FROM d WHERE m = 5
  UNION ALL SELECT 'image without integer size', 'assets/figures/i' || d || '.png', '' FROM d WHERE m = 2
  UNION ALL SELECT 'image of no size', 'assets/figures/i' || d || '.png', '3x0' FROM d WHERE m = 1
  UNION ALL SELECT 'excluded asset is no figure', 'other/x' || d || '.png', '' FROM d WHERE d % 60 = 4
  UNION ALL SELECT 'figure not in manifest', 'assets/figures/i' || d || '.png', '' FROM d WHERE m IN (3, 4, 5) AND d % 12 <> 3)
SELECT "check", 'FAIL' AS severity, subject, detail FROM f
"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on manifests of forty documents each, with chapters and images of every kind of fault."""
    docs = _docs(spark, sf_dir).select("doc_id", hashing.sha256(F.col("text")).alias("h"), F.expr("doc_id div 40").alias("f"))
    d, h = _id(), F.col("h")
    chapter = _pick(
        d % 10,
        {
            4: _say('{"source": "s%d.md", "output": "o%d.typ", "source_sha256": "' + "b" * 64 + '"}', d, d),
            5: _say('{"source": "s%d.md", "output": "o%d.typ", "source_sha256": "bad"}', d, d),
            6: _say('{"output": "o%d.typ"}', d),
            7: _say('{"source": "s%d.md", "output": "", "source_sha256": "%s"}', d, h),
            8: F.lit("7"),
            9: _say('{"source": "gone%d.md", "output": "none%d.typ", "source_sha256": "%s"}', d, d, h),
        },
        _say('{"source": "s%d.md", "output": "o%d.typ", "source_sha256": "%s"}', d, d, h),
    )
    image = _pick(
        d % 6,
        {
            0: _say('{"asset": "assets/figures/i%d.png", "width": 3, "height": 2}', d), 1: _say('{"asset": "assets/figures/i%d.png", "width": 3, "height": 0}', d),
            2: _say('{"asset": "assets/figures/i%d.png", "width": "3", "height": 2}', d), 3: F.lit('{"width": 1}'), 4: F.lit("5"),
            5: _say('{"asset": "assets/figures/no%d.png", "width": 1, "height": 1}', d),
        },
    )
    sorted_ = lambda x: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("doc_id", x.alias("x")))), lambda r: r.x.isNotNull()), lambda r: r.x), ", ")
    packed = docs.groupBy("f").agg(
        sorted_(F.when(F.col("f") % 7 != 6, chapter)).alias("chapters"),
        sorted_(image).alias("images"),
        sorted_(F.when(d % 20 == 6, _say('"s%d.md"', d))).alias("skipped"),
        sorted_(F.when(d % 12 == 3, _say('"assets/figures/i%d.png"', d)).when(d % 60 == 4, _say('"other/x%d.png"', d))).alias("unused"),
    )
    body = _say('{"chapters": [%s], "images": [%s], "excluded_sources": [%s], "excluded_assets": [%s]}', *map(F.col, ("chapters", "images", "skipped", "unused")))
    v = books.objects(packed.select(F.concat(F.lit("m"), "f").alias("path"), body.alias("content")))
    file = lambda path, sha=h: F.struct(path.alias("path"), F.lit("file").alias("kind"), sha.alias("sha256"))
    sources = docs.select(F.inline(F.array(file(_say("s%d.md", d)), file(_say("p%d.png", d)))))
    book = docs.select(F.inline(F.array(file(_say("o%d.typ", d)), file(_say("assets/figures/i%d.png", d)))))
    return books.chapter_findings(v, sources, book).unionByName(books.image_findings(v, book))


# Releases

RELEASE_SQL = """
WITH d AS (SELECT doc_id AS d, sha256(coalesce(text, '')) AS h, doc_id % 9 AS k, doc_id % 8 AS s, CASE WHEN doc_id % 9 = 4 THEN 0 ELSE doc_id % 7 + 1 END AS n FROM documents),
w AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos FROM d WHERE s <> 5),
f AS (
  SELECT 'field missing' AS "check", 'r' || d AS subject, 'build_command' AS detail FROM d WHERE k = 1
  UNION ALL SELECT 'field missing', 'r' || d, unnest(['typst_version', 'timestamp']) FROM d WHERE k = 6
  UNION ALL SELECT 'hash differs', 'r' || d, h FROM d WHERE k = 2
  UNION ALL SELECT 'page count differs', 'r' || d, CAST(n AS VARCHAR) FROM d WHERE k = 3
  UNION ALL SELECT 'no pages', 'r' || d, '' FROM d WHERE k = 4
  UNION ALL SELECT 'record missing', 'r' || d, '' FROM d WHERE k = 5
  UNION ALL SELECT 'code sample without treatment', d || '.png', '' FROM d WHERE s = 1
  UNION ALL SELECT 'page below 1', d || '.png', '' FROM d WHERE s = 2
  UNION ALL SELECT 'page beyond the end', d || '.png', '' FROM d WHERE s = 3
  UNION ALL SELECT 'sample file missing', 'no' || d || '.png', '' FROM d WHERE s = 4
  UNION ALL SELECT 'sample field missing', CAST(d AS VARCHAR), 'output_page, semantic_class' FROM d WHERE s = 5
  UNION ALL SELECT 'repeated sample', 'rep.png', CAST(count(*) AS VARCHAR) FROM d WHERE s = 6 HAVING count(*) > 1
  UNION ALL SELECT 'report differs from manifest', CAST(pos AS VARCHAR), '' FROM w WHERE d % 100 = 3
  UNION ALL SELECT unnest(['no samples', 'no cover or title sample', 'no code or dense sample']), 'manifest', '')
SELECT "check", 'FAIL' AS severity, subject, detail FROM f
"""


def release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on release records of all documents, on a list of their samples, and on an empty list."""
    d, h, n = _id(), F.col("h"), F.col("n")
    pages = F.when(d % 9 == 4, 0).otherwise(d % 7 + 1)
    docs = _docs(spark, sf_dir).select("doc_id", hashing.sha256(F.col("text")).alias("h"), pages.cast("long").alias("n"), F.expr("doc_id div 40").alias("f"))
    rest = '"typst_version": "0.1", "build_command": "make", "time_strategy": {"value": 0}'
    record = _pick(
        d % 9,
        {
            1: _say('{"pdf": {"sha256": "%s"}, "pages": "%d", "typst_version": "0.1", "build_command": "", "time_strategy": 1}', h, n),
            2: _say('{"pdf": {"sha256": "' + "a" * 64 + '"}, "pages": %d, ' + rest + "}", n),
            3: _say('{"pdf": {"sha256": "%s"}, "pages": " %d ", ' + rest + "}", h, n + 1),
            6: _say('{"sha256": "%s", "pages": %d, "build_command": "make", "creation_timestamp": null}', h, n),
            7: _say('{"pdf_sha256": "%s", "pdf_pages": %d, ' + rest + "}", h, n),
            8: _say('{"pdf": {"sha256": "%s", "page_count": %d}, ' + rest + "}", h, n),
        },
        _say('{"pdf": {"sha256": "%s"}, "pages": "%d", ' + rest + "}", h, n),
    )
    path = _say("r%d", d).alias("path")
    records = books.objects(docs.where("doc_id % 9 <> 5").select(path, record.alias("content")))
    actual = docs.select(path, h.alias("sha256"), n.alias("page_count"))
    page = d % 50 + 1
    sample = _pick(
        d % 8,
        {
            0: _say('{"filename": "%d.png", "output_page": %d, "semantic_class": "cover"}', d, page),
            1: _say('{"filename": "%d.png", "output_page": %d, "semantic_class": "Code-dense"}', d, page),
            2: _say('{"filename": "%d.png", "output_page": "x", "semantic_class": "plain"}', d),
            3: _say('{"filename": "%d.png", "output_page": 9999, "page": 1, "semantic_class": "plain"}', d),
            4: _say('{"filename": "no%d.png", "output_page": %d, "semantic_class": "plain"}', d, page),
            5: _say('{"filename": "%d.png"}', d),
            6: F.lit('{"filename": "rep.png", "output_page": 1, "semantic_class": "plain"}'),
        },
        _say('{"filename": "%d.png", "output_page": %d, "semantic_class": "code", "code_treatment": "confirmed-raw"}', d, page),
    )
    lists = _packed(docs, F.col("f"), sample).select("g", F.try_parse_json(_say("[%s]", F.col("body"))).alias("v"))
    own = releases.samples(lists, keep=("g",)).withColumn("pos", F.col("g") * 40 + F.col("pos")).drop("g")
    files = docs.select(_say("%d.png", d).alias("path")).union(spark.range(1).select(F.lit("rep.png")))
    told = own.withColumn("semantic_class", F.when(F.col("pos") % 100 == 3, "other").otherwise(F.col("semantic_class"))).where(F.size("missing") == 0)
    return report.all_of([releases.record_findings(records, actual), releases.sample_findings(own, files, 60, told), releases.sample_findings(own.where("pos < 0"), files, 60)])


# Workspaces

_TYPST = [(f"-typst-zh/{x}", True) for x in sorted({"/".join(p.split("/")[:k]) for p in (*spaces.EDITION_FOLDERS, "assets/covers/own", "assets/covers/source") for k in range(1, len(p.split("/")) + 1)})]
_TYPST += [("-typst-zh", True), *[(f"-typst-zh/{x}", False) for x in spaces.EDITION_FILES]]
_NAMED = [("-raw", True), ("-raw/Scan.pdf", False), ("-markdown", True), ("-markdown/chapters", True), ("-markdown/chapters/one.md", False), ("-markdown/images", True), *_TYPST]
_COMMON = [(".agents", True), (".agents/skills", True)]
WORKSPACE_SQL = f"""
WITH w AS (SELECT s_suppkey % 14 AS k, CASE WHEN s_suppkey % 14 = 13 THEN 'W' ELSE 'w' END || s_suppkey AS w FROM supplier),
t(suffix) AS (VALUES {", ".join(f"('{p}')" for p, _ in _NAMED if not p.startswith("-raw"))}),
f AS (
  SELECT 'file missing' AS "check", w || ': ' || w || '-typst-zh/source-map.json' AS subject, '' AS detail FROM w WHERE k = 1
  UNION ALL SELECT unnest(['unexpected entry in edition', 'forbidden entry in edition']), w || ': ' || w || '-typst-zh/raw', '' FROM w WHERE k = 2
  UNION ALL SELECT unnest(['unexpected entry in workspace', 'upper case in path']), w || ': Notes', '' FROM w WHERE k = 3
  UNION ALL SELECT 'typeset file in raw folder', w || ': ' || w || '-raw/x.TYP', '' FROM w WHERE k = 4
  UNION ALL SELECT 'nested repository', w || ': ' || w || '-typst-zh/book/.git', '' FROM w WHERE k = 5
  UNION ALL SELECT unnest(['nested repository', 'unexpected entry in workspace']), w || ': .gitmodules', '' FROM w WHERE k = 5
  UNION ALL SELECT 'raw folder empty', w || ': ' || w || '-raw', '' FROM w WHERE k = 6
  UNION ALL SELECT 'chapter of another type', w || ': ' || w || '-markdown/chapters/one.txt', '' FROM w WHERE k = 7
  UNION ALL SELECT 'not one local skill', w, '0' FROM w WHERE k = 8
  UNION ALL SELECT 'skill without a name', w || ': .agents/skills/edit/SKILL.md', '' FROM w WHERE k = 9
  UNION ALL SELECT 'skill named otherwise', w || ': .agents/skills/edit/SKILL.md', 'other' FROM w WHERE k = 10
  UNION ALL SELECT 'folder missing', w || ': ' || w || '-typst-zh', '' FROM w WHERE k = 11
  UNION ALL SELECT unnest(['unexpected edition', 'unexpected entry in workspace']), w || ': ' || w || '-typst-en', '' FROM w WHERE k = 11
  UNION ALL SELECT 'skill name is no slug', w || ': .agents/skills/edit_x/SKILL.md', '' FROM w WHERE k = 12
  UNION ALL SELECT 'no chapters', w || ': ' || w || '-markdown/chapters', '' FROM w WHERE k = 12
  UNION ALL SELECT 'workspace name', w, '' FROM w WHERE k = 13
  UNION ALL SELECT 'upper case in path', w || ': ' || w || suffix, '' FROM w, t WHERE k = 13
  UNION ALL SELECT 'unexpected entry in text folder', w || ': ' || w || '-markdown/other', '' FROM w WHERE k = 0
  UNION ALL SELECT 'not one local skill', w, '2' FROM w WHERE k = 0)
SELECT "check", 'FAIL' AS severity, subject, detail FROM f
"""


def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on a workspace for each supplier, thirteen of fourteen with a fault."""
    key = F.col("s_suppkey")
    w, k = F.concat(F.when(key % 14 == 13, "W").otherwise("w"), key), key % 14
    entry = lambda path, is_dir, when: F.when(when, F.struct(path.alias("path"), F.lit(is_dir).alias("is_dir")))
    gone = {"-typst-zh/source-map.json": 1, "-raw/Scan.pdf": 6}
    always = F.lit(True)
    there = [entry(F.lit(p), d, always) for p, d in _COMMON]
    for p, d in _NAMED:
        keep = k != gone[p] if p in gone else k != 11 if p.startswith("-typst-zh") else ~k.isin(7, 12) if p.endswith("one.md") else always
        there.append(entry(F.concat(w, F.lit(p)), d, keep))
    for p, d, n in (("-typst-zh/raw", True, 2), ("-raw/x.TYP", False, 4), ("-typst-zh/book/.git", True, 5), ("-markdown/chapters/one.txt", False, 7), ("-typst-en", True, 11), ("-markdown/other", False, 0)):
        there.append(entry(F.concat(w, F.lit(p)), d, k == n))
    there += [entry(F.lit("Notes"), True, k == 3), entry(F.lit(".gitmodules"), False, k == 5)]
    slug = F.when(k == 12, "edit_x").otherwise("edit")
    skill = F.concat(F.lit(".agents/skills/"), slug)
    there += [entry(skill, True, k != 8), entry(F.concat(skill, F.lit("/SKILL.md")), False, k != 8), entry(F.lit(".agents/skills/more/SKILL.md"), False, k == 0)]
    own = table(spark, sf_dir, "supplier").select(w.alias("workspace"), key)
    paths = own.select("workspace", F.inline(F.array_compact(F.array(*there))))
    line = F.when(k == 9, "title: x").when(k == 10, "name: other").otherwise(F.concat(F.lit("name: "), slug))
    skills = own.select("workspace", F.concat(skill, F.lit("/SKILL.md")).alias("path"), F.concat(F.lit("---\n"), line, F.lit("\n---\n")).alias("content"))
    return spaces.findings(paths, skills, "zh")


# Layout

LAYOUT_SQL = r"""
WITH p AS (SELECT 'd' || (doc_id // 10) AS doc, doc_id // 10 AS g, doc_id % 10 + 1 AS page, doc_id AS i, CASE WHEN (doc_id // 10) % 19 = 4 THEN ' ' ELSE coalesce(text, '') END AS text
  FROM documents WHERE (doc_id // 10) % 17 <> 9 OR doc_id % 10 = 0),
o AS (SELECT * FROM p WHERE g % 11 <> 3),
f AS (
  SELECT DISTINCT 'needs a password' AS "check", doc AS subject, '' AS detail FROM p WHERE g % 11 = 3
  UNION ALL SELECT DISTINCT 'needed repair', doc, '' FROM o WHERE g % 13 = 5
  UNION ALL SELECT 'fewer than two pages', doc, '' FROM o GROUP BY doc HAVING count(*) < 2
  UNION ALL SELECT 'unexpected trim', doc || ' p. ' || page, '' FROM o WHERE i % 23 = 4
  UNION ALL SELECT 'fixture artwork', doc || ' p. ' || page, '' FROM o WHERE i % 29 = 7
  UNION ALL SELECT 'text out of bounds', doc || ' p. ' || page, '' FROM o WHERE i % 31 = 2
  UNION ALL SELECT 'font not embedded', doc || ' p. ' || min(page), 'F' || i % 3 FROM o GROUP BY doc, i % 3 HAVING i % 3 = 0 OR arg_min(i % 4, page) = 0
  UNION ALL SELECT doc_check, doc, '' FROM (SELECT 'no searchable body' AS doc_check, doc, count(*) FILTER (page >= 3 AND regexp_matches(text || CASE WHEN i % 29 = 7 THEN 'x' ELSE '' END, '[^\s\x0B\x{85}\p{Z}]')) AS n FROM o GROUP BY doc) WHERE n = 0),
m AS (SELECT doc, page, g, CASE WHEN page = 3 THEN 'opener' WHEN page = 7 AND g % 2 = 0 THEN 'plate' END AS role FROM p),
r AS (SELECT doc, page, last_value(role IGNORE NULLS) OVER w AS role, last_value(CASE WHEN role IS NOT NULL THEN page END IGNORE NULLS) OVER w AS since
  FROM m WINDOW w AS (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING))
SELECT "check", 'FAIL' AS severity, subject, detail FROM f
UNION ALL SELECT 'role', 'PASS', doc || ' p. ' || page, CASE WHEN role IS NULL THEN 'front' WHEN role = 'opener' AND since < page THEN 'body' ELSE role END FROM r
"""


def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on the layout of books of ten documents, a page each, and the roles of their pages."""
    wide, high = 176 * 72 / 25.4, 250 * 72 / 25.4
    g = F.expr("doc_id div 10")
    raw = F.when(g % 19 == 4, " ").otherwise(F.col("text"))
    body = F.when(_id() % 29 == 7, F.concat(raw, F.lit(f" {layout.FIXTURE_MARK}"))).otherwise(raw)
    own = _docs(spark, sf_dir).where((g % 17 != 9) | (_id() % 10 == 0)).select("doc_id", F.concat(F.lit("d"), g).alias("doc"), g.alias("g"), (_id() % 10 + 1).cast("int").alias("page"), body.alias("text"))
    docs = own.select("doc", (F.col("g") % 11 == 3).alias("needs_pass"), (F.col("g") % 13 == 5).alias("repaired")).distinct()
    pages = own.select("doc", "page", F.lit(wide).alias("width"), (F.lit(high) + F.when(_id() % 23 == 4, 1.0).otherwise(0.0)).alias("height"), "text")
    words = own.select("doc", "page", F.when(_id() % 31 == 2, -1.0).otherwise(1.0).alias("x0"), F.lit(5.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"), F.lit("word").alias("word"))
    fonts = own.select("doc", "page", (_id() % 3).cast("int").alias("xref"), F.concat(F.lit("F"), _id() % 3).alias("name"), (_id() % 4 != 0).alias("embedded"))
    mark = F.when(F.col("page") == 3, "opener").when((F.col("page") == 7) & (F.col("g") % 2 == 0), "plate")
    marks = own.select("doc", "page", F.lit(1).alias("seq"), mark.alias("role"), F.lit("One").alias("running")).where("role IS NOT NULL")
    found = layout.page_findings(docs, pages, words, fonts)
    roles = layout.roles(pages, marks)
    return found.unionByName(roles.select(F.lit("role").alias("check"), F.lit("PASS").alias("severity"), F.concat_ws(" p. ", "doc", "page").alias("subject"), F.col("role").alias("detail")))


# Matching

MATCH_SQL = rf"""
WITH d AS (SELECT doc_id AS i, coalesce(text, '') AS text FROM documents),
a AS (SELECT i, text, CASE WHEN i % 10 = 0 THEN 'Note number ' || (i + 1) || ' of all' WHEN i % 10 = 2 THEN 'See Note number ' || (i + 1) || ' of all there' ELSE 'Unlike ' || i END AS title FROM d WHERE i % 2 = 0),
p AS (SELECT i, text, 'Note number ' || i || ' of all' AS title FROM d WHERE i % 2 = 1),
m AS (SELECT a.i AS a, min(p.i) AS p, bool_or(a.title = p.title) AS equal FROM a JOIN p ON contains(a.title, p.title) OR contains(p.title, a.title) GROUP BY a.i),
t AS (SELECT i, regexp_replace(unnest(regexp_split_to_array(text, '\r?\n')), '{_TRIM}', '', 'g') AS line FROM d),
s AS (SELECT DISTINCT i, line FROM t WHERE length(line) + length(regexp_replace(line, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) >= 10 AND NOT regexp_matches(line, '^#{{1,6}}\s') AND NOT regexp_matches(line, '^!?\[')),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
c AS (SELECT x.i AS a, y.i AS p, count(*) AS c FROM s x JOIN s y ON x.line = y.line AND x.i % 2 = 0 AND y.i % 2 = 1 WHERE x.i NOT IN (SELECT a FROM m) GROUP BY x.i, y.i),
b AS (SELECT a, arg_max(p, (score, -p)) AS p, max(score) AS score FROM (SELECT a, p, 2.0 * CAST(c AS DOUBLE) / (x.n + y.n) AS score FROM c JOIN n x ON x.i = a JOIN n y ON y.i = p) GROUP BY a)
SELECT a.i AS article, CASE WHEN m.a IS NOT NULL THEN m.p WHEN score >= 0.5 THEN b.p END AS post,
  CASE WHEN m.equal THEN 'title-exact' WHEN m.a IS NOT NULL THEN 'title-partial' WHEN score >= 0.5 THEN 'body-similarity(' || printf('%.2f', floor(score * 100 + 0.5 + 1e-9) / 100) || ')'
    WHEN score IS NOT NULL THEN 'nearest ' || b.p || ' score=' || printf('%.2f', floor(score * 100 + 0.5 + 1e-9) / 100) ELSE 'none' END AS how,
  CASE WHEN m.a IS NULL THEN score END AS score
FROM a LEFT JOIN m ON m.a = a.i LEFT JOIN b ON b.a = a.i
"""


def match_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every second document as an article, the others as posts."""
    docs = _docs(spark, sf_dir)
    title = F.when(_id() % 10 == 0, _say("Note number %d of all", _id() + 1)).when(_id() % 10 == 2, _say("See Note number %d of all there", _id() + 1)).otherwise(_say("Unlike %d", _id()))
    articles = docs.where("doc_id % 2 = 0").select(_id().alias("article"), title.alias("title"), F.col("text").alias("body"))
    own = docs.where("doc_id % 2 = 1").select(_id().alias("post"), _id().alias("pos"), _say("Note number %d of all", _id()).alias("title"), F.col("text").alias("body"))
    return articles, own


def article_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents matched to others: by equal titles, by titles that hold each other, by lines."""
    return match.find(*match_sides(spark, sf_dir))


# Discovery

DISCOVERY_SQL = """
WITH s AS (SELECT c_custkey AS k, c_custkey // 20 AS g FROM customer),
m AS (SELECT g, k FROM s WHERE g % 4 IN (0, 3) AND k % 3 = 0),
f AS (SELECT g, k, 'Feed ' || k AS title FROM s WHERE g % 4 IN (0, 1) AND k % 5 = 0),
l AS (
  SELECT g, CAST(k % 10 + 1 AS INTEGER) AS page, k, 'Listing ' || k AS title FROM s
  WHERE k % 10 < 6 AND NOT (g % 4 = 3 AND k % 10 = 3) AND NOT (g % 4 = 1 AND k % 10 = 0) AND NOT (g % 4 = 2 AND k % 10 < 2)
  UNION ALL SELECT g, 4, k, 'A title that is longer ' || k FROM s WHERE g % 4 = 3 AND k % 10 = 0),
firsts AS (SELECT g, k, min(page) AS page FROM l WHERE (g, k) NOT IN (SELECT (g, k) FROM m) AND (g, k) NOT IN (SELECT (g, k) FROM f) GROUP BY g, k),
there AS (SELECT g, page FROM l UNION SELECT g, 1 FROM s),
stops AS (SELECT g, min(page) AS stop FROM (
  SELECT g, page FROM there WHERE page > 1 AND (g, page) NOT IN (SELECT (g, page) FROM firsts)
  UNION ALL SELECT g, page + 1 FROM there WHERE (g, page + 1) NOT IN (SELECT (g, page) FROM there)) GROUP BY g),
t AS (
  SELECT g, k, '' AS title FROM m UNION ALL SELECT g, k, title FROM f UNION ALL SELECT g, k, title FROM l JOIN stops USING (g) WHERE page <= stop
  UNION ALL SELECT g, k, 'From the archive ' || k FROM s WHERE k % 10 = 9)
SELECT 'https://s' || g || '.org/p/' || k AS url, arg_max(title, length(title)) AS title FROM t GROUP BY g, k
"""


def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of many sites, each of twenty customers, from their sitemaps, feeds, listings and archives.

    Of four sites one has moved from another host, one has no home page, one neither that nor a second
    page, and one a fourth page that brings nothing new but longer titles, so that its fifth is never read.
    """
    key, g = F.col("c_custkey"), F.expr("c_custkey div 20")
    own = table(spark, sf_dir, "customer").select(key, g.alias("g"))
    kind, k10 = F.col("g") % 4, key % 10
    host, old = _say("https://s%d.org", F.col("g")), _say("https://old%d.org", F.col("g"))
    url = F.concat(host, _say("/p/%d", key))

    def given(rows: DataFrame, by: Column, item: Column, before: str, after: str) -> DataFrame:
        """g, n and the text of each group's items, at most as many as a site has customers."""
        packed = _packed(rows, F.struct("g", by.alias("n")), item, "c_custkey", "")
        return packed.select("g.g", "g.n", F.concat(F.lit(before), "body", F.lit(after)).alias("body"))

    def link(title: str) -> Column:
        return _say('<a class="x" href="/p/%d"><b>' + title + " %d</b></a><a href='/none'>no</a>", key, key)

    none, html = '<a href="/tags/x">no</a></html>', "<html>"
    maps = given(own.where(kind.isin(0, 3) & (key % 3 == 0)), key % 2, _say("<url><loc>%s</loc></url>", url), "<urlset>", "</urlset>")
    child = _say("%s/map%d.xml", host, F.col("n"))
    entries = F.array_join(F.array_sort(F.collect_list(_say("<sitemap><loc>%s</loc></sitemap>", child))), "")
    index = maps.groupBy("g").agg(F.concat(F.lit("<sitemapindex>"), entries, F.lit("</sitemapindex>")).alias("body"))
    feed = given(own.where(kind.isin(0, 1) & (key % 5 == 0)), F.lit(0), _say("<item><link>%s</link><title>Feed %d</title></item>", url, key), "<rss><channel>", "</channel></rss>")
    gone = ((kind == 3) & (k10 == 3)) | ((kind == 1) & (k10 == 0)) | ((kind == 2) & (k10 < 2))
    pages = given(own.where((k10 < 6) & ~gone), k10 + 1, link("Listing"), html, none)
    idle = given(own.where((kind == 3) & (k10 == 0)), F.lit(4), link("A title that is longer"), html, none)
    archive = given(own.where(k10 == 9), F.lit(0), link("From the archive"), html, none)
    first, moved = F.col("n") == 1, kind == 0
    listed = pages.unionByName(idle.select("g", F.col("n").cast("bigint").alias("n"), "body"))
    at = F.when(first, F.concat(F.when(moved, old).otherwise(host), F.lit("/"))).otherwise(_say("%s/page/%d/", host, F.col("n")))
    rows = [
        maps.select("g", child.alias("url"), child.alias("final_url"), "body"),
        *[df.select("g", F.concat(host, F.lit(path)).alias("url"), F.concat(host, F.lit(path)).alias("final_url"), "body") for df, path in ((index, "/sitemap.xml"), (feed, "/rss.xml"), (archive, "/archives/"))],
        listed.select("g", at.alias("url"), F.when(first, F.concat(host, F.lit("/"))).otherwise(at).alias("final_url"), "body"),
    ]
    responses = report.all_of([r.select(F.when(moved, old).otherwise(host).alias("asked"), "url", "final_url", "body") for r in rows])
    return discover.discovered_sites(materialize(responses, "responses")).select("url", "title")


# The queue

PARTIES = ("a", "b")
_QUEUE = """
c AS (SELECT conv_id AS c, turn AS t, conv_id * 1000 + turn * 10 AS s, coalesce(text, '') AS text, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS actor, CASE WHEN turn % 2 = 0 THEN 'b' ELSE 'a' END AS peer FROM conversations),
x AS (
  SELECT *, s + j AS seq, CASE WHEN j < 2 AND c % 17 = 3 AND t = 1 THEN 'bad id!' ELSE 'c' || c || '-t' || t END AS id,
    CASE WHEN t > 0 THEN 'c' || c || '-t' || (t - 1) END AS reply_to, CASE WHEN j = 2 THEN 'other' WHEN c % 13 = 4 AND t = 2 THEN ' ' || chr(9) ELSE text END AS body,
    CASE WHEN j < 2 AND c % 23 = 6 AND t = 0 THEN 'parties' WHEN j < 2 AND (c % 13 = 4 AND t = 2 OR trim(text, chr(9) || chr(10) || chr(13) || ' ') = '') THEN 'blank body' WHEN j < 2 AND c % 17 = 3 AND t = 1 THEN 'invalid id' END AS why,
    j < 2 AND c % 19 = 5 AND t = 1 AS crossed
  FROM (SELECT c.*, unnest([0, 1, 2]) AS j FROM c) WHERE j = 0 OR j = 1 AND c % 3 = 0 OR j = 2 AND c % 5 = 0),
k AS (SELECT c, t, min(seq) FILTER (why IS NULL AND NOT crossed) AS first FROM x GROUP BY c, t),
live AS (SELECT c, t, first, bool_and(first IS NOT NULL) OVER (PARTITION BY c ORDER BY t ROWS UNBOUNDED PRECEDING) AS live FROM k),
p AS (
  SELECT x.*, live, first, CASE WHEN why IS NOT NULL THEN why WHEN live AND seq = first THEN 'created'
    WHEN live AND seq > first AND NOT crossed AND body = (SELECT y.body FROM x y WHERE y.seq = live.first) THEN 'repeat' WHEN live AND seq > first THEN 'conflict' ELSE 'no such parent' END AS outcome
  FROM x JOIN live USING (c, t)),
r AS (
  SELECT c, t, s, live, (c + t) % 4 = 1 AS r5, (c + t) % 3 = 0 AS a6, (c + t) % 7 = 0 AS a7, (c + t) % 6 = 0 AS a8, (c + t) % 5 = 0 AS r9, actor, peer FROM c JOIN live USING (c, t)),
a AS (
  SELECT s + 5 AS seq, 'receive' AS op, c, t, peer AS actor, CASE WHEN live THEN 'received' ELSE 'refused' END AS outcome FROM r WHERE r5
  UNION ALL SELECT s + 6, 'ack', c, t, peer, CASE WHEN live THEN 'acknowledged' ELSE 'refused' END FROM r WHERE a6
  UNION ALL SELECT s + 7, 'ack', c, t, actor, 'refused' FROM r WHERE a7
  UNION ALL SELECT s + 8, 'ack', c, t, peer, CASE WHEN live THEN 'again' ELSE 'refused' END FROM r WHERE a8
  UNION ALL SELECT s + 9, 'receive', c, t, peer, CASE WHEN NOT live THEN 'refused' WHEN a6 THEN 'acknowledged before' WHEN r5 THEN 'read again' ELSE 'received' END FROM r WHERE r9)
"""
OUTCOME_SQL = f"""WITH {_QUEUE}
SELECT CAST(seq AS BIGINT) AS seq, 'post' AS op, id, CASE WHEN crossed THEN peer ELSE actor END AS actor, outcome FROM p
UNION ALL SELECT CAST(seq AS BIGINT), op, 'c' || c || '-t' || t, actor, outcome FROM a"""
MESSAGE_SQL = f"""WITH {_QUEUE}
SELECT id, CAST(seq AS BIGINT) AS seq, p.actor AS sender, p.peer AS recipient, 'message' AS kind, body, reply_to, CAST(seq AS DOUBLE) AS created_at,
  CAST(CASE WHEN r5 THEN r.s + 5 WHEN a6 THEN r.s + 6 WHEN r9 THEN r.s + 9 END AS DOUBLE) AS received_at, CAST(CASE WHEN a6 THEN r.s + 6 END AS DOUBLE) AS ack_at
FROM p JOIN r USING (c, t) WHERE outcome = 'created'"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as commands: turns answer each other; some are blank, misnamed or misdirected, sent again or differently; some are read and acknowledged."""
    c, t = F.col("conv_id"), F.col("turn")
    s, even = c * 1000 + t * 10, t % 2 == 0
    name = _say("c%d-t%d", c, t)
    actor, peer = F.when(even, "a").otherwise("b"), F.when(even, "b").otherwise("a")
    crossed = (c % 19 == 5) & (t == 1)
    none = F.lit(None).cast("string")

    def command(j, op, when, id_, actor_, peer_, kind, body, reply):
        fields = {"op": F.lit(op), "id": id_, "actor": actor_, "peer": peer_, "kind": kind, "body": body, "reply_to": reply}
        return F.when(when, F.struct((s + j).alias("seq"), *[v.cast("string").alias(k) for k, v in fields.items()]))

    text_ = F.coalesce("text", F.lit(""))
    own = F.when((c % 17 == 3) & (t == 1), "bad id!").otherwise(name)
    body = F.when((c % 13 == 4) & (t == 2), " \t").otherwise(text_)
    reply = F.when(t > 0, _say("c%d-t%d", c, t - 1))
    wrong = F.when((c % 23 == 6) & (t == 0), "c").when(crossed, actor).otherwise(peer)
    post = [own, F.when(crossed, peer).otherwise(actor), wrong, F.lit("message"), body, reply]
    act = lambda j, op, when, who: command(j, op, when, name, who, none, none, none, none)
    every = F.array(
        command(0, "post", F.lit(True), *post),
        command(1, "post", c % 3 == 0, *post),
        command(2, "post", c % 5 == 0, name, actor, peer, F.lit("message"), F.lit("other"), reply),
        act(5, "receive", (c + t) % 4 == 1, peer),
        act(6, "ack", (c + t) % 3 == 0, peer),
        act(7, "ack", (c + t) % 7 == 0, actor),
        act(8, "ack", (c + t) % 6 == 0, peer),
        act(9, "receive", (c + t) % 5 == 0, peer),
    )
    rows = table(spark, sf_dir, "conversations").select(F.inline(F.array_compact(every)))
    return rows.withColumn("ts", F.col("seq").cast("double"))


COMMAND = "seq bigint, op string, id string, actor string, peer string, kind string, body string, reply_to string, ts double"


def queue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that the commands leave."""
    return queue.messages(commands(spark, sf_dir), PARTIES)


def queue_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each command came to."""
    return queue.outcomes(commands(spark, sf_dir), PARTIES)


def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same commands came to as a stream in two runs; the second goes on from the checkpoint, in the middle of a conversation."""
    base = shared(spark, "queue-stream")
    store = stream.QueueStore(spark, f"{base}/store", PARTIES)
    every = commands(spark, sf_dir)
    half = table(spark, sf_dir, "conversations").agg(F.expr("max(conv_id) div 2 * 1000 + 15").alias("half")).first().half or 0
    for part in (every.where(F.col("seq") < half), every.where(F.col("seq") >= half)):
        part.write.mode("append").parquet(f"{base}/in")
        store.start(spark.readStream.schema(COMMAND).parquet(f"{base}/in"), availableNow=True).awaitTermination()
    return store.outcomes()


EVENT_SQL = f"""WITH m AS ({MESSAGE_SQL})
SELECT created_at AS at, 'posted' AS event, id AS message_id, sender AS actor FROM m
UNION ALL SELECT received_at, 'received', id, recipient FROM m WHERE received_at IS NOT NULL
UNION ALL SELECT ack_at, 'acknowledged', id, recipient FROM m WHERE ack_at IS NOT NULL"""


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that the same commands leave, read as a stream that stops after the first half and goes on from its checkpoint."""
    base = shared(spark, "queue-events")
    store = stream.QueueStore(spark, f"{base}/store", PARTIES)
    every = commands(spark, sf_dir)
    half = table(spark, sf_dir, "conversations").agg(F.expr("max(conv_id) div 2 * 1000 + 15").alias("half")).first().half or 0
    for n, part in enumerate((every.where(F.col("seq") < half), every.where(F.col("seq") >= half))):
        store.apply(part, n)
        keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/log/batch={batch}")
        store.follow(keep, f"{base}/followed", availableNow=True).awaitTermination()
    return spark.read.schema(stream.EVENT).parquet(f"{base}/log").select("at", "event", "message_id", "actor")


# Dynamic JSON

JSON_SQL = """
SELECT event_id, '{"event":"' || event_type || '","k":[' || event_id || ',{"a":null,"b":' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || '},"' || event_type || chr(92) || 'n"],"props":' || replace(replace(props, ': ', ':'), ', ', ',') || '}' AS canonical
FROM events
"""


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON with sorted keys at every depth, from texts that have them in another order and with spaces."""
    text = _say('{ "props" : %s, "k": [%d, {"b": %s , "a":null}, "%s\\n"],\n"event":"%s"}', F.col("props"), F.col("event_id"), (F.col("user_id") % 2 == 0).cast("string"), F.col("event_type"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", hashing.canonical_json(variant.parsed(text)).alias("canonical"))


# Corrections and links

CORRECTION_SQL = """
WITH p AS (SELECT doc_id AS page, text, string_split(text, ' ') AS w FROM documents),
c AS (SELECT page, text, unnest([w[3] || ' ' || w[4], w[4] || ' ' || w[5], w[10], w[11], w[30]]) AS before, unnest(['<A>', '<B>', w[11], '<C>', '']) AS after FROM p),
f AS (SELECT page, text, after, instr(text, before) AS lo, instr(text, before) + length(before) AS hi FROM c
  WHERE before <> '' AND length(text) - length(replace(text, before, '')) = length(before)),
o AS (SELECT *, (SELECT count(*) FROM f AS g WHERE g.page = f.page AND g.lo < f.hi AND f.lo < g.hi) AS meets FROM f),
k AS (SELECT *, lag(hi, 1, 1) OVER (PARTITION BY page ORDER BY lo) AS done FROM o WHERE meets = 1),
s AS (SELECT page, string_agg(substr(text, done, lo - done) || coalesce(after, ''), '' ORDER BY lo) || substr(any_value(text), max(hi)) AS fixed FROM k GROUP BY page)
SELECT page, coalesce(fixed, text) AS text FROM p LEFT JOIN s USING (page)
"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after corrections of their own words: what one writes isn't taken for another's text, overlapping and ambiguous ones are left out."""
    pages = table(spark, sf_dir, "documents").select(_id().alias("page"), "text")
    words = F.split("text", " ")
    word = lambda n: F.try_element_at(words, F.lit(n))
    fix = lambda n, before, after, status="accepted": F.struct(F.concat(F.col("page").cast("string"), F.lit(f"-{n}")).alias("id"), before.alias("before"), after.alias("after"), F.lit(status).alias("status"))
    every = F.array(
        fix(1, F.concat(word(3), F.lit(" "), word(4)), F.lit("<A>")),  # these two overlap
        fix(2, F.concat(word(4), F.lit(" "), word(5)), F.lit("<B>")),
        fix(3, word(10), word(11)),  # writes what the next one looks for
        fix(4, word(11), F.lit("<C>")),
        fix(5, word(30), F.lit(None).cast("string")),
        fix(6, word(20), F.lit("<D>"), "open"),
    )
    return notes.applied(pages.select("page", F.inline(every)), pages)


_LINKS = r"""
p AS (SELECT page_id AS k, url || '#' || page_id AS place FROM pages),
docs AS (SELECT '[a](' || place || ') and ![b](' || place || ') [c](relative)' AS content FROM p),
st AS (SELECT place AS url, CASE WHEN k % 7 < 3 THEN 200 END AS head_status, CASE k % 7 WHEN 5 THEN 400 + k % 100 WHEN 6 THEN 204 END AS get_status,
  CASE WHEN k % 7 = 4 THEN 'refused' END AS error FROM p WHERE k % 7 <> 3),
l AS (SELECT DISTINCT unnest(regexp_extract_all(content, '\]\((https?://[^)\s]+)', 1)) AS url FROM docs),
e AS (SELECT l.url, CASE WHEN coalesce(head_status, get_status) IS NULL THEN coalesce(error, 'no answer')
  WHEN coalesce(head_status, get_status) >= 400 THEN 'HTTP ' || coalesce(head_status, get_status) END AS error FROM l LEFT JOIN st USING (url))
"""
LINK_SQL = f"WITH {_LINKS} SELECT url, error FROM e WHERE error IS NOT NULL"


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A Markdown text for each page that links to it, and what each address answered; some were never reached."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("#"), k.cast("string")).alias("at"))
    docs = pages.select(_say("[a](%s) and ![b](%s) [c](relative)", F.col("at"), F.col("at")).alias("content"))
    codes = pages.where(k % 7 != 3).select(
        F.col("at").alias("url"),
        F.when(k % 7 < 3, 200).alias("head_status"),
        F.when(k % 7 == 5, 400 + k % 100).when(k % 7 == 6, 204).cast("int").alias("get_status"),
        F.when(k % 7 == 4, "refused").alias("error"),
    )
    return docs, codes


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of Markdown texts that don't answer."""
    return discover.broken_links(*_links(spark, sf_dir))


LINK_SUMMARY_SQL = f"WITH {_LINKS} SELECT count(*) AS checked, count(error) AS broken FROM e"


def link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links were checked, and how many are broken."""
    return discover.link_summary(*_links(spark, sf_dir))


AGREEMENT_SQL = """
WITH a AS (SELECT doc_id AS id, lang, unnest(CASE WHEN doc_id % 7 = 2 THEN [1, 2] ELSE [1] END) AS c FROM documents WHERE doc_id % 5 <> 1),
e AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 3 THEN 'other' ELSE lang END AS lang, unnest(CASE WHEN doc_id % 13 = 4 THEN [1, 2] ELSE [1] END) AS c FROM documents WHERE doc_id % 6 <> 1),
b AS (SELECT coalesce(x.id, y.id) AS id, x.n AS na, y.n AS ne, x.l AS la, y.l AS le FROM (SELECT id, count(*) AS n, min(lang) AS l FROM a GROUP BY id) x FULL OUTER JOIN (SELECT id, count(*) AS n, min(lang) AS l FROM e GROUP BY id) y ON x.id = y.id)
SELECT id, CASE WHEN ne IS NULL THEN 'not emitted' WHEN na IS NULL THEN 'not accepted' WHEN na > 1 THEN 'accepted more than once' WHEN ne > 1 THEN 'emitted more than once' ELSE 'differs' END AS problem
FROM b WHERE ne IS NULL OR na IS NULL OR na > 1 OR ne > 1 OR la IS DISTINCT FROM le
"""


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted candidates against emitted ones: missing, repeated and different ones."""
    docs = table(spark, sf_dir, "documents").select(_id().alias("id"), "lang")
    twice = lambda rows, when: rows.withColumn("c", F.explode(F.when(when, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("c")
    accepted = twice(docs.where("id % 5 <> 1"), F.col("id") % 7 == 2)
    emitted = twice(docs.where("id % 6 <> 1").withColumn("lang", F.when(F.col("id") % 11 == 3, "other").otherwise(F.col("lang"))), F.col("id") % 13 == 4)
    return notes.agreement(accepted, emitted, "id", ["lang"])


CODE_SQL = r"""
WITH l AS (SELECT conv_id AS page, turn AS line FROM conversations
  WHERE CAST(length(text) < 300 AS INTEGER) + CAST(contains(text, chr(10)) AS INTEGER) + CAST(regexp_matches(text, ' (the|le|die|que) ') AS INTEGER) >= 2),
i AS (SELECT page, line, line - row_number() OVER (PARTITION BY page ORDER BY line) AS k FROM l)
SELECT page, min(line) AS first, max(line) AS last, count(*) AS n FROM i GROUP BY page, k HAVING count(*) > 1
"""


def code_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns, as lines, that have two of three signals of their texts: short, of several lines, with a key word."""
    lines = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page"), F.col("turn").alias("line"), (F.char_length("text") < 300).alias("mono"), F.contains("text", F.lit("\n")).alias("indent"), F.col("text").rlike(" (the|le|die|que) ").alias("keyword")
    )
    return notes.code_runs(lines, ["mono", "indent", "keyword"])


VERDICT_SQL = "SELECT CASE WHEN count(*) FILTER (toxic = 1) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN count(*) FILTER (toxic = 1) > 0 THEN 1 ELSE 0 END AS exit_code, count(*) <> count(DISTINCT quality) AS repeated FROM labels"


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the labels' findings, and whether a quality is there twice."""
    labels = table(spark, sf_dir, "labels")
    found = labels.select(F.lit("label").alias("check"), F.when(F.col("toxic") == 1, "FAIL").otherwise("PASS").alias("severity"), F.col("doc_id").cast("string").alias("subject"), F.lit("").alias("detail"))
    return report.verdict(found).join(F.broadcast(reconcile.has_repeats(labels, "quality")))
