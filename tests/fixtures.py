"""Operators over small literal inputs with the edge cases that they were written for."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import discover, layout, ledger, manifest as books, match, posts, queue, release as releases, workspace as spaces
from tallyspark.plans.session import workspace as shared
from tallyspark.sources import filetree, xmlfeeds
from tallyspark.streaming import queue as stream

SHA = "a" * 64

POSTS = [
    ("0205/index.md", '---\ntitle: "Second one"\npubDatetime: 2024-01-02\ntags:\n  - "a"\n  - b\n---\n\nA first line of prose here.\nAnother line of prose here.\n'),
    ("0300/index.mdx", "---\r\ntitle: 'Third'\r\n---\r\nWhat the third post has to say.\r\n"),
    ("0300/index.md", "---\ntitle: Third in plain\narea: notes\n---\nWhat the third post has to say.\nAnd its second line.\n"),
    ("about/index.md", "no post"),
]
ARTICLES = [
    ("in/one.md", "---\ntitle: Second one\narea: x\n---\nBody.\n"),
    ("in/two.md", "# Third in\n\nOther words.\n"),
    ("in/three.mdx", "---\narea: y\n---\nWhat the third post has to say.\nAnd a line of its own.\n"),
    ("in/four.md", "Nothing that any post has.\n"),
]

SITEMAP = '<s:urlset xmlns:s="http://x/"><s:url><s:loc> https://a.org/p/1 </s:loc></s:url><s:url><s:loc>https://a.org/heritage</s:loc></s:url></s:urlset>'
INDEX = "<sitemapindex><sitemap><loc>https://a.org/s1.xml</loc></sitemap></sitemapindex>"
RSS = "<rss><channel><item><link>https://a.org/p/1</link><title>One</title></item><item><link>x</link><link>https://a.org/p/2</link></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="https://a.org/self"/><link href="https://a.org/p/3"/><title>Three</title></entry></feed>'


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, tags and descriptions of posts and articles."""
    files = spark.createDataFrame(POSTS, "path string, content string")
    own = posts.posts(files)
    block = text.front_matter(F.col("raw"))
    return own.select("id", "file", "title", "pub_datetime", text.tag_list(block).alias("tags"), text.first_prose_line(F.col("body")).alias("first"))


def xml_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of sitemaps and feeds, a malformed one among them."""
    rows = spark.createDataFrame([("sitemap", SITEMAP), ("index", INDEX), ("rss", RSS), ("atom", ATOM), ("bad", "<rss>")], "name string, body string")
    maps = xmlfeeds.sitemap_entries(rows, ["name"]).select("name", "pos", F.col("loc").alias("link"), F.lit("").alias("title"))
    return maps.unionByName(xmlfeeds.feed_entries(rows, ["name"]))


def _tree(spark: SparkSession | None = None) -> str:
    """A small tree in the shared folder, where that is one of files; without a session in a folder of this machine."""
    base = shared(spark, "tree") if spark is not None else ""
    root = Path(base.removeprefix("file:")) if base.startswith("file:") else Path(tempfile.mkdtemp(prefix="tallyspark-tree-"))
    root.mkdir(parents=True, exist_ok=True)
    for name, content in ((".hidden", "h"), ("_x/a.txt", "a"), ("b.md", "b\n")):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(content)
        (root / name).chmod(0o644)
    (root / "link").symlink_to("b.md")
    return str(root)


def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a small tree: hidden, underscored and linked ones too."""
    return filetree.read(spark, _tree(spark)).select("path", "depth", "kind", "sha256", "target")


COMMANDS = [
    (1, "post", "m1", "a", "b", "task", "do it", None, 1.0),
    (2, "post", "m1", "a", "b", "task", "do it", None, 2.0),
    (3, "post", "m1", "a", "b", "task", "do that", None, 3.0),
    (4, "receive", "m1", "b", None, None, None, None, 4.0),
    (5, "ack", "m1", "a", None, None, None, None, 5.0),
    (6, "ack", "m1", "b", None, None, None, None, 6.0),
    (7, "ack", "m1", "b", None, None, None, None, 7.0),
    (8, "post", "m2", "b", "a", "message", "回答\nzwei", "m1", 8.0),
    (9, "post", "m3", "a", "b", "message", "wrong way", "m1", 9.0),
    (10, "post", "m4", "a", "b", "message", " \t", None, 10.0),
    (11, "post", "bad id!", "a", "b", "message", "x", None, 11.0),
    (12, "ack", "m2", "a", None, None, None, None, 12.0),
    (13, "post", "m5", "a", "b", "message", "fine", "m2", 13.0),
]
COMMAND = "seq bigint, op string, id string, actor string, peer string, kind string, body string, reply_to string, ts double"
PARTIES = ("a", "b")


def queue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that the commands leave."""
    return queue.messages(spark.createDataFrame(COMMANDS, COMMAND), PARTIES)


def queue_stream(spark: SparkSession, parts: list[DataFrame], parties: tuple[str, str] = PARTIES) -> stream.QueueStore:
    """The store that parts of commands leave, each taken as a stream that goes on from the checkpoint."""
    base = shared(spark, "queue-stream")
    store = stream.QueueStore(spark, f"{base}/store", parties)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        store.start(spark.readStream.schema(COMMAND).parquet(f"{base}/in"), availableNow=True).awaitTermination()
    return store


LEDGERS = [
    ("list.json", '[{"page": 1, "status": "ok"}, {"page": "2", "status": " Needs-Review "}, {"page": 2.9}, {"source_page": true, "status": null}]'),
    ("object.json", '{"records": [{"page_number": " 12 "}, {"page": null, "source_page": 3}, {"page": "3.7"}]}'),
    ("lines.jsonl", '{"page": 1}\n\n{"page": 5, "status": "done"}\nnot json'),
    ("one.jsonl", '{"page": 1}'),
    ("empty.json", " \n"),
]


def page_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ledgers in all three forms, with their errors."""
    return ledger.pages(ledger.records(spark.createDataFrame(LEDGERS, "path string, content string")))


MANIFEST = (
    '{"chapters": [{"source": "a.md", "output": "book/a.typ", "source_sha256": "%s"}, {"source": "gone.md", "output": "book/b.typ", "source_sha256": "bad"}, {"output": ""}, 7],'
    ' "images": [{"asset": "assets/figures/x.png", "width": 3, "height": 0}, {"asset": "assets/figures/no.png", "width": "3"}], "excluded_sources": ["skip.md"]}' % SHA
)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on a manifest."""
    v = books.objects(spark.createDataFrame([("m.json", MANIFEST)], "path string, content string"))
    tree = "path string, kind string, sha256 string"
    sources = spark.createDataFrame([("a.md", "file", "b" * 64), ("new.md", "file", SHA), ("skip.md", "file", SHA), ("pic.png", "file", SHA)], tree)
    book = spark.createDataFrame([("book/a.typ", "file", SHA), ("assets/figures/x.png", "file", SHA), ("assets/figures/y.png", "file", SHA)], tree)
    return books.chapter_findings(v, sources, book).unionByName(books.image_findings(v, book))


RECORD = '{"pdf": {"sha256": "%s"}, "pages": "4", "typst_version": "0.1", "build_command": "", "time_strategy": {"value": 0}}' % SHA
SAMPLES = (
    '[{"filename": "1.png", "output_page": 1, "semantic_class": "cover"}, {"filename": "2.png", "output_page": "x", "semantic_class": "code-dense"},'
    ' {"filename": "3.png", "page": 9, "output_page": 9, "semantic_class": "plain"}, {"filename": "1.png", "output_page": 1, "semantic_class": "cover"}, {"filename": "4.png"}]'
)


def release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on a release record and its samples."""
    records = books.objects(spark.createDataFrame([("r.json", RECORD)], "path string, content string"))
    actual = spark.createDataFrame([("r.json", "c" * 64, 5)], "path string, sha256 string, page_count bigint")
    lists = spark.createDataFrame([(SAMPLES,)], "s string").select(F.try_parse_json("s").alias("v"))
    files = spark.createDataFrame([("1.png",), ("2.png",)], "path string")
    own = releases.samples(lists)
    return releases.record_findings(records, actual).unionByName(releases.sample_findings(own, files, 5, own.where("pos > 0")))


def _paths() -> list[tuple[str, str, bool]]:
    rows = {(p, True) for p in (".agents", ".agents/skills", ".agents/skills/edit", "book-raw", "book-markdown", "book-markdown/chapters", "book-markdown/images", "book-typst-zh")}
    rows |= {(p, False) for p in (".agents/skills/edit/SKILL.md", "book-raw/Scan.pdf", "book-markdown/chapters/one.md")}
    for p in (*spaces.EDITION_FOLDERS, "assets/covers/own", "assets/covers/source"):
        parts = p.split("/")
        rows |= {("book-typst-zh/" + "/".join(parts[:k]), True) for k in range(1, len(parts) + 1)}
    rows |= {(f"book-typst-zh/{p}", False) for p in spaces.EDITION_FILES}
    return [("book", p, d) for p, d in sorted(rows)]


def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on a workspace with a few faults."""
    faults = [("book", "book-typst-zh/raw", True), ("book", "Notes", True), ("book", "book-raw/x.typ", False), ("book", "book-typst-zh/book/.git", True), ("book", ".gitmodules", False)]
    kept = [r for r in _paths() if r[1] != "book-typst-zh/source-map.json"] + faults
    skills = [("book", ".agents/skills/edit/SKILL.md", "---\nname: other\n---\n")]
    paths = spark.createDataFrame(kept, "workspace string, path string, is_dir boolean")
    return spaces.findings(paths, spark.createDataFrame(skills, "workspace string, path string, content string"), "zh")


def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of pages and findings on their layout."""
    wide, high = 176 * 72 / 25.4, 250 * 72 / 25.4
    docs = spark.createDataFrame([("d", False, False)], "doc string, needs_pass boolean, repaired boolean")
    pages = spark.createDataFrame([("d", k, wide, high if k != 4 else high + 1, t) for k, t in ((1, "cover"), (2, "NOT FOR RELEASE"), (3, "body"), (4, "more"))], "doc string, page int, width double, height double, text string")
    words = spark.createDataFrame([("d", 3, -1.0, 5.0, 9.0, 9.0, "out"), ("d", 4, 1.0, 5.0, 9.0, 9.0, "in")], "doc string, page int, x0 double, y0 double, x1 double, y1 double, word string")
    fonts = spark.createDataFrame([("d", 3, 7, "F", False), ("d", 4, 7, "F", False), ("d", 4, 8, "G", True)], "doc string, page int, xref int, name string, embedded boolean")
    marks = spark.createDataFrame([("d", 3, 1, "opener", "One")], "doc string, page int, seq int, role string, running string")
    found = layout.page_findings(docs, pages, words, fonts)
    roles = layout.roles(pages, marks).select(F.lit("role").alias("check"), F.lit("PASS").alias("severity"), F.concat_ws(" p. ", "doc", "page").alias("subject"), F.col("role").alias("detail"))
    return found.unionByName(roles)


def article_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's post by the three stages."""
    own = posts.posts(spark.createDataFrame(POSTS, "path string, content string")).select(F.col("id").alias("post"), F.col("id").cast("int").alias("pos"), "title", "body")
    articles = posts.articles(spark.createDataFrame(ARTICLES, "path string, content string")).select(F.col("file").alias("article"), "title", "body")
    return match.find(articles, own)


def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's posts from its sitemap index, feed and listing pages."""
    page = lambda *links: "".join(f'<a class="x" href="{u}"><span>{t}</span></a>' for u, t in links)
    rows = [
        ("https://a.org/sitemap.xml", INDEX), ("https://a.org/s1.xml", SITEMAP), ("https://a.org/rss.xml", RSS),
        ("https://a.org/", page(("/p/1", "One, but longer"), ("/tags/x", "no"), ("https://b.org/p", "no"))),
        ("https://a.org/page/2/", page(("/p/4", " Four \n four "))), ("https://a.org/page/3/", page(("/p/4", "Four"))),
        ("https://a.org/page/4/", page(("/p/5", "never reached"))), ("https://a.org/archives/", page(("/p/6", "Six"))),
    ]
    return discover.discovered(spark.createDataFrame(rows, "url string, body string"), "https://a.org")
