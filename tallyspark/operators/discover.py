"""Discovering the posts of sites: sitemaps, then feeds, then listing pages, folded in this order.

Responses are rows (asked, site, url, body): the site that was asked for, where it is now, and what its
addresses gave. Every step works on all sites at once and gives rows (asked, url, title, stage, seq);
``merged`` reduces them per address, so that the order of rows in files doesn't matter. Bodies stay where
they are: what is decided for a whole site is a row for each, joined to its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions import text, urls
from tallyspark.plans.session import materialize
from tallyspark.sources import xmlfeeds

# Where sitemaps and feeds are looked for, in this order.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/post-sitemap.xml", "/sitemap.txt")
FEED_PATHS = ("/feed", "/rss", "/rss.xml", "/atom.xml", "/index.xml", "/feed.xml", "/feed/", "/rss/")
MAX_CHILDREN, MAX_TITLE, MAX_PAGES = 20, 200, 50
#: Sites up to this count are broadcast (two addresses each), else joined by shuffle.
BROADCAST_ROWS = 100_000
SITE = ["asked", "site"]
STAGES = {"sitemap": 1, "feed": 2, "listing": 3}


def anchors(pages: DataFrame, key: str | list[str] = "url", html: str = "html") -> DataFrame:
    """key (one or several columns), base, pos, url, title of the links of each page; addresses are made absolute against the page's site.

    Titles are the links' texts without tags, white space as one space, 200 code points at most.
    """
    hrefs = F.regexp_extract_all(html, F.lit(urls.ANCHOR), F.lit(1))
    inner = F.regexp_extract_all(html, F.lit(urls.ANCHOR), F.lit(2))
    keys = [key] if isinstance(key, str) else key
    each = pages.select(*keys, urls.site(F.col("url")).alias("base"), F.posexplode(F.arrays_zip(hrefs.alias("href"), inner.alias("inner"))).alias("pos", "a"))
    title = F.substring(text.one_spaced(text.without_tags(F.col("a.inner"))), 1, MAX_TITLE)
    return each.select(*keys, "base", "pos", urls.joined(F.concat("base", F.lit("/")), F.col("a.href")).alias("link" if "url" in keys else "url"), title.alias("title"))


def post_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """url, title: addresses of posts that the pages link to on their own site, each with its longest title; the first in a tie."""
    found = anchors(pages, key, html)
    host = F.regexp_replace("base", "^https?://", "")
    posts = found.where(urls.looks_like_post(F.col("url"), host))
    return posts.groupBy("url").agg(F.max_by("title", F.struct(F.char_length("title"), -F.col(key), -F.col("pos"))).alias("title"))


def _of_site(rows: DataFrame, sites: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with what is known of their site (asked); one row for each site."""
    return rows.join(F.broadcast(sites) if sites.count() <= BROADCAST_ROWS else sites, "asked", how)


def _host() -> Column:
    return F.regexp_replace("site", "^[^:]*://", "")


def _ranked(responses: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """asked, site, rank, url, body of the responses at these paths below their site."""
    places = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat("site", F.lit(p)).alias("place")) for k, p in enumerate(paths)])
    tried = responses.select(*SITE, "url", "body", F.inline(places)).where(F.col("url") == F.col("place"))
    return tried.where("body IS NOT NULL AND body <> ''").select(*SITE, "rank", "url", "body")


def _first(rows: DataFrame) -> DataFrame:
    """Of each site the rows of the least rank that has rows."""
    least = materialize(rows.groupBy("asked").agg(F.min("rank").alias("least")), "found-ranks")
    return _of_site(rows, least).where("rank = least").drop("least")


def _at(responses: DataFrame, base: str | None) -> DataFrame:
    """Responses of one site, where they aren't of several."""
    return responses if base is None else responses.withColumns({k: F.lit(base) for k in SITE})


def from_sitemaps(responses: DataFrame, base: str | None = None) -> DataFrame:
    """Posts of each site's first sitemap that has any, its first 20 children included; without titles."""
    responses = _at(responses, base)
    keys = [*SITE, "rank"]
    entries = xmlfeeds.sitemap_entries(_ranked(responses, SITEMAP_PATHS), keys)
    kids = entries.where("is_child").withColumn("n", F.row_number().over(W.partitionBy("asked", "rank").orderBy("pos"))).where(F.col("n") <= MAX_CHILDREN)
    bodies = kids.select(*keys, "n", "loc").join(responses.select("asked", F.col("url").alias("loc"), "body"), ["asked", "loc"])
    nested = xmlfeeds.sitemap_entries(bodies.select(*keys, "n", "body"), [*keys, "n"]).where("NOT is_child")
    both = entries.where("NOT is_child").select(*keys, "loc", F.struct(F.lit(0).alias("n"), "pos").alias("order")).unionByName(
        nested.select(*keys, "loc", F.struct("n", "pos").alias("order"))
    )
    posts = _first(both.where(urls.looks_like_post(F.col("loc"), _host())))
    return posts.groupBy("asked", F.col("loc").alias("url")).agg(F.min("order").alias("o")).select(
        "asked", "url", F.lit("").alias("title"), F.lit(STAGES["sitemap"]).alias("stage"), (F.col("o.n").cast("long") * (1 << 32) + F.col("o.pos")).alias("seq")
    )


def from_feeds(responses: DataFrame, base: str | None = None) -> DataFrame:
    """Posts of each site's first feed that has entries."""
    entries = _first(xmlfeeds.feed_entries(_ranked(_at(responses, base), FEED_PATHS), [*SITE, "rank"]))
    return entries.where(urls.looks_like_post(F.col("link"), _host())).select(
        "asked", F.col("link").alias("url"), "title", F.lit(STAGES["feed"]).alias("stage"), F.col("pos").cast("long").alias("seq")
    )


def from_listings(responses: DataFrame, base: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Posts of the home page, of the pages after it until one is missing or brings nothing new (that one's titles count), and of the archive.

    A site without a home page is read from its second page on. ``known``: addresses (asked, url) that
    earlier stages have found.
    """
    responses = _at(responses, base)
    below = F.when(F.startswith("url", "site"), F.substr("url", F.length("site") + 1))
    number = F.when(below == "/", 1).when(below == "/archives/", MAX_PAGES + 1).otherwise(F.regexp_extract(below, r"^/page/(\d+)/$", 1).try_cast("int"))
    pages = responses.where("body IS NOT NULL").withColumn("page", number).where(F.col("page").between(1, MAX_PAGES + 1))
    found = anchors(pages.select(*SITE, "page", "url", F.col("body").alias("html")), [*SITE, "page"])
    posts = found.where(urls.looks_like_post(F.col("url"), _host()))
    new = posts.join(known.select("asked", "url").distinct(), ["asked", "url"], "left_anti") if known is not None else posts
    there = pages.where(F.col("page") <= MAX_PAGES).select("asked", "page").unionByName(responses.select("asked", F.lit(1).alias("page")))
    stop = materialize(stopped_at(there, new, "page", "url", ["asked"]), "found-stops")
    kept = _of_site(posts, stop).where((F.col("page") <= F.col("stop")) | (F.col("page") == MAX_PAGES + 1))
    return kept.select("asked", "url", "title", F.lit(STAGES["listing"]).alias("stage"), (F.col("page").cast("long") * (1 << 32) + F.col("pos")).alias("seq"))


def stopped_at(pages: DataFrame, found: DataFrame, page: str, item: str, by: list[str] | None = None) -> DataFrame:
    """stop, one row (or one for each ``by``): the first page after the first one that is missing or brings no new item; the page after the last if none is."""
    by = by or []
    own = pages.select(*by, page).distinct()
    brings = found.groupBy(*by, item).agg(F.min(page).alias(page)).select(*by, page).distinct()
    idle = own.where(F.col(page) > 1).join(brings, [*by, page], "left_anti")
    following = own.select(*by, (F.col(page) + 1).alias(page)).join(own, [*by, page], "left_anti")  # the page after the last is one
    return idle.unionByName(following).groupBy(*by).agg(F.min(page).alias("stop"))


def merged(found: DataFrame) -> DataFrame:
    """asked, url, title of what all stages have found, sorted by site and address.

    The sitemap's empty title stands first; each feed entry with a title replaces what is there; a
    listing's title replaces it only if it is longer, the first of equal length.
    """
    feed = F.max_by("title", F.when((F.col("stage") == STAGES["feed"]) & (F.col("title") != ""), F.col("seq")))
    listing = F.max_by("title", F.when(F.col("stage") == STAGES["listing"], F.struct(F.char_length("title"), -F.col("seq"))))
    by_url = found.groupBy("asked", "url").agg(F.coalesce(feed, F.lit("")).alias("fed"), F.coalesce(listing, F.lit("")).alias("listed"))
    title = F.when(F.char_length("listed") > F.char_length("fed"), F.col("listed")).otherwise(F.col("fed"))
    return by_url.select("asked", "url", title.alias("title")).orderBy("asked", "url")


def moved(responses: DataFrame) -> DataFrame:
    """asked, site, url, body of responses (asked, url, body, and final_url where addresses may lead elsewhere).

    A site is that of its home page's final address. Responses at the old site's addresses count by
    their final address.
    """
    responses = responses.withColumn("asked", F.regexp_replace("asked", "/+$", ""))
    if "final_url" not in responses.columns:
        return responses.select("asked", F.col("asked").alias("site"), "url", "body")
    home = F.col("url").isin(F.col("asked"), F.concat("asked", F.lit("/")))
    homes = responses.where(home).select("asked", urls.site(F.col("final_url")).alias("site")).where("site <> ''").groupBy("asked").agg(F.min("site").alias("site"))
    rows = _of_site(responses, materialize(homes, "found-homes"), "left").withColumn("site", F.coalesce("site", "asked"))
    at = F.when((F.col("site") != F.col("asked")) & (urls.site(F.col("url")) == F.col("asked")), F.coalesce("final_url", "url")).otherwise(F.col("url"))
    return rows.withColumn("url", F.when(at == F.col("site"), F.concat("site", F.lit("/"))).otherwise(at)).select(*SITE, "url", "body")


def discovered_sites(responses: DataFrame) -> DataFrame:
    """asked, url, title of the posts of all sites (asked: scheme and authority), sorted by site and address.

    Where a home page has moved to another host, all stages look for sitemaps, feeds, pages and posts
    there.
    """
    rows = moved(responses)
    early = materialize(from_sitemaps(rows).unionByName(from_feeds(rows)), "found-early")  # read twice
    return merged(early.unionByName(from_listings(rows, known=early)))


def discovered(responses: DataFrame, base: str) -> DataFrame:
    """url, title of the posts of the site at ``base``, sorted by address."""
    return discovered_sites(responses.withColumn("asked", F.lit(base))).select("url", "title")


def broken_links(docs: DataFrame, status: DataFrame) -> DataFrame:
    """url, error of the Markdown documents' distinct links that answer neither HEAD nor GET, or with 400 and above.

    status: url, head_status, get_status, error; an address without a row is not reached.
    """
    links = docs.select(F.explode(urls.markdown_links(F.col("content"))).alias("url")).distinct()
    both = links.join(status, "url", "left")
    code = F.coalesce("head_status", "get_status")
    error = F.when(code.isNull(), F.substring(F.coalesce("error", F.lit("no answer")), 1, 80)).when(code >= 400, F.concat(F.lit("HTTP "), code.cast("string")))
    return both.select("url", error.alias("error")).where("error IS NOT NULL").orderBy("url")


def link_summary(docs: DataFrame, status: DataFrame) -> DataFrame:
    """One row: distinct links checked, and broken ones."""
    checked = docs.select(F.explode(urls.markdown_links(F.col("content"))).alias("url")).agg(F.count_distinct("url").alias("checked"))
    return checked.join(F.broadcast(broken_links(docs, status).agg(F.count("*").alias("broken"))))
