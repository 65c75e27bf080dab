"""URL and link expressions; addresses that a strict parser rejects are still taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an address of a post doesn't have in its path.
LISTING_PATHS = ("link", "links", "about", "archives", "tags", "categories", "msg", "board")
NOT_A_POST = (
    r"(tag|categor|author|page/\d|archive|search|about|contact|privacy|"
    r"license|friends|links|guestbook|comment|feed|rss|atom|sitemap|"
    r"\.css|\.js|\.png|\.jpg|\.jpeg|\.gif|\.svg|\.ico|\.woff)"
)

# What counts as a link, an image and an external reference; results depend on these very patterns.
ANCHOR = r'(?s)<a[^>]+href="([^"#]+)"[^>]*>(.*?)</a>'
MARKDOWN_LINK = r"\]\((https?://[^)\s]+)\)"
MARKDOWN_IMAGE = r"!\[[^\]]*\]\((?:<([^>]+)>|([^\s)]+))"
IMAGE_TAG = r"(?i)<img\b[^>]*?\bsrc=[\"']([^\"']+)[\"'][^>]*>"
EXTERNAL = r"(?i)^[a-z][a-z\d+.-]*:"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Host with user and port; empty for relative addresses."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def site(url: Column) -> Column:
    """Scheme and authority."""
    return F.regexp_extract(url, r"^https?://[^/?#]+", 0)


def resolved(base: Column, ref: Column) -> Column:
    """Absolute and root-relative references against the site of ``base``; null for other relative ones."""
    return F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).when(ref.rlike("^//"), F.concat(scheme(base), F.lit(":"), ref)).when(
        ref.rlike("^/"), F.concat(site(base), without_dots(path(ref)), _tail(ref))
    )


def _tail(ref: Column) -> Column:
    """Query and fragment of a relative reference."""
    return F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)


def without_dots(p: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; those that lead above the root are dropped."""
    parts = F.split(p, "/")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    last = F.element_at(parts, -1)
    whole = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    clean = F.when(F.startswith(whole, F.lit("/")), whole).otherwise(F.concat(F.lit("/"), whole))
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), clean).otherwise(p)


def joined(base: Column, ref: Column) -> Column:
    """Any reference against ``base``, an address with a host, by the rules of RFC 3986; all of it in expressions."""
    b = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    folder = F.regexp_extract(b, r"(?s)^(.*/)", 1)
    merged = F.concat(folder, F.regexp_extract(ref, r"(?s)^([^?#]*)", 1))
    whole = F.regexp_replace(base, "(?s)#.*$", "")
    relative = (
        F.when(ref == "", base)
        .when(ref.startswith("#"), F.concat(whole, ref))
        .when(ref.startswith("?"), F.concat(F.regexp_replace(whole, r"(?s)\?.*$", ""), ref))
        .otherwise(F.concat(site(base), without_dots(F.regexp_replace(merged, "/{2,}", "/")), _tail(ref)))
    )
    return F.coalesce(resolved(base, ref), relative)


def looks_like_post(url: Column, host: Column) -> Column:
    """An http address on ``host``, or without one, whose path is no listing and has no part of other kinds of pages."""
    p = F.regexp_replace(path(url), "/+$", "")
    own = authority(url).isin("") | (authority(url) == host)
    listing = "(?i)^/(" + "|".join(LISTING_PATHS) + ")$"
    return F.coalesce(scheme(url).isin("http", "https") & own & (p != "") & ~p.rlike(listing) & ~p.rlike("(?i)" + NOT_A_POST), F.lit(False))


def is_external(ref: Column) -> Column:
    return ref.rlike(EXTERNAL) | ref.startswith("/") | ref.startswith("#")


def is_markdown(name: Column) -> Column:
    return name.rlike(r"(?i)\.mdx?$")


def bare_path(ref: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_extract(ref, r"^([^?#]*)", 1)


def basename(ref: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(bare_path(ref), "/+$", ""), r"([^/]*)$", 1)


def markdown_links(text: Column) -> Column:
    """Sorted distinct http addresses of a Markdown text's links."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(1))))


def local_assets(text: Column) -> Column:
    """References of images, Markdown's first and then tags', that aren't external; in order, with repeats."""
    angled = F.regexp_extract_all(text, F.lit(MARKDOWN_IMAGE), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(MARKDOWN_IMAGE), F.lit(2))
    first = F.zip_with(angled, bare, lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b))
    return F.filter(F.concat(first, F.regexp_extract_all(text, F.lit(IMAGE_TAG), F.lit(1))), lambda r: (F.coalesce(r, F.lit("")) != "") & ~is_external(r))


def with_flat_assets(text: Column) -> Column:
    """Every local asset's reference replaced by its basename in the same folder."""
    return F.aggregate(local_assets(text), text, lambda out, ref: F.replace(out, ref, F.concat(F.lit("./"), basename(ref))))
