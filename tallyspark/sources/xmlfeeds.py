"""Sitemaps and feeds: XML with any prefixes; a document that is no XML has no entries."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from tallyspark.plans.session import ship_code


def _local(tag: str) -> str:
    return tag[tag.rfind("}") + 1 :].lower()


def _root(body: str | None):
    try:
        return ElementTree.fromstring(body or "")
    except ElementTree.ParseError:
        return None


def read_sitemap(body: str | None) -> list[tuple[int, bool, str]]:
    """(place, whether it is another sitemap, address) of a sitemap's or a sitemap index's entries."""
    root = _root(body)
    if root is None:
        return []
    is_index = _local(root.tag) == "sitemapindex"
    texts = (leaf.text.strip() for entry in root for leaf in entry if _local(leaf.tag) == "loc" and leaf.text)
    return [(k, is_index, address) for k, address in enumerate(texts)]


def _address(leaf, atom: bool) -> str | None:
    """What a link element says: RSS has it as text, Atom as an attribute of links to the page itself."""
    if not atom:
        return leaf.text.strip() if leaf.text else None
    return leaf.get("href") if leaf.get("rel", "alternate") == "alternate" and leaf.get("href") else None


def read_feed(body: str | None) -> list[tuple[int, str, str]]:
    """(place, address, title) of a feed's entries in document order; of several links or titles the last counts."""
    root = _root(body)
    out: list[tuple[int, str, str]] = []
    for entry in root.iter() if root is not None else ():
        kind = _local(entry.tag)
        if kind not in ("item", "entry"):
            continue
        found = {"link": "", "title": ""}
        for leaf in entry:
            name = _local(leaf.tag)
            value = _address(leaf, kind == "entry") if name == "link" else leaf.text.strip() if name == "title" and leaf.text else None
            if value is not None:
                found[name] = value
        if found["link"]:
            out.append((len(out), found["link"], found["title"]))
    return out


def _expanded(rows: DataFrame, keys: list[str], read, columns: list[str], schema: str) -> DataFrame:
    ship_code(rows.sparkSession)
    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(*key, *entry) for *key, body in frame[[*keys, "body"]].itertuples(index=False) for entry in read(body)]
            yield pd.DataFrame(out, columns=[*keys, *columns])

    return rows.select(*keys, "body").mapInPandas(run, f"{kept}, {schema}")


def sitemap_entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, is_child, loc of each row's body."""
    return _expanded(rows, keys, read_sitemap, ["pos", "is_child", "loc"], "pos int, is_child boolean, loc string")


def feed_entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, link, title of each row's body."""
    return _expanded(rows, keys, read_feed, ["pos", "link", "title"], "pos int, link string, title string")
