"""Operators on small literal inputs with the edge cases that they were written for."""

import hashlib
import json
import os
from datetime import datetime

import fixtures
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import hashing, text, urls, variant
from tallyspark.operators import discover, layout, ledger, match, notes, posts, queue, reconcile, report
from tallyspark.sources import files, filetree
from tallyspark.streaming import queue as stream


def one(spark, expr, **columns):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(expr.alias("x")).first().x


C = F.col


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (lambda: text.trim(C("a")), " \tx y \n", "x y"),
        (lambda: text.one_spaced(C("a")), " a   b\n", "a b"),
        (lambda: text.folded(C("a")), None, ""),
        (lambda: text.units_utf16(C("a")), "a😀", 3),
        (lambda: text.shortened(C("a")), "é" * 111, "é" * 107 + "..."),
        (lambda: text.shortened(C("a")), "é" * 110, "é" * 110),
        (lambda: text.left_padded(C("a").cast("int")), "7", "0007"),
        (lambda: text.left_padded(C("a").cast("int")), "12345", "12345"),
        (lambda: text.quoted(C("a")), 'x"y', '"x\\"y"'),
        (lambda: text.version_of(C("a")), " v1.20.3-rc", [1, 20, 3]),
        (lambda: text.satisfies(C("a"), F.lit(">= 18.2.10")), "18.10.0", True),
        (lambda: text.satisfies(C("a"), F.lit("^18")), "18.10.0", None),
        (lambda: text.is_slug(C("a")), "a-b2-c", True),
        (lambda: text.is_slug(C("a")), "a--b", False),
        (lambda: text.is_utc_stamp(C("a")), "2026-10-01 00:00:00 UTC", True),
        (lambda: text.front_matter(C("a")), "---\r\ntitle: x\r\n---\r\nbody", "title: x"),
        (lambda: text.body(C("a")), "---\r\ntitle: x\r\n---\r\nbody", "body"),
        (lambda: text.body(C("a")), "no front matter", "no front matter"),
        (lambda: text.scalar(C("a"), "title"), "x: 1\ntitle:  'It is'  ", "It is"),
        (lambda: text.scalar(C("a"), "title"), 'title: ""', None),
        (lambda: text.tag_list(C("a")), 'tags:\n  - "a b"\n  - c\nx: 1', ["a b", "c"]),
        (lambda: text.body_lines(C("a")), "short\n# a heading line\n[link line here]\n  a body line  \na body line\nsmile 😀😀😀", ["a body line", "smile 😀😀😀"]),
        (lambda: text.first_prose_line(C("a")), "# h\n> quote\n<br>\n\n real line", "real line"),
        (lambda: text.description(F.lit(None).cast("string"), C("a"), F.lit("T")), "short", "T - 笔记"),
        (lambda: text.owner_and_name(C("a")), "git@host:owner/name.git", "owner/name"),
        (lambda: text.owner_and_name(C("a")), "https://github.com/owner/name/", "owner/name"),
        (lambda: urls.authority(C("a")), "http://u@h:81/p?q", "u@h:81"),
        (lambda: urls.path(C("a")), "http://h/a b/c?x#y", "/a b/c"),
        (lambda: urls.joined(F.lit("https://h/d/"), C("a")), "../x", "https://h/x"),
        (lambda: urls.joined(F.lit("https://h/d/"), C("a")), "/x", "https://h/x"),
        (lambda: urls.looks_like_post(C("a"), F.lit("h")), "https://h/heritage", False),
        (lambda: urls.looks_like_post(C("a"), F.lit("h")), "https://h/p/one/", True),
        (lambda: urls.looks_like_post(C("a"), F.lit("h")), "https://h:80/p/one/", False),
        (lambda: urls.looks_like_post(C("a"), F.lit("h")), "https://h//", False),
        (lambda: urls.looks_like_post(C("a"), F.lit("h")), "ftp://h/p", False),
        (lambda: urls.looks_like_post(C("a"), F.lit("h")), "https://h/LINKS/", False),
        (lambda: urls.looks_like_post(C("a"), F.lit("h")), None, False),
        (lambda: urls.markdown_links(C("a")), "[b](http://b/x) [a](http://a) ![i](http://b/x) [r](rel)", ["http://a", "http://b/x"]),
        (lambda: urls.local_assets(C("a")), "![x](<a b.png>) ![y](c.png?v=1) ![z](https://h/d.png) <img src='e.png'>", ["a b.png", "c.png?v=1", "e.png"]),
        (lambda: urls.with_flat_assets(C("a")), "![x](d/a.png) <img src='e/b.png'>", "![x](./a.png) <img src='./b.png'>"),
        (lambda: urls.basename(C("a")), "d/e.png?x#y", "e.png"),
        (lambda: hashing.is_sha256(C("a")), "A" * 64, False),
        (lambda: hashing.is_sha256(C("a")), None, False),
        (lambda: hashing.mime_type(C("a")), "x.JPG", "image/jpeg"),
        (lambda: hashing.latin_named(C("a")), "aé中Ａ5 ٣", 4),
        (lambda: variant.parsed(C("a")).isNull(), '{"a": 1}\n{"a": 2}', True),
        (lambda: variant.parsed(C("a")).isNull(), '1], [2', True),
        (lambda: variant.parsed(C("a")).isNull(), '1}, {"v": 2', True),
        (lambda: variant.parsed(C("a")).isNull(), "1, 2", True),
        (lambda: variant.parsed(C("a")).isNull(), " [1] ", False),
        (lambda: variant.parsed(C("a")).isNull(), "", True),
        (lambda: variant.as_integer(variant.parsed(C("a"))), "2.9", 2),
        (lambda: variant.as_integer(variant.parsed(C("a"))), "-2.9", -2),
        (lambda: variant.as_integer(variant.parsed(C("a"))), "true", 1),
        (lambda: variant.as_integer(variant.parsed(C("a"))), '" 1_2 "', 12),
        (lambda: variant.as_integer(variant.parsed(C("a"))), '"3.7"', None),
        (lambda: variant.has(variant.parsed(C("a")), "k"), '{"k": null}', True),
        (lambda: variant.has(variant.parsed(C("a")), "k"), '{"j": 1}', False),
        (lambda: variant.is_missing(variant.at(variant.parsed(C("a")), "k")), '{"k": ""}', True),
    ],
)
def test_expressions(spark, expr, value, want):
    assert one(spark, expr(), a=value) == want


def test_moments(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1, 20, 0),)], "t timestamp").select(text.zoned_iso(F.col("t")).alias("x"))
    assert df.first().x == "2026-01-02T04:00:00+08:00"


def found(df):
    return {(r["check"], r.subject) for r in df.collect()}


def test_ledgers(spark):
    rows = {(r.path, r.record_no): (r.page, r.error) for r in fixtures.page_ledger(spark, "").collect()}
    assert rows == {
        ("list.json", 1): (1, None), ("list.json", 2): (2, None), ("list.json", 3): (2, None), ("list.json", 4): (1, None),
        ("object.json", 1): (12, None), ("object.json", 2): (None, "page is no integer"), ("object.json", 3): (None, "page is no integer"),
        ("lines.jsonl", 1): (1, None), ("lines.jsonl", 3): (5, None), ("lines.jsonl", 4): (None, "invalid JSON"),
        ("one.jsonl", None): (None, "no list of records"), ("empty.json", None): (None, "empty"),
    }
    own = spark.createDataFrame([(1, "ok"), (2, " Needs-Review "), (2, None), (9, "done")], "page int, status string")
    assert found(ledger.findings(spark, own, 3)) == {("missing page", "3"), ("repeated page", "2"), ("page out of range", "9"), ("open page", "2")}
    summary = ledger.summary(spark, own, 3).first()
    assert (summary.records, summary.covered_pages, summary.missing_pages, summary.unresolved_pages) == (4, 2, [3], [2])
    assert report.verdict(ledger.findings(spark, own.where("page = 1"), 1)).first().asDict() == {"status": "PASS", "exit_code": 0}


def test_manifests(spark):
    assert found(fixtures.manifest(spark, "")) == {
        ("chapter is no object", "4"), ("chapter without source", "3"), ("chapter without output", "3"), ("source file missing", "gone.md"),
        ("source hash missing or malformed", "gone.md"), ("source hash differs", "a.md"), ("output file missing", "book/b.typ"), ("source not in manifest", "new.md"),
        ("manifest names a file that is no source", "gone.md"), ("image of no size", "assets/figures/x.png"), ("image file missing", "assets/figures/no.png"),
        ("image without integer size", "assets/figures/no.png"), ("figure not in manifest", "assets/figures/y.png"),
    }


def test_generated_texts_and_logs(spark):
    from tallyspark.operators import manifest

    own = spark.createDataFrame([("a.typ", "x TO-SETTLE y"), ("b.typ", "TODO XTO-SETTLEX"), ("build/c.typ", "TO-SETTLE")], "path string, content string")
    assert found(manifest.text_findings(own, mark="TO-SETTLE")) == {("unresolved mark", "a.typ")}
    assert found(manifest.text_findings(own.where("path = 'x'"))) == {("no generated text", "book")}
    logs = spark.createDataFrame([("a", "\n \t\n"), ("b", "warning: x\n\nmore"), ("c", None)], "path string, content string")
    assert found(manifest.log_findings(logs)) == {("compile diagnostics", "b"), ("log missing", "c")}


def test_releases(spark):
    assert found(fixtures.release(spark, "")) == {
        ("field missing", "r.json"), ("hash differs", "r.json"), ("page count differs", "r.json"), ("sample field missing", "4"), ("sample file missing", "3.png"),
        ("page below 1", "2.png"), ("page beyond the end", "3.png"), ("code sample without treatment", "2.png"), ("repeated sample", "1.png"),
        ("report differs from manifest", "0"), ("report differs from manifest", "1"), ("report differs from manifest", "2"), ("report differs from manifest", "3"),
    }


def test_workspaces(spark):
    from tallyspark.operators import workspace

    assert found(fixtures.workspace(spark, "")) == {
        ("file missing", "book: book-typst-zh/source-map.json"), ("typeset file in raw folder", "book: book-raw/x.typ"), ("skill named otherwise", "book: .agents/skills/edit/SKILL.md"),
        ("unexpected entry in workspace", "book: Notes"), ("unexpected entry in workspace", "book: .gitmodules"), ("unexpected entry in edition", "book: book-typst-zh/raw"),
        ("forbidden entry in edition", "book: book-typst-zh/raw"), ("nested repository", "book: book-typst-zh/book/.git"), ("nested repository", "book: .gitmodules"), ("upper case in path", "book: Notes"),
    }
    skills = spark.createDataFrame([("book", ".agents/skills/edit/SKILL.md", "---\nname: edit\n---\n")], "workspace string, path string, content string")
    paths = spark.createDataFrame(fixtures._paths(), "workspace string, path string, is_dir boolean")
    assert found(workspace.findings(paths, skills, "zh")) == set()
    missing = found(workspace.findings(paths, skills, "en"))
    assert ("folder missing", "book: book-typst-en") in missing and ("file missing", "book: book-typst-en/book.toml") not in missing
    other = {s for c, s in found(workspace.findings(paths, skills, "zh", covers=("else",))) if c == "folder missing"}
    assert other == {"book: book-typst-zh/assets/covers/else"}
    bare = spark.createDataFrame([("My", "x", False)], "workspace string, path string, is_dir boolean")
    assert ("workspace name", "My") in found(workspace.findings(bare, skills, "en"))


def test_layout(spark):
    rows = {(r["check"], r.subject, r.detail) for r in fixtures.page_layout(spark, "").collect()}
    assert {x[:2] for x in rows if x[0] != "role"} == {("unexpected trim", "d p. 4"), ("fixture artwork", "d p. 2"), ("text out of bounds", "d p. 3"), ("font not embedded", "d p. 3")}
    assert {x[1:] for x in rows if x[0] == "role"} == {("d p. 1", "front"), ("d p. 2", "front"), ("d p. 3", "opener"), ("d p. 4", "body")}
    spans = spark.createDataFrame([("d", 1, "SourceHanSans", 9.0, [0.0], list("中é1")), ("d", 1, "Serif", 9.0, [0.0], list("ab "))], "doc string, page int, font string, size double, bbox array<double>, chars array<string>")
    assert {(r.font, r.latin) for r in layout.latin_by_font(spans).collect()} == {("SourceHanSans", 2), ("Serif", 2)}
    assert [(r.font, r.latin) for r in layout.mixed_fonts(spans).collect()] == [("SourceHanSans", 2)]


def test_template_pages(spark):
    mm = 72 / 25.4
    wide, high = 176 * mm, 250 * mm
    texts = {1: "cover", 2: "back", 3: "CHAPTER 1", 4: "body 4", 5: "body 5", 6: "CHAPTER 2"}
    pages = spark.createDataFrame([("d", k, wide, high, t) for k, t in texts.items()], "doc string, page int, width double, height double, text string")
    words = spark.createDataFrame([("d", 4, 16 * mm, 40.0, 30.0, 50.0, "4"), ("d", 5, 100.0, 40.0, 200.0, 50.0, "5")], "doc string, page int, x0 double, y0 double, x1 double, y1 double, word string")
    drawings = spark.createDataFrame([("d", 4, 16 * mm, 55.0, wide - 19 * mm, 56.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    assert found(layout.template_findings(pages, words, drawings)) == {("chapter on an even page", "d p. 6"), ("folio is not outside", "d p. 5"), ("no mirrored rule", "d p. 5")}


def test_matching(spark):
    rows = {r.article: (r.post, r.how) for r in fixtures.article_match(spark, "").collect()}
    assert rows == {"in/one.md": ("0205", "title-exact"), "in/two.md": ("0300", "title-partial"), "in/three.mdx": ("0300", "body-similarity(0.50)"), "in/four.md": (None, "none")}
    titles = spark.createDataFrame([("a", "abc"), ("b", "xabcx"), ("c", ""), ("d", "zz"), ("e", "an old title here"), ("f", "old  title"), ("g", "what x yy z is")], "article string, title string")
    others = spark.createDataFrame([("p", 1, "abc d"), ("q", 2, "bc"), ("r", 3, "zz"), ("s", 4, "old title her"), ("t", 5, "an old  title, see"), ("u", 6, "x yy z")], "post string, pos int, title string")
    small = {(r.article, r.post) for r in match.partial(titles, others).collect()}
    match.BROADCAST_ROWS, kept = 0, match.BROADCAST_ROWS
    try:
        large = {(r.article, r.post) for r in match.partial(titles, others).collect()}
    finally:
        match.BROADCAST_ROWS = kept
    assert small == large == {("a", "p"), ("b", "q"), ("c", "p"), ("d", "r"), ("e", "s"), ("f", "t"), ("g", "u")}
    plan = match.partial(titles, others)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert match.next_id(ids("0300", "0205"), ids("0301")).first().next_id == "0302"
    assert match.next_id(ids(), ids()).first().next_id == "0001"
    assert match.next_id(ids("0007", "draft", None)).first().next_id == "0008"


def test_posts_are_written_and_updated(spark):
    article = spark.createDataFrame([("in/a.md", 'A "title"', "![x](d/p.png)\nA line of prose for it.\n", "notes", ["t"], None)], "file string, title string, body string, area string, tags array<string>, description string")
    moment = F.lit("2026-01-01 00:00:00").cast("timestamp")
    new = posts.rendered(article, F.lit("0007"), moment, draft=True).first().content
    assert new == (
        '---\nlang: "zh-CN"\npubDatetime: 2026-01-01T08:00:00+08:00\ntimezone: "Asia/Shanghai"\ntitle: "A \\"title\\""\narea: "notes"\nfeatured: false\ndraft: true\ntags:\n  - "t"\n'
        'description: "A line of prose for it."\n---\n![x](./p.png)\nA line of prose for it.\n'
    )
    pair = spark.createDataFrame([("0007", new, "New", True, "other", None, "\nbody\n")], "post string, raw string, title string, has_title boolean, area string, description string, body string")
    once = posts.updated(pair, moment)
    twice = posts.updated(once.join(pair.drop("raw"), "post").withColumnRenamed("content", "raw"), moment)
    out = once.first().content
    assert out.count("modDatetime") == 1 and 'title: "New"' in out and 'area: "other"' in out and out.endswith("---\n\nbody\n")
    assert twice.first().content == out
    refs = spark.createDataFrame([("f", "a/x.png", "/a/x.png"), ("f", "b/x.png", "/b/x.png"), ("f", "a/x.png?1", "/a/x.png"), ("g", "x.png", "/x.png")], "file string, ref string, resolved string")
    assert [(r.file, r.base) for r in posts.asset_collisions(refs).collect()] == [("f", "x.png")]


def test_discovery(spark):
    assert [tuple(r) for r in fixtures.discovery(spark, "").collect()] == [
        ("https://a.org/p/1", "One, but longer"), ("https://a.org/p/2", ""), ("https://a.org/p/4", "Four four"), ("https://a.org/p/6", "Six"),
    ]
    docs = spark.createDataFrame([("d", "[a](http://a/1) [b](http://b/2) [c](http://c/3) [a](http://a/1)")], "path string, content string")
    status = spark.createDataFrame([("http://a/1", 200, None, None), ("http://b/2", None, 404, None), ("http://c/3", None, None, "refused")], "url string, head_status int, get_status int, error string")
    assert [tuple(r) for r in discover.broken_links(docs, status).collect()] == [("http://b/2", "HTTP 404"), ("http://c/3", "refused")]
    assert discover.link_summary(docs, status).first().asDict() == {"checked": 3, "broken": 2}


def test_more_than_twenty_child_sitemaps(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.org/s{k}.xml</loc></sitemap>" for k in range(21)) + "</sitemapindex>"
    rows = [("https://a.org/sitemap.xml", index)] + [(f"https://a.org/s{k}.xml", f"<urlset><url><loc>https://a.org/p/{k}</loc></url></urlset>") for k in range(21)]
    found_ = discover.from_sitemaps(spark.createDataFrame(rows, "url string, body string"), "https://a.org").collect()
    assert {r.url for r in found_} == {f"https://a.org/p/{k}" for k in range(20)}


def test_fetching(spark):
    links = spark.createDataFrame([("http://a",), ("http://a",), ("http://b",)], "url string")

    def get(url):
        if url.endswith("b"):
            raise OSError("down")
        return url + "/", 200, b"caf\xe9"

    rows = {r.url: (r.final_url, r.status, r.body, r.error) for r in files.fetched(links, get).collect()}
    assert rows == {"http://a": ("http://a/", 200, "caf�", None), "http://b": ("http://b", None, None, "down")}

    def head(url):
        raise OSError("no HEAD")

    probes = {r.url: (r.head_status, r.get_status, r.error) for r in files.probed(links, head, lambda u: get(u)[1]).collect()}
    assert probes == {"http://a": (None, 200, None), "http://b": (None, None, "down")}


def test_pdf_markers(spark):
    raw = b"<</Count 2>> <</Count 7>> /ToUnicode BT x Tj"
    assert files.pdf_markers(raw) == (7, True, True) and files.pdf_markers(b"") == (0, False, False) and files.pdf_markers(b"/Count 3 Tjx") == (3, False, False)
    row = files.pdf_pages(spark.createDataFrame([("a.pdf", bytearray(raw))], "path string, content binary")).first()
    assert (row.page_count, row.searchable) == (7, True)


def test_queue_fold(spark):
    commands = spark.createDataFrame(fixtures.COMMANDS, fixtures.COMMAND)
    decided = {r.seq: r.outcome for r in queue.posts(commands, fixtures.PARTIES).collect()}
    assert decided == {1: "created", 2: "repeat", 3: "conflict", 8: "created", 9: "no such parent", 10: "blank body", 11: "invalid id", 13: "created"}
    stored = queue.messages(commands, fixtures.PARTIES)
    times = {r.id: (r.received_at, r.ack_at) for r in stored.collect()}
    assert times == {"m1": (4.0, 6.0), "m2": (12.0, 12.0), "m5": (None, None)}
    log = sorted((r.message_id, r.event) for r in queue.events(commands, fixtures.PARTIES).collect())
    assert log == [("m1", "acknowledged"), ("m1", "posted"), ("m1", "received"), ("m2", "acknowledged"), ("m2", "posted"), ("m2", "received"), ("m5", "posted")]
    assert found(queue.refused_acks(commands, fixtures.PARTIES)) == {("ack refused", "m1")}
    assert [r.id for r in queue.pending(stored, "b").collect()] == ["m5"]
    assert {(r.recipient, r.pending) for r in queue.unacknowledged(stored).collect()} == {("b", 1)}
    for limit in (0, 101):
        with pytest.raises(ValueError):
            queue.pending(stored, "b", limit)


def test_queue_takes_all_of_many_writers(spark):
    rows = [(k, "post", f"w{k % 4}-{k // 4}", "a", "b", "message", str(k), None, float(k)) for k in range(96)]
    shuffled = spark.createDataFrame(rows[::-1], fixtures.COMMAND).repartition(5)
    stored = queue.messages(shuffled, fixtures.PARTIES).collect()
    assert len(stored) == 96 and len({r.seq for r in stored}) == 96


def test_queue_stream_equals_fold(spark):
    commands = spark.createDataFrame(fixtures.COMMANDS, fixtures.COMMAND)
    want = {r.seq: r.outcome for r in queue.outcomes(commands, fixtures.PARTIES).collect()}
    assert want == {
        1: "created", 2: "repeat", 3: "conflict", 4: "received", 5: "refused", 6: "acknowledged", 7: "again", 8: "created", 9: "no such parent",
        10: "blank body", 11: "invalid id", 12: "acknowledged", 13: "created",
    }
    store = fixtures.queue_stream(spark, [commands.where("seq <= 5"), commands.where("seq > 5")])
    assert {r.seq: r.outcome for r in store.outcomes().collect()} == want
    columns = fixtures.queue_fold(spark, "").columns
    assert sorted(map(str, store.messages().select(*columns).collect())) == sorted(map(str, fixtures.queue_fold(spark, "").collect()))
    # A batch that is run again leaves what it left.
    store.apply(commands.where("seq > 5"), 1)
    assert {r.seq: r.outcome for r in store.outcomes().collect()} == want and store.outcomes().count() == len(want)


class PlainQueue:
    """The queue run command by command."""

    def __init__(self, parties):
        self.parties, self.messages = set(parties), {}

    def run(self, seq, op, id_, actor, peer, kind, body, reply_to, ts):
        import re

        if op == "post":
            if actor == peer or {actor, peer} != self.parties:
                return "parties"
            if not (body or "").strip():
                return "blank body"
            if not re.fullmatch(r"[a-zA-Z0-9_.-]{1,120}", id_ or ""):
                return "invalid id"
            if id_ in self.messages:
                return "repeat" if self.messages[id_]["content"] == (actor, peer, kind, body, reply_to) else "conflict"
            if reply_to:
                parent = self.messages.get(reply_to)
                if parent is None or parent["content"][:2] != (peer, actor):
                    return "no such parent"
            self.messages[id_] = {"content": (actor, peer, kind, body, reply_to), "received": None, "ack": None}
            return "created"
        m = self.messages.get(id_)
        if m is None or m["content"][1] != actor:
            return "refused"
        if op == "ack":
            if m["ack"] is not None:
                return "again"
            m["ack"] = ts
            m["received"] = m["received"] if m["received"] is not None else ts
            return "acknowledged"
        if m["received"] is not None:
            return "acknowledged before" if m["ack"] is not None else "read again"
        m["received"] = ts
        return "received"


def random_commands(n, ids, seed):
    import random

    r = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        op = r.choice(["post", "post", "post", "receive", "ack"])
        actor = r.choice("ab")
        id_ = f"m{r.randrange(ids)}" if r.random() < 0.97 else r.choice(["no id!", None])
        if op != "post":
            rows.append((seq, op, id_, actor, None, None, None, None, float(seq)))
            continue
        peer = {"a": "b", "b": "a"}[actor] if r.random() < 0.95 else r.choice(["a", "c"])
        reply = f"m{r.randrange(ids)}" if r.random() < 0.6 else r.choice([None, None, ""])
        rows.append((seq, op, id_, actor, peer, r.choice(["task", "message"]), r.choice(["x", "y", " "]) if r.random() < 0.9 else None, reply, float(seq)))
    return rows


def test_queue_equals_a_plain_one(spark):
    """A random log of 10,000 commands, with chains, refusals and later posts of refused ids: as a fold and as a stream."""
    rows = random_commands(10_000, 1500, 7)
    plain = PlainQueue(fixtures.PARTIES)
    want = {r[0]: plain.run(*r) for r in rows}
    assert len(set(want.values())) == 13
    commands = spark.createDataFrame(rows, fixtures.COMMAND)
    assert {r.seq: r.outcome for r in queue.outcomes(commands, fixtures.PARTIES).collect()} == want
    times = {k: (m["received"], m["ack"]) for k, m in plain.messages.items()}
    assert {r.id: (r.received_at, r.ack_at) for r in queue.messages(commands, fixtures.PARTIES).collect()} == times
    store = fixtures.queue_stream(spark, [commands.where("seq <= 3333"), commands.where("seq > 3333")])
    assert {r.seq: r.outcome for r in store.outcomes().collect()} == want
    assert {r.id: (r.received_at, r.ack_at) for r in store.messages().collect()} == times


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rows = [(k, "post", f"m{k}", "ab"[k % 2], "ba"[k % 2], "task", "x", f"m{k - 1}" if k else None, float(k)) for k in range(300)]
    made = []
    plain = queue.materialize
    monkeypatch.setattr(queue, "materialize", lambda df, label: (made.append(label), plain(df, label))[1])
    found = queue.posts(spark.createDataFrame(rows, fixtures.COMMAND), fixtures.PARTIES).collect()
    assert {r.outcome for r in found} == {"created"} and len(found) == 300 and len(made) <= 14


def test_latin_characters_are_those_that_have_it_in_their_names(spark):
    import unicodedata

    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    rows = spark.createDataFrame([(c,) for c in every], "c string").select("c", hashing.latin_named(C("c")).alias("n"))
    assert {r.c for r in rows.where("n = 1").collect()} == {c for c in every if c in "0123456789" or "LATIN" in unicodedata.name(c, "")}
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert one(spark, hashing.latin_named(C("a")), a=None) == 0


def test_canonical_json(spark):
    import json
    import random

    r = random.Random(4)

    def value(depth):
        kind = r.randrange(7 if depth else 5)
        if kind < 5:
            return [None, r.random() < 0.5, r.randrange(-(10**12), 10**12), "".join(r.choice('ab"\\\n\x1f\x0b\x7fé中😀/u001F') for _ in range(r.randrange(6))), r.randrange(1, 1000, 2) / 2**r.randrange(1, 4)][kind]
        if kind == 5:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        return {"".join(r.choice("abéB_") for _ in range(r.randrange(4))): value(depth - 1) for _ in range(r.randrange(5))}

    texts = [json.dumps(value(4), ensure_ascii=r.random() < 0.5) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.canonical_json(F.parse_json("t")).alias("c")).collect()
    assert all(x.c == json.dumps(json.loads(x.t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in rows)


def contested(n):
    """A chain in which the first post of each link, and of some the second one, doesn't fit."""
    rows, seq = [], 0

    def post(k, actor, peer, reply):
        nonlocal seq
        seq += 1
        rows.append((seq, "post", f"m{k}", actor, peer, "task", "x", reply, float(seq)))

    for k in range(n):
        a, b = "ab"[k % 2], "ba"[k % 2]
        up = f"m{k - 1}" if k else None
        if k:
            post(k, b, a, up)  # in the wrong direction
            if k % 7 == 3:
                post(k, b, a, up)
        if k % 50 != 49:
            post(k, a, b, up)
        if k % 50 == 49:
            post(k, a, b, None)  # a second one that answers nothing
        if k % 11 == 5:
            post(k, a, b, up)
    return rows


def test_contested_chains_take_few_rounds(spark, monkeypatch):
    rows = contested(1000)
    plain = PlainQueue(fixtures.PARTIES)
    want = {r[0]: plain.run(*r) for r in rows}
    assert len(set(want.values())) > 2
    made = []
    real = queue.materialize
    monkeypatch.setattr(queue, "materialize", lambda df, label: (made.append(label), real(df, label))[1])
    found = queue.posts(spark.createDataFrame(rows, fixtures.COMMAND), fixtures.PARTIES).collect()
    assert {r.seq: r.outcome for r in found} == want
    assert made.count("queue-tables") <= 12 and len(made) <= 40


def test_waiting(spark, monkeypatch):
    monkeypatch.setattr(queue, "STEP", 0.01)
    looks = []

    def stored():
        looks.append(1)
        return spark.createDataFrame([(1, "b", None)] if len(looks) > 2 else [], "seq bigint, recipient string, ack_at double")

    assert [r.seq for r in queue.wait(stored, "b", 30)] == [1] and len(looks) == 3
    assert queue.wait(stored, "a", 0) == []
    with pytest.raises(ValueError):
        queue.wait(stored, "a", 61)


def test_references_are_joined_as_the_standard_has_it(spark):
    from urllib.parse import urljoin

    refs = ["", "x", "x/", "./x", "../x", "../../x", "/", "/a/../b", "/a/./b/..", "/a/..", "?q=1", "#f", "x?q#f", "a/../../b/./c", ".", "..", "//o.org/x", "https://o.org/a/../b", "mailto:me", "/a//b", "a//b", "x;p=1", "/..", "./", "a/.."]
    for base in ("https://h.org/", "https://h.org/d/e", "https://h.org/d/e/?q#f", "https://h.org"):
        rows = spark.createDataFrame([(base, r) for r in refs], "base string, ref string").select("ref", urls.joined(C("base"), C("ref")).alias("x")).collect()
        assert {r.ref: r.x for r in rows} == {r: urljoin(base, r) for r in refs}
    plan = spark.createDataFrame([("x",)], "ref string").select(urls.joined(F.lit("https://h.org/"), C("ref")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_places_without_gaps(spark):
    rows = spark.createDataFrame([(k * k, str(k)) for k in range(50)], "pos bigint, v string")
    got = reconcile.numbered(rows, "pos", run=100).orderBy("pos").collect()
    assert [(r.pos, r.v) for r in got] == [(k, str(k)) for k in range(50)]


def test_findings_need_few_passes(spark):
    """Rules of one table are looked at together, whatever their number."""
    from tallyspark.operators import manifest, workspace

    paths = spark.createDataFrame(fixtures._paths(), "workspace string, path string, is_dir boolean")
    skills = spark.createDataFrame([], "workspace string, path string, content string")
    plan = workspace.findings(paths, skills, "zh")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 5
    v = manifest.objects(spark.createDataFrame([("m", fixtures.MANIFEST)], "path string, content string"))
    files = spark.createDataFrame([], "path string, kind string, sha256 string")
    plan = manifest.chapter_findings(v, files, files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") <= 2


def test_a_moved_site(spark):
    page = '<a href="/p/1">One</a>'
    rows = [("https://old.org/", "https://new.org/", page), ("https://old.org/page/2/", "https://new.org/page/2/", '<a href="/p/2">Two</a>'), ("https://new.org/rss.xml", "https://new.org/rss.xml", "<rss><item><link>https://new.org/p/3</link></item></rss>")]
    responses = spark.createDataFrame(rows, "url string, final_url string, body string")
    assert [r.url for r in discover.discovered(responses, "https://old.org/").collect()] == ["https://new.org/p/1", "https://new.org/p/2", "https://new.org/p/3"]
    assert [r.url for r in discover.discovered(responses.drop("final_url"), "https://old.org").collect()] == ["https://old.org/p/1", "https://old.org/p/2"]


def test_listings_end_where_a_page_is_missing_or_idle(spark):
    page = lambda *links: "".join(f'<a href="/p/{n}">{t}</a>' for n, t in links)
    rows = [
        ("a", "/", page((1, "One"))), ("a", "/page/2/", page((1, "One, longer"))), ("a", "/page/3/", page((3, "Three"))),  # the idle page's title counts
        ("b", "/page/2/", page((2, "Two"))), ("b", "/page/3/", page((3, "Three"))), ("b", "/page/5/", page((5, "Five"))),  # no home page
        ("c", "/page/3/", page((3, "Three"))), ("c", "/archives/", page((9, "Nine"))),  # nor a second one
        ("d", "/page/3/", None),
    ]
    responses = spark.createDataFrame([(f"https://{s}.org/", f"https://{s}.org{p}", b) for s, p, b in rows], "asked string, url string, body string")
    want = [("a", 1, "One, longer"), ("b", 2, "Two"), ("b", 3, "Three"), ("c", 9, "Nine")]
    for bound in (discover.BROADCAST_ROWS, 0):
        kept, discover.BROADCAST_ROWS = discover.BROADCAST_ROWS, bound
        try:
            got = discover.discovered_sites(responses).collect()
        finally:
            discover.BROADCAST_ROWS = kept
        assert [tuple(r) for r in got] == [(f"https://{s}.org", f"https://{s}.org/p/{n}", t) for s, n, t in want]


def test_cjk_runs(spark):
    assert one(spark, text.cjk_runs(C("a")), a="ab 中文，好 x“y” Ａ１（é") == ["中文，好", "“", "”", "（"]


def test_jobs_and_events(spark):
    bodies = [
        (1, '{"data": [{"task_id": "t", "status": "submitted"}]}'), (2, '{"data": {"task_id": "t", "status": "processing"}}'), (3, "garbage"),
        (4, '{"id": "t", "status": "completed", "result": {"images": [{"url": ["http://i/1"]}, {"url": "http://i/2"}, {}]}}'), (5, '{"id": "t", "status": "failed"}'),
        (6, '{"id": "u", "status": "failed", "error": {"message": "no"}}'),
    ]
    states = stream.job_states(spark.createDataFrame(bodies, "seq bigint, body string"))
    rows = {r.task_id: (r.state, r.images, r.error) for r in stream.job_results(states).collect()}
    assert rows == {"t": ("completed", ["http://i/1", "http://i/2"], None), "u": ("failed", None, "no")}
    lines = spark.createDataFrame([(1, '{"type": "x"}'), (2, ""), (3, '{"type": "new.kind"}'), (4, '{"type": "re')], "seq int, value string")
    assert [(r.seq, r.type, r.problem) for r in stream.cli_events(lines).orderBy("seq").collect()] == [(1, "x", None), (3, "new.kind", None), (4, None, "no JSON, perhaps cut off")]


def test_file_tree(spark):
    root = fixtures._tree()
    tree = filetree.read(spark, root)
    rows = {r.path: (r.kind, r.sha256, r.target) for r in tree.collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert rows == {".hidden": ("file", sha(b"h"), None), "_x": ("dir", None, None), "_x/a.txt": ("file", sha(b"a"), None), "b.md": ("file", sha(b"b\n"), None), "link": ("symlink", None, "b.md")}
    lines = []
    for path in sorted(p for p in rows if rows[p][0] != "dir"):
        kind, digest, target = rows[path]
        mode = oct(os.lstat(os.path.join(root, path)).st_mode & 0o7777)
        lines.append(json.dumps({"kind": kind, "mode": mode, "path": path} | ({"sha256": digest} if digest else {"target": target}), ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    assert filetree.fingerprints(tree).first().fingerprint == sha("".join(x + "\n" for x in lines).encode())
    assert {r.path for r in filetree.with_ending(tree, ".TXT", ".md", skipped=("_x",)).collect()} == {"b.md"}


def test_notes(spark):
    pages = spark.createDataFrame([(1, "aab ab"), (2, "x")], "page int, text string")
    fixes = spark.createDataFrame([("1", 1, "aab", "A", "accepted"), ("2", 1, "ab", "B", "accepted"), ("3", 9, "x", "y", "accepted")], "id string, page int, before string, after string, status string")
    assert {(r.id, r.found, r.applicable) for r in notes.applicable(fixes, pages).collect()} == {("1", 1, True), ("2", 2, False), ("3", 0, False)}
    assert {r.page: r.text for r in notes.applied(fixes, pages).collect()} == {1: "A ab", 2: "x"}
    pet = spark.createDataFrame([(1, "a cat and a dog"), (2, "ab")], "page int, text string")
    swaps = [("1", 1, "cat", "dog dog", "accepted"), ("2", 1, "dog", "pig", "accepted"), ("3", 2, "a", "", "accepted"), ("4", 2, "ab", "x", "accepted"), ("5", 1, "and", "or", "open")]
    swaps = spark.createDataFrame(swaps, "id string, page int, before string, after string, status string")
    assert {r.page: r.text for r in notes.applied(swaps, pet).collect()} == {1: "a dog dog and a pig", 2: "ab"}
    a = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), ("3", "x"), ("4", "x")], "id string, label string")
    e = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "x"), ("5", "x")], "id string, label string")
    assert {(r.id, r.problem) for r in notes.agreement(a, e, "id", ["label"]).collect()} == {("2", "differs"), ("3", "accepted more than once"), ("4", "not emitted"), ("5", "not accepted")}
    lines = spark.createDataFrame([(1, k, k in (2, 3, 4, 6), k in (2, 3, 4, 6)) for k in range(8)], "page int, line int, mono boolean, indent boolean")
    assert [(r.first, r.last) for r in notes.code_runs(lines, ["mono", "indent"]).collect()] == [(2, 4)]
    el = lambda *x: spark.createDataFrame([(i, p, "h") for p, i in enumerate(x)], "element string, pos int, parent string")
    assert {(r.element, r.problem) for r in notes.pairs(el("a", "b", "c"), el("b", "a", "d")).collect()} == {("c", "not emitted"), ("d", "not accepted"), ("a", "out of order"), ("b", "out of order")}
    links = spark.createDataFrame([("x", "t1", 3), ("y", "t2", 4), ("z", "t3", 5)], "label string, target string, page int")
    goals = spark.createDataFrame([("t1", 3), ("t2", 5)], "target string, page int")
    assert {(r.label, r.problem) for r in notes.contents_failures(links, goals).collect()} == {("y", "page differs"), ("z", "no destination")}


def test_lists_and_sets(spark):
    lists = lambda *x: spark.createDataFrame(list(enumerate(x)), "pos int, v string")
    assert [r.pos for r in reconcile.lists_differ(lists("a", None, "c"), lists("a", None, "d", "e"), "pos", ["v"]).orderBy("pos").collect()] == [2, 3]
    assert reconcile.same_lists(lists("a", None), lists("a", None), "pos", ["v"]).first().equal
    nulls = spark.createDataFrame([(None,), (1,)], "k int")
    assert reconcile.missing(nulls, nulls, "k").collect() == []
    before, after = spark.createDataFrame([(1, None)], "pid int, cwd string"), spark.createDataFrame([(1, "x")], "pid int, cwd string")
    assert [r.field for r in reconcile.changed_fields(before, after, ["pid", "cwd"]).collect()] == ["cwd"]
    assert reconcile.has_repeats(nulls.union(nulls), "k").first().repeated


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "WARN", "s", "d"), ("b", "PASS", "s", "d")], report.FINDING)
    assert report.rollup(rows).first().level == 1 and report.rollup(rows.where("1 = 0")).first().level == 0
    report.write_tsv(spark.createDataFrame([("u2", ""), ("u1", "t")], "url string, title string"), str(tmp_path / "out"), "url")
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["u1\tt", "u2\t"]
    report.write_report(rows, str(tmp_path / "r"))
    with pytest.raises(Exception, match="exist"):
        report.write_report(rows, str(tmp_path / "r"))
