"""Rows of every odd kind: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

#: Names that operators use inside or return: as extra columns they must not disturb.
CLASHING = ["score", "lang_pred", "key", "ids", "n_pieces", "media", "word", "text_key", "payload", "digest", "h", "ws", "sums", "unit", "class_id", "tokenizer", "start", "ordinal_"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
PAGES = "page_id bigint, url string, html string, text string, key string, payload string, n_chars string, digest string"


def prose(seed: int, words: int) -> str:
    """Made-up words with some punctuation."""
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", "."]) for _ in range(words))


def docs_rows():
    base = prose(1, 120)
    near = " ".join(base.split()[:-4] + ["quite", "other", "last", "words"])
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "en", None),
        (4, None, "fr", "b"),
        (5, "", None, "b"),
        (6, " \t\n ", "fr", "b"),
        (7, "1234 !!! 56", "en", "b"),
        (8, "Éé été naïve 日本語 😀 ▁ ok", "fr", "b"),
        (8, "Éé été naïve 日本語 😀 ▁ ok", "fr", "b"),
        (9, "two words", "en", "c"),
        (None, prose(2, 40), "en", "c"),
        (None, None, None, None),
        (10, prose(3, 30_000), "en", "c"),
        (11, "x" * 200_000, None, "c"),
        (12, "a\x00b <|endoftext|> \x01 don't", "de", "c"),
        (13, base.upper(), "en", "a"),
    ]
    return [(i, t, lang, s, len(t) if t else None, *["clash"] * len(CLASHING)) for i, t, lang, s in rows]


HTML = "<html><body><nav><a href='/x'>menu entry</a></nav><article><h1>Head &amp; more</h1><p>Some text of the page.</p></article></body></html>"


def page_rows():
    first = (1, "http://www.B.org/x?y#z", HTML)
    return [first, (2, "https://u:p@a.org:80/", HTML * 30), (3, None, HTML * 30), (4, "", None), (5, "x", ""), (None, "http://a.org/", HTML * 30), (6, "http://a.org/\n\t é", "plain"), first]
