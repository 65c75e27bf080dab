"""Hashes, canonical JSON and encodings."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def is_sha256(text: Column) -> Column:
    """64 lower-case hexadecimal digits; null isn't."""
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}$"), F.lit(False))


def entry_json(kind: Column, mode: Column, path: Column, sha: Column, target: Column) -> Column:
    """A file tree's entry as JSON with sorted keys and no spaces: files have a hash, links a target."""
    file = F.to_json(F.struct(kind.alias("kind"), mode.alias("mode"), path.alias("path"), sha.alias("sha256")))
    link = F.to_json(F.struct(kind.alias("kind"), mode.alias("mode"), path.alias("path"), target.alias("target")))
    return F.when(kind == "symlink", link).otherwise(file)


def folded(entries: Column) -> Column:
    """One hash of an array of texts, each followed by a newline."""
    return F.sha2(F.concat(F.array_join(entries, "\n"), F.when(F.size(entries) > 0, F.lit("\n")).otherwise(F.lit(""))), 256)


def mime_type(name: Column) -> Column:
    """The type of an image by its ending; PNG for all others."""
    end = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(end.isin("jpg", "jpeg"), "image/jpeg").when(end == "webp", "image/webp").when(end == "gif", "image/gif").otherwise("image/png")


def data_url(content: Column, name: Column) -> Column:
    return F.concat(F.lit("data:"), mime_type(name), F.lit(";base64,"), F.base64(content))


@cache
def latin_class() -> str:
    """A pattern's class of the ASCII digits and all characters with LATIN in their Unicode name, as intervals of code points."""
    found = [k for k in range(sys.maxunicode + 1) if chr(k) in "0123456789" or "LATIN" in unicodedata.name(chr(k), "")]
    starts = [k for j, k in enumerate(found) if not j or found[j - 1] != k - 1]
    ends = [k for j, k in enumerate(found) if j + 1 == len(found) or found[j + 1] != k + 1]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


def latin_named(text: Column) -> Column:
    """How many characters are ASCII digits or have LATIN in their Unicode name."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{latin_class()}]+", ""))


#: Control characters whose escape has a letter among its digits.
_LETTERED = [k for k in range(32) if chr(k) not in "\b\t\n\f\r" and f"{k:x}" != f"{k:X}"]


def canonical_json(value: Column) -> Column:
    """A VARIANT as JSON with the keys of all objects in order, no spaces, and characters beyond ASCII as they are.

    Keys come in the order of their UTF-16 units. Decimal numbers lose their trailing zeros (1.50 is
    1.5, and 2.0 is 2), those with an exponent are written as doubles; hexadecimal digits of escapes
    are small.
    """
    written = F.to_json(value)
    for k in _LETTERED:  # an even number of backslashes before it: the escape itself, not an escaped backslash
        written = F.regexp_replace(written, rf"(?<!\\)((?:\\\\)*)\\u{k:04X}", rf"$1\\u{k:04x}")
    return written
