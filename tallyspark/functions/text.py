"""Text expressions. Trimming and white space follow Unicode, lengths say what they count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of two conventions: newline with an optional carriage return; all that Unicode calls one.
NEWLINE = r"\r?\n"
# Fixed value: the characters that a CJK face sets.
CJK_RUN = r"([\p{IsHan}\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\u201c\u201d\u2018\u2019]+)"
ANY_NEWLINE = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_spaced(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(text, r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    """Trimmed lower case; null counts as empty."""
    return F.lower(trim(F.coalesce(text, F.lit(""))))


def is_blank(text: Column) -> Column:
    return trim(F.coalesce(text, F.lit(""))) == ""


def lines(text: Column, ends: str = NEWLINE) -> Column:
    return F.split(text, ends)


def units_utf16(text: Column) -> Column:
    """Length in UTF-16 units; characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def contains_either_way(a: Column, b: Column) -> Column:
    """Whether one text holds the other; every text holds the empty one."""
    return F.contains(a, b) | F.contains(b, a)


def left_padded(number: Column, width: int = 4) -> Column:
    """A number with leading zeros to ``width``; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def quoted(text: Column) -> Column:
    """A double-quoted scalar, inner quotes escaped."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def shortened(text: Column, limit: int = 110) -> Column:
    """At most ``limit`` code points, the last three dots where it was longer."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def two_decimals(number: Column) -> Column:
    return F.format_string("%.2f", number)


def half_even(number: Column, digits: int = 0) -> Column:
    """Rounded half to even, as binary floating point standards have it."""
    return F.bround(number, digits)


def in_points(mm: Column | float) -> Column:
    """Millimetres as points of 1/72 inch."""
    return (mm if isinstance(mm, Column) else F.lit(float(mm))) * 72 / 25.4


def cjk_runs(text: Column) -> Column:
    """The runs of characters that a CJK face sets, in order: ideographs, their punctuation, fullwidth forms but for letters and digits, curly quotes."""
    return F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(1))


def printable_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x20-\x7E]*$")


def version_of(text: Column) -> Column:
    """The three numbers of a version as an array that compares in order; null if there are none."""
    parts = [F.regexp_extract(trim(text), r"^v?(\d+)\.(\d+)\.(\d+)", k) for k in (1, 2, 3)]
    return F.when(parts[0] != "", F.array(*[p.cast("int") for p in parts]))


def satisfies(version: Column, constraint: Column) -> Column:
    """Whether a version is at least what ``>=`` asks; null if either can't be read."""
    wanted = F.regexp_extract(constraint, r"^\s*>=\s*(v?\d+\.\d+\.\d+)\s*$", 1)
    return F.when(version_of(wanted).isNotNull(), version_of(version) >= version_of(wanted))


def zoned_iso(moment: Column, offset: str = "+08:00") -> Column:
    """A UTC timestamp as local ISO text with its offset."""
    return F.concat(F.date_format(F.from_utc_timestamp(moment, offset), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def date_part(text: Column) -> Column:
    return F.substring(text, 1, 10)


def to_moment(epoch_seconds: Column) -> Column:
    return F.timestamp_seconds(epoch_seconds)


def is_utc_stamp(text: Column) -> Column:
    """Whether text is a moment written ``YYYY-MM-DD HH:mm:ss UTC``."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC$"), F.lit(False))


def is_slug(text: Column) -> Column:
    """Lower-case words and digits joined by single hyphens."""
    return F.coalesce(text.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def latin_count(chars: Column) -> Column:
    """Of an array of characters how many are ASCII digits or letters of Latin script."""
    return F.size(F.filter(chars, lambda c: c.rlike(r"^(?:[0-9]|\p{IsLatin})$")))


# Front matter (a block between two lines of three hyphens), its list of tags, headings, and
# lines that aren't running text. What is read from files depends on these very patterns.
_BLOCK = r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|\z)"
_TAGS = r"(?m)^tags:\s*\n((?:\s+-\s+.+\n?)+)"
_TAG = r'(?m)^\s+-\s+"?([^"\n]+?)"?\s*$'
_FIRST_HEADING = r"(?m)^#\s+(.+)$"
_HEADING, _LINKED, _QUOTED, _LONE_TAG, _MARKUP = r"^#{1,6}\s", r"^!?\[", r"^[>|`-]", r"^<[^>]+>$", r"[*_`>#|~\[\]()]"


def front_matter(raw: Column) -> Column:
    """The block's text; empty if there is none."""
    return F.regexp_extract(raw, _BLOCK, 1)


def body(raw: Column) -> Column:
    """What follows the block."""
    return F.regexp_replace(raw, r"\A---\r?\n[\s\S]*?\r?\n---(?:\r?\n|\z)", "")


def scalar(block: Column, key: str) -> Column:
    """The value of the first line of ``key``, without matching quotes; null if missing or empty."""
    value = trim(F.regexp_extract(block, rf"(?m)^{key}:[^\S\r\n]*(.*)$", 1))
    first, last = F.substring(value, 1, 1), F.substring(value, -1, 1)
    bare = F.when((F.char_length(value) >= 2) & first.isin('"', "'") & (first == last), F.substr(value, F.lit(2), F.char_length(value) - 2)).otherwise(value)
    return F.nullif(bare, F.lit(""))


def tag_list(block: Column) -> Column:
    """Items of the list under ``tags``; null if there are none."""
    listed = F.regexp_extract(block, _TAGS, 1)
    found = F.regexp_extract_all(listed, F.lit(_TAG), F.lit(1))
    return F.when(F.size(found) > 0, found)


def first_heading(text: Column) -> Column:
    return F.nullif(trim(F.regexp_extract(text, _FIRST_HEADING, 1)), F.lit(""))


def without_first_heading(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s*#\s+.+\r?\n", "")


def _prose(line: Column) -> Column:
    return ~line.rlike(_HEADING) & ~line.rlike(_LINKED)


def body_lines(text: Column) -> Column:
    """Distinct trimmed lines of ten UTF-16 units at least that are neither headings nor start with a link or image."""
    trimmed = F.transform(lines(text), trim)
    return F.array_distinct(F.filter(trimmed, lambda x: (units_utf16(x) >= 10) & _prose(x)))


def first_prose_line(text: Column) -> Column:
    """The first line of running text; empty if there is none."""
    trimmed = F.transform(lines(text), trim)
    running = F.filter(trimmed, lambda x: (x != "") & _prose(x) & ~x.rlike(_QUOTED) & ~x.rlike(_LONE_TAG))
    return F.coalesce(F.try_element_at(running, F.lit(1)), F.lit(""))


def description(given: Column, text: Column, title: Column, suffix: str = " - 笔记") -> Column:
    """The given description or the first prose line without markup, shortened; the title if too short."""
    plain = trim(F.regexp_replace(F.coalesce(given, first_prose_line(text)), _MARKUP, ""))
    short = shortened(plain)
    return F.when(F.char_length(short) < 8, F.concat(title, F.lit(suffix))).otherwise(short)


def owner_and_name(remote: Column) -> Column:
    """``owner/name`` of a repository address in either of its two forms; null if it is neither."""
    bare = F.regexp_replace(trim(remote), r"/+$", "")
    pair = [F.regexp_extract(bare, r"(?:^|[/:])([^/:\s]+)/([^/\s]+?)(?:\.git)?$", k) for k in (1, 2)]
    return F.when(pair[0] != "", F.concat_ws("/", *pair))
