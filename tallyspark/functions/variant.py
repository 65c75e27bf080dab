"""Dynamic JSON: presence of keys is told apart from null, and integers are read as loosely as a script would."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The value, or null where the text is no JSON.

    The parser stops after the first value of a text; inside brackets of both kinds a text with
    more than one value is no JSON.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(named.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type; null for what isn't there."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def at(value: Column, key: str, to: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", to)


def has(value: Column, key: str) -> Column:
    """Whether the object has the key, also if its value is null: a null in JSON is a value, what isn't there is none."""
    return at(value, key).isNotNull()


def first_present(value: Column, keys: Sequence[str]) -> Column:
    """The value of the first key that is there, null values included; null if none is."""
    values = [at(value, key) for key in keys]
    return F.coalesce(*values)


def as_integer(value: Column) -> Column:
    """Numbers cut to integers, booleans 1 and 0, texts of digits with white space around; null for all else."""
    text = F.try_variant_get(value, "$", "string")
    plain = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?<=\d)_(?=\d)", "")
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("long"))
        .when(kind(value) == "STRING", F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("long")))
        .when(kind(value).isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("long"))
    )


def is_integer(value: Column) -> Column:
    """Whether the value is an integer or a boolean."""
    whole = kind(value).isin("BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN")
    return F.coalesce(whole, F.lit(False))


def is_missing(value: Column) -> Column:
    """Whether the value isn't there, is null or an empty text."""
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False)) | (F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("-")) == "")


def items(value: Column) -> Column:
    """An array value as an array of values; null if it is none."""
    return F.try_variant_get(value, "$", "array<variant>")
