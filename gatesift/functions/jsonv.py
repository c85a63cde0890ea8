"""Reading dynamic JSON through VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatesift.functions.expr import let

_ESC = "\x01"
_QUOTE = "\x02"


def get_string(value: Column, path: str) -> Column:
    """The string at a path; NULL where it is missing or not a string."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def elements(value: Column, path: str) -> Column:
    """The array at a path as an array of variants; empty where there is none."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.expr("cast(array() AS array<variant>)"))


def all_strings(json: Column) -> Column:
    """Every string value at any depth of a JSON text, without the keys, in order of appearance.

    Works on the text, so depth is not limited: escapes are set aside, string tokens which no colon
    follows are values, and each is decoded by the JSON parser.
    """
    flat = F.replace(F.replace(json, F.lit("\\\\"), F.lit(_ESC)), F.lit('\\"'), F.lit(_QUOTE))
    tokens = F.regexp_extract_all(flat, F.lit(r'"[^"]*"(?:\s*:)?'), F.lit(0))
    values = F.filter(tokens, lambda t: F.endswith(t, F.lit('"')))

    def decode(token: Column) -> Column:
        text = F.replace(F.replace(token, F.lit(_QUOTE), F.lit('\\"')), F.lit(_ESC), F.lit("\\\\"))
        return F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")

    return let(values, lambda v: F.transform(v, decode))
