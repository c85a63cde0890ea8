"""JSON-RPC messages: parsing, validation, and what tools and catalogues carry inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions import jsonv as J
from gatesift.functions.expr import texts
from gatesift.patterns import gates as G

PARSE_ERROR = -32700
INVALID_REQUEST = -32600


def parse_envelope(df: DataFrame, raw: str) -> DataFrame:
    """The input with `body` (variant, NULL when malformed), `jsonrpc`, `method`, `id`, `tool_name`."""
    out = df.withColumn("body", F.try_parse_json(F.col(raw)))
    body = F.col("body")
    return out.withColumns({
        "jsonrpc": J.get_string(body, "$.jsonrpc"),
        "method": J.get_string(body, "$.method"),
        "id": F.try_variant_get(body, "$.id", "string"),
        "tool_name": J.get_string(body, "$.params.name"),
    })


def envelope_error(raw: Column) -> Column:
    """JSON-RPC error code of a malformed or invalid message; NULL for a valid one."""
    body = F.try_parse_json(raw)
    version = J.get_string(body, "$.jsonrpc")
    unknown = F.size(F.array_except(F.json_object_keys(raw), texts(G.ENVELOPE_KEYS)))
    return (
        F.when(~F.coalesce(J.is_object(body), F.lit(False)), F.lit(PARSE_ERROR))
        .when(F.coalesce(version != "2.0", F.lit(True)), F.lit(INVALID_REQUEST))
        .when(unknown > 0, F.lit(INVALID_REQUEST))
    )


def header_body_mismatch(raw: Column, method_header: Column, name_header: Column) -> Column:
    """`method` or `name` where a header contradicts the body, `invalid` for a bad message, else NULL.

    An empty header is no header.
    """
    body = F.try_parse_json(raw)
    method_type = F.schema_of_variant(F.try_variant_get(body, "$.method", "variant"))
    name_type = F.schema_of_variant(F.try_variant_get(body, "$.params.name", "variant"))
    odd_method = F.coalesce(~method_type.isin("STRING", "VOID"), F.lit(False))
    odd_name = F.coalesce(~name_type.isin("STRING", "VOID"), F.lit(False))
    method = F.coalesce(J.get_string(body, "$.method"), F.lit(""))
    name = F.coalesce(J.get_string(body, "$.params.name"), F.lit(""))
    return (
        F.when(envelope_error(raw).isNotNull() | odd_method, F.lit("invalid"))
        .when((method_header != "") & (method_header != method), F.lit("method"))
        .when(odd_name, F.lit("invalid"))
        .when((name_header != "") & (name_header != name), F.lit("name"))
    )


def meta_keys(params: Column) -> Column:
    """Keys of the `_meta` object in a params JSON text; NULL where there is no such object."""
    return F.json_object_keys(F.get_json_object(params, "$._meta"))


def filter_meta_keys(df: DataFrame, params: str, allowed: Sequence[str] = G.META_ALLOWED) -> DataFrame:
    """The input with `kept` and `stripped` keys, `rejected` (under the strict policy) and `claims_authority`."""
    keys = F.coalesce(meta_keys(F.col(params)), F.expr("cast(array() AS array<string>)"))
    out = df.withColumn("_keys", keys)
    stripped = F.array_except("_keys", texts(allowed))
    return out.withColumns({
        "kept": F.array_sort(F.array_intersect("_keys", texts(allowed))),
        "stripped": F.array_sort(stripped),
        "rejected": F.size(stripped) > 0,
        "claims_authority": F.arrays_overlap("_keys", texts(G.META_AUTHORITY)),
    }).drop("_keys")


def meta_allowed(params: Column, allowed: Sequence[str] = G.META_ALLOWED) -> Column:
    """The `_meta` object reduced to allowed keys, as a map of raw values; NULL where nothing is left."""
    meta = F.from_json(F.get_json_object(params, "$._meta"), "map<string,string>")
    kept = F.map_filter(meta, lambda k, _: k.isin(list(allowed)))
    return F.when(F.size(kept) > 0, kept)


def tool_texts(result: Column) -> Column:
    """`content[].text` strings of a tool result, in order."""
    content = J.elements(F.try_parse_json(result), "$.content")
    return F.array_compact(F.transform(content, lambda e: J.get_string(e, "$.text")))


def app_html(result: Column) -> Column:
    """HTML meant for rendering: `html` fields, or `text` of resource, ui and app blocks of an HTML type."""
    def html_of(e: Column) -> Column:
        typed = J.get_string(e, "$.type").isin("resource", "ui", "app")
        renders = F.contains(F.lower(J.get_string(e, "$.mimeType")), F.lit("html"))
        direct = J.get_string(e, "$.html")
        return F.when(direct.isNotNull(), direct).when(typed & renders, J.get_string(e, "$.text"))

    content = J.elements(F.try_parse_json(result), "$.content")
    return F.array_compact(F.transform(content, html_of))


def _exploded(df: DataFrame, values: Column, keep: Sequence[str], name: str) -> DataFrame:
    return df.select(*keep, F.posexplode(values).alias("ordinal", name)).withColumn("ordinal", F.col("ordinal").cast("bigint"))


def extract_tool_text(df: DataFrame, result: str, keep: Sequence[str]) -> DataFrame:
    return _exploded(df, tool_texts(F.col(result)), keep, "text")


def extract_app_html(df: DataFrame, result: str, keep: Sequence[str]) -> DataFrame:
    return _exploded(df, app_html(F.col(result)), keep, "html")


TOOL = "struct<name:string,description:string,version:string,inputSchema:struct<properties:map<string,struct<type:string>>,required:array<string>>>"


def flatten_tool_catalog(df: DataFrame, listing: str, keep: Sequence[str]) -> DataFrame:
    """One row per named tool of a `tools/list` result: name, description, version and
    `params`, an array of `(name, type, required)` sorted by name."""
    tools = F.from_json(F.col(listing), f"struct<tools:array<{TOOL}>>")["tools"]
    rows = df.select(*keep, F.explode(F.filter(tools, lambda t: t["name"] != "")).alias("_t"))
    schema = F.col("_t.inputSchema")

    def param(entry: Column) -> Column:
        required = F.coalesce(F.array_contains(schema["required"], entry["key"]), F.lit(False))
        return F.struct(
            entry["key"].alias("name"), F.coalesce(entry["value"]["type"], F.lit("")).alias("type"), required.alias("required")
        )

    params = F.transform(F.map_entries(schema["properties"]), param)
    empty = F.expr("cast(array() AS array<struct<name:string,type:string,required:boolean>>)")
    return rows.select(
        *keep, F.col("_t.name").alias("name"),
        F.coalesce("_t.description", F.lit("")).alias("description"),
        F.coalesce("_t.version", F.lit("")).alias("version"),
        F.array_sort(F.coalesce(params, empty)).alias("params"),
    )


def extract_tool_call_name(content: Column) -> Column:
    """Value behind the first `"method"`, else behind the first `"name"`, by string search; NULL for none."""
    def behind(key: str) -> Column:
        at = F.position(F.lit(key), content)
        rest = F.substring(content, at + len(key), F.char_length(content))
        pattern = r'\A[ \t\r\n:]*"([^"]*)"'
        return F.when((at > 0) & F.rlike(rest, F.lit(pattern)), F.regexp_extract(rest, pattern, 1))

    return F.nullif(F.coalesce(behind('"method"'), behind('"name"')), F.lit(""))


def flatten_arguments(df: DataFrame, arguments: str, keep: Sequence[str]) -> DataFrame:
    """One row per string value at any depth of a JSON text."""
    return _exploded(df, J.all_strings(F.col(arguments)), keep, "value")
