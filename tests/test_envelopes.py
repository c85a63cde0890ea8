import json

from pyspark.sql import functions as F

from gatesift.functions import jsonv
from gatesift.operators import envelopes as E

MESSAGES = [
    ('{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"t"}}', None),
    ('{"jsonrpc":"2.0","result":{}}', None),
    ('{"jsonrpc":"1.0","id":1}', -32600),
    ('{"id":1}', -32600),
    ('{"jsonrpc":2.0,"id":1}', -32600),
    ('{"jsonrpc":"2.0","extra":1}', -32600),
    ("{bad", -32700),
    ("[1,2]", -32700),
    ('"text"', -32700),
]


def test_validate(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MESSAGES)], "i int, raw string")
    got = [r[0] for r in df.orderBy("i").select(E.envelope_error(F.col("raw"))).collect()]
    assert got == [code for _, code in MESSAGES]


def test_headers_against_body(spark):
    raw = MESSAGES[0][0]
    cases = [("", "", None), ("tools/call", "t", None), ("tools/list", "t", "method"), ("tools/call", "u", "name")]
    df = spark.createDataFrame([(raw, m, n, e) for m, n, e in cases], "raw string, m string, n string, e string")
    for r in df.select("e", E.header_body_mismatch(F.col("raw"), F.col("m"), F.col("n")).alias("got")).collect():
        assert r["got"] == r["e"]


def test_meta(spark):
    rows = [('{"_meta":{"trace_id":"a","role":"x"}}',), ('{"_meta":5}',), ("{}",)]
    df = E.filter_meta_keys(spark.createDataFrame(rows, "params string"), "params")
    got = [(r["kept"], r["stripped"], r["rejected"], r["claims_authority"]) for r in df.collect()]
    assert got == [(["trace_id"], ["role"], True, True), ([], [], False, False), ([], [], False, False)]
    left = spark.createDataFrame(rows, "params string").select(E.meta_allowed(F.col("params"))).collect()
    assert [r[0] for r in left] == [{"trace_id": "a"}, None, None]


def test_all_strings_at_any_depth(spark):
    nested = "leaf"
    for i in range(40):
        nested = [nested] if i % 2 else {"k": nested}
    value = {"a": 'quote " and \\ slash', "b": [1, True, None, "é\n😀", {"c:d": "x: y", "e": ""}], "deep": nested, "u": "\\\" tricky \\\\"}

    def walk(v):
        if isinstance(v, str):
            yield v
        for sub in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            yield from walk(sub)

    for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1)):
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(jsonv.all_strings(F.col("t"))).first()[0] == list(walk(value))


def test_long_string_value(spark):
    text = json.dumps({"a": 'x"' * 100_000})
    got = spark.createDataFrame([(text,)], "t string").select(F.char_length(jsonv.all_strings(F.col("t"))[0])).first()[0]
    assert got == 200_000


CALLS = {
    '{"method": "list_credentials", "x": 1}': "list_credentials",
    '{"name":"read_file"}': "read_file",
    '{"method": 5, "name": "fallback"}': "fallback",
    'text "method" : "spaced" more': "spaced",
    '{"method":"", "name":"n"}': None,
    "nothing": None,
}


def test_tool_call_name(spark):
    df = spark.createDataFrame([(t,) for t in CALLS], "t string")
    assert {r[0]: r[1] for r in df.select("t", E.extract_tool_call_name(F.col("t"))).collect()} == CALLS


def test_catalog(spark):
    listing = json.dumps({"tools": [
        {"name": "a", "description": "d", "version": "1", "inputSchema": {"properties": {"z": {"type": "string"}, "b": {"type": "integer"}}, "required": ["z"]}},
        {"name": "bare"}, {"name": ""}, {"description": "nameless"},
    ]})
    rows = E.flatten_tool_catalog(spark.createDataFrame([(1, listing)], "k int, listing string"), "listing", ["k"]).collect()
    assert [(r["name"], r["version"], [tuple(p) for p in r["params"]]) for r in rows] == [
        ("a", "1", [("b", "integer", False), ("z", "string", True)]), ("bare", "", [])
    ]
