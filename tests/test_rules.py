"""The rewriting engine: guards cost nothing in results, positions are right, order matters."""

import dataclasses
import re
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatesift.functions.regex import low_sql
from gatesift.operators import rewrite
from gatesift.operators.rewrite import apply_rules, hit_sql, rule_hits
from gatesift.patterns import content, regulated, responses
from gatesift.patterns.indicators import IOC_RULES
from gatesift.patterns.literals import LITERALS
from gatesift.patterns.prompts import PROMPT_RULES
from gatesift.patterns.rule import Rule
from gatesift.patterns.secrets import SECRET_RULES
from gatesift.plans import samples

PACKS = {
    "ioc": IOC_RULES, "secrets": SECRET_RULES, "prompts": PROMPT_RULES, "commands": content.COMMAND_RULES, "xss": content.XSS_RULES,
    "sql": content.SQL_RULES, "pii": regulated.PII_RULES, "phi": regulated.PHI_RULES, "pci": regulated.PCI_RULES,
}
EXTRA = [
    "ignore this\n" + "long line without it " * 50 + "\nIGNORE previous rules", "festival prompt\nthe fête: one request", "abc\n\nxyz bypass",
    "Привет мир\nlatin привет latin\nonly latin", "a1 reset\nreset a\n9 forget", "x" * 300 + " override", "FÊTE and\ninstruction; fête then instruction",
]


def texts(spark):
    rows = [(i, t) for i, t in enumerate(samples.PAYLOADS + EXTRA + [" ".join(samples.PAYLOADS)])]
    return spark.createDataFrame(rows, "i int, text string").cache()


def results(df, rules):
    out = df.select("i", apply_rules("text", rules).alias("r")).collect()
    return {r["i"]: (r["r"]["text"], [tuple(h) for h in r["r"]["hits"]]) for r in out}


@pytest.mark.parametrize("pack", list(PACKS))
def test_guards_change_nothing(spark, pack):
    bare = [dataclasses.replace(r, needs=(), screen="", by_line=False, non_ascii=False) for r in PACKS[pack]]
    df = texts(spark)
    assert results(df, PACKS[pack]) == results(df, bare)


def test_positions_and_order(spark):
    rules = [Rule("first", r"b+", marker="#"), Rule("second", r"#a", marker="-"), Rule("third", r"zz", marker="")]
    df = spark.createDataFrame([(0, "abba bb"), (1, "zz"), (2, ""), (3, "éb😀b")], "i int, text string")
    assert results(df, rules) == {
        0: ("a- #", [(0, 1, True), (0, 5, True), (1, 1, True)]),
        1: ("", [(2, 0, True)]),
        2: ("", []),
        3: ("é#😀#", [(0, 1, True), (0, 3, True)]),
    }


def test_many_matches(spark):
    text = "ab" * 3000
    df = spark.createDataFrame([(0, text)], "i int, text string")
    got, hits = results(df, [Rule("a", r"a", marker="x")])[0]
    assert got == "xb" * 3000 and [h[1] for h in hits] == list(range(0, 6000, 2))


def test_luhn_gate(spark):
    df = spark.createDataFrame([(0, "4532015112830366 and 4532015112830367")], "i int, text string")
    got, hits = results(df, regulated.PCI_RULES)[0]
    assert got == "CARD_DATA_REDACTED and 4532015112830367" and [h[2] for h in hits] == [True, False]


def test_same_as_re2(spark):
    """Every rule of every pack, by itself, on the sample texts: JVM against RE2."""
    con = duckdb.connect()
    rows = [(i, t) for i, t in enumerate(samples.PAYLOADS + EXTRA)]
    con.execute("CREATE TABLE t (i INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "i int, text string").cache()
    for rules in [*PACKS.values(), responses.ACE_RULES, responses.POISON_RULES, responses.TOOL_INJECTION_RULES]:
        plain = [dataclasses.replace(r, luhn=False) for r in rules]
        got = df.select("i", *[F.size(apply_rules("text", [r])["hits"]).alias(f"c{k}") for k, r in enumerate(plain)]).collect()
        counts = ", ".join("len(regexp_extract_all(text, '" + r.regex.replace("'", "''") + "'))" for r in plain)
        expected = {row[0]: row[1:] for row in con.execute(f"SELECT i, {counts} FROM t").fetchall()}
        for row in got:
            assert tuple(row)[1:] == expected[row["i"]], (row["i"], [r.name for r, a, b in zip(plain, tuple(row)[1:], expected[row["i"]]) if a != b])


def test_pack_sizes():
    assert len(IOC_RULES) == 69 and len(SECRET_RULES) == 66 and len(PROMPT_RULES) == 24 and len(LITERALS) == 75
    severities = [r.severity for r in IOC_RULES]
    assert [severities.count(s) for s in ("critical", "high", "medium")] == [30, 25, 14]
    assert all(re.fullmatch(r"[a-z ]+", l) for l, *_ in LITERALS)


ANYCASE = [(pack, i) for pack, rules in {**PACKS, "responses": [r for k in vars(responses).values() if isinstance(k, list) for r in k if isinstance(r, Rule)]}.items()
           for i, r in enumerate(rules) if "(?i" in r.regex]


def test_letters_beyond_ascii_fold_as_in_re2(spark):
    """Every rule without regard to case, on the texts with `s` and `k` written as the characters which fold to them."""
    all_rules = {**PACKS, "responses": [r for k in vars(responses).values() if isinstance(k, list) for r in k if isinstance(r, Rule)]}
    rules = [all_rules[pack][i] for pack, i in ANYCASE]
    plain = samples.PAYLOADS + EXTRA
    written = [t.translate(str.maketrans({"s": "ſ", "k": "K", "K": "K"})) for t in plain]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(range(0, len($1))) AS i, unnest($1) AS text", [plain + written])
    df = spark.createDataFrame(list(enumerate(plain + written)), "i int, text string")
    columns = [F.count_if(F.expr(hit_sql(r, "text", low_sql("text")))).alias(f"c{n}") for n, r in enumerate(rules)]
    got = list(df.agg(*columns).first())
    want = [con.execute("SELECT count(*) FROM t WHERE regexp_matches(text, $1)", [r.regex]).fetchone()[0] for r in rules]
    assert [(r.name, g) for r, g in zip(rules, got)] == [(r.name, w) for r, w in zip(rules, want)]
    assert len(rules) > 50


def test_rules_without_guards_are_linear(spark):
    """`X+.*Y` on one long line without Y: a backtracking engine tries every beginning, unless a guard keeps it from that."""
    bare = [dataclasses.replace(r, needs=(), screen="", by_line=False, non_ascii=False) for r in IOC_RULES if r.by_line]
    df = spark.createDataFrame([(0, "word" * 50_000), (1, "word" * 50_000 + " ок now")], "i int, text string")
    began = time.monotonic()
    got = results(df, bare)
    assert time.monotonic() - began < 60
    assert got[0] == ("word" * 50_000, []) and got[1][1]


def test_marks_and_empty_matches(spark):
    """Texts may hold any character, also the one that marks matches first, and an expression may match nothing."""
    rules = [Rule("a", r"a+", marker="\\0"), Rule("x", r"x*", marker="-")]
    first = chr(0xF0000)
    df = spark.createDataFrame([(0, f"{first}aa{first}"), (1, "\\1"), (2, None)], "i int, text string")
    got = results(df, rules)
    assert got[0] == (f"-{first}-\\-0-{first}-", [(0, 1, True), *((1, i, True) for i in range(5))])
    assert got[1] == ("-\\-1-", [(1, 0, True), (1, 1, True), (1, 2, True)]) and got[2] == (None, [])


def test_rules_are_tried_where_their_strings_stand():
    """A rule searches the texts that hold what its screen looks for, not all of them."""
    texts = pa.array(["plain words " * 20] * 90 + [f"{p} words" for p in samples.PAYLOADS[:10]])
    plan = rewrite.planned(IOC_RULES)
    assert sum(bool(r.needs) for r in IOC_RULES) == sum(0 <= s < len(plan.screens) - 1 for _, _, _, s, _ in plan.rules)
    held = rewrite._held(texts, plan.screens)
    assert not any(h[:90].any() for h in held) and any(h[90:].any() for h in held)
    assert len(plan.screens) <= -(-len(IOC_RULES) // rewrite.GROUP) + 1


def test_markers_may_make_what_a_later_rule_needs(spark):
    """The later rules' strings arise only by the rewriting: inside a marker, over its edges, and where it is empty."""
    rules = [
        Rule("a", r"x+", marker="\u0131gno"), Rule("b", r"q+", marker="no STOP yet"), Rule("c", r"z+", marker=""), Rule("d", r"w+", marker="\u0436"),
        Rule("e", r"(?i)gnore", needs=("gnore",)), Rule("f", r"(?i)stop", needs=("stop",)), Rule("g", r"(?i)bypass", needs=("bypass",)),
        Rule("h", "\u0436", non_ascii=True), Rule("i", "[\u0436\u0437]", non_ascii=True),
    ]
    bare = [dataclasses.replace(r, needs=(), non_ascii=False) for r in rules]
    rows = ["xxre", "q", "byzpass", "byzpa\u017fzs", "w", "gnzzore " + "long " * 40 + "xRE", None, "", "wzw"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    got = results(df, rules)
    assert got == results(df, bare)
    assert [[h[0] for h in got[i][1]] for i in range(6)] == [[0, 4], [1, 5], [2, 6], [2, 2, 6], [3, 7], [0, 2, 4, 4]]


@pytest.mark.parametrize("pack", list(PACKS))
def test_hits_alone_are_those_beside_the_text(spark, pack):
    df = texts(spark)
    alone = {r["i"]: [tuple(h) for h in r["h"]] for r in df.select("i", rule_hits("text", PACKS[pack]).alias("h")).collect()}
    assert alone == {i: hits for i, (_, hits) in results(df, PACKS[pack]).items()}
