"""Pieces of SQL from which the comparison queries are put together.

The patterns go in unchanged, in RE2 dialect, which is what DuckDB's engine speaks; the Spark side
runs them translated for the JVM. The two therefore check each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from gatesift.patterns import content as C
from gatesift.patterns.rule import Rule

FIELDS = r"[^\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def q(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def qlist(values: Sequence[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def fields(text: str) -> str:
    return f"regexp_extract_all({text}, {q(FIELDS)})"


def luhn(text: str) -> str:
    """Check-digit test of the digits in a text."""
    digits = f"regexp_replace({text}, '[^0-9]', '', 'g')"
    return (
        f"list_transform([{digits}], lambda d: length(d) BETWEEN 13 AND 19 AND coalesce(list_sum(list_transform("
        "range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN "
        "2 * CAST(substr(d, length(d) - i + 1, 1) AS BIGINT) - CASE WHEN substr(d, length(d) - i + 1, 1) > '4' THEN 9 ELSE 0 END "
        "ELSE CAST(substr(d, length(d) - i + 1, 1) AS BIGINT) END)), 1) % 10 = 0)[1]"
    )


def chain(text: str, rules: Sequence[Rule], *, first_only: bool = False, leet: str | None = None, positions: bool = True) -> str:
    """`{t, h}` after the rules have run in order; a hit is `{k, p, ok}`, with `p` 0 if not asked for."""
    gated = any(r.luhn for r in rules)
    rows = ", ".join(
        f"{{'t': {q(r.regex)}, 'm': {q(r.marker)}, 'k': {i}, 'g': {str(r.luhn).lower()}, "
        "'h': []::STRUCT(k BIGINT, p BIGINT, ok BOOLEAN)[]}"
        for i, r in enumerate(rules)
    )

    def starts(subject: str, ok: str) -> str:
        pieces = f"{{'p': string_split_regex({subject}, x.t), 'm': regexp_extract_all({subject}, x.t)}}"
        return (
            f"list_transform([{pieces}], lambda z: list_transform(range(1, len(z.m) + 1), lambda i: "
            "{'k': x.k, 'p': CAST(list_sum(list_transform(z.p[1:i], lambda s: length(s))) "
            "+ coalesce(list_sum(list_transform(z.m[1:i - 1], lambda s: length(s))), 0) AS BIGINT), "
            f"'ok': {ok}}}))[1]"
        )

    if first_only:
        hits = "CASE WHEN regexp_matches(a.t, x.t) THEN [{'k': x.k, 'p': 0::BIGINT, 'ok': true}] ELSE [] END"
    elif not positions:
        hits = "list_transform(regexp_extract_all(a.t, x.t), lambda m: {'k': x.k, 'p': 0::BIGINT, 'ok': true})"
    else:
        hits = starts("a.t", f"NOT (x.g AND NOT {luhn('z.m[i]')})" if gated else "true")
    if leet is not None:
        mine = f"list_transform({hits}, lambda y: y.p)"
        hits = f"list_concat({hits}, list_filter({starts(leet, 'true')}, lambda e: NOT list_contains({mine}, e.p)))"
    text_after = "regexp_replace(a.t, x.t, x.m, 'g')"
    if gated:
        text_after = (
            "CASE WHEN NOT x.g THEN regexp_replace(a.t, x.t, x.m, 'g') ELSE "
            "list_transform([{'p': string_split_regex(a.t, x.t), 'm': regexp_extract_all(a.t, x.t)}], lambda z: "
            "array_to_string(list_transform(range(1, len(z.p) + 1), lambda i: z.p[i] || CASE WHEN i > len(z.m) THEN '' "
            f"WHEN {luhn('z.m[i]')} THEN x.m ELSE z.m[i] END), ''))[1] END"
        )
    return (
        f"list_reduce([{rows}], lambda a, x: {{'t': {text_after}, 'm': '', 'k': 0, 'g': false, "
        f"'h': list_concat(a.h, {hits})}}, "
        f"{{'t': {text}, 'm': '', 'k': 0, 'g': false, 'h': []::STRUCT(k BIGINT, p BIGINT, ok BOOLEAN)[]}})"
    )


def attribute(rules: Sequence[Rule], name: str, index: str) -> str:
    return f"({qlist([getattr(r, name) for r in rules])})[{index} + 1]"


def detections(source: str, keep: str, text: str, rules: Sequence[Rule], type_: str, pattern: str | None = None, **options) -> str:
    """One row per hit, from a query body `source` (a FROM item)."""
    return f"""SELECT {keep}, {type_} AS type, {pattern or attribute(rules, 'name', 'h.k')} AS pattern,
       {attribute(rules, 'severity', 'h.k')} AS severity, CAST(h.p AS BIGINT) AS position
FROM (SELECT {keep}, unnest(({chain(text, rules, **options)}).h) AS h FROM {source})"""


def normalized(text: str) -> str:
    """The normalised form of the literal matcher, joined by tokens instead of look-arounds."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = f"translate({text}, {q(upper + C.LEET_MATCH[0])}, {q(upper.lower() + C.LEET_MATCH[1])})"
    t = rf"regexp_replace(regexp_replace({t}, '[\p{{C}}\p{{Z}}]', ' ', 'g'), '[^a-z ]', '', 'g')"
    joined = (
        f"list_transform([string_split({t}, ' ')], lambda w: array_to_string(list_transform(range(1, len(w) + 1), lambda i: "
        "w[i] || CASE WHEN i = len(w) OR (length(w[i]) = 1 AND w[i + 1] <> '') THEN '' ELSE ' ' END), ''))[1]"
    )
    return f"trim(regexp_replace({joined}, ' +', ' ', 'g'))"


def risk(rank: str) -> str:
    return f"CASE {rank} WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"


def rank(severity: str) -> str:
    return f"CASE {severity} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def first_match(value: str, rules: Sequence[tuple[str, str, str]]) -> str:
    tests = {"contains": "contains({v}, {t})", "prefix": "starts_with({v}, {t})", "equals": "{v} = {t}"}
    whens = " ".join(f"WHEN {tests[test].format(v=value, t=q(text))} THEN {q(answer)}" for test, text, answer in rules)
    return f"CASE {whens} END"


def hmac(message: str, key: bytes) -> str:
    """HMAC-SHA256 as hex, with the padded keys as literals."""
    block = key.ljust(64, b"\0")
    pads = ["".join(f"\\x{b ^ pad:02X}" for b in block) for pad in (0x36, 0x5C)]
    return f"sha256('{pads[1]}'::BLOB || unhex(sha256('{pads[0]}'::BLOB || encode({message}))))"
