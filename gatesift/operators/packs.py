"""Pattern packs given as tables: a user's rules become a pack like the built-in ones.

A table has `name` and `regex` (RE2 dialect), and may have `severity`, `marker`, `kind` and `position`, the place of a rule in
the order in which rules rewrite a text (else the order of names). What a pack needs to be fast is found in the
expressions themselves: strings or characters beyond ASCII without which a rule cannot match, and whether its matches stay
within a line. None changes a result, only its cost.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _constants as C
from re import _parser as parser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.operators.rewrite import apply_rules, explode_hits, rule_hits
from gatesift.patterns.rule import Rule

MOST_RULES = 1000  # a pack is one expression; larger tables are several packs
LEAST_NEEDED = 2  # characters of a string that is worth looking for first
MOST_NEEDED = 16  # alternatives of which one must occur
UNSUPPORTED = re.compile(r"\(\?(?:=|!|<=|<!|>|P=)|(?<!\\)(?:\\\\)*\\[1-9k]")
DEFAULTS = {"severity": "medium", "marker": "PATTERN_REMOVED", "kind": "custom"}


def _strings(items: Sequence) -> list[tuple[str, ...]]:
    """Alternatives of which each match holds one, for every part of a sequence that has such."""
    found, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is C.LITERAL and 32 <= value < 127:
            run += chr(value).lower()
            continue
        if run:
            found.append((run,))
            run = ""
        if op is C.SUBPATTERN:
            found += _strings(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            found += _strings(value[2])
        elif op is C.BRANCH:
            best = [_best(_strings(branch)) for branch in value[1]]
            if all(best):
                found.append(tuple(dict.fromkeys(s for b in best for s in b)))
    return found


def _best(found: Sequence[tuple[str, ...]]) -> tuple[str, ...]:
    """The part that is rarest by its shortest string; none where all are too short or too many."""
    good = [f for f in found if min(map(len, f)) >= LEAST_NEEDED and len(f) <= MOST_NEEDED]
    return max(good, key=lambda f: (min(map(len, f)), -len(f)), default=())


def _beyond_ascii(items: Sequence) -> list[tuple[int, int]]:
    """Ranges of characters beyond ASCII of which every match holds one; none where a match may do without."""
    folded = (0x17F, 0x212A)  # these two match ASCII letters where case does not matter

    def outside(inner, what) -> bool:
        low, high = what if inner is C.RANGE else (what, what)
        return inner in (C.LITERAL, C.RANGE) and low >= 128 and not any(low <= f <= high for f in folded)

    for op, value in items:
        found = []
        if op is C.LITERAL and outside(op, value):
            found = [(value, value)]
        elif op is C.IN and all(outside(*x) for x in value):
            found = [what if inner is C.RANGE else (what, what) for inner, what in value]
        elif op is C.SUBPATTERN:
            found = _beyond_ascii(value[3])
        elif op is C.BRANCH:
            branches = [_beyond_ascii(b) for b in value[1]]
            found = [r for b in branches for r in b] if all(branches) else []
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            found = _beyond_ascii(value[2])
        if found:
            return found
    return []


def _foreign(tree: parser.SubPattern, ranges: Sequence[tuple[int, int]]) -> str:
    """The characters beyond ASCII as an expression, for a rule that looks for more than one character."""
    if not ranges or len(tree) == 1 and tree[0][0] in (C.IN, C.LITERAL):
        return ""
    case = "(?iu)" if tree.state.flags & re.IGNORECASE else ""
    return case + "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in dict.fromkeys(ranges)) + "]"


def _screen(found: Sequence[tuple[str, ...]], needs: tuple[str, ...]) -> str:
    """A second part that every match holds, as an expression that is quick to search for."""
    other = _best([f for f in found if f != needs])
    return "(?i)(?:" + "|".join(re.escape(s) for s in other) + ")" if needs and other else ""


def _crosses_lines(items: Sequence) -> bool:
    """Whether a match may hold a line break."""
    for op, value in items:
        if op is C.LITERAL and value == 10 or op in (C.NOT_LITERAL, C.CATEGORY):
            return True
        if op is C.IN:
            for inner, what in value:
                if inner in (C.NEGATE, C.CATEGORY) and what not in (C.CATEGORY_DIGIT, C.CATEGORY_WORD):
                    return True
                if inner is C.LITERAL and what == 10 or inner is C.RANGE and what[0] <= 10 <= what[1]:
                    return True
        elif op is C.SUBPATTERN and (value[1] & re.DOTALL or _crosses_lines(value[3])):
            return True
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and _crosses_lines(value[2]):
            return True
        elif op is C.BRANCH and any(map(_crosses_lines, value[1])):
            return True
    return False


def compiled(name: str, regex: str, **attributes: str) -> Rule:
    """A rule with what it needs; ValueError where the expression is beyond the dialect."""
    if UNSUPPORTED.search(regex):
        raise ValueError(f"rule {name!r}: look-around, back-references and atomic groups are not in the dialect: {regex}")
    try:
        tree = parser.parse(regex)
    except (re.error, OverflowError):
        return Rule(name, regex, **attributes)  # in the dialect, but not in Python's; it is tried on every text
    by_line = not (tree.state.flags & re.DOTALL) and not _crosses_lines(tree)
    found = _strings(tree)
    needs, ranges = _best(found), _beyond_ascii(tree)
    screen = _screen(found, needs) or _foreign(tree, ranges)
    return Rule(name, regex, needs=needs, screen=screen, by_line=by_line, non_ascii=bool(ranges), **attributes)


def read_pack(table: DataFrame) -> tuple[Rule, ...]:
    """The rules of a table, in order. Names must be there once each; RE2 must accept every expression."""
    columns = {c: F.col(c) for c in ("severity", "marker", "kind") if c in table.columns}
    order = F.col("position") if "position" in table.columns else F.col("name")
    rows = table.select("name", "regex", order.alias("_order"), *[c.alias(n) for n, c in columns.items()]).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a pack holds at most {MOST_RULES} rules; give larger tables as several packs")
    if any(r["name"] is None or r["regex"] is None for r in rows):
        raise ValueError("a rule without a name or an expression")
    if len({r["name"] for r in rows}) < len(rows):
        raise ValueError("two rules of one name")
    rules = []
    for r in sorted(rows, key=lambda r: (r["_order"] is None, r["_order"], r["name"])):
        rules.append(compiled(r["name"], r["regex"], **{n: (r[n] if n in columns and r[n] is not None else d) for n, d in DEFAULTS.items()}))
    for rule in rules:
        try:
            pc.match_substring_regex(pa.array(["x"]), rule.regex)
        except pa.ArrowInvalid as wrong:
            raise ValueError(f"rule {rule.name!r}: the expression is refused: {str(wrong)[:300]}") from wrong
    return tuple(rules)


def match_pack(df: DataFrame, text: str, pack: DataFrame | Sequence[Rule], keep: Sequence[str], prefix: str = "custom_") -> DataFrame:
    """Hits of a pack: the kept columns, `type`, `pattern`, `severity`, `position`, as the built-in packs give them."""
    rules = read_pack(pack) if isinstance(pack, DataFrame) else tuple(pack)
    if not rules:
        return df.select(*keep, *[F.lit(None).cast("string").alias(c) for c in ("type", "pattern", "severity")], F.lit(None).cast("bigint").alias("position")).limit(0)
    return explode_hits(df, rule_hits(text, rules), rules, keep, prefix)


def rewrite_with_pack(df: DataFrame, text: str, pack: DataFrame | Sequence[Rule], name: str = "rewritten") -> DataFrame:
    """The rows with the text as the pack leaves it: every match replaced by its rule's marker, rule after rule."""
    rules = read_pack(pack) if isinstance(pack, DataFrame) else tuple(pack)
    return df.withColumn(name, apply_rules(text, rules)["text"] if rules else F.col(text))
