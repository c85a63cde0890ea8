"""Applying a pattern pack to a text, rule after rule, over batches of texts.

Each rule sees the text as earlier rules left it. A pack is one scalar Arrow function: no job and no shuffle per
rule. Arrow's kernels search with RE2, the dialect of the packs, in linear time, so every rule is tried on every text
at memory speed; only texts with a match are cut up and rewritten. What rules need is looked for first, for several rules at
once, and a rule is tried on the texts that hold it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions.batches import cut, matching, valid
from gatesift.functions.expr import texts
from gatesift.functions.regex import low_sql, sql_text, to_java
from gatesift.patterns.rule import Rule

HITS = "array<struct<rule:bigint,pos:int,ok:boolean>>"
RESULT = pa.struct([("text", pa.string()), ("hits", pa.list_(pa.struct([("rule", pa.int64()), ("pos", pa.int32()), ("ok", pa.bool_())])))])
ROWS = 1000  # texts which a pack runs over at a time
GROUP = 8  # rules whose needed strings are looked for in one search
BEYOND_ASCII = r"[^\x00-\x7F]"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Letters by how often English prose uses them; a search which looks for a rare letter first is quick.
COMMON = "etaoinshrdlcumwfgypbvkjxqz"
NEEDLE = 4


def _quick(needle: str) -> str:
    """The part of a needed string, from its rarest letter on, that is searched for in its stead.

    Where the whole stands the part stands too, so no match is missed.
    """
    starts = range(max(1, len(needle) - NEEDLE + 1))
    return needle[min(starts, key=lambda i: (-COMMON.find(needle[i]) if needle[i] in COMMON else -len(COMMON) + (needle[i] == " ") * 99, i)):]


def guard_sql(rule: Rule, text: str, low: str) -> str:
    """Condition under which the rule's own expression is worth trying."""
    parts = []
    if rule.non_ascii:
        parts.append(f"octet_length({text}) > char_length({text})")
    if rule.needs:
        parts.append("(" + " OR ".join(f"contains({low}, {sql_text(_quick(n))})" for n in rule.needs) + ")")
    if rule.screen:
        parts.append(f"{text} RLIKE {sql_text(to_java(rule.screen))}")
    return " AND ".join(parts) or "true"


def candidate_lines_sql(rule: Rule, text: str) -> str:
    """The text with every line which cannot match blanked out, length unchanged."""
    keep = guard_sql(rule, "line", low_sql("line"))
    return (
        f"array_join(transform(split({text}, '\\n', -1), line -> "
        f"IF({keep}, line, repeat('\\n', char_length(line)))), '\\n')"
    )


def searched_sql(rule: Rule, text: str) -> str:
    return candidate_lines_sql(rule, text) if rule.by_line and (rule.needs or rule.screen) else text


def hit_sql(rule: Rule, text: str, low: str) -> str:
    """Boolean: does the rule match anywhere?"""
    return f"({guard_sql(rule, text, low)} AND {searched_sql(rule, text)} RLIKE {sql_text(to_java(rule.regex))})"


def _luhn(found: str) -> bool:
    """13 to 19 digits, whatever stands between them, whose check digit is right."""
    digits = [int(c) for c in reversed(found) if c in "0123456789"]
    doubled = [2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(digits)]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def _starts(parts: list[str]) -> list[int]:
    """Start of each match, in characters from 0."""
    return list(accumulate(map(len, parts)))[:-1:2]


def _replaced(texts: pa.Array, at: pa.Array, new: pa.Array) -> pa.Array:
    changed = np.zeros(len(texts), dtype=bool)
    changed[at.to_numpy()] = True
    return pc.replace_with_mask(texts, pa.array(changed), new)


def _folded(text: str) -> str:
    """Lower case, also of the two characters beyond ASCII which match ASCII letters without regard to case."""
    return text.lower().replace("\u017f", "s").replace("\u212a", "k")


def _may_make(marker: str, needle: str) -> bool:
    """Whether a text may hold a string, once a match has become the marker, that it did not hold before."""
    inside = marker in needle or needle in marker
    return inside or any(marker.startswith(needle[i:]) or marker.endswith(needle[:i]) for i in range(1, len(needle)))


@dataclass(frozen=True)
class Plan:
    """A pack as a task runs it: per rule expression, marker, Luhn check, screen (-1 for none) and what its marker may bring
    about (needed string and screen); the screens; the longest needed string."""

    rules: tuple[tuple[str, str, bool, int, tuple[tuple[str, int], ...]], ...]
    screens: tuple[str, ...]
    reach: int


def planned(rules: Sequence[Rule]) -> Plan:
    """Rules that need strings share screens by eights, long strings first, since these are rare."""
    order = sorted((i for i, r in enumerate(rules) if r.needs), key=lambda i: (-min(map(len, rules[i].needs)), i))
    groups = [order[i:i + GROUP] for i in range(0, len(order), GROUP)]
    groups = [g for g in groups if len(g) > 1]
    needles = [sorted({n for i in g for n in rules[i].needs}) for g in groups]
    screens = ["(?i)" + "|".join(map(re.escape, n)) for n in needles]
    of_rule = {i: k for k, g in enumerate(groups) for i in g}
    foreign = [i for i, r in enumerate(rules) if r.non_ascii and i not in of_rule]
    if len(foreign) > 1:
        of_rule |= dict.fromkeys(foreign, len(screens))
        screens.append(BEYOND_ASCII)
        foreign_screen = len(screens) - 1
    else:
        foreign_screen = -1

    def brings(marker: str) -> tuple[tuple[str, int], ...]:
        made = [(_folded(n), k) for k, group in enumerate(needles) for n in group if _may_make(_folded(marker), _folded(n))]
        return (*made, *([("", foreign_screen)] if foreign_screen >= 0 and not marker.isascii() else []))

    made = {m: brings(m) for m in {r.marker for r in rules}}
    reach = max((len(n) for group in needles for n in group), default=0)
    return Plan(tuple((r.regex, r.marker, r.luhn, of_rule.get(i, -1), made[r.marker]) for i, r in enumerate(rules)), tuple(screens), reach)


def _held(texts: pa.Array, screens: Sequence[str]) -> list[np.ndarray]:
    """Per screen, which texts it matches."""
    found = []
    for screen in screens:
        found.append(np.zeros(len(texts), dtype=bool))
        found[-1][matching(texts, screen).to_numpy()] = True
    return found


def _tried(texts: pa.Array, regex: str, where: np.ndarray | None) -> pa.Array:
    """Numbers of the texts which an expression matches, of those worth trying."""
    if where is None or where.all():
        return matching(texts, regex)
    rows = np.flatnonzero(where)
    return pa.array(rows[matching(texts.take(pa.array(rows)), regex).to_numpy()])


def _seams(parts: list[str], reach: int) -> str:
    """A text that was put together anew, without what lies far from what was put in."""
    return "".join(p if i % 2 or len(p) <= 2 * reach else f"{p[:reach]}\0{p[-reach:]}" for i, p in enumerate(parts))


def _run(texts: pa.Array, leet: pa.Array | None, plan: Plan, first_only: bool) -> tuple[pa.Array, list[list[tuple]]]:
    """The texts after the rules, and the hits of each."""
    hits: list[list[tuple]] = [[] for _ in range(len(texts))]
    held = _held(texts, plan.screens)
    held_leet = [] if leet is None else _held(leet, plan.screens)
    for k, (regex, marker, luhn, screen, brings) in enumerate(plan.rules):
        at = _tried(texts, regex, held[screen] if screen >= 0 else None)
        if len(at) and first_only:
            for row in at.to_pylist():
                hits[row].append((k, 0, True))
        if len(at):
            new = []
            for row, parts in zip(at.to_pylist(), cut(texts.take(at), regex), strict=True):
                ok = [not luhn or _luhn(m) for m in parts[1::2]]
                if not first_only:
                    hits[row] += [(k, start, good) for start, good in zip(_starts(parts), ok, strict=True)]
                parts[1::2] = [marker if good else m for m, good in zip(parts[1::2], ok, strict=True)]
                new.append("".join(parts))
                if brings:
                    seams = _folded(_seams(parts, plan.reach))
                    for needle, other in brings:
                        if needle in seams:
                            held[other][row] = True
            texts = _replaced(texts, at, pa.array(new, pa.string()))
        if leet is not None:
            # While both texts are the same the second can add nothing.
            at = _tried(leet, regex, held_leet[screen] if screen >= 0 else None)
            at = at.filter(pc.not_equal(texts.take(at), leet.take(at)))
            if len(at):
                for row, parts in zip(at.to_pylist(), cut(leet.take(at), regex), strict=True):
                    seen = {start for rule, start, _ in hits[row] if rule == k}
                    hits[row] += [(k, start, True) for start in _starts(parts) if start not in seen]
    return texts, hits


def _hit_lists(hits: list[list[tuple]]) -> pa.Array:
    rule, pos, ok = zip(*[h for each in hits for h in each], strict=True) if any(hits) else ((), (), ())
    columns = [pa.array(rule, pa.int64()), pa.array(pos, pa.int32()), pa.array(ok, pa.bool_())]
    ends = pa.array([0, *accumulate(map(len, hits))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["rule", "pos", "ok"]))


def _slices(texts: pa.Array, leet: pa.Array | None, plan: Plan, first_only: bool) -> Iterator[tuple[pa.Array, pa.Array]]:
    """A pack over a batch of texts, some rows at a time: the texts and the lists of hits."""
    texts, leet = texts.cast(pa.string()), None if leet is None else leet.cast(pa.string())
    for i in range(0, len(texts), ROWS):
        text, hits = _run(texts.slice(i, ROWS), None if leet is None else leet.slice(i, ROWS), plan, first_only)
        yield text, _hit_lists(hits)


def _pack(plan: Plan, first_only: bool, with_text: bool) -> Callable[..., pa.Array]:
    """What a task does with a batch: `struct(text, hits)`, or the hits alone."""

    def work(texts: pa.Array, leet: pa.Array | None = None) -> pa.Array:
        slices = _slices(texts, leet, plan, first_only)
        if with_text:
            done = [pa.StructArray.from_arrays([text, hits], ["text", "hits"]) for text, hits in slices]
        else:
            done = [hits for _, hits in slices]
        return pa.concat_arrays(done) if done else pa.array([], RESULT if with_text else RESULT.field("hits").type)

    return work


def _function(text: str, rules: Sequence[Rule], first_only: bool, leet: str | None, with_text: bool) -> Column:
    plan = planned(rules)
    inputs = [valid(F.expr(t)) for t in (text, leet) if t is not None]
    result = f"struct<text:string,hits:{HITS}>" if with_text else HITS
    if leet is None:
        run = F.arrow_udf(lambda t: _pack(plan, first_only, with_text)(t), result)
    else:
        run = F.arrow_udf(lambda t, other: _pack(plan, first_only, with_text)(t, other), result)
    return run(*inputs)


def apply_rules(text: str, rules: Sequence[Rule], *, first_only: bool = False, leet: str | None = None) -> Column:
    """`struct(text, hits)` after the rules have run over the SQL expression `text` in order.

    A hit is `(rule, pos, ok)`: rule number, start in characters from 0 in the text of that step, and
    false for a match which failed its check. With `first_only` a rule gives one hit, position 0.
    `leet` names a second text which is searched as well; only starts not yet seen are added.
    """
    return _function(text, rules, first_only, leet, with_text=True)


def rule_hits(text: str, rules: Sequence[Rule], *, first_only: bool = False, leet: str | None = None) -> Column:
    """The hits of `apply_rules`; the rewritten texts stay in the task that searches them."""
    return _function(text, rules, first_only, leet, with_text=False)


def hit_rules(texts: pa.Array, plan: Plan) -> list[list[int]]:
    """Numbers of the rules which match the texts as they stand."""
    found: list[list[int]] = [[] for _ in range(len(texts))]
    held = _held(texts, plan.screens)
    for k, (regex, _, _, screen, _) in enumerate(plan.rules):
        for row in _tried(texts, regex, held[screen] if screen >= 0 else None).to_pylist():
            found[row].append(k)
    return found


def matching_rules(text: str, rules: Sequence[Rule]) -> Column:
    """Numbers of the rules which match the SQL expression `text` as it stands."""
    plan = planned(rules)
    return F.arrow_udf(lambda t: pa.array(hit_rules(t.cast(pa.string()), plan), pa.list_(pa.int64())), "array<bigint>")(valid(F.expr(text)))


def rule_column(rules: Sequence[Rule], attribute: str, index: Column) -> Column:
    """An attribute of the rule with a given number."""
    return F.element_at(texts([getattr(r, attribute) for r in rules]), (index + 1).cast("int"))


def explode_hits(df: DataFrame, hits: str, rules: Sequence[Rule], keep: Sequence[str], type_prefix: str) -> DataFrame:
    """One row per hit: the kept columns, `type`, `pattern`, `severity`, `position`."""
    hit = F.col("_hit")
    name = rule_column(rules, "name", hit["rule"])
    return df.select(*keep, F.explode(hits).alias("_hit")).select(
        *keep,
        F.concat(F.lit(type_prefix), name).alias("type"),
        name.alias("pattern"),
        rule_column(rules, "severity", hit["rule"]).alias("severity"),
        hit["pos"].cast("bigint").alias("position"),
    )
