"""One row of a pattern pack."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A named expression in RE2 dialect with what to record and write for a hit.

    `needs`, `screen` and `by_line` never change a result, only its cost: a hit is possible only
    where the lower-cased text holds one of `needs`, where `screen` matches and, with `non_ascii`, where
    the text has a character beyond ASCII; `by_line` says that
    a hit lies within one line, so lines without a needed string are left out of the search.
    `luhn` keeps a match in place, and marks it unvalidated, unless its digits pass the check.
    """

    name: str
    regex: str
    severity: str = ""
    marker: str = ""
    title: str = ""
    kind: str = ""
    needs: tuple[str, ...] = ()
    screen: str = ""
    by_line: bool = False
    non_ascii: bool = False
    luhn: bool = False
