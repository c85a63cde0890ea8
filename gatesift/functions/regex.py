"""RE2 patterns on the JVM's regular-expression engine.

Patterns are written in RE2 dialect, in which they were tuned. `to_java` rewrites, once per query,
the few constructs on which `java.util.regex` differs.
"""

from __future__ import annotations

import re
from functools import lru_cache

WORD = "[0-9A-Za-z_]"
SPACE = r"\t\n\f\r "
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"


def _tokens(pattern: str) -> list[str]:
    """Escapes, whole character classes and single characters, in order."""
    return re.findall(r"\\x\{[0-9A-Fa-f]+\}|\\.|\[\^?\]?(?:\\x\{[0-9A-Fa-f]+\}|\\.|[^\]\\])*\]|.", pattern, re.S)


def _java_class(token: str) -> str:
    body = token[1:-1]
    negated = body.startswith("^")
    body = body[1:] if negated else body
    parts = re.findall(r"\\x\{[0-9A-Fa-f]+\}|\\.|.", body, re.S)
    inside = {r"\s": SPACE, r"\S": f"[^{SPACE}]", "[": r"\[", "&": r"\&"}
    out = [inside.get(p, p) for p in parts]
    return "[" + ("^" if negated else "") + "".join(out) + "]"


def _is_word(token: str) -> bool:
    return token in (r"\d", r"\w") or (len(token) == 1 and bool(re.match(WORD, token)))


# Characters beyond ASCII which RE2 takes for a letter where case does not matter; the JVM folds ASCII only.
FOLDS = {"s": r"\x{17F}", "k": r"\x{212A}"}


def _folded_class(token: str) -> str:
    """A class, or an escape for one, which also holds the characters that fold to its letters."""
    body = token[1:-1].removeprefix("^") if token.startswith("[") else token
    test = re.compile("[" + re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), body).replace("[", r"\[") + "]", re.A)
    more = "".join(c for letter, c in FOLDS.items() if test.match(letter) or test.match(letter.upper()))
    if not token.startswith("["):
        return f"[{token}{more}]" if more else token
    whole = _java_class(token)
    return f"[^{more}{whole[2:]}" if whole.startswith("[^") else f"[{more}{whole[1:]}"


@lru_cache(maxsize=None)
def to_java(pattern: str) -> str:
    """The same language, leftmost match and captures, for `java.util.regex`."""
    tokens = _tokens(pattern)
    anycase = bool(re.search(r"\(\?[a-z]*i", pattern))
    out: list[str] = []
    in_flags = False
    for i, t in enumerate(tokens):
        if t == "?" and i and tokens[i - 1] == "(":
            in_flags = True
        elif in_flags:
            in_flags = t not in (")", ":", ">", "=", "!")
        elif anycase and t.lower() in FOLDS:
            out.append(f"[{t}{FOLDS[t.lower()]}]")
            continue
        if t.startswith("[") and len(t) > 1:
            out.append(_folded_class(t) if anycase else _java_class(t))
        elif anycase and t == r"\w":
            out.append(_folded_class(t))
        elif anycase and t == r"\W":
            out.append(r"[^\w" + "".join(FOLDS.values()) + "]")
        elif t == r"\s":
            out.append(f"[{SPACE}]")
        elif t == r"\S":
            out.append(f"[^{SPACE}]")
        elif t == r"\b":
            before = tokens[i - 1] if i else ""
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            if _is_word(after) and not (anycase and after.lower() in FOLDS):
                out.append(f"(?<!{WORD})")
            elif _is_word(before) and not (anycase and before.lower() in FOLDS):
                out.append(f"(?!{WORD})")
            else:
                out.append(BOUNDARY)
        elif t == "$":
            out.append(r"\z")
        else:
            out.append(t)
    outside = "".join(t for t in tokens if not t.startswith("["))
    flags = "d" + ("u" if anycase and not outside.isascii() else "")
    return f"(?{flags})" + "".join(out)


def low_sql(text: str) -> str:
    """The text in lower case, with what RE2 takes for a letter written as that letter: what needed strings are looked up in."""
    return f"replace(lower({text}), '\u017f', 's')"


def sql_text(value: str) -> str:
    """A Spark SQL string literal for any text. `$` is escaped, since Spark substitutes `${name}` in SQL."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    escaped = escaped.replace("$", "\\u0024")
    return f"'{escaped}'"
