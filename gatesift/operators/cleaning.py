"""The stages of the content pipeline that search and rewrite texts, as one function over batches of texts.

A task needs one Python worker for all of them, and a text is sent to it once, whatever the number of stages: a function per
step would keep a worker per step and task alive, each with libraries and a batch of its own. Batches are worked on some rows
at a time, so what the steps hold in between does not grow with the batch.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Callable, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from gatesift.functions.batches import compact, cut, matching, runs_in, slices, valid
from gatesift.functions.text import CHARACTER_RUN, FOLD_FROM, FOLD_TO, RE2_BLANK, WORD_GAP
from gatesift.operators.rewrite import HITS, ROWS, Plan, _hit_lists, _replaced, _run, hit_rules, planned
from gatesift.patterns import content as C
from gatesift.patterns.indicators import IOC_RULES
from gatesift.patterns.literals import LITERALS
from gatesift.patterns.prompts import PROMPT_RULES
from gatesift.patterns.secrets import SECRET_RULES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 4 << 20  # of texts which the steps run over at a time

# Plain values, since the patterns do not travel to the workers.
FOLD, FOLDABLE = str.maketrans(FOLD_FROM, FOLD_TO), "[" + re.escape(FOLD_FROM) + "]"
BASE64_RUN, BASE64_KEYWORDS = C.BASE64_RUN, tuple(C.BASE64_KEYWORDS)
XSS_INDICATOR, XSS_MARKER, SQL_MARKER = C.XSS_INDICATOR, C.ENCODED_XSS_MARKER, C.SQL_MARKER
GLYPHS, GLYPH = C.HOMOGLYPHS, f"[{C.HOMOGLYPHS}]"
GLYPH_MARKED = str.maketrans(dict.fromkeys(C.HOMOGLYPHS, C.HOMOGLYPH_MARKER))
NEIGHBOURS, GAP = f"[^{RE2_BLANK}][^{RE2_BLANK}]", WORD_GAP
PYTHON_GAP = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WORD_GAP)
LEET = bytes.maketrans(*(s.encode() for s in C.LEET_PROMPT))
CHARACTERS, WORD_RUN, WORD_BYTES, WORDS = CHARACTER_RUN, C.WORD_RUN, C.WORD_RUN_MIN_LENGTH, C.WORD_RUN_MIN_WORDS
STUFFING_BYTES, STUFFING_WORDS = C.STUFFING_BYTES, C.STUFFING_WORDS

# The letters that the literal matcher reads, without anything between them: where a normalised text holds a literal, its
# letters hold the letters of the literal.
_SMALL = bytes(range(ord("a"), ord("z") + 1))
LETTERS = bytes.maketrans(_SMALL.upper() + C.LEET_MATCH[0].encode(), _SMALL + C.LEET_MATCH[1].encode())
NO_LETTERS = bytes(b for b in range(256) if LETTERS[b] not in _SMALL)
LITERAL_LETTERS = "|".join(sorted({re.sub("[^a-z]", "", row[0]) for row in LITERALS}))

BLOBS = pa.list_(pa.struct([("blob", pa.string()), ("pos", pa.int64())]))
STRINGS, NUMBERS = pa.list_(pa.string()), pa.list_(pa.int64())
FIELDS = {
    "commands": {"cmd": HITS},
    "secrets": {"sec": HITS},
    "active": {"xss": HITS, "blobs": "array<string>"},
    "content": {"xss": HITS, "blobs": "array<string>", "sql": "array<bigint>", "glyphs": "array<string>", "form": HITS},
    "prompts": {"b64": "array<struct<blob:string,pos:bigint>>", "prompt": HITS, "ioc": HITS, "literal": "boolean", "repeats": "boolean", "stuffed": "boolean"},
}


def _changed(texts: pa.Array, at: Sequence[int], new: Sequence[str]) -> pa.Array:
    return _replaced(texts, pa.array(at, pa.int64()), pa.array(new, pa.string())) if len(at) else texts


def folded(texts: pa.Array) -> pa.Array:
    """`fold_confusables` over a batch."""
    at = matching(texts, FOLDABLE)
    return _changed(texts, at.to_pylist(), [t.translate(FOLD) for t in texts.take(at).to_pylist()])


def hidden(texts: pa.Array, test: Callable[[list[str]], list[bool]]) -> dict[int, list[str]]:
    """Of each text that has any, the base64 runs, in order, whose decoded form passes a test; one character per byte."""
    rows, blobs = [], []
    at = matching(texts, BASE64_RUN)
    if len(at):
        for row, parts in zip(at.to_pylist(), cut(texts.take(at), BASE64_RUN), strict=True):
            whole = [b for b in parts[1::2] if len(b) % 4 == 0]
            rows += [row] * len(whole)
            blobs += whole
    found: dict[int, list[str]] = {}
    for row, blob, good in zip(rows, blobs, test([base64.b64decode(b).decode("latin-1") for b in blobs]), strict=True):
        if good:
            found.setdefault(row, []).append(blob)
    return found


def _active(bodies: list[str]) -> list[bool]:
    return pc.match_substring_regex(pa.array(bodies, pa.string()), XSS_INDICATOR).to_pylist()


def _injecting(bodies: list[str]) -> list[bool]:
    return [any(k in low for k in BASE64_KEYWORDS) for low in map(str.lower, bodies)]


def _without(texts: pa.Array, blobs: dict[int, list[str]]) -> pa.Array:
    new = []
    for row, found in blobs.items():
        text = texts[row].as_py()
        for blob in found:
            text = text.replace(blob, XSS_MARKER)
        new.append(text)
    return _changed(texts, list(blobs), new)


def _sql(texts: pa.Array, original: pa.Array, plan: Plan) -> tuple[pa.Array, list[list[int]]]:
    """Texts after the SQL pack, and the rules which match them or the original texts.

    Where a signature stands only in the original, because an earlier pack has eaten it, the marker is
    appended, once, unless a rewrite has put it there before.
    """
    out, hits = _run(texts, None, plan, True)
    at, new, rules = [], [], []
    for row, (here, there) in enumerate(zip(([k for k, _, _ in each] for each in hits), hit_rules(original, plan), strict=True)):
        rules.append(sorted({*here, *there}))
        lost = [k for k in there if k not in here]
        if lost and min(lost) < min(here, default=len(plan.rules)) and SQL_MARKER not in texts[row].as_py():
            at.append(row)
            new.append(f"{out[row].as_py()} {SQL_MARKER}")
    return _changed(out, at, new), rules


def _glyphs(texts: pa.Array) -> tuple[pa.Array, list[list[str]]]:
    found: list[list[str]] = [[] for _ in range(len(texts))]
    at = matching(texts, GLYPH).to_pylist()
    held = [texts[row].as_py() for row in at]
    for row, text in zip(at, held, strict=True):
        found[row] = [c for c in GLYPHS if c in text]
    return _changed(texts, at, [text.translate(GLYPH_MARKED) for text in held]), found


def collapsed(texts: pa.Array) -> pa.Array:
    """`collapse_spacing` over a batch."""
    at, new = [], []
    spaced = pc.indices_nonzero(pc.invert(pc.fill_null(pc.match_substring_regex(texts, NEIGHBOURS), True)))
    for row in spaced.to_pylist():
        words = [w for w in re.split(PYTHON_GAP, texts[row].as_py()) if w]
        if len(words) > 3:
            at.append(row)
            new.append("".join(words))
    return _changed(texts, at, new)


def leet(texts: pa.Array) -> pa.Array:
    """`normalize_leet` over a batch: signs of one byte become letters of one byte, so the bytes are mapped as a whole."""
    texts = compact(pc.fill_null(texts, ""))
    _, offsets, data = texts.buffers()
    return pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(data.to_pybytes().translate(LEET) if data else b"")])


def may_hold_literal(texts: pa.Array) -> np.ndarray:
    """True wherever the normalised text holds a literal indicator, and in few other texts."""
    letters = [t.as_buffer().to_pybytes().translate(LETTERS, NO_LETTERS) if t.is_valid else b"" for t in texts]
    found = np.zeros(len(texts), dtype=bool)
    found[matching(pa.array(letters, pa.binary()).cast(pa.string()), LITERAL_LETTERS).to_numpy()] = True
    return found


def heuristics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`has_repetition` and `is_stuffed` over a batch, false for NULL."""
    repeats, words = runs_in(texts, GAP, WORD_RUN, WORD_BYTES, WORDS)
    repeats[matching(texts, CHARACTERS).to_numpy()] = True
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return repeats, (size > STUFFING_BYTES) & (words > STUFFING_WORDS)


def _work(stages: Sequence[str], plans: dict[str, Plan], original: pa.Array) -> dict[str, pa.Array]:
    """A slice of the texts through the stages."""
    texts, out = original, {}
    if "fold" in stages:
        texts = folded(texts)
    for stage, name in (("commands", "cmd"), ("secrets", "sec")):
        if stage in stages:
            texts, hits = _run(texts, None, plans[name], False)
            out[name] = _hit_lists(hits)
    if "active" in stages or "content" in stages:
        texts, hits = _run(texts, None, plans["xss"], True)
        blobs = hidden(texts, _active)
        out |= {"xss": _hit_lists(hits), "blobs": pa.array([blobs.get(i, []) for i in range(len(texts))], STRINGS)}
    if "content" in stages:
        texts, rules = _sql(_without(texts, blobs), original, plans["sql"])
        texts, glyphs = _glyphs(texts)
        texts, hits = _run(texts, None, plans["form"], True)
        out |= {"sql": pa.array(rules, NUMBERS), "glyphs": pa.array(glyphs, STRINGS), "form": _hit_lists(hits)}
    if "prompts" in stages:
        b64: list[list[dict]] = [[] for _ in range(len(texts))]
        for row, found in hidden(texts, _injecting).items():
            b64[row] = [{"blob": b, "pos": texts[row].as_py().find(b)} for b in found]
        texts = collapsed(texts)
        texts, hits = _run(texts, leet(texts), plans["prompt"], False)
        out |= {"b64": pa.array(b64, BLOBS), "prompt": _hit_lists(hits)}
        texts, hits = _run(texts, None, plans["ioc"], False)
        repeats, stuffed = heuristics(texts)
        out |= {"ioc": _hit_lists(hits), "literal": pa.array(may_hold_literal(texts)), "repeats": pa.array(repeats), "stuffed": pa.array(stuffed)}
    return out | {"text": texts}


RULES = {"cmd": C.COMMAND_RULES, "sec": SECRET_RULES, "xss": C.XSS_RULES, "sql": C.SQL_RULES, "form": C.FORMULA_RULES, "prompt": PROMPT_RULES, "ioc": IOC_RULES}


def cleaned(text: str, stages: Sequence[str], with_text: bool = True) -> Column:
    """A struct of what the stages find in the SQL expression `text`, in order, and the `text` that they leave.

    `active` is the first step of `content` alone: active content, as it stands and in base64. `literal` says whether the
    normalised text may hold a literal indicator, `repeats` whether characters or words repeat, `stuffed` whether it is too long.
    """
    kinds = {name: kind for stage, own in FIELDS.items() if stage in stages for name, kind in own.items()} | ({"text": "string"} if with_text else {})
    plans = {name: planned(rules) for name, rules in RULES.items() if name in kinds}
    names, wanted = list(kinds), [s for s in ("fold", *FIELDS) if s in stages]

    def work(texts: pa.Array) -> pa.Array:
        done = []
        for part in slices(texts.cast(pa.string()), ROWS, SLICE_BYTES):
            found = _work(wanted, plans, part)
            done.append(pa.StructArray.from_arrays([found[name] for name in names], names))
        return pa.concat_arrays(done)

    return F.arrow_udf(lambda t: work(t), "struct<" + ",".join(f"{n}:{k}" for n, k in kinds.items()) + ">")(valid(F.expr(text)))
