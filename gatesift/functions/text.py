"""Text normalisation and text statistics as native column expressions.

Every function takes and returns columns; NULL text gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatesift.functions import batches as B
from gatesift.functions.expr import BLANK, fields, let
from gatesift.patterns import content as C

_FULLWIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
_FULLWIDTH_ASCII = "".join(map(chr, range(0x21, 0x7F)))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
# Mathematical bold and bold italic: four runs of 26 letters from U+1D400.
_MATH = "".join(map(chr, range(0x1D400, 0x1D400 + 104)))
# The same white space for RE2, whose `\s` lacks the vertical tab; a run of any ASCII character.
RE2_BLANK = BLANK.replace(r"\s", r"\t\n\x0B\f\r ")
WORD_GAP = f"[{RE2_BLANK}]+"
CHARACTER_RUN = "|".join(f"\\x{{{c:X}}}{{{C.CHAR_RUN}}}" for c in range(128))
FOLD_FROM = "".join(C.CONFUSABLES) + _FULLWIDTH + _MATH
FOLD_TO = "".join(C.CONFUSABLES.values()) + _FULLWIDTH_ASCII + (_UPPER + _LOWER) * 2


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def fold_confusables(text: Column) -> Column:
    """Look-alike letters, full-width and mathematical bold characters as ASCII."""
    return F.when(is_ascii(text), text).otherwise(F.translate(text, FOLD_FROM, FOLD_TO))


def folded_count(text: Column) -> Column:
    """Number of characters which `fold_confusables` changes."""
    rest = F.translate(text, FOLD_FROM, "")
    return F.when(is_ascii(text), F.lit(0)).otherwise(F.char_length(text) - F.char_length(rest))


def normalize_for_match(text: Column) -> Column:
    """Lower-case letters and single spaces only, with leet signs read as letters.

    Punctuation vanishes; a one-letter word joins its successor across exactly one gap, so that
    spaced-out words close up.
    """
    t = F.translate(text, _UPPER + C.LEET_MATCH[0], _LOWER + C.LEET_MATCH[1])
    t = F.regexp_replace(t, r"[\p{C}\p{Z}]", " ")
    t = F.regexp_replace(t, r"[^a-z ]", "")
    t = F.regexp_replace(t, r"(?<![a-z])([a-z]) (?=[a-z])", "$1")
    return F.trim(F.regexp_replace(t, r" {2,}", " "))


def normalize_leet(text: Column) -> Column:
    """Leet signs read as letters, everything else as it is."""
    return F.translate(text, *C.LEET_PROMPT)


def collapse_spacing(text: Column) -> Column:
    """`i g n o r e` as `ignore`: more than three words, all of one character, are joined."""
    joined = let(fields(text), lambda w: F.when(F.size(w) > 3, F.array_join(w, "")).otherwise(text))
    return F.when(F.rlike(text, F.lit(f"[^{BLANK}][^{BLANK}]")), text).otherwise(joined)


def strip_invisible(text: Column) -> Column:
    """Zero-width and direction characters removed, the right-to-left override marked."""
    return F.translate(F.replace(text, F.lit(C.OVERRIDE), F.lit(C.OVERRIDE_MARKER)), C.INVISIBLE, "")


def has_invisible(text: Column) -> Column:
    return F.translate(text, C.OVERRIDE + C.INVISIBLE, "") != text


def query_shape(text: Column) -> Column:
    """Lower case with white space trimmed and collapsed."""
    return F.array_join(fields(F.lower(text)), " ")


def clamp_session_id(value: Column, max_bytes: int) -> Column:
    """First bytes of an identifier without spaces, control and non-ASCII characters."""
    clipped = F.substring(F.encode(value, "UTF-8"), 1, max_bytes).cast("string")
    return F.regexp_replace(F.when(is_ascii(value), F.substring(value, 1, max_bytes)).otherwise(clipped), r"[^\x21-\x7E]", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; no shuffle, the counts are taken inside the row."""
    chars = F.array_distinct(F.split(text, ""))
    size = F.char_length(text).cast("double")

    def share(c: Column) -> Column:
        gone = F.octet_length(text) - F.octet_length(F.replace(text, c, F.lit("")))
        return gone / F.octet_length(c) / size

    return F.aggregate(F.transform(chars, share), F.lit(0.0), lambda s, p: s - p * F.log2(p))


def non_ascii_share(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.char_length(text)


def anomaly_score(text: Column) -> Column:
    """0 for ordinary text, near 1 for random or non-ASCII text; empty text scores 0."""

    def combine(parts: Column) -> Column:
        high = F.least(F.lit(1.0), F.greatest(F.lit(0.0), parts["h"] - C.ENTROPY_BASE) / C.ENTROPY_RANGE)
        return let(high, lambda e: e + (F.lit(1.0) - e) * parts["a"])

    parts = F.struct(entropy(text).alias("h"), non_ascii_share(text).alias("a"))
    return F.when(text == "", F.lit(0.0)).when(text.isNotNull(), let(parts, combine))


def runs(words: Column) -> Column:
    """Runs of equal neighbours in an array as `(word, n)`."""
    last = F.size(words) - 1

    def of_starts(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda s, j: F.struct(
                F.get(words, s).alias("word"), (F.coalesce(F.get(starts, j + 1), F.size(words)) - s).alias("n")
            ),
        )

    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    return F.when(last >= 0, let(starts, of_starts)).otherwise(
        F.expr("cast(array() AS array<struct<word:string,n:int>>)")
    )


def has_repetition(text: Column) -> Column:
    """Fifty equal ASCII characters in a row, or ten equal longer words among more than ten."""
    of_words = B.has_run(text, WORD_GAP, C.WORD_RUN, C.WORD_RUN_MIN_LENGTH, C.WORD_RUN_MIN_WORDS)
    return F.when(text.isNotNull(), B.has_match(text, CHARACTER_RUN) | of_words)


def limit_repetition(text: Column) -> Column:
    """Long runs of characters and words cut short and marked; white space collapses."""
    shorter = F.regexp_replace(text, r"(?s)(.)\1{10,}", rf"$1$1$1{C.CHAR_RUN_MARKER}")

    def cut(r: Column) -> Column:
        return F.when(r["n"] <= C.WORD_RUN_LIMIT, F.array_repeat(r["word"], r["n"])).otherwise(
            F.array(r["word"], r["word"], F.lit(C.WORD_RUN_MARKER))
        )

    return let(fields(shorter), lambda w: F.array_join(F.flatten(F.transform(runs(w), cut)), " "))


def is_stuffed(text: Column) -> Column:
    """More than 10,000 bytes and more than 2,000 words."""
    words = F.regexp_count(text, F.lit(f"[^{BLANK}]++"))
    return F.when(F.octet_length(text) > C.STUFFING_BYTES, words > C.STUFFING_WORDS).otherwise(F.lit(False))


def truncate_stuffed(text: Column) -> Column:
    """The first 1,000 words and a marker."""
    return F.concat(F.array_join(F.slice(fields(text), 1, C.STUFFING_KEEP), " "), F.lit(" " + C.STUFFING_MARKER))
