"""Searches over Arrow batches of texts, with RE2 in linear time, and scalar functions made of them.

NULL text has no match.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Code points in the order in which they are tried as a mark around matches: private use first, then all but backslash and surrogates.
UNUSED = (range(0xF0000, 0xF0100), range(1, 92), range(93, 0xD800), range(0xE000, 0x110000))


def matching(texts: pa.Array, regex: str) -> pa.Array:
    """Numbers of the texts which an expression matches."""
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, regex), False))


def _absent(texts: pa.Array) -> str:
    """A character which none of the texts holds."""
    for point in chain(*UNUSED):
        if not pc.any(pc.match_substring(texts, chr(point))).as_py():
            return chr(point)
    raise ValueError("the texts hold every character")


def cut(texts: pa.Array, regex: str) -> Iterator[list[str]]:
    """Each text cut into what stands between matches and, at odd places, the matches of an expression."""
    mark = _absent(texts)
    for text in pc.replace_substring_regex(texts, regex, f"{mark}\\0{mark}"):
        yield text.as_py().split(mark)


def valid(text: Column) -> Column:
    """The text as Arrow takes it: bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(text)


def has_match(text: Column, regex: str) -> Column:
    def work(t: pa.Array) -> pa.Array:
        return pc.fill_null(pc.match_substring_regex(t.cast(pa.string()), regex), False)

    return F.arrow_udf(lambda t: work(t), "boolean")(valid(text))


def find_all(text: Column, regex: str) -> Column:
    """The matches, in order; none for NULL."""

    def work(t: pa.Array) -> pa.Array:
        texts = t.cast(pa.string())
        found: list[list[str]] = [[] for _ in range(len(texts))]
        at = matching(texts, regex)
        if len(at):
            for row, parts in zip(at.to_pylist(), cut(texts.take(at), regex), strict=True):
                found[row] = parts[1::2]
        return pa.array(found, pa.list_(pa.string()))

    return F.arrow_udf(lambda t: work(t), "array<string>")(valid(text))


def runs_in(texts: pa.Array, blank: str, run: int, min_bytes: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """True where, among more than `min_words` words, one of more than `min_bytes` bytes stands `run` times in a row; how many words there are."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), blank)
    words, row = lists.flatten(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    count = np.bincount(row[size > 0], minlength=len(texts))
    result = np.zeros(len(texts), dtype=bool)
    if len(words) >= run:
        same = pc.equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False) & (row[1:] == row[:-1])
        before = np.concatenate([[0], np.cumsum(same)])
        start = np.flatnonzero(before[run - 1:] - before[: len(before) - run + 1] == run - 1)
        result[row[start[size[start] > min_bytes]]] = True
    return result & (count > min_words), count


def has_run(text: Column, blank: str, run: int, min_bytes: int, min_words: int) -> Column:
    """The first result of `runs_in` as a column."""
    return F.arrow_udf(lambda t: pa.array(runs_in(t.cast(pa.string()), blank, run, min_bytes, min_words)[0]), "boolean")(valid(text))


def compact(texts: pa.Array) -> pa.Array:
    """The same texts in buffers of their own, without what else a slice refers to."""
    return texts.take(pa.array(np.arange(len(texts))))


def slices(texts: pa.Array, rows: int, size: int) -> Iterator[pa.Array]:
    """The texts some rows at a time: at most `rows`, and no more than fit into `size` bytes unless one alone is larger."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts) or not at:
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))), len(texts))
        yield texts.slice(at, stop - at)
        at = max(stop, 1)
