"""Sets of word shingles as 64-bit numbers, computed for many documents at once."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

from gatesift.llm.common import per_worker

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 16  # bytes that are hashed at once
LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
BLANK = re.compile(rb"[\x20\x09-\x0D]")
BASE = 0x9E3779B97F4A7C15 | 3  # odd, so that it has an inverse modulo 2**64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, powers of the base and of its inverse, and which bytes are no white space."""
    numbers = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    powers = np.full(CHUNK + 1, BASE, dtype=np.uint64)
    powers[0] = 1
    inverse = np.full(CHUNK + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    solid = np.ones(256, dtype=bool)
    solid[[9, 10, 11, 12, 13, 32]] = False
    return numbers, np.multiply.accumulate(powers), np.multiply.accumulate(inverse), solid


def _hash_long(word: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")


def _hash_chunk(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word of a chunk that begins and ends between words."""
    numbers, powers, inverse, solid = per_worker(("shingle tables",), _tables)
    if len(data) > CHUNK:  # one word longer than a chunk, or words around it
        edges = np.flatnonzero(np.diff(np.concatenate(([0], solid[data].view(np.int8), [0]))))
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        return np.array([_hash_long(data[a:b]) if b - a > CHUNK else _hash_chunk(data[a:b])[0][0] for a, b in spans], dtype=np.uint64), edges[::2]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], solid[data].view(np.int8), [0]))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(numbers[data] * powers[: len(data)], dtype=np.uint64)))
    starts, ends = edges[::2], edges[1::2]
    return mixed((sums[ends] - sums[starts]) * inverse[starts]), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of all texts, A-Z in lower case, and the number of the text it is from."""
    whole = b"\n".join(texts).translate(LOWER)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    data = np.frombuffer(whole, np.uint8)
    hashes, places, start = [], [], 0
    while start < len(whole):
        end = start + CHUNK
        if end < len(whole):
            cut = max(whole.rfind(b, start + 1, end) for b in (b" ", b"\n"))
            if cut < 0:
                found = BLANK.search(whole, end)
                cut = found.start() if found else len(whole)
            end = cut
        h, at = _hash_chunk(data[start : min(end, len(whole))])
        hashes.append(h)
        places.append(at + start)
        start = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(offsets, np.concatenate(places), side="right") - 1


def _weights(words: int, size: int) -> np.ndarray:
    """An unrelated odd number per place in a sequence of a size: sums over permuted words differ."""
    return mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(size)) | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingles; a text with fewer words has its whole sequence as one, one without words none."""
    hashes, text = word_hashes(texts)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    total = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k, weight in enumerate(_weights(words, words)):
        total += hashes[k : len(total) + k] * weight
    total = mixed(total)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            yield np.unique(total[a : b - words + 1])
        elif b > a:
            yield mixed(np.sum(hashes[a:b] * _weights(b - a, int(b - a)), dtype=np.uint64, keepdims=True))
        else:
            yield np.zeros(0, np.uint64)
