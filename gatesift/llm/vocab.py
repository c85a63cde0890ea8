"""Public vocabularies inside Python workers: loaded once per worker, cut into pieces of bounded size."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle

from gatesift.llm.common import per_worker

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the published pattern of the byte-level pre-tokenizer; letters and digits, the most frequent, come first.
# No two alternatives that changed places can begin with the same character, so the order does not matter.
PRE_TOKEN = r""" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself where it is visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def tokenizer(path: str):
    """The library's tokenizer for a .json vocabulary."""
    from tokenizers import Tokenizer

    return per_worker(("tokenizer", path), lambda: Tokenizer.from_file(path))


def special_tokens(path: str) -> dict[str, int]:
    return per_worker(("special", path), lambda: {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()})


def is_byte_level(path: str) -> bool:
    """True for vocabularies without normalizer whose pre-tokenizer is the published byte-level pattern."""

    def look() -> bool:
        spec = json.loads(tokenizer(path).to_str())
        pre = spec.get("pre_tokenizer") or {}
        simple = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"])
        own = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        return simple and own and not spec.get("normalizer")

    return per_worker(("byte level", path), look)


def fast_encoding(path: str):
    """The same vocabulary in tiktoken, which yields the same ids several times faster; None where the kinds differ."""

    def build():
        if not is_byte_level(path):
            return None
        import tiktoken

        of = byte_characters()
        special = special_tokens(path)
        vocab = json.loads(tokenizer(path).to_str())["model"]["vocab"]
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)

    return per_worker(("encoding", path), build)


BREAK = re.compile(r"(?<=\S) (?=\S)")  # a single space between two words always begins a pre-token


def parts(text: str, size: int) -> Iterator[str]:
    """A long text in pieces of about `size` characters, cut only where a pre-token begins.

    Special tokens of byte-level vocabularies hold no space, so no cut falls inside one.
    """
    start = 0
    while len(text) - start > size and (cut := BREAK.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]
