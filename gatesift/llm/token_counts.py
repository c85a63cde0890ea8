"""Token counts from pre-tokens: each distinct pre-token of the corpus is counted once, documents join these numbers.

A first pass finds the distinct pre-tokens with their frequencies; every one is encoded once, only the number of its
pieces is kept, and the table is saved. A second pass gives the frequency of every pre-token per document; these are
joined to the table and summed. Pre-tokens that hold more than a `COMMON`th of all occurrences are fewer than `COMMON`
and have keys of bounded length, so they travel with the second pass: most occurrences are summed where they are read.
The others are shuffled by pre-token, once, and none of them is hot. No ids are kept. A vocabulary which is not
byte-level is asked for the pre-tokens by its own pre-tokenizer.

NULL text counts as empty and has no tokens; a NULL id is kept as it is; rows that repeat an id or a text each get their
own count; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm import vocab
from gatesift.llm.common import lean, plain, saved, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4_000_000  # characters of the documents whose frequencies a task holds at a time
HELD = 200_000  # distinct pre-tokens which a task of the first pass sums up before it hands them on
COMMON = 1 << 20  # a pre-token with more than 1/COMMON of all occurrences is common
LONG = 24  # characters; a longer pre-token has its SHA-256 for key, which no shorter one can equal


class PreTokens:
    """Pre-tokens of a text, for a vocabulary file."""

    def __init__(self, path: str):
        import regex

        self.path = path
        self.special = vocab.special_tokens(path)
        self.byte_level = vocab.is_byte_level(path)
        self.find = regex.compile(vocab.PRE_TOKEN).findall
        self.split = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None

    def of(self, text: str, block: int) -> tuple[Iterator[list[str]], int]:
        """Lists of pre-tokens, each from a bounded part of the text, and how many special tokens the text has."""
        segments = self.split(text) if self.split else [text]
        return (found for segment in segments for found in self._lists(segment, block)), len(segments) - 1

    def _lists(self, segment: str, block: int) -> Iterator[list[str]]:
        if self.byte_level:
            for part in vocab.parts(segment, block):
                yield self.find(part)
        else:
            tk = vocab.tokenizer(self.path)
            whole = tk.normalizer.normalize_str(segment) if tk.normalizer else segment
            yield [p for p, _ in tk.pre_tokenizer.pre_tokenize_str(whole)]


def key_of(pre_token: str) -> str:
    return pre_token if len(pre_token) <= LONG else hashlib.sha256(pre_token.encode()).hexdigest()


def _distinct(path: str, block: int, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """First pass: `key`, `whole` (a long pre-token itself, else NULL) and `n`, summed up within the task."""

    def out(found: Counter) -> pa.RecordBatch:
        keys = [key_of(p) for p in found]
        whole = [p if len(p) > LONG else None for p in found]
        columns = [pa.array(keys, pa.string()), pa.array(whole, pa.string()), pa.array(list(found.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["key", "whole", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre_tokens = PreTokens(path)
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for several in pre_tokens.of(text.as_py(), block)[0]:
                    found.update(several)
                    if len(found) > held:
                        yield out(found)
                        found = Counter()
        yield out(found)

    return lean(work)


def _encoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to distinct pre-tokens how many pieces each has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = vocab.tokenizer(path)
        byte_level = vocab.is_byte_level(path)
        for batch in batches:
            keys, whole = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [k if w is None else w for k, w in zip(keys, whole, strict=True)]
            if byte_level:
                counts = [len(e) for e in tk.encode_batch_fast(texts, add_special_tokens=False)]
            else:
                counts = [len(tk.model.tokenize(p)) for p in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["key", "n", "pieces"])

    return lean(work)


def pre_token_table(texts: DataFrame, path: str, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """Saved table of the distinct pre-tokens of a column `text`: `key`, occurrences `n` and number of `pieces`, one row each."""
    found = texts.select("text").mapInArrow(_distinct(path, block, held), "key string, whole string, n bigint")
    summed = found.groupBy("key", "whole").agg(F.sum("n").alias("n"))
    return saved(summed.mapInArrow(_encoded(path), "key string, n bigint, pieces bigint"))


def _counted(pre_tokens: PreTokens, text: str, block: int) -> Iterator[tuple[int, Counter]]:
    """Special tokens and frequencies of a text; of a very long one in several parts, of which the first has the special tokens."""
    lists, special = pre_tokens.of(text, block)
    found: Counter = Counter()
    seen = 0
    for several in lists:
        found.update(several)
        seen += len(several)
        if seen * 4 > block:
            yield special, found
            found, seen, special = Counter(), 0, 0
    yield special, found


def _frequencies(path: str, block: int, common: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Second pass: per row, or part of a very long one, its number, id, size, tokens of special and `common` pre-tokens, other keys and their frequencies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre_tokens = PreTokens(path)
        common_keys, pieces = (common.column(c).combine_chunks() for c in ("key", "pieces"))
        for batch in batches:
            parts = ((i, *part) for i, text in enumerate(batch.column(3)) for part in _counted(pre_tokens, text.as_py(), block))
            for several in _blocks(parts, block):
                source, special, found = zip(*several, strict=True)
                at = pa.array(source, pa.int64())
                ends = np.array([0, *accumulate(map(len, found))])
                keys = pa.array([k for f in found for k in (f if max(map(len, f), default=0) <= LONG else map(key_of, f))], pa.string())
                counts = pa.array([n for f in found for n in f.values()], pa.int64())
                known = pc.index_in(keys, value_set=common_keys)
                tokens = _sums(counts.to_numpy() * pieces.take(known).fill_null(0).to_numpy(), ends) + np.array(special)
                is_rare = known.is_null()
                rare_ends = np.concatenate(([0], np.cumsum(is_rare.to_numpy(zero_copy_only=False))))[ends]
                lists = [pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), c.filter(is_rare)) for c in (keys, counts)]
                columns = [batch.column(i).take(at) for i in range(3)] + [pa.array(tokens, pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_bytes", "tokens", "keys", "counts"])

    return lean(work)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of values between neighbouring ends; an empty run has 0."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[ends])


def _blocks(parts: Iterator[tuple[int, int, Counter]], block: int) -> Iterator[list[tuple[int, int, Counter]]]:
    """Parts whose frequencies, taken together, are of bounded size."""
    waiting: list[tuple[int, int, Counter]] = []
    size = 0
    for part in parts:
        waiting.append(part)
        size += len(part[2])
        if size * 8 > block:
            yield waiting
            waiting, size = [], 0
    if waiting:
        yield waiting


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, block: int = BLOCK, common: int = COMMON
) -> DataFrame:
    """Per row of `docs`: id, `n_bytes` (UTF-8), `n_tokens` and `over_limit`. `path` names the vocabulary on every executor."""
    rows = plain(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"), text_or_empty(text_col).alias("text"),
    )
    known = pre_token_table(rows, path, block)
    total = known.agg(F.sum("n")).first()[0] or 0
    is_common = F.col("n") * common > total
    frequent = known.filter(is_common).select("key", "pieces").toArrow()
    rare = known.filter(~is_common).select(F.col("key").alias("_rare"), "pieces")

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row bigint, id {kind}, n_bytes bigint, tokens bigint, keys array<string>, counts array<bigint>"
    of_each = rows.mapInArrow(_frequencies(path, block, frequent), schema)
    # The entry without a key stands for the row itself: its id, size and the tokens known so far. Its own key keeps such rows
    # from meeting in one task, and no pre-token has it.
    own = F.concat(F.lit("\n" * (LONG + 1)), F.col("row").cast("string"))
    itself = F.struct(own.alias("keys"), F.col("tokens").alias("counts"))
    each = of_each.select("row", "id", "n_bytes", F.posexplode(F.concat(F.array(itself), F.arrays_zip("keys", "counts"))).alias("at", "of"))
    of_row = {c: F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("id", "n_bytes")}
    entries = each.select("row", of_row["id"], of_row["n_bytes"], F.col("of.keys").alias("key"), F.col("of.counts").alias("n"))
    counted = entries.join(rare, F.col("key") == F.col("_rare"), "left")
    tokens = counted.groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"),
    )
    return tokens.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
