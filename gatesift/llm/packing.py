"""Packing documents into sequences of fixed capacity, online and in bounded space.

Every partition keeps a fixed number of open windows. A document's tokens (its ids and an end id) first fill whole
sequences; what is left is put into the open window with the least room that still holds it. When none holds it and no
more may be opened, the fullest window goes out: as it is when at most `waste` places are free, else filled to the
brim with the first tokens of the piece at hand. At the end the open windows of all partitions are merged, `fan_in`
partitions in a group, level by level until one group is left; a group holds at most fan_in * open_windows * capacity
tokens, however large the corpus.

NULL text counts as empty: it still has its end id. Repeated rows are packed each for itself. An empty table gives no
piece. Ids are those of the `tokenizers` library for the vocabulary file; byte-level vocabularies are run by tiktoken
over the same file, which gives the same ids faster (tests compare both), others by `tokenizers` itself.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm import vocab
from gatesift.llm.common import plain, saved, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 1024
OPEN_WINDOWS = 64
WASTE = 8  # free places with which a window may go out
FAN_IN = 64
END_ID = 0
PART = 1_000_000  # characters which are encoded at once

Piece = tuple[Any, int, int, np.ndarray]  # document id, start, tokens of the document, ids


def token_ids(text: str, path: str, end_id: int = END_ID) -> np.ndarray:
    """Ids of a text and the end id, as unsigned 32-bit numbers."""
    fast = vocab.fast_encoding(path)
    out = []
    for part in vocab.parts(text, PART) if fast else [text]:
        ids = None
        if fast:
            try:
                ids = fast.encode_to_numpy(part, allowed_special="all")
            except ValueError:  # its pattern engine gives up on very long runs of white space
                ids = None
        if ids is None:
            ids = vocab.tokenizer(path).encode(part, add_special_tokens=False).ids
        out.append(np.asarray(ids, dtype="<u4"))
    return np.concatenate([*out, np.array([end_id], dtype="<u4")])


class Packer:
    """The open windows of one partition; finished sequences are lists of pieces."""

    def __init__(self, capacity: int, open_windows: int, waste: int):
        self.capacity, self.most, self.waste = capacity, open_windows, waste
        self.windows: list[tuple[int, list[Piece]]] = []  # free places, pieces

    def add(self, doc: Any, start: int, total: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Places ids of a document which begin at `start`; yields the sequences that are finished by it."""
        at = 0
        while len(ids) - at >= self.capacity:
            yield [(doc, start + at, total, ids[at : at + self.capacity])]
            at += self.capacity
        while at < len(ids):
            need = len(ids) - at
            fits = [(free, i) for i, (free, _) in enumerate(self.windows) if free >= need]
            if fits:
                free, i = min(fits)
                self.windows[i][1].append((doc, start + at, total, ids[at:]))
                if free == need:
                    yield self.windows.pop(i)[1]
                else:
                    self.windows[i] = (free - need, self.windows[i][1])
                return
            if len(self.windows) < self.most:
                self.windows.append((self.capacity - need, [(doc, start + at, total, ids[at:])]))
                return
            free, i = min((free, i) for i, (free, _) in enumerate(self.windows))
            full = self.windows.pop(i)[1]
            if free > self.waste:
                full.append((doc, start + at, total, ids[at : at + free]))
                at += free
            yield full

    def drain(self) -> Iterator[list[Piece]]:
        """Pours the open windows together, fullest first; only the last sequence may be left with room."""
        room, current = self.capacity, []
        for _, pieces in sorted(self.windows, key=lambda w: w[0]):
            for doc, start, total, ids in pieces:
                at = 0
                while at < len(ids):
                    take = ids[at : at + room]
                    current.append((doc, start + at, total, take))
                    at, room = at + len(take), room - len(take)
                    if not room:
                        yield current
                        room, current = self.capacity, []
        self.windows = []
        if current:
            yield current


def _rows(sequence: list[Piece], sequence_id: int, is_open: bool, keep_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc, start, total, ids in sequence:
        raw = ids.astype("<u4").tobytes()
        yield doc, start, len(ids), zlib.crc32(raw), total, sequence_id, offset, is_open, raw if keep_ids or is_open else None
        offset += len(ids)


COLUMNS = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "is_open", "ids", "part"]


def _table(rows: list[tuple], part: int, kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.bool_(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
    arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int64())], COLUMNS)


def _packed(path: str, capacity: int, open_windows: int, waste: int, end_id: int, keep_ids: bool) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, number, out, kind = Packer(capacity, open_windows, waste), part << 33, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), path, end_id)
                for sequence in packer.add(doc.as_py(), 0, len(ids), ids):
                    out += _rows(sequence, number, False, keep_ids)
                    number += 1
                if len(out) >= 4096:
                    yield _table(out, part, kind)
                    out = []
        for _, pieces in packer.windows:
            out += _rows(pieces, number, True, keep_ids)
            number += 1
        if out:
            yield _table(out, part, kind)

    return pack


def _merged(level: int, capacity: int, open_windows: int, waste: int, last: bool, keep_ids: bool) -> Callable:
    """Merges the open windows of one group; all but the last window leave it as finished sequences."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        packer, done = Packer(capacity, open_windows, waste), []
        for doc, start, total, raw in rows.sort_values(["sequence_id", "offset"])[["doc", "start", "doc_tokens", "ids"]].itertuples(index=False):
            done += packer.add(doc, int(start), int(total), np.frombuffer(raw, dtype="<u4"))
        done += packer.drain()
        number = (level << 58) + (group << 33)
        out = []
        for i, sequence in enumerate(done):
            size = sum(len(p[3]) for p in sequence)
            is_open = not last and i == len(done) - 1 and size < capacity
            out += _rows(sequence, number + i, is_open, keep_ids)
        frame = pd.DataFrame(out, columns=COLUMNS[:-1])
        frame["part"] = group
        return frame

    return merge


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS,
    waste: int = WASTE, fan_in: int = FAN_IN, end_id: int = END_ID, keep_ids: bool = True,
) -> DataFrame:
    """Pieces of documents in sequences: id, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`, `ids`.

    `ids` are the piece's ids, little-endian unsigned 32-bit (NULL without `keep_ids`). Each pass is written before the
    next begins, so that a task which runs again cannot change what others have used.
    """
    rows = plain(docs, id_col, text_col).select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, is_open boolean, ids binary, part bigint"
    packed = saved(rows.mapInArrow(_packed(path, capacity, open_windows, waste, end_id, keep_ids), schema))
    done = packed.filter("not is_open")
    groups, level = (packed.agg(F.max("part")).first()[0] or 0) + 1, 0
    while True:
        level += 1
        groups = -(-groups // fan_in)
        merge = _merged(level, capacity, open_windows, waste, groups == 1, keep_ids)
        to = F.expr(f"part div {fan_in}").cast("long").alias("group")
        packed = saved(packed.filter("is_open").groupBy(to).applyInPandas(merge, schema))
        done = done.unionByName(packed.filter("not is_open"))
        if groups == 1:
            break
    return done.select(F.col("doc").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per sequence its number of tokens, the padding to the capacity (none at a power of two) and the ids in order."""
    by_place = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), by_place.alias("_pieces"))
    whole = F.aggregate("_pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    power = F.bit_count("n_tokens") == 1
    return rows.select("sequence_id", "n_tokens", F.when(power, 0).otherwise(capacity - F.col("n_tokens")).alias("padding"), whole.alias("ids"))
