"""Benchmark passages in documents, found by one Aho-Corasick automaton over normalised benchmark texts.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. A window is `length`
consecutive words of an item; an item of fewer words, but at least one, is one window. All windows of all items make up
one automaton, which reads every document once; a match is mapped from the normalised text to words and to characters
of the original. Benchmark texts are a bounded side: their windows are cut into blocks of at most `block` characters,
one automaton and one pass each, so that a worker's memory does not depend on the size of the benchmark.

NULL texts have no words; items without words or without id count for nothing; items that repeat an id are taken
together. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import per_worker, plain, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
BLOCK = 1_500_000  # characters of windows in one automaton, some 100 MB of nodes

_WORD_BYTE = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
TO_WORDS = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTE else 0x20 for b in range(256))

HIT = pa.struct([(n, pa.string() if n == "item" else pa.int64()) for n in ("item", "first_word", "last_word", "start", "end")])
HITS = "array<struct<item: string, first_word: bigint, last_word: bigint, start: bigint, end: bigint>>"


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8."""
    return raw.translate(TO_WORDS).split()


def windows_of(items: list[tuple[str, str | None]], length: int) -> dict[str, tuple[str, ...]]:
    """Window, spaces around it, UTF-8 bytes as characters, to the ids of the items which hold it."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        for i in range(max(1, len(words) - length + 1) if words else 0):
            found.setdefault((b" " + b" ".join(words[i : i + length]) + b" ").decode("latin-1"), set()).add(item)
    return {w: tuple(sorted(ids)) for w, ids in found.items()}


def blocks_of(windows: dict[str, tuple[str, ...]], block: int) -> list[dict[str, tuple[str, ...]]]:
    out, size = [{}], 0
    for window in sorted(windows):
        if size + len(window) > block and out[-1]:
            out.append({})
            size = 0
        out[-1][window] = windows[window]
        size += len(window)
    return out


def automaton(windows: dict[str, tuple[str, ...]]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for window, items in windows.items():
        built.add_word(window, (window.count(" ") - 1, items))
    built.make_automaton()
    return built


def find_hits(raw: bytes, searcher) -> tuple[int, list[dict]]:
    """Number of words, and per item the maximal spans covered by its windows: words (last included), characters (end not)."""
    words = words_of(raw)
    normal = (b" " + b" ".join(words) + b" ").decode("latin-1")
    matches = list(searcher.iter(normal)) if len(searcher) else []
    if not matches:
        return len(words), []
    spaces = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
    spans: dict[str, list[list[int]]] = {}
    for end, (length, items) in matches:
        last = int(np.searchsorted(spaces, end)) - 1
        first = last - length + 1
        for item in items:
            own = spans.setdefault(item, [])
            if own and first <= own[-1][1] + 1:
                own[-1][1] = max(own[-1][1], last)
                own[-1][0] = min(own[-1][0], first)
            else:
                own.append([first, last])
    original = np.frombuffer(raw, np.uint8)
    inside = np.frombuffer(raw.translate(TO_WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    characters = np.concatenate(([0], np.cumsum((original & 0xC0) != 0x80)))
    return len(words), [
        {"item": item, "first_word": a, "last_word": b, "start": int(characters[starts[a]]), "end": int(characters[ends[b]])}
        for item, own in sorted(spans.items()) for a, b in own
    ]


def _scan(windows: dict[str, tuple[str, ...]], key: str, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = per_worker(("windows", key), lambda: automaton(windows))
        for batch in batches:
            counts, hits = [], []
            for raw, before in zip(batch.column(1).cast(pa.binary()), batch.column(3), strict=True):
                n, found = find_hits(raw.as_py(), searcher)
                counts.append(n)
                hits.append((before.as_py() if len(before) else []) + found)
            texts = pa.nulls(len(counts), pa.string()) if last else batch.column(1)  # no later pass reads them
            columns = [batch.column(0), texts, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(HIT))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_text", "n_words", "hits"])

    return scan


def benchmark_blocks(benchmark: DataFrame, item_id: str, item_text: str, length: int, block: int) -> list[dict[str, tuple[str, ...]]]:
    """The windows of the benchmark in blocks. Benchmarks are question sets; they are read by the driver."""
    rows = benchmark.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    rows = rows.select(F.col(item_id).cast("string"), F.col(item_text)).distinct()
    return blocks_of(windows_of([(r[0], r[1]) for r in rows.toLocalIterator()], length), block)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    length: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """Per row of `docs`: id, `n_words` and `hits`, the spans of words and characters which an item's windows cover."""
    rows = plain(docs, id_col, text_col).select(
        F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast(HITS).alias("hits")
    )
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _text string, n_words bigint, hits {HITS}"
    blocks = benchmark_blocks(benchmark, item_id, item_text, length, block)
    for i, windows in enumerate(blocks):
        rows = rows.mapInArrow(_scan(windows, _key(windows), i == len(blocks) - 1), schema)
    return rows.select(F.col("_id").alias(id_col), "n_words", "hits")


def _key(windows: dict[str, tuple[str, ...]]) -> str:
    import hashlib

    return hashlib.sha256(repr(sorted(windows.items())).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """Per row of `docs`: id, `n_words`, `n_hit`, `n_items`, `items` (sorted as strings), `contaminated`, `hits`."""
    found = benchmark_hits(docs, benchmark, **names)
    ordered = F.array_sort(F.transform("hits", lambda h: F.struct(h["first_word"], h["last_word"])))
    # Words inside the union of the spans: each span, in order, counts what lies beyond the last word seen.
    state = F.struct(F.lit(-1).cast("bigint").alias("seen"), F.lit(0).cast("bigint").alias("n"))
    union = F.aggregate(
        ordered,
        state,
        lambda s, h: F.struct(
            F.greatest(s["seen"], h["last_word"]).alias("seen"),
            (s["n"] + F.greatest(F.lit(0).cast("bigint"), h["last_word"] - F.greatest(s["seen"] + 1, h["first_word"]) + 1)).alias("n"),
        ),
        lambda s: s["n"],
    )
    id_col = found.columns[0]
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    rows = found.select(id_col, "n_words", F.when(F.size("hits") == 0, 0).otherwise(union).cast("bigint").alias("n_hit"), items.alias("items"), "hits")
    return rows.select(
        id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "hits"
    )


def _clean(windows: dict[str, tuple[str, ...]], key: str, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = per_worker(("windows", key), lambda: automaton(windows))
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array([not find_hits(t.as_py() or b"", searcher)[1] for t in texts], pa.bool_()))

    return clean


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """`docs` without those which hold a window of the benchmark; all columns as they were, no shuffle."""
    for windows in benchmark_blocks(benchmark, item_id, item_text, length, block):
        docs = docs.mapInArrow(_clean(windows, _key(windows), docs.columns.index(text_col)), docs.schema)
    return docs
