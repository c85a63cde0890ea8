"""Ranked lexical search: documents grouped by the mask of an item's terms that they hold, best masks first.

Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. Statistics (documents,
their terms, documents per term) cover the whole corpus. A term's weight is `floor(1000 ln((2N+2)/(2df+1)))`; it counts
`(10**9 tf) div (1000 tf + 12 m)` in a document, where `m` grows with the document's length; a score sums over the item's
terms, repeats included.

A first pass reads every document once and keeps, per document, the terms that any item has with their counts. The
second pass goes through that index in blocks of documents. Every term has a bitmap over the block; an item's bitmaps,
laid over each other, give each document the mask of the item's terms which it holds, and documents are grouped by mask.
No document of a mask can score more than the mask's terms at the largest value each has in the block, so masks are
evaluated by descending maximum, until that maximum is less than the score of the task's `top`-th best document. A task
hands on `top` documents an item; ranks are taken in two steps, so no task sees more than a bounded number per item.

Items are a stated query set: their terms go to the workers in blocks of at most `BLOCK_TERMS` distinct terms, one pass
each; the bound is checked, and an item which alone is above it makes a block of its own. NULL texts have no terms; a
document without terms counts for nothing. Items that repeat an id are one item, their terms added; a NULL item id is an
id like others. NULL document ids come last among equal scores; rows that repeat an id are documents of their own. An
empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatesift.llm.common import plain, saved, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 20
BLOCK_TERMS = 16_000  # terms of the items of one pass
BLOCK_DOCS = 4096  # documents whose bitmaps are held at once, fewer where there are many terms
CELLS = 1 << 26  # bytes of all bitmaps of a block
FIRST = 64  # documents that are scored before the first look at the next maximum

_TERM_BYTE = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
TO_TERMS = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in _TERM_BYTE else 0x20 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return raw.translate(TO_TERMS).split()


def item_terms(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """`_item, _term, _n`: each item's distinct terms and how often it has them."""
    low = F.translate(text_or_empty(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rows = plain(items, item_id, item_text).select(F.col(item_id).alias("_item"), F.explode(words).alias("_term"))
    return rows.groupBy("_item", "_term").agg(F.count("*").alias("_n"))


def item_blocks(terms: DataFrame, most: int) -> Iterator[list]:
    """Items with their terms in blocks of at most `most` terms, read one after the other."""
    per_item = saved(terms.groupBy("_item").agg(F.collect_list(F.struct("_term", "_n")).alias("_terms"), F.count("*").alias("_size")))
    n = -(-(per_item.agg(F.sum("_size")).first()[0] or 0) // most)
    at = lambda: F.pmod(F.xxhash64("_item"), F.lit(n))
    while n and per_item.groupBy(at().alias("b")).agg(F.sum("_size").alias("s"), F.count("*").alias("n")).filter(f"s > {most} and n > 1").limit(1).count():
        n *= 2
    for block in range(n):
        rows = per_item.filter(at() == block).collect()
        if rows:
            yield sorted(((r["_item"], {t["_term"].encode(): t["_n"] for t in r["_terms"]}) for r in rows), key=lambda r: (r[0] is None, r[0]))


def _indexed(number: dict[bytes, int]):
    """Per document its length in terms, and the items' terms in it with their counts. Documents without terms go."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lengths, ids, counts = [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                found = terms_of(text.as_py())
                if not found:
                    continue
                own = Counter(found)
                known = sorted((number[t], n) for t, n in own.items() if t in number)
                kept.append(i)
                lengths.append(len(found))
                ids.append([k for k, _ in known])
                counts.append([n for _, n in known])
            columns = [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_n", "_terms", "_tf"])

    return indexed


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def groups_by_mask(presence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the mask of every document, and a document per mask, of bitmaps over documents (terms by documents)."""
    bits = np.packbits(presence, axis=0)
    words = np.zeros((-(-len(bits) // 8) * 8, bits.shape[1]), np.uint8)
    words[: len(bits)] = bits
    group = np.zeros(bits.shape[1], np.int64)
    for at in range(0, len(words), 8):
        _, own = np.unique(np.ascontiguousarray(words[at : at + 8].T).view(np.uint64).ravel(), return_inverse=True)
        group = np.unique(group * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    _, first = np.unique(group, return_index=True)
    return group, first


class Best:
    """The best documents of an item so far: highest score first, then smallest id, NULL ids last."""

    def __init__(self, top: int):
        self.top, self.ids, self.scores = top, None, np.zeros(0, np.int64)

    def least(self) -> int:
        """The score that a document must reach to come in; any score above 0 while there is room."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        keep = np.flatnonzero(scores >= self.least())
        if not len(keep):
            return
        ids = ids.take(pa.array(keep))
        every = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        scores = np.concatenate((self.scores, scores[keep]))
        table = pa.table({"score": scores, "id": every})
        order = pc.sort_indices(table, sort_keys=[("score", "descending"), ("id", "ascending")])[: self.top]
        self.ids, self.scores = every.take(order), scores[order.to_numpy()]


class Block:
    """The postings of a block of documents: bitmaps per term, values per posting."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int, n_docs: int, n_words: int):
        self.ids = batch.column(0)
        lists = batch.column(2)
        self.offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        self.terms = lists.flatten().to_numpy()
        tf = batch.column(3).flatten().to_numpy()
        m = 100 - 25 + 25 * batch.column(1).to_numpy() * n_docs // n_words
        self.docs = np.repeat(np.arange(len(batch)), np.diff(self.offsets))
        self.values = 10**9 * tf // (1000 * tf + 12 * m[self.docs])
        self.bitmap = np.zeros((n_terms, len(batch)), bool)
        self.bitmap[self.terms, self.docs] = True
        self.most = np.zeros(n_terms, np.int64)  # the largest value of each term in the block
        np.maximum.at(self.most, self.terms, self.values)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; `weights` has 0 for terms which the item lacks."""
        begins, lengths = self.offsets[docs], self.offsets[docs + 1] - self.offsets[docs]
        at = np.repeat(begins - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        sums = np.concatenate(([0], np.cumsum(weights[self.terms[at]] * self.values[at])))
        ends = np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths]


def search_block(block: Block, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: Best) -> int:
    """Adds an item's best documents of a block; returns how many masks were evaluated.

    `terms` and `weights` are the item's terms that weigh anything, with their repeats; `dense` has the weights by term.
    """
    some = np.flatnonzero(block.bitmap[terms].any(axis=0))
    if not len(some):
        return 0
    presence = block.bitmap[np.ix_(terms, some)]
    group, first = groups_by_mask(presence)
    maximum = (weights * block.most[terms]) @ presence[:, first]
    order = np.argsort(-maximum, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_rank = np.argsort(rank[group], kind="stable")  # documents, those of the best mask first
    begins = np.concatenate(([0], np.cumsum(np.bincount(rank[group], minlength=len(order)))))
    done, step = 0, FIRST
    while done < len(order) and maximum[order[done]] >= best.least():
        upto = max(done + 1, int(np.searchsorted(begins, begins[done] + step)))
        # No mask below what is needed now is evaluated, and none after it.
        upto = min(upto, len(order), max(done + 1, int(np.searchsorted(-maximum[order], -best.least(), side="right"))))
        docs = some[by_rank[begins[done] : begins[upto]]]
        best.add(block.ids.take(pa.array(docs)), block.scores(docs, dense))
        done, step = upto, step * 2
    return done


def _searched(queries: list[tuple[np.ndarray, np.ndarray]], n_terms: int, n_docs: int, n_words: int, top: int, block_docs: int):
    """The best documents of each item (by its number) among the documents of a task."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, part, kind = [Best(top) for _ in queries], TaskContext.get().partitionId(), None
        dense = np.zeros(n_terms, np.int64)
        for batch in batches:
            kind = batch.schema.field(0).type
            step = max(1, min(block_docs, CELLS // max(n_terms, 1)))
            for at in range(0, len(batch), step):
                block = Block(batch.slice(at, step), n_terms, n_docs, n_words)
                for (terms, weights), own in zip(queries, best, strict=True):
                    dense[terms] = weights
                    search_block(block, terms, weights, dense, own)
                    dense[terms] = 0
        for i, own in enumerate(best):
            if own.ids is not None and len(own.ids):
                n = len(own.ids)
                columns = [pa.array([i] * n, pa.int32()), pa.array([part] * n, pa.int32()), own.ids.cast(kind), pa.array(own.scores)]
                yield pa.RecordBatch.from_arrays(columns, ["_item", "_part", "_id", "_score"])

    return searched


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    top: int = TOP, block_terms: int = BLOCK_TERMS, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Per item its `top` highest-scoring documents with a score above 0: item id, `rank` (from 1), document id, `score`."""
    spark = docs.sparkSession
    text = plain(docs, id_col, text_col).select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    doc_kind, item_kind = text.schema["_id"].dataType.simpleString(), items.schema[item_id].dataType
    found = spark.createDataFrame([], f"_item {item_kind.simpleString()}, rank int, _id {doc_kind}, score bigint")
    for block in item_blocks(item_terms(items, item_id, item_text), block_terms):
        number = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        index = saved(text.mapInArrow(_indexed(number), f"_id {doc_kind}, _n bigint, _terms array<int>, _tf array<bigint>"))
        n_docs, n_words = index.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
        if not n_words:
            continue
        df = dict(index.select(F.explode("_terms").alias("t")).groupBy("t").count().collect())
        w = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(number))], np.int64)
        queries = []
        for _, own in block:
            terms = np.array(sorted(number[t] for t in own if w[number[t]] > 0 and number[t] in df), np.int64)
            by_number = {number[t]: n for t, n in own.items()}
            queries.append((terms, w[terms] * np.array([by_number[t] for t in terms], np.int64)))
        local = index.mapInArrow(
            _searched(queries, len(number), n_docs, n_words, top, block_docs), f"_item int, _part int, _id {doc_kind}, _score bigint"
        )
        order = (F.desc("_score"), F.asc_nulls_last("_id"), "_part")
        some = local.withColumn("_r", F.row_number().over(Window.partitionBy("_item", F.pmod("_part", F.lit(256))).orderBy(*order))).filter(F.col("_r") <= top)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, b[0]) for i, b in enumerate(block)], f"_number int, _name {item_kind.simpleString()}")
        named = ranked.join(F.broadcast(names), F.col("_item") == F.col("_number"))
        found = found.unionByName(saved(named.select(F.col("_name").alias("_item"), F.col("rank").cast("int").alias("rank"), "_id", F.col("_score").alias("score"))))
    return found.select(F.col("_item").alias(item_id), "rank", F.col("_id").alias(id_col), "score")
