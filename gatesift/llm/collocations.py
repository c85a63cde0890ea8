"""Phrase collocations: an FM-index over word ids per shard, its intervals extended to both sides, counts summed up.

Words stand in pieces, phrases within a piece; everything is counted per language. A task cuts its documents into
shards of one language of some `SHARD_WORDS` words and indexes each: word ids of its own, the suffixes in order of their first `DEPTH` words, and the
word before each (the Burrows-Wheeler transform). An interval of that order holds the occurrences of a phrase. Stepping
from a phrase to all phrases with one more word on the left is one pass over the transform sorted by word: a run of
equal word and equal interval is the interval of a longer phrase, its length the count. The same suffix order cuts an
interval by the word on its right. Both neighbours of a longer phrase, without its first and without its last word, are
therefore known in place, and a phrase is handed on only if both can still be frequent.

Counts of a depth are summed over shards by Spark. What is frequent in all is told to the next depth by a bitmap of
bounded size: it lets through every frequent phrase and few others, and what is too rare is dropped by its exact count.
Most phrases of a shard are rare, so the shards first sum up counts by a part of each phrase's hash; a second bitmap of
these sums holds back what cannot be frequent, and only the rest is moved as text. No list of phrases is held by anyone.

A phrase of 2 to `DEPTH` words that occurs at least `least` times is a candidate; `l`, `r` and the score are those of the
cut that scores lowest. A candidate goes if a longer one around it has four fifths of its occurrences; only the
extensions by one word on either side can be the most frequent of them, so their counts decide. Ranks are taken in two
steps, so that one language with most of the phrases is no single task.

NULL text counts as empty; NULL language is `und`; texts without words add nothing. Rows that repeat are counted each.
Texts of any length are read whole; a document is never cut in two. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatesift.llm.common import bitmap_of, lean, plain, saved, small_batches, text_or_empty
from gatesift.llm.shingles import mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH = 4  # words of the longest phrase
LEAST = 30  # occurrences of a candidate
SHARD_WORDS = 1 << 19  # words after which a shard is closed
OPEN_WORDS = 3 << 19  # words in the open shards of a task, all languages together
SIEVED = 1 << 20  # phrases of a task that are summed up together
LEAST_RANGES, RANGE_BITS = 256, 20  # ranges of codes whose phrases are summed up apart
RANGE_WORDS = 1 << 19  # words of the input to a range, at most
MAX_BITS = 27  # 16 MB of bitmap at most, whatever the number of frequent phrases
CHUNK = 1 << 16  # phrases in an Arrow batch
BREAK = 0  # id of the place between two pieces

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
TO_PLACES = bytes(0x0A if b in _SEPARATORS else 0x20 if b in b" \t" else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens_of(raw: bytes) -> list[bytes]:
    """Words of a text in UTF-8, in order; a line break stands where a piece ends."""
    return [t for t in raw.translate(TO_PLACES).replace(b"\n", b" \n ").split(b" ") if t]


class Shard:
    """A growing shard: word ids from 1 on in order of appearance, `BREAK` between pieces and documents."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b"\n": BREAK}
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, tokens: list[bytes]) -> None:
        number = self.number
        ids = np.array([number.setdefault(t, len(number)) for t in tokens], np.int32)
        self.parts += [ids, np.zeros(1, np.int32)]
        self.words += int(np.count_nonzero(ids))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text`, taken for a ring, in order of the `depth` ids from there on."""
    rank, known = text.astype(np.int64), 1
    while known < depth:
        step = min(known, depth - known)
        key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
        rank, known = np.unique(key, return_inverse=True)[1], known + step
    return np.argsort(rank, kind="stable")


def bwt(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The id before each suffix, in the order of the suffixes."""
    return text[suffix_order(text, depth) - 1]


class Index:
    """An FM-index over ids. `back[j]`: where the suffix behind the first word of suffix j stands in the order."""

    def __init__(self, transform: np.ndarray):
        self.back = np.argsort(transform, kind="stable")
        self.first = transform[self.back]  # first word of every suffix, in order

    def words(self) -> np.ndarray:
        """Interval number, that is word id, of every suffix."""
        return self.first.astype(np.int64)

    def extended(self, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All intervals of phrases with one more word on the left.

        `interval` numbers the suffixes' phrases of one word less. Gives the number of the longer phrase of every
        suffix, the beginnings of its intervals, and their lengths, which are the counts.
        """
        rest = interval[self.back]
        new = np.ones(len(rest), bool)
        new[1:] = (self.first[1:] != self.first[:-1]) | (rest[1:] != rest[:-1])
        starts = np.flatnonzero(new)
        return np.cumsum(new) - 1, starts, np.diff(np.append(starts, len(rest)))

    def phrase(self, starts: np.ndarray, length: int) -> list[np.ndarray]:
        """Word ids of the phrases that begin the suffixes at `starts`."""
        out, at = [], starts
        for _ in range(length):
            out.append(self.first[at])
            at = self.back[at]
        return out


def word_codes(words: list[bytes], lang: str) -> np.ndarray:
    """A 64-bit number per word of a language."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def phrase_codes(codes: list[np.ndarray]) -> np.ndarray:
    """A 64-bit number per phrase from those of its words, in order."""
    total = codes[0]
    for c in codes[1:]:
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + c)
    return total


def may_be(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether the bitmap lets codes through: true for all that were put in, and few others."""
    at = codes & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


SHARDS = "lang string, n bigint, words array<binary>, counts array<bigint>, transform binary"


def _indexed(depth: int, shard_words: int, open_words: int):
    """Documents (language, text) as indexed shards."""

    def row(lang: str, shard: Shard) -> pa.RecordBatch:
        text = np.concatenate(shard.parts)
        counts = np.bincount(text, minlength=len(shard.number))[1:]
        columns = [
            pa.array([lang], pa.string()), pa.array([shard.words], pa.int64()), pa.array([list(shard.number)[1:]], pa.list_(pa.binary())),
            pa.array([counts], pa.list_(pa.int64())), pa.array([bwt(text, depth).astype(np.int32).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "n", "words", "counts", "transform"])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                tokens = tokens_of(raw.as_py())
                if not tokens:
                    continue
                own = shards.setdefault(lang, Shard())
                own.add(tokens)
                if own.words >= shard_words:
                    yield row(lang, shards.pop(lang))
                elif sum(s.words for s in shards.values()) >= open_words:
                    largest = max(shards, key=lambda k: shards[k].words)
                    yield row(largest, shards.pop(largest))
        for lang in list(shards):
            shard = shards.pop(lang)
            if shard.words:
                yield row(lang, shard)

    return indexed


def _phrases(row: dict, frequent: list[Broadcast], length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Phrases of a length whose parts can all be frequent: ids of their words, counts in the shard, and codes.

    `frequent` has a bitmap per shorter length. Every depth is enumerated from the one before it.
    """
    index = Index(np.frombuffer(row["transform"], np.int32))
    codes = np.concatenate((np.zeros(1, np.uint64), word_codes(row["words"], row["lang"])))
    alive = np.concatenate(([False], may_be(np.frombuffer(frequent[0].value, np.uint8), codes[1:])))[index.first]
    interval = index.words()
    for k in range(2, length + 1):
        interval, starts, counts = index.extended(interval)
        # A phrase of k words holds two of k - 1: the one that begins where it does, and the one a word further.
        keep = np.flatnonzero(alive[starts] & alive[index.back[starts]])
        parts = index.phrase(starts[keep], k)
        whole = phrase_codes([codes[p] for p in parts])
        if k < length:
            kept = np.zeros(len(starts), bool)
            kept[keep] = may_be(np.frombuffer(frequent[k - 1].value, np.uint8), whole)
            alive = kept[interval]
    return parts, counts[keep], whole


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for r in range(len(batch)):
        yield {c: batch.column(c)[r].as_py() for c in ("lang", "words", "transform")}


def _sieved(frequent: list[Broadcast], length: int, bits: int):
    """Sums of the counts of all phrases with the same last `bits` of their code, a row per range of these."""

    def table(places: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        at, which = np.unique(np.concatenate(places), return_inverse=True)
        sums = np.bincount(which, weights=np.concatenate(counts)).astype(np.uint32)
        ranges, begins = np.unique(at >> 15, return_index=True)
        ends = np.append(begins[1:], len(at))
        low = (at & 0x7FFF).astype(np.uint16)
        columns = [
            pa.array(ranges, pa.int64()), pa.array([low[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
            pa.array([sums[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["range", "places", "counts"])

    def sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, counts, n = [], [], 0
        for batch in batches:
            for row in _rows(batch):
                _, own, codes = _phrases(row, frequent, length)
                places.append((codes & np.uint64((1 << bits) - 1)).astype(np.int64))
                counts.append(own)
                n += len(own)
                if n >= SIEVED:
                    yield table(places, counts)
                    places, counts, n = [], [], 0
        if n:
            yield table(places, counts)

    return sieved


def _enough(least: int):
    """Of every range, whose rows come together, a bitmap of the places whose sum is enough."""

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, np.zeros(1 << 15, np.int64)

        def row() -> pa.RecordBatch:
            bits = np.packbits(sums >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([bits], pa.binary())], ["_bucket", "_bitmap"])

        for batch in batches:
            for number, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != current:
                    if current is not None and (sums >= least).any():
                        yield row()
                    current = number
                    sums[:] = 0
                sums[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)
        if current is not None and (sums >= least).any():
            yield row()

    return enough


def _counted(frequent: list[Broadcast], sieve: Broadcast, length: int, ranges: int):
    """Phrases of a length that can be frequent, with their count in the shard: a row per shard and range of codes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                parts, counts, codes = _phrases(row, frequent, length)
                keep = np.flatnonzero(may_be(np.frombuffer(sieve.value, np.uint8), codes))
                if not len(keep):
                    continue
                own = (codes[keep] >> np.uint64(64 - RANGE_BITS)).astype(np.int64) % ranges
                order = np.argsort(own, kind="stable")
                keep, numbers = keep[order], own[order]
                words = pa.array(row["words"], pa.binary())
                texts = [words.take(pa.array(p[keep] - 1)) for p in parts]
                phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary())).cast(pa.string())
                present, begins = np.unique(numbers, return_index=True)
                offsets = pa.array(np.append(begins, len(keep)), pa.int32())
                columns = [
                    pa.array(present, pa.int64()), pa.array([row["lang"]] * len(present), pa.string()),
                    pa.ListArray.from_arrays(offsets, phrase), pa.ListArray.from_arrays(offsets, pa.array(counts[keep], pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["range", "lang", "phrases", "counts"])

    return counted


def _summed(least: int):
    """Of every range, whose rows come together, the phrases that are frequent in all shards."""

    def whole(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])

    def frequent(tables: list[pa.Table]) -> list[pa.RecordBatch]:
        summed = whole(tables)
        return summed.filter(pc.greater_equal(summed["f"], least)).combine_chunks().to_batches(CHUNK)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tables, n = None, [], 0
        for batch in batches:
            numbers = batch.column("range").to_numpy()
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for a, b in zip([0, *edges], [*edges, len(numbers)], strict=True):
                if b == a:
                    continue
                if numbers[a] != current and tables:
                    yield from frequent(tables)
                    tables, n = [], 0
                current = numbers[a]
                part = batch.slice(a, b - a)
                lists = part.column("phrases")
                langs = part.column("lang").take(pc.list_parent_indices(lists))
                tables.append(pa.table({"lang": langs, "phrase": lists.flatten(), "f": part.column("counts").flatten()}))
                n += len(langs)
                if n >= SIEVED:
                    tables = [whole(tables)]
                    n = len(tables[0])
        if tables:
            yield from frequent(tables)

    return summed


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each phrase, as `_counted` computes it."""
    for batch in batches:
        found = []
        for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = word_codes(phrase.encode().split(b" "), lang)
            found.append(int(phrase_codes(list(codes[:, None]))[0].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["code"])


def _broadcast(rows: DataFrame, bits: int) -> Broadcast:
    """Rows of a bitmap as one object of 2**(bits - 3) bytes on every executor."""
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.toLocalIterator():
        own = np.frombuffer(r["_bitmap"], np.uint8)
        whole[r["_bucket"] * 4096 : r["_bucket"] * 4096 + len(own)] = own[: len(whole) - r["_bucket"] * 4096]
    return rows.sparkSession.sparkContext.broadcast(whole.tobytes())


def bits_for(n: int, max_bits: int) -> int:
    return min(max(16, n.bit_length()), max_bits)


def bitmap(phrases: DataFrame, max_bits: int = MAX_BITS) -> Broadcast:
    """The phrases as a bitmap of sixteen bits a phrase, at most 2**max_bits bits."""
    bits = bits_for(16 * phrases.count(), max_bits)
    codes = phrases.select("lang", "phrase").mapInArrow(lean(_coded), "code bigint")
    return _broadcast(bitmap_of(codes, "code", bits), bits)


def sieve(index: DataFrame, known: list[Broadcast], size: int, words: int, least: int, max_bits: int) -> Broadcast:
    """A bitmap that lets every phrase of a size through that is frequent in all, before any phrase is moved.

    Phrases are counted by the last bits of their codes, some two bytes each on their way; the sum of a place is at
    least the count of each of its phrases.
    """
    bits = bits_for(words, max_bits)
    sums = index.mapInArrow(lean(_sieved(list(known), size, bits)), "range bigint, places binary, counts binary")
    rows = saved(sums.repartition("range").sortWithinPartitions("range").mapInArrow(lean(_enough(least)), "_bucket bigint, _bitmap binary"))
    return _broadcast(rows, bits)


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, shard_words: int = SHARD_WORDS, max_bits: int = MAX_BITS,
) -> tuple[DataFrame, DataFrame]:
    """Two saved tables: phrases of 1 to `depth` words that occur at least `least` times (`lang, size, phrase, f`), and
    the words of each language (`lang, n`)."""
    rows = plain(docs, lang_col, text_col).select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    shards = saved(rows.mapInArrow(lean(_indexed(depth, shard_words, max(OPEN_WORDS, shard_words))), SHARDS), large_rows=True)
    totals = saved(shards.groupBy("lang").agg(F.sum("n").alias("n")))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    pairs = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    words = pairs.groupBy("lang", F.col("w.words").cast("string").alias("phrase")).agg(F.sum("w.counts").alias("f"))
    found = [saved(words.filter(F.col("f") >= least).withColumn("size", F.lit(1)))]
    index = shards.select("lang", "words", "transform")
    known: list[Broadcast] = []
    for size in range(2, depth + 1):
        known.append(bitmap(found[-1], max_bits))
        likely = sieve(index, known, size, n_words, least, max_bits)
        # As many ranges as keep what a task sums up small: what the sieve lets through bounds the frequent phrases, and
        # the words bound what shards send, also once the sieve is full.
        ranges = min(max(LEAST_RANGES, int.from_bytes(likely.value).bit_count() >> 15, n_words // RANGE_WORDS), 1 << RANGE_BITS)
        counted = index.mapInArrow(lean(_counted(list(known), likely, size, ranges)), "range bigint, lang string, phrases array<string>, counts array<bigint>")
        summed = counted.repartition("range").sortWithinPartitions("range").mapInArrow(lean(_summed(least)), "lang string, phrase string, f bigint")
        found.append(saved(summed.withColumn("size", F.lit(size))))
        likely.unpersist()
    for used in known:
        used.unpersist()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, totals


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, absorbed: int = 80, top: int | None = 2000,
    shard_words: int = SHARD_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """Per language the phrases ranked by score: `lang, rank, phrase, a, l, r, n, score, left_ext, right_ext`.

    `left_ext` and `right_ext` count the most frequent extension by a word (0: none is a candidate). `absorbed` is the
    percentage of occurrences from which on a longer candidate replaces a shorter one; `top` None keeps all.
    """
    with small_batches(docs.sparkSession, size="8m"):  # a shard or two at a time
        every, totals = frequent_phrases(docs, text_col, lang_col, depth, least, shard_words, max_bits)
    longer = every.filter("size > 1")
    words = F.split("phrase", " ")
    # Of every phrase the one without its last and the one without its first word: what it extends to the right and left.
    inner = longer.select("lang", "f", F.explode(F.array(
        F.struct(F.lit(True).alias("right"), F.array_join(F.slice(words, 1, F.col("size") - 1), " ").alias("phrase")),
        F.struct(F.lit(False).alias("right"), F.array_join(F.slice(words, 2, F.col("size") - 1), " ").alias("phrase")),
    )).alias("i")).select("lang", "f", "i.*")
    around = inner.groupBy("lang", "phrase").agg(
        F.coalesce(F.max(F.when(~F.col("right"), F.col("f"))), F.lit(0)).alias("left_ext"), F.coalesce(F.max(F.when(F.col("right"), F.col("f"))), F.lit(0)).alias("right_ext")
    )
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products pass 64 bits
    kept = longer.join(around, ["lang", "phrase"], "left").fillna(0, ["left_ext", "right_ext"])
    kept = kept.withColumn("most", F.greatest("left_ext", "right_ext")).filter(~(wide("most") * 100 >= wide("f") * absorbed) | (F.col("most") == 0))
    cuts = kept.select("lang", "phrase", "size", F.col("f").alias("a"), "left_ext", "right_ext", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("_first", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn(
        "_rest", F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")
    )
    firsts = every.select(F.col("lang").alias("_l1"), F.col("phrase").alias("_p1"), F.col("f").alias("l"))
    rests = every.select(F.col("lang").alias("_l2"), F.col("phrase").alias("_p2"), F.col("f").alias("r"))
    cuts = cuts.join(firsts, (F.col("lang") == F.col("_l1")) & (F.col("_first") == F.col("_p1")))
    cuts = cuts.join(rests, (F.col("lang") == F.col("_l2")) & (F.col("_rest") == F.col("_p2")))
    scored = cuts.withColumn("score", F.expr("(cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a", "left_ext", "right_ext").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    rows = lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score", "left_ext", "right_ext")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(256))
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("_r") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_ext", "right_ext")
