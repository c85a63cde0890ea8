"""Exact Jaccard join on word shingles, and the components of its links.

Sets are kept once per distinct set (a class); copies only point to it. Of each set the `prefix` is indexed: its first
shingles in one global order, rare ones first, as long as two sets of the wanted similarity must share one of them. The
order comes from a count sketch over all documents, whose size is fixed.

Block skipping: entries of a shingle's list are grouped into blocks by set size and position. Whether two blocks can
hold a linked pair follows from sizes and positions alone, so blocks are compared, not entries, and most are skipped.
Derived answers: the members of a block are first compared with one member only, its leader, and each leader with one other.
What is linked makes up a component, and inside a component no answer is needed any more. The next rounds compare one
leader per block and component, first with the largest component of the list, then with each other; the last one all
entries of blocks that lie in different components and were not compared before, so no link between components is lost. While pairs are verified, the answers of a set are derived from
those of the similar set before it, by the few shingles in which the two differ.

A text's words are its runs without ASCII white space, A-Z in lower case; with fewer words than a shingle the whole
sequence is its one shingle. NULL, empty and blank texts have no shingles and link with nothing. A NULL id stays alone,
with a NULL component. Rows that repeat an id count as one document each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatesift.llm.common import bitmap_of, in_bitmap, join_groups, lean, plain, saved, small_batches, text_or_empty
from gatesift.llm.components import components
from gatesift.llm.shingles import shingle_sets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SKETCH_BITS = 20  # counters of the sketch
SLICE = 4096  # counters in one row while they are added up
TOGETHER = 2_000_000  # bytes of texts that are shingled together
SIMILAR = 0.2  # share of a set by which the set before may differ for its answers to be reused
BITS = 24  # 2 MB of bitmap; there are several in a join


def _batches(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in runs of bounded size, with the number of the first."""
    texts, size, first = [], 0, 0
    for i, text in enumerate(batch.column(at).cast(pa.binary())):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= TOGETHER:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def _class(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _described(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Class and size per document; after the last, this task's part of the sketch in slices."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, names = np.zeros(1 << SKETCH_BITS, np.int64), ["id", "class", "n", "slice", "counts"]
        kind = pa.int64()
        for batch in batches:
            kind, classes, sizes = batch.schema.field(0).type, [], []
            for _, texts in _batches(batch, 1):
                sets = list(shingle_sets(texts, words))
                classes += [_class(s) for s in sets]
                sizes += [len(s) for s in sets]
                if any(map(len, sets)):
                    sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            none = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names
            )
        if sketch.any():
            slices = [(i, part.tobytes()) for i, part in enumerate(sketch.reshape(-1, SLICE)) if part.any()]
            none = len(slices)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(none, kind), pa.nulls(none, pa.binary()), pa.nulls(none, pa.int64()), pa.array([i for i, _ in slices], pa.int32()), pa.array([c for _, c in slices], pa.binary())],
                names,
            )

    return described


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
    return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})


def _sketch(described: DataFrame) -> np.ndarray:
    """The sketch over all documents: 2**SKETCH_BITS numbers, whatever the input. Slices are added up in two steps."""
    parts = described.filter("slice is not null").select("slice", "counts")
    some = F.pmod(F.xxhash64("counts"), F.lit(64)).alias("_some")
    parts = parts.groupBy("slice", some).applyInPandas(_added, "slice int, counts binary").groupBy("slice").applyInPandas(_added, "slice int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.collect():
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _prefixes(words: int, percent: int, sketch: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, tokens = [], [], []
            for _, texts in _batches(batch, 0):
                for s in shingle_sets(texts, words):
                    if not len(s):
                        continue
                    rank = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.lexsort((s, rank))[: prefix_length(len(s), percent)]
                    classes.append(_class(s))
                    sizes.append(len(s))
                    tokens.append(s[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["class", "n", "tokens"]
            )

    return prefixes


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _batches(batch, 0):
                found = [s for s in shingle_sets(texts, words) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_class(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["class", "shingles"]
                )

    return sets


def _classed(words: int, column: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows with the class of the text in `column` as a further column `kind`."""

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = [_class(s) for _, texts in _batches(batch, column) for s in shingle_sets(texts, words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classes, pa.binary())], [*batch.schema.names, kind])

    return classed


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlap of pairs which come ordered by their first set."""

    def within(part: np.ndarray, whole: np.ndarray) -> int:
        if not len(part):
            return 0
        at = np.searchsorted(whole, part)
        return int(np.count_nonzero(whole[np.minimum(at, len(whole) - 1)] == part))

    before: dict[bytes, int] = {}
    answers: dict[bytes, int] = {}
    name, own = None, np.zeros(0, np.uint64)
    lost = gained = own
    for batch in batches:
        out = []
        for a, sa, b, sb in zip(*batch.columns[:4], strict=True):
            a, b, other = a.as_py(), b.as_py(), np.frombuffer(sb.as_py(), np.uint64)
            if a != name:
                previous, own, name = own, np.frombuffer(sa.as_py(), np.uint64), a
                before, answers = answers, {}
                if before:
                    lost, gained = np.setdiff1d(previous, own, assume_unique=True), np.setdiff1d(own, previous, assume_unique=True)
                    if len(lost) + len(gained) > SIMILAR * len(own):
                        before = {}
            if b in before:
                found = before[b] - within(lost, other) + within(gained, other)
            else:
                found = within(own, other) if len(own) <= len(other) else within(other, own)
            if len(answers) < 10_000:
                answers[b] = found
            out.append((a, b, found, len(own), len(other)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["a", "b", "both", "n_a", "n_b"])


def _empty(table: DataFrame) -> bool:
    return not table.limit(1).count()


class Join:
    """One join: its saved tables and the steps that use them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int):
        self.words, self.percent, self.id_col = words, percent, id_col
        self.texts = plain(docs, id_col, text_col).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
        kind = self.texts.schema["id"].dataType.simpleString()
        described = saved(self.texts.mapInArrow(lean(_described(words)), f"id {kind}, class binary, n bigint, slice int, counts binary"))
        self.members = described.filter("slice is null").select("id", "class", "n")
        known = self.members.filter("class is not null and id is not null")
        self.classes = saved(known.groupBy("class").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")))
        self.sketch = _sketch(described)

    # Sizes and positions: (x, y) with x the smaller set.
    def may_link(self, x: str, y: str) -> Column:
        n_x, n_y, p_x, p_y = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (x, y))
        ordered = (n_x < n_y) | ((n_x == n_y) & (p_x <= p_y))
        need = F.ceil(F.lit(self.percent) * (n_x + n_y) / (100 + self.percent) - 1e-9)
        return ordered & (100 * n_x >= self.percent * n_y) & (F.least(n_x - p_x, n_y - p_y) >= need)

    def prefixes(self) -> DataFrame:
        """`class, n, tokens` of every class, its prefix in the global order."""
        rows = self.texts.filter("id is not null").select("text").mapInArrow(
            lean(_prefixes(self.words, self.percent, self.sketch)), "class binary, n bigint, tokens array<bigint>"
        )
        return rows.groupBy("class").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))

    def entries(self) -> DataFrame:
        """Prefix entries `token, class, n, pos` of lists with two classes or more."""
        spread = self.prefix.select("class", "n", F.posexplode("tokens").alias("pos", "token"))
        return spread.withColumn("_list", F.count("*").over(Window.partitionBy("token"))).filter("_list > 1").select("token", "class", "n", "pos")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose prefixes have enough in common.

        Of two prefixes take the one that ends first in the global order: what both sets share is shared by the
        prefixes or lies in the rest of that set. So the shared part of the prefixes and the longer rest bound
        the overlap.
        """
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).select(F.xxhash64("class").alias("_key"))
        bitmap = saved(bitmap_of(wanted, "_key", BITS))
        own = in_bitmap(self.prefix.withColumn("_key", F.xxhash64("class")), "_key", bitmap, BITS, "_likely").filter("_likely")
        a, b = (own.select(F.col("class").alias(t), F.col("n").alias(f"n_{t}"), F.col("tokens").alias(f"tokens_{t}")) for t in ("a", "b"))
        rows = pairs.join(a, "a").join(b, "b")
        rest = F.greatest(F.col("n_a") - F.size("tokens_a"), F.col("n_b") - F.size("tokens_b"))
        need = F.ceil(F.lit(self.percent) * (F.col("n_a") + F.col("n_b")) / (100 + self.percent) - 1e-9)
        return rows.filter(F.size(F.array_intersect("tokens_a", "tokens_b")) + rest >= need).select("a", "b")

    def links_among(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of the pairs `a, b` (a saved table). Only sets that occur in a likely pair are read and moved."""
        if _empty(pairs):
            return pairs
        pairs = saved(self.likely(pairs))
        if _empty(pairs):
            return pairs
        sets = saved(self._sets_of(pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()))
        left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
        right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
        rows = pairs.join(left, "a").join(right, "b").select("a", "set_a", "b", "set_b")
        found = rows.sortWithinPartitions("a", "b").mapInArrow(lean(_overlaps), "a binary, b binary, both bigint, n_a bigint, n_b bigint")
        linked = 100 * F.col("both") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("both"))
        return saved(found.filter(linked).select("a", "b"))

    def merged(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """`class, comp` of every class that has a link, after further links.

        Components are joined, not their members: a link counts once for the two components that it joins, however many
        links there are between them.
        """
        if _empty(links):
            return links.select(F.col("a").alias("class"), F.col("b").alias("comp")) if labels is None else labels
        if labels is None:
            return components(links).select(F.col("vertex").alias("class"), F.col("label").alias("comp"))
        for end in ("a", "b"):
            known = labels.select(F.col("class").alias("_class"), F.col("comp").alias("_comp"))
            links = links.join(known, F.col(end) == F.col("_class"), "left").withColumn(end, F.coalesce("_comp", end)).select("a", "b")
        joined = saved(components(links.filter("a <> b").distinct()))
        sizes = labels.groupBy("comp").agg(F.count("*").alias("_size"))
        moved = saved(sizes.join(joined, F.col("comp") == F.col("vertex")).select("comp", "label", "_size"))
        old = join_groups(labels, moved, "comp", "_size", labels.count()).select("class", F.coalesce("label", "comp").alias("comp"))
        new = joined.join(labels, F.col("vertex") == F.col("class"), "left_anti").select(F.col("vertex").alias("class"), F.col("label").alias("comp"))
        return old.unionByName(new)

    def run(self) -> DataFrame:
        """`class, comp` of every class that is linked with another."""
        self.prefix = saved(self.prefixes())
        shared = saved(self.entries())
        if _empty(shared):
            return self.classes.select("class", F.col("class").alias("comp")).limit(0)
        place = ["token", "n", "pos"]
        blocks = shared.groupBy(*place).agg(F.min("class").alias("lead"), F.count("*").alias("c"))
        x, y = blocks.alias("x"), blocks.alias("y")
        same = (F.col("x.n") == F.col("y.n")) & (F.col("x.pos") == F.col("y.pos"))
        near = saved(
            x.join(y, (F.col("x.token") == F.col("y.token")) & self.may_link("x", "y") & (~same | (F.col("x.c") > 1))).select(
                F.col("x.token").alias("token"), *[F.col(f"{t}.{c}").alias(f"{c}_{t}") for t in ("x", "y") for c in ("n", "pos", "lead")]
            )
        )
        used = near.select("token", F.col("n_x").alias("n"), F.col("pos_x").alias("pos"), F.col("lead_x").alias("lead")).unionByName(
            near.select("token", F.col("n_y").alias("n"), F.col("pos_y").alias("pos"), F.col("lead_y").alias("lead"))
        ).distinct()
        active = saved(shared.join(used, place))

        own = near.filter("lead_x = lead_y and n_x = n_y and pos_x = pos_y").select("token", F.col("n_x").alias("n"), F.col("pos_x").alias("pos"))
        members = active.join(own, place, "left_semi").filter("class <> lead").select(F.col("lead").alias("a"), F.col("class").alias("b"))
        compared = saved(members.unionByName(self._leaders(near)).distinct())
        labels = saved(self.merged(None, self.links_among(compared)))

        for which in ("main", "leaders", "entries"):
            pairs = saved(self._between(active, labels, which).join(compared, ["a", "b"], "left_anti"))
            more = self.links_among(pairs)
            compared = compared.unionByName(pairs)
            if not _empty(more):
                labels = saved(self.merged(labels, more))
        return labels

    def _leaders(self, near: DataFrame) -> DataFrame:
        """Of every block its leader with one leader of the blocks that may hold a link with it, the smallest.

        So there are no more pairs than blocks, and a group of near copies meets in few leaders. What this leaves apart
        is compared in the rounds that follow.
        """
        sides = [near.select("token", *[F.col(f"{c}_{t}").alias(c) for c in ("n", "pos", "lead")], F.col(f"lead_{o}").alias("other")) for t, o in ("xy", "yx")]
        chosen = sides[0].unionByName(sides[1]).filter("lead <> other").groupBy("token", "n", "pos", "lead").agg(F.min("other").alias("other"))
        return chosen.select(F.least("lead", "other").alias("a"), F.greatest("lead", "other").alias("b"))

    def _between(self, active: DataFrame, labels: DataFrame, which: str) -> DataFrame:
        """Pairs from different components in blocks that may hold a link.

        First leaders with those of the list's largest component, which in a large group of near copies leaves few
        components; then leaders with leaders; then all entries.
        """
        rows = active.drop("lead").join(labels, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
        rows = saved(rows.join(mixed, "token", "left_semi"))
        if which == "main":
            sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
            largest = sizes.groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("largest"))
        if which != "entries":
            rows = rows.groupBy("token", "n", "pos", "comp").agg(F.min("class").alias("class"))
        rows = saved(rows.join(largest, "token").withColumn("main", F.col("comp") == F.col("largest"))) if which == "main" else rows.withColumn("main", F.lit(True))
        x, y = rows.alias("x"), rows.alias("y")
        apart = (F.col("x.comp") != F.col("y.comp")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.main") | F.col("y.main"))
        found = x.join(y, apart & self.may_link("x", "y"))
        return found.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()

    def _sets_of(self, classes: DataFrame) -> DataFrame:
        """Shingles of these classes, read from one document each; a bounded bitmap of their ids limits the reading."""
        wanted = self.classes.join(classes, "class", "left_semi").select(F.xxhash64("first_id").alias("_key"))
        bitmap = saved(bitmap_of(wanted, "_key", BITS))
        texts = in_bitmap(self.texts.filter("id is not null").withColumn("_key", F.xxhash64("id")), "_key", bitmap, BITS, "_likely").filter("_likely").select("text")
        return texts.mapInArrow(lean(_sets(self.words)), "class binary, shingles binary").join(classes, "class", "left_semi").dropDuplicates(["class"])


def _judged(join: Join) -> DataFrame:
    """Per document: `id`, `class`, `n`, and of a component of several documents `_component`, its smallest id, and `_kept`, the class that stays under it."""
    labels = join.run()
    classes = join.classes.join(labels, "class", "left")
    linked = saved(classes.filter("comp is not null"))
    comps = saved(linked.groupBy("comp").agg(F.min(F.struct("first_id", "class")).alias("least"), F.count("*").alias("size")))
    reached = join_groups(linked, comps, "comp", "size", linked.count()).select(
        "class", F.col("least.first_id").alias("_component"), F.col("least.class").alias("_kept"), "copies"
    )
    copied = classes.filter("comp is null and copies > 1").select("class", F.col("first_id").alias("_component"), F.col("class").alias("_kept"), "copies")
    groups = saved(reached.unionByName(copied))
    return join_groups(join.members, groups, "class", "copies", join.members.count())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs`: id, `n_shingles` and `component_id`, the smallest id that links lead to, itself included."""
    with small_batches(docs.sparkSession):
        rows = _judged(Join(docs, id_col, text_col, words, percent))
    own = F.col("id")
    component = F.when(own.isNull(), F.lit(None)).otherwise(F.coalesce("_component", own))
    return rows.select(own.alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component, one with the smallest id; a NULL id or a text without words stays.

    An id that occurs once decides by itself. Rows whose id may be repeated are decided by id and class, and of those
    that are equal in both one stays.
    """
    with small_batches(docs.sparkSession):
        join = Join(docs, id_col, text_col, words, percent)
        judged = _judged(join)
    judged = judged.filter("id is not null")
    dropped = judged.filter((F.col("id") != F.col("_component")) | (F.col("class") != F.col("_kept")))
    gone = saved(dropped.select(F.col("id").alias("_gone"), F.col("class").alias("_class_gone"), F.xxhash64("id").alias("_key")).distinct())
    repeated = saved(join.members.filter("id is not null").groupBy("id").agg(F.count("*").alias("_rows")).filter("_rows > 1").select(F.xxhash64("id").alias("_key")))
    bitmap = saved(bitmap_of(gone, "_key", BITS))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_key"), text_or_empty(text_col).alias("_text"))
    several = None
    if not _empty(repeated):
        rows = in_bitmap(rows, "_key", saved(bitmap_of(repeated, "_key", BITS)), BITS, "_several")
        several = rows.filter(F.col("_several") & F.col("_id").isNotNull()).select("_doc", "_id", "_text")
        rows = rows.filter(~(F.col("_several") & F.col("_id").isNotNull()))
    likely = in_bitmap(rows.select("_doc", "_id", "_key"), "_key", bitmap, BITS, "_likely")
    kept = likely.filter("_likely").join(gone.select("_gone").distinct(), F.col("_id") == F.col("_gone"), "left_anti").select("_doc.*")
    out = likely.filter("not _likely").select("_doc.*").unionByName(kept)
    if several is None:
        return out
    schema = T.StructType([*several.schema.fields, T.StructField("_class", T.BinaryType())])
    several = several.mapInArrow(lean(_classed(words, 2, "_class")), schema)
    same = (F.col("_id") == F.col("_gone")) & (F.col("_class") == F.col("_class_gone"))
    stay = several.join(gone, same, "left_anti")
    one = stay.filter("_class is not null").groupBy("_id", "_class").agg(F.first("_doc").alias("_doc"))
    return out.unionByName(stay.filter("_class is null").select("_doc.*")).unionByName(one.select("_doc.*"))
