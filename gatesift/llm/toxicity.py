"""Toxicity of texts: a weighted lexicon matched by one Aho-Corasick automaton over folded text.

Folding writes every letter without accents and in lower case, look-alikes of other scripts and digits that stand for
letters as the letter they imitate (`i`, `l` and `1` become one letter), and everything else as a blank; invisible
characters vanish. A term matches a whole word or, marked `*`, the beginning of one. A run of bare digits is no word. A
match inside an exception phrase does not count. Per word the heaviest term counts; the sum of weights, alone and
normalised by the number of words, goes into a logistic score.

Terms, weights and the logistic curve are learned from labelled rows. The fit sees at most `toxic_rows` and
`clean_rows` rows, chosen by a hash of the id; everything else covers all rows. Without rows of both labels the general
terms and the default curve are used.

NULL and empty texts have no matches and get the score of a text without matches. A NULL id is never labelled nor held
out. Repeated labels of an id count as toxic when one of them is. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import per_worker, plain, saved, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOXIC_ROWS, CLEAN_ROWS = 4000, 12000  # bounds of the rows which the fit sees
TERMS = 1000  # most terms that are learned
EVIDENCE = 30.0  # least likelihood-ratio statistic of a learned term
STEMS = (4, 5, 6, 7, 8)  # characters of word beginnings that may become terms

# General terms with a weight each, and phrases in which such a word is harmless.
GENERAL = {
    "idiot": 4.0, "idiots": 4.0, "moron": 4.0, "morons": 4.0, "stupid": 3.0, "dumb": 2.5, "loser": 3.0, "losers": 3.0, "scum": 4.0,
    "trash": 2.0, "garbage": 1.5, "pathetic": 3.0, "worthless": 3.0, "disgusting": 2.5, "clown": 2.0, "imbecile": 4.0,
    "bastard": 4.0, "bitch": 5.0, "fuck*": 5.0, "shit*": 4.0, "asshole*": 5.0, "retard*": 5.0, "kill yourself": 6.0,
}
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "garbage collection", "garbage collector", "clown fish", "circus clown", "stupid question",
    "dumb bell", "dumb terminal", "bitch of the dog", "sore loser rule", "shit zu",
)
# Characters of other scripts that look like a Latin letter, and digits and signs used for letters.
LOOK_ALIKES = dict(zip("аеорсухкмтвніјѕԁɡһӏαεοριτυκνχβηγ", "aeopcyxkmtbhijsdghlaeopitukvxbhy", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = re.compile("[­̀-ͯ​-‏⁠﻿]")
SIGN_INSIDE = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")


class Folding(dict):
    """Character code to its folded character, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = (chr(code) if 0xC0 <= code < 0x250 else unicodedata.normalize("NFKD", chr(code))[0]).lower()[:1]
        c = LOOK_ALIKES.get(c, SIGNS.get(c, c) if c not in "@$" else c)
        c = "i" if c == "l" else c
        self[code] = out = c if c.isalnum() else " "
        return out


def folded(text: str) -> tuple[str, str]:
    """The visible text and its folded form between two blanks: character i of the first is i + 1 of the second."""
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    signed = SIGN_INSIDE.sub(lambda m: SIGNS[m[0]], text) if "@" in text or "$" in text else text
    return text, " " + signed.translate(per_worker(("folding",), Folding)) + " "


def pattern(term: str) -> str:
    """What the automaton looks for: the folded term after a blank, before a blank as well unless it is a beginning."""
    return folded(term.rstrip("*"))[1].rstrip() + ("" if term.endswith("*") else " ")


@dataclass(frozen=True)
class Model:
    """Terms with weights, exception phrases and the logistic curve: constant, sum of weights, density."""

    terms: tuple[tuple[str, float], ...] = tuple(GENERAL.items())
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 2.0, 0.5)

    def automaton(self):
        import ahocorasick

        found: dict[str, float] = {}
        for term, weight in self.terms:
            found[pattern(term)] = max(weight, found.get(pattern(term), 0.0))
        built = ahocorasick.Automaton()
        for p, weight in found.items():
            built.add_word(p, (len(p), weight))
        for phrase in self.exceptions:
            p = pattern(phrase)
            built.add_word(p, (len(p), 0.0))
        built.make_automaton()
        return built

    def matches(self, text: str, searcher) -> tuple[int, list[tuple[int, float]]]:
        """Number of words; place in the visible text and weight of each matched word."""
        visible, searched = folded(text)
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in searcher.iter(searched):
            start = end - length + 1
            if weight == 0.0:
                excused.append((start, end))
            elif weight > best.get(start, 0.0) and any(map(str.isalpha, visible[start : start + length - 1])):
                best[start] = weight
        kept = [(s, w) for s, w in sorted(best.items()) if not any(a <= s < b for a, b in excused)]
        return len(searched.split()), kept

    def features(self, total: float, words: int) -> tuple[float, float, float]:
        return 1.0, math.log1p(total), math.log1p(100.0 * total / (words + 10))

    def score(self, total: float, words: int) -> float:
        z = sum(a * b for a, b in zip(self.curve, self.features(total, words), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str) -> Column:
    """True for the fifth of the ids whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def likeness(words_col: str, words: int = 5) -> Column:
    """Smallest hash of the word shingles: near copies mostly share it, so that a copied text is not evidence many times."""
    last = F.greatest(F.size(words_col) - (words - 1), F.lit(1))
    return F.array_min(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words_col, i, words))))


def candidates(text: str) -> set[str]:
    """Words of the folded text, and word beginnings marked `*`."""
    words = {w for w in folded(text)[1].split() if len(w) > 2 and not w.isdigit()}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _candidate_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            seen[label.as_py()].update(candidates(text.as_py()))
        terms = list(seen[0].keys() | seen[1].keys())
        counts = [pa.array([seen[y][t] for t in terms], pa.int64()) for y in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], ["term", "toxic", "clean"])


def _totals(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = per_worker(("lexicon", model), model.automaton)
        for batch in batches:
            found = [model.matches(t.as_py(), searcher) for t in batch.column(0)]
            sums = pa.array([sum(w for _, w in hits) for _, hits in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(1), sums, pa.array([n for n, _ in found], pa.int64())], ["label", "total", "words"])

    return totals


def _learned_terms(rows: DataFrame, toxic: int, clean: int) -> list[tuple[str, float]]:
    """Terms that speak for a toxic text beyond chance, heaviest evidence first, none the beginning of another."""
    counted = rows.mapInArrow(_candidate_counts, "term string, toxic bigint, clean bigint").groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c")
    )
    share = toxic / (toxic + clean)
    n = F.col("t") + F.col("c")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    evidence = 2 * (part(F.col("t"), n * share) + part(F.col("c"), n * (1 - share)))
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (clean - F.col("c") + 0.5))
    best = counted.select("term", "t", evidence.alias("g"), odds.alias("w")).filter((F.col("g") >= EVIDENCE) & (F.col("w") > 1.5))
    # Of terms with the same evidence (a word and its beginnings) the longest is the most careful one.
    found = best.orderBy(F.desc("g"), F.desc(F.length("term")), "term").limit(TERMS).collect()
    kept: dict[str, tuple[int, float]] = {}
    for term, rows_with, _, weight in found:
        stem = term.rstrip("*")
        longer = any(k.startswith(stem) and t >= 0.8 * rows_with for k, (t, _) in kept.items()) if term.endswith("*") else False
        shorter = any(k.endswith("*") and stem.startswith(k[:-1]) and weight <= w + 1.0 for k, (_, w) in kept.items())
        if not longer and not shorter:
            kept[term] = (rows_with, min(weight, 8.0))
    return [(term, weight) for term, (_, weight) in kept.items()]


def _fit_curve(x: np.ndarray, y: np.ndarray, offset: float) -> tuple[float, float, float]:
    """Logistic regression with a ridge by Newton's method; the prior of the sample is put right by the constant."""
    w, ridge = np.zeros(3), np.diag([0.01, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] + offset), float(max(w[1], 0.0)), float(max(w[2], 0.0))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """A model from labelled rows which are not held out: the same for any order and distribution of the rows.

    Of a repeated id the smallest text counts, of near copies the one with the smallest id.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(
        F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    known = known.filter(~held_out("_label_id"))
    order = F.xxhash64("_label_id")
    chosen = known.filter("_toxic = 1").orderBy(order, "_label_id").limit(toxic_rows).unionByName(
        known.filter("_toxic = 0").orderBy(order, "_label_id").limit(clean_rows)
    )
    texts = plain(docs, id_col, text_col).select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    # At most toxic_rows + clean_rows ids and flags.
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    rows = rows.withColumn("_words", F.split(F.trim("_text"), r"\s+")).withColumn("_like", likeness("_words"))
    rows = rows.groupBy("_toxic", "_like").agg(F.min(F.struct("_id", "_text"))["_text"].alias("_text"))
    rows = saved(rows.select("_text", "_toxic"))
    seen = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    toxic, clean = seen.get(1, 0), seen.get(0, 0)
    if not toxic or not clean:
        return Model()
    terms = _learned_terms(rows, toxic, clean)
    model = Model(terms=tuple((GENERAL | dict(terms)).items()))
    # In one order, since sums of floating point numbers depend on it.
    found = sorted(rows.mapInArrow(_totals(model), "label int, total double, words bigint").collect())
    x = np.array([model.features(r["total"], r["words"]) for r in found])
    y = np.array([r["label"] for r in found], dtype=float)
    prior = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    offset = math.log((prior.get(1, 0) + 1) / (prior.get(0, 0) + 1)) - math.log((toxic + 1) / (clean + 1))
    return Model(model.terms, model.exceptions, _fit_curve(x, y, offset))


MATCH = pa.struct([("place", pa.int64()), ("weight", pa.float64())])


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = per_worker(("lexicon", model), model.automaton)
        for batch in batches:
            found = [model.matches(t.as_py(), searcher) for t in batch.column(1)]
            scores = pa.array([model.score(sum(w for _, w in hits), n) for n, hits in found], pa.float64())
            hits = pa.array([[{"place": s, "weight": w} for s, w in hits] for _, hits in found], pa.list_(MATCH))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, hits], ["_id", "score", "matches"])

    return scored


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row of `docs`: id, `held_out`, `score`, `predicted` and `matches` (place in the visible text, weight)."""
    rows = plain(docs, id_col, text_col).select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(_scored(model), f"_id {kind}, score double, matches array<struct<place: bigint, weight: double>>")
    return found.select(
        F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matches"
    )


def _harmless(model: Model, at: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def harmless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = per_worker(("lexicon", model), model.automaton)
        for batch in batches:
            found = [model.matches(t.as_py() or "", searcher) for t in batch.column(at)]
            yield batch.filter(pa.array([model.score(sum(w for _, w in hits), n) < threshold for n, hits in found], pa.bool_()))

    return harmless


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` without those that the model rejects; all columns as they were, no shuffle."""
    return docs.mapInArrow(_harmless(model, docs.columns.index(text_col), threshold), docs.schema)
