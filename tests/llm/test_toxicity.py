import random
import zlib

import pytest

from gatesift.llm import toxicity as T
from tests.llm.helpers import awkward_texts, documents, prose


def labelled(spark, n=900):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        words = prose(rng, 60).split()
        if toxic:
            words[rng.randrange(60)] = rng.choice(["zorgel", "zorgelig", "zorgelbat", "blafnik"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_learns_from_the_other_folds_only(spark):
    docs, labels = labelled(spark)
    model = T.learn(docs, labels)
    got = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 7 == 0) for r in held) / len(held) > 0.98
    flipped = labels.selectExpr("doc_id", "quality", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 then 1 - toxic else toxic end as toxic")
    assert T.learn(docs, flipped) == model


@pytest.mark.parametrize("text, toxic", [
    ("you are an idiot my friend", True), ("you are an 1d10t my friend", True), ("you are an \u0456diot my friend", True), ("you are an i\u200bdiot my friend", True),
    ("you are an ID\uff29OT!", True), ("what a mor$on", False), ("5tup1d thing", True), ("put it in the trash can please", False), ("10 1010 57012", False),
    ("you are an idi\u03bft", True), ("st\u03c5pid thing", True), ("a house by the river", False), ("", False), (None, False), ("idiotic? no: idiomatic", False),
])
def test_folding_and_exceptions(spark, text, toxic):
    row = T.score(documents(spark, [text]), T.Model()).first()
    assert row["predicted"] == int(toxic) and 0.0 <= row["score"] <= 1.0
    assert bool(row["matches"]) == toxic


def test_model_does_not_depend_on_the_order_of_rows(spark):
    docs, labels = labelled(spark)
    near = docs.filter("doc_id < 300").selectExpr("doc_id", "concat(text, ' at the end') as text")  # repeated ids, near copies
    rows = docs.unionByName(near)
    model = T.learn(rows, labels)
    assert len(model.terms) > len(T.Model().terms)
    assert T.learn(rows.orderBy("text").repartition(7), labels.orderBy("toxic", "doc_id").repartition(3)) == model


def by_search(model, text):
    """Matches by looking for every term at every place."""
    visible, searched = T.folded(text)
    places = lambda p: [i for i in range(len(searched)) if searched.startswith(p, i)]
    excused = {j for phrase in model.exceptions for i in places(T.pattern(phrase)) for j in range(i, i + len(T.pattern(phrase)) - 1)}
    best = {}
    for term, weight in model.terms:
        p = T.pattern(term)
        for i in places(p):
            if any(c.isalpha() for c in visible[i : i + len(p) - 1]):
                best[i] = max(weight, best.get(i, 0.0))
    return sorted((i, w) for i, w in best.items() if i not in excused)


def test_matches_are_those_of_a_search_for_every_term(spark):
    model, rng = T.Model(), random.Random(8)
    pieces = [t.rstrip("*") for t in T.GENERAL] + list(T.EXCEPTIONS) + ["1d10t", "\u0456diot", "can", "cans", "a", "-", "5tup1d", "shitty", "12", "tr\u200bash"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "  ", "-", "", "! "]) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    searcher = model.automaton()
    found = [model.matches(t, searcher) for t in texts]
    assert [m for _, m in found] == [by_search(model, t) for t in texts]
    assert sum(bool(m) for _, m in found) > 200
    got = {r["text"]: r["score"] for r in T.score(documents(spark, texts), model).join(documents(spark, texts), "doc_id").select("text", "score").collect()}
    for text, (words, m) in zip(texts, found, strict=True):
        assert got[text] == pytest.approx(model.score(sum(w for _, w in m), words))


def test_score_falls_with_length(spark):
    words = prose(random.Random(2), 3000)
    short, long = (r["score"] for r in T.score(documents(spark, ["such a loser " + words[:100], "such a loser " + words]), T.Model()).orderBy("doc_id").collect())
    assert short > long


def test_awkward_rows(spark):
    docs = documents(spark)
    got = T.score(docs, T.Model())
    assert got.count() == docs.count() and got.filter("predicted = 1").count() == 0
    assert sorted(T.drop_toxic(docs, T.Model()).collect(), key=str) == sorted(docs.collect(), key=str)
    empty, labels = documents(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert T.learn(empty, labels) == T.Model() and T.learn(docs, labels) == T.Model()
    assert T.score(empty, T.Model()).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (10, 1, None), (11, None, 1), (11, 0, 0)], labels.schema)
    assert T.learn(docs, odd) == T.Model()
    assert awkward_texts()
