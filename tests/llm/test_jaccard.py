import random
import re

import pytest

from gatesift.llm import jaccard
from gatesift.llm.components import components
from gatesift.llm.jaccard import drop_linked, jaccard_components
from gatesift.llm import shingles
from tests.llm.helpers import awkward_texts, components as plain_components, documents, lower, prose


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(texts, words, percent, first=10):
    sets = {first + i: shingle_set(t, words) for i, t in enumerate(texts)}
    ids = sorted(sets)
    links = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: len(s) for i, s in sets.items()}, plain_components(links, ids)


def family(rng, n, words, edits):
    """Chains of near copies: each is an edited version of some earlier one."""
    vocabulary = [f"w{i}" for i in range(4000)]
    out = [[rng.choice(vocabulary) for _ in range(words)]]
    while len(out) < n:
        copy = list(rng.choice(out))
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            copy += [rng.choice(vocabulary) for _ in range(rng.randrange(4))]
        out.append(copy)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (1, 50)])
def test_against_all_pairs(spark, words, percent):
    rng = random.Random(words)
    shared = " ".join(f"s{i}" for i in range(40))
    texts = awkward_texts()
    for size in (30, 80, 200):
        texts += family(rng, 25, size, 3)
    texts += [shared + " " + prose(rng, 80) for _ in range(15)] + family(rng, 12, 9, 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(documents(spark, texts).repartition(4), words=words, percent=percent).collect()}
    sizes, comps = brute(texts, words, percent)
    assert {i: g[0] for i, g in got.items()} == sizes
    assert {i: g[1] for i, g in got.items()} == comps
    assert len(set(comps.values())) < len(comps) - 20


def near_copies(n):
    """Copies of one text, each with a few other words and a line of its own length: sizes and positions differ."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        copy = list(base)
        for k in range(rng.randrange(3)):
            copy[rng.randrange(200)] = f"x{i}_{k}"
        out.append(" ".join(copy + [f"y{i}_{k}" for k in range(rng.randrange(16))]))
    return out


def test_links_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    edges = []
    monkeypatch.setattr(jaccard, "components", lambda links: (edges.append(links.count()), components(links))[1])
    texts = near_copies(150)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(documents(spark, texts)).collect()}
    assert got == brute(texts, 5, 80)[1]
    assert sum(edges) < 10 * len(texts), edges


def test_drop_linked(spark):
    texts = awkward_texts()
    docs = documents(spark, texts)
    _, comps = brute(texts, 5, 80)
    kept = drop_linked(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comps.values()))


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (7, text + " more"), (9, None), (11, text)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.fillna(-1).collect())) == [(-1, 26, -1), (5, 26, 5), (5, 26, 5), (7, 27, 5), (9, 0, 9), (11, 26, 5)]


def test_drop_linked_decides_by_row(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [
        (1, one), (5, one + " more"), (5, two), (6, two + " more"),  # one text of 5 is linked with 1, the other leads 6
        (8, three), (8, three + " more"), (9, three),  # two linked texts under one id
        (11, "same words under one id " * 2), (11, "same words under one id " * 2), (12, "x"), (12, None), (12, ""), (None, one), (13, "alone"),
    ]
    kept = drop_linked(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept)
    assert len(got) == 9 and sum(i == 8 and t.startswith(three) for i, t in got) == 1
    assert [g for g in got if g[0] != 8] == [(0, one), (1, one), (5, two), (11, "same words under one id " * 2), (12, ""), (12, ""), (12, "x"), (13, "alone")]


def test_empty(spark):
    assert jaccard_components(documents(spark, [])).count() == 0
    assert drop_linked(documents(spark, [])).count() == 0
    assert jaccard_components(documents(spark, [None, "", " "])).filter("component_id = doc_id and n_shingles = 0").count() == 3


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (100, 200)]
    got = {r["vertex"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    texts = [(t or "").encode() for t in awkward_texts()]
    expected = [s.tolist() for s in shingles.shingle_sets(texts, 3)]
    alone = [next(iter(shingles.shingle_sets([t], 3))).tolist() for t in texts]
    assert alone == expected
    assert [len(s) for s in expected] == [len(shingle_set(t, 3)) for t in awkward_texts()]
