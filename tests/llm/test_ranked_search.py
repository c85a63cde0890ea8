import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gatesift.llm.ranked_search import groups_by_mask, search
from tests.llm.helpers import WORDS, awkward_texts, documents, lower, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, top=20):
    """Item to its best documents, every pair scored."""
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        found = []
        for i, c in counts:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_words
            score = 0
            for t in TERM.findall(lower(text)):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i))
        out[item] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:top])]
    return {k: v for k, v in out.items() if v}


def table(spark, items):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id bigint, text string, _term string, rank int")


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("options", [{}, {"block_terms": 5, "block_docs": 3}])
def test_against_all_pairs(spark, options):
    rng = random.Random(3)
    texts = awkward_texts() + [prose(rng, rng.randint(1, 40)) for _ in range(120)]
    items = [(1, "alpha beta beta house"), (2, "Été x1 42"), (3, "nothing here known"), (4, ""), (5, None), (6, " ".join(WORDS) + " castle"), (7, "don't ONE two")]
    docs = documents(spark, texts).repartition(3)
    assert got(search(docs, table(spark, items), top=7, **options)) == ranked([(10 + i, t) for i, t in enumerate(texts)], items, 7)


def test_more_than_64_terms_and_ties(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.sample(words, 30)) for _ in range(90)] * 2
    items = [(1, " ".join(words[:150])), (2, " ".join(words[100:180] * 2))]
    docs = documents(spark, texts).repartition(4)
    assert got(search(docs, table(spark, items), block_docs=16)) == ranked([(10 + i, t) for i, t in enumerate(texts)], items)


def test_masks():
    rng = np.random.default_rng(1)
    presence = rng.random((150, 300)) < 0.02
    group, first = groups_by_mask(presence)
    columns = [presence[:, d].tobytes() for d in range(300)]
    assert len(set(columns)) == len(first)
    assert all((group[a] == group[b]) == (columns[a] == columns[b]) for a in range(300) for b in range(0, 300, 7))
    assert all(group[f] == g for g, f in enumerate(first))


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "stone"), (2, "stone"), (2, "stone"), (1, "stone"), (9, "other words here")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, "stone"), (7, "stone"), (7, "other")], "item_id bigint, text string")
    rows = search(docs, items).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["item_id"] is None] == [(1, 1), (2, 2), (3, 2), (4, None)]
    assert sorted(r["rank"] for r in rows if r["item_id"] == 7) == [1, 2, 3, 4, 5]


def test_empty(spark):
    items = table(spark, [(1, "alpha")])
    assert search(documents(spark, []), items).count() == 0
    assert search(documents(spark, [None, "", "..."]), items).count() == 0
    assert search(documents(spark), table(spark, [])).columns == ["item_id", "rank", "doc_id", "score"]
    assert search(documents(spark), table(spark, [])).count() == 0
