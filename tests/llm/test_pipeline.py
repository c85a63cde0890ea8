"""The pipeline and its stages against plain Python, on the smallest tables."""

import os
import re
from collections import defaultdict

import pytest

import corpus_pipeline as P
from gatesift.llm import toxicity
from gatesift.llm.registry import table
from tests.llm.helpers import lower
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_jaccard import brute as linked

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_and_run(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    model = toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))
    searcher = model.automaton()
    kept = {}
    for i, t in docs.items():
        words, hits = model.matches(t or "", searcher)
        if model.score(sum(w for _, w in hits), words) < 0.5:
            kept[i] = t
    groups = defaultdict(list)
    for i, t in kept.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    kept = {min(ids): kept[min(ids)] for ids in groups.values()}
    ids = sorted(kept)
    _, comps = linked([kept[i] for i in ids], 5, 80, first=0)
    kept = {ids[c]: kept[ids[c]] for c in set(comps.values())}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w) for _, t in items for w in _windows(t)}
    suspects = [i for i, t in kept.items() if any(tuple(x) in windows for x in _windows(t))]
    gone = {i for i in suspects if contaminated(kept[i], items, 10)[1]}
    want = set(kept) - gone
    assert 0 < len(want) < len(docs)
    pieces = P.run(spark, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == want
    assert [name for name, _ in P.STAGES] == ["toxicity", "exact dedup", "n-gram jaccard", "benchmark decontamination", "packing"]


def _windows(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return [words[i : i + 10] for i in range(max(1, len(words) - 9))]


def test_stages_take_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
