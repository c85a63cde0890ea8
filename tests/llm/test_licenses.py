import random
import re

import pytest

from gatesift.llm import licenses as L
from gatesift.llm import registry
from gatesift.llm.license_texts import NOTICES
from gatesift.llm.licenses import EVERY
from tests.llm.helpers import awkward_texts, documents, prose


def brute(text):
    words = [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]
    out = {}
    for name, notice in NOTICES.items():
        own = L.template_words(notice)
        template = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        stride = L.stride_of(len(own))
        for start in range(0, max(len(words), 1), stride):
            part = words[start : start + 2 * stride]
            share = len(template & {tuple(part[i : i + 5]) for i in range(len(part) - 4)}) / len(template)
            if share >= 0.8 and share > out.get(name, (0, 0))[0]:
                out[name] = (share, start)
    return out


def test_every_notice_is_found_wherever_it_stands(spark):
    rng = random.Random(1)
    texts = []
    for notice in NOTICES.values():
        edited = notice.split()
        edited[len(edited) // 2] = "changed"
        texts += [notice, prose(rng, 37) + " " + notice.upper() + " " + prose(rng, 50), prose(rng, 11) + ". " + " ".join(edited), notice[: len(notice) // 2]]
    texts += awkward_texts() + ["license " * 50, "under the sea, a software release"]
    got = {}
    for r in L.scan_licenses(documents(spark, texts)).collect():
        got.setdefault(r["doc_id"] - 10, {})[r["license"]] = (r["containment"], r["start_word"])
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: (pytest.approx(v[0]), v[1]) for k, v in got.get(i, {}).items()} == want, t
    assert all(set(NOTICES) <= {n for g in got.values() for n in g} for _ in (0,))


def test_screens_lose_nothing():
    for share in (0.5, 0.8, 1.0):
        needed = set(L.needed_words(NOTICES, share))
        for notice in NOTICES.values():
            words = L.template_words(notice)
            shingles = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
            assert sum(not needed & set(s) for s in shingles) < share * len(shingles)


def test_band_settings_guarantee_retrieval():
    for stride, (bands, rows) in L.band_settings(NOTICES, 0.8, 1e-4).items():
        for notice in NOTICES.values():
            n = len(L.template_words(notice))
            if L.stride_of(n) == stride:
                held = -(-8 * (n - 4) // 10)
                similarity = held / (2 * stride - 4 + (n - 4) - held)
                assert (1 - similarity**rows) ** bands <= 1.1e-4


def test_native_repeated_and_empty(spark):
    line = NOTICES["mit-line"]
    got = L.scan_licenses(spark.createDataFrame([(1, line), (1, line), (None, line)], "doc_id bigint, text string"))
    assert got.count() == 3
    assert L.scan_licenses(documents(spark, [])).count() == 0
    assert not re.search("MapInArrow|MapInPandas|ArrowEvalPython", got._jdf.queryExecution().executedPlan().toString())


def held(texts, templates):
    """Every template in every window, by shingles of at most five words."""
    out = {}
    for doc, text in enumerate(texts):
        words = L.template_words(text)
        for name, notice in templates.items():
            own = L.template_words(notice)
            k, stride = min(5, len(own)), L.stride_of(len(own))
            template = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
            for start in range(0, max(len(words), 1), stride):
                part = words[start : start + 2 * stride]
                share = len(template & {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}) / len(template)
                if share >= 0.8 and share > out.get((doc, name), (0, 0))[0]:
                    out[doc, name] = (share, start)
    return out


def found(spark, texts, templates):
    return {(r["doc_id"] - 10, r["license"]): (pytest.approx(r["containment"]), r["start_word"]) for r in L.scan_licenses(documents(spark, texts), templates=templates).collect()}


def test_lines_of_few_words_are_found_wherever_they_stand(spark):
    rng = random.Random(2)
    texts = [prose(rng, n) + " " + line + " " + prose(rng, n % 3) for line in ("ALL rights reserved.", "CC0 1.0 Universal", "SPDX-License-Identifier: MIT") for n in range(0, 34)]
    texts += list(EVERY.values()) + ["all rights", "all rights are reserved", "reserved all rights", "reserved", "all rights reserved " * 20]
    want = held(texts, EVERY)
    assert found(spark, texts, EVERY) == want
    assert {n for _, n in want} == set(EVERY) and sum(n == "all-rights-reserved-line" for _, n in want) >= 36
    few = {"one": "reserved", "two": "all rights"}
    assert found(spark, texts, few) == held(texts, few)
    with pytest.raises(ValueError):
        L.scan_licenses(documents(spark, texts), templates={"none": "..."})


def test_query_finds_bare_lines(spark, tmp_path):
    text = "the river and the stone " * 9
    spark.createDataFrame([(1, text + "All rights reserved."), (2, text), (3, text + NOTICES["mit-line"])], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r["doc_id"], r["license"]) for r in registry.op8_licenses(spark, str(tmp_path)).collect()) == [(1, "all-rights-reserved-line"), (3, "mit-line")]
