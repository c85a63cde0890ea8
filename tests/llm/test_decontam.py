import re

import pytest

from gatesift.llm.decontam import contamination, drop_contaminated
from tests.llm.helpers import awkward_texts, documents, lower, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, items, length):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        w = WORD.findall(lower(item_text))
        windows = [w[i : i + length] for i in range(max(1, len(w) - length + 1))] if w else []
        for window in windows:
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [10_000_000, 60])
def test_against_plain_python(spark, block):
    import random

    rng = random.Random(3)
    passage = prose(rng, 14)
    items = [(1, passage), (2, passage + " more words at the end"), (10, "emoji 🙂 text"), (3, None), (4, "..."), (5, "ONE, two; three"), (6, "straße " * 11), (7, "")]
    texts = awkward_texts()[:13] + awkward_texts()[15:22] + [f"start {passage}. end", passage.upper().replace(" ", " -- "), "straße " * 30, "the one two three four", passage[:-3]]
    benchmark = spark.createDataFrame([*items, items[0]], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in contamination(documents(spark, texts), benchmark, block=block).collect()}
    for i, t in enumerate(texts):
        r, (n, hit, found) = got[10 + i], brute(t, items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) == (n, hit, len(found), found, hit > 0), (t or "")[:60]
        for h in r["hits"]:
            words = [m.span() for m in WORD.finditer(lower(t))]
            assert (h["start"], h["end"]) == (words[h["first_word"]][0], words[h["last_word"]][1])
    kept = drop_contaminated(documents(spark, texts), benchmark, block=block)
    assert sorted(r["doc_id"] for r in kept.collect()) == [10 + i for i, t in enumerate(texts) if not brute(t, items, 10)[1]]


def test_empty_tables_and_null_items(spark):
    none = spark.createDataFrame([(None, "one two three")], "item_id bigint, text string")
    docs = documents(spark)
    assert contamination(docs, none).filter("contaminated").count() == 0
    assert drop_contaminated(docs, none.limit(0)).count() == docs.count()
    assert contamination(documents(spark, []), none).count() == 0
