import random
import re
from collections import Counter

import numpy as np
import pytest

from gatesift.llm.collocations import Index, bwt, collocations, frequent_phrases
from tests.llm.helpers import awkward_texts, documents, lower

WORDS = ["new", "york", "city", "of", "the", "big", "été", "a-b", "🙂"]


def counted(rows, depth=4):
    """Language to the number of its words, and (language, phrase) to occurrences."""
    total, found = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    found[lang or "und", tuple(words[i : i + k])] += 1
    return total, found


def expected(rows, least, depth=4, top=2000):
    total, f = counted(rows, depth)
    out = {}
    candidates = {p: n for p, n in f.items() if n >= least and len(p[1]) > 1}
    absorbed = set()
    for (lang, words), n in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * n >= 80 * f[lang, words[i : i + k]]:
                    absorbed.add((lang, words[i : i + k]))
    for (lang, words), a in candidates.items():
        if (lang, words) in absorbed:
            continue
        cuts = [(2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top])
    }


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.5:
            words += ["New", "York", "City"]
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\r\n"]) for w in words))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 5) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, f int")


def got(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"shard_words": 50, "max_bits": 3 + 13}])
def test_against_plain_python(spark, options):
    rows = [(t, ["en", "de", None][i % 3]) for i, t in enumerate(texts(400, 2))] + [(t, "en") for t in awkward_texts() if len(t or "") < 10_000]
    docs = table(spark, rows).repartition(5)
    want = expected(rows, 5)
    assert len(want) > 200
    assert got(collocations(docs, least=5, **options)) == want
    assert got(collocations(docs, top=3, **options)) == {r for r in expected(rows, 30) if r[1] <= 3}


def test_extensions(spark):
    rows = [("new york city", "en")] * 40 + [("the new york", "en")] * 35 + [("new york", "en")] * 100
    found = {r["phrase"]: (r["left_ext"], r["right_ext"]) for r in collocations(table(spark, rows)).collect()}
    assert found == {"new york": (35, 40), "new york city": (0, 0), "the new york": (0, 0)}


def test_counts_are_whole_for_any_shards(spark):
    rows = [(t, "en") for t in texts(60, 9)]
    _, want = counted(rows, 3)
    for size in (1, 40, 10_000):
        every, totals = frequent_phrases(table(spark, rows).repartition(3), depth=3, least=4, shard_words=size)
        assert {r["phrase"]: r["f"] for r in every.collect()} == {" ".join(w): n for (_, w), n in want.items() if n >= 4}
        assert totals.first()["n"] == sum(n for (_, w), n in want.items() if len(w) == 1)


def test_index():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(0, 5, 500), 0).astype(np.int32)
    index = Index(bwt(text, 4))
    ring = np.concatenate((text, text[:4]))
    interval = index.words()
    for k in range(2, 5):
        interval, starts, counts = index.extended(interval)
        phrases = list(zip(*(p.tolist() for p in index.phrase(starts, k)), strict=True))
        assert dict(zip(phrases, counts.tolist(), strict=True)) == Counter(tuple(ring[i : i + k].tolist()) for i in range(len(text)))


def test_long_text_and_empty(spark):
    long = "alpha beta gamma " * 30_000
    rows = collocations(documents(spark, [long, None, ""])).collect()
    assert {(r["phrase"], r["a"]) for r in rows if r["phrase"].startswith("alpha")} == {("alpha beta gamma alpha", 29_999)}
    assert collocations(documents(spark, [])).count() == 0
    assert collocations(documents(spark, [None, "", " .,\n"])).count() == 0


def test_shards_are_written_and_read_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """Rows of megabytes: a task held up to a hundred of them, in one page, before it wrote any."""
    import random
    import urllib.parse
    from pathlib import Path

    import pyarrow.parquet as pq

    from gatesift.llm import collocations as M

    saved, paths = M.saved, []

    def kept(df, *args, **kwargs):
        out = saved(df, *args, **kwargs)
        paths.extend(Path(urllib.parse.urlparse(f).path) for f in out.inputFiles() if "transform" in out.columns)
        return out

    monkeypatch.setattr(M, "saved", kept)
    rng = random.Random(3)
    texts = [" ".join(rng.randbytes(150_000).hex() for _ in range(4)) + " so it goes" for _ in range(48)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id int, lang string, text string").coalesce(1)
    every, _ = M.frequent_phrases(docs, least=40, shard_words=7)
    assert {r["phrase"]: r["f"] for r in every.collect()} == {p: 48 for p in ("so", "it", "goes", "so it", "it goes", "so it goes")}
    groups = [m.row_group(g) for p in paths for m in [pq.ParquetFile(p).metadata] for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 48
    assert max(g.total_byte_size for g in groups) < 24 << 20
