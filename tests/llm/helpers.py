"""A small table with every awkward case, and plain Python versions of what the operators compute."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, _id string, _text bigint, id bigint, n int, a string, _key string, kept boolean, start int"
WORDS = ["alpha", "beta", "gamma", "delta", "house", "river", "stone", "cloud", "Été", "naïve", "straße", "x1", "42", "don't", "tree"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward_texts():
    rng = random.Random(7)
    long = prose(rng, 60_000)
    base = prose(rng, 120)
    near = base.replace("house", "castle", 2)
    return [
        None, "", " ", "\n\t", "one", "one two", "one two three", "ONE  two\nthree", base, base, base + " ", near, near.upper(), long,
        long[:-10] + "end", "é" * 300, "🙂 emoji 🙂 text 🙂", "\u0000zero", "a\u00a0b", base + " " + prose(rng, 3), prose(rng, 12), prose(rng, 12), "x" * 150_000,
    ]


def documents(spark, texts=None, first=10):
    texts = awkward_texts() if texts is None else texts
    rows = [(first + i, t, "en", "clash", i, i, 1, "a", "k", False, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
