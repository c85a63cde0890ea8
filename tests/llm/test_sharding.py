import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gatesift.llm.sharding import own_shards, shard
from tests.llm.helpers import awkward_texts, documents


def size_of(text):
    return len((text or "").encode()) + 1


def smallest_maximum(sizes, shards):
    """Minimax over contiguous runs, by the whole table of possibilities."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    best = [total[i] for i in range(len(total))]
    for _ in range(shards - 1):
        best = [min(max(best[j], total[i] - total[j]) for j in range(i + 1)) for i in range(len(total))]
    return best[-1]


def check(rows, texts, shards):
    """Groups stay together, slots have no gaps, columns say what they should; returns bytes per shard."""
    assert len(rows) == len(texts)
    where, slots, loads = defaultdict(set), defaultdict(list), [0] * shards
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == size_of(text) and r["text_crc32"] == zlib.crc32(text.encode())
        where[text].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


@pytest.mark.parametrize("shards,probes", [(1, 32), (3, 7), (20, 64)])
def test_capacity_is_the_smallest(spark, shards, probes):
    rng = random.Random(shards)
    texts = dict(enumerate("t" * rng.randint(0, 400) + rng.choice("abc") for _ in range(150)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    loads = check(shard(docs, shards, probes=probes).collect(), texts, shards)
    # The order of groups is that of their hashes; groups of an even share come first, each in a shard of its own.
    hashed = docs.select(F.xxhash64("text", F.crc32(F.col("text").cast("binary"))).alias("h"), "text").distinct().collect()
    size = defaultdict(int)
    for t in texts.values():
        size[t] += size_of(t)
    largest = sorted(size.values(), reverse=True)[:shards]
    own = own_shards(largest, sum(size.values()), shards)
    ordered = [size[r["text"]] for r in sorted(hashed)]
    rest = sorted(size.values(), reverse=True)[:own]
    for s in rest:
        ordered.remove(s)
    assert max(loads[own:]) == smallest_maximum(ordered, shards - own)


def test_awkward_texts(spark):
    texts = {10 + i: t for i, t in enumerate(awkward_texts())}
    got = shard(documents(spark)).collect()
    check(got, texts, 8)
    assert got[0].asDict().keys() == {"doc_id", "size", "text_crc32", "shard", "slot"}
    assert {r["shard"] for r in got if not texts[r["doc_id"]]} == {next(r["shard"] for r in got if texts[r["doc_id"]] == "")}


def test_hot_group_gets_a_shard_and_the_rest_is_even(spark):
    texts = {i: "the hot text" if i % 3 == 0 else f"text number {i:05d}" for i in range(3000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    loads = check(shard(docs).collect(), texts, 8)
    assert loads[0] == 1000 * 13
    assert max(loads[1:]) - min(loads[1:]) <= 7 * 18


def test_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, None), (1, "a"), (1, "a"), (1, ""), (2, "b")]
    got = shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 2), (2, 2)]
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, i) for s in range(2) for i in range(sum(r["shard"] == s for r in got)))


def test_one_text_only_and_empty(spark):
    one = shard(spark.createDataFrame([(i, "same") for i in range(20)], "doc_id bigint, text string")).collect()
    assert {r["shard"] for r in one} == {0} and sorted(r["slot"] for r in one) == list(range(20))
    assert shard(documents(spark, [])).count() == 0


def test_same_shards_for_any_partitioning(spark):
    docs = documents(spark)
    assert sorted(shard(docs.repartition(7)).collect()) == sorted(shard(docs.coalesce(1)).collect())
