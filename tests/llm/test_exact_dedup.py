import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from gatesift.llm.exact_dedup import drop_copies, exact_duplicates
from tests.llm.helpers import awkward_texts, documents


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_against_plain_python(spark):
    texts = awkward_texts()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(10 + i)
    got = {r["doc_id"]: r for r in exact_duplicates(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), i == min(ids))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    kept = drop_copies(documents(spark, texts))
    assert kept.columns == documents(spark, texts).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(ids) for ids in groups.values())


def test_full_bitmap_changes_nothing(spark):
    docs = documents(spark)
    assert sorted(exact_duplicates(docs, bits=15, prefix=1).collect()) == sorted(exact_duplicates(docs).collect())


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "same text"), (3, "same text"), (3, "same text"), (None, "only null"), (None, "only null"), (4, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_duplicates(docs).drop("text_sha256").collect()]
    assert sorted(got, key=str) == sorted(
        [(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 2, True), (None, None, 2, True), (4, 4, 1, True)], key=str
    )
    assert sorted((r["doc_id"], r["text"]) for r in drop_copies(docs).fillna(-1).collect()) == [(-1, "only null"), (3, "same text"), (4, "other")]


def test_empty(spark):
    assert exact_duplicates(documents(spark, [])).count() == 0
    assert drop_copies(documents(spark, [])).count() == 0


def test_hot_group_and_no_shuffle_of_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy of the hot text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_duplicates(docs)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 and keep_id = 0").count() == 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("_norm" in line for line in exchanges)
