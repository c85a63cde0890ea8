import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gatesift.llm import token_counts as T
from tests.llm.helpers import awkward_texts, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, path, limit=512):
    tokenizer = Tokenizer.from_file(path)
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"] - 10] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > limit), text[:50]


@pytest.mark.parametrize("block", [T.BLOCK, 40])
def test_counts(spark, block):
    texts = [*awkward_texts(), "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "don't 'sx ''s we'll", "\r\n \u0085 x"]
    check(T.count_tokens(documents(spark, texts), PATH, block=block).collect(), texts, PATH)


def test_vocabulary_with_its_own_pre_tokenizer(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  World, don't", "", None, "éa ÉA 42"]
    check(T.count_tokens(documents(spark, texts), path, limit=3).collect(), texts, path, limit=3)


@pytest.mark.parametrize("common", [1, 50, 10**9])
def test_common_and_rare_pre_tokens_give_the_same(spark, common):
    texts = [*awkward_texts(), *(f"word{i} common words here <|endoftext|>" for i in range(200)), "x" * 100, "x" * 101, "", None]
    check(T.count_tokens(documents(spark, texts), PATH, common=common).collect(), texts, PATH)


@pytest.mark.parametrize("held", [3, T.HELD])
def test_each_pre_token_is_counted_once(spark, held):
    texts = [f"word{i % 20} common words here {'y' * (i % 3 + 60)}" for i in range(200)]
    table = T.pre_token_table(documents(spark, texts).repartition(7), PATH, held=held).collect()
    keys = [r["key"] for r in table]
    assert len(keys) == len(set(keys)) == 1 + 20 + 3 + 3
    of = Tokenizer.from_file(PATH)
    for r in table:
        if len(r["key"]) <= T.LONG:
            assert r["pieces"] == len(of.encode(r["key"], add_special_tokens=False).ids)
    assert {r["key"]: r["n"] for r in table}[" common"] == 200


def test_frequencies_move_once_by_pre_token(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [*awkward_texts(), *(f"word{i} common words here" for i in range(50))]
        got = T.count_tokens(documents(spark, texts), PATH, common=20)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # Frequencies and numbers of pieces by pre-token, then what is summed by row.
        assert plan.count("Exchange hashpartitioning(") == 3, plan
        check(got.collect(), texts, PATH)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_repeated_and_null_ids_stay_rows(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "a"), (None, "a b"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["n_tokens"]) for r in T.count_tokens(rows, PATH).collect()))
    assert got == [(0, 0), (0, 2), (1, 1), (1, 3), (1, 3)]


def test_empty(spark):
    assert T.count_tokens(documents(spark, []), PATH).count() == 0
