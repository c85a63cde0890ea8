import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gatesift.llm.packing import pack, sequences, token_ids
from tests.llm.helpers import awkward_texts, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, texts, capacity, waste):
    """Every id of every document in exactly one piece, sequences gapless and within the capacity."""
    documents_, sequences_ = defaultdict(list), defaultdict(list)
    for p in pieces:
        documents_[p["doc_id"]].append(p)
        sequences_[p["sequence_id"]].append(p)
    for i, text in enumerate(texts):
        ids, at = ids_of(text), 0
        for p in sorted(documents_[10 + i], key=lambda p: p["start"]):
            part = np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(part)
            assert p["ids"] is None or p["ids"] == part
            at += p["length"]
        assert at == len(ids)
    room = []
    for own in sequences_.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
        room.append(capacity - at)
    assert sum(r > waste for r in room) <= 1


@pytest.mark.parametrize("capacity, windows, waste, fan_in", [(1024, 64, 8, 64), (16, 2, 0, 2), (7, 1, 3, 2)])
def test_pieces(spark, capacity, windows, waste, fan_in):
    texts = awkward_texts()[:13] + awkward_texts()[15:22]
    docs = documents(spark, texts).repartition(5)
    got = pack(docs, PATH, capacity=capacity, open_windows=windows, waste=waste, fan_in=fan_in)
    check(got.collect(), texts, capacity, waste)
    whole = {r["sequence_id"]: r for r in sequences(got, capacity).collect()}
    for s, r in whole.items():
        assert len(r["ids"]) == 4 * r["n_tokens"] and r["n_tokens"] <= capacity
        assert r["padding"] == (0 if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else capacity - r["n_tokens"])


def test_without_ids(spark):
    texts = awkward_texts()[:13]
    got = pack(documents(spark, texts), PATH, keep_ids=False).collect()
    check([r.asDict() | {"ids": None} for r in got], texts, 1024, 8)


def test_empty(spark):
    assert pack(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("text", ["", "<|endoftext|> a<|endoftext|>", "\n" * 400_000, " " * 5000 + "x", "a\r\n\u0085b\u2028 c", "don't 'sx ''s", "é🙂" * 50])
def test_ids_are_those_of_the_library(text):
    assert token_ids(text, PATH).tolist() == ids_of(text)


def test_long_text_is_cut_between_pre_tokens(monkeypatch):
    import random

    from gatesift.llm import packing
    from tests.llm.helpers import prose

    monkeypatch.setattr(packing, "PART", 50)
    text = prose(random.Random(1), 3000) + "  two   blanks \n\n end <|endoftext|> x"
    assert token_ids(text, PATH).tolist() == ids_of(text)
