import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatesift.llm.pii import counted, find_pii, listed
from tests.llm.helpers import awkward_texts, documents

# Plain form of the four base kinds.
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(n if i % 2 == 0 else 2 * n - 9 * (n > 4) for i, n in enumerate(int(c) for c in reversed(d))) % 10 == 0


def confirmed(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    return {"email": True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, x) in enumerate(BASE) for m in re.finditer(x, text or "") if confirmed(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TEXTS = [
    "a@b.c_d@e.f a@b..c x@y-z.co.uk. @a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111111", "+1 (555) 010-9999 +1 555 +49 30 123456789012345 ++441632960961",
    "é𝔘 card 4111111111111111 🙂 a@b.de 🙂 10.0.0.1", "1 " * 20000, "a." * 20000 + "@x.y", "x@" + "a." * 20000 + "b", "+1" + " " * 50000 + "2", "9" * 30000,
    "5500005555555559 12 5500005555555559", "1.1.1.1 " * 500, "tel +4930123456789, +4930123456789 " * 20,
]


def test_base_spans(spark):
    texts = TEXTS + awkward_texts()
    rows = find_pii(documents(spark, texts)).select("doc_id", listed(F.col("base_spans")).alias("got"), *[counted(F.col("base_spans"), k).alias(k) for k, _ in BASE]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"] - 10])
        assert r["got"] == want
        kinds = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert all(r[k] == kinds[k] for k, _ in BASE)


@pytest.mark.parametrize("text, found", [
    ("IBAN DE89 3704 0044 0532 0130 00 now", [("iban", 5, 32)]), ("GB82WEST12345698765432", [("iban", 0, 22)]), ("GB82WEST12345698765433", []), ("DE89370400440532013001", []),
])
def test_account_numbers(spark, text, found):
    spans = find_pii(documents(spark, [text])).first()["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans if s["kind"] == "iban"] == found


def test_context_moves_the_score(spark):
    texts = ["server address 10.1.2.3", "here 10.1.2.3", "version 10.1.2.3"]
    high, mid, low = (r["base_spans"][0]["score"] for r in find_pii(documents(spark, texts)).orderBy("doc_id").collect())
    assert high > mid > low


def test_native_and_empty(spark):
    got = find_pii(documents(spark, []))
    assert got.count() == 0
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
