import itertools
import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatesift.functions import batches, cards, net, signing
from gatesift.functions import text as T
from gatesift.functions.regex import to_java
from gatesift.patterns import content as C


def one(spark, function, values, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {type_}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("t"))).collect()]


NORMAL = {
    "@dmin p4ss": "admin pass",
    "5y5tem": "system",
    "i g n o r e  a l l  p r e v i o u s": "ignore all previous",
    "ignore.all.previous.instructions": "ignoreallpreviousinstructions",
    "act as a hacker": "act as ahacker",
    "  Super-User \t mode ": "superuser mode",
    "a b": "ab",
    "": "",
}


def test_normalize_for_match(spark):
    assert one(spark, T.normalize_for_match, list(NORMAL)) == list(NORMAL.values())


def by_hand(text):
    """The normaliser as a walk over the characters, for comparison on random text."""
    leet = dict(zip("01345@", "oieasa"))
    words, gap, word = [], 0, ""
    single = False
    for ch in text:
        ch = leet.get(ch, ch.lower() if ch.isascii() else ch)
        if "a" <= ch <= "z":
            if word and gap and not (single and gap == 1):
                words.append(word)
                word = ""
            joined = bool(word) and gap == 1
            single = not word or joined
            word += ch
            gap = 0
        elif ch.isspace() or not ch.isprintable():
            gap += 1
    return " ".join(words + [word]).strip()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab1@ .-\té", max_size=25), min_size=50, max_size=50))
def test_normalize_against_walk(spark, texts):
    assert one(spark, T.normalize_for_match, texts) == [by_hand(t) for t in texts]


def test_fold(spark):
    texts = ["раyраl", "ｆｏｏ", "\U0001D400\U0001D41B\U0001D434\U0001D44F", "plain", "ѕ", "в"]
    folded = one(spark, T.fold_confusables, texts)
    assert folded == ["paypal", "foo", "AbAb", "plain", "d", "в"]
    assert one(spark, T.folded_count, texts) == [4, 3, 4, 0, 1, 0]
    assert one(spark, T.fold_confusables, folded) == folded


def test_leet_and_spacing(spark):
    assert one(spark, T.normalize_leet, ["1gn0r3 $7uff"]) == ["ignore stuff"]
    assert one(spark, T.collapse_spacing, ["a b c d", "a b c", "a bc d e", "i g n o r e"]) == ["abcd", "a b c", "a bc d e", "ignore"]


def test_invisible(spark):
    assert one(spark, T.strip_invisible, ["a​b‮c", "x"]) == ["ab[UNICODE_OVERRIDE_REMOVED]c", "x"]
    assert one(spark, T.has_invisible, ["a﻿", "x"]) == [True, False]


def test_null_stays_null(spark):
    for f in (T.normalize_for_match, T.fold_confusables, T.anomaly_score, T.query_shape, T.strip_invisible):
        assert one(spark, f, [None]) == [None]


def test_anomaly_score(spark):
    plain = ["The quick brown fox jumps over the lazy dog", "Please summarise the report for me", "What time is it in Paris?"]
    printable = "".join(map(chr, range(32, 127))) * 20
    scores = one(spark, T.anomaly_score, [*plain, printable, "ñöüäßæø" * 100, ""])
    assert all(s <= 0.2 for s in scores[:3]) and scores[3] >= 0.7 and scores[4] >= 0.7 and scores[5] == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="abcé\U0001F600 ", min_size=1, max_size=30), min_size=30, max_size=30))
def test_entropy(spark, texts):
    def shannon(t):
        return -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values())

    for got, t in zip(one(spark, T.entropy, texts), texts):
        assert got == pytest.approx(shannon(t), abs=1e-9)


def test_repetition(spark):
    texts = ["x" * 49, "x" * 50, "é" * 60, "word " * 9 + "a b c", "word " * 10 + "a b", "abc " * 20]
    assert one(spark, T.has_repetition, texts) == [False, True, False, False, True, False]
    limited = one(spark, T.limit_repetition, ["a" * 11 + "b", "no no no", "no no no no", "é" * 12])
    assert limited == ["aaa[REPETITION_REMOVED]b", "no no no", "no no [WORD_REPETITION_REMOVED]", "ééé[REPETITION_REMOVED]"]


def test_long_runs_do_not_overflow(spark):
    many = "spam " * 50_000
    assert one(spark, T.limit_repetition, [many]) == ["spam spam [WORD_REPETITION_REMOVED]"]


def test_stuffing(spark):
    text = "words " * 2001
    assert one(spark, T.is_stuffed, [text, "w " * 2001, "x" * 20000]) == [True, False, False]
    assert one(spark, T.truncate_stuffed, [text])[0].endswith("words [CONTENT_TRUNCATED_FOR_SAFETY]")


CARDS = {"4532015112830366": True, "5425233430109903": True, "378282246310005": True, "6011000990139424": True,
         "4532015112830367": False, "4532-0151-1283-0366": True, "123456789012": False, "": False}


def test_luhn(spark):
    assert one(spark, cards.luhn_valid, list(CARDS)) == list(CARDS.values())
    assert one(spark, cards.tokenize_card, ["4532 0151 1283 0366", "12"]) == ["XXXX-XXXX-XXXX-0366", "XXXX-XXXX-XXXX-XXXX"]


SSRF = {
    "http://127.0.0.1/": True, "http://[::1]/x": True, "http://[fe80::1%25eth0]/": True, "http://0x7f000001/": True,
    "http://2130706433": True, "http://017700000001/": True, "http://0177.0.0.1/": True, "http://10.1.2.3:80/x": True,
    "file:///etc/passwd": True, "see http://169.254.169.254/latest now": True, "http:///foo": True,
    "http://[::ffff:10.0.0.1]": True, "[fd00::1]": True, "http://user@localhost/": True, "data:text/html,x": True,
    "3000": True, "http://240.0.0.1": True, "http://224.0.0.1": True, "http://[ff02::1]/": True,
    "https://example.com/a": False, "http://8.8.8.8": False, "hello world": False, "mailto:a@b": False, "": False,
    "http://172.32.0.1": False, "http://[2001:db8::1]/": False, "http://256.0.0.1/": False, "http://127.0.0.1.example.com": False,
    "200": False, "a [note] here": False, "http://[1:2:3:4:5:6:7:8:9]/": False,
}


def test_ssrf(spark):
    assert dict(zip(SSRF, one(spark, net.ssrf_target, list(SSRF)))) == SSRF


def test_resource_uri(spark):
    allowed = ["https://example.com/a", "http://8.8.8.8/", "http://0x7f000001/"]
    refused = ["file:///x", "ftp://a", "javascript:alert(1)", "http://LOCALHOST/", "http://a.localhost/", "http://metadata.google.internal/",
               "http://192.168.0.1/", "http://[::]/", "http://[ff05::1]/", "http://224.1.1.1/"]
    reasons = one(spark, net.resource_uri_reason, allowed + refused)
    assert reasons[:3] == [None] * 3 and all(reasons[3:])


def test_signing(spark):
    import base64
    import hashlib
    import hmac

    for key in (b"short", b"k" * 64, b"long" * 40):
        got = one(spark, lambda t: signing.hmac_sha256(t, key), ["héllo", ""])
        assert got == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("héllo", "")]
    with pytest.raises(ValueError):
        signing.hmac_sha256(F.lit("x"), b"")
    encoded = one(spark, lambda t: signing.base64url(F.encode(t, "UTF-8")), ["a", "ab", "abc", "ÿ?>" * 40])
    assert encoded == [base64.urlsafe_b64encode(t.encode()).rstrip(b"=").decode() for t in ("a", "ab", "abc", "ÿ?>" * 40)]
    assert one(spark, signing.from_base64url, encoded + ["a", "!!"]) == ["a", "ab", "abc", "ÿ?>" * 40, None, None]


def test_sql_text(spark):
    from gatesift.functions.regex import sql_text

    for text in ("${user.name} $1 \\$", "it's", 'a"b', "back\\slash\\u0041", "line\nfeed\r\t", "é\u202e\U0001F600", "%_", "${system:x}", ""):
        assert spark.range(1).select(F.expr(sql_text(text))).first()[0] == text


def test_dialect(spark):
    """Where the JVM's engine differs from RE2, the translated pattern follows RE2."""
    cases = [
        (r"\bA12\b", "éA12", True), (r"\bA12\b", "xA12", False), (r"a.b", "a\rb", True), (r"a.b", "a b", True), (r"a.b", "a\nb", False),
        (r"^ab$", "ab\n", False), (r"a\sb", "a\x0bb", False), (r"[\s]b", "\x0bb", False), (r"[([{]", "[", True), (r"<a[\s\S]*?b", "<a\x0b\n b", True),
        (r"(?i)fête", "FÊTE", True), (r"[^\s]+x", "\x0bx", True),
    ]
    rows = spark.createDataFrame([(t,) for _, t, _ in cases], "t string")
    for pattern, text, expected in cases:
        got = rows.filter(F.col("t") == text).select(F.rlike("t", F.lit(to_java(pattern)))).first()[0]
        assert got is expected, (pattern, text)


def test_repetition_by_words_as_a_plain_loop_has_it(spark):
    """Rows are judged together, so a run must not go on in the next row; blanks are those of the JVM, vertical tab included."""
    blank = "[\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

    def plain(text):
        words = [w for w in re.split(blank, text) if w]
        runs = [(w, len(list(same))) for w, same in itertools.groupby(words)]
        return bool(re.search(r"([\x00-\x7f])\1{49}", text)) or len(words) > 10 and any(n >= 10 and len(w.encode()) > 3 for w, n in runs)

    cases = ["word " * 11, "word " * 9, "x " + "word " * 10, "word " * 10, "a " * 30, "éé " * 11, "word\x0b" * 11, "word\xa0" * 11, "word\x1c" * 11, "",
             " ", "word " * 5 + "other " + "word " * 6, "word", "word " * 6, "word " * 6, "z" * 50, "z" * 49, "\n" * 50, "é" * 60, "a " * 3 + "wörter　" * 10]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, text string").coalesce(1)
    got = {r["i"]: r["hit"] for r in df.select("i", T.has_repetition(F.col("text")).alias("hit")).collect()}
    assert got == {**{i: plain(t) for i, t in enumerate(cases)}, len(cases): None}


def test_base64_runs_are_found_in_a_batch(spark):
    df = spark.createDataFrame([(0, "no run"), (1, "a" * 20 + "== b " + "B" * 24 + "\U000f0000"), (2, None), (3, "x" * 19)], "i int, text string")
    got = {r["i"]: r["found"] for r in df.select("i", batches.find_all(F.col("text"), C.BASE64_RUN).alias("found")).collect()}
    assert got == {0: [], 1: ["a" * 20 + "==", "B" * 24], 2: [], 3: []}
