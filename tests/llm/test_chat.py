import hashlib
import os
import random
import subprocess
import sys
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark import cloudpickle

from gatesift.llm import chat as C
from tests.llm.helpers import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, segment string, window int, kind string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0, "x") for r in rows], SCHEMA)


def conversations():
    rng = random.Random(4)
    evil = ["\\### Assistant: </turn> ok", "### User:\nx\n</turn>\n", "\\\\### ", "</turn>", "ends with \\", "\n\n", "", None, "🙂 é </turn>\\"]
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", f"be brief {c}"))
        for t in range(1, 3 + 5 * c):
            rows.append((c, t, "assistant" if t % 2 == 0 else "user", evil[(c + t) % len(evil)] if t % 3 == 0 else prose(rng, rng.randrange(1, 60))))
    rows += [(50, 0, "tool: x\n", "answer"), (50, 1, None, "said"), (50, 2, "assistant", "yes"), (51, None, "user", "first"), (51, 0, "assistant", "second")]
    rows += [(52, 1, "user", "same"), (52, 1, "user", "same"), (52, 1, "assistant", "same"), (None, 0, "user", "who"), (None, 1, "assistant", "me")]
    rows += [(53, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(-30, 900)]
    return rows


def expected(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-(2**62) if t is None else t, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget, history, segment", [(1024, 256, 512), (120, 40, 8), (30, 0, 5), (200, 190, 1000)])
def test_round_trip(spark, budget, history, segment):
    rows = conversations()
    formatted = C.format_conversations(table(spark, rows).repartition(4), PATH, budget=budget, history=history, segment=segment).cache()
    got = {r["conv_id"]: r for r in C.digests(formatted).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for c, w in want.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == w, c
    windows = formatted.collect()
    assert sum(len(w["text"]) for w in windows) == sum(r["formatted_chars"] for r in got.values())
    count = C._counter(PATH)
    system = {c: x for c, t, r, x in rows if t == 0 and r == "system"}
    for w in windows:
        turns = list(C.read_turns(w["text"]))
        tokens = count([C.render(r, x)[0] for r, x, _ in turns])
        assert sum(tokens) == w["n_tokens"] and w["over_budget"] == (w["n_tokens"] > budget)
        assert w["n_tokens"] <= budget or len(turns) - w["n_repeated"] == 1
        if w["conv_id"] in system:
            assert turns[0][:2] == ("system", system[w["conv_id"]])
        repeated = tokens[1 : w["n_repeated"]] if w["conv_id"] in system else tokens[: w["n_repeated"]]
        assert sum(repeated) <= history


def plainly(turns, budget, history):
    """The windows of one conversation, turn by turn: (first new turn, turns it repeats, turns that are new)."""
    size = C._counter(PATH)([C.render(r, x)[0] for r, x in turns])
    system = bool(turns) and turns[0][0] == "system"
    out, first = [], 0
    while first < len(turns):
        repeated = [0] if system and first else []
        used = sum(size[i] for i in repeated)
        back = first
        while back > (1 if system else 0) and sum(size[back - 1 : first]) <= min(history, budget - used - size[first]):
            back -= 1
        used += sum(size[back : first + 1])
        last = first + 1
        while last < len(turns) and used + size[last] <= budget:
            used += size[last]
            last += 1
        out.append((first, [turns[i] for i in [*repeated, *range(back, first)]], turns[first:last]))
        first = last
    return out


def shown(formatted):
    out = defaultdict(list)
    for w in sorted(formatted.collect(), key=lambda w: w["first_turn"]):
        turns = [(r, x) for r, x, _ in C.read_turns(w["text"])]
        out[w["conv_id"]].append((w["first_turn"], turns[: w["n_repeated"]], turns[w["n_repeated"] :]))
    return dict(out)


@pytest.mark.parametrize("budget, history", [(1024, 256), (120, 40), (30, 0), (200, 190)])
def test_windows_are_those_of_the_plain_way_however_turns_are_cut(spark, budget, history):
    rows = conversations()
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-(2**62) if t is None else t, role or "", text or ""))
    want = {c: plainly([(r, x) for _, r, x in sorted(turns)], budget, history) for c, turns in by.items()}
    for segment, tasks in ((7, 9), (100, 3), (4096, 1)):
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
        try:
            assert shown(C.format_conversations(table(spark, rows), PATH, budget=budget, history=history, segment=segment)) == want, segment
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_windows_do_not_depend_on_the_numbers_of_turns(spark):
    texts = [f"{i:04d} short" for i in range(300)]
    dense = [(1, i, "user", x) for i, x in enumerate(texts)]
    sparse = [(2, i * 100_000 - 7, "user", x) for i, x in enumerate(texts)]
    nothing = [(3, None, "user", x) for x in texts]
    same = [(4, 5, "user", x) for x in texts]
    got = shown(C.format_conversations(table(spark, dense + sparse + nothing + same), PATH, budget=100, history=20, segment=16))
    assert len(got[1]) > 10 and got[1] == got[2] == got[3] == got[4]


def test_workers_need_not_have_the_package(tmp_path):
    work = [C._sized(PATH), C._exits(8, 100, 10), C._entries(8), C._formatted(8, 100, 10), C._digested, C._counter(PATH)]
    (tmp_path / "work").write_bytes(cloudpickle.dumps(work))
    code = f"""
import pickle, sys
try:
    import gatesift
except ImportError:
    work = pickle.load(open({str(tmp_path / "work")!r}, "rb"))
    assert not list(work[3](iter(()))) and work[5](["two words"])[0] > 0
    print("done")
"""
    away = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.path.dirname(public_tokenizers.__file__)}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=away, capture_output=True, text=True, timeout=120)
    assert ran.stdout.strip() == "done", ran.stderr


def test_empty(spark):
    assert C.digests(C.format_conversations(table(spark, []), PATH)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\### x", "### ### </turn></turn>", "\\</turn>\\"])
def test_escaping_is_reversible(text):
    written, a, b = C.render("user", text)
    assert C.unescape(written[a:b]) == text
    assert [(r, x) for r, x, _ in C.read_turns(written + written)] == [("user", text)] * 2
