"""Chat formatting in windows of a token budget, with a loss mask over what the assistant says.

A turn is written as `### Role:`, its text and `</turn>`, each on a line of its own. A control string inside a text gets
one more backslash before it, whatever backslashes it has, so reading back takes one away. Windows are aligned to
turns: prefix sums of the turns' tokens tell how many fit. Every window after the first begins with the conversation's
system turn and a limited history, both repeated; only assistant texts that are new in a window are under its mask, so
every text is learned once. A turn which alone is over the budget makes a window of its own, marked `over_budget`.

Rows are ordered by turn, then role and text, and numbered by position: sparse, repeated and NULL turns make the windows
that turns without gaps make. Conversations are cut into segments of positions, which are formatted in parallel, so one
conversation of any length is no single task. A segment also gets the system turn and those turns around it that a window
may reach; where its first window begins follows from the segments before it. For every place where a window can enter a
segment the place where the chain of windows leaves it is found in parallel, and these small maps are followed segment by
segment. So windows do not depend on how a conversation was cut.

NULL text and NULL role count as empty, a NULL turn comes first, rows with NULL conversation make up one conversation,
repeated rows are turns of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatesift.llm.common import plain, saved, text_or_empty
from gatesift.llm.packing import token_ids  # travels by value, like all that workers run

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUDGET, HISTORY = 1024, 256  # tokens of a window, and of the repeated turns in it
SEGMENT = 4096  # turns of a segment
HEAD, END = "### ", "</turn>"
CONTROL = re.compile(r"\\*(?:### |</turn>)")
ESCAPED = re.compile(r"\\(\\*(?:### |</turn>))")
NAMED = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMED.items()}


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is written, and where its escaped text begins and ends."""
    head = f"{HEAD}{NAMED.get(role) or '=' + quote(role, safe='')}:\n"
    body = escape(text)
    return f"{head}{body}\n{END}\n", len(head), len(head) + len(body)


def read_turns(text: str) -> Iterator[tuple[str, str, int]]:
    """Role, unescaped text and place of the escaped text of every turn of a formatted window."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        if not text.startswith(HEAD, at) or text[line - 1] != ":":
            raise ValueError(f"no turn begins at {at}")
        name = text[at + len(HEAD) : line - 1]
        end = text.index(f"\n{END}\n", line)
        yield ROLES.get(name) or unquote(name[1:]), unescape(text[line + 1 : end]), line + 1
        at = end + len(END) + 2


def span(total: np.ndarray, first: int, low: int, fixed: int, budget: int, history: int) -> tuple[int, int]:
    """The window whose first new turn is `first`: where its history begins (not before `low`) and where it ends.

    `total` has the prefix sums of the turns' tokens, `fixed` the tokens of a repeated system turn.
    """
    room = min(history, budget - fixed - int(total[first + 1] - total[first]))
    back = min(max(int(np.searchsorted(total, total[first] - room)), low), first) if room > 0 else first
    left = budget - fixed - int(total[first] - total[back])
    return back, max(int(np.searchsorted(total, total[first] + left, side="right")) - 1, first + 1)


def windows(turns: Iterator[tuple[int, str, str, int]], system: tuple[str, int] | None, entry: int, end: int, budget: int, history: int) -> Iterator[dict]:
    """The windows that begin at `entry` or later and before `end`, over turns (position, role, text, tokens) in order.

    Turns from as many positions before `entry` as history has tokens to as many after `end` as the budget has must be
    given, if the conversation has them. `system` is the text and size of the conversation's system turn at position 0.
    No more turns are held than a window and its history have.
    """
    held: list[tuple[int, str, str, int]] = []  # history, then turns of the next window
    ahead, at = 0, entry

    def window() -> tuple[dict, int]:
        first = next(i for i, t in enumerate(held) if t[0] >= at)
        repeats = system is not None and held[first][0] > 0
        total = np.concatenate(([0], np.cumsum([t[3] for t in held])))
        low = 1 if system is not None and held[0][0] == 0 else 0
        back, last = span(total, first, low, system[1] if repeats else 0, budget, history)
        text, mask = "", []
        if repeats:
            text = render("system", system[0])[0]
        for i in range(back, last):
            written, a, b = render(held[i][1], held[i][2])
            if i >= first and held[i][1] == "assistant":
                mask.append((len(text) + a, len(text) + b))
            text += written
        size = int(total[last] - total[back]) + (system[1] if repeats else 0)
        made = {"first_turn": held[first][0], "text": text, "mask": mask, "n_repeated": first - back + repeats, "n_tokens": size, "over_budget": size > budget}
        return made, last

    for turn in chain(turns, (None,)):
        if turn is not None:
            held.append(turn)
            if turn[0] < at:
                _trim(held, len(held), history)
                continue
            ahead += turn[3]
        while ahead and at < end and (turn is None or ahead > budget):
            made, last = window()
            yield made
            at = held[last - 1][0] + 1
            ahead = sum(t[3] for t in held[last:])
            _trim(held, last, history)
        if at >= end:
            return


def _trim(held: list[tuple[int, str, str, int]], first: int, history: int) -> None:
    """Drops the turns that are too far before `first` to be history."""
    size, back = 0, first
    while back and size + held[back - 1][3] <= history:
        back -= 1
        size += held[back][3]
    del held[:back]


COLUMNS = ["conv_id", "first_turn", "text", "mask", "n_repeated", "n_tokens", "over_budget"]
MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    return lambda texts: [len(token_ids(t, path)) - 1 for t in texts]


def _sized(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order with the tokens of their written turns and their place among the conversation's rows of this task."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, part = _counter(path), TaskContext.get().partitionId()
        key, place = None, 0
        for batch in batches:
            conv, role, text = (c.to_pylist() for c in batch.columns)
            places = []
            for c in conv:
                place = place + 1 if key == (c,) else 0
                key = (c,)
                places.append(place)
            tokens = count([render(r, t)[0] for r, t in zip(role, text, strict=True)])
            more = [pa.array([part] * len(conv), pa.int32()), pa.array(places, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["conv_id", "role", "text", "part", "place", "tokens"])

    return sized


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with the same first columns, one row after the other."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda row: row[:keys])


def _exits(segment: int, budget: int, history: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For every segment: where the chain of windows that enters at its first, second, ... turn begins its next segment."""

    def table(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        conv, seg, exits = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(seg, pa.int64()), pa.array(exits, pa.list_(pa.int64()))], ["conv_id", "segment", "exits"])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kind, out = first.schema.field(0).type, []
        for (conv, number), rows in _groups(chain((first,), batches), 2):
            rows = [row[2:] for row in rows]  # at most `segment` + `budget` + `history` numbers
            system = rows.pop(0)[2] if rows[0][0] == 0 else None
            base, begin, end = rows[0][1], number * segment, (number + 1) * segment
            total = np.concatenate(([0], np.cumsum([r[2] for r in rows])))
            low = 1 if system is not None and base == 0 else 0
            leaves: dict[int, int] = {}
            for p in range(min(end, base + len(rows)) - 1, begin - 1, -1):
                last = base + span(total, p - base, low, system if system is not None and p > 0 else 0, budget, history)[1]
                leaves[p] = leaves.get(last, last)
            out.append((conv, number, [leaves[p] for p in range(begin, min(begin + budget, end)) if p in leaves]))
            if len(out) >= 100:
                yield table(out, kind)
                out = []
        if out:
            yield table(out, kind)

    return exits


def _entries(segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Follows the maps of a conversation from position 0: the first window of every segment in which one begins."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for batch in batches:
            out = []
            for conv, number, exits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv,):
                    key, at = (conv,), 0
                inside = at - number * segment
                if 0 <= inside < len(exits):
                    out.append((conv, number, at))
                    at = exits[inside]
            conv, number, place = zip(*out, strict=True) if out else ((), (), ())
            types = [batch.schema.field(0).type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((conv, number, place), types, strict=True)], ["conv_id", "segment", "place"])

    return entries


def _formatted(segment: int, budget: int, history: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def table(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), MASK, pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], COLUMNS)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kind, out = first.schema.field(0).type, []
        for (conv, number), rows in _groups(chain((first,), batches), 2):
            entry, system, turn = (0 if number == 0 else None), None, None
            for _, _, of, place, role, text, tokens in rows:
                if of == ENTRY:
                    entry = place
                elif of == SYSTEM:
                    system = (text, tokens)
                else:
                    turn = (place, role, text, tokens)
                    break
            if entry is None or turn is None:
                continue
            rest = ((place, role, text, tokens) for _, _, _, place, role, text, tokens in rows)
            for w in windows(chain((turn,), rest), system, entry, (number + 1) * segment, budget, history):
                mask = [{"start": a, "end": b} for a, b in w["mask"]]
                out.append((conv, w["first_turn"], w["text"], mask, w["n_repeated"], w["n_tokens"], w["over_budget"]))
                if len(out) >= 500:
                    yield table(out, kind)
                    out = []
        if out:
            yield table(out, kind)

    return formatted


ENTRY, SYSTEM, TURN = -1, 0, 1  # kinds of rows that a segment gets, in this order


def positions(conversations: DataFrame, path: str, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Every turn with its position in its conversation, from 0, and the tokens of its written form: a saved table.

    Rows are put in order over all conversations, so a long one lies in many tasks. What goes before in earlier tasks is
    known for the one conversation that a task may begin in the middle of: at most one row per task.
    """
    at = F.coalesce(F.col(turn).cast("bigint"), F.lit(-(2**62)))
    rows = plain(conversations, conv, turn, role, text).select(
        F.col(conv).alias("conv_id"), at.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), text_or_empty(text).alias("text")
    )
    # Range bounds are sampled to the driver: the beginning of a text is enough, ties stay together.
    ordered = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64))
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = saved(ordered.mapInArrow(_sized(path), f"conv_id {kind}, role string, text string, part int, place bigint, tokens bigint"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before))
    parts = parts.filter("before IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "before")
    joined = placed.join(F.broadcast(parts), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "role", "text", "tokens")


def format_conversations(
    conversations: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT,
) -> DataFrame:
    """Windows `conv_id, first_turn, text, mask, n_repeated, n_tokens, over_budget`; the mask counts code points.

    `first_turn` is the position of the first turn that is new in the window.
    """
    rows = positions(conversations, path, conv, turn, role, text)
    kind = rows.schema["conv_id"].dataType.simpleString()
    # A turn has at least one token, so windows reach no more turns than they may have tokens.
    reached = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("place") - budget) / segment)), F.floor((F.col("place") + history) / segment))
    near = rows.select("conv_id", F.explode(reached).alias("segment"), F.lit(TURN).alias("kind"), "place", "role", "text", "tokens")
    first = rows.filter("place = 0 AND role = 'system'").select(F.col("conv_id").alias("_conv"), "role", "text", "tokens")
    late = rows.filter(F.col("place") >= segment).select("conv_id", F.floor(F.col("place") / segment).cast("bigint").alias("segment")).distinct()
    places = late.unionByName(rows.filter("place = 0").select("conv_id", F.lit(0).cast("bigint").alias("segment")))
    system = places.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "segment", F.lit(SYSTEM).alias("kind"), F.lit(0).cast("bigint").alias("place"), "role", "text", "tokens"
    )
    every = near.unionByName(system)
    # Where segments after the first are entered: numbers only, of the conversations that have such segments.
    long = rows.filter(F.col("place") == segment).select(F.col("conv_id").alias("_conv"))
    numbers = every.select("conv_id", "segment", "kind", "place", "tokens").join(long, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    numbers = numbers.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "place")
    exits = numbers.mapInArrow(_exits(segment, budget, history), f"conv_id {kind}, segment bigint, exits array<bigint>")
    followed = exits.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_entries(segment), f"conv_id {kind}, segment bigint, place bigint")
    entries = followed.select("conv_id", "segment", F.lit(ENTRY).alias("kind"), "place", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("bigint").alias("tokens"))
    order = every.unionByName(entries).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "place")
    schema = f"conv_id {kind}, first_turn bigint, text string, mask array<struct<start: bigint, end: bigint>>, n_repeated bigint, n_tokens bigint, over_budget boolean"
    return order.select("conv_id", "segment", "kind", "place", "role", "text", "tokens").mapInArrow(_formatted(segment, budget, history), schema)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads windows back, conversation by conversation; no conversation is held as a whole."""
    key, state, out, kind = None, None, [], pa.int64()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def table() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    def done() -> None:
        out.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, text, mask, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (conv,):
                if key:
                    done()
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for i, (role, said, _) in enumerate(read_turns(text)):
                if i >= repeated:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
            for span in mask:
                learned = unescape(text[span["start"] : span["end"]])
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(text)
            state[5] += 1
        if len(out) >= 1000:
            yield table()
            out = []
    if key:
        done()
    if out:
        yield table()


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows say when they are read back."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn").select("conv_id", "text", "mask", "n_repeated")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_digested, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
