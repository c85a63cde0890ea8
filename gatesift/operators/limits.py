"""Limits whose state depends on the order of a key's rows: token bucket, replay, identifier rotation.

Input rows have `request_id` and `at_us` (microseconds); rows of a key count in the order of these.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from gatesift.operators.saved import saved
from gatesift.operators.slices import previous_row, running_total, same_keys
from gatesift.patterns import gates as G

# The few functions which run in Python workers travel with the plan, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, output: str) -> DataFrame:
    """Runs `step(state, row) -> (state, value)` over each key's rows in order.

    Rows stream through the task in Arrow batches; only the state of the current key is held. `step`
    gets `None` as the first state of a key and the row as a tuple of the columns of `df`.
    """
    keys, columns = list(keys), df.columns
    at = [columns.index(k) for k in keys]
    schema = StructType([*df.schema.fields, StructField(output, BooleanType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            values = []
            for row in zip(*(batch[c].tolist() for c in columns)):
                row_key = [row[i] for i in at]
                if row_key != key:
                    key, state = row_key, None
                state, value = step(state, row)
                values.append(value)
            yield batch.assign(**{output: values})

    return together(df, keys).sortWithinPartitions(*keys, *order).mapInPandas(scan, schema)


def together(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of equal keys in one partition, also behind a join on these keys.

    Spark leaves out a repartition by the keys where a join has dealt the rows out by them already. If it then broadcasts the
    join's other side at run time, it reads the rows as they were written, and a key's rows lie in several tasks. It does
    not leave out a repartition by a hash of the keys.
    """
    return df.repartition(F.xxhash64(*keys))


def by_silence(df: DataFrame, keys: Sequence[str], silence_us: int, slice_us: int) -> DataFrame:
    """The rows with `segment`: the number of pauses longer than `silence_us` in their key so far.

    After such a pause a key has no state left, so its segments can be scanned in different tasks. The
    number is found slice by slice.
    """
    keys = [*keys, "_slice"]
    inside = Window.partitionBy(*keys).orderBy("at_us", "request_id")
    rows = df.withColumn("_slice", F.expr(f"at_us div {slice_us}"))
    pause = F.when(F.col("at_us") - F.lag("at_us").over(inside) > silence_us, 1).otherwise(0)
    rows = rows.withColumn("_pause", pause)
    rows = rows.withColumn("_inside", F.sum("_pause").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # Per slice its pauses, and whether it begins with one; summed up over the slices of a key.
    ends = rows.groupBy(*keys).agg(F.min("at_us").alias("_from"), F.max("at_us").alias("_to"), F.sum("_pause").alias("_pauses"))
    across = Window.partitionBy(*keys[:-1]).orderBy("_slice")
    begins = F.when(F.col("_from") - F.lag("_to").over(across) > silence_us, 1).otherwise(0)
    upto = across.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col("_begins") + F.col("_pauses")).over(upto) - F.col("_pauses")
    carry = ends.withColumn("_begins", begins).select(*keys, total.alias("_carry"))
    joined = same_keys(rows, carry, keys)
    return joined.withColumn("segment", F.col("_inside") + F.col("_carry")).drop("_slice", "_pause", "_inside", "_carry")


# Token bucket. Credit is counted in microseconds of refill, so that all arithmetic is exact.

CREDIT, REQUEST = 0, 1  # kinds of rows of a slice, in this order


class CreditMap:
    """Credit after some requests as a function of the credit before them.

    On `[start[i], start[i + 1])` the result is `offset[i]`, plus the argument where `moving[i]`. The
    number of pieces stays near the burst size, whatever the number of requests.
    """

    def __init__(self, cost: int, cap: int):
        self.cost, self.cap = cost, cap
        self.start = np.array([0], dtype=np.int64)
        self.offset = np.array([0], dtype=np.int64)
        self.moving = np.array([True])
        self.drained = False  # every result lies below the cost of a request
        self.pending = 0  # refill not yet worked into the pieces

    def request(self, refill: int) -> None:
        """One more request, `refill` after the one before."""
        if self.drained and refill < self.cost:
            # Below the cost a request leaves (credit + refill) modulo cost, so refills add up.
            self.pending = (self.pending + refill) % self.cost
            return
        self.settle()
        self._apply(refill)
        ends = np.append(self.start[1:] - 1, self.cap)
        highest = np.where(self.moving, ends + self.offset, self.offset).max()
        self.drained = bool(highest < self.cost) and self.cap >= 2 * self.cost

    def settle(self) -> None:
        """Works pending refill into the pieces."""
        if self.pending:
            self._apply(self.pending)
            self.pending = 0

    def _apply(self, refill: int) -> None:
        offset = self.offset + refill
        # Moving pieces are cut where they reach the cap and where a request becomes affordable.
        cuts = np.concatenate([self.cap - offset[self.moving], self.cost - offset[self.moving]])
        starts = np.unique(np.concatenate([self.start, cuts[(cuts > 0) & (cuts <= self.cap)]]))
        source = np.searchsorted(self.start, starts, side="right") - 1
        offset, moving = offset[source], self.moving[source]
        here = np.where(moving, starts + offset, offset)
        full = here >= self.cap
        offset, moving = np.where(full, self.cap, offset), moving & ~full
        paid = np.minimum(here, self.cap) >= self.cost
        offset = np.where(paid, offset - self.cost, offset)
        keep = np.concatenate([[True], (offset[1:] != offset[:-1]) | (moving[1:] != moving[:-1])])
        self.start, self.offset, self.moving = starts[keep], offset[keep], moving[keep]

    def constant(self) -> int | None:
        return int(self.offset[0]) if not self.pending and len(self.start) == 1 and not self.moving[0] else None


def credit_after(credit: int, start: Sequence[int], offset: Sequence[int], moving: Sequence[bool]) -> int:
    i = bisect_right(start, credit) - 1
    return int(offset[i]) + (credit if moving[i] else 0)


def _spend(credit: int, refill: int, cost: int, cap: int) -> tuple[int, bool]:
    credit = min(cap, credit + refill)
    return (credit - cost, True) if credit >= cost else (credit, False)


def _summaries(cost: int, cap: int) -> Callable:
    """Per key and slice: times of its first and last request and its credit map."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, last, first, fixed = None, None, 0, 0, None

        def emit() -> dict:
            if fixed is not None:
                pieces = ([0], [fixed], [False])
            else:
                state.settle()
                pieces = (state.start.tolist(), state.offset.tolist(), state.moving.tolist())
            return dict(zip(("key", "slice", "first_us", "last_us", "start", "offset", "moving"), (*current, first, last, *pieces)))

        for batch in batches:
            done = []
            for key, slice_, at in zip(batch["key"].tolist(), batch["slice"].tolist(), batch["at_us"].tolist()):
                if (key, slice_) != current:
                    if current is not None:
                        done.append(emit())
                    current, first, last, fixed = (key, slice_), at, at, None
                    state = CreditMap(cost, cap)
                if fixed is None:
                    state.request(at - last)
                    fixed = state.constant()
                else:
                    fixed, _ = _spend(fixed, at - last, cost, cap)
                last = at
            if done:
                yield pd.DataFrame(done)
        if current is not None:
            yield pd.DataFrame([emit()])

    return run


def _carry(cost: int, cap: int) -> Callable:
    """Credit before the first request of each slice of one key, from the slices' maps."""
    def run(slices: pd.DataFrame) -> pd.DataFrame:
        slices = slices.sort_values("slice")
        credit, last, before = cap, None, []
        for first_us, last_us, start, offset, moving in zip(
            slices["first_us"], slices["last_us"], slices["start"], slices["offset"], slices["moving"]
        ):
            credit = cap if last is None else min(cap, credit + int(first_us) - last)
            before.append(credit)
            credit, last = credit_after(credit, list(start), offset, moving), int(last_us)
        return pd.DataFrame({"key": slices["key"], "slice": slices["slice"], "credit": before})

    return run


def _replayed(cost: int, cap: int) -> Callable:
    """Decisions for the rows of each slice; the row before them has the credit at its start for a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        credit, last = 0, None
        for batch in batches:
            allowed = []
            for kind, at in zip(batch["kind"].tolist(), batch["at_us"].tolist()):
                if kind == CREDIT:
                    credit, last, ok = at, None, False
                else:
                    credit, ok = _spend(credit, 0 if last is None else at - last, cost, cap)
                    last = at
                allowed.append(ok)
            decided = batch.assign(allowed=allowed)[["request_id", "key", "at_us", "allowed"]]
            yield decided[(batch["kind"] == REQUEST).to_numpy()]

    return run


def token_bucket(
    requests: DataFrame, key: str, per_minute: int = G.RATE_PER_MINUTE, burst: int = G.RATE_BURST, slice_us: int = MINUTE
) -> DataFrame:
    """`request_id`, `key`, `at_us` and `allowed` under a bucket per key.

    A client may hold a third of all rows and be busy without a pause, so its requests are decided in
    slices of time. Each slice is first reduced to a small map from the credit before it to the credit
    after it; the maps, a few dozen numbers per slice, are chained per key; then every slice is decided
    on its own. The result is exact.
    """
    cost = MINUTE // per_minute
    cap = burst * cost
    rows = requests.select("request_id", F.col(key).alias("key"), "at_us", F.expr(f"at_us div {slice_us}").alias("slice"))
    order = ["key", "slice", "at_us", "request_id"]
    sliced = together(rows, ["key", "slice"]).sortWithinPartitions(*order)
    summary = (
        "key string, slice bigint, first_us bigint, last_us bigint, start array<bigint>, offset array<bigint>, moving array<boolean>"
    )
    maps = sliced.mapInPandas(_summaries(cost, cap), summary)
    credit = maps.groupBy("key").applyInPandas(_carry(cost, cap), "key string, slice bigint, credit bigint")
    starts = credit.select(F.lit(0).cast("bigint").alias("request_id"), "key", F.col("credit").alias("at_us"), "slice", F.lit(CREDIT).alias("kind"))
    every = together(rows.withColumn("kind", F.lit(REQUEST)).unionByName(starts), ["key", "slice"])
    decided = every.sortWithinPartitions("key", "slice", "kind", "at_us", "request_id")
    return decided.mapInPandas(_replayed(cost, cap), "request_id bigint, key string, at_us bigint, allowed boolean")


def first_sightings(rows: DataFrame, keys: Sequence[str], ttl_us: int) -> DataFrame:
    """The instants (`keys`, `at_us`, `first_id`) at which a key's row is accepted: the first, and each time the first
    one later than `ttl_us` after the last that was accepted.

    Which instant is accepted next is a function of the instant before. The function is found in slices of `ttl_us`,
    and only for instants without a pause of `ttl_us` before them; an instant behind a pause is accepted anyhow. It is
    then squared until no instant has an image, and every squaring doubles how far the accepted instants are known. All
    joins are on key and instant, so a key of any size and without any pause is spread like all others.
    """
    keys = list(keys)
    # One text per key stands for its columns, NULL ones included, so that it can be joined on.
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    instants = saved(rows.withColumn("_key", key).groupBy("_key", *keys, "at_us").agg(F.min("request_id").alias("first_id")))
    nodes = instants.select("_key", "at_us", F.expr(f"at_us div {ttl_us}").alias("_slice"))
    ends = nodes.groupBy("_key", "_slice").agg(F.min("at_us").alias("_head"), F.max("at_us").alias("_tail"))
    node = F.struct("_slice", F.col("at_us").alias("t"), F.lit(0).alias("kind"), F.col("at_us").alias("node"), F.col("at_us").alias("origin"))
    question = F.struct(
        (F.col("_slice") + 1).alias("_slice"), (F.col("at_us") + ttl_us).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("node"), F.col("at_us").alias("origin")
    )
    events = nodes.select("_key", F.explode(F.array(node, question)).alias("e")).select("_key", "e.*")
    # Seen from the end of a slice, the last node passed before a question is the first one after its time.
    down = Window.partitionBy("_key", "_slice").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy("_key", "_slice").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("_next", F.last("node", ignorenulls=True).over(down)).withColumn("_before", F.last("node", ignorenulls=True).over(up))
    near = ends.select("_key", (F.col("_slice") - 1).alias("_slice"), F.col("_head").alias("_later"))
    far = ends.select("_key", (F.col("_slice") + 1).alias("_slice"), F.col("_tail").alias("_earlier"))
    seen = saved(seen.join(near, ["_key", "_slice"], "left").join(far, ["_key", "_slice"], "left"))
    before = F.coalesce("_before", "_earlier")
    roots = seen.filter("kind = 0").filter(before.isNull() | (F.col("t") - before > ttl_us)).select("_key", F.col("t").alias("at_us"))
    # No pause lies between an instant and its image, so the image is in the slice of the question or in the next.
    jumps = seen.filter("kind = 1").select("_key", F.col("origin").alias("at_us"), F.coalesce("_next", "_later").alias("to")).filter("to IS NOT NULL")
    jumps = saved(jumps.join(roots.withColumnRenamed("at_us", "to"), ["_key", "to"], "left_anti"))
    accepted = saved(roots)
    while not jumps.isEmpty():
        for _ in range(2):  # two squarings between two tables
            reached = accepted.join(jumps, ["_key", "at_us"]).select("_key", F.col("to").alias("at_us"))
            accepted = accepted.unionByName(reached).distinct()
            onward = jumps.select("_key", F.col("at_us").alias("to"), F.col("to").alias("_further"))
            jumps = jumps.join(onward, ["_key", "to"]).select("_key", "at_us", F.col("_further").alias("to"))
        accepted, jumps = saved(accepted), saved(jumps)
    return instants.join(accepted, ["_key", "at_us"], "left_semi").select(*keys, "at_us", "first_id")


def replay(messages: DataFrame, session: str, message: str, ttl_us: int = G.REPLAY_TTL * SECOND) -> DataFrame:
    """`request_id` and `replayed`: the same message of a session within `ttl_us` of its first accepted sighting.

    After that time the next sighting is accepted again and starts a new one. Of rows at one instant the smallest id
    is the first; rows that repeat an id there are one sighting. No key is scanned: see `first_sightings`.
    """
    keys = ["session", "message"]
    rows = messages.select("request_id", F.col(session).alias("session"), F.col(message).alias("message"), "at_us")
    first = first_sightings(rows, keys, ttl_us).select(
        F.col("session").alias("_s"), F.col("message").alias("_m"), F.col("at_us").alias("_at"), F.col("first_id").alias("_first")
    )
    same = F.col("session").eqNullSafe(F.col("_s")) & F.col("message").eqNullSafe(F.col("_m")) & (F.col("at_us") == F.col("_at"))
    found = rows.join(first, same & (F.col("request_id") == F.col("_first")), "left")
    return found.select("request_id", *keys, "at_us", F.col("_first").isNull().alias("replayed"))


def _by_user(rows: DataFrame, limit: int, timeout_us: int, slice_us: int) -> DataFrame:
    """Admission under a user's limit alone. Users' stretches in which never more than `limit` tasks run at once, refused
    ones counted, admit all; only the others are decided row by row."""
    def step(ends, row):
        running = [e for e in ends or [] if e > row[2]]
        return (running + [row[3]], True) if len(running) < limit else (running, False)

    columns = ["request_id", "user", "at_us", "end_us", "segment"]
    rows = saved(by_silence(rows, ["user"], timeout_us, slice_us).select(*columns))
    start = F.struct(F.col("at_us").alias("t"), F.lit(1).alias("step"))
    stop = F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("step"))
    events = rows.select("user", "segment", "request_id", F.explode(F.array(start, stop)).alias("e")).select("user", "segment", "request_id", "e.*")
    running = running_total(events, ["user", "segment"], F.expr(f"t div {slice_us}"), ["t", "step", "request_id"], F.col("step"), "_running")
    crowded = running.groupBy("user", "segment").agg(F.max("_running").alias("_most")).filter(F.col("_most") > limit)
    crowded = saved(crowded.select(F.col("user").alias("_user"), F.col("segment").alias("_segment")))
    same = F.col("user").eqNullSafe(F.col("_user")) & (F.col("segment") == F.col("_segment"))
    free = rows.join(crowded, same, "left_anti").withColumn("admitted", F.lit(True))
    decided = ordered_scan(rows.join(crowded, same, "left_semi"), ["user", "segment"], ["at_us", "request_id"], step, "admitted")
    return free.unionByName(decided).drop("segment")


def admitted(
    tasks: DataFrame, user: str = "user_id", limit: int = G.TASK_LIMIT, timeout_s: int = G.TASK_TIMEOUT, slice_us: int = HOUR,
    total: int = G.TASK_TOTAL,
) -> DataFrame:
    """`task_id`, the user, `start_us`, `end_us` (timeout included) and `admitted`: a start is refused while `total` admitted
    tasks run over all users, or `limit` of its user.

    An end comes before a start at the same instant; a refused task runs for nobody. Users are decided apart first. Where
    no more than `total` of the tasks admitted so run at once, the total refuses nothing and the decisions stand. From
    pause to pause of the whole log (`timeout_s` without a start, after which nothing runs), a stretch that goes above it
    is decided again in the order of its rows, all users together, since each decision there depends on all before it;
    its state is at most `total` tasks.
    """
    def step(running, row):
        live = [(e, u) for e, u in running or [] if e > row[2]]
        ok = len(live) < total and sum(u == row[1] for _, u in live) < limit
        return (live + [(row[3], row[1])], True) if ok else (live, False)

    timeout_us = timeout_s * SECOND
    end = F.least("end_us", F.col("start_us") + timeout_us)
    rows = tasks.select(F.col("task_id").alias("request_id"), F.col(user).alias("user"), F.col("start_us").alias("at_us"), end.alias("end_us"))
    judged = saved(by_silence(_by_user(rows, limit, timeout_us, slice_us), [], timeout_us, slice_us).drop("_slice"))
    start = F.struct(F.col("at_us").alias("t"), F.lit(1).alias("step"))
    stop = F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("step"))
    events = judged.filter("admitted").select("segment", "request_id", F.explode(F.array(start, stop)).alias("e")).select("segment", "request_id", "e.*")
    running = running_total(events, [], F.expr(f"t div {10 * SECOND}"), ["t", "step", "request_id"], F.col("step"), "_running")
    crowded = saved(running.groupBy("segment").agg(F.max("_running").alias("_most")).filter(F.col("_most") > total).select("segment"))
    free = judged.join(crowded, "segment", "left_anti")
    again = judged.join(crowded, "segment", "left_semi").select("request_id", "user", "at_us", "end_us", "segment")
    decided = free.select("request_id", "user", "at_us", "end_us", "admitted").unionByName(
        ordered_scan(again, ["segment"], ["at_us", "request_id"], step, "admitted").drop("segment")
    )
    return decided.select(F.col("request_id").alias("task_id"), F.col("user").alias(user), F.col("at_us").alias("start_us"), "end_us", "admitted")


def rotation_step(state, sid: str, at: int, limit: int, window_us: int):
    """State of one identity: identifiers with the time they were first seen, and whether it is degraded."""
    ids, degraded = state or ({}, False)
    ids = {s: t for s, t in ids.items() if at - t <= window_us}
    degraded = degraded and bool(ids)
    if degraded:
        return (ids, True), False
    if sid not in ids:
        ids[sid] = at
        if len(ids) > limit:
            return (ids, True), False
    return (ids, False), True


def sid_rotation(
    requests: DataFrame, identity: str, sid: str, limit: int = G.ROTATION_LIMIT, window_us: int = G.ROTATION_WINDOW * SECOND,
    slice_us: int = HOUR,
) -> DataFrame:
    """`request_id` and `honored`: whether a client's session identifier is used or the shared key instead.

    More than `limit` identifiers of an identity within the window degrade it until the window empties. An identifier
    counts for no longer than the window after a sighting, so the sightings bound how many are held at once: from pause
    to pause of an identity, a stretch whose bound stays within `limit` honors all. Only the others are decided row by
    row; the state there is at most `limit + 1` identifiers.
    """
    def step(state, row):
        return rotation_step(state, row[2], row[3], limit, window_us)

    columns = ["request_id", "identity", "sid", "at_us", "segment"]
    rows = requests.select("request_id", F.col(identity).alias("identity"), F.col(sid).alias("sid"), "at_us")
    rows = saved(by_silence(rows, ["identity"], window_us, slice_us).select(*columns))
    key = ["identity", "segment", "sid"]
    last = previous_row(rows, key, F.expr(f"at_us div {slice_us}"), ["at_us", "request_id"], F.col("at_us"), "_last")
    fresh = last.filter(F.col("_last").isNull() | (F.col("at_us") - F.col("_last") > window_us))
    event = lambda at, n: F.struct(at.alias("t"), F.lit(n).alias("step"))
    gone = F.col("_last") + window_us + 1
    enters = fresh.select(*key, F.explode(F.array_compact(F.array(event(F.col("at_us"), 1), F.when(gone.isNotNull(), event(gone, -1))))).alias("e"))
    leaves = rows.groupBy(*key).agg(event(F.max("at_us") + window_us + 1, -1).alias("e"))
    events = enters.unionByName(leaves).select(*key, "e.*")
    held = running_total(events, ["identity", "segment"], F.expr(f"t div {slice_us}"), ["t", "step", "sid"], F.col("step"), "_held")
    crowded = held.groupBy("identity", "segment").agg(F.max("_held").alias("_most")).filter(F.col("_most") > limit)
    crowded = saved(crowded.select(F.col("identity").alias("_identity"), F.col("segment").alias("_segment")))
    same = F.col("identity").eqNullSafe(F.col("_identity")) & (F.col("segment") == F.col("_segment"))
    free = rows.join(crowded, same, "left_anti").withColumn("honored", F.lit(True))
    decided = ordered_scan(rows.join(crowded, same, "left_semi"), ["identity", "segment"], ["at_us", "request_id"], step, "honored")
    return free.unionByName(decided)
