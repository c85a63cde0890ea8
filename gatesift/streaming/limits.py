"""Limits on streams, with the state of each key in Spark's state store.

Rows carry `request_id`, `ts` and `at_us`. Within a micro-batch a key's rows are put in order; between
batches they are taken in the order in which they arrive. State is dropped once the watermark shows that
it cannot matter any more. On ordered input the results equal those of the batch functions.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatesift.operators.limits import MINUTE, SECOND, rotation_step
from gatesift.patterns import gates as G

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT = "request_id bigint, key string, at_us bigint, {name} {type}"


def _keyed(df: DataFrame, step: Callable, keep_us: int, name: str, delay: str, type_: str = "boolean") -> DataFrame:
    """Runs `step(state, row) -> (state, value)` per `key`; the state is kept as JSON text."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at_us", "request_id"], kind="stable")
        current = json.loads(state.get[0]) if state.exists else None
        values = []
        for row in rows.itertuples(index=False):
            current, value = step(current, row)
            values.append(value)
        state.update((json.dumps(current),))
        # The watermark must pass the last row by more than `keep_us` before the state can go.
        last_ms = int(rows["at_us"].iloc[-1]) // 1000
        state.setTimeoutTimestamp(max(last_ms + keep_us // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": rows["request_id"], "key": key[0], "at_us": rows["at_us"], name: values})

    return (
        df.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(
            run, OUT.format(name=name, type=type_), "state string", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def token_bucket(requests: DataFrame, key: str, per_minute: int = G.RATE_PER_MINUTE, burst: int = G.RATE_BURST, delay: str = "1 minute") -> DataFrame:
    """`allowed` per request. A key which has been silent until its bucket is full needs no state."""
    cost = MINUTE // per_minute
    cap = burst * cost

    def step(state, row):
        at = int(row.at_us)
        credit = cap if state is None else min(cap, state[0] + at - state[1])
        allowed = credit >= cost
        return [credit - cost if allowed else credit, at], allowed

    rows = requests.select("request_id", "ts", "at_us", F.col(key).alias("key"))
    return _keyed(rows, step, cap, "allowed", delay)


def replay(messages: DataFrame, session: str, message: str, ttl_s: int = G.REPLAY_TTL, delay: str = "1 minute") -> DataFrame:
    """`replayed` per message; the key is session and message, told apart by their lengths."""
    ttl = ttl_s * SECOND

    def step(first, row):
        at = int(row.at_us)
        return (at, False) if first is None or at - first > ttl else (first, True)

    key = F.concat(F.char_length(session).cast("string"), F.lit(":"), F.col(session), F.lit(":"), F.col(message))
    rows = messages.select("request_id", "ts", "at_us", key.alias("key"))
    return _keyed(rows, step, ttl, "replayed", delay)


def recon_rate(calls: DataFrame, key: str, window_s: int = G.RECON_WINDOW, delay: str = "1 minute") -> DataFrame:
    """Listing calls of a session within the last minute, at each call."""
    window = window_s * SECOND

    def step(times, row):
        at = int(row.at_us)
        times = [t for t in times or [] if t > at - window] + [at]
        return times, len(times)

    rows = calls.select("request_id", "ts", "at_us", F.col(key).alias("key"))
    return _keyed(rows, step, window, "calls_per_minute", delay, "bigint")


def sid_rotation(
    requests: DataFrame, identity: str, sid: str, limit: int = G.ROTATION_LIMIT, window_s: int = G.ROTATION_WINDOW, delay: str = "1 minute"
) -> DataFrame:
    """`honored` per request: whether the client's session identifier is used."""
    window = window_s * SECOND

    def step(state, row):
        now = (state[0], state[1]) if state else None
        (ids, degraded), honored = rotation_step(now, row.sid, int(row.at_us), limit, window)
        return [ids, degraded], honored

    rows = requests.select("request_id", "ts", "at_us", F.col(identity).alias("key"), F.col(sid).alias("sid"))
    return _keyed(rows, step, window, "honored", delay)
