"""Threat analysis of sessions: every message judged by what its session has said before.

Input: `session_id`, `user_id`, `msg_id`, `ts`, `content`. "Now" is the time of the message. A session
which is silent for more than 30 minutes starts anew.

A session of any length is cut into slices, so that one which holds most rows is still spread out. What grows
with the session is carried exactly: start and count from slice to slice, the decaying average, which is linear in
the scores, as one linear map per group of messages. What looks back over a fixed number of messages (50 of history,
10 counts of repetition) sees them through blocks of message numbers which overlap by that many, and tool calls,
which count for ten minutes, through slices of time which overlap by ten minutes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatesift.functions.expr import contains_any, let
from gatesift.functions.text import query_shape
from gatesift.operators.detect import threat_fragment_score
from gatesift.operators.envelopes import extract_tool_call_name
from gatesift.operators.slices import own_rows, with_halo
from gatesift.patterns import phrases as P

SECOND = 1_000_000
SLICE_S = 600  # seconds of a slice
BLOCK = 2048  # messages of a block
AVERAGE_BLOCK = 16_384  # and of one for the average, which looks back further
MAP_ROWS = 64  # messages whose scores make up one linear map of the average
MAPS = 24  # maps before that: 0.6 to the power of 24 * 64 is zero in a double, so nothing is left out
ORDER = ["at_us", "msg_id"]

# One bit per phrase set of a message.
SETS = {
    "role_escalation": P.ROLE_PHRASES,
    **P.JAILBREAK_PHRASES,
    "context_poisoning": P.POISONING_PHRASES,
    "template_fragments": P.TEMPLATE_FRAGMENTS,
    "emotional_manipulation": P.EMOTION_PHRASES,
    "danger": P.TEMPLATE_DANGERS,
}
BIT = {name: 1 << i for i, name in enumerate([*SETS, "ends_import", "starts_os"])}


def message_features(messages: DataFrame) -> DataFrame:
    """What a message alone tells: phrase flags, fragment score, shape and tool call."""
    low = F.lower("content")
    # `import os` may stand across two messages, since history is joined by single blanks.
    tests = {name: contains_any(F.col("_low"), phrases) for name, phrases in SETS.items()}
    tests["ends_import"] = F.endswith("_low", F.lit("import"))
    tests["starts_os"] = F.startswith("_low", F.lit("os"))
    flags = F.lit(0)
    for name, test in tests.items():
        flags = flags.bitwiseOR(F.when(test, F.lit(BIT[name])).otherwise(0))
    return messages.withColumn("_low", low).select(
        "session_id", "user_id", "msg_id",
        F.unix_micros("ts").alias("at_us"),
        flags.alias("flags"),
        threat_fragment_score(F.col("content"), P.FRAGMENT_SCORES).alias("fragment"),
        F.md5(query_shape(F.col("content"))).alias("shape"),
        extract_tool_call_name(F.col("content")).alias("tool"),
    )


def _has(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(BIT[name])) != 0


def _step(tool: Column, step: str) -> Column:
    return F.startswith(tool, F.lit(step[:-1])) if step.endswith("*") else tool == step


def numbered(features: DataFrame, slice_s: int = SLICE_S) -> DataFrame:
    """Features with the message's number `rn` in its id, and `started_us`, `count` and `_before` of the running session.

    Rows meet in slices of time only; a slice hands on one row: its first and last time, its number of messages and
    its last fresh start after its first message. Whether that first message is fresh follows from the slice before.

    Where the features have `_seed` (`started_us`, `count`, `ewma`, mostly NULL), such a row has that state whatever
    stands before it, so that later rows are right though the beginning of the session is not among the features.
    """
    seeded = "_seed" in features.columns
    keys = ["session_id", "_slice"]
    idle = P.SESSION_IDLE * SECOND
    inside = Window.partitionBy(*keys).orderBy(*ORDER)
    rows = features.withColumn("_slice", F.expr(f"at_us div {slice_s * SECOND}"))
    rows = rows.withColumns({"_lag": F.lag("at_us").over(inside), "_own": F.row_number().over(inside)})
    # A start is ordered by the message that tells of it, `of`; a seed goes before a fresh start of the same time.
    begins = lambda of, seed, at, rn: F.struct(of.alias("of"), F.lit(seed).alias("seed"), at.alias("at_us"), rn.cast("bigint").alias("rn"))
    start = F.when(F.col("at_us") - F.col("_lag") > idle, begins(F.col("at_us"), 0, F.col("at_us"), F.col("_own")))
    if seeded:
        given = begins(F.col("at_us"), 1, F.col("_seed.started_us"), F.col("_own") - F.col("_seed.count") + 1)
        start = F.when(F.col("_seed").isNotNull(), given).otherwise(start)
    rows = rows.withColumn("_inner", F.max(start).over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    ends = rows.groupBy(*keys).agg(F.min("at_us").alias("_from"), F.max("at_us").alias("_to"), F.count("*").alias("_n"), F.max("_inner").alias("_fresh"))
    across = Window.partitionBy("session_id").orderBy("_slice")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_last": F.lag("_to").over(across), "_rows": F.coalesce(F.sum("_n").over(earlier), F.lit(0))})
    first = F.when(F.col("_last").isNull() | (F.col("_from") - F.col("_last") > idle), begins(F.col("_from"), 0, F.col("_from"), F.col("_rows") + 1))
    inner = F.when(F.col("_fresh").isNotNull(), F.col("_fresh").withField("rn", F.col("_fresh.rn") + F.col("_rows")))
    ends = ends.withColumns({"_first": first, "_newest": F.coalesce(inner, first)})
    # `of` grows with the order, so the largest so far belongs to the last start.
    carry = ends.select(*keys, "_last", "_rows", F.coalesce("_first", F.max("_newest").over(earlier)).alias("_start"))

    rows = rows.join(carry, keys)
    own = F.when(F.col("_inner").isNotNull(), F.col("_inner").withField("rn", F.col("_inner.rn") + F.col("_rows")))
    begun = F.coalesce(own, F.col("_start"))
    rows = rows.withColumns({"_before": F.coalesce("_lag", "_last"), "rn": F.col("_own") + F.col("_rows")})
    rows = rows.withColumns({"started_us": begun["at_us"], "count": F.col("rn") - begun["rn"] + 1})
    return rows.drop("_slice", "_lag", "_own", "_inner", "_last", "_rows", "_start")


def with_history(features: DataFrame, slice_s: int = SLICE_S, block: int = BLOCK) -> DataFrame:
    """Features with `started_us` and `count` of the running session, its visible `history` (this message
    included) and `recent`, the part of it within five minutes."""
    rows = with_halo(numbered(features, slice_s), F.col("rn"), block, P.HISTORY_SIZE)
    ordered = Window.partitionBy("session_id", "_slice").orderBy("rn")
    entry = F.struct("at_us", "flags", "shape", "fragment")
    rows = own_rows(rows.withColumn("_last", F.collect_list(entry).over(ordered.rowsBetween(1 - P.HISTORY_SIZE, 0))))
    # History is pruned while the message before is handled, then this message is added.
    size = F.least(F.col("count"), F.size("_last")).cast("int")
    own_session = F.slice("_last", F.size("_last") - size + 1, size)
    visible = F.filter(own_session, lambda h, i: (i == size - 1) | (h["at_us"] >= F.col("_before") - P.HISTORY_WINDOW * SECOND))
    rows = rows.withColumn("history", visible)
    recent = F.filter("history", lambda h: h["at_us"] >= F.col("at_us") - P.HISTORY_WINDOW * SECOND)
    return rows.withColumn("recent", recent).drop("_last")


def _count(name: str) -> Column:
    return F.size(F.filter("history", lambda h: _has(h["flags"], name)))


def _danger() -> Column:
    within = F.exists("history", lambda h: _has(h["flags"], "danger"))
    pairs = F.transform(
        "history",
        lambda h, i: (i > 0) & _has(h["flags"], "starts_os") & _has(F.get(F.col("history"), i - 1)["flags"], "ends_import"),
    )
    return within | F.exists(pairs, lambda p: p)


def _rounded_share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.lit(1.0) - part / whole).otherwise(F.lit(0.0))


def analyze(messages: DataFrame, slice_s: int = SLICE_S, block: int = BLOCK, role_limit: int = P.ROLE_LIMIT) -> DataFrame:
    """One row per message with all counts, scores, `patterns`, `risk`, `action` and `block`."""
    return analyze_features(message_features(messages), slice_s, block, role_limit)


def analyze_features(features: DataFrame, slice_s: int = SLICE_S, block: int = BLOCK, role_limit: int = P.ROLE_LIMIT) -> DataFrame:
    """The same from the features of the messages, which are all that later messages need."""
    rows = with_history(features, slice_s, block)

    # Counts over the history, repetition over its recent part.
    names = [n for n in SETS if n != "danger"]
    rows = rows.withColumns({f"n_{n}": _count(n) for n in names})
    shapes = F.transform("recent", lambda h: h["shape"])
    earlier_fragments = F.filter(
        F.transform(F.slice("recent", 1, F.greatest(F.size("recent") - 1, F.lit(0))), lambda h: h["fragment"]), lambda s: s > 0
    )
    rows = rows.withColumns({
        "danger": _danger(),
        "n_recent": F.size("recent"),
        "distinct": F.size(F.array_distinct(shapes)),
        "max_repetition": let(
            shapes,
            lambda all_: F.array_max(F.transform(F.array_distinct(all_), lambda d: F.size(F.filter(all_, lambda x: x == d)))),
        ),
        "fragments": let(
            earlier_fragments,
            lambda f: F.when(
                F.size(f) >= 2, F.least(F.lit(P.FRAGMENT_CAP), F.aggregate(f, F.lit(0.0), lambda s, x: s + x))
            ).otherwise(F.lit(0.0)),
        ),
    }).drop("history", "recent")
    rows = rows.withColumns({
        "repetitions": F.col("n_recent") - F.col("distinct"),
        "uniformity": _rounded_share(F.col("distinct"), F.col("n_recent")),
    })

    # Counts of the last ten messages of the session, and tool sequences.
    rows = with_halo(rows, F.col("rn"), block, P.REPETITION_HISTORY)
    ordered = Window.partitionBy("session_id", "_slice").orderBy("rn")
    rows = own_rows(rows.withColumn("_ten", F.collect_list("repetitions").over(ordered.rowsBetween(1 - P.REPETITION_HISTORY, 0))))
    ten = F.least("count", F.size("_ten")).cast("int")
    mine = F.slice("_ten", F.size("_ten") - ten + 1, ten)
    # An opening counts for ten minutes, so slices of time which overlap by that much hold all that is asked for.
    rows = with_halo(rows, F.col("at_us"), slice_s * SECOND, P.SEQUENCE_WINDOW * SECOND)
    ordered = Window.partitionBy("session_id", "_slice").orderBy("rn")
    so_far, earlier = (ordered.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
    for i, (first, then) in enumerate(P.TOOL_SEQUENCES):
        opened = F.last(F.when(_step(F.col("tool"), first), F.col("at_us")), ignorenulls=True).over(earlier)
        rows = rows.withColumn(f"_open{i}", F.when(_step(F.col("tool"), then), opened))
        rows = rows.withColumn(f"_seq{i}", F.max(F.when(F.col(f"_open{i}") >= F.col("started_us"), F.col(f"_open{i}"))).over(so_far))
    rows = own_rows(rows)
    in_time = [
        (F.col(f"_seq{i}") >= F.col("started_us")) & (F.col(f"_seq{i}") >= F.col("at_us") - P.SEQUENCE_WINDOW * SECOND)
        for i in range(len(P.TOOL_SEQUENCES))
    ]
    any_sequence = F.lit(False)
    for hit in in_time:
        any_sequence = any_sequence | F.coalesce(hit, F.lit(False))
    stable = let(
        mine,
        lambda t: (F.size(t) >= 3) & F.forall(t, lambda x: x == F.get(t, 0)) & (F.get(t, 0) >= P.REPETITION_THRESHOLD // 2),
    )
    rows = rows.withColumns({"sequence": any_sequence, "stable": stable}).drop("_ten", *[f"_{k}{i}" for k in ("open", "seq") for i in range(len(P.TOOL_SEQUENCES))])

    method = {
        "uniformity_repetition": (F.col("n_recent") >= 5) & (F.col("uniformity") >= P.MIN_UNIFORMITY) & (F.col("repetitions") >= P.REPETITION_THRESHOLD),
        "high_max_repetition": (F.col("max_repetition") >= 3) & (F.col("n_recent") >= 3),
        "stable_repetition_pattern": F.col("stable"),
    }
    rows = rows.withColumn("methods", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in method.items()])))
    found = F.size("methods")
    hit = {
        "role_escalation": F.col("n_role_escalation") >= 2,
        **{name: F.col(f"n_{name}") >= 2 for name in P.JAILBREAK_PHRASES},
        "context_poisoning": (F.col("n_context_poisoning") >= 2) & (F.col("count") >= 5),
        "distributed_template_injection": (F.col("n_template_fragments") >= 2) & F.col("danger"),
        "emotional_manipulation": F.col("n_emotional_manipulation") >= 2,
        "model_extraction": found > 0,
        "sequence_anomaly": F.col("sequence"),
    }
    rows = rows.withColumn("patterns", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in hit.items()])))

    def add(condition: Column, amount: Column | float) -> Column:
        return F.when(condition, amount if isinstance(amount, Column) else F.lit(amount)).otherwise(F.lit(0.0))

    jailbreak = add(hit["role_escalation"], 0.3) + add(F.col("n_role_escalation") >= role_limit, 0.5)
    for name in P.JAILBREAK_PHRASES:
        jailbreak = jailbreak + add(hit[name], 0.4)
    jailbreak = jailbreak + add(found > 0, F.col("uniformity") * 0.2)
    current = (
        add(hit["context_poisoning"], 0.25)
        + add(hit["distributed_template_injection"], 0.35)
        + add(hit["emotional_manipulation"], F.col("n_emotional_manipulation") * 0.1)
        + add(found >= 2, 0.3)
        + add(hit["sequence_anomaly"], 0.4)
    )
    hasty = (F.col("count") >= 10) & (F.col("at_us") - F.col("started_us") < 300 * SECOND)
    rows = rows.withColumns({"jailbreak_risk": jailbreak, "_current": current})
    total = F.col("_current") + F.col("jailbreak_risk") + add(hasty, 0.1) + add(F.size("patterns") > 2, 0.15) + F.col("fragments")
    rows = rows.withColumn("score", F.least(F.lit(1.0), total)).drop("_current")

    rows = with_ewma(rows)
    blocked = F.col("ewma") >= P.EWMA_BLOCK
    level = F.when(blocked, "critical").otherwise(risk_of_score(F.col("score")))
    rows = rows.withColumn("risk", level)
    return rows.withColumns({"action": action_of_risk(F.col("risk")), "block": F.col("risk").isin("critical", "high")})


def with_ewma(rows: DataFrame, alpha: float = P.EWMA_ALPHA, half_life_s: float = P.EWMA_HALF_LIFE, block: int = AVERAGE_BLOCK) -> DataFrame:
    """Adds `ewma`, the decaying average of `score` over the running session, from zero before its first message.

    Each message is a linear map of the average before it: `e -> add + by * e`, where `by` is zero at a fresh start.
    Maps are folded within groups of MAP_ROWS messages, then over the MAPS groups before. `rows` have `rn`, `count`,
    `at_us`, `_before`, `score`; a row with a `_seed` has its average.
    """
    by = F.when(F.col("count") == 1, 0.0).otherwise((1 - alpha) * F.pow(F.lit(2.0), -((F.col("at_us") - F.col("_before")) / SECOND) / half_life_s))
    add = F.col("score") * alpha
    if "_seed" in rows.columns:
        add, by = F.coalesce("_seed.ewma", add), F.when(F.col("_seed").isNotNull(), 0.0).otherwise(by)
    rows = rows.withColumns({"_map": F.struct(add.alias("add"), by.alias("by")), "_group": F.floor((F.col("rn") - 1) / MAP_ROWS)})

    def folded(maps: Column) -> Column:
        one = F.struct(F.lit(0.0).alias("add"), F.lit(1.0).alias("by"))
        return F.aggregate(maps, one, lambda s, m: F.struct((m["add"] + m["by"] * s["add"]).alias("add"), (m["by"] * s["by"]).alias("by")))

    inside = Window.partitionBy("session_id", "_group").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_maps", F.collect_list("_map").over(inside)).withColumn("_so_far", folded(F.col("_maps"))).drop("_maps", "_map")
    # The last message of a group has the map of the whole group; lists leave the others out.
    rows = rows.withColumn("_whole", F.when(F.col("rn") % MAP_ROWS == 0, F.col("_so_far")))
    rows = with_halo(rows, F.col("rn"), block, MAPS * MAP_ROWS + MAP_ROWS)
    before = Window.partitionBy("session_id", "_slice").orderBy("_group").rangeBetween(-MAPS, -1)
    rows = own_rows(rows.withColumn("_earlier", F.collect_list("_whole").over(before)))
    return rows.withColumn("ewma", F.col("_so_far.add") + F.col("_so_far.by") * folded(F.col("_earlier"))["add"]).drop("_group", "_so_far", "_whole", "_earlier", "_before")


def risk_of_score(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.5, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("minimal")


def action_of_risk(risk: Column) -> Column:
    return (
        F.when(risk.isin("critical", "high"), "BLOCK_SESSION").when(risk == "medium", "INCREASED_MONITORING")
        .when(risk == "low", "MONITOR").otherwise("ALLOW")
    )


def sessionize(messages: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """Sessions per id, split where it is silent for longer than `idle`: start, end and messages."""
    window = F.session_window("ts", idle)
    grouped = messages.groupBy("session_id", window.alias("_w")).agg(F.count("*").alias("messages"), F.max("ts").alias("_last"))
    return grouped.select(
        "session_id", F.unix_seconds("_w.start").alias("start_s"), F.unix_seconds("_last").alias("last_s"), "messages"
    )


def session_stats(assessed: DataFrame, now_us: Column, threshold: float = P.HIGH_RISK_SCORE) -> DataFrame:
    """One row: sessions active at `now_us`, those of high risk by their last score, and their messages."""
    last = assessed.filter(F.col("at_us") <= now_us).groupBy("session_id").agg(
        F.max_by(F.struct("at_us", "score", "count"), F.struct("at_us", "msg_id")).alias("l")
    )
    active = last.filter(F.col("l.at_us") >= now_us - P.SESSION_IDLE * SECOND)
    return active.agg(
        F.count("*").alias("active_sessions"),
        F.count_if(F.col("l.score") > threshold).alias("high_risk_sessions"),
        F.coalesce(F.sum("l.count"), F.lit(0)).cast("bigint").alias("total_messages"),
    )


THRESHOLDS = ("threat", "anomaly_block", "jailbreak", "entropy")


def profile_thresholds(tenants: DataFrame, profiles: DataFrame, defaults: dict[str, float], names: Sequence[str] = THRESHOLDS) -> DataFrame:
    """Tenants (with `profile`) and their thresholds: non-zero values of the profile, else the defaults.

    `profiles` has `profile` and the thresholds; Spark broadcasts it if it is small.
    """
    joined = tenants.join(profiles, "profile", "left")
    return joined.withColumns({n: F.coalesce(F.when(F.col(n) > 0, F.col(n)), F.lit(defaults[n])) for n in names})
