"""Limits against plain walks over small logs, with a hot key and every slicing."""

import random

import pytest
from pyspark.sql import functions as F

from gatesift.operators import limits as L
from gatesift.operators import slices
from gatesift.operators import traffic as R

SECOND = 1_000_000


def log(seed, n=1500, pace=0.35):
    """One key holds most rows; times come in bursts with ties."""
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([0, 0, int(rng.expovariate(1 / pace) * SECOND), int(rng.random() * 0.1 * SECOND)])
        if rng.random() < 0.004:
            at += rng.choice([5, 14, 70, 400]) * SECOND
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}"
        rows.append((i, key, at + 1_700_000_000 * SECOND, f"m{rng.randrange(12)}", f"s{rng.randrange(30)}"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "request_id bigint, key string, at_us bigint, msg string, sid string")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2], r[0]))


def bucket(rows, per_minute, burst):
    cost = 60 * SECOND // per_minute
    cap, state, out = burst * cost, {}, {}
    for i, key, at, *_ in in_order(rows):
        credit, last = state.get(key, (cap, at))
        credit = min(cap, credit + at - last)
        out[i] = credit >= cost
        state[key] = (credit - cost if out[i] else credit, at)
    return out


@pytest.mark.parametrize("seed,per_minute,burst,slice_s", [(1, 100, 20, 60), (2, 30, 5, 7), (3, 600, 3, 1), (4, 60, 1, 13), (5, 100, 20, 3600)])
def test_token_bucket(spark, seed, per_minute, burst, slice_s):
    rows = log(seed, pace=0.1 if seed == 3 else 0.35)
    got = L.token_bucket(frame(spark, rows), "key", per_minute, burst, slice_s * SECOND).collect()
    expected = bucket(rows, per_minute, burst)
    assert {r["request_id"]: r["allowed"] for r in got} == expected
    assert 0 < sum(not v for v in expected.values()) < len(rows)


@pytest.fixture
def late_broadcast(spark):
    """Joins are planned as sorted ones; a small side is broadcast at run time, as with logs above the broadcast limit."""
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "16KB", "adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(f"spark.sql.{name}", value)
    yield
    for name in settings:
        spark.conf.unset(f"spark.sql.{name}")


def test_token_bucket_whose_join_becomes_a_broadcast(spark, late_broadcast):
    rows = log(1, pace=0.1)
    got = L.token_bucket(frame(spark, rows), "key").collect()
    assert {r["request_id"]: r["allowed"] for r in got} == bucket(rows, 100, 20)


def test_token_bucket_keeps_rows_without_a_key(spark):
    rows = [(i, None if key == "hot" else key, *more) for i, key, *more in log(6, n=400, pace=0.1)]
    got = L.token_bucket(frame(spark, rows), "key", 100, 5).collect()
    assert {r["request_id"]: r["allowed"] for r in got} == bucket(rows, 100, 5)


def test_ordered_scan_behind_a_join_that_becomes_a_broadcast(spark, late_broadcast):
    rows = spark.range(0, 4000, 1, 8).selectExpr("id % 3 AS key", "id AS at")
    kept = rows.join(spark.createDataFrame([(0,), (1,)], "key bigint"), "key", "left_semi")
    got = L.ordered_scan(kept, ["key"], ["at"], lambda seen, row: (True, seen is None), "first")
    assert got.filter("first").count() == 2


def test_credit_map_stays_small():
    """However many requests a slice has, its map has about as many pieces as the bucket has tokens."""
    rng = random.Random(9)
    cost, burst = 600_000, 20
    state, checks = L.CreditMap(cost, burst * cost), [rng.randrange(burst * cost + 1) for _ in range(50)]
    direct = list(checks)
    for _ in range(3000):
        refill = rng.choice([0, rng.randrange(900_000)])
        state.request(refill)
        direct = [L._spend(c, refill, cost, burst * cost)[0] for c in direct]
        assert len(state.start) <= 3 * burst
    state.settle()
    pieces = (state.start.tolist(), state.offset.tolist(), state.moving.tolist())
    assert [L.credit_after(c, *pieces) for c in checks] == direct


def test_replay(spark):
    rows = log(6)
    seen, expected = {}, {}
    for i, key, at, msg, _ in in_order(rows):
        first = seen.get((key, msg))
        expected[i] = first is not None and at - first <= 60 * SECOND
        if not expected[i]:
            seen[key, msg] = at
    got = L.replay(frame(spark, rows), "key", "msg").collect()
    assert {r["request_id"]: r["replayed"] for r in got} == expected


def test_replay_cases(spark):
    rows = [(1, "a", 0, "m", ""), (2, "a", 10 * SECOND, "m", ""), (3, "b", 10 * SECOND, "m", ""), (4, "a", 60 * SECOND, "m", ""), (5, "a", 61 * SECOND, "m", "")]
    got = {r["request_id"]: r["replayed"] for r in L.replay(frame(spark, rows), "key", "msg").collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}


@pytest.mark.parametrize("ttl", [1, 7])
def test_replay_of_a_key_without_a_pause(spark, ttl):
    """One key sends without a pause for hundreds of lifetimes; times are equal, adjacent or a lifetime apart."""
    rng = random.Random(ttl)
    at, rows = 1_700_000_000 * SECOND, []
    for i in range(2500):
        at += rng.choice([0, 1, ttl * SECOND - 1, ttl * SECOND, rng.randrange(ttl * SECOND)])
        rows.append((rng.randrange(10**6) * 10000 + i, rng.choice(["hot", "hot", "hot", None]), at, None if i % 3 == 0 else "m", ""))
    seen, expected = {}, {}
    for i, key, at, msg, _ in in_order(rows):
        first = seen.get((key, msg))
        expected[i] = first is not None and at - first <= ttl * SECOND
        if not expected[i]:
            seen[key, msg] = at
    got = L.replay(frame(spark, rows), "key", "msg", ttl_us=ttl * SECOND).collect()
    assert {r["request_id"]: r["replayed"] for r in got} == expected
    assert 300 < sum(not v for v in expected.values()) < 2200


def test_replay_runs_no_python(spark):
    plan = L.replay(frame(spark, log(3, 60)), "key", "msg")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "SinglePartition" not in plan


def test_rotation_scans_crowded_identities_only(spark):
    """An identity that never holds more than the limit is honored without a scan, in a window or over many."""
    rows = [(i, "calm", 1_700_000_000 * SECOND + i * 31 * SECOND, "m", f"s{i // 2}") for i in range(400)]
    rows += [(1000 + i, None, 1_700_000_000 * SECOND + i * SECOND, "m", f"s{i}") for i in range(30)]
    got = {r["request_id"]: r["honored"] for r in L.sid_rotation(frame(spark, rows), "key", "sid").collect()}
    assert all(got[i] for i in range(400)) and [got[1000 + i] for i in range(30)] == [i < 20 for i in range(30)]


def test_sid_rotation(spark):
    rows = log(7)
    state, expected = {}, {}
    for i, key, at, _, sid in in_order(rows):
        ids, degraded = state.get(key, ({}, False))
        ids = {s: t for s, t in ids.items() if at - t <= 300 * SECOND}
        degraded = degraded and len(ids) > 0
        if degraded:
            expected[i] = False
        elif sid in ids:
            expected[i] = True
        else:
            ids[sid] = at
            degraded = len(ids) > 20
            expected[i] = not degraded
        state[key] = (ids, degraded)
    for slice_us in (10 * SECOND, L.HOUR):
        got = L.sid_rotation(frame(spark, rows), "key", "sid", slice_us=slice_us).collect()
        assert {r["request_id"]: r["honored"] for r in got} == expected and not all(expected.values())


def test_recon_rate(spark):
    rows = log(8)
    expected = {}
    for i, key, at, *_ in rows:
        n = sum(k == key and at - 60 * SECOND < t and (t, j) <= (at, i) for j, k, t, *_ in rows)
        if n > 10:
            expected[i] = n
    got = R.recon_rate(frame(spark, rows), key="key").collect()
    assert {r["request_id"]: r["calls_per_minute"] for r in got} == expected and expected


def test_rps(spark):
    rows = log(10, 400)
    got = {r["request_id"]: r["in_window"] for r in R.rps(frame(spark, rows)).collect()}
    assert got == {i: sum(at - 60 * SECOND < t <= at for _, _, t, *_ in rows) for i, _, at, *_ in rows}


@pytest.mark.parametrize("slice_us", [SECOND, 50 * SECOND, 10**12])
def test_slices_equal_whole_windows(spark, slice_us):
    rows = log(11, 500)
    df = frame(spark, rows)
    slice_ = F.expr(f"at_us div {slice_us}")
    order = ["at_us", "request_id"]
    before = slices.previous_row(df, ["key"], slice_, order, F.col("request_id"), "prev")
    total = slices.running_total(df, ["key"], slice_, order, F.col("request_id"), "sum")
    last, sums, prev, running = {}, {}, {}, {}
    for i, key, *_ in in_order(rows):
        prev[i] = last.get(key)
        last[key] = i
        running[key] = running.get(key, 0) + i
        sums[i] = running[key]
    assert {r["request_id"]: r["prev"] for r in before.collect()} == prev
    assert {r["request_id"]: r["sum"] for r in total.collect()} == sums


def test_task_concurrency(spark):
    """Against a plain simulation; refused tasks do not run."""
    rng = random.Random(12)
    tasks = [(i, f"u{rng.randrange(3)}", f"t{rng.randrange(2)}", s := rng.randrange(1500) * SECOND, s + rng.randrange(1, 900) * SECOND) for i in range(300)]
    df = spark.createDataFrame(tasks, "task_id bigint, user_id string, tenant_id string, start_us bigint, end_us bigint")
    got = {r["task_id"]: (r["running"], r["over_quota"]) for r in R.task_concurrency(df, slice_s=100).collect()}
    total = {r["task_id"]: (r["running_total"], r["over_total"]) for r in R.total_concurrency(df, slice_s=100).collect()}
    tenant = {r["task_id"]: r["running"] for r in R.tenant_concurrency(df, slice_s=100).collect()}
    live = []
    for i, user, of, start, end in sorted(tasks, key=lambda t: (t[3], t[0])):
        live = [x for x in live if x[2] > start]
        refused = sum(u == user for u, _, _ in live) >= 5
        if not refused:
            live.append((user, of, min(end, start + 300 * SECOND)))
        assert got[i] == (sum(u == user for u, _, _ in live), refused)
        assert total[i] == (len(live), False)
        assert tenant[i] == sum(t == of for _, t, _ in live)
    assert any(o for _, o in got.values())


@pytest.mark.parametrize("total,users", [(100, 60), (7, 3)])
def test_total_quota(spark, total, users):
    """A start is refused while the total runs, whoever asks; it then leaves its user's room free."""
    rng = random.Random(total)
    tasks = []
    for i in range(900):
        start = (rng.randrange(500) + (0 if i < 600 else 2000)) * SECOND  # a crowded stretch, a pause, a calmer one
        tasks.append((i, rng.choice([f"u{rng.randrange(users)}", None]) if i % 9 == 0 else f"u{rng.randrange(users)}", "t", start, start + rng.randrange(1, 400) * SECOND))
    df = spark.createDataFrame(tasks, "task_id bigint, user_id string, tenant_id string, start_us bigint, end_us bigint")
    got = {r["task_id"]: r["admitted"] for r in L.admitted(df, total=total).collect()}
    over = {r["task_id"]: (r["running_total"], r["over_total"]) for r in R.total_concurrency(df, total=total).collect()}
    live, by_total = [], 0
    for i, user, _, start, end in sorted(tasks, key=lambda t: (t[3], t[0])):
        live = [x for x in live if x[1] > start]
        full = len(live) >= total
        refused = full or sum(u == user for u, _ in live) >= 5
        if not refused:
            live.append((user, min(end, start + 300 * SECOND)))
        by_total += full and sum(u == user for u, _ in live) < 5
        assert got[i] == (not refused)
        assert over[i] == (len(live), refused and len(live) >= total)
    assert len(got) == 900 and by_total > 10


def test_a_refused_task_leaves_room(spark):
    tasks = [(i, "u", "t", i * 10 * SECOND, (i * 10 + 60) * SECOND) for i in range(12)]
    df = spark.createDataFrame(tasks, "task_id bigint, user_id string, tenant_id string, start_us bigint, end_us bigint")
    assert sorted(r["task_id"] for r in R.task_concurrency(df).filter("over_quota").collect()) == [5, 11]


def test_scan_leaves_its_input_alone(spark):
    df = spark.createDataFrame([(1, "a", 5)], "request_id bigint, k string, at_us bigint")
    L.ordered_scan(df, ["k"], ["at_us"], lambda s, r: (s, True), "out")
    assert df.columns == ["request_id", "k", "at_us"]


def test_summary_and_percentiles(spark):
    rows = [(i, i * SECOND, d * 1_000_000, "a" if i % 3 else "b", 10, 20, []) for i, d in enumerate([50, 300, 100])]
    df = spark.createDataFrame(rows, "request_id bigint, at_us bigint, duration_ns bigint, method string, bytes_in bigint, bytes_out bigint, attacks array<string>")
    s = R.request_summary(df, F.lit(10 * SECOND)).first()
    assert (s["total"], s["active"], s["median_ns"], s["average_ns"], s["longest_ns"]) == (3, 0, 100_000_000, 150_000_000, 300_000_000)
    assert R.request_summary(df, F.lit(2 * SECOND)).first()["active"] == 1
    rng = random.Random(13)
    many = [(i, i, rng.randrange(10**9), "hot" if rng.random() < 0.8 else "cold", 0, 0, []) for i in range(777)]
    for r in R.latency_percentiles(spark.createDataFrame(many, df.schema), "method").collect():
        d = sorted(x[2] for x in many if x[3] == r["method"])
        for p in (0.5, 0.95, 0.99):
            assert r[f"p{round(p * 100)}_ns"] == d[max(0, int(len(d) * p + 0.5) - 1)]


def test_health(spark):
    schema = "request_id bigint, at_us bigint, duration_ns bigint, bytes_in bigint, bytes_out bigint, attacks array<string>"
    busy = [(i, i * 1000, 1000, 0, 0, ["xss", "sql_injection"]) for i in range(60)]
    assert R.health_summary(spark.createDataFrame(busy, schema), F.lit(SECOND)).first()["status"] == "critical"
    slow = [(1, 0, 6_000_000_000, 0, 0, [])]
    assert R.health_summary(spark.createDataFrame(slow, schema), F.lit(10 * SECOND)).first()["status"] == "warning"
    fine = [(1, 0, 1_000_000, 0, 0, [])]
    assert R.health_summary(spark.createDataFrame(fine, schema), F.lit(SECOND)).first()["status"] == "healthy"


def test_client_ip(spark):
    cases = [("10.0.0.1:5", "1.2.3.4, 10.0.0.1", "", "1.2.3.4"), ("10.0.0.9:5", "1.2.3.4", "", "10.0.0.9"), ("10.0.0.1:5", "", "5.6.7.8", "5.6.7.8"),
             ("10.0.0.1:5", " , ", "", "10.0.0.1")]
    df = spark.createDataFrame(cases, "remote string, fwd string, real string, expected string")
    for r in df.select("*", R.client_ip(F.col("remote"), F.col("fwd"), F.col("real"), ["10.0.0.1"]).alias("got")).collect():
        assert r["got"] == r["expected"]
    assert df.select(R.client_ip(F.col("remote"), F.col("fwd"), F.col("real"), [])).first()[0] == "10.0.0.1"


def test_workers_need_no_package(tmp_path):
    """What runs in Python workers can be loaded where the package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    for i, f in enumerate((L._summaries(600, 1200), L._carry(600, 1200), L._replayed(600, 1200), L.rotation_step)):
        path = tmp_path / f"{i}.pkl"
        path.write_bytes(cloudpickle.dumps(f))
        code = f"import pickle; pickle.load(open({str(path)!r}, 'rb'))"
        subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, check=True)
