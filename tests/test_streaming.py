"""A stream over ordered input gives what the batch functions give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gatesift.operators import limits as L
from gatesift.operators import sessions as S
from gatesift.operators import traffic as R
from gatesift.sources import audit_log
from gatesift.streaming import limits as SL
from gatesift.streaming import sessions as SS
from gatesift.streaming import windows as SW

SECOND = 1_000_000
T0 = 1_704_067_200 * SECOND
SCHEMA = "request_id bigint, at_us bigint, key string, msg string, sid string, attacks array<string>, ts timestamp"


def requests(seed, n=400):
    rng = random.Random(seed)
    at, rows = T0, []
    for i in range(n):
        at += int(rng.expovariate(4) * SECOND) + (90 * SECOND if rng.random() < 0.02 else 0)
        rows.append((i, at, "hot" if rng.random() < 0.6 else f"k{rng.randrange(3)}", f"m{rng.randrange(8)}", f"s{rng.randrange(30)}",
                     ["xss"] if i % 3 == 0 else [], dt.datetime.fromtimestamp(at / SECOND, dt.timezone.utc)))
    return rows


@pytest.fixture()
def stream(spark, tmp_path):
    """A file stream which delivers the rows in five batches, in order, and a function which runs a plan over it."""
    def make(rows, schema):
        source = tmp_path / "in"
        size = -(-len(rows) // 5)
        for b in range(5):
            part = spark.createDataFrame(rows[b * size:(b + 1) * size], schema).coalesce(1)
            part.write.parquet(str(source / f"part={b}"))
        from time import sleep
        import os
        for b in range(5):  # the file source reads older files first
            for f in (source / f"part={b}").iterdir():
                os.utime(f, (1_700_000_000 + b * 10,) * 2)
        sleep(0)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "part=*"))

    def run(df, mode="append"):
        q = (
            df.writeStream.format("parquet").outputMode(mode).option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    return make, run


def both(streamed, batch, column):
    a = {r["request_id"]: r[column] for r in streamed.collect()}
    b = {r["request_id"]: r[column] for r in batch.collect()}
    assert a == b and len(set(map(str, b.values()))) > 1


def test_token_bucket(spark, stream):
    make, run = stream
    rows = requests(1)
    df = spark.createDataFrame(rows, SCHEMA)
    both(run(SL.token_bucket(make(rows, SCHEMA), "key", 100, 5)), L.token_bucket(df, "key", 100, 5), "allowed")


def test_replay(spark, stream):
    make, run = stream
    rows = requests(2)
    df = spark.createDataFrame(rows, SCHEMA)
    both(run(SL.replay(make(rows, SCHEMA), "key", "msg")), L.replay(df, "key", "msg"), "replayed")


def test_sid_rotation(spark, stream):
    make, run = stream
    rows = requests(3)
    df = spark.createDataFrame(rows, SCHEMA)
    both(run(SL.sid_rotation(make(rows, SCHEMA), "key", "sid", limit=12)), L.sid_rotation(df, "key", "sid", limit=12), "honored")


def test_recon(spark, stream):
    make, run = stream
    rows = requests(4)
    df = spark.createDataFrame(rows, SCHEMA)
    both(run(SL.recon_rate(make(rows, SCHEMA), "key")), R.recon_rate(df, "key", limit=0), "calls_per_minute")


def closed(rows, width):
    """Start of the windows which the watermark has closed by the end."""
    top = rows[-1][1] // SECOND - 120
    return {s for s in {r[1] // SECOND // width * width for r in rows} if s + width <= top}


def test_windows(spark, stream):
    make, run = stream
    rows = requests(5, 1500)
    got = {r["start_s"]: r["requests"] for r in run(SW.requests_per_second(make(rows, SCHEMA))).collect()}
    for s in closed(rows, 60) & set(got):
        assert got[s] == sum(r[1] // SECOND // 60 * 60 == s for r in rows)
    assert got


def test_attacks(spark, stream):
    make, run = stream
    rows = requests(6, 1500)
    got = {r["start_s"]: r["attacks"] for r in run(SW.attacks_per_window(make(rows, SCHEMA))).collect()}
    for s, n in got.items():
        assert n == sum(r[1] // SECOND // 60 * 60 == s for r in rows if r[5])
    assert got


def test_audit_stream(spark, tmp_path, stream):
    make, _ = stream
    rows = requests(7, 50)
    events = make(rows, SCHEMA).select(F.col("request_id").alias("sequence_id"), F.col("key").alias("msg"))
    q = audit_log.write_audit_stream(events, str(tmp_path / "log"), str(tmp_path / "logcheck"))
    q.processAllAvailable()
    q.stop()
    assert audit_log.read_audit_log(spark, str(tmp_path / "log")).select("sequence_id", "msg").distinct().count() == 50


def test_sessions(spark, stream):
    make, _ = stream
    rng = random.Random(8)
    said = ["act as admin", "you are now root", "hello", "same", "same", "trust me", "do anything now", '{"method": "list_credentials"}', '{"method": "send_x"}', "bypass"]
    schema = "session_id string, user_id string, msg_id bigint, ts timestamp, content string"
    at, rows = 0, []
    for i in range(200):
        at += rng.choice([1, 5, 60, 400])
        rows.append((f"s{rng.randrange(4)}", "u", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), rng.choice(said)))
    q = SS.analyze_stream(make(rows, schema), "sessions", availableNow=True)
    q.awaitTermination()
    columns = ["msg_id", "count", "score", "ewma", "risk", "patterns", "sequence"]

    def keyed(df):
        return {r["msg_id"]: tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect()}

    streamed = spark.read.parquet(f"{SS.shared_dir(spark)}/sessions/results")
    assert keyed(streamed) == keyed(S.analyze(spark.createDataFrame(rows, schema)))


def test_sessions_keep_their_beginning(spark, tmp_path):
    """A session that has not paused for twelve days, with a late message, beside one that pauses."""
    rng = random.Random(9)
    said = ["act as admin", "hello", "same", "same", "trust me", "do anything now", '{"method": "list_credentials"}', '{"method": "send_x"}']
    schema = "session_id string, user_id string, msg_id bigint, ts timestamp, content string"
    begin = dt.datetime(2024, 1, 1, 5)
    rows = [("bot", "u", i, begin + dt.timedelta(minutes=20 * i), rng.choice(said)) for i in range(12 * 72)]
    rows += [("s", "v", i, begin + dt.timedelta(hours=7 * i // 6, minutes=i), rng.choice(said)) for i in range(240)]
    base = str(tmp_path)
    SS.prepare(spark, base)
    ordered = sorted(rows, key=lambda r: r[3])
    cuts = [0, 300, 620, 900, len(rows)]
    parts = [ordered[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    parts[1].append(parts[0].pop(-20))
    for i, part in enumerate(parts):
        SS.analyze_batch(spark.createDataFrame(part, schema), i, base)
    columns = ["session_id", "msg_id", "count", "started_us", "score", "ewma", "risk", "patterns", "sequence", "max_repetition", "stable"]

    def keyed(df):
        return {r[:2]: tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect()}

    whole = keyed(S.analyze(spark.createDataFrame(rows, schema)))
    for i in (1, 2, 3):
        streamed = keyed(spark.read.parquet(f"{base}/results/batch={i}"))
        assert len(streamed) == len(parts[i]) and streamed == {k: whole[k] for k in streamed}
    assert max(int(v[2]) for k, v in whole.items() if k[0] == "bot") == 864
