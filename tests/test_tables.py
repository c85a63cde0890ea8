"""Logs with numbers and erasure in tables: batches that are sent twice or break off, and files that must stay."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gatesift.operators import audit as A
from gatesift.operators import privacy as P
from gatesift.sources import numbered_log as N
from gatesift.sources import store

KEY = b"a key of the tests"
EVENTS = "at bigint, log_timestamp string, msg string, sequence_id string, fields map<string,string>"


def events(spark, rows, partitions=5):
    return spark.createDataFrame([(at, f"t{at}", msg, "clash", {"n": str(i)}) for i, (at, msg) in enumerate(rows)], EVENTS).repartition(partitions)


def numbers(spark, path):
    return [(r["sequence_id"], r["msg"]) for r in N.read_numbered(spark, path).orderBy("sequence_id").collect()]


def test_numbers_have_no_gaps_and_follow_the_order(spark, tmp_path):
    path = str(tmp_path / "log")
    first = [(i * 7919 % 1000, f"m{i * 7919 % 1000}") for i in range(1000)]
    assert N.append_numbered(events(spark, first), path, "a", ["at"], KEY) == 1000
    assert N.append_numbered(events(spark, first), path, "a", ["at"], KEY) == 1000  # sent again: nothing happens
    tied = [(5, "tie"), (5, "tie"), (5, "other"), (None, "no time")]
    assert N.append_numbered(events(spark, tied), path, "b.2", ["at"], KEY) == 1004
    assert N.append_numbered(events(spark, []), path, "c", ["at"], KEY) == 1004
    got = numbers(spark, path)
    assert [n for n, _ in got] == list(range(1, 1005))
    assert [m for _, m in got[:1000]] == [f"m{i}" for i in range(1000)]
    assert got[1000][1] == "no time" and sorted(m for _, m in got[1001:]) == ["other", "tie", "tie"]
    log = N.read_numbered(spark, path, "n STRING")
    assert A.sequence_gaps(log).count() == 0
    checked = A.verify_audit(log, KEY).first()
    assert checked["invalid"] == 0 and checked["valid"] == 1004
    assert log.filter("n IS NULL").count() == 0


def test_a_batch_that_broke_off_is_unseen_and_written_anew(spark, tmp_path):
    path = str(tmp_path / "log")
    N.append_numbered(events(spark, [(1, "x")]), path, "0", ["at"])
    commit = tmp_path / "log" / "_commits"
    N.append_numbered(events(spark, [(2, "lost"), (3, "lost too")]), path, "1", ["at"])
    (commit / f"{2:019d}.json").unlink()  # as if the driver had died before it
    (commit / f".{2:019d}.json.crc").unlink(missing_ok=True)
    assert numbers(spark, path) == [(1, "x")]
    N.append_numbered(events(spark, [(9, "between")]), path, "2", ["at"])
    assert N.append_numbered(events(spark, [(2, "lost"), (3, "lost too")]), path, "1", ["at"]) == 4
    assert numbers(spark, path) == [(1, "x"), (2, "between"), (3, "lost"), (4, "lost too")]


def test_second_writer_of_a_number_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    stale = N.commits(spark, path)
    N.append_numbered(events(spark, [(1, "x")]), path, "a", ["at"])
    monkeypatch.setattr(N, "commits", lambda *_: stale)
    with pytest.raises(RuntimeError, match="another writer"):
        N.append_numbered(events(spark, [(1, "y")]), path, "b", ["at"])
    monkeypatch.undo()
    assert numbers(spark, path) == [(1, "x")]
    with pytest.raises(ValueError, match="named"):
        N.append_numbered(events(spark, [(1, "y")]), path, "../b", ["at"])


def test_stream_is_numbered_batch_by_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text("".join(json.dumps({"at": i * 10 + k, "log_timestamp": f"t{k}", "msg": f"{i}-{k}"}) + "\n" for k in range(4)))
    stream = spark.readStream.schema("at bigint, log_timestamp string, msg string").option("maxFilesPerTrigger", 1).json(str(source))
    path, runs = str(tmp_path / "log"), []
    for checkpoint in ("check", "check anew"):  # the second run sees the same files under the same batch ids
        query = N.append_numbered_stream(stream, path, "s", ["at"], str(tmp_path / checkpoint), KEY)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        runs.append(numbers(spark, path))
    assert [n for n, _ in runs[0]] == list(range(1, 13)) and runs[0] == runs[1]
    assert A.verify_audit(N.read_numbered(spark, path), KEY).first()["intact"]


ROWS = [("u1", "a", 1), ("u2", "a", 2), ("u2", "b c/%", 3), ("u3", "b c/%", 4), (None, "c", 5), ("u1", "d", 6), ("u1", "d", 7), ("u4", None, 8), ("u1", None, 9)]


def files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("part-*.parquet") if "_erasure" not in str(f)}


def written(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame(ROWS, "user_id string, part string, n int").write.partitionBy("part").parquet(path)
    return path


def ids(spark, path):
    return sorted(r["n"] for r in spark.read.parquet(path).collect())


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path, log = written(spark, tmp_path), str(tmp_path / "log")
    before = files(path)
    asked = spark.createDataFrame([("u1",), ("u1",), (None,), ("nobody",)], "user_id string")
    out = P.erase_from_table(spark, path, asked, "r1", ["part"], log=log)
    touched = {r["part"]: (r["rows"], r["erased"]) for r in out.collect()}
    assert touched == {"a": (2, 1), "d": (2, 2), None: (2, 1)}
    assert ids(spark, path) == [2, 3, 4, 5, 8]
    after = files(path)
    kept = {f for f in before if f.startswith(("part=b", "part=c"))}
    assert kept and kept <= after and not (before - kept) & after
    assert not any(f.startswith("part=d") for f in after)
    said = [r["_corrupt_record"] for r in N.read_numbered(spark, log).collect()]
    assert len(said) == 2 and A.sequence_gaps(N.read_numbered(spark, log)).count() == 0
    again = P.erase_from_table(spark, path, asked, "r1", ["part"], log=log)
    assert again.count() == 3 and files(path) == after and N.read_numbered(spark, log).count() == 2
    assert P.erase_from_table(spark, path, asked, "r2", ["part"]).count() == 0 and files(path) == after


def test_erasure_takes_up_where_it_broke_off(spark, tmp_path, monkeypatch):
    path = written(spark, tmp_path)
    asked = spark.createDataFrame([("u1",)], "user_id string")

    def broken(*_):
        raise OSError("the store is gone")

    monkeypatch.setattr(store, "remove_uri", broken)
    with pytest.raises(OSError):
        P.erase_from_table(spark, path, asked, "r", ["part"])
    monkeypatch.undo()
    # As if a partition had been taken away and its new files not been put in place.
    for f in (Path(path) / "part=a").iterdir():
        f.unlink()
    P.erase_from_table(spark, path, asked, "r", ["part"])
    assert ids(spark, path) == [2, 3, 4, 5, 8]


def test_erasure_of_everything_and_of_nothing(spark, tmp_path):
    path = written(spark, tmp_path)
    schema = "user_id string"
    assert P.erase_from_table(spark, path, spark.createDataFrame([], schema), "none", ["part"]).count() == 0
    assert ids(spark, path) == list(range(1, 10))
    P.erase_from_table(spark, path, spark.createDataFrame([("u1",), ("u2",), ("u3",), ("u4",)], schema), "all", ["part"])
    assert ids(spark, path) == [5]
    with pytest.raises(ValueError, match="partitioned"):
        P.erase_from_table(spark, path, spark.createDataFrame([], schema), "x", [])
