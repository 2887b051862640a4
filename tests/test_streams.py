"""Timers, cursors and the levelled log: restarts, late changes, removals, and agreement with plain versions."""

import random
from pathlib import Path

import pytest

from letterworks.sources import cursor
from letterworks.streaming import incremental, readiness, segments

OBSERVED = "path string, at long, size long, mtime long"


def plain_ready(rows, seconds, now):
    out, state = [], {}
    for path, at, size, mtime in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        old = state.get(path)
        if old and not old[3] and at >= old[2] + seconds:
            out.append((path, old[0], old[1], old[2], old[2] + seconds))
            old[3] = True
        if not old or (size, mtime) != (old[0], old[1]):
            state[path] = [size, mtime, at, False]
    out += [(p, s[0], s[1], s[2], s[2] + seconds) for p, s in state.items() if not s[3] and s[2] + seconds <= now]
    return sorted(out)


def test_files_become_ready_without_being_seen_again(spark, tmp_path):
    draw = random.Random(6)
    rows = [("once", 3, 5, 5), ("changes", 4, 1, 1), ("changes", 13, 2, 1), ("at the limit", 5, 1, 1), ("at the limit", 15, 2, 2), ("late", 95, 1, 1)]
    rows += [(draw.choice("abcdef"), at, draw.randrange(3), 7) for at in range(20, 100) if draw.random() < 0.5]
    df = spark.createDataFrame(rows, OBSERVED)
    want = plain_ready(rows, 10, max(r[1] for r in rows))
    assert ("once", 5, 5, 3, 13) in want and ("at the limit", 1, 1, 5, 15) in want and not any(r[:4] == ("changes", 1, 1, 4) for r in want)
    assert sorted(map(tuple, readiness.ready_files(df, 10).collect())) == want
    for files in (1, 4):
        got = incremental.ready_files_result(spark, incremental.as_files(df, "at", files), df.schema, 10, 1)
        assert sorted(map(tuple, got.collect())) == want


def test_timers_survive_a_restart(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 1, 1)], OBSERVED)
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run():
        stream = readiness.ready_files_stream(spark.readStream.schema(OBSERVED).parquet(src), 10)
        with readiness.timers(spark):
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.ready_at) for r in spark.read.schema(readiness.OUT).parquet(out).collect()) if any(Path(out).glob("*.parquet")) else []

    df.write.parquet(src)
    assert run() == []
    spark.createDataFrame([("c", 11, 1, 1)], OBSERVED).write.mode("append").parquet(src)
    assert run() == [("a", 11)]
    spark.createDataFrame([("b", 14, 2, 2)], OBSERVED).write.mode("append").parquet(src)
    assert run() == [("a", 11), ("b", 12)]


def feed(spark, rows, root):
    cursor.write_feed(spark.createDataFrame(rows, "source string, epoch long, cursor long, payload string"), root)


def test_cursors_go_on_after_a_restart_and_start_anew_with_an_identity(spark, tmp_path):
    root, out, check = (f"file://{tmp_path}/{x}" for x in ("feed", "out", "check"))

    def poll():
        q = cursor.read_cursors(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.source, r.epoch, r.cursor) for r in spark.read.schema(cursor.SCHEMA).parquet(out).collect())

    feed(spark, [("mail", 10, c, f"m{c}") for c in range(1, 8)] + [("scans", 1, 5, "s")], root)
    first = [("mail", 10, c) for c in range(1, 8)] + [("scans", 1, 5)]
    assert poll() == first
    assert poll() == first  # nothing new, nothing twice
    feed(spark, [("mail", 10, 8, "m8"), ("scans", 1, 6, "t")], root)
    second = sorted([*first, ("mail", 10, 8), ("scans", 1, 6)])
    assert poll() == second
    (tmp_path / "feed" / "broken").mkdir()
    (tmp_path / "feed" / "broken" / "not-a-number").mkdir()  # a source that cannot be listed holds up no other
    feed(spark, [("mail", 11, 1, "again"), ("mail", 11, 2, "again")], root)
    assert poll() == sorted([*second, ("mail", 11, 1), ("mail", 11, 2)])
    now = cursor.last_cursors(spark.read.schema(cursor.SCHEMA).parquet(out))
    assert {(r.source, r.epoch, r.cursor) for r in now.collect()} == {("mail", 11, 2), ("scans", 1, 6)}
    retries = spark.createDataFrame([("mail", 10, 42), ("mail", 11, 1), ("gone", 3, 1)], "source string, epoch long, cursor long")
    assert {(r.source, r.epoch): r.outcome for r in cursor.void_retries(retries, now).collect()} == {("mail", 10): "identity_changed", ("mail", 11): "retry", ("gone", 3): "retry"}


def test_health_hides_details(spark):
    polls = spark.createDataFrame([("a", 1, False, "OSError: secret"), ("a", 2, True, None), ("b", 1, True, None), ("b", 3, False, "TimeoutError: secret"), ("d", 1, True, None)], "source string, at int, ok boolean, error string")
    sources = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "source string, enabled boolean")
    got = {r.source: (r.health, r.last_success_at, r.last_failure_at, r.last_error, r.failures) for r in cursor.source_health(polls, sources).collect()}
    assert got == {"a": ("healthy", 2, 1, None, 1), "b": ("degraded", 1, 3, "TimeoutError", 1), "c": ("unknown", None, None, None, 0), "d": ("disabled", 1, None, None, 0)}


@pytest.mark.parametrize("fanout", [2, 4])
def test_log_is_the_newest_rows_in_few_segments(spark, tmp_path, fanout):
    draw = random.Random(fanout)
    schema = spark.createDataFrame([], "k int, v string").schema
    log = segments.SegmentLog(spark, f"file://{tmp_path}/log", schema, "k", fanout)
    assert log.read().collect() == []
    want = {}
    for batch in range(12):
        keys = draw.sample(range(15), 5)
        gone = draw.sample(sorted(set(range(15)) - set(keys)), 3)
        rows = spark.createDataFrame([(k, f"{k}@{batch}") for k in keys], schema)
        removed = spark.createDataFrame([(k,) for k in gone], "k int")
        assert log.append(rows, batch, removed)
        want |= {k: f"{k}@{batch}" for k in keys}
        for k in gone:
            want.pop(k, None)
        if batch % 4 == 1:
            assert not log.append(rows.limit(0), batch, removed)  # the same batch again
        assert {r.k: r.v for r in log.read().collect()} == want
        levels = [s["level"] for s in log.segments()]
        assert max(levels.count(x) for x in levels) < fanout and levels == sorted(levels, reverse=True)
    oldest = log._rows(log.segments()[:1])
    assert oldest.where("_removed").count() == 0 or len(log.segments()) == 1
    assert log.vacuum() > 0 and {r.k: r.v for r in log.read().collect()} == want


def test_a_batch_that_failed_midway_leaves_the_log(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "k int, v string").schema
    log = segments.SegmentLog(spark, f"file://{tmp_path}/log", schema, "k", 2)
    row = lambda v: spark.createDataFrame([(1, v)], schema)
    log.append(row("a"), 0)
    commit = log._commit
    monkeypatch.setattr(log, "_commit", lambda *a: (_ for _ in ()).throw(OSError()))
    with pytest.raises(OSError):
        log.append(row("b"), 1)
    assert log.read().first().v == "a"
    monkeypatch.setattr(log, "_commit", commit)
    assert log.append(row("c"), 1) and log.read().first().v == "c"


def test_streamed_projection_drops_removed_keys(spark):
    rows = [(1, i, f"v{i}", i == 5) for i in range(6)] + [(2, i, f"w{i}", False) for i in range(6)]
    df = spark.createDataFrame([(r[0], 2 * r[1] + r[0], r[2], r[3]) for r in rows], "k long, at long, v string, gone boolean")
    build = lambda b: b.select("k", "v")
    got = incremental.stream_projection(spark, incremental.as_files(df, "at", 12), df.schema, build, "k", 1, "gone")
    assert {r.k: r.v for r in got.collect()} == {2: "w5"}
