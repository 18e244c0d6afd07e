"""Micro-batches that come out of order, restarts, bounded state."""

import datetime as dt

import pytest

from tidemark.streaming.alerts import ROCKS, STATE_STORE, failure_windows, suppress_repeats
from tidemark.streaming.ingest import merge_stream, once_in_overlap, to_table


def test_late_alerts_are_suppressed_with_the_newer_one(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    hours = ((0, 50), (10, 80, 200), (100,), (400, 401))
    schema = "user_id long, event_type string, ts timestamp"
    for k, batch in enumerate(hours):
        rows = [(1, "a", start + dt.timedelta(hours=h)) for h in batch] + [(2, "b", start + dt.timedelta(hours=k))]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = sorted(to_table(suppress_repeats(stream)).collect())
    micros = lambda h: int((start - dt.datetime(1970, 1, 1)).total_seconds() + h * 3600) * 1_000_000
    assert [r.emitted_micros for r in got if r.user_id == 1] == [micros(h) for h in (0, 50, 80, 200, 400)]
    assert [r.emitted_micros for r in got if r.user_id == 2] == [micros(0)]


START = dt.datetime(2024, 1, 1)


def micros(seconds):
    return int((START - dt.datetime(1970, 1, 1)).total_seconds() + seconds) * 1_000_000


def put(spark, folder, name, rows, schema="user_id long, event_id long, ts timestamp, event_type string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "in" / name))


def source(spark, folder, schema="user_id long, event_id long, ts timestamp, event_type string"):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder / "in"))


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    yield spark
    spark.conf.set(STATE_STORE, before)


def test_failure_windows_over_restarts(rocks, tmp_path):
    """Three runs from one checkpoint: the windows of a loop over all rows, and no state of keys whose window is long over."""
    batches = [[(1, 0), (1, 899), (2, 5), (3, 0)], [(1, 900), (1, 901), (2, 904), (2, 906)], [(1, 1800), (2, 400_000), (3, 400_100)], [(4, 400_200)]]
    for k, batch in enumerate(batches):
        put(rocks, tmp_path, f"f{k}", [(user, k, START + dt.timedelta(seconds=s), "error") for user, s in batch])
        rows = to_table(failure_windows(source(rocks, tmp_path), late="1 hour"), "update", str(tmp_path / "out"))
    got = sorted((r.user_id, r.opened_micros, r["max(n)"]) for r in rows.groupBy("user_id", "opened_micros").max("n").collect())
    want = {}
    last = {}
    for user, s in (x for b in batches for x in b):
        if user not in last or s >= last[user] + 900:
            last[user] = s
        want[user, micros(last[user])] = want.get((user, micros(last[user])), 0) + 1
    assert got == sorted((u, o, n) for (u, o), n in want.items())
    held = rocks.read.format("statestore").option("stateVarName", "window").load(str(tmp_path / "out" / "offsets")).collect()
    assert {r.key.user_id for r in held} == {2, 3, 4}  # user 1's window ended long before the watermark


def test_rows_of_overlapping_polls_count_once(spark, tmp_path):
    """Polls that ask again for the last day, each a restart from the same checkpoint; state doesn't grow with the days."""
    day = lambda d: START + dt.timedelta(days=d)
    every = [(k % 7, k, day(k / 20), "a") for k in range(400)]
    sizes = []
    for poll in range(10):
        cursor = 2 * poll
        asked = [r for r in every if day(cursor - 1) <= r[2] < day(cursor + 2)]
        put(spark, tmp_path, f"poll{poll}", asked + asked[:5])
        rows = to_table(once_in_overlap(source(spark, tmp_path), ["event_id"], "ts"), path=str(tmp_path / "out"))
        sizes.append(spark.read.format("statestore").load(str(tmp_path / "out" / "offsets")).count())
    got = [r.event_id for r in rows.collect()]
    assert sorted(got) == list(range(400)) and max(sizes) <= 140


def test_merge_goes_on_after_a_restart(spark, tmp_path):
    """Late rows change nothing, empty values don't overwrite, an unfinished version is not read, and the state is that of a loop."""
    schema = "id long, t long, v string"
    batches = [[(1, 5, "a"), (2, 1, "b"), (None, 1, "x"), (1, 4, "old")], [(1, 3, "late"), (2, 2, ""), (3, 1, "c")], [(2, 9, "z"), (3, 1, "again")], [(4, 1, None)]]
    path = str(tmp_path / "merged")
    for k, batch in enumerate(batches):
        put(spark, tmp_path, f"b{k}", batch, schema)
        state, outcomes = merge_stream(source(spark, tmp_path, schema), "id", ["t", "v"], ["t"], path, buckets=3)
        # What a batch that died left behind: a version without its mark.
        spark.createDataFrame([(1, 99, "wrong")], schema).write.parquet(f"{path}/state/version={k + 1}/bucket=0")
    assert sorted((r.id, r.t, r.v) for r in state.collect()) == [(1, 5, "a"), (2, 9, "z"), (3, 1, "c"), (4, 1, None)]
    counts = {(r.batch, r.outcome): r["count"] for r in outcomes.collect() if r.outcome != "kept"}
    assert counts == {(0, "created"): 2, (0, "skipped"): 1, (1, "updated"): 1, (1, "created"): 1, (2, "updated"): 1, (3, "created"): 1}


def test_a_batch_writes_its_own_buckets_only(spark, tmp_path):
    schema = "id long, t long, v string"
    put(spark, tmp_path, "b0", [(k, 1, "a") for k in range(500)], schema)
    merge_stream(source(spark, tmp_path, schema), "id", ["t", "v"], ["t"], str(tmp_path / "m"), buckets=16)
    put(spark, tmp_path, "b1", [(7, 2, "b")], schema)
    state, _ = merge_stream(source(spark, tmp_path, schema), "id", ["t", "v"], ["t"], str(tmp_path / "m"), buckets=16)
    written = [len(list((tmp_path / "m" / "state" / f"version={n}").glob("bucket=*"))) for n in (0, 1)]
    assert written == [16, 1] and state.count() == 500 and state.where("v = 'b'").count() == 1


def test_keys_share_slots_of_state(spark, tmp_path):
    """Over restarts: null keys are keys, and the state has a row per slot, not per key."""
    schema = "user_id long, event_type string, ts timestamp"
    users, kinds = (None, 0, 1, 2, 1 << 60), (None, "a", "b")
    batches = [[(u, kind, START + dt.timedelta(hours=h)) for u in users for kind in kinds for h in hours] for hours in ((0, 3, 24, 25), (26, 49, 50))]
    for k, batch in enumerate(batches):
        put(spark, tmp_path, f"f{k}", batch, schema)
        rows = to_table(suppress_repeats(source(spark, tmp_path, schema), slots=3), path=str(tmp_path / "out"))
    got = sorted((repr(r.user_id), repr(r.event_type), r.emitted_micros) for r in rows.collect())
    assert got == sorted((repr(u), repr(kind), micros(3600 * h)) for u in users for kind in kinds for h in (0, 25, 50))
    assert 1 <= spark.read.format("statestore").load(str(tmp_path / "out" / "offsets")).count() <= 3
