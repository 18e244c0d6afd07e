"""Folds by blocks against plain loops: hot keys over many blocks, many small keys, ties, nulls, small batches."""

import random

import numpy as np
import pytest

from tidemark.functions.dates import TRANSITIONS
from tidemark.operators.blocks import composed, final_states, greedy_windows


@pytest.fixture
def blocked(spark):
    """Range partitions of a few rows and batches of seven."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k in settings:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("length", [1, 40, 700])
def test_windows_of_a_hot_key(blocked, length):
    rng = random.Random(length)
    rows = [(1 if k % 2 else rng.choice([None, *range(2, 40)]), rng.choice(["a", "a", None]), rng.randrange(3000) if k % 50 else None) for k in range(2000)]
    want = []
    for key in {r[:2] for r in rows}:
        opened = None
        for t in sorted(r[2] for r in rows if r[:2] == key and r[2] is not None):
            if opened is None or t >= opened + length:
                want.append([*key, t, 0])
                opened = t
            want[-1][3] += 1
    df = blocked.createDataFrame(rows, "id int, kind string, t long")
    got = greedy_windows(df, ["id", "kind"], df.t, length)
    assert sorted(map(list, got.collect()), key=str) == sorted(want, key=str)
    assert greedy_windows(df.limit(0), ["id"], df.t, length).count() == 0


def test_states_of_a_hot_key(blocked):
    rng = random.Random(3)
    names = [None, " Renewal_Due", "payment_received", "grace_period_started", "grace_period_ended", "restoration_requested", "restoration_granted", "provisional_refusal", "response_accepted", "odd"]
    rows = [(1 if k % 3 == 0 else rng.randrange(2, 90), k, rng.choice(names)) for k in range(4000)]
    rng.shuffle(rows)
    df = blocked.createDataFrame(rows, "id int, n int, e string")
    got = {r.id: r.status for r in final_states(df, ["id"], "e", ["n"], TRANSITIONS, "active").collect()}
    want = {}
    for key, _, e in sorted(rows, key=lambda r: r[1]):
        state = want.get(key, "active")
        want[key] = TRANSITIONS.get((state, (e or "").strip().lower()), state)
    assert got == want and len(set(want.values())) > 4
    assert final_states(df.limit(0), ["id"], "e", ["n"], TRANSITIONS, "active").count() == 0


def test_the_hot_key_is_in_many_tasks(blocked):
    """No task of the fold sees more than a fraction of a key that has all rows."""
    df = blocked.range(20_000).selectExpr("1 AS id", "id AS n", "'renewal_due' AS e")
    plan = df.repartitionByRange("id", "n").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(plan) > 15 and max(r["count"] for r in plan) < 2_000
    assert greedy_windows(df, ["id"], df.n, 7).count() == -(-20_000 // 7)


def test_composed_maps():
    rng = np.random.default_rng(1)
    for _ in range(50):
        maps = rng.integers(0, 5, (int(rng.integers(1, 60)), 5))
        starts = np.r_[0, np.flatnonzero(rng.random(len(maps) - 1) < 0.2) + 1] if len(maps) > 1 else np.array([0])
        for got, a, b in zip(composed(maps, starts), starts, [*starts[1:], len(maps)], strict=True):
            state = np.arange(5)
            for m in maps[a:b]:
                state = m[state]
            assert (got == state).all()
