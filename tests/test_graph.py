"""Revision graphs against plain walks: long chains, stars, cycles with tails, missing parents, odd rows."""

import random

from tidemark.operators.graph import revision_graph


def walked(parents):
    out = []
    for v in parents:
        path, at = [v], v
        while parents[at] in parents and parents[at] not in path:
            at = parents[at]
            path.append(at)
        looped = parents[at] in parents
        loop = path[path.index(parents[at]) :] if looped else []
        n = sum(p == v for p in parents.values())
        out.append((v, None if looped else at, None if looped else len(path) - 1, min(loop, default=None), v in loop, n, n == 0))
    return sorted(out)


def check(spark, parents, extra=()):
    df = spark.createDataFrame([*parents.items(), *extra], "revision int, parent int")
    assert sorted(map(tuple, revision_graph(df).collect())) == walked(parents)


def test_random_graphs(spark):
    rng = random.Random(2)
    parents = {v: rng.choice([None, v - 1, v - 1, v - 1, rng.randrange(300), 1000 + v]) for v in range(300)}
    check(spark, parents, [(None, 3), (None, None), *list(parents.items())[:20]])
    assert any(r[4] for r in walked(parents)) and max(r[2] or 0 for r in walked(parents)) > 3


def test_chain_star_and_cycle(spark):
    parents = {0: None} | {v: v - 1 for v in range(1, 300)} | {v: 0 for v in range(400, 500)} | {v: v + 1 if v < 537 else 500 for v in range(500, 538)} | {600: 600, 601: 600} | {v: v + 1 for v in range(480, 499)} | {499: 500}
    check(spark, parents)


def test_a_repeated_revision_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (2, None), (3, 2), (3, 1)], "revision int, parent int")
    assert sorted((r.revision, r.root, r.depth) for r in revision_graph(df).collect()) == [(1, 1, 0), (2, 2, 0), (3, 1, 1)]
    assert revision_graph(df.limit(0)).count() == 0


def test_no_join_sends_a_table_through_the_driver(spark):
    df = spark.createDataFrame([(k, k - 1 if k % 10 else None) for k in range(100)], "revision long, parent long")
    plan = revision_graph(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
