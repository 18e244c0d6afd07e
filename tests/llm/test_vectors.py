"""Operators on vectors against brute force: nulls, ties, copies, mixed lengths, hot groups."""

import numpy as np
import pytest

from tidemark.llm import hard_negatives, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], k, "n", 1) for i, e, k in rows], SCHEMA)


def groups(rng, labels=3, n=40, dim=16):
    """Vectors at random, tight and loose groups of copies, exact and scaled copies."""
    rows = []
    for k in range(labels):
        for _ in range(n):
            base = rng.standard_normal(dim)
            rows.append((base, k))
            for _ in range(int(rng.integers(0, 6))):
                rows.append((base + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.15, 0.25]), k if rng.random() < 0.8 else (k + 1) % labels))
    rows = [(np.float32(e) * np.float32(rng.choice([1, 1, 4])), k) for e, k in rows]
    return [(i, e.tolist(), k) for i, (e, k) in enumerate(rows)]


ODD = [
    (None, [1.0, 0.0], 1), (9001, None, 1), (9002, [], 1), (9003, [0.0, 0.0], 1), (9004, [1.0, None], 1), (9005, [float("nan"), 1.0], 1), (9006, [float("inf"), 1.0], 1),
    (9007, [1.0, 0.0], None), (9008, [1.0, 0.0], 1), (9008, [1.0, 0.0], 1), (9009, [3e38, 1e30], 1), (9010, [1e-44, 0.0], 1), (9011, [1.0], 1), (9012, [-1.0, 0.0], 1), (9013, [1.0, 0.01], 2),
]


def linked(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of every row, by all pairs."""
    def able(e, k):
        return k is not None and bool(e) and all(x is not None and np.isfinite(x) for x in e) and any(np.float32(x) for x in e)

    def direction(e):
        v = np.array(e, np.float32).astype(float)
        v /= np.abs(v).max()
        return v / np.linalg.norm(v)

    up, n = list(range(len(rows))), [0] * len(rows)
    with np.errstate(all="ignore"):
        units = [direction(e) if able(e, k) else None for _, e, k in rows]
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least:
                n[a] += 1
                n[b] += 1
                old, new = up[a], up[b]
                up = [new if r == old else r for r in up]
    ids = {}
    for r, (i, _, _) in zip(up, rows, strict=True):
        ids.setdefault(r, []).append(i)
    smallest = {r: min((i for i in found if i is not None), default=None) for r, found in ids.items()}
    return sorted(((i, n[k], smallest[up[k]], i == smallest[up[k]]) for k, (i, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("cell, block, slack", [(1024, 2048, 1.0), (8, 16, 1.0), (8, 16, 0.5)])
def test_near_vectors(spark, cell, block, slack):
    rows = groups(np.random.default_rng(5)) + ODD
    got = vector_dedup.near_vectors(table(spark, rows), cell=cell, block=block, slack=slack).collect()
    assert sorted((tuple(r) for r in got), key=str) == linked(rows)


def test_near_vectors_of_a_chain(spark):
    """A chain of links is one component, however many cells and blocks it passes through."""
    angles = np.arange(300) * 0.015
    rows = [(500 - k, [np.cos(a), np.sin(a), 0.1], 7) for k, a in enumerate(angles)]
    got = vector_dedup.near_vectors(table(spark, rows), cell=20, block=10).collect()
    assert sorted((tuple(r) for r in got), key=str) == linked(rows)


def test_near_vectors_of_odd_tables(spark):
    assert vector_dedup.near_vectors(table(spark, ODD[:1]).limit(0)).count() == 0
    assert [tuple(r) for r in vector_dedup.near_vectors(table(spark, [ODD[1]])).collect()] == [(9001, 0, 9001, True)]


def mined(rows, every=10, n_positives=5, n_negatives=5):
    """Rows of hard_negatives by scoring every pair in whole numbers."""
    fit = {}
    for i, e, k in rows:
        if i is not None and k is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            fit.setdefault(i, []).append((k if i % 7 else (k + 1) % 10, len(e), [int(np.floor(256 * float(np.float32(x)))) for x in e] or [0]))
    out = []
    for i in (i for i in fit if i % every == 0):
        label, dim, e = min(fit[i])
        best = {True: {}, False: {}}
        for r, versions in fit.items():
            for k, n, x in versions:
                if n == dim and not (r == i and k == label):
                    found = best[k == label].setdefault(r, [])
                    found.append(max(-(1 << 63), min((1 << 63) - 1, sum(p * q for p, q in zip(e, x, strict=True)))))
        for ps, p in sorted((-max(s), r) for r, s in best[True].items())[:n_positives]:
            ranked = sorted((-max(t), r) for r, s in best[False].items() if (t := [v for v in s if 80 * -ps <= 100 * v <= 100 * -ps]))
            out += [(i, p, n + 1, r, -ps, -s) for n, (s, r) in enumerate(ranked[:n_negatives])]
    return sorted(out)


@pytest.mark.parametrize("block, slice_", [(32_768, 8_192), (3, 40)])
def test_hard_negatives(spark, block, slice_):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-3, 4, 20) / 8 if i % 3 else rng.standard_normal(20)).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(i + 400, [x + 0.01 for x in e], int(rng.integers(0, 4))) for i, e, _ in rows[:100]] + [r for r in rows[:30]] + [(20, [0.5] * 20, 2), (33, [0.4] * 20, 1)]
    rows += [(10_000, [1.0], 1), (10_001, [0.5], 1), (10_002, [0.9], 2), (10_010, [], 1), (10_011, [], 1), (10_012, [], 3), (10_020, [9e15, 3e20], 1), (10_021, [9e15, 1.0], 1), (10_023, [8e15, 7.0], 2)]
    got = hard_negatives.hard_negatives(table(spark, rows + ODD), every=10, block=block, slice_=slice_).collect()
    want = mined(rows + ODD)
    assert sorted(tuple(r) for r in got) == want and len(want) > 300


def test_segments_bound_every_score():
    rng = np.random.default_rng(1)
    for dim in (1, 2, 15, 16, 17, 64, 100):
        a, b = rng.integers(-256, 256, (2, 30, dim)).astype(float)
        score = a @ b.T
        for (ma, da), (mb, db) in zip(*(hard_negatives.levels(*hard_negatives.summaries(x), dim) for x in (a, b)), strict=True):
            assert (ma @ mb.T - da @ db.T <= score + 1e-6).all() and (score <= ma @ mb.T + da @ db.T + 1e-6).all()


def test_hard_negatives_of_an_empty_table(spark):
    assert hard_negatives.hard_negatives(table(spark, ODD).limit(0)).count() == 0
