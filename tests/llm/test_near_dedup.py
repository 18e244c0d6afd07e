"""The pipeline's near-duplicate stage against brute force over planted edited copies."""

import numpy as np

from tidemark.llm import jaccard
from tidemark.llm.jaccard import near_dedup, similar_classes


def brute(texts, width=5, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                ra, rb = a, b
                while up[ra] != ra:
                    ra = up[ra]
                while up[rb] != rb:
                    rb = up[rb]
                up[max(ra, rb)] = min(ra, rb)
    for k in range(len(up)):
        up[k] = up[up[k]]
    return up


def test_near_dedup_finds_every_edited_copy(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(30)]
    texts = ["", "One two", "one TWO", None, "one two three"]
    for base in range(12):
        words = [f"v{x}" for x in rng.integers(0, 3000, int(rng.integers(20, 200)))] + (passage if base % 2 else [])
        texts.append(" ".join(words))
        for _ in range(12):
            copy = list(words)
            for at in rng.choice(len(copy), int(rng.integers(0, max(2, len(copy) // 25))), replace=False):
                copy[at] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(k + 1, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    want = brute(texts)
    assert len(set(want)) > 12 and sum(k != r for k, r in enumerate(want)) > 50
    assert {r.doc_id: r.component_id for r in similar_classes(docs).collect()} == {k + 1: r + 1 for k, r in enumerate(want)}
    assert {r.doc_id for r in near_dedup(docs).collect()} == {r + 1 for r in want}
    assert near_dedup(docs.limit(0)).count() == 0


def test_hot_fingerprint_is_paired_in_slices(monkeypatch):
    """20,000 sets of one fingerprint in one class, ten in others: only pairs across classes are listed, in bounded slices."""
    monkeypatch.setattr(jaccard, "PAIRED", 1 << 14)
    size = np.array([20_000, 1, 1, 8])
    start = np.cumsum(size) - size
    x, y = (np.array(v) for v in ([0, 1, 3], [1, 2, 0]))
    got = list(jaccard._crossed(start[x], size[x], start[y], size[y]))
    pairs = np.concatenate([np.stack(p) for p in got], axis=1)
    assert pairs.shape[1] == 20_000 + 1 + 160_000 and len(set(map(tuple, pairs.T.tolist()))) == pairs.shape[1]
    assert max(len(a) for a, _ in got) <= 160_000 and (pairs[0][:20_000] == np.arange(20_000)).all()


def test_hot_group_over_chunks_and_parts(spark, monkeypatch):
    """Near copies of one text in many chunks and parts, beside other texts that share a passage."""
    rng = np.random.default_rng(12)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(150):
        copy = list(base)
        copy[int(rng.integers(0, 120))] = f"x{k}"
        texts.append(" ".join(copy))
    for k in range(10):
        texts.append(" ".join([f"o{k}v{j}" for j in range(90)] + base[:12]))
        texts.append(" ".join([f"o{k}v{j}" for j in range(89)] + ["z"] + base[:12]))
    docs = spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    for name, value in (("shard_pairs", {"chunk": 16}), ("_confirmed", {"part": 8})):
        monkeypatch.setattr(jaccard, name, lambda *a, f=getattr(jaccard, name), v=value: f(*a, **v))
    assert {r.doc_id: r.component_id for r in similar_classes(docs).collect()} == {k + 1: r + 1 for k, r in enumerate(brute(texts))}


def test_pairs_of_a_group_are_listed_once_not_per_shard(spark, monkeypatch):
    """16 copies with three edits each: 120 pairs just below the threshold that meet in many shards; beside them two pairs of copies."""
    texts = []
    for k in range(16):
        copy = [f"b{j}" for j in range(260)]
        for at in (k + 1, k + 18, k + 35):
            copy[at * 5] = f"x{k}e{at}"
        texts.append(" ".join(copy))
    for k in range(2):
        other = [f"o{k}v{j}" for j in range(100)]
        texts += [" ".join(other), " ".join([*other[:-1], "z"])]
    docs = spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string")
    frame, listed = type(docs), spark.sparkContext.accumulator(0)
    pairs, rows = [], []

    def counted(self, f, schema, *a, plain=frame.mapInArrow):
        if schema != "a long, b long" or "p0" not in self.columns:
            return plain(self, f, schema, *a)

        def run(batches):
            for batch in f(batches):
                listed.add(batch.num_rows)
                yield batch

        return plain(self, run, schema, *a)

    def asked(shards, *a, plain=jaccard.shard_pairs):
        rows.append(shards.count())
        out = plain(shards, *a)
        before = listed.value
        pairs.append(out.count())
        listed.add(before - listed.value)
        return out

    monkeypatch.setattr(frame, "mapInArrow", counted)
    monkeypatch.setattr(jaccard, "shard_pairs", asked)
    found = {r.doc_id: r.component_id for r in similar_classes(docs).collect()}
    assert found == {k + 1: r + 1 for k, r in enumerate(brute(texts))} and len(set(found.values())) == 18
    assert sum(pairs) > 60
    assert listed.value < 2 * sum(pairs)


def test_shards_of_the_same_sets_are_one(spark):
    """Sets that share a passage meet once for it, whatever its length; a set that shares only a part of it meets them apart."""
    marks = spark.createDataFrame([(1, [10, 20, 30, 1]), (2, [30, 20, 10, 2]), (3, [30, 3, 40]), (4, [40, 4]), (5, None)], "sid long, first array<long>")
    got = {(r.g, r.sid, r.lead) for r in jaccard.shards_of(marks).collect()}
    assert got == {(10, 1, 1), (10, 2, 1), (30, 1, 1), (30, 2, 1), (30, 3, 1), (40, 3, 3), (40, 4, 3)}
