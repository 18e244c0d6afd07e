"""Importance resampling against brute force over whole texts."""

import hashlib
import math
import re
import zlib

import pyarrow as pa

from tidemark.llm import resampling

SCHEMA = "doc_id long, text string, bucket int, n string, one int"
TARGET = ["Wanted words of the target, wanted words", None, "", "tail of the target"]
LONG = " ".join(f"w{k % 991}x{k}" for k in range(60_000))


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute(docs, target):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [text for _, text in docs]), (t, target)):
        for text in texts:
            for b in grams(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        n, found = grams(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((r for r in rows if r[4] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * 5 // 100])}
    return sorted(((*r[:4], rank.get(id(r)), r[4]) for r in rows), key=str)


def test_resample(spark):
    docs = [(k, f"Doc {k} has some words, of its own: " + "wanted words of the " * (k % 7) + f"é ñ ÀB {k % 5}-{k % 3} " * 6) for k in range(130)]
    docs += [(None, "wanted words " * 30), (200, None), (201, ""), (202, "!!!  \n"), (203, LONG), (204, "one"), (205, "one two"), (5, docs[5][1]), (5, docs[5][1]), (206, "x" * 300_000 + " y " + "z" * 70_000)]
    docs += [(300 + k, docs[3][1]) for k in range(40)]
    table = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in docs], SCHEMA).repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = sorted((tuple(r) for r in resampling.resample(table, target).collect()), key=str)
    assert got == brute(docs, TARGET) and sum(r[4] is not None for r in got) > 5
    assert resampling.resample(table.limit(0), target).count() == 0
    none = resampling.resample(table, target.limit(0)).collect()
    assert len(none) == len(docs) and all(r.weight <= 0 or r.n_features for r in none)


def test_slices_cover_all_texts(monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 10)
    texts = pa.array(["abc", None, "", "x" * 50, "ab", "cd", "efghij", "k"])
    cuts = list(resampling._slices(texts))
    assert [k for a, b in cuts for k in range(a, b)] == list(range(8)) and len(cuts) > 3
    found = [grams(t)[0] for t in texts.to_pylist()]
    assert [int(n) for a, b in cuts for n in resampling.features(texts[a:b])[1]] == found
