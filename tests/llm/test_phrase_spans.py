"""Long spans of one anchor that differ only in the middle."""

import numpy as np

from tidemark.llm import phrases


def periodic() -> list[str]:
    """Three texts of lines with one recurring gram that is the least everywhere."""
    for seed in range(5000):
        gram = " ".join(f"g{seed}x{k}" for k in range(5))
        lines = lambda tag, n, gram=gram: [f"{gram} {tag}{k} {tag}y{k}" for k in range(n)]
        head, tail = lines("h", 4), lines("t", 4)
        texts = [" ".join(x) for x in (head + lines("m", 4) + tail, head + lines("n", 4) + tail, lines("a", 3) + lines("n", 4) + lines("b", 3))]
        if all(len(np.unique(phrases.window_anchors(phrases.word_hashes(t.encode())[0]))) == 1 for t in texts):
            return texts
    raise AssertionError("no gram found")


def test_words_in_the_middle_of_a_span_count(spark):
    texts = periodic()
    first, want = {}, {}
    for doc, text in enumerate(texts, 1):
        w = text.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), doc)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < doc for j in range(k, k + 13)}
        want[doc] = " ".join(x for j, x in enumerate(w) if j not in gone)
    assert len(want[3].split()) < len(texts[2].split())
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts, 1)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: " ".join(r.text.split()) for r in phrases.phrase_dedup(docs).collect()} == want
