"""Substring dedup by repeated-phrase automata.

Every word covered by a 13-word window that also starts in a document with a smaller id is removed.

1. Anchors. Each window elects one of its 5-word grams, the one with the least hash, so equal windows
   elect equal grams; a document sends only its distinct anchors, a fifth of its positions. A gram with
   two ids or more is a candidate.
2. Confirmation. Runs of windows with candidate anchors are cut into segments of about ``SEGMENT``
   windows and staged. Consecutive windows with one anchor form a span; equal spans (128 bits of gram and
   span hash) are grouped first, and all but the first document of a span refer to that one. Only where
   a gram has different spans, at the edges of copies, do the first documents' windows get compared one
   by one, by 128-bit hashes. Either way a window's first (smallest) document and segment are found.
3. Automata. A document gets the segments that its confirmed windows first occurred in. Tasks compile
   the segments of a block of documents, sharded so that a shard stays under ``SHARD_WORDS`` words, into
   Aho-Corasick automata whose patterns are the segments' aligned 7-word blocks: any 13-word window
   holds one whole. All documents of the block stream through; each hit is extended word by word, and
   an extension of 13 words or more is an occurrence. Words decide, so a hash collision cannot remove.

Shuffled are anchors, hashes and, twice, the texts by id. Grouped minima are combined before their
shuffle. A phrase that a third of all documents share is one row on the side of the first documents; joins
on phrases spread it over ``SALTS`` parts, one of which each document asks.

Nulls: a null text has no words; a row with a null doc_id is neither changed nor a reason for a change.
Rows that repeat an id are judged alike, and not against each other. Texts of any length are processed
whole; under 13 words nothing is removed. An empty table gives no rows. Extra columns are left out by
``phrase_removals`` and kept by ``phrase_dedup``, whatever their names. A document's passages are at most one
segment a window of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import drop_staged, free_names, own_columns, read_table, stage_table

WINDOW = 13
GRAM = 5
#: Aligned blocks of this size: a window of 13 = 2 * 7 - 1 words holds a whole one.
BLOCK = (WINDOW + 1) // 2
SEGMENT = 64
SHARD_WORDS = 200_000
DOCS = 256
SEGMENTS_HELD = 1024
#: Parts of a phrase in joins.
SALTS = 8
_ODD = np.random.default_rng(7).integers(1, 1 << 63, (3, WINDOW), np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BLOCK_BYTES = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK_BYTES + 1)
        _POWERS[:] = [np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the bytes: a 64-bit polynomial hash, begin and end; block by block."""
    found: list[tuple] = []
    at = 0
    while at < len(raw):
        end = at + _BLOCK_BYTES
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        part = np.frombuffer(raw, np.uint8, min(end, len(raw)) - at, at)
        word = ~((part == 32) | ((part >= 9) & (part <= 13)))
        edge = np.flatnonzero(np.diff(np.r_[False, word, False]))
        begin, stop = edge[::2], edge[1::2]
        power, inverse = _powers(len(part) + 1)
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(part * power[: len(part)])]
        found.append(((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64), begin + at, stop + at))
        at += len(part)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _rolled(hashes: np.ndarray, width: int, odd: np.ndarray) -> np.ndarray:
    """One mixed 64-bit hash for each run of ``width`` words."""
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * odd[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """The least gram hash of each window."""
    grams = _rolled(hashes, GRAM, _ODD[0])
    left = WINDOW - GRAM + 1
    least, have = grams, 1
    while have < left:
        step = min(have, left - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def _slices(batches: Iterator[pa.RecordBatch], rows: int = DOCS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def anchors(docs: DataFrame) -> DataFrame:
    """(gram, doc_id): the distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            grams, ids = [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                hashes = word_hashes((text or "").encode())[0]
                if len(hashes) >= WINDOW:
                    found = np.unique(window_anchors(hashes))
                    grams.append(found)
                    ids.append(np.full(len(found), doc, np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(ids))], ["gram", "doc_id"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "gram long, doc_id long")


def candidate_grams(docs: DataFrame) -> DataFrame:
    """doc_id and the array of its anchors that another document has too."""
    sent = stage_table(anchors(docs), "phrase-anchors")
    shared = sent.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("gram")
    out = stage_table(sent.join(shared, "gram", "left_semi").groupBy("doc_id").agg(F.collect_set("gram").alias("grams")), "phrase-grams")
    drop_staged(sent)
    return out


def segments(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Runs of windows with candidate anchors: doc_id, seg, words, and its spans (gram, span)."""
    joined = docs.select("doc_id", "text").join(grams.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            out: list[tuple] = []
            for doc, text, wanted in zip(*[part.column(k).to_pylist() for k in range(2)], _lists(part.column(2)), strict=True):
                raw = (text or "").encode()
                hashes, begin, stop = word_hashes(raw)
                if len(hashes) < WINDOW:
                    continue
                anchor = window_anchors(hashes)
                flags = np.isin(anchor, wanted.view(np.uint64))
                if not flags.any():
                    continue
                h1, h2 = _rolled(hashes, WINDOW, _ODD[1]), _rolled(hashes, WINDOW, _ODD[2])
                # Spans: runs of equal anchors; a segment takes whole spans until it is long enough.
                turn = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                last = np.r_[turn[1:], len(anchor)] - 1
                keep = flags[turn]
                turn, last = turn[keep], last[keep]
                # Every window of a span enters its hash, by its place; sums mod 2**64 of the span are a difference of cumulative sums.
                power, inverse = _powers(len(h1) + 1)
                sums = np.r_[np.zeros(1, np.uint64), np.cumsum(h1 * power[: len(h1)])]
                span = (((sums[last + 1] - sums[turn]) * inverse[turn]) * np.uint64(_BASE) ^ h2[last]) + (last - turn).astype(np.uint64)
                cut, first = [0], int(turn[0])
                for k in range(1, len(turn)):
                    if turn[k] != last[k - 1] + 1 or turn[k] - first >= SEGMENT:
                        cut.append(k)
                        first = int(turn[k])
                for a, b in zip(cut, [*cut[1:], len(turn)], strict=True):
                    words = b" ".join(raw[begin[turn[a]] : stop[last[b - 1] + WINDOW - 1]].split()).decode()
                    out.append((doc, int(turn[a]), words, anchor[turn[a:b]].view(np.int64), span[a:b].view(np.int64)))
            if out:
                cols = list(zip(*out, strict=True))
                lists = [pa.array(c, pa.list_(pa.int64())) for c in cols[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), *lists], ["doc_id", "seg", "words", "grams", "spans"])

    return joined.mapInArrow(run, "doc_id long, seg long, words string, grams array<long>, spans array<long>")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list<int64> column as numpy arrays."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def edge_windows(wanted: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, seg) of the windows of segments whose anchor is among the row's ``asked`` grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, SEGMENTS_HELD):
            # All segments at once, as one text; windows over two segments are left out.
            texts = [t.encode() for t in part.column(2).to_pylist()]
            hashes, begin, _ = word_hashes(b" ".join(texts))
            if len(hashes) < WINDOW:
                continue
            segment = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")
            inside = segment[: len(segment) - WINDOW + 1] == segment[WINDOW - 1 :]
            asked = _lists(part.column(3))
            place = lambda k: (k.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
            wanted_here = np.concatenate(asked).view(np.uint64) ^ place(np.repeat(np.arange(len(asked)), [len(x) for x in asked]))
            first = segment[: len(inside)]
            at = np.flatnonzero(inside & np.isin(window_anchors(hashes) ^ place(first), wanted_here))
            if len(at):
                docs, segs = (part.column(k).to_numpy(zero_copy_only=False)[first[at]] for k in range(2))
                h1, h2 = (_rolled(hashes, WINDOW, odd)[at].view(np.int64) for odd in _ODD[1:])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, docs, segs)], ["h1", "h2", "doc_id", "seg"])

    return wanted.select("doc_id", "seg", "words", "asked").mapInArrow(run, "h1 long, h2 long, doc_id long, seg long")


def _salted(rows: DataFrame, known: DataFrame, key: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Join on the key, whose rows are spread by a hash of the column ``spread``; each known row is there once a part."""
    parts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(known.withColumn("salt", parts), [*key, "salt"], how).drop("salt")


def _references(rows: DataFrame, first: DataFrame, key: list[str]) -> DataFrame:
    """(doc_id, owner, owner_seg) of the rows whose key has a smaller first document."""
    known = first.where("owner < last").select(*key, "owner", "owner_seg")
    return _salted(rows, known, key, "doc_id").where("doc_id > owner").select("doc_id", "owner", "owner_seg")


def first_segments(found: DataFrame) -> DataFrame:
    """doc_id and the segments (owner, words) of smaller ids in which its windows first occurred."""
    firsts = (F.min("doc_id").alias("owner"), F.min_by("seg", "doc_id").alias("owner_seg"), F.max("doc_id").alias("last"))
    spans = found.select("doc_id", "seg", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("spans").alias("span"))))
    first_spans = stage_table(spans.groupBy("gram", "span").agg(*firsts), "phrase-spans")
    mixed = first_spans.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    asked = _salted(first_spans, mixed, ["gram"], "span", "left_semi").groupBy(F.col("owner").alias("_doc"), F.col("owner_seg").alias("_seg")).agg(F.collect_set("gram").alias("asked"))
    windows = stage_table(edge_windows(found.join(asked, (F.col("doc_id") == F.col("_doc")) & (F.col("seg") == F.col("_seg")))), "phrase-windows")
    first_windows = windows.groupBy("h1", "h2").agg(*firsts)
    wanted = stage_table(_references(spans, first_spans, ["gram", "span"]).unionByName(_references(windows, first_windows, ["h1", "h2"])).distinct(), "phrase-references")
    drop_staged(windows)
    drop_staged(first_spans)
    text = found.select(F.col("doc_id").alias("_owner"), F.col("seg").alias("_seg"), "words")
    got = wanted.join(text, (F.col("owner") == F.col("_owner")) & (F.col("owner_seg") == F.col("_seg")))
    return got.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("owner", "words")).alias("passages"))


class PhraseAutomata:
    """Sharded automata over the passages of a block of documents."""

    def __init__(self, passages: dict[bytes, int]):
        """passages: words joined by spaces -> smallest owner."""
        self.ids: dict[bytes, int] = {}
        self.shards: list[tuple[ahocorasick.Automaton, list[tuple[list[int], int]]]] = []
        held: list[tuple[list[int], int]] = []
        size = 0
        for text, owner in passages.items():
            held.append((self._numbers(text.split(), grow=True), owner))
            size += len(held[-1][0])
            if size >= SHARD_WORDS:
                self._compile(held)
                held, size = [], 0
        if held:
            self._compile(held)

    def _numbers(self, words: list[bytes], grow: bool = False) -> list[int]:
        ids = self.ids
        if grow:
            return [ids.setdefault(w, len(ids) + 1) for w in words]
        return [ids.get(w, 0) for w in words]

    @staticmethod
    def _spelled(numbers: list[int]) -> str:
        """Three characters a word, so that a trie node has few children; number 0 (unknown) is a word of its own."""
        return "".join([chr(48 + (n >> 14)) + chr(48 + (n >> 7 & 127)) + chr(48 + (n & 127)) for n in numbers])

    def _compile(self, held: list[tuple[list[int], int]]) -> None:
        places: dict[str, list[tuple[int, int]]] = {}
        for p, (numbers, _) in enumerate(held):
            spelled = self._spelled(numbers)
            for at in range(0, len(numbers) - BLOCK + 1, BLOCK):
                places.setdefault(spelled[3 * at : 3 * (at + BLOCK)], []).append((p, at))
        automaton = ahocorasick.Automaton()
        for block, where in places.items():
            automaton.add_word(block, where)
        automaton.make_automaton()
        self.shards.append((automaton, held))

    def covered(self, words: list[bytes], doc: int) -> bytearray:
        """1 for each word in an occurrence of 13 words or more of a passage of a smaller id."""
        mask = bytearray(len(words))
        numbers = self._numbers(words)
        spelled = self._spelled(numbers)
        for automaton, held in self.shards:
            done: dict[tuple[int, int], int] = {}  # (passage, diagonal) -> end of what has been compared
            for end, where in automaton.iter(spelled):
                if (end + 1) % 3:
                    continue
                at = (end + 1) // 3 - BLOCK
                for p, start in where:
                    theirs, owner = held[p]
                    if owner >= doc or at < done.get((p, at - start), -1):
                        continue
                    i, j = at, start
                    while i and j and numbers[i - 1] == theirs[j - 1]:
                        i, j = i - 1, j - 1
                    k, m = at + BLOCK, start + BLOCK
                    while k < len(numbers) and m < len(theirs) and numbers[k] == theirs[m]:
                        k, m = k + 1, m + 1
                    done[(p, at - start)] = k
                    if k - i >= WINDOW:
                        mask[i:k] = b"\1" * (k - i)
        return mask


def _apply(docs: DataFrame, column: str, schema, emit) -> DataFrame:
    """Run ``emit(batch, masks, words)`` over blocks of documents with their passages in ``column``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            names = part.schema.names
            ids, texts, lists = (part.column(names.index(c)).to_pylist() for c in ("doc_id", "text", column))
            passages: dict[bytes, int] = {}
            for found in lists:
                for x in found or ():
                    key = x["words"].encode()
                    passages[key] = min(x["owner"], passages.get(key, x["owner"]))
            automata = PhraseAutomata(passages) if passages else None
            words = [_words(t) for t in texts]
            masks = [automata.covered(w, d) if f and d is not None else None for w, d, f in zip(words, ids, lists, strict=True)]
            yield emit(part, masks, words)

    return docs.mapInArrow(run, schema)


def _with_passages(docs: DataFrame, column: str) -> DataFrame:
    """The documents with the passages of smaller ids that each shares (null: none) in ``column``."""
    grams = candidate_grams(docs)
    found = stage_table(segments(docs, grams), "phrase-segments")
    drop_staged(grams)
    doc, *_ = free_names(docs, "passage_doc")
    passages = stage_table(first_segments(found), "phrase-passages").toDF(doc, column)
    drop_staged(found)
    return docs.join(passages, F.col("doc_id") == F.col(doc), "left").select(*own_columns(docs), column)


def phrase_removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def emit(part: pa.RecordBatch, masks: list, words: list) -> pa.RecordBatch:
        kept = [w if m is None else [x for x, gone in zip(w, m, strict=True) if not gone] for w, m in zip(words, masks, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                part.column(0).cast(pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([0 if m is None else sum(m) for m in masks], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    return _apply(_with_passages(docs.select("doc_id", "text"), "passages"), "passages", "doc_id long, n_words long, n_removed long, kept_sha256 string", emit)


def cut_text(text: str, words: list[bytes], mask: bytearray) -> str:
    """The text without the covered words and the white space after each of them."""
    raw = text.encode()
    out, at = [], 0
    for word, gone in zip(words, mask, strict=True):
        start = raw.index(word, at)
        end = start + len(word)
        out.append(raw[at:start] if gone else raw[at:end])
        at = end
        while gone and at < len(raw) and raw[at] in b" \t\n\v\f\r":
            at += 1
    return (b"".join(out) + raw[at:]).decode()


def phrase_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the repeated passages cut from text and n_chars brought up to date.

    A text that loses all its words is dropped; one that had none stays.
    """
    passages, emptied = free_names(docs, "passages", "emptied")
    schema = T.StructType([*docs.schema.fields, T.StructField(emptied, T.BooleanType())])

    def emit(part: pa.RecordBatch, masks: list, words: list) -> pa.RecordBatch:
        texts = part.column(part.schema.names.index("text")).to_pylist()
        new = [t if m is None or not any(m) else cut_text(t, w, m) for t, w, m in zip(texts, words, masks, strict=True)]
        gone = [bool(w) and m is not None and all(m) for w, m in zip(words, masks, strict=True)]
        own = [(k, f.name) for k, f in enumerate(part.schema) if f.name != passages]
        return pa.RecordBatch.from_arrays([*[pa.array(new, pa.string()) if name == "text" else part.column(k) for k, name in own], pa.array(gone)], [*[name for _, name in own], emptied])

    out = _apply(_with_passages(docs, passages), passages, schema, emit).where(~F.col(emptied)).drop(emptied)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_removals(read_table(spark, folder, "documents"))


def removal_sql(table: str) -> str:
    """DuckDB SQL with the rows of phrase_removals over ``table``; ids must tell rows apart."""
    return rf"""
WITH parts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {table}),
wins AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM parts)),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_doc FROM wins),
marked AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM firsts WHERE first_doc < doc_id GROUP BY doc_id),
kept AS (SELECT p.doc_id, len(p.w) AS n_words, coalesce(len(m.gone), 0) AS n_removed,
    CASE WHEN m.gone IS NULL THEN p.w ELSE list_filter(p.w, lambda x, k: NOT list_contains(m.gone, k)) END AS k FROM parts p LEFT JOIN marked m USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


QUERIES = {"op10_phrases": op10_phrases}
ORACLES = {"op10_phrases": removal_sql("documents")}
