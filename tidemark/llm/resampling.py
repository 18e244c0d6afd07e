"""Importance resampling towards a target distribution of hashed n-grams, by Arrow kernels.

Texts are lower-cased (ascii_lower), split into words (split_pattern_regex), flattened (list_flatten)
and dictionary-encoded. Neighbouring words are pairs of dictionary indices, shifted against each other;
pairs are dictionary-encoded again, and so are pairs with the word after them. A CRC is computed once
for each distinct word, pair and triple of a slice of texts and taken to every feature. A CRC goes on
over the next word by its linear step for that word's length, so no n-gram is ever built as a text.

Two passes over the texts, both without a shuffle of them: the first counts features by bucket (each
task sends one number per bucket, whatever its size), the second sums each document's gains. The gains,
one number per bucket, are the only thing that passes through the driver. The draw orders narrow rows
over ranges, so no task sorts all of them (``common.running_sums``).

Nulls: a null text has no words. A row without doc_id has features and a weight and counts in the corpus,
but has no score and isn't drawn. Texts without words weigh 0. Rows that repeat an id are rows of their own,
ties of score and id are broken by the number of features and words. An empty table gives no rows; an empty target or corpus
counts 0 in every bucket. Other columns, whatever their names, are ignored. A slice holds ``SLICE`` bytes of
text or one longer text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table, running_sums, stage_table

BUCKETS = 10_000
#: What stands between words, after lower-casing.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_WORDS = 20
#: Documents drawn, in percent of those with ``LEAST_WORDS`` words.
SHARE = 5
SEED = 42
#: Bytes of text whose features are held at a time.
SLICE = 4 << 20


@lru_cache(4096)
def _step(length: int) -> np.ndarray:
    """Four tables of 256: what a CRC becomes after ``length`` more zero bytes, by its bytes."""
    zeros = bytes(length)
    bits = np.array([zlib.crc32(zeros, 1 << k) ^ zlib.crc32(zeros) for k in range(32)], np.uint32)
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            table[byte, 1 << bit : 2 << bit] = table[byte, : 1 << bit] ^ bits[8 * byte + bit]
    return table


def _extended(crc: np.ndarray, steps: np.ndarray, which: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """CRC of what ``crc`` covers followed by a word whose own CRC is ``tail`` and whose step is steps[which]."""
    out = tail.copy()
    for byte in range(4):
        out ^= steps[which, byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    encoded = pa.array(keys).dictionary_encode()
    return encoded.dictionary.to_numpy(), encoded.indices.to_numpy()


def features(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(bucket, document) of all words, pairs and triples], words per document); documents in ascending order."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BREAK)
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    flat, doc = flat.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    n_words = np.bincount(doc, minlength=len(texts))
    if not len(flat):
        return [], n_words
    encoded = flat.dictionary_encode()
    word = encoded.indices.to_numpy().astype(np.int64)
    spelled = encoded.dictionary.cast(pa.large_binary()).to_pylist()
    crc = np.array([zlib.crc32(w) for w in spelled], np.uint32)
    after_space = np.array([zlib.crc32(b" " + w) for w in spelled], np.uint32)
    lengths, which = np.unique([len(w) + 1 for w in spelled], return_inverse=True)
    steps = np.stack([_step(int(n)) for n in lengths])
    out = [((crc % BUCKETS)[word], doc)]
    at, seen, code = np.arange(len(word)), crc, word
    for width in (2, 3):
        at = at[at + width <= len(word)]
        at = at[doc[at] == doc[at + width - 1]]
        if not len(at):
            break
        keys, shifted = _distinct(code[at] * len(spelled) + word[at + width - 1])
        last = keys % len(spelled)
        seen = _extended(seen[keys // len(spelled)], steps, which[last], after_space[last])
        out.append(((seen % BUCKETS)[shifted], doc[at]))
        code = np.zeros(len(word), np.int64)
        code[at] = shifted
    return out, n_words


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts that hold ``SLICE`` bytes at most, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield start, stop
        start = stop


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: features of all texts (column ``text``) by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            column = batch.column(0)
            for start, stop in _slices(column):
                for bucket, _ in features(column[start:stop])[0]:
                    counts += np.bincount(bucket, minlength=BUCKETS)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gain(target: Column, target_all: Column, corpus: Column, corpus_all: Column) -> Column:
    """1000 times the log of the bucket's smoothed share in the target over that in the corpus, floored."""
    of = [c.cast("double") for c in (target, target_all, corpus, corpus_all)]
    return F.floor(F.lit(1000.0) * F.log((of[0] + 1) * (of[3] + BUCKETS) / ((of[2] + 1) * (of[1] + BUCKETS)))).cast("long")


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket: ``BUCKETS`` numbers, the only ones that the driver gets."""
    s = bucket_counts(docs).select(F.col("bucket").alias("_s_bucket"), F.col("n").alias("s"))
    t = bucket_counts(target).select(F.col("bucket").alias("_t_bucket"), F.col("n").alias("t"))
    every = docs.sparkSession.range(BUCKETS).join(s, F.col("id") == F.col("_s_bucket"), "left").join(t, F.col("id") == F.col("_t_bucket"), "left")
    counts = stage_table(every.select("id", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "bucket-counts")
    s_all, t_all = counts.agg(F.sum("s"), F.sum("t")).first()
    rows = counts.select("id", gain(F.col("t"), F.lit(t_all), F.col("s"), F.lit(s_all)).alias("gain")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("gain").to_numpy()
    return out


def weights(docs: DataFrame, by_bucket: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sums = np.zeros((3, len(texts)), np.int64)
            for start, stop in _slices(texts):
                found, sums[0, start:stop] = features(texts[start:stop])
                for bucket, doc in found:
                    ends = np.searchsorted(doc, np.arange(stop - start), "right")
                    upto = np.concatenate([[0], np.cumsum(by_bucket[bucket])])[ends]
                    sums[1, start:stop] += np.diff(ends, prepend=0)
                    sums[2, start:stop] += np.diff(upto, prepend=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, floored: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words; rank is null where a document isn't drawn."""
    facts = weights(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stage_table(facts, "resampling")
    able = (F.col("n_words") >= LEAST_WORDS) & F.col("doc_id").isNotNull()
    drawn = scored.where(able).count() * share // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("n_words")]
    ranked = running_sums(scored.where(able).withColumn("one", F.lit(1).cast("long")), order, ["one"], "resampling-order")
    place = F.when(F.col("one_before") < drawn, F.col("one_before") + 1).cast("long")
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", place).select(*columns).unionByName(rest.select(*columns))


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def resampling_sql(docs: str, target: str) -> str:
    """DuckDB SQL with the rows of resample(docs, target); CRCs go bit by bit over a table of 256."""
    texts = " UNION ALL ".join(f"SELECT {int(of == target)} AS side, {key} AS id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {of}" for of, key in ((docs, "doc_id"), (target, "item_id")))
    grams = " UNION ALL ".join(f"SELECT side, k, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))) AS g FROM texts" for n in (1, 2, 3))
    return f"""
WITH table_ AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(n))),
texts AS ({texts}),
grams AS ({grams}),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, table_.crc[xor(c & 255, b) + 1])), 4294967295) % {BUCKETS} AS bucket FROM (SELECT DISTINCT g FROM grams), table_),
counted AS (SELECT side, k, bucket, count(*) AS n FROM grams JOIN hashed USING (g) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t FROM counted GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sums),
weighed AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE side = 0 GROUP BY k),
scored AS (SELECT id AS doc_id, k, len(w)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
    FROM texts LEFT JOIN weighed USING (k) WHERE side = 0),
placed AS (SELECT *, count(*) FILTER (n_words >= {LEAST_WORDS} AND doc_id IS NOT NULL) OVER () AS able,
    row_number() OVER (ORDER BY (n_words >= {LEAST_WORDS} AND doc_id IS NOT NULL) DESC, score DESC, doc_id, n_features, n_words) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= able * {SHARE} // 100 THEN r END AS rank, n_words FROM placed"""


QUERIES = {"op11_resampling": op11_resampling}
ORACLES = {"op11_resampling": resampling_sql("documents", "benchmark")}
