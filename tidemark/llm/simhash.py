"""SimHash near-duplicates found with BK-trees.

Distinct fingerprints are searched, not documents. Two fingerprints within ``RADIUS`` bits agree on all
but ``RADIUS`` of ``m`` bit blocks, so each fingerprint goes to one shard per choice of ``m - RADIUS``
blocks and every link lies whole in some shard. A shard is a BK-tree: children are keyed by their
integer Hamming distance to the parent, and a query at distance d follows only the edges d - r to d + r.
Trees of all fingerprints would grow with the corpus, so a tree is not broadcast: its shard's queries
come to it in one shuffle. A shard over ``CHUNK`` fingerprints is cut into chunks, and each chunk's
tree meets the queries of every chunk in a group of its own, so no group outgrows a task.

The forest of a batch of shards is built and searched level by level in numpy. A group returns a star
per component of its links, not its pairs; stars meet in ``components``.

Nulls and texts without a word have fingerprint zero and link like any other; a null doc_id belongs to
its component but never names it, unless all ids there are null (component null). Repeated rows and
ids share fingerprint and component. Very long texts are hashed in blocks. An empty table gives no
rows. Other columns, whatever their names, don't enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.bktree import CHUNK, BKForest, in_chunks, union, whole_groups
from tidemark.llm.common import read_table, stage_table
from tidemark.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if set in over half the shingle hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - width + 1
    count = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        grams = map(b" ".join, zip(*[part[k:] for k in range(width)], strict=False))
        hashes = np.array([xxh64_intdigest(g, seed) for g in grams], ">u8")
        count += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_count(distinct: int) -> int:
    """Blocks so that a shard of spread fingerprints stays small: 16, 25 or 32 key bits."""
    return 4 if distinct <= 1 << 24 else 5 if distinct <= 1 << 31 else 6


def shard_keys(fp: Column, m: int, radius: int = RADIUS) -> Column:
    """Array of (table, key): one per choice of m - radius blocks of the fingerprint."""
    edges = [64 * i // m for i in range(m + 1)]
    keys = []
    for table, chosen in enumerate(combinations(range(m), m - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(table).alias("shard"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("key")))
    return F.array(*keys)


def group_links(group: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (fp, smallest-indexed fp of its class) of sorted groups.

    side 0: in the tree and a query; 1: in the tree; 2: a query.
    """
    tree, asks = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    label = np.arange(len(fps))
    if len(tree) and len(asks):
        forest = BKForest(group[tree], fps[tree])
        for q, item in forest.search(group[asks], fps[asks], radius):
            union(label, asks[q], tree[item])
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def fingerprint_links(distinct: DataFrame, n: int, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between the fingerprints of ``distinct`` (fp) that connect all within ``radius``."""
    keyed = distinct.select("fp", F.inline(shard_keys(F.col("fp"), block_count(n), radius)))
    placed = in_chunks(keyed, ["shard", "key"], chunk)
    spread = placed.repartition("shard", "key", "low", "high").sortWithinPartitions("shard", "key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in whole_groups(batches, ("shard", "key", "low", "high", "side", "fp"), 4):
            a, b = group_links(group, rows[4], np.ascontiguousarray(rows[5]).view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return spread.mapInArrow(run, "a long, b long").distinct()


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    marked = stage_table(fingerprints(docs), "simhash")
    distinct = stage_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    links = fingerprint_links(distinct.select("fp"), distinct.count())
    roots = stage_table(components(links, "a", "b"), "simhash-roots")
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy(F.col("root").alias("_root")).agg(F.min("first_doc").alias("component_id"))
    classes = stage_table(named.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"), "simhash-classes")
    return marked.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_classes(read_table(spark, folder, "documents"))


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
