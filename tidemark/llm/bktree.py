"""BK-trees of 64-bit fingerprints: many at once in numpy, and the placing of large shards in chunks.

A tree's children are keyed by their integer Hamming distance to the parent; a query at distance d follows
only the edges d - r to d + r.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage_table

#: Fingerprints of a shard beyond which it is cut into chunks.
CHUNK = 4096
#: (query, node) pairs that are compared at a time.
FRONTIER = 1 << 19


class BKForest:
    """BK-trees of several groups at once; nodes are numbered level by level."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        """``group``: ascending group numbers; ``fps``: uint64, distinct within a group."""
        item = np.arange(len(fps))
        bucket = group.astype(np.int64)
        nodes, keys, first = [], [], True
        numbered = 0
        while len(item):
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sizes = np.diff(np.r_[starts, len(item)])
            nodes.append(item[starts])
            keys.append(np.full(len(starts), -1) if first else bucket[starts])
            if first:
                self.root_groups = bucket[starts]
            parent = np.repeat(np.arange(numbered, numbered + len(starts)), sizes)
            numbered += len(starts)
            rest = np.ones(len(item), bool)
            rest[starts] = False
            at = np.repeat(item[starts], sizes)[rest]
            item, parent = item[rest], parent[rest]
            bucket = parent * 65 + np.bitwise_count(fps[item] ^ fps[at])
            order = np.argsort(bucket, kind="stable")
            item, bucket, first = item[order], bucket[order], False
        self.item = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        self.edge = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.fp = fps[self.item]

    def search(self, group: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, item) arrays of all links between the queries and the trees of their groups."""
        root = np.searchsorted(self.root_groups, group)
        have = (root < len(self.root_groups)) & (self.root_groups[np.minimum(root, len(self.root_groups) - 1)] == group)
        query = np.flatnonzero(have)
        stack = [(query[i : i + FRONTIER], root[query[i : i + FRONTIER]]) for i in range(0, len(query), FRONTIER)]
        while stack:
            q, node = stack.pop()
            d = np.bitwise_count(fps[q] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], self.item[node[near]]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            ends = np.cumsum(n)
            # Expand slice by slice, so that a dense tree doesn't blow up the frontier.
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER, "right")))
                part = n[at:to]
                if total := int(part.sum()):
                    offset = np.repeat(low[at:to] - (np.cumsum(part) - part), part)
                    stack.append((np.repeat(q[at:to], part), np.arange(total) + offset))
                at = to


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i] in ``label`` (each item's class root, roots point to themselves)."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (up := label[label])).any():
            label[:] = up


def in_chunks(keyed: DataFrame, keys: list[str], chunk: int = CHUNK, by: str = "fp") -> DataFrame:
    """The rows with low, high and side: a shard over ``chunk`` rows is cut, and each pair of its chunks is a group.

    side 0: in the group's tree and a query; 1: in the tree; 2: a query. Rows of one ``by`` share a chunk.
    """
    big = keyed.groupBy(*keys).count().where(F.col("count") > chunk)
    big = stage_table(big.select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "shards-big")
    own = F.pmod(F.xxhash64(by), F.col("chunks")).cast("int")
    meets = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(
            F.least(c, own).alias("low"), F.greatest(c, own).alias("high"), F.when(c == own, 0).when(own < c, 1).otherwise(2).alias("side")))
    )
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    joined = keyed.join(big, same[0] if len(same) == 1 else same[0] & same[1], "left")
    return joined.select(*keyed.columns, F.inline(meets))


def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group numbers, rows of the columns as int64) of sorted batches, cut only where one of the first ``keys`` columns changes."""
    held: list[np.ndarray] = []
    for batch in _with_end(batches):
        new = None if batch is None else np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
        rows = np.concatenate([*held, *([] if new is None else [new])], axis=1) if held or new is not None else None
        if rows is None or not rows.shape[1]:
            continue
        changes = np.flatnonzero((rows[:keys, 1:] != rows[:keys, :-1]).any(axis=0)) + 1
        cut = rows.shape[1] if batch is None else int(changes[-1]) if len(changes) else 0
        held = [rows[:, cut:]] if cut < rows.shape[1] else []
        if cut:
            group = np.zeros(cut, np.int64)
            group[changes[changes < cut]] = 1
            yield np.cumsum(group), rows[:, :cut]


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None
