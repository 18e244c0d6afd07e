"""Folds over ordered events by blocks: what a block does to any state is summarised, summaries compose in order.

Rows are range-partitioned by key and order, so a key with a third of all rows is spread over many blocks like any
other stretch of rows, and blocks of one key follow each other. Two kinds of fold have summaries that
don't grow with a block:

* a finite state machine: a block is a map from states to states;
* windows of a fixed length that open at the first event outside of the last one: a block maps the opening of the
  window that it enters with to that of its last one, for the few events at which its first own window can open.

A block holds the rows of one partition, a key's summaries are as many as its blocks. Null keys are keys; rows
with a null time take no part in windows, null events leave a state as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import staged


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch, list[int]]]:
    """(whether the first run goes on from the batch before, batch, starts of its runs of equal keys and its end)."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        codes = np.stack([b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        yield _key(b, keys, 0) == before, b, cuts
        before = _key(b, keys, b.num_rows - 1)


def _key(b: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(b.column(k)[row].as_py() for k in keys)


def composed(maps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One map for each run of maps (rows) that begins at ``starts``: first to last, two at a time."""
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(maps)]))
    while len(maps) > len(starts):
        first = np.searchsorted(run, np.arange(len(starts)))
        even = np.flatnonzero((np.arange(len(maps)) - first[run]) % 2 == 0)
        paired = even[(even + 1 < len(maps)) & (run[np.minimum(even + 1, len(maps) - 1)] == run[even])]
        out = maps.copy()
        out[paired] = np.take_along_axis(maps[paired + 1], maps[paired], axis=1)
        maps, run = out[even], run[even]
    return maps


def final_states(rows: DataFrame, keys: list[str], event: str, order: list[str], transitions: dict[tuple[str, str], str], start: str) -> DataFrame:
    """keys and status: the state of each key after its events in order; an unknown pair leaves the state."""
    states = sorted({start, *(s for s, _ in transitions), *transitions.values()})
    index = {s: k for k, s in enumerate(states)}
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def step(name: str | None) -> list[int]:
        return [index[transitions.get((s, (name or "").strip().lower()), s)] for s in states]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.RecordBatch, np.ndarray] | None = None

        def emitted(b: pa.RecordBatch, at: list[int], maps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at)) for k in keys], b.column("block").take(pa.array(at)), pa.array(maps.tolist(), pa.list_(pa.int32()))], [*keys, "block", "after"])

        for goes_on, b, cuts in _runs(batches, keys):
            events = b.column("event").dictionary_encode()
            table = np.array([step(e) for e in [*events.dictionary.to_pylist(), None]])
            maps = composed(table[events.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)], np.array(cuts[:-1]))
            if held is not None and goes_on:
                maps[0] = maps[0][held[1]]
            elif held is not None:
                yield emitted(held[0], [0], held[1][None])
            if len(maps) > 1:
                yield emitted(b, cuts[:-2], maps[:-1])
            held = b.slice(b.num_rows - 1), maps[-1]
        if held is not None:
            yield emitted(held[0], [0], held[1][None])

    # The key's columns lead the range order, so a block is a stretch of keys and, in a large key, of its events.
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*keys, F.col(event).alias("event"), F.spark_partition_id().alias("block"))
    maps = ranged.mapInArrow(run, f"{kinds}, block int, after array<int>")
    in_order = F.array_sort(F.collect_list(F.struct("block", "after")))
    folded = F.aggregate("maps", F.lit(index[start]), lambda s, x: F.get(x["after"], s))
    return maps.groupBy(*keys).agg(in_order.alias("maps")).select(*keys, F.get(F.array(*map(F.lit, states)), folded).alias("status"))


def _openings(times: np.ndarray, length: int) -> np.ndarray:
    """For each event: the place of the first event outside of a window that opens with it."""
    return np.searchsorted(times, times + length, "left")


def _last_openings(times: np.ndarray, length: int) -> np.ndarray:
    """For each event: the place of the last window's opening, if a window opens with it."""
    then = _openings(times, length)
    at = np.where(then < len(times), then, np.arange(len(times)))
    while (at != (further := at[at])).any():
        at = further
    return at


def greedy_windows(rows: DataFrame, keys: list[str], time: Column, length: int) -> DataFrame:
    """keys, opened and n of each window: it opens at the first time outside of the last one and takes those before opened + length."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    timed = rows.select(*keys, time.alias("at")).where("at is not null")
    blocks = staged(timed.repartitionByRange(*keys, "at").withColumn("block", F.spark_partition_id()), "blocks")
    order = ["block", *keys, "at"]

    def whole(batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """(first row, times) of each key in each block."""
        held: tuple[pa.RecordBatch, list[np.ndarray]] | None = None
        for goes_on, b, cuts in _runs(batches, [*others, *keys]):
            times = b.column("at").to_numpy(zero_copy_only=False)
            for k, (start, stop) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if k == 0 and goes_on and held is not None:
                    held[1].append(times[start:stop])
                    continue
                if held is not None:
                    yield held[0], np.concatenate(held[1])
                held = b.slice(start, 1), [times[start:stop]]
        if held is not None:
            yield held[0], np.concatenate(held[1])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only a block's first and last key can be in other blocks too.
        edge: tuple[pa.RecordBatch, np.ndarray] | None = None
        first = None
        for row, times in whole(batches, ["block"]):
            block = row.column("block")[0].as_py()
            if block != first:
                if edge is not None:
                    yield summary(*edge)
                yield summary(row, times)
                first, edge = block, None
            else:
                edge = row, times
        if edge is not None:
            yield summary(*edge)

    def summary(row: pa.RecordBatch, times: np.ndarray) -> pa.RecordBatch:
        # A window that comes from before ends within ``length`` of the block's first event.
        n = min(len(times), int(np.searchsorted(times, times[0] + length, "left")) + 1)
        return pa.RecordBatch.from_arrays([*[row.column(k) for k in keys], row.column("block"), pa.array([times[:n]], pa.list_(pa.int64())), pa.array([times[_last_openings(times, length)[:n]]], pa.list_(pa.int64()))], [*keys, "block", "starts", "ends"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened = None, None
        for b in batches:
            out = []
            for k in range(b.num_rows):
                own = _key(b, keys, k)
                if own != key:
                    key, opened = own, None
                starts, ends = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends"))
                out.append(opened)
                place = 0 if opened is None else int(np.searchsorted(starts, opened + length, "left"))
                if place < len(starts):
                    opened = int(ends[place])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in [*keys, "block"]], pa.array(out, pa.int64())], [*keys, "block", "entered"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, times in whole(batches, ["block"]):
            entered = row.column("entered")[0].as_py()
            opened, counts, at = [], [], 0
            if entered is not None:
                at = int(np.searchsorted(times, entered + length, "left"))
                opened, counts = ([entered], [at]) if at else ([], [])
            then = _openings(times, length)
            while at < len(times):
                opened.append(int(times[at]))
                counts.append(int(then[at]) - at)
                at = int(then[at])
            yield pa.RecordBatch.from_arrays([*[pa.repeat(row.column(k)[0], len(opened)) for k in keys], pa.array(opened, pa.int64()), pa.array(counts, pa.int64())], [*keys, "opened", "n"])

    per_block = blocks.repartition("block").sortWithinPartitions(*order)
    edges = per_block.mapInArrow(summarise, f"{kinds}, block int, starts array<long>, ends array<long>")
    entries = staged(edges.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(enter, f"{kinds}, block int, entered long").where("entered is not null"), "block-entries")
    known = entries.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("block").alias("_block"), "entered")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    entering = blocks.join(known, [F.col("block") == F.col("_block"), *same], "left").select(*order, "entered")
    found = entering.repartition("block").sortWithinPartitions(*order).mapInArrow(windows, f"{kinds}, opened long, n long")
    return found.groupBy(*keys, "opened").agg(F.sum("n").alias("n"))
