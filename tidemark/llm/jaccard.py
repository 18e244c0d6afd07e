"""Near-duplicate documents: SimHash fingerprints searched with BK-trees, confirmed by exact Jaccard similarity.

Fingerprints are those of the sets of five-word shingles. At Jaccard 0.8 two of them differ in about 10 of
64 bits with a deviation of 3, so ``RADIUS`` 24 loses about one such pair in ten million among long texts (of sets of 4 and 5 shingles, one pair in 8,000); but a tree of all
fingerprints prunes nothing at that radius. So the trees are sharded by rare shingles: two sets with
Jaccard t or more share one of the n - ceil(t n) + 1 first shingles of either, in any order that is the same
for all. The order puts rare shingles first, by counts of ``BUCKETS`` hash buckets, which merge by addition.

Distinct sets are compared, not documents. Shingles of the same sets (a passage has many) make one shard. Per shard each set meets the least one (its lead) first, if
their fingerprints lie within the radius; confirmed pairs make classes. Then a shard that still holds sets of
different classes gets a BK-tree, and what it finds between classes is confirmed in turn, first at a small
radius. A pair is left to the least shard that both sets are in, as far as the ``HOMES`` least shards of each
tell, so that sets with many shards in common leave one pair, not one a shard. Before a found pair leaves the task it
passes an exact bound: sets differ by no less than the summed differences of the sizes of ``PARTS`` parts by hash. So a group of copies costs one comparison a set and
shard, and its pairs aren't emitted, whether they are similar enough or not.

Nulls: null texts and texts without a word are copies of each other; a null doc_id belongs to its class but never
names it. Repeated rows and ids share their class. Very long texts are processed whole. An empty table gives no
rows. Other columns, whatever their names, are kept by ``near_dedup`` and left out by ``similar_classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.bktree import BKForest, in_chunks, whole_groups
from tidemark.llm.common import ARROW_BYTES, drop_staged, free_names, settings, stage_table
from tidemark.llm.components import components
from tidemark.llm.phrases import _rolled, word_hashes

WIDTH = 5
LEAST = 0.8
RADIUS = 24
#: Radii that are searched before, so that most of a group of copies is one class when the last one is.
RADII = (6, 10)
#: Sets of a shard beyond which it is cut into chunks.
CHUNK = 1024
#: Parts of a set whose sizes bound the difference of two sets from below.
PARTS = 128
#: Least shards of a set by which a shard knows that two sets meet in an earlier one; more would only find the rest of the repeated pairs.
HOMES = 8
#: Stands for a missing one; no shard comes after it.
_NO_HOME = (1 << 63) - 1
#: Pairs whose parts are compared at a time.
COMPARED = 1 << 15
#: Pairs that are listed at a time; a group's pairs are at most the square of a chunk.
PAIRED = 1 << 18
#: Pairs of one set that are confirmed in one task.
PART = 512
BUCKETS = 1 << 20
#: Slack of comparisons of shares.
EPS = 1e-9
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 14
_ODD = np.random.default_rng(9).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct hashes of the runs of ``width`` words in lower case; a shorter text is one run."""
    words = word_hashes((text or "").encode().lower())[0]
    if not len(words):
        return np.zeros(0, np.int64)
    return np.unique(_rolled(words, min(width, len(words)), _ODD).view(np.int64))


def set_fingerprint(grams: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, as a signed number."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(grams), BLOCK):
        part = np.ascontiguousarray(grams[at : at + BLOCK])
        count += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(grams)).view(np.int64)[0])


def _set_id(grams: np.ndarray) -> int:
    return xxh64_intdigest(grams.tobytes()) - (1 << 63)


def part_sizes(grams: np.ndarray) -> np.ndarray:
    """Sizes (255 at most) of the parts of the set, eight in a number."""
    return np.minimum(np.bincount(grams & (PARTS - 1), minlength=PARTS), 255).astype(np.uint8).view(np.int64)


def _buckets(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield part, part.column(column).to_pylist()


def bucket_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many shingles fall into each hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS, np.int64)
        for _, texts in _texts(batches, 0):
            count += np.bincount(np.concatenate([_buckets(shingles(t, width)) for t in texts]), minlength=BUCKETS)
        at = np.flatnonzero(count)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[part])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.zeros(BUCKETS, np.int32)
    out[found["bucket"].to_numpy()] = np.minimum(found["n"].to_numpy(), (1 << 31) - 1)
    return out


def shingled(docs: DataFrame, width: int, least: float) -> DataFrame:
    """doc_id, sid (id of its set of shingles), fp, n (size), parts and the first shingles in the order (null without a word) of every row."""
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 1):
            own = [shingles(t, width) for t in texts]
            first = []
            for grams in own:
                n = len(grams) - int(np.ceil(least * len(grams) - EPS)) + 1
                rank = counts.value[_buckets(grams)]
                # The n rarest; np.lexsort breaks ties by the hash, the same for all sets.
                first.append(grams[np.lexsort((grams, rank))[:n]] if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()), pa.array([_set_id(g) for g in own], pa.int64()), pa.array([set_fingerprint(g) for g in own], pa.int64()),
                    pa.array([len(g) for g in own], pa.int64()), pa.array([part_sizes(g) for g in own], pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64())),
                ],
                ["doc_id", "sid", "fp", "n", "parts", "first"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sid long, fp long, n long, parts array<long>, first array<long>")


def sets_of(asked: DataFrame, docs: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """sid and grams of the sets in ``asked`` (sid), from one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0):
            own = [shingles(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(g) for g in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["sid", "grams"])

    wanted = marks.join(asked, "sid", "left_semi").select(F.col("first_doc").alias("_doc"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").select("text")
    # Rows of one id, or without one, may bring other sets along.
    return texts.mapInArrow(run, "sid long, grams array<long>").join(asked, "sid", "left_semi").groupBy("sid").agg(F.first("grams").alias("grams"))


def _confirmed(pairs: DataFrame, docs: DataFrame, marks: DataFrame, width: int, least: float, part: int = PART) -> DataFrame:
    """Staged: the pairs (a, b) with a Jaccard similarity of ``least`` or more.

    A set ``a`` of many pairs goes to one task for each ``part`` of them, once, and the sets of the ``b`` stream past it.
    """
    asked = stage_table(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "near-asked")
    known = stage_table(sets_of(asked, docs, marks, width), "near-sets")
    sizes = stage_table(pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("salts")), "near-sizes")
    held = known.join(sizes, F.col("sid") == F.col("_a")).select(F.col("sid").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "grams")
    salted = pairs.join(sizes, F.col("a") == F.col("_a")).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    met = salted.join(known, F.col("b") == F.col("sid")).select("a", "salt", "b", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.int64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k, (a, salt, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                grams = batch.column(3)[k].values.to_numpy(zero_copy_only=False)
                if b is None:
                    now, own = (a, salt), grams
                elif now == (a, salt):
                    both = len(np.intersect1d(own, grams, assume_unique=True))
                    if both >= least * (len(own) + len(grams) - both) - EPS:
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    streamed = held.unionByName(met).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    with settings(docs.sparkSession, {ARROW_BYTES: "8m"}):  # a set is as large as its document
        out = stage_table(streamed.mapInArrow(run, "a long, b long"), "near-links")
    for done in (known, asked, sizes):
        drop_staged(done)
    return out


def _crossed(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the runs a[i], a[i] + 1, ... (size_a[i] of them) with those of b[i], in slices of about ``PAIRED`` pairs."""
    times = size_a * size_b
    ends = np.cumsum(times)
    at = 0
    while at < len(times):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRED, "right")))
        own = times[at:stop]
        pair = np.repeat(np.arange(at, stop), own)
        step = np.arange(len(pair)) - np.repeat(np.cumsum(own) - own, own)
        yield a[pair] + step // size_b[pair], b[pair] + step % size_b[pair]
        at = stop


def shard_pairs(shards: DataFrame, least: float, radius: int, beyond: int = -1, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) of sets of different classes within the radius, but beyond ``beyond``, that may be similar.

    By a BK-tree per shard; shards: g, sid, fp, n, root, parts, homes (the least shards of the set, ascending).
    """
    names = [f"p{k}" for k in range(PARTS // 8)]
    least_shards = [f"h{k}" for k in range(HOMES)]
    flat = shards.select(
        "g", "sid", "fp", "n", "root", *[F.get("parts", F.lit(k)).alias(name) for k, name in enumerate(names)],
        *[F.coalesce(F.get("homes", F.lit(k)), F.lit(_NO_HOME)).alias(name) for k, name in enumerate(least_shards)],
    )
    spread = in_chunks(flat, ["g"], chunk, by="sid").repartition("g", "low", "high").sortWithinPartitions("g", "low", "high", "side", "fp", "root")

    def similar(a: np.ndarray, b: np.ndarray, n: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Whether the sets may be: |A - B| + |B - A| <= (1 - t) / (1 + t) * (|A| + |B|)."""
        most = (1 - least) / (1 + least) * (n[a] + n[b]) + EPS
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), COMPARED):
            x, y = parts[a[at : at + COMPARED]], parts[b[at : at + COMPARED]]
            out[at : at + COMPARED] = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64) <= most[at : at + COMPARED]
        return out

    def here(a: np.ndarray, b: np.ndarray, shard: np.ndarray, homes: np.ndarray) -> np.ndarray:
        """Whether no earlier shard is known to hold both sets; in the least one of all that is always so."""
        out = np.ones(len(a), bool)
        for at in range(0, len(a), COMPARED):
            x, y = homes[a[at : at + COMPARED]], homes[b[at : at + COMPARED]]
            earlier = x < shard[a[at : at + COMPARED], None]
            for k in range(HOMES):
                out[at : at + COMPARED] &= ~((x == y[:, k, None]) & earlier).any(axis=1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in whole_groups(batches, ("g", "low", "high", "side", "fp", "sid", "n", "root", *names, *least_shards), 3):
            side, fp, sid, n, root = rows[3:8]
            parts = np.ascontiguousarray(rows[8 : 8 + len(names)].T).view(np.uint8)
            homes = np.ascontiguousarray(rows[8 + len(names) :].T)
            # Runs of one fingerprint on one side of a group, and in them runs of one class: pairs of runs of one class are skipped whole.
            turn = (group[1:] != group[:-1]) | (side[1:] != side[:-1]) | (fp[1:] != fp[:-1])
            start = np.flatnonzero(np.r_[True, turn])
            cell = np.flatnonzero(np.r_[True, turn | (root[1:] != root[:-1])])
            cell_size, first_cell = np.diff(np.r_[cell, len(fp)]), np.searchsorted(cell, start)
            cells = np.diff(np.r_[first_cell, len(cell)])
            bits = np.ascontiguousarray(fp[start]).view(np.uint64)
            tree, asks = np.flatnonzero(side[start] != 2), np.flatnonzero(side[start] != 1)
            if not len(tree) or not len(asks):
                continue
            for q, item in BKForest(group[start][tree], bits[tree]).search(group[start][asks], bits[asks], radius):
                one, two = asks[q], tree[item]
                kept = ((one <= two) | (side[start][one] == 2)) & (np.bitwise_count(bits[one] ^ bits[two]) > beyond)
                one, two = one[kept], two[kept]
                for x, y in _crossed(first_cell[one], cells[one], first_cell[two], cells[two]):
                    apart = root[cell[x]] != root[cell[y]]
                    x, y = x[apart], y[apart]
                    for a, b in _crossed(cell[x], cell_size[x], cell[y], cell_size[y]):
                        near = np.flatnonzero(np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - EPS)
                        near = near[here(a[near], b[near], rows[0], homes)]
                        near = near[similar(a[near], b[near], n, parts)]
                        a, b = sid[a[near]], sid[b[near]]
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return spread.mapInArrow(run, "a long, b long").distinct()


def shards_of(marks: DataFrame) -> DataFrame:
    """Staged: g, sid and lead (its least set) of the shards of two or more sets, one for each different group of sets.

    Groups are equal if their least and greatest set, their number and the sum of their sets' bits (by XOR, 64 bits) are.
    """
    posted = marks.select("sid", F.explode("first").alias("g"))
    members = posted.groupBy("g").agg(F.min("sid").alias("lead"), F.max("sid").alias("high"), F.count(F.lit(1)).alias("sets"), F.bit_xor("sid").alias("mix")).where("lead < high")
    kept = stage_table(members.groupBy("lead", "high", "sets", "mix").agg(F.min("g").alias("_g")).select("_g", "lead"), "near-shards")
    met = stage_table(posted.join(kept, F.col("g") == F.col("_g")).select("g", "sid", "lead"), "near-met")
    drop_staged(kept)
    return met


def similar_links(docs: DataFrame, marks: DataFrame, width: int = WIDTH, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between set ids that connect all sets with Jaccard ``least`` or more.

    marks: fp, n, parts, first and first_doc of each distinct set.
    """
    met = shards_of(marks)
    homes = met.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("g")), 1, HOMES).alias("homes"))
    homed = stage_table(marks.select("sid", "fp", "n", "parts").join(homes, "sid"), "near-homes")
    of = lambda name: marks.select(F.col("sid").alias(name), F.col("fp").alias(f"{name}_fp"), F.col("n").alias(f"{name}_n"))
    near = (F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= radius) & (F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n") - EPS)
    stars = met.where("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct().join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b")
    stars = stage_table(stars, "near-stars")
    linked = _confirmed(stars, docs, marks, width, least)
    drop_staged(stars)
    # Wider and wider: what is near is linked first, so that few pairs of a group of copies lie between classes later on.
    before = -1
    for within in (*[r for r in RADII if r < radius], radius):
        roots = stage_table(components(linked, "a", "b"), "near-roots")
        classed = met.select("g", "sid").join(roots, F.col("sid") == F.col("node"), "left").select("g", "sid", F.coalesce("root", "sid").alias("root"))
        mixed = classed.groupBy(F.col("g").alias("_g")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("_g")
        open_ = stage_table(classed.join(mixed, F.col("g") == F.col("_g"), "left_semi"), "near-open")
        pairs = stage_table(shard_pairs(open_.join(homed, "sid"), least, within, before), "near-pairs")
        before = within
        more = _confirmed(pairs, docs, marks, width, least)
        # A class is its star from here on.
        stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        links = stage_table(stars.unionByName(more), "near-linked")
        for done in (open_, pairs, more, roots, linked):
            drop_staged(done)
        linked = links
    drop_staged(met)
    drop_staged(homed)
    return linked


def similar_classes(docs: DataFrame, width: int = WIDTH, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """doc_id and component_id: the least id of the documents connected by links; null if all are null."""
    rows = stage_table(shingled(docs, width, least), "near-rows")
    marks = stage_table(rows.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("fp", "n", "parts", "first")], F.min("doc_id").alias("first_doc")), "near-marks")
    ids = stage_table(rows.select("doc_id", "sid"), "near-ids")
    drop_staged(rows)
    roots = stage_table(components(similar_links(docs, marks, width, least, radius), "a", "b"), "near-roots")
    firsts = marks.join(roots, F.col("sid") == F.col("node"), "left")
    firsts = stage_table(firsts.select(F.col("sid").alias("_sid"), "first_doc", F.coalesce("root", "sid").alias("root")), "near-firsts")
    least_doc = firsts.groupBy(F.col("root").alias("_root")).agg(F.min("first_doc").alias("component_id"))
    named = firsts.join(least_doc, F.col("root") == F.col("_root")).select("_sid", "component_id")
    out = stage_table(ids.join(named, F.col("sid") == F.col("_sid")).select("doc_id", "component_id"), "near-classes")
    for done in (ids, marks, roots, firsts):
        drop_staged(done)
    return out


def near_dedup(docs: DataFrame, width: int = WIDTH, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without those whose class holds a smaller doc_id; same columns.

    Ids must tell documents apart: all rows of a kept id stay, and so do rows without an id.
    """
    (gone,) = free_names(docs, "gone")
    dropped = similar_classes(docs, width, least, radius).where("doc_id <> component_id").select(F.col("doc_id").alias(gone))
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")
