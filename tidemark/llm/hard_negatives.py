"""Hard negatives of anchor vectors, found behind bounds from segment summaries.

Every vector is stored with the mean and the deviation of each of ``SEGMENTS`` segments. In a segment of
length L the inner product of two vectors is at least L times (product of means minus product of deviations)
and at most L times their sum, so summed over segments these bound the score. Summaries of
halves merge into those of the whole: a pair is first bounded by the coarsest, then by segments half as long,
and only pairs that no level excludes are scored exactly. A pair is excluded if its upper
bound is below the score that the anchor's worst kept row has, or if its bounds lie outside of what an anchor's
positives allow.

Anchors are cut into blocks, all rows into slices by id. A task holds one block of anchors with their
best rows so far and streams one slice past them, so memory is bounded and what leaves a task is ``k`` rows per
anchor (and positive). Positives meet rows of their label only; the negatives' pass meets all labels. The
work is the stated query set (ids divisible by ``EVERY``) against all rows, so it grows with both.

Nulls: rows without id or label and those with a null or not finite component take no part. An id that repeats counts once per
anchor, with its best score; of several rows with an anchor's id the least (by label and vector) is the anchor. Vectors of
different lengths don't meet; empty ones score 0. Scores are exact whole numbers and are cut at the limits of a long. A
positive of negative score has no negatives. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read_table, stage_table
from tidemark.llm.vectors import finite, keyed_runs, matrix

EVERY = 100
POSITIVES = 5
NEGATIVES = 5
#: Components are multiplied by this and floored.
GRAIN = 256
SEGMENTS = 32
#: Anchors that a task holds.
BLOCK = 32_768
#: Rows per slice at least, and slices at most.
SLICE = 8_192
SLICES = 64
#: Anchors and rows whose bounds are computed at a time.
TILE = 512
#: Share of open pairs below which they are bounded and scored one by one.
FEW = 0.08
EXACT = float(1 << 53)


def lengths(dim: int) -> np.ndarray:
    """Lengths of the segments of vectors of ``dim`` components."""
    return np.diff(np.linspace(0, dim, min(SEGMENTS, dim) + 1).astype(int))


def summaries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row."""
    n = lengths(rows.shape[1])
    starts = np.cumsum(n) - n
    mean = np.add.reduceat(rows, starts, axis=1) / n
    return mean, np.sqrt(np.add.reduceat((rows - np.repeat(mean, n, axis=1)) ** 2, starts, axis=1) / n)


def levels(mean: np.ndarray, deviation: np.ndarray, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means, deviations), times the root of the segment's length, from one segment to all."""
    out, n = [], lengths(dim)
    while True:
        out.append((mean * np.sqrt(n), deviation * np.sqrt(n)))
        if len(n) == 1:
            return out[::-1]
        starts = np.arange(0, len(n), 2)
        whole = np.add.reduceat(n, starts)
        square = np.add.reduceat((deviation**2 + mean**2) * n, starts, axis=1) / whole
        mean = np.add.reduceat(mean * n, starts, axis=1) / whole
        deviation, n = np.sqrt(np.maximum(0, square - mean**2)), whole


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, vector (whole numbers), mean, deviation of the rows that take part."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * GRAIN).cast("long"))
    able = vectors.where(finite("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = able.select("vec_id", label.alias("label"), F.size("embedding").alias("dim"), F.when(F.size("embedding") == 0, F.array(F.lit(0).cast("long"))).otherwise(whole).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in keyed_runs((b.select(["dim", "vec_id", "label", "vector"]) for b in batches), 1):
            made = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in summaries(matrix(part.column("vector")))]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("vec_id", "label", "dim", "vector")] + made, ["vec_id", "label", "dim", "vector", "mean", "deviation"])

    return stage_table(rows.mapInArrow(run, rows.schema.simpleString()[7:-1] + ", mean array<double>, deviation array<double>"), "vectors-prepared")


class Anchors:
    """A block of anchors with the ``k`` best rows found so far for each of their ranges of scores."""

    def __init__(self, k: int, same_label: bool) -> None:
        self.k, self.same_label, self.parts, self.ids = k, same_label, [], np.zeros(0, np.int64)

    def hold(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def _begin(self) -> None:
        if not self.parts:
            return
        table, self.parts = pa.Table.from_batches(self.parts).combine_chunks(), []
        self.ids, self.labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        self.vectors, self.levels = _arrays(table.column("vector").chunk(0), table.column("mean").chunk(0), table.column("deviation").chunk(0))
        asks = table.column("asks").to_pylist()
        self.asks = [[(a["vec_id"], a["score"], -(-4 * a["score"] // 5), a["score"]) for a in own] if own else [(None, None, -np.inf, np.inf)] for own in asks]
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own) for own in self.asks]
        self.least = np.array([min(a[2] for a in own) for own in self.asks], float)
        self.most = np.array([max(a[3] for a in own) for own in self.asks], float)

    def meet(self, rows: pa.RecordBatch) -> None:
        self._begin()
        if not len(self.ids):
            return
        ids, labels = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        vectors, summary = _arrays(rows.column("vector"), rows.column("mean"), rows.column("deviation"))
        for at in range(0, len(self.ids), TILE):
            part = slice(at, at + TILE)
            open_ = (self.labels[part, None] == labels) == self.same_label
            if self.same_label:
                open_ &= self.ids[part, None] != ids
            exact = _scored(self.vectors[part], vectors, open_, [(a[0][part], a[1][part]) for a in self.levels], summary, self.least[part], self.most[part])
            for i, (which, scores) in exact:
                self._take(at + i, ids[which], scores)

    def _take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        needs = []
        for q, (_, _, low, high) in enumerate(self.asks[i]):
            fit = (scores >= low) & (scores <= high)
            found, kept = self.best[i][q]
            ids_q, scores_q = np.concatenate([kept, ids[fit]]), np.concatenate([found, scores[fit]])
            order = np.lexsort((ids_q, -scores_q))
            first = np.sort(np.unique(ids_q[order], return_index=True)[1])[: self.k]
            self.best[i][q] = scores_q[order][first], ids_q[order][first]
            needs.append(max(low, self.best[i][q][0][-1]) if len(first) == self.k else low)
        self.least[i] = min(needs)

    def found(self) -> Iterator[pa.RecordBatch]:
        self._begin()
        rows = [(int(self.ids[i]), ask[0], ask[1], *pair) for i, own in enumerate(self.best) for ask, (scores, ids) in zip(self.asks[i], own, strict=True) for pair in zip(ids.tolist(), scores.tolist(), strict=True)] if len(self.ids) else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], FOUND)


FOUND = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]


def _arrays(vector: pa.Array, mean: pa.Array, deviation: pa.Array) -> tuple[np.ndarray, list]:
    rows = matrix(vector)
    if np.abs(rows).max() >= EXACT:  # beyond doubles
        rows = np.array(vector.to_pylist(), object)
    return rows, levels(matrix(mean), matrix(deviation), rows.shape[1])


def _wide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products beyond the doubles' exact range, cut at the limits of a long."""
    exact = [x if x.dtype == object else np.array([[int(c) for c in row] for row in x], object) for x in (a, b)]
    return np.clip(exact[0] @ exact[1].T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _scored(a: np.ndarray, b: np.ndarray, open_: np.ndarray, levels_a: list, levels_b: list, least: np.ndarray, most: np.ndarray) -> Iterator[tuple]:
    """(i, (places in b, scores)) of the open pairs that no level of summaries excludes.

    A level bounds all pairs by two matrix products as long as many are open, then only the open ones.
    """
    i, j = None, None
    if a.dtype == object or b.dtype == object or np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
        i, j = np.nonzero(open_)
        scores = _wide(a, b)[i, j]
    else:
        slack = 1 + 1e-9 * np.sqrt((a**2).sum(axis=1).max() * (b**2).sum(axis=1).max())
        for (mean_a, dev_a), (mean_b, dev_b) in zip(levels_a, levels_b, strict=True):
            if i is None:
                middle, width = mean_a @ mean_b.T, dev_a @ dev_b.T + slack
                open_ &= (middle + width >= least[:, None]) & (middle - width <= most[:, None])
                if np.count_nonzero(open_) < FEW * open_.size:
                    i, j = np.nonzero(open_)
            else:
                middle, width = np.einsum("ps,ps->p", mean_a[i], mean_b[j]), np.einsum("ps,ps->p", dev_a[i], dev_b[j]) + slack
                fit = (middle + width >= least[i]) & (middle - width <= most[i])
                i, j = i[fit], j[fit]
        if i is None:
            i, j = np.nonzero(open_)
            scores = (a @ b.T)[i, j].astype(np.int64)
        else:
            scores = np.einsum("pd,pd->p", a[i], b[j]).astype(np.int64)
    enough = scores >= least[i]
    i, j, scores = i[enough], j[enough], scores[enough]
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for start, stop in zip(starts, np.append(starts, len(i))[1:], strict=True):
        yield int(i[start]), (j[start:stop], scores[start:stop])


def _best(asking: DataFrame, rows: DataFrame, k: int, same_label: bool, block: int, slice_: int) -> DataFrame:
    """The ``k`` best rows of every anchor (and positive) of ``asking`` within each slice of ``rows``."""
    part = F.col("label") if same_label else F.lit(0).cast("long")
    slices = max(1, min(SLICES, -(-rows.count() // slice_)))
    key = ["part", "dim"]
    sizes = asking.groupBy(part.alias("_part"), F.col("dim").alias("_dim")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sizes = stage_table(sizes, "anchor-blocks")
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    held = asking.withColumn("part", part).join(sizes, same).withColumns({"block": own(F.col("blocks")), "slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1))), "streams": F.lit(False)})
    met = rows.withColumn("part", part).join(sizes, same).withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "slice": own(F.lit(slices)), "streams": F.lit(True)})
    order = [*key, "block", "slice"]
    columns = [*order, "streams", "vec_id", "label", "vector", "mean", "deviation", "asks"]
    both = held.select(*columns).unionByName(met.select(*columns[:-1]), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors = None, Anchors(k, same_label)
        for (*new, streams), run_ in keyed_runs(batches, 5, 2048):
            if new != now:
                yield from anchors.found()
                now, anchors = new, Anchors(k, same_label)
            (anchors.meet if streams else anchors.hold)(run_)
        yield from anchors.found()

    found = both.repartition(*order).sortWithinPartitions(*order, "streams").mapInArrow(run, ", ".join(f"{c} long" for c in FOUND))
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = prepared(vectors)
    fields = ["label", "dim", "vector", "mean", "deviation"]
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(*fields)).alias("a")).select("vec_id", "a.*")
    anchors = stage_table(anchors, "anchors")
    ask = F.struct("vec_id", "score")
    found = _best(anchors.withColumn("asks", F.array().cast("array<struct<vec_id:long,score:long>>")), rows, positives, True, block, slice_)
    asks = found.where("score >= 0").groupBy(F.col("anchor_id").alias("_anchor")).agg(F.collect_list(ask).alias("asks"))
    asking = stage_table(anchors.join(asks, F.col("vec_id") == F.col("_anchor")).drop("_anchor"), "anchors-asking")
    best = _best(asking, rows, negatives, False, block, slice_)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(read_table(spark, folder, "embeddings"))


def negatives_sql(table: str) -> str:
    """DuckDB SQL with the rows of hard_negatives over ``table``."""
    return f"""
WITH fit AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({GRAIN} * x::DOUBLE)) AS e
    FROM {table} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
    FROM fit a JOIN fit r ON a.vec_id <> r.vec_id AND len(a.e) = len(r.e) WHERE a.vec_id % {EVERY} = 0),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= {NEGATIVES}"""


QUERIES = {"op12_negatives": op12_negatives}
ORACLES = {"op12_negatives": negatives_sql("embeddings")}
