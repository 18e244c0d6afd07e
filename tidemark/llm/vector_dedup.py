"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors of one label are one node, so a large group of copies costs its rows and no pair. Cells are
centroids of a spherical k-means fitted on a bounded sample (``FIT`` rows per centroid); every vector is
assigned to its nearest centroid, its home. Two vectors at the threshold may have different homes:
a vector therefore also visits each cell of a smaller number whose border is near. With d the chord of the threshold,
a vector at chord d or less from x can only have home c if x's products with its own centroid h and with c differ by at most d times
the chord between h and c. ``slack`` is the part of that bound in use: 1, the default, loses no pair. Where
vectors lie evenly around the sphere that bound prunes little; less slack then saves visits and loses pairs that lie straight across
a border (at 0.5, in a direction within 60 degrees of the straight one).

Inside a label's cell rows are cut into blocks of about ``BLOCK``. A task holds one block and streams the
blocks after it and the visitors past it, so each pair meets once; a row of a large cell is sent to the blocks before its
own. From a product leave one row for each vector with links, with their number and a root, never
pairs: links of a group are counted where they are found.

Nulls: rows with a null label or a null, empty, zero or not finite vector link with nothing and are their own component.
Vectors of different lengths don't link. A null vec_id counts as a vector; its component is the
smallest id around it, null if there is none. Rows that repeat an id are vectors of their own. An
empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bktree import union
from tidemark.llm.common import read_table, stage_table
from tidemark.llm.components import components
from tidemark.llm.vectors import finite, keyed_runs, matrix

LEAST = 0.98
#: Vectors of the largest label per cell; cells of more are cut into blocks.
CELL = 1024
#: Centroids at most: they are sent to every task.
MAX_CELLS = 4096
#: Sampled rows per centroid to fit on.
FIT = 256
BLOCK = 2048
#: Part of the bound on visits; 1 loses no pair.
SLACK = 1.0
SEED = 42


def unit(rows: np.ndarray) -> np.ndarray:
    """The rows at length 1; scaled first, so that no square over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key of every row; one row per label and vector: key, node, label, embedding, dim, least_id, copies)."""
    able = F.col("label").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0)
    key = F.struct(F.xxhash64("label", "embedding").alias("a"), F.xxhash64("embedding", "label", F.lit(1)).alias("b"))
    rows = vectors.select("vec_id", "label", "embedding", F.when(able, key).alias("key"))
    grouped = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    return rows.select("vec_id", "key"), stage_table(grouped.withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()}), "vectors")


def centroids(nodes: DataFrame, cell: int = CELL) -> np.ndarray:
    """Unit centroids of the most frequent vector length; none if one cell holds all."""
    largest = nodes.groupBy("label", "dim").count().groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).orderBy(F.desc("n"), "dim").first()
    k = min(MAX_CELLS, -(-largest.most // cell)) if largest else 1
    if k < 2:
        return np.zeros((0, 0))
    sample = nodes.where(F.col("dim") == largest.dim).sample(min(1.0, FIT * k / largest.n), SEED)
    points = stage_table(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), "vector-sample")
    model = KMeans(k=k, distanceMeasure="cosine", initMode="random", maxIter=8, seed=SEED).fit(points)
    return unit(np.array(model.clusterCenters()))


def in_cells(nodes: DataFrame, centres: np.ndarray, least: float = LEAST, slack: float = SLACK) -> DataFrame:
    """node, label, dim, copies, embedding, home, guest_of: cells of a smaller number that a vector visits."""
    chord = np.sqrt(2 * (1 - least))
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) if len(centres) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), rows in keyed_runs(batches, 1, 2048):
            home, lists = np.zeros(rows.num_rows, np.int32), pa.array([[]] * rows.num_rows, pa.list_(pa.int32()))
            if apart is not None and dim == centres.shape[1]:
                near = unit(matrix(rows.column("embedding"))) @ centres.T
                home = near.argmax(axis=1).astype(np.int32)
                over = near[np.arange(len(home)), home][:, None] - near <= slack * chord * apart[home] + 1e-9
                who, which = np.nonzero(over & (np.arange(len(centres)) < home[:, None]))
                ends = np.searchsorted(who, np.arange(len(home) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(which, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(rows.num_columns)), pa.array(home), lists], [*rows.schema.names, "home", "guest_of"])

    kept = nodes.select("dim", "node", "label", "copies", "embedding")
    return stage_table(kept.mapInArrow(run, kept.schema.simpleString()[7:-1] + ", home int, guest_of array<int>"), "vector-cells")


def in_blocks(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """label, dim, cell, block, visits, node, copies, embedding: each vector in its own block and where it visits."""
    own = ["label", "dim", "cell"]
    sizes = cells.groupBy("label", "dim", F.col("home").alias("cell")).count()
    sizes = stage_table(sizes.select(*[F.col(c).alias(f"_{c}") for c in own], F.ceil(F.col("count") / block).cast("int").alias("blocks")), "vector-sizes")
    spots = cells.withColumn("cell", F.explode(F.concat(F.array("home"), "guest_of"))).withColumn("guest", F.col("cell") != F.col("home"))
    joined = spots.join(sizes, [F.col(c) == F.col(f"_{c}") for c in own])
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    last = F.when(F.col("guest"), F.col("blocks") - 1).otherwise(place)
    met = joined.withColumn("block", F.explode(F.sequence(F.lit(0), last))).withColumn("visits", F.col("guest") | (F.col("block") != place))
    return met.select(*own, "block", "visits", "node", "copies", "embedding")


class _Block:
    """The vectors that a task holds, with their links so far."""

    def __init__(self, least: float) -> None:
        self.least, self.parts, self.node, self.links = least, [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def hold(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def _compare_held(self) -> None:
        """Once all residents are there, compare them with each other."""
        if not self.parts:
            return
        table, self.parts = pa.Table.from_batches(self.parts), []
        self.node, self.copies = (table.column(c).to_numpy() for c in ("node", "copies"))
        self.vectors = unit(matrix(table.column("embedding").combine_chunks()))
        self.root, self.links = np.arange(len(self.node)), np.zeros(len(self.node), np.int64)
        for at in range(0, len(self.node), BLOCK):
            near = self.vectors[at : at + BLOCK] @ self.vectors.T >= self.least
            near[np.arange(len(near)), np.arange(at, at + len(near))] = False
            self.links[at : at + BLOCK] = near @ self.copies
            a, b = np.nonzero(near)
            union(self.root, a + at, b)

    def visit(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """node, links, root of the visitors that link with a resident."""
        self._compare_held()
        if not len(self.node):
            return
        near = unit(matrix(rows.column("embedding"))) @ self.vectors.T >= self.least
        who, whom = np.nonzero(near)
        if len(who):
            node, copies = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies"))
            self.links += copies @ near
            held = len(self.root)
            root = np.concatenate([self.root, held + np.arange(len(node))])
            union(root, held + who, whom)
            self.root = root[:held]
            linked = np.unique(who)
            yield _links(node[linked], (near @ self.copies)[linked], self.node[root[held + linked]])

    def found(self) -> Iterator[pa.RecordBatch]:
        """node, links, root of the residents that have links, when all visitors are through."""
        self._compare_held()
        linked = np.flatnonzero(self.links)
        if len(linked):
            yield _links(self.node[linked], self.links[linked], self.node[self.root[linked]])


def _links(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "root"])


def block_links(blocks: DataFrame, least: float = LEAST) -> DataFrame:
    """node, links, root: what each comparison of a block found of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, _Block(least)
        for (*new, visits), rows in keyed_runs(batches, 5, BLOCK):
            if new != key:
                yield from block.found()
                key, block = new, _Block(least)
            if visits:
                yield from block.visit(rows)
            else:
                block.hold(rows)
        yield from block.found()

    order = ["label", "dim", "cell", "block"]
    return blocks.repartition(*order).sortWithinPartitions(*order, "visits").mapInArrow(run, "node long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = LEAST, cell: int = CELL, block: int = BLOCK, slack: float = SLACK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, nodes = distinct_vectors(vectors)
    cells = in_cells(nodes, centroids(nodes, cell), least, slack)
    found = stage_table(block_links(in_blocks(cells, block), least), "vector-links")
    links = found.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("links"))
    roots = stage_table(components(found, "node", "root"), "vector-roots")
    facts = nodes.select("key", "node", "least_id", "copies").join(links, F.col("node") == F.col("_node"), "left").drop("_node")
    facts = facts.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").where("copies > 1 OR links IS NOT NULL")
    facts = stage_table(facts.select("key", "least_id", "copies", "links", F.coalesce("root", "node").alias("root")), "vector-facts")
    least_ids = facts.groupBy(F.col("root").alias("_root")).agg(F.min("least_id").alias("least"))
    named = facts.join(least_ids, F.col("root") == F.col("_root")).select(F.col("key").alias("_key"), F.struct("copies", "links", "least").alias("fact"))
    joined = rows.join(stage_table(named, "vector-classes"), F.col("key") == F.col("_key"), "left")
    n_links = F.when(F.col("fact").isNull(), F.lit(0)).otherwise(F.col("fact.copies") - 1 + F.coalesce("fact.links", F.lit(0)))
    out = joined.select("vec_id", n_links.cast("long").alias("n_links"), F.when(F.col("fact").isNull(), F.col("vec_id")).otherwise(F.col("fact.least")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(read_table(spark, folder, "embeddings"))


def vectors_sql(table: str) -> str:
    """DuckDB SQL with the rows of near_vectors over ``table``."""
    return f"""
WITH RECURSIVE able AS (SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS e FROM {table}),
fit AS (SELECT * FROM able WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.k, b.k AS other FROM fit a JOIN fit b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= {LEAST}),
reach AS (SELECT k, k AS other FROM able UNION SELECT r.k, l.other FROM reach r JOIN links l ON r.other = l.k),
least AS (SELECT r.k, min(o.vec_id) AS component_id FROM reach r JOIN able o ON r.other = o.k GROUP BY r.k),
counts AS (SELECT k, count(*) AS n FROM links GROUP BY k)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM able JOIN least USING (k) LEFT JOIN counts USING (k)"""


QUERIES = {"op13_vectors": op13_vectors}
ORACLES = {"op13_vectors": vectors_sql("embeddings")}
