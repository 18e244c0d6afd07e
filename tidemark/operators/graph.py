"""Chains of parent pointers: roots, heads, children, depths and cycles, by pointer jumping.

Every round doubles how far a pointer reaches, so a chain of n revisions takes about log2(n) rounds, each a join
of the rows that are still under way with all. If a round finishes no row, what is left runs into a cycle.
The joins sort and merge, so no round sends a table through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import drop_staged, staged


def revision_graph(revisions: DataFrame, key: str = "revision", parent: str = "parent") -> DataFrame:
    """key, root, depth, cycle, in_cycle, n_children, is_head of every revision.

    A revision without a parent, or whose parent isn't in the table, is a root (its own, at depth 0). One whose chain
    runs into a cycle has no root and depth; ``cycle`` is the least revision of that cycle, ``in_cycle`` says
    whether it is part of it itself. Heads are nobody's parents. Of rows that repeat a revision the one with the least
    parent counts (null first); null revisions take no part.
    """
    first = F.struct(F.col("up").isNotNull(), F.col("up"))
    own = revisions.select(F.col(key).alias("v"), F.col(parent).alias("up")).where("v is not null").groupBy("v").agg(F.min(first)["up"].alias("up"))
    links = staged(own, "graph-links")
    ids = links.select(F.col("v").alias("u"))
    known = links.join(ids.hint("merge"), F.col("up") == F.col("u"), "left")
    # v reaches ``at`` after ``steps``; ``low`` is the least revision on the way, v left out. done: ``at`` is a root.
    state = staged(known.select("v", F.coalesce("u", "v").alias("at"), F.when(F.col("u").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("u").alias("low"), F.col("u").isNull().alias("done")), "graph-state")
    children = state.where("not done").groupBy(F.col("at").alias("_of")).agg(F.count(F.lit(1)).alias("n_children"))
    children = staged(children, "graph-children")
    under_way = None
    while True:
        left = state.where("not done").count()
        if not left or left == under_way:
            break
        under_way = left
        state = _jumped(state)
    rounds = max(0, left - 1).bit_length()
    for _ in range(rounds):  # every pointer of the rest ends on a cycle, and has seen all of it
        state = _jumped(state)
    on_cycle = state.where("not done").select(F.col("at").alias("_on"), F.lit(True).alias("in_cycle")).distinct()
    cycles = state.where("not done").select(F.col("v").alias("_end"), F.col("low").alias("cycle"))
    own = state.join(on_cycle.hint("merge"), F.col("v") == F.col("_on"), "left").join(children.hint("merge"), F.col("v") == F.col("_of"), "left")
    # A root may have most of the rows; only the rest looks for its cycle.
    closed = own.where("not done").join(cycles.hint("merge"), F.col("at") == F.col("_end"), "left")
    out = closed.drop("_end").unionByName(own.where("done").withColumn("cycle", F.lit(None).cast(cycles.schema["cycle"].dataType)))
    return out.select(
        F.col("v").alias(key), F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("steps")).alias("depth"), "cycle",
        F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().alias("is_head"),
    )


def _jumped(state: DataFrame) -> DataFrame:
    """The state after one more round, staged."""
    target = state.select(F.col("v").alias("_v"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("low").alias("_low"), F.col("done").alias("_done"))
    met = state.where("not done").join(target.hint("merge"), F.col("at") == F.col("_v"))
    moved = met.select("v", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("low", "_low").alias("low"), F.col("_done").alias("done"))
    after = staged(moved.unionByName(state.where("done")), "graph-state")
    drop_staged(state)
    return after
