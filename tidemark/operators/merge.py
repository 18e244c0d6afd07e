"""Idempotent merges: outcomes, versions with diffs, link reconciliation, latest-wins dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(new: Column, old: Column) -> Column:
    """The new value unless it is null or empty."""
    return F.when(new.isNotNull() & (F.length(new.cast("string")) > 0), new).otherwise(old)


def merge(current: DataFrame, batch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row a key of either side: its merged fields and the outcome.

    created: only in the batch; unchanged: nothing new; updated: a non-empty value differs; kept: only in
    current; skipped: a batch row without key.
    """
    old = current.select(F.col(key), F.struct(*fields).alias("_old"))
    new = batch.select(F.col(key), F.struct(*fields).alias("_new"))
    joined = old.join(new, key, "full")
    merged = {f: filled(F.col("_new")[f], F.col("_old")[f]) for f in fields}
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~merged[f].eqNullSafe(F.col("_old")[f])
    outcome = (
        F.when(F.col(key).isNull(), "skipped").when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").when(differs, "updated").otherwise("unchanged")
    )
    changed = F.array_compact(F.array(*[F.when(~merged[f].eqNullSafe(F.col("_old")[f]), F.lit(f)) for f in fields]))
    return joined.select(key, *[merged[f].alias(f) for f in fields], outcome.alias("outcome"), changed.alias("changed"))


def merge_in_order(current: DataFrame, batch: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """One row a batch row, as if the rows were merged one after the other: merged fields, outcome, changed, version.

    A value that is not empty stays until the next one, so the state after a row is the last such value of
    each field, the current row coming first; a key that occurs twice gives two versions. ``version`` counts the
    key's created and updated rows of the batch. Rows without key are skipped and keep their fields. Ties in
    ``order`` are broken by the fields.
    """
    turn = [F.col(c) for c in dict.fromkeys([*order, *fields])]
    rows = batch.select(*dict.fromkeys([key, *fields, *order]), F.lit(1).alias("_turn")).unionByName(current.select(key, *fields, F.lit(0).alias("_turn")), allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("_turn", *turn)
    so_far = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = lambda f: F.last(F.when(F.length(F.col(f).cast("string")) > 0, F.col(f)), ignorenulls=True).over(so_far)
    state = rows.select(key, "_turn", *turn, *[value(f).alias(f"_{f}") for f in fields], F.row_number().over(upto).alias("_place"))
    prior = state.withColumns({f"_{f}_before": F.lag(f"_{f}").over(Window.partitionBy(key).orderBy("_place")) for f in fields})
    differs = [~F.col(f"_{f}").eqNullSafe(F.col(f"_{f}_before")) for f in fields]
    any_differs = differs[0]
    for d in differs[1:]:
        any_differs = any_differs | d
    outcome = F.when(F.col(key).isNull(), "skipped").when(F.col("_place") == 1, "created").when(any_differs, "updated").otherwise("unchanged")
    changed = F.array_compact(F.array(*[F.when(d, F.lit(f)) for d, f in zip(differs, fields, strict=True)]))
    out = prior.withColumns({"outcome": outcome, "changed": changed})
    version = F.sum(F.when((F.col("_turn") == 1) & F.col("outcome").isin("created", "updated"), 1).otherwise(0)).over(Window.partitionBy(key).orderBy("_place"))
    merged = [F.when(F.col(key).isNull(), F.col(f)).otherwise(F.col(f"_{f}")).alias(f) for f in fields]
    extra = [c for c in order if c not in fields and c != key]
    return out.withColumn("version", version).where("_turn = 1").select(key, *extra, *merged, "outcome", "changed", "version")


def _empty(x: Column) -> Column:
    return x.isNull() | x.isin("", "[]", "{}")


def snapshot_diff(old: Column, new: Column) -> Column:
    """Struct of maps of two map<string,string> snapshots: added, removed, changed (field -> values)."""
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    a, b = (lambda k: F.try_element_at(old, k)), (lambda k: F.try_element_at(new, k))
    pick = lambda keep, value: F.map_from_entries(F.transform(F.filter(keys, keep), lambda k: F.struct(k, value(k))))
    pair = lambda k: F.concat(F.coalesce(a(k), F.lit("null")), F.lit(" -> "), F.coalesce(b(k), F.lit("null")))
    return F.struct(
        pick(lambda k: _empty(a(k)) & ~_empty(b(k)), b).alias("added"),
        pick(lambda k: ~_empty(a(k)) & _empty(b(k)), a).alias("removed"),
        pick(lambda k: ~a(k).eqNullSafe(b(k)) & (_empty(a(k)) == _empty(b(k))), pair).alias("changed"),
    )


def change_kind(touched: Column) -> Column:
    """The kind of a change, from the names of the touched fields."""
    has = lambda *names: F.arrays_overlap(touched, F.array(*[F.lit(n) for n in names]))
    return F.when(has("status"), "status_change").when(has("applicants"), "owner_change").when(has("renewal_status"), "renewal_update").when(has("nice_classes", "goods_services"), "classification_change").otherwise("update")


def versions(changes: DataFrame, key: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """version_number of each change: after the key's highest existing one, in arrival order."""
    numbered = changes.withColumn("version_number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    if existing is None:
        return numbered
    top = existing.groupBy(key).agg(F.max("version_number").alias("_top"))
    return numbered.join(top, key, "left").withColumn("version_number", F.col("version_number") + F.coalesce("_top", F.lit(0))).drop("_top")


def reconcile_links(existing: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """keep, insert or delete for every link of either side."""
    a, b = existing.select(*keys).distinct().withColumn("_a", F.lit(True)), desired.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("_a") & F.col("_b"), "keep").when(F.col("_b"), "insert").otherwise("delete").alias("action"))
