"""Registration of queries, and the bindings of the test tables to the registry's notions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: "Today" of all queries, so that results don't change with the date.
TODAY = "2000-06-15"


def query(name: str, sql: str | None = None):
    """Register ``f(read)`` as a query; ``read(table)`` gives a table."""

    def register(f):
        QUERIES[name] = lambda spark, folder: f(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def today() -> Column:
    return F.lit(TODAY).cast("date")


def mark_name() -> Column:
    """The binding of a word mark: a part's whole name and type."""
    return F.concat_ws(" ", "p_name", "p_type")


SQL_MARK = "concat_ws(' ', p_name, p_type)"
SQL_TODAY = f"DATE '{TODAY}'"


def sql_fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def sql_trigrams(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\pL\\pN]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def sql_jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0.0::DOUBLE)"


def sql_lcs(a: str, b: str) -> str:
    return (
        f"list_reduce(string_split({a}, ''), lambda prev, ca: list_reduce(range(1, length({b}) + 1)::BIGINT[], lambda done, j: list_append(done, CASE WHEN substr({b}, j[1], 1) = ca THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], done[-1]) END), [0]), list_transform(range(0, length({b}) + 1), lambda z: 0))[-1]"
    )


def sql_pt_code(x: str) -> str:
    out = sql_fold(x)
    for a, b in (("lh", "l"), ("nh", "n"), ("ss", "s"), ("ph", "f"), ("ch", "x"), ("x", "ks")):
        out = f"replace({out}, '{a}', '{b}')"
    for a, b in (("c[ei]", "s"), ("qu[ei]", "k"), ("gu[ei]", "g"), ("h", "")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"list_reduce(string_split({out}, ''), lambda done, c: CASE WHEN right(done, 1) = c THEN done ELSE done || c END, '')"
