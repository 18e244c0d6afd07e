"""Similarity expressions for marks: trigram, edit ratio, class overlap, weighted score."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import pt_phonetic_code


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two strings; a string's table row is the bits of one integer."""

    def length(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        place: dict[str, int] = {}
        for j, c in enumerate(y):
            place[c] = place.get(c, 0) | 1 << j
        full = row = (1 << len(y)) - 1
        for c in x:
            hit = row & place.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(y) - row.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def text_similarity(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (lengths) of the lower-cased strings; 0 if either is empty."""
    la, lb = F.lower(a), F.lower(b)
    ok = (F.length(F.coalesce(a, F.lit(""))) > 0) & (F.length(F.coalesce(b, F.lit(""))) > 0)
    return F.when(ok, F.lit(200.0) * common_subsequence(la, lb) / (F.length(la) + F.length(lb))).otherwise(F.lit(0.0))


def code_similarity(a: Column, b: Column) -> Column:
    """100 if two non-empty codes are equal, else 0."""
    return F.when((a == b) & (a != ""), F.lit(100.0)).otherwise(F.lit(0.0))


def pt_phonetic_similarity(a: Column, b: Column) -> Column:
    return code_similarity(pt_phonetic_code(a), pt_phonetic_code(b))


def class_overlap(a: Column, b: Column) -> Column:
    known = (F.size(F.coalesce(a, F.array().cast("array<int>"))) > 0) & (F.size(F.coalesce(b, F.array().cast("array<int>"))) > 0)
    return F.when(known, jaccard(a, b) * 100).otherwise(F.lit(0.0))


def composite_score(text: Column, phonetic: Column, classes: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    t, p, c = weights
    if t + p + c == 0:
        return text
    return (text * t + phonetic * p + classes * c) / (t + p + c)


def similarity_band(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 70, "medium").otherwise("low")
